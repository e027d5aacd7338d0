"""Public-transport data jobs on Spark: timetables, real-time history and delay analytics."""
