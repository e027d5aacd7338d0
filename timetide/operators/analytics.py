"""Delay analytics over the history tables.

Times are seconds of the day of `trip_start_date`; (trip_id, trip_start_date) is a run. Where several
operators follow each other on the same runs they keep the partitioning by trip_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["trip_id", "trip_start_date"]


def named_stops(history: DataFrame, versions: DataFrame, any_version: bool = True) -> DataFrame:
    """history with `name`: the stop's version valid on the day, else (any_version) its first version, else the id.

    Versions are few per id; both joins are left joins on the id, and one row per history row is kept
    (of overlapping versions the one that began last, then the smallest name)."""
    spans = versions.select(F.col("id").alias("_id"), "valid_from", "valid_to", F.col("name").alias("_valid"))
    day = F.col("trip_start_date")
    on = (F.col("stop_id") == F.col("_id")) & (day >= F.col("valid_from")) & (day < F.col("valid_to"))
    keys = [*RUN, "trip_stop_index", "stop_id"]
    days = history.select("stop_id", "trip_start_date").distinct().join(spans, on, "left")
    days = days.groupBy("stop_id", "trip_start_date").agg(F.max_by("_valid", F.struct("valid_from", "_valid")).alias("_valid"))
    named = history.join(days, ["stop_id", "trip_start_date"], "left")
    if any_version:
        first = versions.groupBy(F.col("id").alias("stop_id")).agg(F.min_by("name", F.struct("valid_from", "name")).alias("_any"))
        named = named.join(first, "stop_id", "left")
    else:
        named = named.withColumn("_any", F.lit(None).cast("string"))
    return named.withColumn("name", F.coalesce("_valid", "_any", "stop_id")).drop("_valid", "_any").select(*keys, *[c for c in history.columns if c not in keys], "name")


def sequence_hash() -> Column:
    """Of a run's ordered `rows`, a hash of their stops and planned times."""
    plan = F.transform("rows", lambda r: F.struct(r["stop_id"], r["should_arrive"], r["should_depart"]))
    return F.sha2(F.to_json(F.struct(plan.alias("s"))), 256)


def run_sequences(history: DataFrame) -> DataFrame:
    """Runs with the hash of their ordered (stop, planned arrival, planned departure) list."""
    rows = F.sort_array(F.collect_list(F.struct("trip_stop_index", "stop_id", "should_arrive", "should_depart")))
    listed = history.groupBy(*RUN).agg(rows.alias("rows"))
    return listed.select(*RUN, sequence_hash().alias("sequence"))


def sequence_groups(history: DataFrame) -> DataFrame:
    """trip_id, ssg (first day), dates (sorted), n: the runs of a trip with the same stop sequence and plan."""
    w = Window.partitionBy("trip_id", "sequence")
    marked = run_sequences(history).withColumn("ssg", F.min("trip_start_date").over(w))
    return marked.groupBy("trip_id", "ssg").agg(F.sort_array(F.collect_list("trip_start_date")).alias("dates"), F.count("*").alias("n"))


def same_sequence_dates(history: DataFrame, trip_id: str, day: Column) -> DataFrame:
    """The days on which a trip ran as it did on the given day."""
    own = run_sequences(history.where(F.col("trip_id") == trip_id))
    wanted = own.where(F.col("trip_start_date") == day).select("sequence")
    return own.join(F.broadcast(wanted), "sequence", "left_semi").select(*RUN)


def delay_percentiles(named: DataFrame, points: tuple[float, ...] = (0.15, 0.5, 0.85), approximate: bool = False) -> DataFrame:
    """Per stop of each stop-sequence group: first planned times and percentiles of the delays in minutes.

    Exact percentiles hold a group's values; groups are one stop of one sequence of one trip. For groups
    of a whole network take approximate=True."""
    # the stops of a run travel as one row, so that finding its group needs no second pass over them
    stop = F.struct("trip_stop_index", "stop_id", "should_arrive", "should_depart", "name", "arrived", "departed")
    listed = named.groupBy(*RUN).agg(F.sort_array(F.collect_list(stop)).alias("rows")).withColumn("sequence", sequence_hash())
    grouped = listed.withColumn("ssg", F.min("trip_start_date").over(Window.partitionBy("trip_id", "sequence")))
    rows = grouped.select("trip_id", "ssg", F.inline("rows")).withColumn("arr", (F.col("arrived") - F.col("should_arrive")) / 60).withColumn("dep", (F.col("departed") - F.col("should_depart")) / 60)
    measure = (lambda c: F.percentile_approx(c, list(points), 1000)) if approximate else (lambda c: F.percentile(c, F.array(*map(F.lit, points))))
    out = rows.groupBy("trip_id", "ssg", "trip_stop_index", "stop_id", "name").agg(F.min("should_arrive").alias("should_arrive"), F.min("should_depart").alias("should_depart"), measure("arr").alias("arr"), measure("dep").alias("dep"))
    names = [f"{k}_p{round(100 * p)}" for k in ("arr", "dep") for p in points]
    values = [F.col(k)[i] for k in ("arr", "dep") for i in range(len(points))]
    return out.select("trip_id", "ssg", "trip_stop_index", "stop_id", "name", "should_arrive", "should_depart", *[v.alias(n) for v, n in zip(values, names)])


def route_summaries(details: DataFrame, history: DataFrame, versions: DataFrame) -> DataFrame:
    """Per route its latest run (of one day the smallest trip id as text), first and last day, name, and the first and last stop of that run."""
    latest = F.min(F.struct((-F.unix_date("trip_start_date")).alias("back"), "trip_id", "trip_start_date")).alias("run")
    named_on = F.max_by("route_short_name", F.when(F.col("route_short_name").isNotNull(), F.struct("trip_start_date", "route_short_name")))
    per = details.groupBy("route_id").agg(latest, F.min("trip_start_date").alias("first_date"), F.max("trip_start_date").alias("last_date"), named_on.alias("short"))
    per = per.select("route_id", "run.trip_id", "run.trip_start_date", "first_date", "last_date", F.coalesce("short", "route_id").alias("name"))
    stops = named_stops(history.join(per.select(*RUN), RUN, "left_semi"), versions, any_version=False)
    ends = stops.groupBy(*RUN).agg(F.min_by("name", "trip_stop_index").alias("first_stop"), F.max_by("name", "trip_stop_index").alias("last_stop"))
    return per.join(ends, RUN, "left").select("route_id", "name", "trip_id", "trip_start_date", "first_date", "last_date", "first_stop", "last_stop")


def route_occurrences(details: DataFrame, start: Column, end: Column) -> DataFrame:
    return details.where(F.col("trip_start_date").between(start, end)).groupBy("route_id").agg(F.count("*").alias("n"))


def routes_calling_at(details: DataFrame, named: DataFrame, predicate: Column, start: Column, end: Column) -> DataFrame:
    """Runs in the date range that call at a stop meeting the predicate over (name, arrived, departed, should_arrive, should_depart)."""
    calls = named.where(F.col("trip_start_date").between(start, end) & predicate).select(*RUN).distinct()
    return details.where(F.col("trip_start_date").between(start, end)).join(calls, RUN, "left_semi")


def contains(column: str, text: str) -> Column:
    return F.col(column).ilike("%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%")


def equals(column: str, value) -> Column:
    return F.lower(column) == value.lower() if isinstance(value, str) else F.col(column) == F.lit(value)


def less(column: str, value) -> Column:
    return F.col(column) < F.lit(value)


def greater(column: str, value) -> Column:
    return F.col(column) > F.lit(value)


def all_of(*predicates: Column) -> Column:
    """Conjunction; with none, everything."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def delays(history: DataFrame) -> DataFrame:
    """history with delays in seconds and planned times as HH:MM."""

    def clock(c: str) -> Column:
        return F.format_string("%02d:%02d", F.floor(F.col(c) / 3600) % 24, F.floor(F.col(c) / 60) % 60)

    out = history.withColumn("arr_delay", F.col("arrived") - F.col("should_arrive")).withColumn("dep_delay", F.col("departed") - F.col("should_depart"))
    return out.withColumn("arr_text", F.when(F.col("should_arrive").isNotNull(), clock("should_arrive"))).withColumn("dep_text", F.when(F.col("should_depart").isNotNull(), clock("should_depart")))


def chart_x(history: DataFrame) -> DataFrame:
    """history with x_arr, x_dep: seconds from the run's first planned departure, kept apart.

    Ten seconds per earlier stop with the same planned time, one more for a departure planned as its arrival."""
    run = Window.partitionBy(*RUN)
    start = F.min_by("should_depart", "trip_stop_index").over(run)
    same = lambda c: F.row_number().over(Window.partitionBy(*RUN, c).orderBy("trip_stop_index")) - 1
    out = history.withColumn("x_arr", F.col("should_arrive") - start + 10 * same("should_arrive"))
    bump = F.when(F.col("should_arrive") == F.col("should_depart"), 1).otherwise(0)
    return out.withColumn("x_dep", F.col("should_depart") - start + 10 * same("should_depart") + bump)


def chart_series(history: DataFrame) -> DataFrame:
    """Distinct (run, x, delay) points of arrivals and departures."""
    x = delays(chart_x(history))
    arr = x.select(*RUN, F.col("x_arr").alias("x"), F.col("arr_delay").alias("delay"))
    dep = x.select(*RUN, F.col("x_dep").alias("x"), F.col("dep_delay").alias("delay"))
    return arr.union(dep).where("x is not null and delay is not null").distinct()


def series_json(series: DataFrame) -> DataFrame:
    """Each run's points as one JSON array in order of x, delay."""
    points = F.sort_array(F.collect_list(F.struct("x", "delay")))
    return series.groupBy(*RUN).agg(F.to_json(points).alias("points"))


def chart_labels(history: DataFrame, top: int = 10) -> DataFrame:
    """Stops to label: the first, the last, and the `top` longest planned stays where arrival and departure differ."""
    run = Window.partitionBy(*RUN)
    stay = F.when(F.col("should_arrive") != F.col("should_depart"), F.col("should_depart") - F.col("should_arrive"))
    ranked = history.withColumn("stay", stay)
    ranked = ranked.withColumn("place", F.row_number().over(run.orderBy(F.col("stay").desc_nulls_last(), "trip_stop_index")))
    ends = (F.col("trip_stop_index") == F.min("trip_stop_index").over(run)) | (F.col("trip_stop_index") == F.max("trip_stop_index").over(run))
    return ranked.withColumn("end", ends).where(F.col("end") | ((F.col("place") <= top) & F.col("stay").isNotNull())).select(*RUN, "trip_stop_index", "stop_id")


def delay_matrix(series: DataFrame) -> DataFrame:
    """Each run's delays in order of x."""
    pairs = F.sort_array(F.collect_list(F.struct("x", "delay")))
    return series.groupBy(*RUN).agg(F.transform(pairs, lambda p: p["delay"]).alias("delays"))


def heatmap_points(series: DataFrame, x_bin: int, y_bin: int) -> DataFrame:
    """Runs per cell of (x, delay), counting points only."""
    cell = series.select(*RUN, F.floor(F.col("x") / x_bin).cast("int").alias("cx"), F.floor(F.col("delay") / y_bin).cast("int").alias("cy"))
    return cell.distinct().groupBy("cx", "cy").agg(F.count("*").alias("runs"))


def heatmap(series: DataFrame, x_res: int = 120, y_res: int = 60, chosen: tuple[int, int] | None = None) -> DataFrame:
    """cx, cy, runs, alpha: distinct runs whose line of delays passes a cell; with `chosen`, only runs that pass that cell.

    The plane spans the least and greatest x and delay of the series. A line goes from point to point in
    even steps of half a cell at most; counting is by partial aggregation. alpha = sin(share of the
    fullest cell * pi / 2)."""
    box = series.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("delay").alias("y0"), F.max("delay").alias("y1"))
    scaled = lambda c, lo, hi, n: (F.col(c) - F.col(lo)).cast("double") / F.greatest(F.col(hi) - F.col(lo), F.lit(1)) * F.lit(n - 1)
    points = series.join(F.broadcast(box), F.lit(True)).select(*RUN, "x", "delay", scaled("x", "x0", "x1", x_res).alias("px"), scaled("delay", "y0", "y1", y_res).alias("py"))
    along = Window.partitionBy(*RUN).orderBy("x", "delay")
    lines = points.withColumn("qx", F.coalesce(F.lead("px").over(along), "px")).withColumn("qy", F.coalesce(F.lead("py").over(along), "py"))
    lines = lines.withColumn("n", F.floor(2 * F.greatest(F.abs(F.col("qx") - F.col("px")), F.abs(F.col("qy") - F.col("py")))).cast("int") + 1)
    steps = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda p, q: F.rint(F.col(p) + (F.col(q) - F.col(p)) * F.col("k") / F.col("n")).cast("int")
    drawn = steps.select(*RUN, at("px", "qx").alias("cx"), at("py", "qy").alias("cy")).distinct()
    if chosen is not None:
        through = drawn.where((F.col("cx") == chosen[0]) & (F.col("cy") == chosen[1])).select(*RUN)
        drawn = drawn.join(through, RUN, "left_semi")
    counted = drawn.groupBy("cx", "cy").agg(F.count("*").alias("runs"))
    most = counted.agg(F.max("runs").alias("most"))
    return counted.join(F.broadcast(most), F.lit(True)).select("cx", "cy", "runs", F.sin(F.col("runs") / F.col("most") * F.pi() / 2).alias("alpha"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def list_routes(summaries: DataFrame, start: Column, end: Column, text: str = "", page: int = 1, size: int = 25) -> DataFrame:
    """One page of the routes that ran in the range, by the first number in the name, then name and id; `total` counts all."""
    number = F.when(F.regexp_extract("name", r"\d+", 0) != "", F.regexp_extract("name", r"\d+", 0).cast("int"))
    fits = summaries.where((F.col("last_date") >= start) & (F.col("first_date") <= end))
    fits = fits.where(contains("name", text)) if text else fits
    total = fits.agg(F.count("*").alias("total"))
    paged = fits.withColumn("number", number).orderBy(F.col("number").asc_nulls_last(), "name", "route_id").offset((page - 1) * size).limit(size)
    return paged.join(F.broadcast(total), F.lit(True))


def route_trips(details: DataFrame, route_id: str, start: Column, end: Column) -> DataFrame:
    """The route's trips with their days; named by their short name (newest), else the id."""
    own = details.where((F.col("route_id") == route_id) & F.col("trip_start_date").between(start, end))
    newest = F.max_by("short_name", F.when(F.col("short_name").isNotNull(), F.col("trip_start_date")))
    return own.groupBy("trip_id").agg(F.coalesce(newest, F.first("trip_id")).alias("name"), F.sort_array(F.collect_list("trip_start_date")).alias("dates"))


def trip_run(named: DataFrame, trip_id: str, day: Column) -> DataFrame:
    return delays(named.where((F.col("trip_id") == trip_id) & (F.col("trip_start_date") == day))).orderBy("trip_stop_index")


def export_rows(table: DataFrame, id_column: str, pattern: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows whose id is LIKE the pattern and whose start day is in the range; both filters reach the scan."""
    out = table.where(F.col(id_column).like(pattern))
    return out if start is None else out.where(F.col("trip_start_date").between(start, end))


def export_csv(rows: DataFrame, path: str) -> None:
    """Write rows as CSV with a header, in as many files as they need."""
    rows.write.option("header", True).option("escape", '"').csv(path)
