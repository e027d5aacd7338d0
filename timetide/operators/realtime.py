"""Merging observations into the history tables: upserts, tails, stop versions, snapshot deltas, dating of bare times.

`seq` is the arrival order of observations. All upserts take the union of stored and new rows and keep
one row per key, so a replay gives what a single write gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["trip_id", "trip_start_date"]
STOP_KEY = [*RUN, "trip_stop_index"]
DAY = 86_400


def flatten_observations(observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coordinates, stop rows, details) of nested observations.

    Columns: trip_id, trip_start_date, observation_time, lat, lon, route_id, short_name, route_short_name,
    seq, stops (array of structs with trip_stop_index). A missing position gives no coordinate row."""
    coords = observations.where("lat is not null and lon is not null").select(*RUN, "observation_time", "lat", "lon", "seq")
    stops = observations.select(*RUN, "seq", F.inline("stops"))
    return coords, stops, observations.select(*RUN, "route_id", "short_name", "route_short_name", "seq")


def last_write(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row per key: the one written last; of rows with one seq the greatest."""
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    last = F.max(F.struct(seq, *rest)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest], F.col(f"_last.{seq}").alias(seq))


def upsert_stop_history(rows: DataFrame) -> DataFrame:
    return last_write(rows, STOP_KEY)


def upsert_coord_history(rows: DataFrame) -> DataFrame:
    return last_write(rows, [*RUN, "observation_time"])


def tail_log(writes: DataFrame) -> DataFrame:
    """trip_id, trip_start_date, seq, top: of the writes (seq, top: highest index) of each run those that can still cut a tail.

    A write that a later one reaches no further than says nothing more, so that of a run at most one write per
    index stays, and the log of a union of logs is that of all their writes."""
    per = writes.groupBy(*RUN, "seq").agg(F.max("top").alias("top"))
    # the newest first: a frame that only grows is linear, one that only shrinks is worked out anew for each row
    later = Window.partitionBy(*RUN).orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_later", F.min("top").over(later)).where("_later is null or top < _later").drop("_later")


def writes_of(rows: DataFrame) -> DataFrame:
    """A write is all rows of one (run, seq); writes without rows are not seen and so ignored."""
    return rows.groupBy(*RUN, "seq").agg(F.max("trip_stop_index").alias("top"))


def truncate_tail(rows: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """upsert_stop_history with tails cut: a row goes if any later write of its run had no index as high.

    Where rows are what is left of earlier writes, log (tail_log) has all the writes; else rows tell them."""
    log = tail_log(writes_of(rows)) if log is None else log
    last = upsert_stop_history(rows)
    row = F.struct(*last.columns)
    both = last.select(*RUN, "seq", F.lit(None).cast("int").alias("top"), row.alias("row")).unionByName(log.select(*RUN, "seq", "top"), allowMissingColumns=True)
    later = Window.partitionBy(*RUN).orderBy(F.col("seq").desc()).rangeBetween(Window.unboundedPreceding, -1)
    kept = both.withColumn("shortest", F.min("top").over(later)).where("row is not null and (shortest is null or row.trip_stop_index <= shortest)")
    return kept.select("row.*")


def upsert_trip_details(rows: DataFrame) -> DataFrame:
    """Route and short name of the newest write, route short name of the first."""
    new, old = F.struct("seq", "route_id", "short_name"), F.struct("seq", "route_short_name")
    return rows.groupBy(*RUN).agg(F.max(new).alias("n"), F.min(old).alias("o")).select(*RUN, "n.route_id", "n.short_name", "o.route_short_name")


def stops_scd2(days: DataFrame) -> DataFrame:
    """id, name, lat, lon, valid_from, valid_to (exclusive) from one observation per (id, name, day).

    Consecutive days with the same coordinates are one range; missing coordinates never extend one. Where
    two names share an id and a one-day range, the greatest name stays."""
    w = Window.partitionBy("id", "name").orderBy("day")
    same = (F.lag("lat").over(w) == F.col("lat")) & (F.lag("lon").over(w) == F.col("lon")) & (F.date_add(F.lag("day").over(w), 1) == F.col("day"))
    marked = days.withColumn("fresh", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w))
    spans = marked.groupBy("id", "name", "island").agg(F.min("day").alias("valid_from"), F.date_add(F.max("day"), 1).alias("valid_to"), F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    one = Window.partitionBy("id", "valid_from", "valid_to").orderBy(F.col("name").desc())
    short = F.datediff("valid_to", "valid_from") == 1
    ranked = spans.withColumn("rank", F.row_number().over(one))
    return ranked.where(~short | (F.col("rank") == 1)).select("id", "name", "lat", "lon", "valid_from", "valid_to")


def snapshot_delta(snapshots: DataFrame) -> DataFrame:
    """What each train's record adds to the stop history, against the train's record in the snapshot just before.

    Columns in: train, snapshot_no (consecutive numbers), last_point, staying, planned, measured (seconds of
    the day). Out: train, snapshot_no, stop, stop_index (minute + 100 * hour of the planned time), arrived,
    should_arrive, departed, should_depart, kind: 'arrival' (stands there), 'full' (left the point where it
    stood; arrival values of the older record), 'departure' (passed), or 'error' (a time is missing).
    An unchanged record adds nothing; a train absent from the snapshot before has no older record."""
    rows = with_older(snapshots)
    return delta_rows(rows.where(~_record().eqNullSafe(F.col("old"))))


def _record() -> Column:
    return F.struct("last_point", "staying", "planned", "measured")


def with_older(snapshots: DataFrame) -> DataFrame:
    """snapshots with `old`: the train's record in the snapshot just before, null where it was absent."""
    w = Window.partitionBy("train").orderBy("snapshot_no")
    return snapshots.withColumn("old", F.when(F.lag("snapshot_no").over(w) == F.col("snapshot_no") - 1, F.lag(_record()).over(w)))


def delta_rows(rows: DataFrame, *more: str) -> DataFrame:
    """The row for a changed record next to its older one (`old`, may be null), and the columns `more`; shared with the stream."""
    left = F.coalesce(~F.col("staying") & F.col("old.staying") & (F.col("old.last_point") == F.col("last_point")), F.lit(False))
    missing = F.col("planned").isNull() | F.col("measured").isNull() | (left & (F.col("old.planned").isNull() | F.col("old.measured").isNull()))
    kind = F.when(missing, "error").when(F.col("staying"), "arrival").when(left, "full").otherwise("departure")
    at = F.when(left, F.col("old.planned")).otherwise(F.col("planned"))
    index = (F.floor(at / 60) % 60 + 100 * F.floor(at / 3600)).cast("int")
    here = lambda c: F.when(kind == "arrival", F.col(c)).when(kind == "full", F.col(f"old.{c}"))
    gone = lambda c: F.when(kind.isin("full", "departure"), F.col(c))
    return rows.select("train", "snapshot_no", F.col("last_point").alias("stop"), F.when(kind != "error", index).alias("stop_index"), here("measured").alias("arrived"), here("planned").alias("should_arrive"), gone("measured").alias("departed"), gone("planned").alias("should_depart"), kind.alias("kind"), *more)


def date_bare_times(times: DataFrame, keys: list[str], order: str = "pos", time: str = "time_sec") -> DataFrame:
    """times with `day`: the date of each bare time, given that an element was seen at a clock.

    In order, each time smaller than the one before it (nulls skipped) starts a new day. The element at or
    after fixed_pos that is present was seen at (clock_date, clock_sec): its day is clock_date, or the day
    before if its time is later than the clock. Nulls keep a null day; with no element at or after
    fixed_pos every day is null."""
    run = Window.partitionBy(*keys).orderBy(order)
    before = F.last(time, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    steps = times.withColumn("_drop", F.when(F.col(time) < before, 1).otherwise(0)).withColumn("_n", F.sum("_drop").over(run))
    whole = Window.partitionBy(*keys)
    fixed = F.min(F.when((F.col(order) >= F.col("fixed_pos")) & F.col(time).isNotNull(), F.struct(order, "_n", time))).over(whole)
    steps = steps.withColumn("_k", fixed)
    shift = F.col("_n") - F.col("_k._n") - F.when(F.col(f"_k.{time}") > F.col("clock_sec"), 1).otherwise(0)
    return steps.withColumn("day", F.when(F.col(time).isNotNull(), F.date_add("clock_date", shift.cast("int")))).drop("_drop", "_n", "_k")


def date_stop_history(stops: DataFrame, keys: list[str]) -> DataFrame:
    """Stop rows (pos, arrived, should_arrive, departed, should_depart as seconds of a day) with a date to each time.

    Planned and actual times are dated apart, each as one series arrival, departure, arrival, …; fixed_pos
    counts in that series (as the reference does; give 2 * stop for the stop itself)."""
    out = stops
    for arr, dep in (("arrived", "departed"), ("should_arrive", "should_depart")):
        both = stops.select(*keys, "pos", "fixed_pos", "clock_date", "clock_sec", F.posexplode(F.array(arr, dep)).alias("side", "time_sec"))
        both = both.withColumn("at", F.col("pos") * 2 + F.col("side"))
        dated = date_bare_times(both, keys, order="at").groupBy(*keys, "pos").agg(F.max(F.when(F.col("side") == 0, F.col("day"))).alias(f"{arr}_day"), F.max(F.when(F.col("side") == 1, F.col("day"))).alias(f"{dep}_day"))
        out = out.join(dated, [*keys, "pos"])
    return out


def day_of_bare_time(time: Column, clock_date: Column, clock_sec: Column, literal: bool = False) -> Column:
    """The day of a bare time seen at a clock: the day before if it lies more than 12 h ahead of the clock.

    literal=True compares with (clock + 12 h) taken as a time of day, as the reference does."""
    ahead = (time > (clock_sec + DAY // 2) % DAY) if literal else (time - clock_sec > DAY // 2)
    return F.when(ahead, F.date_sub(clock_date, 1)).otherwise(clock_date)


def delta_stop_rows(deltas: DataFrame, stops: DataFrame, prefix: str = "SZMAPAST-") -> DataFrame:
    """Stop rows of delta_rows with `taken` and `short_name`: trip and day from the train's id, ids of stops by name, times with
    their days. A train id of another form gives a null trip_id."""
    part = F.split("train", "/")
    at = lambda k: F.get(part, F.lit(k))
    trip = F.concat(F.lit("-CZTRAINT-"), at(4), F.lit(":"), at(1), F.lit(":"), at(2), F.lit(":"), at(3))
    start = F.when(at(5).rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(at(5), 1, 4), F.substring(at(5), 5, 2), F.substring(at(5), 7, 2))).try_cast("date")
    day, clock = F.to_date("taken"), (F.hour("taken") * 3600 + F.minute("taken") * 60 + F.second("taken"))
    time = lambda c: F.when(F.col(c).isNotNull(), day_of_bare_time(F.col(c), day, clock, literal=True).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(c).cast("decimal(18,6)")))
    named = stop_ids(deltas.withColumn("stop_name", F.col("stop")), stops, prefix)
    return named.select(
        F.when(start.isNotNull(), trip).alias("trip_id"), start.alias("trip_start_date"), F.col("stop_index").alias("trip_stop_index"), "stop_id", F.lit("Europe/Prague").alias("time_zone"),
        time("arrived").alias("arrived_at"), time("should_arrive").alias("should_arrive_at"), time("departed").alias("departed_at"), time("should_depart").alias("should_depart_at"),
        F.col("kind").isin("arrival", "full").alias("stopped"), F.col("snapshot_no").cast("long").alias("seq"), "train", "kind", "short_name",
    )


def stop_ids(names: DataFrame, stops: DataFrame, prefix: str) -> DataFrame:
    """names (stop_name) with stop_id: the smallest id of that name, else prefix and the name with underscores."""
    ids = stops.groupBy(F.col("name").alias("stop_name")).agg(F.min("id").alias("_id"))
    fallback = F.concat(F.lit(prefix), F.replace("stop_name", F.lit(" "), F.lit("_")))
    return names.join(ids, "stop_name", "left").withColumn("stop_id", F.coalesce("_id", fallback)).drop("_id")
