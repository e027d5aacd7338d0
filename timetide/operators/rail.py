"""Railway timetable messages to GTFS tables, and the map of who runs where.

A message is one row: message_id, year, core, variant, start, bitmap, offset_days, and `locations`, one
row per message and position in its own table: message_id, pos, country, code, name, platform, company,
commercial, traffic, train_no, train_type, train_name, activities (array), arr_sec, dep_sec (seconds),
arr_offset, dep_offset (days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timetide.functions import text as T
from timetide.functions.lineage import cut, shuffled
from timetide.operators import calendars, timetable

#: Activity and train type codes with a meaning here. Fixed values.
INTERNAL, UNPUBLISHED, REQUEST_STOP, BOARD_ONLY, EXIT_ONLY, PUBLIC_TRAIN = "0002", "CZ13", "0030", "0028", "0029", "1"
DAY = 86_400


def is_public(activities: Column, train_type: Column) -> Column:
    hidden = F.arrays_overlap(activities, F.array(F.lit(INTERNAL), F.lit(UNPUBLISHED)))
    return F.coalesce((F.size(activities) > 0) & ~hidden & (train_type == PUBLIC_TRAIN), F.lit(False))


def public_locations(locations: DataFrame) -> DataFrame:
    return locations.where(is_public(F.col("activities"), F.col("train_type")))


def best_companies(companies: DataFrame) -> DataFrame:
    """One row per code: the one with most of its three licences, then the smallest name."""
    licences = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("licence_a", "licence_b", "licence_c")), F.lit(0))
    w = Window.partitionBy("code").orderBy(licences.desc(), "name")
    return companies.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_company_names(rows: DataFrame, companies: DataFrame) -> DataFrame:
    known = best_companies(companies).select(F.col("code").alias("company"), F.col("name").alias("company_name"))
    return rows.join(known, "company", "left").withColumn("company_name", F.coalesce("company_name", F.concat(F.lit("Unknown "), "company")))


def adjacent_segments(locations: DataFrame, key: str, pos: str, code: str, public: str, carry: list[str]) -> DataFrame:
    """key, a, b (codes of neighbouring locations, smaller first) between the first and the last public location."""
    run = Window.partitionBy(key)
    inside = locations.withColumn("_f", F.min(F.when(F.col(public), F.col(pos))).over(run)).withColumn("_l", F.max(F.when(F.col(public), F.col(pos))).over(run))
    inside = inside.where((F.col(pos) >= F.col("_f")) & (F.col(pos) <= F.col("_l")))
    then = inside.withColumn("_next", F.lead(code).over(run.orderBy(pos))).where("_next is not null")
    return then.select(key, F.least(code, "_next").alias("a"), F.greatest(code, "_next").alias("b"), *carry)


def segment_agencies(segments: DataFrame, key: str, operator: str) -> DataFrame:
    """a, b, operators: sorted (operator, number of trains) pairs of each segment."""
    trains = segments.select(key, "a", "b", operator).distinct().groupBy("a", "b", operator).agg(F.count("*").alias("n"))
    return trains.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct(F.col(operator).alias("operator"), "n"))).alias("operators"))


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the given total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def czptt_stop_list(locations: DataFrame) -> DataFrame:
    """Distinct (sr70, name), but for rows with neither."""
    pairs = locations.select(T.normal_sr70(F.coalesce(F.col("code").cast("string"), F.lit(""))).alias("sr70"), F.coalesce("name", F.lit("")).alias("name"), F.col("code").isNull().alias("none"))
    return pairs.where(~(F.col("none") & (F.col("name") == ""))).select("sr70", "name").distinct()


def czptt_stops(locations: DataFrame) -> DataFrame:
    """Public stops: the stop alone, or its station and a platform below it; first per id (smallest message, position)."""
    rows = public_locations(locations)
    station, stop = T.station_id(F.col("country"), F.col("code")), T.platform_id(F.col("country"), F.col("code"), F.col("platform"))
    has = F.col("platform").isNotNull()
    order = [F.col("message_id"), F.col("pos")]
    own = rows.select(stop.alias("stop_id"), F.col("name").alias("stop_name"), F.when(has, station).alias("parent_station"), F.col("platform").alias("platform_code"), F.lit(0).alias("location_type"), *order)
    parents = rows.where(has).select(station.alias("stop_id"), F.col("name").alias("stop_name"), F.lit(None).cast("string").alias("parent_station"), F.lit(None).cast("string").alias("platform_code"), F.lit(1).alias("location_type"), *order)
    return first_per_key(own.union(parents), ["stop_id"], ["message_id", "pos"]).drop("message_id", "pos")


def described_trains(messages: DataFrame, locations: DataFrame) -> DataFrame:
    """One row per message with a public location: what the first and last public ones say."""
    rows = public_locations(locations)
    first = F.min(F.struct("pos", "commercial", "traffic", "train_no", "train_name", "company")).alias("f")
    ends = rows.groupBy("message_id").agg(first, F.max(F.struct("pos", "name")).alias("l"))
    return messages.join(ends.select("message_id", "f.commercial", "f.traffic", "f.train_no", "f.train_name", "f.company", F.col("l.name").alias("headsign")), "message_id")


def czptt_trips(messages: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(routes, trips, rejected messages): a train of an unknown category is rejected, the others go on."""
    trains = described_trains(messages, locations).withColumn("route_type", T.rail_route_type(F.col("commercial"), F.col("traffic")))
    number = F.concat_ws(" ", F.coalesce("commercial", "traffic"), F.col("train_no").cast("string"))
    trains = trains.withColumn("short_name", number).withColumn("route_id", T.train_route_id(F.col("year"), number)).withColumn("trip_id", T.train_trip_id(F.col("year"), F.col("core"), F.col("variant")))
    good, bad = trains.where("route_type is not null"), trains.where("route_type is null")
    routes = first_per_key(good, ["route_id"], ["message_id"]).select("route_id", F.col("company").alias("agency_id"), F.col("short_name").alias("route_short_name"), F.coalesce("train_name", F.lit("")).alias("route_long_name"), "route_type")
    trips = good.select("message_id", "route_id", "trip_id", F.col("trip_id").alias("service_id"), F.col("headsign").alias("trip_headsign"))
    return routes, trips, bad.select("message_id", "commercial", "traffic")


def czptt_stop_times(messages: DataFrame, locations: DataFrame) -> DataFrame:
    """message_id, stop_sequence, stop_id, arrival, departure, pickup_type, drop_off_type of the public locations.

    Day offsets count from the message's least negative one; arrival and departure fill each other."""
    shift = locations.groupBy("message_id").agg(F.least(F.min(F.least("arr_offset", "dep_offset")), F.lit(0)).alias("least"))
    rows = public_locations(locations).join(shift, "message_id")
    at = lambda t, o: F.col(t) + DAY * (F.coalesce(o, F.lit(0)) - F.col("least"))
    arr, dep = at("arr_sec", "arr_offset"), at("dep_sec", "dep_offset")
    has = lambda c: F.array_contains("activities", c)
    usual = F.when(has(REQUEST_STOP), 3).otherwise(0)
    number = F.row_number().over(Window.partitionBy("message_id").orderBy("pos")) - 1
    out = rows.select("message_id", number.alias("stop_sequence"), T.platform_id(F.col("country"), F.col("code"), F.col("platform")).alias("stop_id"), F.coalesce(arr, dep).alias("arrival"), F.coalesce(dep, arr).alias("departure"), F.when(has(EXIT_ONLY), 1).otherwise(usual).alias("pickup_type"), F.when(has(BOARD_ONLY), 1).otherwise(usual).alias("drop_off_type"))
    return out.join(messages.select("message_id"), "message_id", "left_semi")


def czptt_agencies(locations: DataFrame, companies: DataFrame) -> DataFrame:
    used = public_locations(locations).select("company").distinct()
    named = with_company_names(used, companies)
    return named.select(F.concat(F.lit("-CZPTTA-"), F.col("company").cast("string")).alias("agency_id"), F.col("company_name").alias("agency_name"))


def czptt_service_days(messages: DataFrame, locations: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """message_id, day: the days of the messages' bitmaps, moved by their least negative day offset, but for cancelled ones (message_id, day)."""
    shift = locations.groupBy("message_id").agg(F.least(F.min(F.least("arr_offset", "dep_offset")), F.lit(0)).alias("offset_days"))
    days = calendars.bitmap_days(messages.select("message_id", "start", "bitmap").join(shift, "message_id"), ["message_id"])
    return days if cancelled is None else calendars.cancel_days(days, cancelled, ["message_id"])


def czptt_to_gtfs(messages: DataFrame, locations: DataFrame, companies: DataFrame, cancelled: DataFrame | None = None, coords: DataFrame | None = None) -> dict[str, DataFrame]:
    """The GTFS tables of railway messages, ready for sources.gtfs.write_gtfs.

    Trains of an unknown category and trains of which no day is left are not in the feed; trains of the
    same days share one calendar, all of added days."""
    routes, trips, _ = czptt_trips(messages, locations)
    days = cut(czptt_service_days(messages, locations, cancelled).join(shuffled(trips.select("message_id", "trip_id")), "message_id"))
    listed = days.groupBy("message_id", "trip_id").agg(F.sort_array(F.collect_set("day")).alias("days"))
    services = cut(listed.select("message_id", "trip_id", F.transform("days", lambda d: F.struct(d.alias("day"), F.lit(1).alias("exception_type"))).alias("changes"), F.sha2(F.to_json(F.struct("days")), 256).alias("plan")))
    plans = services.select("plan", "changes", F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(None).cast("array<boolean>").alias("pattern")).dropDuplicates(["plan"])
    names = calendars.calendar_names(services, plans, "trip_id")
    _, dates = timetable.calendar_tables(names, plans, [])
    live = cut(trips.drop("service_id").join(shuffled(services.select("message_id", "plan")), "message_id").join(shuffled(names), "plan").withColumnRenamed("calendar_id", "service_id"))
    times = czptt_stop_times(messages, locations).join(shuffled(live.select("message_id", "trip_id")), "message_id")
    stops = czptt_stops(locations).withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double"))
    agencies = czptt_agencies(locations, companies).withColumn("agency_url", F.lit(None).cast("string")).withColumn("agency_timezone", F.lit("Europe/Prague"))
    agencies, stops = timetable.fill_required(agencies, timetable.add_coords(stops, coords) if coords is not None else stops)
    span = messages.select("start", F.date_add("start", F.length("bitmap") - 1).alias("end"))
    info = calendars.feed_info(span).select(F.lit("timetide").alias("feed_publisher_name"), F.lit(timetable.NO_URL).alias("feed_publisher_url"), F.lit("cs").alias("feed_lang"), F.col("start_date").alias("feed_start_date"), F.col("end_date").alias("feed_end_date"))
    return {
        "agency": agencies,
        "stops": stops.withColumnRenamed("lat", "stop_lat").withColumnRenamed("lon", "stop_lon"),
        "routes": routes.withColumn("agency_id", F.concat(F.lit("-CZPTTA-"), F.col("agency_id").cast("string"))),
        "trips": live.select("route_id", "service_id", "trip_id", "trip_headsign"),
        "stop_times": times.select("trip_id", F.col("arrival").alias("arrival_time"), F.col("departure").alias("departure_time"), "stop_id", "stop_sequence", "pickup_type", "drop_off_type"),
        "calendar_dates": dates,
        "feed_info": info,
    }
