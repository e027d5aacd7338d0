"""Bus and urban timetables to GTFS tables.

Tables carry batch_id, so that all batches are converted in one job. Dimensions (routes, stops, route
stops) join by equality and are left to the optimiser to broadcast; the facts (trip stops) are shuffled
once by trip and all windows and the headsign use that one partitioning.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timetide.functions import text as T
from timetide.functions.lineage import shuffled
from timetide.operators import calendars

TRIP = ["batch_id", "route_id", "dist", "trip_id"]
#: Where a feed must name a page and none is known.
NO_URL = "https://example.invalid"
WEEK = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def require_all(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Inner join in which a left key without a right row is an error, raised by the row itself; of several right rows the greatest is taken."""
    rest = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r"), F.lit(True).alias("_found"))
    missing = F.raise_error(F.concat(F.lit(f"{what} not found: "), F.to_json(F.struct(*keys))))
    found = left.join(one, keys, "left").where(F.when(F.col("_found"), True).otherwise(missing.cast("boolean")))
    return found.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in rest])


def left_join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that takes the greatest right row per key."""
    rest = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r"))
    return left.join(one, keys, "left").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in rest])


def resolve_attributes(rows: DataFrame, refs: DataFrame, column: str = "attributes") -> DataFrame:
    """The column's attribute ids as a sorted set of codes; an id that the batch does not define is an error."""
    maps = refs.groupBy("batch_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute_id", "code"))).alias("_codes"))
    joined = rows.join(F.broadcast(maps), "batch_id", "left")  # a row per batch
    ids = F.filter(F.coalesce(column, F.array().cast("array<int>")), lambda i: i.isNotNull())
    code = F.transform(ids, lambda i: F.coalesce(F.col("_codes")[i], F.raise_error(F.concat(F.lit("unknown attribute "), i.cast("string")))))
    return joined.withColumn(column, F.array_sort(F.array_distinct(code))).drop("_codes")


def gtfs_stop_times(trip_stops: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stop_id, stop_sequence, arrival, departure (seconds, past midnight on later days) and what else the rows hold.

    Order is route_stop_id, backwards on even trips (column `trip_no`). Stops passed or not served
    (dep_kind 'pass' or 'notpass'), and stops without any time, are left out but counted in the sequence.
    Over arrival, departure, arrival, … of what is left, each time smaller than the one before adds a day."""
    order = F.when(F.col("trip_no") % 2 == 0, -F.col("route_stop_id")).otherwise(F.col("route_stop_id"))
    rows = trip_stops.withColumn("_o", order)
    by = Window.partitionBy(*keys).orderBy("_o")
    rows = rows.withColumn("stop_sequence", F.row_number().over(by) - 1)
    served = ~F.coalesce(F.col("dep_kind").isin("pass", "notpass"), F.lit(False)) & F.coalesce("arr_sec", "dep_sec").isNotNull()
    rows = rows.where(served)
    before = F.last(F.coalesce("dep_sec", "arr_sec"), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    down = lambda now, then: F.when(now < then, 1).otherwise(0)
    rows = rows.withColumn("_b", before).withColumn("_da", down(F.col("arr_sec"), F.col("_b"))).withColumn("_dd", down(F.col("dep_sec"), F.coalesce("arr_sec", "_b")))
    days = F.sum(F.col("_da") + F.col("_dd")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_n", days)
    arrival = F.col("arr_sec") + 86_400 * (F.col("_n") - F.col("_dd"))
    departure = F.col("dep_sec") + 86_400 * F.col("_n")
    rows = rows.withColumn("arrival", F.coalesce(arrival, departure)).withColumn("departure", F.coalesce(departure, arrival))
    return rows.drop("_o", "_b", "_da", "_dd", "_n")


def headsigns(trip_stops: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stop_id of the last stop in the direction of travel."""
    way = F.when(F.col("trip_no") % 2 == 0, -F.col("route_stop_id")).otherwise(F.col("route_stop_id"))
    return trip_stops.groupBy(*keys).agg(F.max_by("stop_id", way).alias("stop_id"))


def stop_zones(route_stops: DataFrame, keys: list[str]) -> DataFrame:
    """keys, zone_id: a stop's distinct zones, sorted and joined by commas; null without any."""
    zones = F.array_join(F.array_sort(F.collect_set("zone")), ",")
    return route_stops.groupBy(*keys).agg(F.nullif(zones, F.lit("")).alias("zone_id"))


def route_zones(route_stops: DataFrame) -> DataFrame:
    """batch_id, route_id, dist, zones: the zone of each route stop by its id, of several the greatest; brought together once, by route."""
    known = route_stops.where("route_stop_id is not null").groupBy(*TRIP[:3]).agg(F.sort_array(F.collect_set(F.struct("route_stop_id", "zone"))).alias("all"))
    last = F.filter("all", lambda x, i: ~F.coalesce(F.get("all", i + 1)["route_stop_id"] == x["route_stop_id"], F.lit(False)))
    return known.select(*TRIP[:3], F.map_from_entries(last).alias("zones"))


def add_coords(stops: DataFrame, coords: DataFrame) -> DataFrame:
    """stops (stop_id, lat, lon) with coordinates by own id, for platforms of a station else by the station's; others keep theirs."""
    own = coords.groupBy("id").agg(F.max(F.struct("lat", "lon")).alias("p"))
    station = F.regexp_replace(F.regexp_extract("stop_id", r"^-SR70S-CZ-[0-9]+", 0), "^-SR70S-", "-SR70ST-")
    out = stops.withColumn("_station", station)
    out = out.join(own.select(F.col("id").alias("stop_id"), F.col("p").alias("_a")), "stop_id", "left").join(own.select(F.col("id").alias("_station"), F.col("p").alias("_b")), "_station", "left")
    pair = F.coalesce("_a", "_b", F.struct("lat", "lon"))
    return out.withColumn("_p", pair).withColumn("lat", F.col("_p.lat")).withColumn("lon", F.col("_p.lon")).drop("_a", "_b", "_p", "_station")


def fill_required(agencies: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    return agencies.withColumn("agency_url", F.coalesce("agency_url", F.lit(NO_URL))), stops.fillna(0.0, ["lat", "lon"])


def drop_empty_trips(rows: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of trips that run on some day."""
    return rows.join(days.select(*keys).distinct(), keys, "left_semi")


def unhandled_notes(notes: DataFrame) -> DataFrame:
    return notes.where("note_type is null")


def gtfs_agencies(agencies: DataFrame) -> DataFrame:
    return agencies.select("batch_id", T.agency_id(F.col("agency_id"), F.col("agency_dist")).alias("agency_id"), F.col("name").alias("agency_name"), T.web_address(F.col("url")).alias("agency_url"), F.lit("Europe/Prague").alias("agency_timezone"), F.lit("cs").alias("agency_lang"), F.col("phone").alias("agency_phone"))


def located_stops(stops: DataFrame, locations: DataFrame) -> DataFrame:
    """stops with lat, lon of their location given for the stop itself (precision S)."""
    exact = locations.where("precision = 'S'").select("batch_id", "stop_id", "lat", "lon")
    return left_join_on(stops, exact, ["batch_id", "stop_id"])


def gtfs_stops(stops: DataFrame, posts: DataFrame, locations: DataFrame, route_stops: DataFrame, cis: bool = False) -> DataFrame:
    """Stops and, below them, their posts; a post whose stop is missing is an error."""
    zones = stop_zones(route_stops, ["batch_id", "stop_id"])
    base = located_stops(stops, locations).join(zones, ["batch_id", "stop_id"], "left")
    name = T.stop_name(F.col("town"), F.col("district"), F.col("place"))
    shared = base.select("batch_id", F.col("stop_id").alias("_stop"), name.alias("stop_name"), "lat", "lon", "zone_id")
    own = shared.withColumn("stop_id", T.stop_gtfs_id(F.col("_stop"), cis)).withColumn("platform_code", F.lit(None).cast("string"))
    below = require_all(posts.select("batch_id", F.col("stop_id").alias("_stop"), "post_id", "post_name"), shared, ["batch_id", "_stop"], "stop")
    below = below.withColumn("stop_id", T.stop_gtfs_id(F.col("_stop"), cis, F.col("post_id"))).withColumn("platform_code", F.coalesce("post_name", F.col("post_id").cast("string")))
    return own.drop("_stop").unionByName(below.drop("_stop", "post_id", "post_name"))


def gtfs_routes(routes: DataFrame) -> DataFrame:
    return routes.select("batch_id", T.route_gtfs_id(F.col("route_id"), F.col("dist")).alias("route_id"), T.agency_id(F.col("agency_id"), F.col("agency_dist")).alias("agency_id"), F.col("route_id").cast("string").alias("route_short_name"), F.col("name").alias("route_long_name"), T.route_type(F.col("mode"), F.col("kind")).alias("route_type"))


def calendar_tables(names: DataFrame, plans: DataFrame, within: list[str]) -> tuple[DataFrame, DataFrame]:
    """GTFS calendar and calendar_dates of named plans (calendars.service_calendar, calendars.calendar_names)."""
    known = names.join(shuffled(plans), "plan").withColumnRenamed("calendar_id", "service_id")
    days = [F.element_at("pattern", i + 1).alias(d) for i, d in enumerate(WEEK)]
    calendar = known.where("pattern is not null").select(*within, "service_id", *days, F.col("valid_from").alias("start_date"), F.col("valid_to").alias("end_date"))
    dates = known.select(*within, "service_id", F.explode("changes").alias("c")).select(*within, "service_id", F.col("c.day").alias("date"), "c.exception_type")
    return calendar, dates


#: Tables of a feed.
FEED = ("agency", "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates")


def jdf_to_gtfs(t: dict[str, DataFrame], holidays: DataFrame, cis: bool = False, coords: DataFrame | None = None, only: Collection[str] = FEED) -> dict[str, DataFrame]:
    """GTFS tables of all batches, ready for sources.gtfs.write_gtfs: a feed per batch_id.

    Tables and columns as sources.jdf gives them. Trips that never run are left out; services with the
    same days share one calendar; stops take coordinates by id from coords (id, lat, lon) where given.
    one_feed() makes a single feed of all batches. `only` names the tables that are wanted: calendars are worked
    out where trips or calendars are, and only which trips run at all where stop times are."""
    made = {}
    if {"agency", "stops"} & set(only):
        placed = gtfs_stops(t["stops"], t["stop_posts"], t["stop_locations"], t["route_stops"], cis)
        agencies, placed = fill_required(gtfs_agencies(t["agencies"]), add_coords(placed, coords) if coords is not None else placed)
        made |= {"agency": agencies, "stops": placed.withColumnRenamed("lat", "stop_lat").withColumnRenamed("lon", "stop_lon")}
    if "routes" in only:
        made["routes"] = gtfs_routes(t["routes"])
    if set(only) - set(made) - {"routes"}:
        made |= _running_feed(t, holidays, cis, only)
    return {k: made[k] for k in FEED if k in only}


def _running_feed(t: dict[str, DataFrame], holidays: DataFrame, cis: bool, only: Collection[str]) -> dict[str, DataFrame]:
    """The tables of jdf_to_gtfs that depend on which trips run."""
    stops = resolve_attributes(t["stops"], t["attribute_refs"])
    trips = resolve_attributes(t["trips"], t["attribute_refs"])
    times = resolve_attributes(t["trip_stops"], t["attribute_refs"])
    routes = shuffled(t["routes"].select("batch_id", "route_id", "dist", "valid_from", "valid_to"))
    valid = require_all(trips, routes, ["batch_id", "route_id", "dist"], "route").withColumn("codes", F.col("attributes"))
    trip = T.trip_gtfs_id(F.col("route_id"), F.col("dist"), F.col("trip_id"))
    wheelchair, bikes, direction = T.trip_flags(F.col("attributes"), F.col("trip_id"))
    made = {}
    if {"trips", "calendar", "calendar_dates"} & set(only):
        flagged = valid.withColumns({"wheelchair_accessible": wheelchair, "bikes_allowed": bikes})
        running, plans = calendars.service_calendar(flagged, t["service_notes"], holidays, TRIP, ["wheelchair_accessible", "bikes_allowed"])
        names = calendars.calendar_names(running.withColumn("_service", trip), plans, "_service", ["batch_id"])
        made["calendar"], made["calendar_dates"] = calendar_tables(names, plans, ["batch_id"])
    else:
        running = calendars.running_trips(valid, t["service_notes"], holidays, TRIP)

    of_stop = stops.select("batch_id", "stop_id", F.col("attributes").alias("stop_attributes"))
    full = require_all(times, of_stop, ["batch_id", "stop_id"], "stop").withColumn("trip_no", F.col("trip_id"))
    # zones come with the trip, so that its stops are shuffled once, by trip
    zoned = running.select(*TRIP).join(shuffled(route_zones(t["route_stops"])), TRIP[:3], "left").dropDuplicates(TRIP)
    full = full.join(shuffled(zoned), TRIP).withColumn("zone", F.try_element_at("zones", "route_stop_id")).drop("zones")
    timed = gtfs_stop_times(full, TRIP)
    pickup, dropoff = T.pickup_dropoff(F.array_union("attributes", "stop_attributes"))
    stop = F.when(F.col("post_id").isNull(), T.stop_gtfs_id(F.col("stop_id"), cis)).otherwise(T.stop_gtfs_id(F.col("stop_id"), cis, F.col("post_id")))
    stop_times = timed.select("batch_id", trip.alias("trip_id"), F.col("arrival").alias("arrival_time"), F.col("departure").alias("departure_time"), stop.alias("stop_id"), "stop_sequence", pickup.alias("pickup_type"), dropoff.alias("drop_off_type"), F.col("zone").alias("stop_zone_ids"))
    made["stop_times"] = stop_times
    if "trips" not in only:
        return made

    # a trip's last stop is found before any join, so of its stops one row is shuffled; that all stops are known is seen on the distinct ones
    last = headsigns(times.withColumn("trip_no", F.col("trip_id")), TRIP)
    called = require_all(times.select("batch_id", "stop_id").distinct(), stops.select("batch_id", "stop_id", T.stop_name(F.col("town"), F.col("district"), F.col("place")).alias("trip_headsign")), ["batch_id", "stop_id"], "stop")
    heads = last.join(called, ["batch_id", "stop_id"]).drop("stop_id")
    live = running.join(shuffled(heads), TRIP, "left").join(shuffled(names), ["batch_id", "plan"])
    made["trips"] = live.select("batch_id", T.route_gtfs_id(F.col("route_id"), F.col("dist")).alias("route_id"), F.col("calendar_id").alias("service_id"), trip.alias("trip_id"), "trip_headsign", F.concat_ws(" ", F.col("route_id").cast("string"), F.col("trip_id").cast("string")).alias("trip_short_name"), direction.alias("direction_id"), "wheelchair_accessible", "bikes_allowed")
    return made


def one_feed(feed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The feeds of all batches as one: ids are told apart by their batch ('<batch>:<id>'), and the column goes."""
    out = {}
    for table, df in feed.items():
        ids = [c for c in ("agency_id", "stop_id", "parent_station", "route_id", "trip_id", "service_id") if c in df.columns]
        out[table] = df.withColumns({c: F.concat(F.col("batch_id").cast("string"), F.lit(":"), F.col(c)) for c in ids}).drop("batch_id")
    return out
