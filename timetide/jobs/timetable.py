"""Queries of the timetable conversion and of the name functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from timetide.functions import text as T
from timetide.functions.lineage import shared_dir, shuffled
from timetide.jobs.calendars import RUNS
from timetide.jobs.registry import query
from timetide.operators import rejects
from timetide.operators import timetable as O
from timetide.operators.calendars import calendar_days, czech_holidays
from timetide.operators.timetable import add_coords, drop_empty_trips, gtfs_stop_times, headsigns, left_join_on, require_all, resolve_attributes, stop_zones
from timetide.sources.gtfs import read_gtfs, write_gtfs

C = F.col


@query("p1_gtfs_ids", "SELECT DISTINCT 'JDFA-' || route_id || '-' || dist AS agency, 'JDFS-' || trip AS stop, '-CISS-' || trip || '-2' AS post, '-CISR-' || route_id || '-' || dist AS route, 'CIST-' || route_id || '-' || dist || '-' || trip AS trip_id FROM trips")
def _(s):
    return s.trips.select(T.agency_id(C("route_id"), C("dist")).alias("agency"), T.stop_gtfs_id(C("trip")).alias("stop"), T.stop_gtfs_id(C("trip"), True, F.lit(2)).alias("post"), T.route_gtfs_id(C("route_id"), C("dist")).alias("route"), T.trip_gtfs_id(C("route_id"), C("dist"), C("trip")).alias("trip_id")).distinct()


@query("p3_route_type", "SELECT p_partkey, CASE WHEN m = 'A' THEN CASE k WHEN 'A' THEN 704 WHEN 'N' THEN 201 WHEN 'V' THEN 701 WHEN 'Z' THEN 702 END ELSE CASE m WHEN 'E' THEN 900 WHEN 'L' THEN 1701 WHEN 'M' THEN 401 WHEN 'P' THEN 1000 WHEN 'T' THEN 800 END END AS t FROM (SELECT p_partkey, ['A', 'E', 'L', 'M', 'P', 'T', 'A'][CAST(p_partkey % 7 + 1 AS INT)] AS m, ['A', 'N', 'V', 'Z'][CAST(p_size % 4 + 1 AS INT)] AS k FROM part) x")
def _(s):
    pick = lambda v, i: F.element_at(F.array(*map(F.lit, v)), i.cast("int"))
    return s.part.select("p_partkey", T.route_type(pick("AELMPTA", C("p_partkey") % 7 + 1), pick("ANVZ", C("p_size") % 4 + 1)).alias("t"))


@query("p5_stop_name", "SELECT batch_id, stop_id, CASE WHEN place IS NOT NULL THEN town || ',' || coalesce(d, '') || ',' || place WHEN d IS NOT NULL THEN town || ',' || d ELSE town END AS name, town || ',' || coalesce(d, '') || ',' || coalesce(place, '') AS matching FROM (SELECT *, CASE WHEN size % 2 = 0 THEN district END AS d FROM batches) x")
def _(s):
    d = F.when(C("size") % 2 == 0, C("district"))
    return s.batches.select("batch_id", "stop_id", T.stop_name(C("town"), d, C("place")).alias("name"), T.matching_name(C("town"), d, C("place")).alias("matching"))


@query("p6_web_address", "SELECT s_suppkey, CASE WHEN u LIKE '%http://%' OR u LIKE '%https://%' THEN u ELSE 'http://' || u END AS url FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'https://' WHEN 1 THEN 'http://' ELSE '' END || 'www.' || s_suppkey || '.cz' AS u FROM supplier) x")
def _(s):
    scheme = F.when(C("s_suppkey") % 3 == 0, "https://").when(C("s_suppkey") % 3 == 1, "http://").otherwise("")
    return s.supplier.select("s_suppkey", T.web_address(F.concat(scheme, F.lit("www."), C("s_suppkey").cast("string"), F.lit(".cz"))).alias("url"))


@query("p7_resolve_attributes", "SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(['c' || (l_partkey % 6), 'c' || (l_suppkey % 6)])), ',') AS codes FROM items")
def _(s):
    rows = s.items.select((C("l_suppkey") % 5).alias("batch_id"), "l_orderkey", "l_linenumber", F.array((C("l_partkey") % 6).cast("int"), F.lit(None).cast("int"), (C("l_suppkey") % 6).cast("int")).alias("attributes"))
    refs = s.spark.range(30).select((C("id") % 5).alias("batch_id"), F.floor(C("id") / 5).cast("int").alias("attribute_id")).withColumn("code", F.concat(F.lit("c"), C("attribute_id").cast("string")))
    return resolve_attributes(rows, refs).select("l_orderkey", "l_linenumber", F.array_join("attributes", ",").alias("codes"))


@query("p8_pickup_dropoff", "SELECT l_orderkey, l_linenumber, CASE WHEN x = 'ExitOnly' THEN 1 WHEN y = 'RequestStop' THEN 3 WHEN y IN ('Conditional', 'Commission') THEN 2 ELSE 0 END AS pickup, CASE WHEN x = 'BoardingOnly' THEN 1 WHEN y = 'RequestStop' THEN 3 WHEN y IN ('Conditional', 'Commission') THEN 2 ELSE 0 END AS dropoff FROM (SELECT l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN 'ExitOnly' WHEN 1 THEN 'BoardingOnly' ELSE '-' END AS x, CASE l_suppkey % 4 WHEN 0 THEN 'RequestStop' WHEN 1 THEN 'Conditional' WHEN 2 THEN 'Commission' ELSE '-' END AS y FROM items) z")
def _(s):
    x = F.when(C("l_partkey") % 3 == 0, "ExitOnly").when(C("l_partkey") % 3 == 1, "BoardingOnly").otherwise("-")
    y = F.when(C("l_suppkey") % 4 == 0, "RequestStop").when(C("l_suppkey") % 4 == 1, "Conditional").when(C("l_suppkey") % 4 == 2, "Commission").otherwise("-")
    pickup, dropoff = T.pickup_dropoff(F.array_union(F.array(x), F.array(y)))
    return s.items.select("l_orderkey", "l_linenumber", pickup.alias("pickup"), dropoff.alias("dropoff"))


@query("p9_trip_flags", "SELECT route_id, dist, trip, CASE WHEN codes LIKE '%@%' OR codes LIKE '%{%' THEN 1 END AS wheelchair, CASE WHEN codes = 'O' THEN 1 ELSE 2 END AS bikes, CASE WHEN trip % 2 = 0 THEN '0' ELSE '1' END AS direction FROM trips")
def _(s):
    wheelchair, bikes, direction = T.trip_flags(F.split("codes", ","), C("trip"))
    return s.trips.select("route_id", "dist", "trip", wheelchair.alias("wheelchair"), bikes.alias("bikes"), direction.alias("direction"))


@query("p10_fill_required", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'http://x' ELSE 'https://example.invalid' END AS agency_url, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE CAST(s_suppkey AS DOUBLE) END AS lat FROM supplier")
def _(s):
    rows = s.supplier.select("s_suppkey", F.when(C("s_suppkey") % 2 == 0, "http://x").alias("agency_url"), F.when(C("s_suppkey") % 3 != 0, C("s_suppkey").cast("double")).alias("lat"), F.lit(0.0).alias("lon"))
    return O.fill_required(rows, rows)[0].select("s_suppkey", "agency_url").join(O.fill_required(rows, rows)[1].select("s_suppkey", "lat"), "s_suppkey")


@query("p21_unhandled_notes", "SELECT route_id, dist, trip FROM notes WHERE note_type IS NULL")
def _(s):
    return O.unhandled_notes(s.notes).select("route_id", "dist", "trip")


@query("p11_move_region", "SELECT DISTINCT p_type, CASE WHEN p_size % 2 = 0 THEN substring(p_brand, 1, 2) END AS region, p_type AS town FROM part")
def _(s):
    town = F.when(C("p_size") % 2 == 0, F.concat(C("p_type"), F.lit(" ["), F.substring("p_brand", 1, 2), F.lit("]"))).otherwise(C("p_type"))
    a, b = T.region_in_town(town)
    return s.part.select("p_type", b.alias("region"), a.alias("town")).distinct()


@query("p12_normalise_stop_name", "SELECT p_partkey, CASE WHEN k = 0 THEN p_type ELSE t END AS town, CASE WHEN k = 0 THEN nullif(d, '') WHEN k = 1 THEN p_brand ELSE 'd' END AS district, CASE WHEN k = 0 THEN p_brand WHEN k = 2 THEN p_brand END AS place FROM (SELECT *, p_partkey % 3 AS k, CASE WHEN p_size % 2 = 0 THEN 'x' ELSE '' END AS d, p_type AS t FROM part) x")
def _(s):
    k = C("p_partkey") % 3
    d = F.when(C("p_size") % 2 == 0, "x").otherwise("")
    town = F.when(k == 0, F.concat_ws(",", "p_type", d, "p_brand")).otherwise(C("p_type"))
    a, b, c = T.split_stop_name(town, F.when(k == 2, "d"), F.when(k != 0, C("p_brand")))
    return s.part.select("p_partkey", a.alias("town"), b.alias("district"), c.alias("place"))


@query("p13_non_urban_name", "SELECT p_partkey, p_type AS town, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS district FROM part")
def _(s):
    town = F.when(C("p_partkey") % 2 == 0, F.concat_ws(", ", "p_type", "p_brand")).otherwise(C("p_type"))
    a, b = T.split_non_urban(town, F.lit(None).cast("string"), F.lit(None).cast("string"))
    return s.part.select("p_partkey", a.alias("town"), b.alias("district"))


@query("p14_town_from_route_name", "SELECT p_partkey, p_type AS town FROM part")
def _(s):
    k = C("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("MHD "), C("p_type"), F.lit(" linka 5"))).when(k == 1, F.concat(C("p_type"), F.lit(" - "), C("p_brand"))).otherwise(F.concat(C("p_type"), F.lit(","), C("p_brand")))
    towns = s.part.select(C("p_type").alias("town")).distinct()
    return s.part.select("p_partkey", T.town_candidate(name).alias("town")).join(towns, "town", "left_semi").select("p_partkey", "town")


@query("p15_name_tokens", "SELECT p_partkey, array_to_string([x FOR x IN string_split(lower(replace(replace(replace(n, '.', '. '), ',', ' '), '-', ' ')), ' ') IF x <> ''], '|') AS tokens FROM (SELECT p_partkey, p_name || ',' || p_brand || '-' || p_type || '.x' AS n FROM part) x")
def _(s):
    return s.part.select("p_partkey", F.array_join(T.name_tokens(F.concat(C("p_name"), F.lit(","), C("p_brand"), F.lit("-"), C("p_type"), F.lit(".x"))), "|").alias("tokens"))


@query("p16_normalise_sr70", "SELECT l_orderkey, l_linenumber, CASE WHEN length(c) > 5 THEN substring(c, 1, 5) ELSE lpad(c, 5, '0') END AS code FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey * l_partkey AS STRING) AS c FROM items) x")
def _(s):
    return s.items.select("l_orderkey", "l_linenumber", T.normal_sr70((C("l_partkey") * C("l_partkey")).cast("string")).alias("code"))


RAIL = ["EC", "NJ", "rj", "LET", None, None, None]
TRAFFIC = ["Os", "R", "Ex", "Sv", None]


@query("p4_rail_route_type", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 102 WHEN 1 THEN 105 WHEN 2 THEN 103 WHEN 3 THEN 106 ELSE CASE p_size % 5 WHEN 0 THEN 106 WHEN 1 THEN 103 WHEN 2 THEN 102 ELSE 100 END END AS t FROM part")
def _(s):
    pick = lambda v, i: F.element_at(F.array(*map(F.lit, v)), (i + 1).cast("int"))
    return s.part.select("p_partkey", T.rail_route_type(pick(RAIL, C("p_partkey") % 7), pick(TRAFFIC, C("p_size") % 5)).alias("t"))


@query("p2_railway_ids", "SELECT DISTINCT '-SR70ST-CZ-' || code AS station, '-SR70S-CZ-' || code || CASE WHEN operator > 2 THEN '-' || operator ELSE '' END AS stop, '-CZTRAINR-2024-Os-' || code AS route, '-CZTRAINT-2024:' || code || ':' || operator AS trip FROM locations")
def _(s):
    code, op = C("code").cast("string"), C("operator").cast("string")
    return s.locations.select(T.station_id(F.lit("CZ"), code).alias("station"), T.platform_id(F.lit("CZ"), code, F.when(C("operator") > 2, op)).alias("stop"), T.train_route_id(F.lit(2024), F.concat(F.lit("Os "), code)).alias("route"), T.train_trip_id(F.lit(2024), code, op).alias("trip")).distinct()


TS = """o AS (SELECT *, CASE WHEN trip % 2 = 0 THEN -route_stop_id ELSE route_stop_id END AS o FROM trip_stops), n AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY o) - 1 AS stop_sequence FROM o),
  k AS (SELECT *, last_value(coalesce(dep_sec, arr_sec)) OVER (PARTITION BY trip ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM n WHERE coalesce(dep_kind, '') <> 'pass' AND coalesce(arr_sec, dep_sec) IS NOT NULL),
  d AS (SELECT *, CASE WHEN arr_sec < b THEN 1 ELSE 0 END AS da, CASE WHEN dep_sec < coalesce(arr_sec, b) THEN 1 ELSE 0 END AS dd FROM k), s AS (SELECT *, sum(da + dd) OVER (PARTITION BY trip ORDER BY o) AS n FROM d)"""


@query("w1_gtfs_stop_times", f"WITH {TS} SELECT trip, stop_id, stop_sequence, CAST(coalesce(arr_sec + 86400 * (n - dd), dep_sec + 86400 * n) AS BIGINT) AS arrival, CAST(coalesce(dep_sec + 86400 * n, arr_sec + 86400 * (n - dd)) AS BIGINT) AS departure FROM s")
def _(s):
    return gtfs_stop_times(s.trip_stops.withColumn("trip_no", C("trip")), ["trip"]).select("trip", "stop_id", "stop_sequence", "arrival", "departure")


@query("a7_last_stop_per_trip", "SELECT trip, arg_max(stop_id, CASE WHEN trip % 2 = 0 THEN -route_stop_id ELSE route_stop_id END) AS stop_id FROM trip_stops GROUP BY 1")
def _(s):
    return headsigns(s.trip_stops.withColumn("trip_no", C("trip")), ["trip"])


@query("a6_stop_zones", "SELECT stop_id, string_agg(DISTINCT z, ',' ORDER BY z) AS zone_id FROM (SELECT stop_id, CASE WHEN part % 4 > 0 AND stop_id % 9 > 0 THEN 'Z' || part % 4 END AS z FROM trip_stops) x GROUP BY 1")
def _(s):
    zone = F.when((C("part") % 4 > 0) & (C("stop_id") % 9 > 0), F.concat(F.lit("Z"), (C("part") % 4).cast("string")))
    return stop_zones(s.trip_stops.withColumn("zone", zone), ["stop_id"])


@query("j1_trips_routes_notes", "SELECT t.route_id, t.dist, t.trip, r.detour, count(n.trip) AS notes FROM trips t JOIN routes r USING (route_id, dist) LEFT JOIN notes n ON n.route_id = t.route_id AND n.dist = t.dist AND n.trip = t.trip GROUP BY ALL")
def _(s):
    routed = require_all(s.trips.select("route_id", "dist", "trip"), s.routes.select("route_id", "dist", "detour"), ["route_id", "dist"], "route")
    notes = s.notes.groupBy("route_id", "dist", "trip").agg(F.count("*").alias("notes"))
    return routed.join(notes, ["route_id", "dist", "trip"], "left").fillna(0, ["notes"])


@query("j2_stop_times_zones", "SELECT t.trip, t.route_stop_id, t.stop_id, z.zone FROM trip_stops t LEFT JOIN (SELECT CASE WHEN stop_id % 30 <> 4 THEN stop_id % 30 ELSE -1 END AS k, max('Z' || stop_id % 7) AS zone FROM trip_stops GROUP BY 1) z ON z.k = t.stop_id % 30")
def _(s):
    zones = s.trip_stops.select(F.when(C("stop_id") % 30 != 4, C("stop_id") % 30).otherwise(-1).alias("k"), F.concat(F.lit("Z"), (C("stop_id") % 7).cast("string")).alias("zone"))
    return left_join_on(s.trip_stops.withColumn("k", C("stop_id") % 30).select("trip", "route_stop_id", "stop_id", "k"), zones, ["k"]).drop("k")


@query("j3_stop_locations", "SELECT batch_id, stop_id, CASE WHEN stop_id % 3 = 0 THEN CAST(stop_id AS DOUBLE) END AS lat FROM batches")
def _(s):
    stops = s.batches.select("batch_id", "stop_id")
    places = stops.withColumn("precision", F.when(C("stop_id") % 3 == 0, "S").otherwise("T")).withColumn("lat", C("stop_id").cast("double")).withColumn("lon", C("lat"))
    return O.located_stops(stops, places).select("batch_id", "stop_id", "lat")


@query("j4_u1_stop_posts", "SELECT batch_id, 'JDFS-' || stop_id AS stop_id, town AS stop_name, NULL AS platform_code FROM batches UNION ALL SELECT batch_id, 'JDFS-' || stop_id || '-' || p, town, coalesce(CASE WHEN stop_id % 4 = 0 THEN 'A' END, CAST(p AS STRING)) FROM (SELECT *, CASE WHEN stop_id % 2 = 0 THEN 1 ELSE 2 END AS p FROM batches) x")
def _(s):
    stops = s.batches.select("batch_id", "stop_id", "town", F.lit(None).cast("string").alias("district"), F.lit(None).cast("string").alias("place"))
    posts = s.batches.select("batch_id", "stop_id", F.when(C("stop_id") % 2 == 0, 1).otherwise(2).alias("post_id"), F.when(C("stop_id") % 4 == 0, "A").alias("post_name"))
    none = stops.select("batch_id", "stop_id", F.lit("T").alias("precision"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    zones = stops.select("batch_id", "stop_id", F.lit(None).cast("string").alias("zone"))
    return O.gtfs_stops(stops, posts, none, zones).select("batch_id", "stop_id", "stop_name", "platform_code")


@query("j5_add_coords", "SELECT l_suppkey AS k, CASE WHEN l_suppkey % 4 = 1 THEN -1.0 WHEN l_suppkey % 2 = 0 THEN 10.0 + l_suppkey ELSE 500.0 + l_suppkey END AS lat FROM (SELECT DISTINCT l_suppkey FROM items) x")
def _(s):
    keys = s.items.select(C("l_suppkey").alias("k")).distinct()
    stops = keys.select("k", F.concat(F.lit("-SR70S-CZ-"), C("k").cast("string"), F.lit("-2")).alias("stop_id"), F.lit(-1.0).alias("lat"), F.lit(-1.0).alias("lon"))
    own = keys.select(F.concat(F.when(C("k") % 2 == 0, "-SR70S-CZ-").otherwise("-SR70S-SK-"), C("k").cast("string"), F.lit("-2")).alias("id"), (C("k") + 10.0).alias("lat"), F.lit(1.0).alias("lon"))
    station = keys.select(F.concat(F.when(C("k") % 4 != 1, "-SR70ST-CZ-").otherwise("-SR70ST-SK-"), C("k").cast("string")).alias("id"), (C("k") + 500.0).alias("lat"), F.lit(2.0).alias("lon"))
    return add_coords(stops, own.union(station)).select("k", "lat")


@query("j8_drop_empty_trips", "SELECT DISTINCT trip FROM trip_stops t WHERE EXISTS (SELECT 1 FROM trip_stops u WHERE u.trip = t.trip AND u.part % 3 = 0)")
def _(s):
    return drop_empty_trips(s.trip_stops.select("trip").distinct(), s.trip_stops.select(F.when(C("part") % 3 == 0, C("trip")).alias("trip")), ["trip"])


@query("j13_strict_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def _(s):
    return require_all(s.orders.select("o_orderkey", C("o_custkey").alias("c_custkey")), s.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"], "customer").select("o_orderkey", "c_mktsegment")


def jdf_tables(s, batches=5):
    """Timetable tables of the shapes: one batch per fifth of the routes, or another share. TRIP_STOPS says the same in SQL."""
    n, batch = batches, (C("route_id") % batches).alias("batch_id")
    trips, none = s.trips, F.lit(None).cast("string")
    calling = lambda trips: trips.select(batch, "route_id", "dist", C("trip").alias("trip_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("route_stop_id"), "part", "supp").withColumn("stop_id", ((C("supp") + C("route_stop_id")) % 60).cast("int"))
    # stops of routes come of trips that are dealt by route, so that the trips are shuffled and not their stops
    calls, along = calling(trips), calling(trips.repartition("route_id", "dist"))
    stops = calls.select("batch_id", "stop_id").distinct()
    codes = "X+1234567@{O"
    batches = s.routes.select(batch).distinct()
    return {
        "agencies": s.supplier.select((C("s_suppkey") % n).cast("int").alias("batch_id"), C("s_suppkey").cast("int").alias("agency_id"), F.lit(0).alias("agency_dist"), C("s_name").alias("name"), F.lit("www.x.cz").alias("url"), none.alias("phone")),
        "routes": s.routes.select(batch, "route_id", "dist", F.lit(1).alias("agency_id"), F.lit(0).alias("agency_dist"), F.lit("r").alias("name"), F.lit("A").alias("mode"), F.lit("V").alias("kind"), "valid_from", "valid_to"),
        "stops": stops.select("batch_id", "stop_id", F.concat(F.lit("Town "), C("stop_id").cast("string")).alias("town"), none.alias("district"), none.alias("place"), F.array().cast("array<int>").alias("attributes")),
        "stop_posts": stops.select("batch_id", "stop_id", F.lit(1).alias("post_id"), F.when(C("stop_id") % 4 == 0, "A").alias("post_name")),
        "stop_locations": stops.select("batch_id", "stop_id", F.when(C("stop_id") % 3 == 0, "S").otherwise("T").alias("precision"), (C("stop_id") / 64 + 48).alias("lat"), (C("stop_id") / 64 + 14).alias("lon")),
        "attribute_refs": batches.select("batch_id", F.posexplode(F.split(F.lit(codes), "")).alias("attribute_id", "code")).where("code <> ''"),
        "route_stops": along.select("batch_id", "route_id", "dist", "route_stop_id", "stop_id", F.when(C("route_stop_id") != 2, F.concat(F.lit("Z"), C("route_stop_id").cast("string"))).alias("zone")).distinct(),
        "trips": trips.select(batch, "route_id", "dist", C("trip").alias("trip_id"), F.transform(F.filter(F.split("codes", ","), lambda c: c != ""), lambda c: F.instr(F.lit(codes), c) - 1).alias("attributes")),
        "trip_stops": calls.select("batch_id", "route_id", "dist", "trip_id", "route_stop_id", "stop_id", F.when((C("stop_id") % 2 == 0) & (C("part") % 2 == 0), 1).alias("post_id"), F.array().cast("array<int>").alias("attributes"), F.lit("time").alias("dep_kind"), F.lit(None).cast("int").alias("arr_sec"), (3600 * ((C("part") + 7 * C("route_stop_id")) % 24)).cast("int").alias("dep_sec")),
        "service_notes": s.notes.select(batch, "route_id", "dist", C("trip").alias("trip_id"), "note_type", "date_from", "date_to"),
    }


def feed(s, *only):
    if set(only) - {"agency", "routes"}:
        # all other tables are made of these, several times over
        s.store("routes")
        s.routes = shuffled(s.routes)
        s.store("trips")
    return O.jdf_to_gtfs(jdf_tables(s), czech_holidays(s.spark, 1995, 2010), only=only)


def written_feed(s, tables):
    """The feed as a reader finds it that was written as GTFS files."""
    path = f"{shared_dir(s.spark)}/gtfs-{uuid.uuid4().hex}"
    write_gtfs(tables, path)
    return read_gtfs(s.spark, path)


RUNNING = f"WITH {RUNS}, live AS (SELECT DISTINCT route_id, dist, trip FROM runs_on)"
TRIP_STOPS = "ts AS (SELECT t.*, route_id % 5 AS batch_id, k, (supp + k) % 60 AS stop, CASE WHEN t.trip % 2 = 0 THEN -k ELSE k END AS o, 3600 * ((part + 7 * k) % 24) AS d, CASE WHEN (supp + k) % 60 % 2 = 0 AND part % 2 = 0 THEN '-1' ELSE '' END AS post FROM trips t, (SELECT unnest([1, 2, 3, 4]) AS k) z)"
STOP_TIMES = f"{RUNNING}, {TRIP_STOPS}, l AS (SELECT ts.*, CASE WHEN d < lag(d) OVER (PARTITION BY route_id, dist, trip ORDER BY o) THEN 1 ELSE 0 END AS down FROM ts JOIN live USING (route_id, dist, trip)) SELECT 'CIST-' || route_id || '-' || dist || '-' || trip AS trip_id, 'JDFS-' || stop || post AS stop_id, row_number() OVER (PARTITION BY route_id, dist, trip ORDER BY o) - 1 AS stop_sequence, CAST(d + 86400 * sum(down) OVER (PARTITION BY route_id, dist, trip ORDER BY o) AS BIGINT) AS departure, CASE WHEN k <> 2 THEN 'Z' || k END AS zone FROM l"


@query("g1_jdf_trips", f"{RUNNING} SELECT 'CIST-' || t.route_id || '-' || t.dist || '-' || t.trip AS trip_id, CASE WHEN t.trip % 2 = 0 THEN 'Town ' || (supp + 1) % 60 ELSE 'Town ' || (supp + 4) % 60 END AS trip_headsign, CASE WHEN t.trip % 2 = 0 THEN '0' ELSE '1' END AS direction_id, t.route_id || ' ' || t.trip AS trip_short_name FROM trips t JOIN live USING (route_id, dist, trip)")
def _(s):
    return feed(s, "trips")["trips"].select("trip_id", "trip_headsign", "direction_id", "trip_short_name")


@query("g1_jdf_stop_times", STOP_TIMES)
def _(s):
    return feed(s, "stop_times")["stop_times"].select("trip_id", "stop_id", "stop_sequence", C("departure_time").alias("departure"), C("stop_zone_ids").alias("zone"))


@query("snk2_src4_written_stop_times", STOP_TIMES.replace("SELECT 'CIST-'", "SELECT batch_id, 'CIST-'"))
def _(s):
    back = written_feed(s, feed(s, *(k for k in O.FEED if k != "calendar")))
    return back["stop_times"].select("batch_id", "trip_id", "stop_id", "stop_sequence", C("departure_time").alias("departure"), C("stop_zone_ids").alias("zone"))


@query("g1_feed_service_days", f"WITH {RUNS} SELECT route_id % 5 || ':CIST-' || route_id || '-' || dist || '-' || trip AS trip_id, day FROM runs_on")
def _(s):
    """The days of each trip as a reader of the one feed of all batches finds them."""
    back = written_feed(s, O.one_feed(feed(s, *O.FEED)))
    pattern = F.array(*[C(d) for d in O.WEEK]).alias("pattern")
    weekly = calendar_days(back["calendar"].select("service_id", C("start_date").alias("valid_from"), C("end_date").alias("valid_to"), pattern), ["service_id"])
    dates = back["calendar_dates"].withColumnRenamed("date", "day")
    days = weekly.join(shuffled(dates.where("exception_type = 2")), ["service_id", "day"], "left_anti").union(dates.where("exception_type = 1").select("service_id", "day"))
    return back["trips"].join(shuffled(days), "service_id").select("trip_id", "day")


@query("g1_jdf_stops", f"WITH {TRIP_STOPS}, st AS (SELECT batch_id, stop, string_agg(DISTINCT CASE WHEN k <> 2 THEN 'Z' || k END, ',' ORDER BY CASE WHEN k <> 2 THEN 'Z' || k END) AS zone, CASE WHEN stop % 3 = 0 THEN CAST(stop AS DOUBLE) / 64 + 48 ELSE 0.0 END AS lat FROM ts GROUP BY 1, 2) SELECT batch_id, 'JDFS-' || stop AS stop_id, 'Town ' || stop AS stop_name, lat, zone, NULL AS platform_code FROM st UNION ALL SELECT batch_id, 'JDFS-' || stop || '-1', 'Town ' || stop, lat, zone, CASE WHEN stop % 4 = 0 THEN 'A' ELSE '1' END FROM st")
def _(s):
    return feed(s, "stops")["stops"].select("batch_id", "stop_id", "stop_name", C("stop_lat").alias("lat"), C("zone_id").alias("zone"), "platform_code")


@query("g1_jdf_routes", "SELECT '-CISR-' || route_id || '-' || dist AS route_id, 701 AS route_type, 'JDFA-1-0' AS agency_id FROM routes")
def _(s):
    return feed(s, "routes")["routes"].select("route_id", "route_type", "agency_id")


@query("g1_jdf_agencies", "SELECT 'JDFA-' || s_suppkey || '-0' AS agency_id, 'http://www.x.cz' AS agency_url, s_name AS agency_name FROM supplier")
def _(s):
    return feed(s, "agency")["agency"].select("agency_id", "agency_url", "agency_name")


def broken_tables(s):
    """Forty batches, of which 1 to 8 are broken, each in its own way."""
    t = jdf_tables(s, 40)
    is_batch = lambda k: C("batch_id") == k
    t["routes"] = t["routes"].where(~(is_batch(1) & (C("dist") == 1))).withColumn("agency_dist", F.when(is_batch(8), 7).otherwise(0))
    t["stops"] = t["stops"].where(~(is_batch(2) & (C("stop_id") > 9))).withColumn("attributes", F.when(is_batch(3), F.array(F.lit(0), F.lit(99))).otherwise(C("attributes")))
    t["trips"] = t["trips"].withColumn("attributes", F.when(is_batch(4), F.array_append("attributes", 77)).otherwise(C("attributes"))).withColumn("group_id", F.lit(None).cast("int"))
    t["stop_posts"] = t["stop_posts"].withColumn("stop_id", F.when(is_batch(5), C("stop_id") + 1000).otherwise(C("stop_id")))
    t["route_stops"] = t["route_stops"].where(~(is_batch(6) & (C("route_stop_id") == 3)))
    t["trip_stops"] = t["trip_stops"].withColumn("arr_kind", F.when(is_batch(7) & (C("route_stop_id") == 2), "pass"))
    t["agencies"] = t["routes"].select("batch_id", "agency_id").distinct().withColumns({"agency_dist": F.lit(0), "name": F.lit("a"), "url": F.lit(None).cast("string"), "phone": F.lit(None).cast("string")})
    return t


BROKEN = """WITH tr AS (SELECT *, route_id % 40 AS batch_id, 0 AS z FROM trips), ts AS (SELECT tr.*, k, (supp + k) % 60 AS stop FROM tr, (SELECT unnest([1, 2, 3, 4]) AS k) x),
  st AS (SELECT DISTINCT batch_id, stop FROM ts)"""
SHARED = """SELECT batch_id, 'trips' AS step, 'route not found' AS reason, count(*) AS n FROM tr WHERE batch_id = 1 AND dist = 1 GROUP BY 1
  UNION ALL SELECT batch_id, 'trip_stops', 'stop not found', count(*) FROM ts WHERE batch_id = 2 AND stop > 9 GROUP BY 1
  UNION ALL SELECT batch_id, 'stop_posts', 'stop not found', count(*) FROM st WHERE batch_id = 5 OR (batch_id = 2 AND stop > 9) GROUP BY 1
  UNION ALL SELECT batch_id, 'stops', 'attribute not found', count(*) FROM st WHERE batch_id = 3 GROUP BY 1
  UNION ALL SELECT batch_id, 'trips', 'attribute not found', count(*) FROM tr WHERE batch_id = 4 GROUP BY 1"""


@query("g1_rejects", f"""{BROKEN} {SHARED} UNION ALL SELECT batch_id, 'trip_stops', 'route stop not found', count(*) FROM ts WHERE batch_id = 6 AND k = 3 GROUP BY 1
  UNION ALL SELECT batch_id, 'trip_stops', 'arrival passed, departure not', count(*) FROM ts WHERE batch_id = 7 AND k = 2 GROUP BY 1""")
def _(s):
    return rejects.conversion_rejects(broken_tables(s)).drop("item")


@query("w1_rejects", "SELECT 7 AS batch_id, route_id, dist, trip AS trip_id FROM trips WHERE route_id % 40 = 7")
def _(s):
    """Trips whose arrivals contradict their departures, batch by batch; w1 and g1 have them in no feed."""
    t = broken_tables(s)["trip_stops"]
    bad = t.join(rejects.contradictory_times(t).select("batch_id"), "batch_id", "left_semi").where("arr_kind = 'pass'")
    return bad.select("batch_id", "route_id", "dist", "trip_id").distinct()


@query("g1_accepted_stop_times", STOP_TIMES + " WHERE route_id % 40 NOT BETWEEN 1 AND 7")
def _(s):
    """The feeds of all batches but the broken ones."""
    accepted, _ = rejects.convert(broken_tables(s), czech_holidays(s.spark, 1995, 2010), only=("stop_times",))
    return accepted["stop_times"].select("trip_id", "stop_id", "stop_sequence", C("departure_time").alias("departure"), C("stop_zone_ids").alias("zone"))


@query("m_rejects", f"{BROKEN} {SHARED} UNION ALL SELECT CAST(route_id % 40 AS INT), 'routes', 'agency not found', count(*) FROM routes WHERE route_id % 40 = 8 GROUP BY 1 UNION ALL SELECT batch_id, 'route_stops', 'stop not found', count(*) FROM (SELECT DISTINCT batch_id, route_id, dist, k, stop, CASE WHEN k <> 2 THEN k END AS zone FROM ts WHERE batch_id = 2 AND stop > 9) x GROUP BY 1")
def _(s):
    return rejects.merging_rejects(broken_tables(s)).drop("item")
