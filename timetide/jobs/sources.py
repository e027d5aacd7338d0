"""Queries of readers and writers: over files and texts that Spark makes of the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from timetide.functions.lineage import shared_dir
from timetide.jobs.registry import query
from timetide.sources import czptt, jdf, realtime

C = F.col


def folder(s, label):
    return f"{shared_dir(s.spark)}/{label}-{uuid.uuid4().hex}"


def text(c):
    return C(c).cast("string") if isinstance(c, str) else c.cast("string")


def batch_files(s):
    """(what was written, path): timetable files of the batches' stops."""
    none, stops = F.lit(None).cast("string"), s.batches.withColumn("batch_id", text("batch_id"))
    version = stops.groupBy("batch_id").agg(F.lit("1.11").alias("version"), none.alias("du_num"), none.alias("region"), none.alias("batch"), F.to_date(F.lit("2024-01-05")).alias("created"), F.lit("x").alias("name"))
    rows = stops.select("batch_id", "stop_id", "town", "district", "place", none.alias("region"), "country", F.when(C("size") % 2 == 0, F.array((C("size") % 9).cast("int"), (C("size") % 5).cast("int"))).otherwise(F.array().cast("array<int>")).alias("attributes"))
    path = folder(s, "batches")
    return jdf.write_jdf({"version": version, "stops": rows}, path), path


@query("snk1_write_jdf", "SELECT CAST(batch_id AS STRING) AS batch_id, 'zastavky' AS file, count(*) AS rows FROM batches GROUP BY 1 UNION ALL SELECT DISTINCT CAST(batch_id AS STRING), 'verzejdf', 1 FROM batches")
def _(s):
    return batch_files(s)[0]


@query("src1_read_raw", "SELECT CAST(batch_id AS STRING) AS batch_id, stop_id, town, 12 AS cells FROM batches")
def _(s):
    written, path = batch_files(s)
    written.write.format("noop").mode("overwrite").save()
    raw = jdf.read_raw(s.spark, path).where("file = 'zastavky'")
    return raw.select(F.substring_index("batch_id", "/", -1).alias("batch_id"), F.get("cols", F.lit(0)).cast("int").alias("stop_id"), F.get("cols", F.lit(1)).alias("town"), F.size("cols").alias("cells"))


@query("src2_read_jdf", "SELECT CAST(batch_id AS STRING) AS batch_id, stop_id, town, district, place, country, CASE WHEN size % 2 = 0 THEN (size % 9) || ',' || (size % 5) ELSE '' END AS attributes FROM batches")
def _(s):
    written, path = batch_files(s)
    written.write.format("noop").mode("overwrite").save()
    stops = jdf.read_jdf(s.spark, path)["stops"]
    return stops.select(F.substring_index("batch_id", "/", -1).alias("batch_id"), "stop_id", "town", "district", "place", "country", F.array_join(C("attributes").cast("array<string>"), ",").alias("attributes"))


def old_routes(s):
    """Records of routes in the oldest layout, which has neither mode nor distinctions."""
    cells = [text("route_id"), F.lit("Line"), F.lit("11"), F.lit("A"), *[F.lit("")] * 4, F.date_format("valid_from", "ddMMyyyy"), F.when(C("dist") % 3 > 0, F.date_format("valid_to", "ddMMyyyy")).otherwise("")]
    return s.routes.select(F.concat_ws("-", text("route_id"), text("dist")).alias("batch_id"), F.lit("linky").alias("file"), F.lit(0).alias("row_no"), F.array(*cells).alias("cols"))


@query("src2_cast_table", "SELECT route_id || '-' || dist AS batch_id, CAST(route_id AS STRING) AS route_id, valid_from, CASE WHEN dist % 3 > 0 THEN valid_to END AS valid_to FROM routes")
def _(s):
    return jdf.cast_table(old_routes(s), "routes", "1.8").select("batch_id", "route_id", "valid_from", "valid_to")


def odd_routes(s):
    """Records of routes, a batch each, with a version; some have a version that is none, a flag, a date or a number of another form."""
    k, version = C("o_orderkey"), F.when(C("o_orderkey") % 53 == 7, "2.0").otherwise("1.11")
    batch = F.concat_ws("-", text("route_id"), text("dist"))
    cells = [text("route_id"), F.lit("Line"), F.lit("11"), F.lit("A"), F.lit("A"), F.when(k % 31 == 3, "yes").otherwise("0"), *[F.lit("0")] * 3, *[F.lit("")] * 4, F.when(k % 37 == 3, "31022024").otherwise(F.date_format("valid_from", "ddMMyyyy")), F.date_format("valid_to", "ddMMyyyy"), F.lit("1"), F.when(k % 41 == 3, "x").otherwise(text("dist"))]
    lines = s.routes.select(batch.alias("batch_id"), F.lit("linky").alias("file"), F.lit(0).alias("row_no"), F.array(*cells).alias("cols"))
    return lines.union(s.routes.select(batch, F.lit("verzejdf"), F.lit(0), F.array(version)))


@query("src2_rejects", """SELECT route_id || '-' || dist AS batch_id, CASE WHEN o_orderkey % 53 = 7 THEN 'read' ELSE 'cast' END AS step,
  CASE WHEN o_orderkey % 53 = 7 THEN 'unknown version' WHEN o_orderkey % 31 = 3 THEN 'detour of routes' WHEN o_orderkey % 37 = 3 THEN 'valid_from of routes' ELSE 'dist of routes' END AS reason
  FROM routes WHERE o_orderkey % 53 = 7 OR o_orderkey % 31 = 3 OR o_orderkey % 37 = 3 OR o_orderkey % 41 = 3""")
def _(s):
    return jdf.raw_rejects(odd_routes(s))[1].select("batch_id", "step", "reason")


@query("src3_upgrade", "SELECT route_id || '-' || dist AS batch_id, CAST(route_id AS STRING) AS route_id, 'A' AS mode, FALSE AS detour, 0 AS dist, CASE WHEN dist % 3 > 0 THEN valid_to ELSE DATE '3000-01-01' END AS valid_to FROM routes")
def _(s):
    return jdf.upgrade(jdf.cast_table(old_routes(s), "routes", "1.8"), "routes", "1.8").select("batch_id", "route_id", "mode", "detour", "dist", "valid_to")


def clock(c):
    return F.format_string("%02d:%02d:00", F.floor(c / 3600).cast("int"), (F.floor(c / 60) % 60).cast("int"))


def tag(name, value):
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def messages(s):
    """message_id, kind, xml: a timetable message of each train."""
    timing = lambda q, c: F.concat(F.lit(f'<Timing TimingQualifierCode="{q}">'), tag("Time", clock(c)), tag("Offset", F.lit("0")), F.lit("</Timing>"))

    def location(r):
        place = tag("Location", F.concat(tag("CountryCodeISO", F.lit("CZ")), tag("LocationPrimaryCode", text(r["code"])), tag("PrimaryLocationName", F.concat(F.lit("Stop "), text(r["code"])))))
        times = tag("TimingAtLocation", F.concat(timing("ALA", r["qty"] * 600), timing("ALD", r["qty"] * 600 + 60)))
        rest = F.concat(tag("ResponsibleRU", text(r["operator"])), tag("TrainType", F.lit("1")), tag("TrafficType", F.lit("Os")), tag("TrainActivity", tag("TrainActivityType", F.when(r["public"], "0001").otherwise("0002"))))
        return tag("CZPTTLocation", F.concat(place, times, rest))

    # the rows are shuffled, not their XML
    located = s.locations.groupBy("train").agg(F.sort_array(F.collect_list(F.struct("pos", "code", "qty", "operator", "public"))).alias("rows"))
    body = F.array_join(F.transform("rows", location), "")
    ids = tag("Identifiers", tag("PlannedTransportIdentifiers", F.concat(tag("ObjectType", F.lit("PA")), tag("Core", text("train")), tag("Variant", F.lit("01")), tag("TimetableYear", F.lit("2024")))))
    days = tag("PlannedCalendar", F.concat(tag("BitmapDays", F.lpad(F.bin("bits"), 20, "0")), tag("ValidityPeriod", tag("StartDateTime", F.concat(F.date_format("start", "yyyy-MM-dd"), F.lit("T00:00:00"))))))
    whole = located.join(s.bitmaps.select(C("id").alias("train"), "bits", "start"), "train")
    return whole.select(text("train").alias("message_id"), F.lit("timetable").alias("kind"), tag("CZPTTCISMessage", F.concat(ids, tag("CZPTTInformation", F.concat(body, days)))).alias("xml"))


@query("src5_czptt_messages", "SELECT DISTINCT CAST(id AS STRING) AS core, start, lpad(bin(bits), 20, '0') AS bitmap FROM bitmaps JOIN locations ON train = id")
def _(s):
    return czptt.parse_messages(messages(s))[0].select("core", "start", "bitmap")


@query("src5_czptt_locations", "SELECT CAST(train AS STRING) AS message_id, row_number() OVER (PARTITION BY train ORDER BY pos) - 1 AS pos, CAST(code AS STRING) AS code, CAST(operator AS STRING) AS company, qty * 600 AS arr_sec, qty * 600 + 60 AS dep_sec, CASE WHEN public THEN '0001' ELSE '0002' END AS activity FROM locations JOIN bitmaps ON id = train")
def _(s):
    return czptt.parse_messages(messages(s))[1].select("message_id", "pos", "code", "company", "arr_sec", "dep_sec", F.array_join("activities", ",").alias("activity"))


#: What vehicles said in two polls a day, before noon and from six on, and why a trip cannot be read.
POSITIONS = """e AS (SELECT *, CAST(ts AS DATE) AS day, date_trunc('second', ts) AS clock FROM events, (VALUES (0), (1)) v(r) WHERE (r = 0 AND hour(ts) < 12) OR (r = 1 AND hour(ts) >= 6)),
  t AS (SELECT user_id, day, r, min(event_id) AS e0, bool_or(event_id % 499 = 0) AS b1, bool_or(event_id % 5 > 0 AND event_id % 211 = 0) AS b2 FROM e GROUP BY 1, 2, 3),
  m AS (SELECT *, min(e0) OVER (PARTITION BY day, r, user_id % 5) * 2 + r AS msg, row_number() OVER (PARTITION BY day, r, user_id % 5 ORDER BY user_id) - 1 AS place,
    CASE WHEN user_id % 7 = 1 AND day(day) % 10 = 3 THEN 'no ids' WHEN user_id % 7 = 2 AND day(day) % 10 = 4 THEN 'start time' WHEN b1 THEN 'position without time or place' WHEN b2 THEN 'last stop without id or times' END AS reason FROM t),
  pos AS (SELECT e.*, msg * 1048576 + place AS seq, '-PIDT-' || e.user_id AS trip_id FROM e JOIN m ON m.user_id = e.user_id AND m.day = e.day AND m.r = e.r WHERE e.user_id % 7 > 0 AND reason IS NULL)"""
STOP_ROWS = """s AS (SELECT seq, trip_id, day AS trip_start_date, CAST(event_id % 8 AS INT) AS trip_stop_index, '-PIDS-U' || event_id % 60 AS stop_id,
    CAST(clock + INTERVAL 1 HOUR + to_seconds(60 + coalesce(CASE WHEN event_id % 2 > 0 THEN event_id % 90 END, CASE WHEN event_id % 3 > 0 THEN event_id % 70 END, 0)) AS STRING) AS arrived,
    CAST(clock + INTERVAL 1 HOUR + to_seconds(120 + coalesce(CASE WHEN event_id % 3 > 0 THEN event_id % 70 END, 0)) AS STRING) AS departed
    FROM (SELECT *, row_number() OVER (PARTITION BY seq, event_id % 8 ORDER BY event_id) AS n FROM pos WHERE event_id % 5 > 0) x WHERE n = 1)"""


def positions(s):
    """seq, json: responses of a vehicle source, two polls a day in five pages each; every seventh trip is a train. One junk message per nation."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.000'Z'")
    later = lambda n: iso(F.timestamp_add("SECOND", F.lit(n), C("ts")))
    e, u, some = C("event_id"), C("user_id"), lambda ok, c: F.when(ok, c)
    last = F.struct(F.concat(F.lit("U"), text(e % 60)).alias("id"), some(e % 5 > 0, (e % 8).cast("int")).alias("sequence"), some(e % 211 > 0, later(60)).alias("arrival_time"), later(120).alias("departure_time"))
    delay = F.struct(some(e % 2 > 0, (e % 90).cast("int")).alias("last_stop_arrival"), some(e % 3 > 0, (e % 70).cast("int")).alias("last_stop_departure"))
    point = F.struct(F.lit("Point").alias("type"), F.array((e % 777).cast("double"), (e % 1000).cast("double")).alias("coordinates"))
    seen = F.struct(point.alias("geometry"), F.struct(F.when(e % 499 == 0, "yesterday").otherwise(iso(C("ts"))).alias("origin_timestamp"), last.alias("last_stop"), delay.alias("delay")).alias("properties"))
    polls = s.events.withColumn("r", F.explode(F.array(F.lit(0), F.lit(1)))).where("(r = 0 and hour(ts) < 12) or (r = 1 and hour(ts) >= 6)").withColumn("day", F.to_date("ts"))
    trips = polls.groupBy("user_id", "day", "r").agg(F.min("event_id").alias("e0"), F.transform(F.sort_array(F.collect_list(F.struct("event_id", seen.alias("x")))), lambda p: p["x"]).alias("features"))
    gtfs = F.struct(some((u % 7 != 1) | (F.day("day") % 10 != 3), text(u)).alias("trip_id"), F.concat(F.lit("r"), text(u % 9)).alias("route_id"), text(u % 4).alias("route_short_name"))
    kind = some(u % 7 > 0, F.struct((u % 5).cast("int").alias("id"), F.lit("kind").alias("description_en")))
    start = F.when((u % 7 == 2) & (F.day("day") % 10 == 4), "soon").otherwise(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T12:00:00.000Z")))
    trip = F.struct(gtfs.alias("gtfs"), F.struct((u % 100).cast("int").alias("trip_number")).alias("cis"), kind.alias("vehicle_type"), start.alias("start_timestamp"))
    feature = F.struct("user_id", F.struct(F.struct(trip.alias("trip"), F.struct("features").alias("all_positions")).alias("properties")).alias("x"))
    pages = trips.groupBy("day", "r", u % 5).agg((F.min("e0") * 2 + C("r")).alias("seq"), F.transform(F.sort_array(F.collect_list(feature)), lambda f: f["x"]).alias("features"))
    return pages.select("seq", F.to_json(F.struct("features")).alias("json")).union(s.sql("SELECT -1 - CAST(n_nationkey AS BIGINT) AS seq, CASE WHEN n_nationkey % 2 = 0 THEN '<html>' ELSE '{\"error\": 1}' END AS json FROM nation"))


@query("src6_rt2_coordinates", f"WITH {POSITIONS} SELECT seq, trip_id, day AS trip_start_date, CAST(clock AS STRING) AS seen, lat, lon FROM (SELECT *, CAST(event_id % 1000 AS DOUBLE) AS lat, CAST(event_id % 777 AS DOUBLE) AS lon, row_number() OVER (PARTITION BY seq, clock ORDER BY event_id) AS n FROM pos) x WHERE n = 1")
def _(s):
    coords = realtime.process_positions(positions(s))[0]
    return coords.select("seq", "trip_id", "trip_start_date", F.date_format("observation_time", "yyyy-MM-dd HH:mm:ss").alias("seen"), "lat", "lon")


def stop_times(stops):
    return stops.select("seq", "trip_id", "trip_start_date", "trip_stop_index", "stop_id", F.date_format("arrived_at", "yyyy-MM-dd HH:mm:ss").alias("arrived"), F.date_format("departed_at", "yyyy-MM-dd HH:mm:ss").alias("departed"))


@query("src6_rt2_stop_rows", f"WITH {POSITIONS}, {STOP_ROWS} SELECT * FROM s")
def _(s):
    return stop_times(realtime.process_positions(positions(s))[1])


@query("src6_rt2_details", f"WITH {POSITIONS} SELECT DISTINCT seq, trip_id, day AS trip_start_date, '-PIDT-r' || user_id % 9 AS route_id, (user_id % 4) || ' (' || (user_id % 100) || ')' AS short_name, CAST(user_id % 4 AS STRING) AS route_short_name FROM pos")
def _(s):
    return realtime.process_positions(positions(s))[2]


@query("src6_rt2_all_trips", f"WITH {POSITIONS} SELECT CAST(count(*) AS BIGINT) AS trips, CAST(count(*) FILTER (WHERE user_id % 7 = 0) AS BIGINT) AS trains FROM m WHERE reason IS NULL")
def _(s):
    details = realtime.process_positions(positions(s), no_trains=False)[2]
    return details.agg(F.count("*").alias("trips"), F.count(F.when(F.substring("trip_id", 7, 20).cast("int") % 7 == 0, 1)).alias("trains"))


REJECTS = f"WITH {POSITIONS} SELECT msg AS seq, CASE WHEN reason = 'no ids' THEN CAST(place AS STRING) ELSE CAST(user_id AS STRING) END AS item, reason FROM m WHERE user_id % 7 > 0 AND reason IS NOT NULL UNION ALL SELECT -1 - n_nationkey, NULL, 'no response' FROM nation"


@query("src6_rt2_rejects", REJECTS)
def _(s):
    return realtime.process_positions(positions(s))[3].drop("json")


@query("src7_stops_from_geojson", "SELECT '-PIDS-' || s_suppkey AS id, s_name AS name, 48 + s_suppkey % 64 / 64 AS lat, 14 + s_suppkey % 32 / 32 AS lon FROM supplier")
def _(s):
    feature = F.struct(F.struct(F.array(14 + C("s_suppkey") % 32 / 32, 48 + C("s_suppkey") % 64 / 64).alias("coordinates")).alias("geometry"), F.struct(text("s_suppkey").alias("stop_id"), C("s_name").alias("stop_name")).alias("properties"))
    pages = s.supplier.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("json"))
    return realtime.stops_from_geojson(pages)


def responses(s):
    """seq, json: responses of the train map, one per snapshot; every 97th has a time that is none, and one junk message per nation."""
    at = F.timestamp_add("SECOND", C("snapshot_no") * 21_600, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    short = lambda c: F.substring(clock(C(c)), 1, 5)
    number = F.substring("train", 2, 10)
    name = F.when(number.cast("int") % 13 == 0, C("train")).otherwise(F.concat(F.lit("x/"), number, F.lit("/c/v/y"), F.lit("/20240101")))
    of = F.struct(name.alias("id"), F.lit("Os").alias("tt"), number.alias("tn"), F.lit("").alias("na"), C("last_point").alias("cna"), short("planned").alias("cp"), F.when(C("measured") % 420 > 0, short("measured")).otherwise("").alias("cr"), C("staying").cast("int").alias("rr"), F.lit(3).alias("de"))
    each = s.snapshots.groupBy("snapshot_no", at.alias("at")).agg(F.collect_list(F.struct(of.alias("properties"))).alias("result"))
    time = F.when(C("snapshot_no") % 97 == 96, "now").otherwise(F.date_format("at", "dd.MM.yyyy HH:mm:ss"))
    texts = each.select(C("snapshot_no").cast("long").alias("seq"), F.to_json(F.struct(time.alias("md"), "result")).alias("json"))
    return texts.union(s.sql("SELECT -1 - CAST(n_nationkey AS BIGINT) AS seq, '[]' AS json FROM nation"))


SNAPSHOTS = """p AS (SELECT *, CAST(substr(train, 2) AS BIGINT) AS no, CASE WHEN measured % 420 > 0 THEN measured END AS m FROM snapshots WHERE snapshot_no % 97 < 96),
  sn AS (SELECT snapshot_no, CAST(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(snapshot_no * 21600) AS STRING) AS taken, CASE WHEN no % 13 = 0 THEN train ELSE 'x/' || no || '/c/v/y/20240101' END AS train, last_point, staying, planned, m AS measured, 'Os ' || no || ' ' AS short_name FROM p)"""


@query("src8_train_snapshots", f"WITH {SNAPSHOTS} SELECT * FROM sn")
def _(s):
    return realtime.train_snapshots(responses(s))[0].withColumn("taken", F.date_format("taken", "yyyy-MM-dd HH:mm:ss"))


@query("src8_rejects", "SELECT DISTINCT CAST(snapshot_no AS BIGINT) AS seq, 'time of the response' AS reason FROM snapshots WHERE snapshot_no % 97 = 96 UNION ALL SELECT -1 - n_nationkey, 'no response' FROM nation")
def _(s):
    return realtime.train_snapshots(responses(s))[1].select("seq", "reason")


@query("src9_train_summary", "SELECT o_orderkey AS id, 'Os-' || o_orderkey AS trip_id, 48 + o_orderkey % 64 / 64 AS lat, 14 + o_orderkey % 32 / 32 AS lon FROM orders")
def _(s):
    k = C("o_orderkey")
    train = F.struct(k.alias("Id"), F.array(48 + k % 64 / 64, 14 + k % 32 / 32).alias("GPS"), F.concat(F.lit("Os "), text(k), F.lit(" Praha - Brno")).alias("Title"))
    texts = s.orders.groupBy(C("o_custkey") % 50).agg(F.to_json(F.struct(F.collect_list(train).alias("Trains"))).alias("json")).select("json")
    return realtime.train_summary(texts)


@query("src10_read_dimension", "SELECT p_name || ', \"' || p_partkey || '\"' AS name, p_brand AS region FROM part")
def _(s):
    path = folder(s, "towns")
    s.part.select(F.concat("p_name", F.lit(', "'), text("p_partkey"), F.lit('"')), "p_brand").write.option("quoteAll", True).option("escape", '"').csv(path)
    return realtime.read_dimension(s.spark, "towns", path)


@query("src11_read_polygons", "SELECT 'c' || c_custkey AS name, 'n' || c_nationkey AS region, 5 AS points, CAST(c_custkey % 1000 AS DOUBLE) AS x FROM customer")
def _(s):
    k = (C("c_custkey") % 1000).cast("double")
    corner = lambda dx, dy: F.array(k + dx, F.lit(float(dy)))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))).alias("coordinates"))
    feature = F.struct(F.struct(F.concat(F.lit("c"), text("c_custkey")).alias("name"), F.concat(F.lit("n"), text("c_nationkey")).alias("region")).alias("properties"), shape.alias("geometry"))
    path = folder(s, "polygons")
    # a file holds at most so many keys of a nation, however large the table
    s.customer.groupBy("c_nationkey", F.floor(C("c_custkey") / 50_000)).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("json")).select("json").write.option("maxRecordsPerFile", 1).text(path)
    return realtime.read_polygons(s.spark, path).select("name", "region", F.size("ring").alias("points"), F.array_min(F.transform("ring", lambda p: p["x"])).alias("x"))
