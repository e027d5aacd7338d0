"""Queries of the railway conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from timetide.functions.lineage import shuffled
from timetide.jobs.registry import query
from timetide.jobs.timetable import written_feed
from timetide.operators import rail as R

C = F.col
#: Locations as messages have them, for both engines: train = message, three platforms, five companies.
LOC = """loc AS (SELECT train AS message_id, pos, code, 'Stop ' || code AS name, CASE WHEN operator = 4 THEN '2' END AS platform, operator AS company, public,
  CASE train % 5 WHEN 0 THEN 'EC' WHEN 1 THEN 'rj' WHEN 2 THEN 'XX' END AS commercial, CASE WHEN train % 2 = 0 THEN 'Os' ELSE 'R' END AS traffic, qty * 600 AS arr_sec, CASE WHEN qty % 3 > 0 THEN qty * 600 + 60 END AS dep_sec,
  CAST(qty % 3 - 1 AS INT) AS arr_offset, CAST(qty % 3 - 1 AS INT) AS dep_offset, qty % 4 = 0 AS request, qty % 4 = 1 AS exit_only FROM locations)"""


def locations(s):
    act = F.when(~C("public"), F.array(F.lit("0002"))).when(C("qty") % 4 == 0, F.array(F.lit("0001"), F.lit("0030"))).when(C("qty") % 4 == 1, F.array(F.lit("0029"))).otherwise(F.array(F.lit("0001")))
    k = C("train") % 5
    return s.locations.select(
        C("train").alias("message_id"), "pos", F.lit("CZ").alias("country"), C("code").cast("string").alias("code"), F.concat(F.lit("Stop "), C("code").cast("string")).alias("name"),
        F.when(C("operator") == 4, "2").alias("platform"), C("operator").alias("company"), F.when(k == 0, "EC").when(k == 1, "rj").when(k == 2, "XX").alias("commercial"), F.when(C("train") % 2 == 0, "Os").otherwise("R").alias("traffic"),
        C("train").alias("train_no"), F.lit("1").alias("train_type"), F.lit(None).cast("string").alias("train_name"), act.alias("activities"), (C("qty") * 600).alias("arr_sec"), F.when(C("qty") % 3 > 0, C("qty") * 600 + 60).alias("dep_sec"),
        (C("qty") % 3 - 1).cast("int").alias("arr_offset"), (C("qty") % 3 - 1).cast("int").alias("dep_offset"),
    )


def messages(s):
    return s.locations.select(C("train").alias("message_id")).distinct().select("message_id", F.lit(2024).alias("year"), C("message_id").cast("string").alias("core"), F.lit("01").alias("variant"))


@query("p19_public_locations", "SELECT train AS message_id, pos FROM locations WHERE public")
def _(s):
    return R.public_locations(locations(s)).select("message_id", "pos")


@query("j15_companies", "SELECT o AS company, CASE WHEN o = 4 THEN 'Unknown 4' ELSE 'b' || o END AS company_name FROM (SELECT DISTINCT operator AS o FROM locations) x")
def _(s):
    used = s.locations.select(C("operator").alias("company")).distinct()
    base = used.where("company <> 4").select(C("company").alias("code"))
    rows = [base.select("code", F.concat(F.lit(p), C("code").cast("string")).alias("name"), F.lit(a).alias("licence_a"), F.lit(b).alias("licence_b"), F.lit(None).cast("boolean").alias("licence_c")) for p, a, b in (("a", True, False), ("b", True, True), ("c", True, True))]
    return R.with_company_names(used, rows[0].union(rows[1]).union(rows[2])).select("company", "company_name")


SEG = """seg AS (SELECT *, lead(code) OVER (PARTITION BY train ORDER BY pos) AS nxt FROM (SELECT *, min(CASE WHEN public THEN pos END) OVER (PARTITION BY train) AS f, max(CASE WHEN public THEN pos END) OVER (PARTITION BY train) AS l FROM locations) x WHERE pos BETWEEN f AND l)"""


@query("w10_adjacent_segments", f"WITH {SEG} SELECT train, least(code, nxt) AS a, greatest(code, nxt) AS b, operator FROM seg WHERE nxt IS NOT NULL")
def _(s):
    return R.adjacent_segments(s.locations, "train", "pos", "code", "public", ["operator"])


@query("a9_segment_agencies", f"WITH {SEG}, c AS (SELECT least(code, nxt) AS a, greatest(code, nxt) AS b, operator, count(DISTINCT train) AS n FROM seg WHERE nxt IS NOT NULL GROUP BY 1, 2, 3) SELECT a, b, string_agg(operator || ':' || n, ',' ORDER BY operator) AS operators FROM c GROUP BY 1, 2")
def _(s):
    out = R.segment_agencies(R.adjacent_segments(s.locations, "train", "pos", "code", "public", ["operator"]), "train", "operator")
    return out.withColumn("operators", F.array_join(F.transform("operators", lambda o: F.concat_ws(":", o["operator"].cast("string"), o["n"].cast("string"))), ","))


@query("a17_czptt_stop_list", "SELECT DISTINCT lpad(CAST(code AS STRING), 5, '0') AS sr70, 'Stop ' || code AS name FROM locations")
def _(s):
    return R.czptt_stop_list(locations(s))


@query("w11_first_per_key", "SELECT code, train, pos FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY train, pos) AS n FROM locations) x WHERE n = 1")
def _(s):
    return R.first_per_key(s.locations, ["code"], ["train", "pos"]).select("code", "train", "pos")


@query("g2_czptt_stops", f"WITH {LOC}, u AS (SELECT '-SR70S-CZ-' || code || coalesce('-' || platform, '') AS stop_id, CASE WHEN platform IS NOT NULL THEN '-SR70ST-CZ-' || code END AS parent_station, name AS stop_name FROM loc WHERE public UNION SELECT '-SR70ST-CZ-' || code, NULL, name FROM loc WHERE public AND platform IS NOT NULL) SELECT * FROM u")
def _(s):
    return R.czptt_stops(locations(s)).select("stop_id", "parent_station", "stop_name")


TRAIN = f"{LOC}, tr AS (SELECT message_id, min(commercial) AS commercial, min(traffic) AS traffic, arg_max(name, pos) AS headsign, CAST(arg_min(company, pos) AS STRING) AS company FROM loc WHERE public GROUP BY 1)"


@query("g2_czptt_trips", f"WITH {TRAIN} SELECT message_id, '-CZTRAINR-2024-' || coalesce(commercial, traffic) || '-' || message_id AS route_id, '-CZTRAINT-2024:' || message_id || ':01' AS trip_id, headsign AS trip_headsign FROM tr WHERE commercial IS NULL OR commercial <> 'XX'")
def _(s):
    return R.czptt_trips(messages(s), locations(s))[1].select("message_id", "route_id", "trip_id", "trip_headsign")


@query("g2_czptt_routes", f"WITH {TRAIN} SELECT '-CZTRAINR-2024-' || coalesce(commercial, traffic) || '-' || message_id AS route_id, company AS agency_id, CASE commercial WHEN 'EC' THEN 102 WHEN 'rj' THEN 103 ELSE CASE traffic WHEN 'Os' THEN 106 ELSE 103 END END AS route_type, coalesce(commercial, traffic) || ' ' || message_id AS route_short_name FROM tr WHERE commercial IS NULL OR commercial <> 'XX'")
def _(s):
    return R.czptt_trips(messages(s), locations(s))[0].select("route_id", C("agency_id").cast("string").alias("agency_id"), "route_type", "route_short_name")


@query("g3_czptt_rejects", f"WITH {TRAIN} SELECT message_id, commercial FROM tr WHERE commercial = 'XX'")
def _(s):
    return R.czptt_trips(messages(s), locations(s))[2].select("message_id", "commercial")


@query("g2_czptt_stop_times", f"""WITH {LOC}, m AS (SELECT message_id, least(min(least(arr_offset, dep_offset)), 0) AS o FROM loc GROUP BY 1),
  t AS (SELECT l.*, row_number() OVER (PARTITION BY message_id ORDER BY pos) - 1 AS stop_sequence, arr_sec + 86400 * (arr_offset - o) AS a, dep_sec + 86400 * (dep_offset - o) AS d FROM loc l JOIN m USING (message_id) WHERE public)
  SELECT message_id, stop_sequence, '-SR70S-CZ-' || code || coalesce('-' || platform, '') AS stop_id, coalesce(a, d) AS arrival, coalesce(d, a) AS departure, CASE WHEN exit_only THEN 1 WHEN request THEN 3 ELSE 0 END AS pickup_type FROM t""")
def _(s):
    return R.czptt_stop_times(messages(s), locations(s)).select("message_id", "stop_sequence", "stop_id", "arrival", "departure", "pickup_type")


@query("g2_czptt_agencies", "SELECT DISTINCT '-CZPTTA-' || operator AS agency_id, 'Unknown ' || operator AS agency_name FROM locations WHERE public")
def _(s):
    none = s.spark.createDataFrame([], "code int, name string, licence_a boolean, licence_b boolean, licence_c boolean")
    return R.czptt_agencies(locations(s), none)


def whole_messages(s):
    """messages with their days: 20 days from the order's date, every seventh message's next one cancelling a part."""
    days = s.bitmaps.select(C("id").alias("message_id"), "start", F.lpad(F.bin("bits"), 20, "0").alias("bitmap"))
    return messages(s).join(shuffled(days), "message_id")


@query("g2_czptt_feed_days", f"""WITH {TRAIN}, m AS (SELECT message_id, least(min(least(arr_offset, dep_offset)), 0) AS o FROM loc GROUP BY 1),
  bd AS (SELECT id, CAST(start + CAST(i AS INT) + CAST(o AS INT) AS DATE) AS day FROM bitmaps JOIN m ON m.message_id = id, (SELECT unnest(generate_series(0, 19)) AS i) n WHERE (bits >> (19 - i)) % 2 = 1)
  SELECT '-CZTRAINT-2024:' || id || ':01' AS trip_id, day FROM bd JOIN tr ON tr.message_id = id WHERE (commercial IS NULL OR commercial <> 'XX') AND NOT (id % 7 = 0 AND day(day) <= 10)""")
def _(s):
    """The days of each train as a reader of the written feed finds them; every seventh train is cancelled on the first ten days of a month."""
    s.store("locations")  # all tables of the feed are made of them, several times over
    off = R.czptt_service_days(whole_messages(s), locations(s)).where("message_id % 7 = 0 and day(day) <= 10")
    none = s.spark.createDataFrame([], "code int, name string, licence_a boolean, licence_b boolean, licence_c boolean")
    back = written_feed(s, R.czptt_to_gtfs(whole_messages(s), locations(s), none, off))
    return back["trips"].join(shuffled(back["calendar_dates"]), "service_id").select("trip_id", C("date").alias("day"))
