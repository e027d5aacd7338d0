"""Queries of service days and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from timetide.functions.lineage import shuffled
from timetide.jobs.registry import query
from timetide.operators import calendars as C

KEYS = ["route_id", "dist", "trip"]
HOLIDAYS = """years AS (SELECT unnest(generate_series(1995, 2010)) AS y), g AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
  g2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM g),
  g3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM g2), g4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM g3),
  easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS e FROM g4),
  hol AS (SELECT CAST(e - 2 AS DATE) AS day FROM easter UNION SELECT CAST(e + 1 AS DATE) FROM easter UNION
    SELECT make_date(y, m, d) FROM years, (VALUES (1, 1), (5, 1), (5, 8), (7, 5), (7, 6), (9, 28), (10, 28), (11, 17), (12, 24), (12, 25), (12, 26)) t(m, d))"""
RUNS = f"""{HOLIDAYS}, td AS (SELECT *, CAST(unnest(generate_series(valid_from, valid_to, INTERVAL 1 DAY)) AS DATE) AS day, string_split(codes, ',') AS cs FROM trips),
  nn AS (SELECT n.route_id, n.dist, n.trip, n.note_type, coalesce(n.date_from, t.valid_from) AS f, coalesce(n.date_to, n.date_from, t.valid_from) AS e FROM notes n JOIN trips t USING (route_id, dist, trip) WHERE note_type IS NOT NULL),
  f AS (SELECT td.route_id, td.dist, td.trip, td.day, any_value(cs) AS cs, bool_or(coalesce(note_type = 3, FALSE)) AS e3, bool_or(coalesce(note_type = 1, FALSE)) AS e1,
      bool_or(coalesce(note_type = 3 AND day BETWEEN f AND e, FALSE)) AS n3, bool_or(coalesce(note_type = 4 AND day BETWEEN f AND e, FALSE)) AS n4, bool_or(coalesce(note_type = 2 AND day BETWEEN f AND e, FALSE)) AS n2,
      bool_or(coalesce(note_type IN (5, 7) AND day BETWEEN f AND e, FALSE)) AS n5, bool_or(coalesce(note_type IN (6, 8) AND day BETWEEN f AND e, FALSE)) AS n6, bool_or(coalesce(note_type = 1 AND day BETWEEN f AND e, FALSE)) AS n1
    FROM td LEFT JOIN nn ON nn.route_id = td.route_id AND nn.dist = td.dist AND nn.trip = td.trip GROUP BY 1, 2, 3, 4),
  runs_on AS (SELECT route_id, dist, trip, f.day FROM f LEFT JOIN hol ON hol.day = f.day WHERE CASE WHEN n3 THEN TRUE WHEN e3 THEN FALSE WHEN n4 THEN FALSE WHEN n2 THEN TRUE
    WHEN n5 AND weekofyear(f.day) % 2 = 0 THEN FALSE WHEN n6 AND weekofyear(f.day) % 2 = 1 THEN FALSE WHEN e1 AND NOT n1 THEN FALSE
    WHEN list_contains(cs, '+') AND (hol.day IS NOT NULL OR isodow(f.day) = 7) THEN TRUE WHEN list_contains(cs, 'X') AND hol.day IS NULL AND isodow(f.day) <= 5 THEN TRUE
    WHEN list_contains(cs, CAST(isodow(f.day) AS STRING)) THEN TRUE ELSE NOT list_has_any(cs, ['X', '+', '1', '2', '3', '4', '5', '6', '7']) END)"""
PATTERN = """pat AS (SELECT route_id, dist, trip, valid_from, valid_to, string_split(codes, ',') AS cs FROM trips),
  bits AS (SELECT *, [NOT list_has_any(cs, ['X', '+', '1', '2', '3', '4', '5', '6', '7']) OR list_contains(cs, CAST(i AS STRING)) OR (i <= 5 AND list_contains(cs, 'X')) OR (i = 7 AND list_contains(cs, '+')) FOR i IN [1, 2, 3, 4, 5, 6, 7]] AS b FROM pat),
  planned AS (SELECT route_id, dist, trip, day FROM (SELECT route_id, dist, trip, b, CAST(unnest(generate_series(valid_from, valid_to, INTERVAL 1 DAY)) AS DATE) AS day FROM bits) WHERE b[isodow(day)])"""
COMPACT = f"""{RUNS}, {PATTERN}, bothd AS (SELECT coalesce(r.route_id, p.route_id) AS route_id, coalesce(r.dist, p.dist) AS dist, coalesce(r.trip, p.trip) AS trip, coalesce(r.day, p.day) AS day, r.day IS NOT NULL AS runs, p.day IS NOT NULL AS planned
    FROM runs_on r FULL JOIN planned p ON r.route_id = p.route_id AND r.dist = p.dist AND r.trip = p.trip AND r.day = p.day),
  facts AS (SELECT route_id, dist, trip, count(*) FILTER (WHERE runs) AS n, count(*) FILTER (WHERE runs <> planned) AS d FROM bothd GROUP BY 1, 2, 3)"""


def trips(s):
    return s.trips.withColumn("codes", F.split("codes", ","))


def days(s):
    return C.service_days(trips(s), s.notes, C.czech_holidays(s.spark, 1995, 2010), KEYS)


@query("p18_czech_holidays", f"WITH {HOLIDAYS} SELECT DISTINCT h.day FROM hol h WHERE EXISTS (SELECT 1 FROM orders WHERE year(o_orderdate) = year(h.day))")
def _(s):
    used = s.orders.select(F.year("o_orderdate").alias("y")).distinct()
    return C.czech_holidays(s.spark, 1995, 2010).withColumn("y", F.year("day")).join(used, "y", "left_semi").select("day")


@query("c1_service_days", f"WITH {RUNS} SELECT * FROM runs_on")
def _(s):
    return days(s)


def text(bits):
    return F.array_join(F.transform(bits, lambda b: F.when(b, "1").otherwise("0")), "")


@query("c2_weekly_pattern", f"WITH {PATTERN} SELECT route_id, dist, trip, array_to_string([CASE WHEN x THEN '1' ELSE '0' END FOR x IN b], '') AS pattern FROM bits")
def _(s):
    return trips(s).select(*KEYS, text(C.weekly_pattern(F.col("codes"))).alias("pattern"))


@query("c3_calendar_days", f"WITH {PATTERN} SELECT * FROM planned")
def _(s):
    return C.calendar_days(trips(s).withColumn("pattern", C.weekly_pattern(F.col("codes"))), KEYS)


def calendar(s):
    return C.service_calendar(trips(s), s.notes, C.czech_holidays(s.spark, 1995, 2010), KEYS)


@query("c4_compact_calendar", f"WITH {COMPACT} SELECT f.route_id, f.dist, f.trip FROM facts f WHERE n > 0 AND d <= n")
def _(s):
    services, plans = calendar(s)
    return services.join(plans.where("pattern is not null").select("plan"), "plan").select(*KEYS)


@query("c4_calendar_exceptions", f"WITH {COMPACT} SELECT b.route_id, b.dist, b.trip, day, CASE WHEN runs THEN 1 ELSE 2 END AS exception_type FROM bothd b JOIN facts f USING (route_id, dist, trip) WHERE n > 0 AND CASE WHEN d > n THEN runs ELSE runs <> planned END")
def _(s):
    services, plans = calendar(s)
    return services.join(shuffled(plans.select("plan", "changes")), "plan").select(*KEYS, F.inline("changes"))


@query("c5_dedupe_calendar", f"""WITH {COMPACT}, ex AS (SELECT b.route_id, b.dist, b.trip, string_agg(CAST(day AS STRING) || CASE WHEN runs THEN '+' ELSE '-' END, ',' ORDER BY day) AS x FROM bothd b JOIN facts f USING (route_id, dist, trip) WHERE n > 0 AND CASE WHEN d > n THEN runs ELSE runs <> planned END GROUP BY 1, 2, 3),
  s AS (SELECT 'CIST-' || f.route_id || '-' || f.dist || '-' || f.trip AS service_id, CASE WHEN d <= n THEN array_to_string([CASE WHEN v THEN '1' ELSE '0' END FOR v IN b], '') ELSE 'exc' END AS bits,
      CASE WHEN d <= n THEN CAST(p.valid_from AS STRING) || CAST(p.valid_to AS STRING) END AS span, x FROM facts f JOIN bits p USING (route_id, dist, trip) LEFT JOIN ex ON ex.route_id = f.route_id AND ex.dist = f.dist AND ex.trip = f.trip WHERE n > 0),
  grp AS (SELECT *, min(service_id) OVER (PARTITION BY bits, span, x) AS fst FROM s)
  SELECT service_id, 'CAL-' || bits || '-' || CAST(dense_rank() OVER (ORDER BY fst) - 1 AS STRING) AS calendar_id FROM grp""")
def _(s):
    services, plans = calendar(s)
    services = services.select("plan", F.format_string("CIST-%d-%d-%d", *KEYS).alias("service_id"))
    return services.join(C.calendar_names(services, plans, "service_id"), "plan").select("service_id", "calendar_id")


def messages(s):
    return s.bitmaps.withColumn("bitmap", F.lpad(F.bin("bits"), 20, "0"))


BITDAYS = "bd AS (SELECT id, CAST(start + CAST(i AS INT) + least(offset_days, 0) AS DATE) AS day, cancelled FROM bitmaps, (SELECT unnest(generate_series(0, 19)) AS i) n WHERE (bits >> (19 - i)) % 2 = 1)"


@query("c6_czptt_days", f"WITH {BITDAYS} SELECT id, day FROM bd")
def _(s):
    return C.bitmap_days(messages(s), ["id"])


@query("c7_cancel_days", f"WITH {BITDAYS} SELECT id, day FROM bd WHERE NOT (cancelled AND day IN (SELECT b2.day FROM bd b2 WHERE b2.id = bd.id + 1))")
def _(s):
    every = C.bitmap_days(messages(s), ["id"])
    off = messages(s).where("id % 7 = 1").withColumn("id", F.col("id") - 1)
    return C.cancel_days(every, C.bitmap_days(off, ["id"]), ["id"])


@query("c8_days_to_bitmap", f"WITH {BITDAYS} SELECT id, min(day) AS start, trim(replace(rtrim(ltrim(replace(lpad(bin(any_value(bits)), 20, '0'), '0', ' '))), ' ', '0')) AS bitmap FROM bd JOIN bitmaps USING (id) GROUP BY id")
def _(s):
    return C.days_to_bitmap(C.bitmap_days(messages(s), ["id"]), ["id"])


@query("c8_bitmap_ops", "SELECT id, lpad(bin(1048575 - bits), 20, '0') AS negated, lpad(bin(bits & (1048575 - bits * 7 % 1048576)), 20, '0') AS common, '00' || lpad(bin(bits), 20, '0') || '000' AS extended FROM bitmaps")
def _(s):
    m = messages(s).withColumn("other", F.lpad(F.bin(F.lit(1048575) - F.col("bits") * 7 % 1048576), 20, "0"))
    return m.select("id", C.bitmap_not(F.col("bitmap")).alias("negated"), C.bitmap_and(F.col("bitmap"), F.col("other")).alias("common"), C.bitmap_extend(F.col("bitmap"), F.col("start"), F.date_sub("start", 2), F.date_add("start", 22)).alias("extended"))


@query("c9_negative_day_offset", "SELECT l_orderkey AS id, least(min(CAST(l_suppkey % 4 AS INT)) - 2, min(CAST(l_partkey % 5 AS INT)) - 1, 0) AS shift FROM items GROUP BY 1")
def _(s):
    nested = s.items.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct((F.col("l_suppkey") % 4 - 2).cast("int").alias("arr_offset"), (F.col("l_partkey") % 5 - 1).cast("int").alias("dep_offset"))).alias("locs"))
    return nested.select("id", C.negative_day_offset(F.col("locs")).alias("shift"))


@query("a8_feed_info", "SELECT min(start) AS start_date, coalesce(max(CASE WHEN id % 3 = 0 THEN CAST(start + 19 AS DATE) END), min(start)) AS end_date FROM bitmaps")
def _(s):
    return C.feed_info(s.bitmaps.select("start", F.when(F.col("id") % 3 == 0, F.date_add("start", 19)).alias("end")))
