"""Queries of the batch merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from timetide.jobs.registry import query
from timetide.operators import merging as M

C = F.col
STOP = """st AS (SELECT *, town || '|' || district || '|' || coalesce(place, '-') || '|' || coalesce(country, '-') AS k FROM batches),
  ft AS (SELECT k, batch_id, stop_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY batch_id, stop_id) AS n FROM st) x WHERE n = 1), nw AS (SELECT k, row_number() OVER (ORDER BY batch_id, stop_id) AS new_id FROM ft),
  mp AS (SELECT st.batch_id, st.stop_id, new_id FROM st JOIN nw USING (k))"""


def stops(s):
    return s.batches.withColumn("region", F.lit(None).cast("string"))


def mapping(s):
    return M.merge_stops(stops(s))[1]


@query("m2_merge_stops_map", f"WITH {STOP} SELECT * FROM mp")
def _(s):
    return mapping(s)


@query("m2_merge_stops", f"WITH {STOP} SELECT new_id, b.batch_id, b.stop_id, b.town FROM ft JOIN nw USING (k) JOIN batches b ON b.batch_id = ft.batch_id AND b.stop_id = ft.stop_id")
def _(s):
    return M.merge_stops(stops(s))[0].select("new_id", "batch_id", "stop_id", "town")


@query("m2_merge_stops_by_id", "SELECT stop_id AS new_id, min(batch_id) AS batch_id FROM batches GROUP BY 1")
def _(s):
    return M.merge_stops(stops(s), by="id")[0].select("new_id", "batch_id")


@query("m1_merge_attribute_refs", "WITH r AS (SELECT DISTINCT batch_id, size % 9 AS attribute_id, 'c' || size % 4 AS code FROM batches), f AS (SELECT code, min((batch_id, attribute_id)) AS fst FROM r GROUP BY 1), n AS (SELECT code, row_number() OVER (ORDER BY fst) AS new_id FROM f) SELECT DISTINCT batch_id, attribute_id, new_id FROM r JOIN n USING (code)")
def _(s):
    refs = s.batches.select("batch_id", (C("size") % 9).alias("attribute_id"), F.concat(F.lit("c"), (C("size") % 4).cast("string")).alias("code"), F.lit(None).cast("string").alias("reserved")).distinct()
    return M.merge_attribute_refs(refs)[1]


LOCS = f"{STOP}, lc AS (SELECT b.batch_id, b.stop_id, CASE WHEN b.stop_id % 3 = 0 THEN 'S' ELSE 'T' END AS precision, CAST(b.stop_id * 37 % 3000 AS DOUBLE) AS x, CAST(b.batch_id * 10 AS DOUBLE) AS y, new_id FROM batches b JOIN mp USING (batch_id, stop_id)), rk AS (SELECT *, row_number() OVER w AS n, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, first_value(precision) OVER w AS fp FROM lc WINDOW w AS (PARTITION BY new_id ORDER BY precision, batch_id, stop_id))"


def places(s):
    return s.batches.select("batch_id", "stop_id", F.when(C("stop_id") % 3 == 0, "S").otherwise("T").alias("precision"), (C("stop_id") * 37 % 3000).cast("double").alias("x"), (C("batch_id") * 10).cast("double").alias("y"))


@query("m3_merge_stop_locations", f"WITH {LOCS} SELECT new_id, precision, x, y FROM rk WHERE n = 1")
def _(s):
    return M.merge_stop_locations(places(s), mapping(s))[0]


@query("m3_location_warnings", f"WITH {LOCS}, w AS (SELECT new_id, batch_id, stop_id FROM rk WHERE precision = 'S' AND fp = 'S' AND sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) > 1000) SELECT 'warnings' AS what, count(*) AS n FROM w UNION ALL SELECT 'locations', count(*) FROM lc")
def _(s):
    kept, warned = M.merge_stop_locations(places(s), mapping(s))
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(warned, "warnings").union(count(s.batches, "locations"))


@query("m4_merge_stop_posts", f"WITH {STOP} SELECT new_id, post_id, first(post_name ORDER BY batch_id, stop_id) AS post_name FROM (SELECT mp.*, stop_id % 2 AS post_id, 'P' || stop_id AS post_name FROM mp) x GROUP BY 1, 2")
def _(s):
    posts = s.batches.select("batch_id", "stop_id", (C("stop_id") % 2).alias("post_id"), F.concat(F.lit("P"), C("stop_id").cast("string")).alias("post_name"))
    return M.merge_stop_posts(posts, mapping(s))


AG = "ag AS (SELECT DISTINCT batch_id, size % 6 AS agency_id, size % 2 AS agency_dist, 'n' || size % 3 AS name FROM batches)"


def agencies(s):
    return s.batches.select("batch_id", (C("size") % 6).alias("agency_id"), (C("size") % 2).alias("agency_dist"), F.concat(F.lit("n"), (C("size") % 3).cast("string")).alias("name")).distinct()


@query("m5_merge_agencies", f"WITH {AG}, f AS (SELECT agency_id, name, min((batch_id, agency_dist)) AS fst FROM ag GROUP BY 1, 2), n AS (SELECT agency_id, name, row_number() OVER (PARTITION BY agency_id ORDER BY fst) AS new_dist FROM f) SELECT DISTINCT batch_id, agency_id, agency_dist, new_dist FROM ag JOIN n USING (agency_id, name)")
def _(s):
    return M.merge_agencies(agencies(s))[1]


def batch_routes(s):
    return s.routes.select((C("o_orderkey") % 5).alias("batch_id"), "route_id", "dist", "valid_from", "valid_to", "detour", "created")


@query("m6_merge_routes", "SELECT o_orderkey % 5 AS batch_id, route_id, dist, row_number() OVER (PARTITION BY route_id ORDER BY o_orderkey % 5, dist) AS new_dist FROM routes")
def _(s):
    return M.merge_routes(batch_routes(s)).select("batch_id", "route_id", "dist", "new_dist")


@query("j12_m7_rekey_trip_stops", f"WITH {STOP} SELECT l_orderkey, l_linenumber, new_id AS stop_id FROM items LEFT JOIN mp ON mp.batch_id = l_suppkey % 5 AND mp.stop_id = l_partkey")
def _(s):
    facts = s.items.select((C("l_suppkey") % 5).cast("int").alias("batch_id"), C("l_partkey").cast("int").alias("stop_id"), "l_orderkey", "l_linenumber")
    return M.rekey(facts, mapping(s), ["batch_id", "stop_id"], "new_id", "stop_id").select("l_orderkey", "l_linenumber", "stop_id")


@query("m7_merge_trip_groups", "SELECT batch_id, stop_id AS group_id, row_number() OVER (ORDER BY batch_id, stop_id) AS new_id FROM batches")
def _(s):
    return M.merge_trip_groups(s.batches.select("batch_id", C("stop_id").alias("group_id")))


@query("m8_resolve_route_overlaps")
def _(s):
    return M.resolve_route_overlaps(s.routes)


#: Routes as batches in order of their dates give them, the detours last, in any order: each day then has one rightful owner.
APART = "SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY CASE WHEN detour THEN 1 + o_orderkey % 1009 ELSE 0 END, o_orderkey) AS INT) AS dist, valid_from, valid_to, detour, days(CAST('1990-01-01' AS DATE), CAST(o_orderkey AS INT)) AS created FROM routes"


@query("m8_day_owners", f"""WITH apart AS ({APART}), d AS (SELECT *, CAST(unnest(generate_series(valid_from, valid_to, INTERVAL 1 DAY)) AS DATE) AS day FROM apart),
  o AS (SELECT route_id, day, arg_max(dist, (CAST(detour AS INT), created)) AS source_dist FROM d GROUP BY 1, 2)
  SELECT route_id, source_dist, count(*) AS days, min(day) AS first_day, max(day) AS last_day, CAST(sum(date_diff('day', DATE '1990-01-01', day)) AS BIGINT) AS day_sum FROM o GROUP BY 1, 2""")
def _(s):
    """Which variant has which days, counted from the pieces."""
    pieces = M.resolve_route_overlaps(s.sql(APART))
    days = pieces.select("route_id", "source_dist", F.explode(F.sequence("valid_from", "valid_to")).alias("day"))
    since = F.datediff("day", F.to_date(F.lit("1990-01-01")))
    return days.groupBy("route_id", "source_dist").agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum(since).alias("day_sum"))


@query("m8_follow_routes")
def _(s):
    return M.follow_routes(s.trips.select("route_id", "dist", "trip"), M.resolve_route_overlaps(s.routes))


@query("m9_version_row", "SELECT '1.11' AS version, max(CAST(o_orderdate AS DATE)) AS created FROM orders")
def _(s):
    return s.orders.agg(F.lit("1.11").alias("version"), F.max(F.to_date("o_orderdate")).alias("created"))
