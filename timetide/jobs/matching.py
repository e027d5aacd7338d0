"""Queries of name matching, repair and the coverage report."""

from __future__ import annotations

from pyspark.sql import functions as F

from timetide.functions import geo as G
from timetide.functions import text as T
from timetide.functions.lineage import shuffled
from timetide.jobs.registry import query
from timetide.operators import matching as M
from timetide.operators import repair as R

C = F.col
GROUPS = (("small", "little", "new"), ("red", "hot"), ("rod", "bolt"))
SYN = "syn AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, g in enumerate(GROUPS) for t in g) + ") t(g, token))"
#: Queries: part names shortened by their number; targets: supplier names with a token more for some.
Q = "q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS name FROM part), t AS (SELECT DISTINCT CASE WHEN id % 3 = 0 THEN name || ' depot' ELSE name END AS name FROM names)"
EXP = f"""{SYN}, {Q}, w AS (SELECT name, unnest(string_split(name, ' ')) AS token, generate_subscripts(string_split(name, ' '), 1) AS i FROM (SELECT name FROM q UNION SELECT name FROM t) u),
  forms AS (SELECT d.token, list_sort(list_distinct(list_concat([d.token], coalesce((SELECT list(s2.token) FROM syn s1 JOIN syn s2 USING (g) WHERE s1.token = d.token), [])))) AS f FROM (SELECT DISTINCT token FROM w) d),
  ex AS (SELECT name, list(token ORDER BY i) AS tokens, list(f ORDER BY i) AS forms, list_distinct(flatten(list(f ORDER BY i))) AS every FROM w JOIN forms USING (token) GROUP BY name),
  cand AS (SELECT a.name AS query, b.name AS target, len([x FOR x IN b.forms IF list_has_any(x, a.every)]) / len(b.forms) AS score, a.forms = b.forms AS exact
    FROM q JOIN ex a USING (name), t JOIN ex b USING (name) WHERE list_has_all(b.every, a.tokens))"""


def synonyms(s):
    return s.spark.createDataFrame([(i, t) for i, g in enumerate(GROUPS) for t in g], "group_id int, token string")


def part_names(s):
    return s.part.select(F.when(C("p_partkey") % 2 == 0, C("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name"), "p_partkey")


def targets(s):
    return s.names.select("id", F.when(C("id") % 3 == 0, F.concat("name", F.lit(" depot"))).otherwise(C("name")).alias("name"), "x", "y")


@query("x1_expand_synonyms", f"WITH {EXP} SELECT token, array_to_string(f, ',') AS forms FROM forms WHERE token IN (SELECT token FROM w WHERE name IN (SELECT name FROM q))")
def _(s):
    tokens = part_names(s).select(F.explode(T.name_tokens(C("name"))).alias("token"))
    return M.expansions(tokens, synonyms(s)).select("token", F.array_join("forms", ",").alias("forms"))


@query("j10_match_candidates", f"WITH {EXP} SELECT query, target FROM cand")
def _(s):
    return M.match_candidates(part_names(s), targets(s), synonyms(s)).select("query", "target")


@query("x2_name_similarity", f"WITH {EXP} SELECT query, target, round(score, 6) AS score FROM cand")
def _(s):
    return M.match_candidates(part_names(s), targets(s), synonyms(s)).select("query", "target", F.round("score", 6).alias("score"))


@query("x3_exact_name_match", f"WITH {EXP} SELECT query, target FROM cand WHERE exact")
def _(s):
    return M.match_candidates(part_names(s), targets(s), synonyms(s)).where("exact").select("query", "target")


@query("x4_match_stops_by_name", f"WITH {EXP} SELECT p.id AS stop, n.id, round(score, 6) AS score FROM names p JOIN cand ON query = CASE WHEN p.id % 2 = 0 THEN p.name ELSE split_part(p.name, ' ', 1) END JOIN (SELECT id, CASE WHEN id % 3 = 0 THEN name || ' depot' ELSE name END AS name FROM names) n ON n.name = target")
def _(s):
    stops = s.names.select(C("id").alias("stop"), F.when(C("id") % 2 == 0, C("name")).otherwise(F.split_part("name", F.lit(" "), F.lit(1))).alias("name"))
    return M.match_stops_by_name(stops, targets(s), synonyms(s)).select("stop", "id", F.round("score", 6).alias("score"))


MATCH = f"{EXP}, m AS (SELECT p.k, n.x, n.y, n.id FROM (SELECT min(p_partkey) AS k, p_name FROM part GROUP BY 2) p JOIN cand ON query = p.p_name JOIN (SELECT id, CASE WHEN id % 3 = 0 THEN name || ' depot' ELSE name END AS name, x, y FROM names) n ON n.name = target WHERE score = 1)"


def matches(s):
    stops = s.part.groupBy(C("p_name").alias("name")).agg(F.min("p_partkey").alias("k")).withColumn("region", F.lit(None).cast("string")).withColumn("country", F.lit(None).cast("string"))
    more = targets(s).withColumn("t_region", (C("id") % 2).cast("string")).withColumn("t_country", F.lit("CZ")).withColumn("precision", F.lit("S"))
    return M.exact_matches(M.match_stops_by_name(stops.join(part_names(s).select("name"), "name", "left_semi"), more, synonyms(s)))


@query("x5_exact_matches", f"WITH {MATCH} SELECT k, id FROM m WHERE k IN (SELECT min(p_partkey) FROM part WHERE p_name IN (SELECT name FROM q) GROUP BY p_name)")
def _(s):
    return matches(s).select("k", "id")


@query("a13_points_radius", "SELECT name, round(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 4) AS radius, round(any_value(cx), 4) AS cx FROM (SELECT *, avg(x) OVER (PARTITION BY name) AS cx, avg(y) OVER (PARTITION BY name) AS cy FROM names) z GROUP BY 1")
def _(s):
    return G.group_radius(s.names, ["name"]).select("name", F.round("radius", 4).alias("radius"), F.round("cx", 4).alias("cx"))


@query("x6_top_stop_match", "SELECT name, round(max(d), 4) AS radius FROM (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM (SELECT *, avg(x) OVER (PARTITION BY name) AS cx, avg(y) OVER (PARTITION BY name) AS cy FROM (SELECT name, x % 1200 AS x, y % 1200 AS y, id % 2 AS r FROM names) a) b) z GROUP BY 1 HAVING count(DISTINCT r) = 1 AND max(d) < 1000")
def _(s):
    rows = s.names.select("name", (C("x") % 1200).alias("x"), (C("y") % 1200).alias("y"), (C("id") % 2).cast("string").alias("t_region"), F.lit("CZ").alias("t_country"), F.lit("S").alias("precision"))
    return M.top_stop_match(rows, ["name"]).select("name", F.round("radius", 4).alias("radius"))


@query("j9_match_by_rail_code", "SELECT a.s_suppkey AS k, b.id FROM supplier a JOIN names b ON lpad(CAST(a.s_suppkey % 90 AS STRING), 5, '0') = lpad(CAST(b.id % 70 AS STRING), 5, '0')")
def _(s):
    stops = s.supplier.select(C("s_suppkey").alias("k"), (C("s_suppkey") % 90).cast("string").alias("sr70"))
    to = s.names.select(C("id").cast("string").alias("name"), "x", "y", (C("id") % 70).cast("string").alias("sr70"))
    return M.match_by_rail_code(stops, to).select("k", C("target").cast("long").alias("id"))


#: Forty towns of each type and brand; of some, only the domestic table or only the foreign one has the name.
TOWN = "p_type || ' ' || p_brand || ' ' || (p_partkey % 40)"
TOWNS = f"dom AS (SELECT CASE WHEN p_size % 2 = 0 THEN '' ELSE 'Old ' END || {TOWN} AS name, min(p_size) AS region FROM part GROUP BY 1), fgn AS (SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN '' ELSE 'Far ' END || {TOWN} AS name, CASE WHEN p_size % 3 = 0 THEN 'DE' ELSE 'PL' END AS country FROM part)"


def town_tables(s):
    town = F.concat("p_type", F.lit(" "), "p_brand", F.lit(" "), (C("p_partkey") % 40).cast("string"))
    named = lambda ok, other: F.concat(F.when(ok, "").otherwise(other), town).alias("name")
    home = s.part.groupBy(named(C("p_size") % 2 == 0, "Old ")).agg(F.min("p_size").alias("region"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    away = s.part.select(named(C("p_size") % 5 == 0, "Far "), F.when(C("p_size") % 3 == 0, "DE").otherwise("PL").alias("country"), F.lit(3.0).alias("x"), F.lit(4.0).alias("y")).distinct()
    stops = s.part.select("p_partkey", town.alias("town"), F.lit(None).cast("int").alias("region"), F.when(C("p_partkey") % 3 == 0, "CZ").alias("country"), F.lit(None).cast("string").alias("district"), F.lit(None).cast("string").alias("place"))
    return stops, home, away


@query("x7_conflicting_town", f"WITH {TOWNS} SELECT p_partkey FROM part WHERE {TOWN} IN (SELECT name FROM fgn)")
def _(s):
    stops, _, away = town_tables(s)
    return M.conflicting_town(stops, away, ["p_partkey"])


@query("x8_match_by_top_town", f"""WITH {TOWNS}, f AS (SELECT name, count(*) AS n, max(country) AS c, count(DISTINCT country) AS nc FROM fgn GROUP BY 1),
  j AS (SELECT p_partkey, dom.region, CASE WHEN p_partkey % 3 = 0 THEN 'CZ' END AS country, dom.name IS NOT NULL AS h, coalesce(n, 0) AS n, c, coalesce(nc, 0) AS nc FROM part LEFT JOIN dom ON dom.name = {TOWN} LEFT JOIN f ON f.name = {TOWN}),
  k AS (SELECT *, CASE WHEN h AND (country = 'CZ' OR n = 0) THEN 'home' WHEN country IS NULL AND NOT h AND nc = 1 THEN 'abroad' ELSE 'none' END AS rule FROM j)
  SELECT p_partkey, CASE WHEN rule = 'home' THEN region END AS region, CASE rule WHEN 'home' THEN 'CZ' WHEN 'abroad' THEN c ELSE country END AS country, rule FROM k""")
def _(s):
    stops, home, away = town_tables(s)
    return M.match_by_top_town(stops, home, away, ["p_partkey"]).select("p_partkey", "region", "country", "rule")


@query("x11_primary_matches", f"WITH {TOWNS} SELECT p_partkey FROM part WHERE {TOWN} NOT IN (SELECT name FROM fgn) AND {TOWN} NOT IN (SELECT name FROM dom)")
def _(s):
    stops, home, away = town_tables(s)
    return M.primary_matches(stops.select("p_partkey"), stops, away, home, ["p_partkey"])


@query("p20_missing_region_report", "SELECT b.batch_id, b.stop_id, CASE WHEN EXISTS (SELECT 1 FROM items i WHERE i.l_suppkey % 5 = b.batch_id AND i.l_partkey = b.stop_id AND i.l_returnflag = 'R') THEN 'warning' ELSE 'debug' END AS level FROM batches b WHERE country IS NULL OR size % 2 = 0")
def _(s):
    stops = s.batches.withColumn("region", F.when(C("size") % 2 != 0, "PH"))
    used = s.items.where("l_returnflag = 'R'").select((C("l_suppkey") % 5).cast("int").alias("batch_id"), C("l_partkey").cast("int").alias("stop_id"), F.lit("time").alias("dep_kind"), F.lit(None).cast("int").alias("arr_sec"))
    return R.missing_region_report(stops, used, ["batch_id", "stop_id"])


@query("a12_urban_naming_batches", "SELECT batch_id FROM (SELECT CAST(floor(stop_id / 2) AS BIGINT) AS batch_id, place FROM batches) x GROUP BY 1 HAVING bool_and(place IS NULL)")
def _(s):
    rows = s.batches.select(F.floor(C("stop_id") / 2).alias("batch_id"), F.lit(None).cast("string").alias("district"), "place")
    return R.urban_naming_batches(rows)


PATTERNS = """tp AS (SELECT trip % 9 AS line, trip, route_stop_id AS pos, stop_id, metres FROM trip_stops), pr AS (SELECT line, trip, string_agg(pos || ':' || metres, ',' ORDER BY pos, metres, stop_id) AS p FROM tp GROUP BY 1, 2), pk AS (SELECT line, min(trip) AS pattern FROM pr GROUP BY line, p)"""


def line_stops(s):
    return s.trip_stops.select((C("trip") % 9).alias("line"), "trip", C("route_stop_id").alias("pos"), "stop_id", "metres")


@query("x9_trip_patterns", f"WITH {PATTERNS} SELECT pk.line, pattern, pos, stop_id, metres FROM pk JOIN tp ON tp.line = pk.line AND tp.trip = pattern")
def _(s):
    return R.trip_patterns(line_stops(s), ["line"], "trip")


@query("w3_last_known_position", "SELECT trip, pos, last_value(CASE WHEN x IS NOT NULL THEN metres END IGNORE NULLS) OVER (PARTITION BY trip ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_metres FROM (SELECT trip, route_stop_id AS pos, metres, CASE WHEN stop_id % 3 > 0 THEN stop_id END AS x FROM trip_stops) z")
def _(s):
    rows = s.trip_stops.select("trip", C("route_stop_id").alias("pos"), "metres", F.when(C("stop_id") % 3 > 0, C("stop_id") * 100.0).alias("x"), F.lit(0.0).alias("y"))
    return R.last_known_position(rows, ["trip"]).select("trip", "pos", C("last.metres").alias("last_metres"))


@query("x10_secondary_matches")
def _(s):
    patterns = R.trip_patterns(line_stops(s), ["line"], "trip").withColumn("x", F.when(C("stop_id") % 3 > 0, C("stop_id") * 1000.0)).withColumn("y", F.lit(0.0))
    found = s.names.select((C("id") % 60).cast("int").alias("stop_id"), ((C("id") % 60) * 1000.0 + C("x") % 700).alias("x"), F.lit(0.0).alias("y"), F.lit("S").alias("precision"), F.lit("PH").alias("t_region"), F.lit("CZ").alias("t_country"))
    return R.secondary_matches(patterns, patterns.select("line", "stop_id").distinct().join(found, "stop_id"), ["line"])


@query("w4_fill_regions", """WITH l AS (SELECT trip, route_stop_id AS pos, CASE WHEN part % 7 = 0 THEN 'R' || part % 3 END AS region, CASE WHEN part % 7 = 0 THEN 'CZ' WHEN part % 11 = 0 THEN 'SK' END AS country FROM trip_stops),
  c AS (SELECT *, last_value(country IGNORE NULLS) OVER (PARTITION BY trip ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fc FROM l), d AS (SELECT *, lag(fc) OVER (PARTITION BY trip ORDER BY pos) AS pc FROM c),
  e AS (SELECT *, CASE WHEN region IS NOT NULL THEN region WHEN country IS NOT NULL AND country IS DISTINCT FROM pc THEN '' END AS ev FROM d)
  SELECT trip, pos, fc AS country, coalesce(region, nullif(last_value(ev IGNORE NULLS) OVER (PARTITION BY trip ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')) AS region FROM e""")
def _(s):
    line = s.trip_stops.select("trip", C("route_stop_id").alias("pos"), F.when(C("part") % 7 == 0, F.concat(F.lit("R"), (C("part") % 3).cast("string"))).alias("region"), F.when(C("part") % 7 == 0, "CZ").when(C("part") % 11 == 0, "SK").alias("country"))
    return R.fill_regions(line, ["trip"]).select("trip", "pos", "country", "region")


@query("x12_revert_far_regions", "SELECT batch_id, stop_id, CASE WHEN size > 20 THEN NULL ELSE 'PH' END AS region FROM batches")
def _(s):
    filled = s.batches.select("batch_id", "stop_id", F.lit("PH").alias("region"), F.lit(None).cast("string").alias("old_region"))
    ways = s.batches.select("batch_id", "stop_id", C("size").alias("way"), F.lit(20).alias("edge"))
    return R.revert_far_regions(filled, ways, ["batch_id", "stop_id"]).select("batch_id", "stop_id", "region")


@query("w9_distance_warnings", """WITH p AS (SELECT trip, route_stop_id AS pos, metres, CASE WHEN stop_id % 3 > 0 THEN stop_id * 3000.0 END AS x, CASE WHEN part % 2 = 0 THEN 4000 ELSE 20000 END AS slack FROM trip_stops),
  l AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN x END IGNORE NULLS) OVER w AS lx, last_value(CASE WHEN x IS NOT NULL THEN metres END IGNORE NULLS) OVER w AS lm FROM p WINDOW w AS (PARTITION BY trip ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT trip, pos, round(abs(x - lx), 3) AS distance FROM l WHERE abs(x - lx) > (abs(metres - lm) + slack) * 2""")
def _(s):
    rows = s.trip_stops.select("trip", C("route_stop_id").alias("pos"), "stop_id", "metres", F.when(C("stop_id") % 3 > 0, C("stop_id") * 3000.0).alias("x"), F.lit(0.0).alias("y"), F.when(C("part") % 2 == 0, "S").otherwise("T").alias("precision"))
    return R.distance_warnings(rows, ["trip"]).select("trip", "pos", F.round("distance", 3).alias("distance"))


VOTES = "v AS (SELECT DISTINCT batch_id, stop_id, town || ' ' || size % 4 AS town FROM batches), c AS (SELECT batch_id, town, count(*) AS n FROM v GROUP BY 1, 2 HAVING count(*) > 1), s AS (SELECT batch_id, town, n + CASE WHEN town LIKE '%2' THEN 2 ELSE 0 END AS votes FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY votes DESC, town) AS rank FROM s)"


def voted(s):
    votes = s.batches.select("batch_id", "stop_id", F.concat("town", F.lit(" "), (C("size") % 4).cast("string")).alias("town"))
    return votes, R.town_candidates(votes, votes.where("town like '%2'").select("batch_id", "town"))


@query("a11_town_candidates", f"WITH {VOTES} SELECT batch_id, town, votes, rank FROM r")
def _(s):
    return voted(s)[1]


@query("x13_urban_names", f"WITH {VOTES} SELECT b.batch_id, b.stop_id, r.town, b.town AS district, b.district AS place, rank FROM batches b JOIN r USING (batch_id) WHERE rank <= 2")
def _(s):
    stops = s.batches.select("batch_id", "stop_id", F.concat("town", F.lit(", "), "district").alias("town"), F.lit(None).cast("string").alias("region"), "country")
    return R.urban_names(stops, voted(s)[1].where("rank <= 2")).select("batch_id", "stop_id", "town", "district", "place", "rank")


@query("x14_choose_naming", "SELECT b AS batch_id, count(*) FILTER (WHERE size % 2 = 0) > count(*) FILTER (WHERE size % 3 = 0) + 1 AS urban FROM (SELECT stop_id % 40 AS b, size FROM batches WHERE size % 2 = 0 OR size % 3 = 0) x GROUP BY 1")
def _(s):
    rows = s.batches.select((C("stop_id") % 40).alias("batch_id"), F.concat_ws("/", C("batch_id").cast("string"), C("stop_id").cast("string")).alias("stop_id"), "size")
    return R.choose_naming(rows.where("size % 3 = 0"), rows.where("size % 2 = 0"))


#: The projection written out: authalic latitude, then the equal-area plane around the centre.
LAEA = f"""p AS (SELECT id, 48 + x / 1000.0 AS lat, 12 + y / 1000.0 AS lon FROM names), s AS (SELECT *, sin(radians(lat)) AS s, radians(lon) - {G.LON0!r} AS dl FROM p),
  b AS (SELECT *, asin(least(1.0, {1 - G.E2!r} * (s / (1 - {G.E2!r} * s * s) - ln((1 - {G.E!r} * s) / (1 + {G.E!r} * s)) / {2 * G.E!r}) / {G.QP!r})) AS beta FROM s),
  k AS (SELECT *, {G.RQ!r} * sqrt(2 / (1 + sin({G.BETA0!r}) * sin(beta) + cos({G.BETA0!r}) * cos(beta) * cos(dl))) AS k FROM b)"""


@query("p23_project_laea", f"WITH {LAEA} SELECT id, round({G.X0} + k * {G.D!r} * cos(beta) * sin(dl), 2) AS x, round({G.Y0} + k / {G.D!r} * (cos({G.BETA0!r}) * sin(beta) - sin({G.BETA0!r}) * cos(beta) * cos(dl)), 2) AS y, CAST(0 AS DOUBLE) AS lat_error, CAST(0 AS DOUBLE) AS lon_error FROM k")
def _(s):
    points = s.names.select("id", (48 + C("x") / 1000).alias("lat"), (12 + C("y") / 1000).alias("lon"))
    x, y = G.project(C("lat"), C("lon"))
    lat, lon = G.unproject(x, y)
    return points.select("id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), (F.round(lat - C("lat"), 8) + 0.0).alias("lat_error"), (F.round(lon - C("lon"), 8) + 0.0).alias("lon_error"))


@query("j11_town_by_point", "SELECT c_custkey, CASE WHEN x < 25 AND y < 1 THEN 'NATION_' || CAST(floor(x) AS INT) END AS name FROM (SELECT c_custkey, c_custkey % 3000 / 100.0 + 0.005 AS x, (c_custkey % 13) / 10.0 + 0.03 AS y FROM customer) z")
def _(s):
    n = C("n_nationkey").cast("double")
    corner = lambda dx, dy: F.struct((n + dx).alias("x"), F.lit(float(dy)).alias("y"))
    squares = s.nation.select(C("n_name").alias("name"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    points = s.customer.select("c_custkey", (C("c_custkey") % 3000 / 100.0 + 0.005).alias("x"), (C("c_custkey") % 13 / 10.0 + 0.03).alias("y"))
    return G.towns_of_points(points, squares, ["c_custkey"], 0.5).select("c_custkey", "name")


#: A diamond around the middle of each nation's square, with a corner cut off, and points around them.
DIAMONDS = """p AS (SELECT c_custkey, c_custkey % 3000 / 100.0 + 0.005 AS x, (c_custkey % 131) / 100.0 - 0.1512 AS y FROM customer)"""


@query("j11_town_by_point_in_diamonds", f"WITH {DIAMONDS} SELECT c_custkey, 'NATION_' || CAST(floor(x) AS INT) AS name FROM p WHERE x < 25 AND abs(x - floor(x) - 0.5) + abs(y - 0.5) < 0.5 AND y < 0.8")
def _(s):
    n = C("n_nationkey").cast("double")
    corner = lambda dx, dy: F.struct((n + dx).alias("x"), F.lit(float(dy)).alias("y"))
    diamonds = s.nation.select(C("n_name").alias("name"), F.array(corner(0.5, 0), corner(1, 0.5), corner(0.7, 0.8), corner(0.3, 0.8), corner(0, 0.5)).alias("ring"))
    points = s.customer.select("c_custkey", (C("c_custkey") % 3000 / 100.0 + 0.005).alias("x"), (C("c_custkey") % 131 / 100.0 - 0.1512).alias("y"))
    return G.towns_of_points(points, diamonds, ["c_custkey"], 0.07).where("name is not null").select("c_custkey", "name")


@query("x12_towns_within_reach", """WITH a AS (SELECT 'R' || n_regionkey AS town, n_nationkey % 3 AS region, n_nationkey * 10000.0 AS x0 FROM nation),
  o AS (SELECT c_custkey, 'R' || c_custkey % 5 AS town, c_custkey % 250 * 1000.0 AS x, c_custkey % 13 * 700.0 - 3000 AS y, c_custkey % 40 * 500 AS way FROM customer),
  d AS (SELECT c_custkey, region, way, greatest(x0 - x, x - x0 - 4000, 0) AS dx, greatest(0 - y, y - 2000, 0) AS dy FROM o JOIN a USING (town))
  SELECT c_custkey, max(region) AS t_region FROM d WHERE sqrt(dx * dx + dy * dy) < way + 1000 GROUP BY 1 HAVING count(DISTINCT region) = 1""")
def _(s):
    """Towns that share a name, as rectangles; stops some way along a line from a known position."""
    x0 = C("n_nationkey") * 10_000.0
    corner = lambda dx, dy: F.struct((x0 + dx).alias("x"), F.lit(float(dy)).alias("y"))
    areas = s.nation.select(F.concat(F.lit("R"), C("n_regionkey").cast("string")).alias("name"), (C("n_nationkey") % 3).alias("region"), F.array(corner(0, 0), corner(4000, 0), corner(4000, 2000), corner(0, 2000)).alias("ring"))
    k = C("c_custkey")
    stops = s.customer.select("c_custkey", F.concat(F.lit("R"), (k % 5).cast("string")).alias("town"), (k % 250 * 1000.0).alias("x"), (k % 13 * 700.0 - 3000).alias("y"), (k % 40 * 500).alias("way"))
    return R.towns_within_reach(stops, areas, ["c_custkey"])


@query("x12_boundary_distance", "SELECT c_custkey, c_nationkey, round(least(x - c_nationkey, c_nationkey + 1 - x, y, 1 - y), 9) AS edge FROM (SELECT c_custkey, c_nationkey, c_nationkey + (c_custkey % 97 + 1) / 128.0 AS x, (c_custkey % 89 + 2) / 128.0 AS y FROM customer) p")
def _(s):
    """How far each point inside a square lies from its edge."""
    n = C("n_nationkey").cast("double")
    corner = lambda dx, dy: F.struct((n + dx).alias("x"), F.lit(float(dy)).alias("y"))
    squares = s.nation.select(C("n_nationkey").alias("c_nationkey"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    points = s.customer.select("c_custkey", "c_nationkey", (C("c_nationkey") + (C("c_custkey") % 97 + 1) / 128.0).cast("double").alias("x"), ((C("c_custkey") % 89 + 2) / 128.0).cast("double").alias("y"))
    return points.join(G.boundary_distances(points, squares, "c_nationkey"), ["x", "y", "c_nationkey"]).select("c_custkey", "c_nationkey", F.round("edge", 9).alias("edge"))


@query("x16_map_stop_full_name", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'official' WHEN p_size % 4 = 1 THEN p_name WHEN p_size % 4 = 2 THEN p_name ELSE p_type || ',' || p_name END AS name FROM part")
def _(s):
    k = C("p_size") % 4
    return s.part.select("p_partkey", M.full_name(F.when(k == 0, "official"), C("p_name"), F.when(k != 1, C("p_type")), F.when(k == 2, 1.0).otherwise(0.5)).alias("name"))


NODES = "nd AS (SELECT p_partkey AS id, p_name AS name, p_size % 7 AS k FROM part)"


def nodes(s):
    k = C("p_size") % 7
    pair = lambda *kv: F.map_from_arrays(F.array(*[F.lit(x) for x in kv[::2]]), F.array(*[F.lit(x) for x in kv[1::2]]))
    base = F.when(k == 0, pair("railway", "station")).when(k == 1, pair("railway", "halt", "railway:ref", "12")).when(k == 2, pair("highway", "bus_stop")).when(k == 3, pair("railway", "tram_stop", "tram", "yes")).when(k == 4, pair("railway", "station", "station", "subway")).when(k == 5, pair("public_transport", "platform", "train", "yes")).otherwise(pair("amenity", "bench"))
    return s.part.select(C("p_partkey").alias("id"), F.map_concat(base, F.map_from_arrays(F.array(F.lit("name")), F.array("p_name"))).alias("tags"), F.lit(50.0).alias("lat"), F.lit(14.0).alias("lon"))


@query("src12_map_rail_stops", f"WITH {NODES} SELECT id, name, CASE WHEN k = 1 THEN '12' END AS sr70 FROM nd WHERE k IN (0, 1)")
def _(s):
    return M.map_nodes(nodes(s), rail=True).select("id", "name", "sr70")


@query("src12_map_other_stops", f"WITH {NODES} SELECT id, name FROM nd WHERE k IN (2, 3)")
def _(s):
    return M.map_nodes(nodes(s), rail=False).select("id", "name")


@query("t4_top_priority", "SELECT id, name, priority FROM (SELECT id, name, x % 4 AS priority, min(x % 4) OVER (PARTITION BY name) AS best FROM names) z WHERE priority = best")
def _(s):
    return M.top_priority(s.names.select("id", "name", (C("x") % 4).alias("priority")), ["name"])


@query("a10_match_summary", "SELECT 'type ' || x % 5 AS match_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM names), 4) AS percent FROM names GROUP BY 1")
def _(s):
    return M.match_summary(s.names.select(F.concat(F.lit("type "), (C("x") % 5).cast("string")).alias("match_type"))).withColumn("percent", F.round("percent", 4))


def report_tables(s):
    stops = s.names.select(C("id").alias("stop_id"), "name", F.when(C("id") % 4 == 0, (C("id") % 70).cast("string")).alias("sr70"))
    to = targets(s).withColumn("kind", F.when(C("id") % 2 == 0, "map").otherwise("ext")).withColumn("sr70", F.when(C("id") % 5 == 0, (C("id") % 70).cast("string"))).drop("id")
    return stops, to, synonyms(s)


@query("x17_coverage_report")
def _(s):
    return M.coverage_report(*report_tables(s)).withColumn("score", F.round("score", 6))


@query("t5_report_page")
def _(s):
    return M.coverage_page(*report_tables(s), text="o", perfect=True, sort="radius", size=20).withColumn("radius", F.round("radius", 4))


@query("a17_jdf_stop_names", "SELECT DISTINCT town || ',' || district || ',' || coalesce(place, '') AS name FROM batches")
def _(s):
    return M.stop_names(s.batches, home_only=True)


@query("u3_names_over_batches", "SELECT DISTINCT town || ',' || district || ',' || coalesce(place, '') AS name FROM batches")
def _(s):
    return M.stop_names(s.batches)


@query("u4_unmatched_stops", f"WITH {TOWNS} SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM fgn WHERE name = {TOWN})")
def _(s):
    stops, _, away = town_tables(s)
    return stops.select("p_partkey").join(M.conflicting_town(stops, away, ["p_partkey"]), "p_partkey", "left_anti")


def repaired(s):
    none = F.lit(None).cast("string")
    stops = s.batches.select("batch_id", "stop_id", "town", "district", "place", none.alias("region"), none.alias("country"))
    rows = s.items.select((C("l_suppkey") % 5).cast("int").alias("batch_id"), C("l_orderkey").alias("trip"), (C("l_orderkey") % 2 + 1).alias("direction"), C("l_linenumber").alias("pos"), C("l_partkey").cast("int").alias("stop_id"), (C("l_linenumber") * 3500).alias("metres"), F.lit("time").alias("dep_kind"), F.lit(None).cast("int").alias("arr_sec"))
    name = T.matching_name(C("town"), C("district"), C("place")).alias("name")
    known = s.batches.where("size > 25").select(name, (C("size") * 100.0).alias("x"), (C("size") * 50.0).alias("y"), F.lit("PH").alias("t_region"), F.lit("CZ").alias("t_country"), F.lit("S").alias("precision")).distinct()
    towns = s.batches.where("size between 11 and 20").groupBy(C("town").alias("name")).agg(F.lit("JM").alias("region"), F.min(C("size") * 100.0).alias("x"), F.min(C("size") * 50.0).alias("y"))
    foreign = s.nation.select(C("n_name").alias("name"), F.lit("DE").alias("country"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    routes = s.batches.groupBy("batch_id").agg(F.concat(F.lit("MHD "), F.min("town"), F.lit(" linka 1")).alias("name"))
    return R.fix_jdf(stops, rows, routes, known, towns, foreign, synonyms(s))


@query("x15_fix_jdf")
def _(s):
    out = repaired(s)
    return out["stops"].join(shuffled(out["locations"]), ["batch_id", "stop_id"], "left").withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query("x15_fix_jdf_primary", """WITH n AS (SELECT batch_id, stop_id, town || ',' || district || ',' || coalesce(place, '') AS name, town, size FROM batches), k AS (SELECT DISTINCT name, size * 100.0 AS x, size * 50.0 AS y FROM n WHERE size > 25),
  r AS (SELECT name, max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS radius FROM (SELECT *, avg(x) OVER (PARTITION BY name) AS cx, avg(y) OVER (PARTITION BY name) AS cy FROM k) z GROUP BY 1)
  SELECT batch_id, stop_id, 'PH' AS region FROM n JOIN r USING (name) WHERE radius < 1000""")
def _(s):
    """Stops whose name's targets lie together: all of them are placed and take the targets' region."""
    out = repaired(s)
    known = s.batches.where("size > 25").select(T.matching_name(C("town"), C("district"), C("place")).alias("name"), (C("size") * 100.0).alias("x"), (C("size") * 50.0).alias("y")).distinct()
    own = G.group_radius(known, ["name"]).where("radius < 1000").select("name")
    placed = out["stops"].join(shuffled(out["locations"]), ["batch_id", "stop_id"], "left_semi")
    return placed.withColumn("name", T.matching_name(C("town"), C("district"), C("place"))).join(own, "name", "left_semi").select("batch_id", "stop_id", "region")
