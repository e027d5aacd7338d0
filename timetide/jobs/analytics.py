"""Queries of the delay analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from timetide.functions.lineage import shared_dir
from timetide.jobs.registry import query
from timetide.operators import analytics as A

D = F.to_date
LO, HI = "1996-01-01", "1998-12-31"

NAMED = """named AS (SELECT h.*, coalesce(v.name, a.name, h.stop_id) AS name FROM stop_history h
  LEFT JOIN stop_versions v ON v.id = h.stop_id AND h.trip_start_date >= v.valid_from AND h.trip_start_date < v.valid_to
  LEFT JOIN (SELECT id, arg_min(name, valid_from) AS name FROM stop_versions GROUP BY id) a ON a.id = h.stop_id)"""
SEQ = """seqs AS (SELECT trip_id, trip_start_date, string_agg(stop_id || ',' || coalesce(CAST(should_arrive AS STRING), '-') || ',' || CAST(should_depart AS STRING), ';' ORDER BY trip_stop_index) AS s FROM stop_history GROUP BY 1, 2),
  ssgs AS (SELECT *, min(trip_start_date) OVER (PARTITION BY trip_id, s) AS ssg FROM seqs)"""
CHART = """x AS (SELECT *, first_value(should_depart) OVER (PARTITION BY trip_id, trip_start_date ORDER BY trip_stop_index) AS t0,
    row_number() OVER (PARTITION BY trip_id, trip_start_date, should_arrive ORDER BY trip_stop_index) - 1 AS ka, row_number() OVER (PARTITION BY trip_id, trip_start_date, should_depart ORDER BY trip_stop_index) - 1 AS kd FROM stop_history),
  xs AS (SELECT *, should_arrive - t0 + 10 * ka AS x_arr, should_depart - t0 + 10 * kd + CASE WHEN should_arrive = should_depart THEN 1 ELSE 0 END AS x_dep FROM x),
  series AS (SELECT trip_id, trip_start_date, x_arr AS x, arrived - should_arrive AS delay FROM xs WHERE x_arr IS NOT NULL AND arrived IS NOT NULL
    UNION SELECT trip_id, trip_start_date, x_dep, departed - should_depart FROM xs)"""


@query("j6_valid_name_join", f"WITH {NAMED} SELECT trip_id, trip_start_date, trip_stop_index, stop_id, name FROM named")
def _(s):
    return A.named_stops(s.stop_history, s.stop_versions).select("trip_id", "trip_start_date", "trip_stop_index", "stop_id", "name")


@query("a1_delay_percentiles", f"""WITH {NAMED}, {SEQ} SELECT n.trip_id, g.ssg, trip_stop_index, stop_id, name, min(should_arrive) AS should_arrive, min(should_depart) AS should_depart,
  round(quantile_cont((arrived - should_arrive) / 60, 0.15), 4) AS arr_p15, round(quantile_cont((arrived - should_arrive) / 60, 0.5), 4) AS arr_p50, round(quantile_cont((arrived - should_arrive) / 60, 0.85), 4) AS arr_p85,
  round(quantile_cont((departed - should_depart) / 60, 0.15), 4) AS dep_p15, round(quantile_cont((departed - should_depart) / 60, 0.5), 4) AS dep_p50, round(quantile_cont((departed - should_depart) / 60, 0.85), 4) AS dep_p85
  FROM named n JOIN ssgs g ON g.trip_id = n.trip_id AND g.trip_start_date = n.trip_start_date GROUP BY ALL""")
def _(s):
    out = A.delay_percentiles(A.named_stops(s.stop_history, s.stop_versions))
    return out.select(*[F.round(c, 4).alias(c) if c[3:5] == "_p" else c for c in out.columns])


@query("a2_stop_sequence_groups", f"WITH {SEQ} SELECT trip_id, ssg, string_agg(CAST(trip_start_date AS STRING), ',' ORDER BY trip_start_date) AS dates, count(*) AS n FROM ssgs GROUP BY 1, 2")
def _(s):
    return A.sequence_groups(s.stop_history).withColumn("dates", F.array_join(F.col("dates").cast("array<string>"), ","))


@query("a3_same_sequence_dates", f"WITH {SEQ} SELECT trip_id, trip_start_date FROM seqs WHERE trip_id = 'T7' AND s = (SELECT s FROM seqs WHERE trip_id = 'T7' AND trip_start_date = (SELECT min(trip_start_date) FROM stop_history WHERE trip_id = 'T7'))")
def _(s):
    first = s.stop_history.where("trip_id = 'T7'").agg(F.min("trip_start_date")).first()[0]
    return A.same_sequence_dates(s.stop_history, "T7", F.lit(first))


@query("a4_route_summaries", """WITH latest AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY trip_start_date DESC, trip_id) AS rn FROM trip_details),
  named AS (SELECT h.*, coalesce(v.name, h.stop_id) AS name FROM stop_history h LEFT JOIN stop_versions v ON v.id = h.stop_id AND h.trip_start_date >= v.valid_from AND h.trip_start_date < v.valid_to),
  short AS (SELECT route_id, first(route_short_name ORDER BY trip_start_date DESC, route_short_name DESC) AS short FROM trip_details WHERE route_short_name IS NOT NULL GROUP BY 1),
  span AS (SELECT route_id, min(trip_start_date) AS first_date, max(trip_start_date) AS last_date FROM trip_details GROUP BY 1),
  ends AS (SELECT trip_id, trip_start_date, arg_min(name, trip_stop_index) AS first_stop, arg_max(name, trip_stop_index) AS last_stop FROM named GROUP BY 1, 2)
  SELECT l.route_id, coalesce(short, l.route_id) AS name, l.trip_id, l.trip_start_date, first_date, last_date, first_stop, last_stop
  FROM latest l JOIN span USING (route_id) LEFT JOIN short USING (route_id) LEFT JOIN ends e ON e.trip_id = l.trip_id AND e.trip_start_date = l.trip_start_date WHERE rn = 1""")
def _(s):
    return A.route_summaries(s.trip_details, s.stop_history, s.stop_versions)


@query("a5_route_occurrences", f"SELECT route_id, count(*) AS n FROM trip_details WHERE trip_start_date BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY 1")
def _(s):
    return A.route_occurrences(s.trip_details, D(F.lit(LO)), D(F.lit(HI)))


@query("j7_routes_calling_at", f"""WITH {NAMED} SELECT trip_id, trip_start_date, route_id FROM trip_details t WHERE trip_start_date BETWEEN DATE '{LO}' AND DATE '{HI}'
  AND EXISTS (SELECT 1 FROM named n WHERE n.trip_id = t.trip_id AND n.trip_start_date = t.trip_start_date AND lower(name) LIKE '%town 1%' AND departed > 25000)""")
def _(s):
    named = A.named_stops(s.stop_history, s.stop_versions)
    return A.routes_calling_at(s.trip_details, named, A.all_of(A.contains("name", "TOWN 1"), A.greater("departed", 25000)), D(F.lit(LO)), D(F.lit(HI))).select("trip_id", "trip_start_date", "route_id")


@query("p24_search_predicates", "SELECT trip_id, trip_start_date, short_name FROM trip_details WHERE lower(short_name) LIKE '%ip 1%' AND lower(route_id) = 'r1' AND trip_start_date < DATE '1999-01-01' AND NOT trip_id = 'T13'")
def _(s):
    import datetime

    wanted = A.all_of(A.contains("short_name", "IP 1"), A.equals("route_id", "r1"), A.less("trip_start_date", datetime.date(1999, 1, 1)), ~A.equals("trip_id", "t13"))
    return s.trip_details.where(wanted).select("trip_id", "trip_start_date", "short_name")


@query("p22_delays", """SELECT trip_id, trip_start_date, trip_stop_index, arrived - should_arrive AS arr_delay, departed - should_depart AS dep_delay,
  CASE WHEN should_arrive IS NOT NULL THEN lpad(CAST(should_arrive // 3600 % 24 AS STRING), 2, '0') || ':' || lpad(CAST(should_arrive // 60 % 60 AS STRING), 2, '0') END AS arr_text,
  lpad(CAST(should_depart // 3600 % 24 AS STRING), 2, '0') || ':' || lpad(CAST(should_depart // 60 % 60 AS STRING), 2, '0') AS dep_text FROM stop_history""")
def _(s):
    return A.delays(s.stop_history).select("trip_id", "trip_start_date", "trip_stop_index", "arr_delay", "dep_delay", "arr_text", "dep_text")


@query("w5_chart_x", f"WITH {CHART} SELECT trip_id, trip_start_date, trip_stop_index, x_arr, x_dep FROM xs")
def _(s):
    return A.chart_x(s.stop_history).select("trip_id", "trip_start_date", "trip_stop_index", "x_arr", "x_dep")


@query("u2_chart_series", f"WITH {CHART} SELECT * FROM series")
def _(s):
    return A.chart_series(s.stop_history)


@query("a18_series_json", f"""WITH {CHART} SELECT trip_id, trip_start_date, '[' || string_agg('{{"x":' || CAST(x AS STRING) || ',"delay":' || CAST(delay AS STRING) || '}}', ',' ORDER BY x, delay) || ']' AS points FROM series GROUP BY 1, 2""")
def _(s):
    return A.series_json(A.chart_series(s.stop_history))


@query("a15_delay_matrix", f"WITH {CHART} SELECT trip_id, trip_start_date, string_agg(CAST(delay AS STRING), ',' ORDER BY x, delay) AS delays FROM series GROUP BY 1, 2")
def _(s):
    return A.delay_matrix(A.chart_series(s.stop_history)).withColumn("delays", F.array_join(F.col("delays").cast("array<string>"), ","))


@query("w6_chart_labels", """WITH r AS (SELECT *, CASE WHEN should_arrive <> should_depart THEN should_depart - should_arrive END AS stay FROM stop_history),
  k AS (SELECT *, row_number() OVER (PARTITION BY trip_id, trip_start_date ORDER BY stay DESC NULLS LAST, trip_stop_index) AS place,
    min(trip_stop_index) OVER (PARTITION BY trip_id, trip_start_date) AS lo, max(trip_stop_index) OVER (PARTITION BY trip_id, trip_start_date) AS hi FROM r)
  SELECT trip_id, trip_start_date, trip_stop_index, stop_id FROM k WHERE trip_stop_index IN (lo, hi) OR (place <= 2 AND stay IS NOT NULL)""")
def _(s):
    return A.chart_labels(s.stop_history, top=2)


@query("a14_heatmap_points", f"WITH {CHART} SELECT CAST(floor(x / 300) AS INT) AS cx, CAST(floor(delay / 120) AS INT) AS cy, count(DISTINCT trip_id || '/' || CAST(trip_start_date AS STRING)) AS runs FROM series GROUP BY 1, 2")
def _(s):
    return A.heatmap_points(A.chart_series(s.stop_history), 300, 120)


RASTER = f"""{CHART}, box AS (SELECT min(x) AS x0, max(x) AS x1, min(delay) AS y0, max(delay) AS y1 FROM series),
  p AS (SELECT trip_id, trip_start_date, x, delay, CAST(x - x0 AS DOUBLE) / greatest(x1 - x0, 1) * 119 AS px, CAST(delay - y0 AS DOUBLE) / greatest(y1 - y0, 1) * 59 AS py FROM series, box),
  q AS (SELECT *, coalesce(lead(px) OVER w, px) AS qx, coalesce(lead(py) OVER w, py) AS qy FROM p WINDOW w AS (PARTITION BY trip_id, trip_start_date ORDER BY x, delay)),
  l AS (SELECT *, CAST(floor(2 * greatest(abs(qx - px), abs(qy - py))) AS INT) + 1 AS n FROM q), st AS (SELECT *, unnest(generate_series(0, n)) AS k FROM l),
  drawn AS (SELECT DISTINCT trip_id, trip_start_date, CAST(round_even(px + (qx - px) * k / n, 0) AS INT) AS cx, CAST(round_even(py + (qy - py) * k / n, 0) AS INT) AS cy FROM st)"""
CELLS = "SELECT cx, cy, count(*) AS runs, round(sin(CAST(count(*) AS DOUBLE) / max(count(*)) OVER () * pi() / 2), 6) AS alpha FROM drawn"


@query("a14_heatmap", f"WITH {RASTER} {CELLS} GROUP BY 1, 2")
def _(s):
    return A.heatmap(A.chart_series(s.stop_history)).withColumn("alpha", F.round("alpha", 6))


@query("a14_heatmap_chosen", f"WITH {RASTER} {CELLS} WHERE (trip_id, trip_start_date) IN (SELECT (trip_id, trip_start_date) FROM drawn WHERE cx = 30 AND cy = 30) GROUP BY 1, 2")
def _(s):
    return A.heatmap(A.chart_series(s.stop_history), chosen=(30, 30)).withColumn("alpha", F.round("alpha", 6))


@query("a16_duplicate_keys", "SELECT trip_id, trip_start_date, count(*) AS n FROM observations GROUP BY 1, 2 HAVING count(*) > 1")
def _(s):
    return A.duplicate_keys(s.observations, ["trip_id", "trip_start_date"])


@query("t1_list_routes", """WITH span AS (SELECT route_id, min(trip_start_date) AS first_date, max(trip_start_date) AS last_date FROM trip_details GROUP BY 1),
  short AS (SELECT route_id, first(route_short_name ORDER BY trip_start_date DESC, route_short_name DESC) AS short FROM trip_details WHERE route_short_name IS NOT NULL GROUP BY 1),
  s AS (SELECT route_id, coalesce(short, route_id) AS name, first_date, last_date FROM span LEFT JOIN short USING (route_id) WHERE last_date >= DATE '1996-01-01' AND first_date <= DATE '1998-12-31')
  SELECT route_id, name, (SELECT count(*) FROM s) AS total FROM s ORDER BY CAST(nullif(regexp_extract(name, '[0-9]+'), '') AS INT) NULLS LAST, name, route_id LIMIT 5 OFFSET 5""")
def _(s):
    summaries = A.route_summaries(s.trip_details, s.stop_history, s.stop_versions)
    return A.list_routes(summaries, D(F.lit(LO)), D(F.lit(HI)), page=2, size=5).select("route_id", "name", "total")


@query("t2_route_trips", f"""SELECT trip_id, coalesce(arg_max(short_name, trip_start_date), trip_id) AS name, string_agg(CAST(trip_start_date AS STRING), ',' ORDER BY trip_start_date) AS dates
  FROM trip_details WHERE route_id = 'R3' AND trip_start_date BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY trip_id""")
def _(s):
    return A.route_trips(s.trip_details, "R3", D(F.lit(LO)), D(F.lit(HI))).withColumn("dates", F.array_join(F.col("dates").cast("array<string>"), ","))


@query("t3_trip_run", f"WITH {NAMED} SELECT trip_stop_index, name, should_arrive, arrived, should_depart, departed, arrived - should_arrive AS arr_delay FROM named WHERE trip_id = 'T3' AND trip_start_date = (SELECT max(trip_start_date) FROM stop_history WHERE trip_id = 'T3')")
def _(s):
    last = s.stop_history.where("trip_id = 'T3'").agg(F.max("trip_start_date")).first()[0]
    return A.trip_run(A.named_stops(s.stop_history, s.stop_versions), "T3", F.lit(last)).select("trip_stop_index", "name", "should_arrive", "arrived", "should_depart", "departed", "arr_delay")


@query("snk3_export_rows", "SELECT trip_id, trip_start_date, trip_stop_index, arrived FROM stop_history WHERE trip_id LIKE 'T1_' AND trip_start_date BETWEEN DATE '1996-05-01' AND DATE '1996-07-31'")
def _(s):
    return A.export_rows(s.stop_history, "trip_id", "T1_", D(F.lit("1996-05-01")), D(F.lit("1996-07-31"))).select("trip_id", "trip_start_date", "trip_stop_index", "arrived")


@query("snk3_exported_csv", "SELECT trip_id, trip_start_date, trip_stop_index, stop_id, arrived FROM stop_history WHERE trip_id LIKE 'T1_' AND trip_start_date BETWEEN DATE '1996-05-01' AND DATE '1996-07-31'")
def _(s):
    """The rows as a reader of the exported files finds them."""
    path, columns = f"{shared_dir(s.spark)}/export-{uuid.uuid4().hex}", ["trip_id", "trip_start_date", "trip_stop_index", "stop_id", "arrived"]
    A.export_csv(A.export_rows(s.stop_history, "trip_id", "T1_", D(F.lit("1996-05-01")), D(F.lit("1996-07-31"))).select(*columns), path)
    return s.spark.read.schema("trip_id string, trip_start_date date, trip_stop_index int, stop_id string, arrived int").option("header", True).csv(path)
