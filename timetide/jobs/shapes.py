"""Transport-shaped tables derived from the star-schema test tables, in SQL that Spark and DuckDB both run.

Every shape is a SELECT over other shapes and base tables. A Shapes object gives them as DataFrames;
with_shapes() puts them before an oracle query as common table expressions. Integer arithmetic only,
total orders everywhere, so that both engines agree.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from timetide.functions.lineage import cut

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: days(d, n): a date n days on; secs(t, n): a timestamp n seconds on. They differ between the dialects.
SHAPES = {
    "items": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS qty, l_returnflag FROM (
            SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) x
        WHERE rn = 1""",
    "runs": """
        SELECT 'T' || CAST(c AS STRING) AS trip_id, c, d AS trip_start_date, min(o_orderkey) AS o_orderkey, CAST(min(o_orderkey) % 3 AS INT) AS variant
        FROM (SELECT CAST(o_custkey % 40 AS INT) AS c, CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders) x GROUP BY c, d""",
    "stop_history": """
        SELECT trip_id, trip_start_date, trip_stop_index, 'S' || CAST((c * 7 + trip_stop_index) % 60 AS STRING) AS stop_id,
            CASE WHEN flag <> 'R' THEN plan_arr + qty * 20 - 200 END AS arrived, CASE WHEN trip_stop_index > 1 THEN plan_arr END AS should_arrive,
            plan_arr + part % 600 AS departed, plan_arr + (trip_stop_index % 3) * 60 AS should_depart, part % 7 <> 0 AS stopped
        FROM (SELECT r.trip_id, r.c, r.trip_start_date, CAST(i.l_linenumber AS INT) AS trip_stop_index, 21600 + i.l_linenumber * 600 + r.variant * 60 AS plan_arr,
                i.qty, CAST(i.l_partkey AS INT) AS part, i.l_returnflag AS flag FROM runs r JOIN items i ON i.l_orderkey = r.o_orderkey) x""",
    "trip_details": """
        SELECT trip_id, trip_start_date, 'R' || CAST(c % 12 AS STRING) AS route_id,
            CASE WHEN o_orderkey % 11 <> 0 THEN 'trip ' || CAST(c AS STRING) END AS short_name,
            CASE WHEN c % 12 <> 5 THEN 'Line ' || CAST(c % 12 * 3 + o_orderkey % 2 AS STRING) END AS route_short_name FROM runs""",
    "stop_versions": """
        SELECT 'S' || CAST(n AS STRING) AS id, CAST('1995-01-01' AS DATE) AS valid_from, CAST('1998-06-01' AS DATE) AS valid_to, 'Old town ' || CAST(n AS STRING) AS name, n FROM (SELECT DISTINCT CAST(s_suppkey % 57 AS INT) AS n FROM supplier) x
        UNION ALL
        SELECT 'S' || CAST(n AS STRING), CAST('1998-06-01' AS DATE), CAST('2000-01-01' AS DATE), 'New town ' || CAST(n - n % 4 AS STRING), n FROM (SELECT DISTINCT CAST(s_suppkey % 57 AS INT) AS n FROM supplier) x WHERE n % 2 = 0""",
    "observations": """
        SELECT r.trip_id, r.trip_start_date, CAST(i.l_linenumber AS INT) AS trip_stop_index, 'S' || CAST(i.l_suppkey % 60 AS STRING) AS stop_id, i.qty AS arrived, i.l_orderkey AS seq,
            'R' || CAST(i.l_orderkey % 12 AS STRING) AS route_id, 'n' || CAST(i.l_orderkey % 5 AS STRING) AS short_name, 'Line ' || CAST(i.l_orderkey % 9 AS STRING) AS route_short_name
        FROM (SELECT 'T' || CAST(o_custkey % 40 AS STRING) AS trip_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS trip_start_date, o_orderkey FROM orders) r
        JOIN items i ON i.l_orderkey = r.o_orderkey""",
    "coords": """
        SELECT 'U' || CAST(user_id AS STRING) AS trip_id, CAST(ts AS DATE) AS trip_start_date, date_trunc('hour', ts) AS observation_time,
            event_id % 1000 AS lat, event_id % 777 AS lon, event_id AS seq FROM events""",
    "stop_days": """
        SELECT id, day, name, lat, lon FROM (
            SELECT 'E' || CAST(user_id % 50 AS STRING) AS id, CAST(ts AS DATE) AS day, 'name ' || CAST(user_id % 50 % 7 AS STRING) AS name,
                CASE WHEN user_id % 50 <> 3 THEN (CASE WHEN day(CAST(ts AS DATE)) >= 15 THEN 1 ELSE 0 END) + user_id % 50 END AS lat, CASE WHEN user_id % 50 <> 3 THEN user_id % 50 * 2 END AS lon,
                row_number() OVER (PARTITION BY user_id % 50, CAST(ts AS DATE) ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1""",
    "snapshots": """
        SELECT train, snapshot_no, last_point, staying, planned, measured FROM (
            SELECT 'U' || CAST(user_id AS STRING) AS train, CAST((day(CAST(ts AS DATE)) - 1) * 4 + (hour(ts) - hour(ts) % 6) / 6 AS INT) AS snapshot_no, event_type AS last_point, event_id % 2 = 0 AS staying,
                CAST(event_id * 37 % 1440 * 60 AS INT) AS planned, CAST(event_id * 41 % 1440 * 60 AS INT) AS measured,
                row_number() OVER (PARTITION BY user_id, day(CAST(ts AS DATE)), hour(ts) - hour(ts) % 6 ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1""",
    "bare_times": """
        SELECT trip, CAST(pos AS INT) AS pos, CASE WHEN event_id % 6 <> 0 THEN CAST(event_id * 37 % 1440 * 60 AS INT) END AS time_sec, 2 AS fixed_pos, CAST('2024-02-10' AS DATE) AS clock_date, CAST(event_id0 * 53 % 1440 * 60 AS INT) AS clock_sec FROM (
            SELECT 'U' || CAST(user_id AS STRING) || '/' || CAST(day(CAST(ts AS DATE)) AS STRING) AS trip, event_id,
                row_number() OVER (PARTITION BY user_id, day(CAST(ts AS DATE)) ORDER BY event_id) AS pos,
                min(event_id) OVER (PARTITION BY user_id, day(CAST(ts AS DATE))) AS event_id0 FROM events) x""",
    "routes": """
        SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY o_orderkey) AS INT) AS dist, d AS valid_from, days(d, CAST(CASE WHEN o_orderkey % 1009 = 5 THEN 1700 ELSE 13 + 7 * (o_orderkey % 3) END AS INT)) AS valid_to,
            o_orderkey % 5 = 0 AS detour, days(d, CAST(o_orderkey % 40 AS INT)) AS created, o_orderkey
        FROM (SELECT CAST(o_custkey % 200 AS INT) AS route_id, CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders) x""",
    "trips": """
        SELECT r.route_id, r.dist, CAST(i.l_linenumber AS INT) AS trip, r.valid_from, r.valid_to, i.l_partkey AS part, i.l_suppkey AS supp, i.qty,
            CASE i.l_partkey % 12 WHEN 0 THEN 'X' WHEN 1 THEN '+' WHEN 2 THEN 'X,+' WHEN 3 THEN '1,2,3' WHEN 4 THEN '6' WHEN 5 THEN '7,@' WHEN 6 THEN '{' WHEN 7 THEN '5,X' WHEN 8 THEN 'O' WHEN 9 THEN '+,6' WHEN 10 THEN '' ELSE '4' END AS codes
        FROM routes r JOIN items i ON i.l_orderkey = r.o_orderkey""",
    "notes": """
        SELECT route_id, dist, trip, CASE WHEN supp % 9 <> 0 AND supp % 4 <> 1 THEN CAST(supp % 9 AS INT) END AS note_type,
            CASE WHEN part % 5 <> 0 THEN days(valid_from, qty % 20) END AS date_from, CASE WHEN part % 5 <> 0 AND part % 3 <> 0 THEN days(valid_from, qty % 20 + qty % 5) END AS date_to
        FROM trips""",
    "trip_stops": """
        SELECT l_orderkey AS trip, CAST(l_linenumber AS INT) AS route_stop_id, CAST(l_suppkey % 60 AS INT) AS stop_id, CAST(l_linenumber * 3500 AS INT) AS metres,
            CASE WHEN l_returnflag = 'R' AND l_linenumber IN (2, 4) THEN 'pass' WHEN l_partkey % 17 <> 0 THEN 'time' END AS dep_kind,
            CASE WHEN NOT (l_returnflag = 'R' AND l_linenumber IN (2, 4)) AND l_partkey % 17 <> 0 THEN CAST(60 * ((l_orderkey * 97 + l_linenumber * 211 + l_partkey % 4) % 1440) AS INT) END AS dep_sec,
            CASE WHEN l_partkey % 17 <> 0 AND l_partkey % 3 = 0 AND NOT (l_returnflag = 'R' AND l_linenumber IN (2, 4)) THEN CAST(60 * ((l_orderkey * 97 + l_linenumber * 211) % 1440) AS INT) END AS arr_sec,
            l_partkey AS part, l_suppkey AS supp FROM items""",
    "bitmaps": """
        SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS start, o_orderkey * 2654435 % 1048576 AS bits, CAST(o_orderkey % 3 - 1 AS INT) AS offset_days, o_orderkey % 7 = 0 AS cancelled FROM orders""",
    "batches": """
        SELECT CAST(i.l_suppkey % 5 AS INT) AS batch_id, CAST(i.l_partkey AS INT) AS stop_id, min(p.p_type) AS town, min(p.p_brand) AS district,
            min(CASE WHEN p.p_size % 3 = 0 THEN 'place ' || CAST(p.p_size AS STRING) END) AS place, min(CASE WHEN i.l_partkey % 2 = 0 THEN 'CZ' END) AS country,
            min(CAST(p.p_size AS INT)) AS size FROM items i JOIN part p ON p.p_partkey = i.l_partkey GROUP BY 1, 2""",
    "locations": """
        SELECT l_orderkey AS train, CAST(l_linenumber AS INT) AS pos, CAST(l_suppkey % 60 AS INT) AS code, CAST(l_partkey % 5 AS INT) AS operator, l_returnflag <> 'R' AS public, qty FROM items""",
    "names": """
        SELECT s_suppkey AS id, p_name AS name, CAST(s_suppkey * 131 % 5000 AS INT) AS x, CAST(s_suppkey * 71 % 5000 AS INT) AS y FROM supplier JOIN part ON p_partkey = s_suppkey""",
}

_CALL = re.compile(r"\b(days|secs)\(")


def _rewrite(sql: str, dialect: str) -> str:
    """days(d, n) and secs(t, n) in a dialect's own words; arguments hold no comma outside brackets but one."""
    while m := _CALL.search(sql):
        depth, comma, i = 1, 0, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        a, b = sql[m.end() : comma].strip(), sql[comma + 1 : i - 1].strip()
        if dialect == "spark":
            new = f"date_add({a}, {b})" if m[1] == "days" else f"timestampadd(SECOND, {b}, {a})"
        else:
            new = f"CAST(({a}) + ({b}) AS DATE)" if m[1] == "days" else f"(({a}) + to_seconds({b}))"
        sql = sql[: m.start()] + new + sql[i:]
    return sql


def _needs(sql: str) -> list[str]:
    return [n for n in SHAPES if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)]


def _ordered(sql: str, seen: list[str]) -> list[str]:
    for n in _needs(sql):
        if n not in seen:
            _ordered(SHAPES[n], seen)
            if n not in seen:
                seen.append(n)
    return seen


def with_shapes(sql: str) -> str:
    """DuckDB SQL with the shapes that it names in front."""
    parts = [f"{n} AS ({SHAPES[n]})" for n in _ordered(sql, [])]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:] if parts else body
        return _rewrite(("WITH " + ", ".join(parts) + body) if parts else body, "duckdb")
    return _rewrite(("WITH " + ", ".join(parts) + " " if parts else "") + body, "duckdb")


class Shapes:
    """Base tables and shapes of one data folder as DataFrames: shapes.stop_history, shapes.orders, …"""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in SHAPES:
            return self.sql(SHAPES[name])
        raise AttributeError(name)

    def store(self, *names: str) -> None:
        """Work these shapes out now, each from those before it, and write them, for all that is made of them."""
        for n in names:
            setattr(self, n, cut(getattr(self, n)))

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over shapes and base tables."""
        names = [n for n in (*SHAPES, *BASE) if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)]
        text = text.replace("{", "{{").replace("}", "}}")
        for n in names:
            text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(_rewrite(text, "spark"), **{n: getattr(self, n) for n in names})
