"""Repair, matching and reports on hand-made batches."""

from __future__ import annotations

import pytest

from timetide.functions.geo import unproject
from timetide.operators import matching, repair

STOPS = "batch_id int, stop_id int, town string, district string, place string, region string, country string"
CALLS = "batch_id int, trip int, direction int, pos int, stop_id int, metres int, dep_kind string, arr_sec int"
TARGETS = "name string, x double, y double, t_region string, t_country string, precision string"
AT = 4_800_000.0, 2_960_000.0


def at(dx, dy=0.0):
    return AT[0] + dx, AT[1] + dy


@pytest.fixture(scope="module")
def fixed(spark):
    stops = [
        (0, 1, "Brno", "hlavní nádraží", None, None, None), (0, 2, "Brno, Lesná", None, None, None, None), (0, 3, "Neznámo", None, None, None, None),
        (0, 4, "Adamov", None, None, None, None), (0, 5, "Wien", None, None, None, None), (0, 6, "Soběšice [JM]", None, "kaple", None, None),
        (1, 1, "Nádraží", None, None, None, None), (1, 2, "Náměstí", None, None, None, None), (1, 3, "Škola, u lesa", None, None, None, None), (1, 4, "Adamov, zámek", None, None, None, None),
    ]
    calls = [(0, 1, 1, i + 1, s, m, "time", None) for i, (s, m) in enumerate(((1, 0), (2, 1500), (3, 4000), (4, 9000), (5, 200_000)))]
    calls += [(1, 1, 1, i + 1, s, 1000 * i, "time", None) for i, s in enumerate((1, 2, 3, 4))]
    targets = [
        ("Brno,hlavní nádraží,", *at(0), "JM", "CZ", "S"), ("Brno,Lesná,", *at(1000), "JM", "CZ", "S"), ("Brno,Lesná,", *at(90_000), "JM", "CZ", "S"),
        ("Olomouc,Nádraží,", *at(60_000), "OL", "CZ", "S"), ("Olomouc,Náměstí,", *at(61_000), "OL", "CZ", "S"), ("Olomouc,Škola,u lesa", *at(62_000), "OL", "CZ", "S"), ("Adamov,zámek,", *at(8000), "JM", "CZ", "S"),
    ]
    towns = [("Brno", "JM", *at(0)), ("Adamov", "JM", *at(9000)), ("Olomouc", "OL", *at(60_000))]
    make = spark.createDataFrame
    return repair.fix_jdf(
        make(stops, STOPS), make(calls, CALLS), make([(0, "Brno - Adamov"), (1, "MHD Olomouc linka 5")], "batch_id int, name string"), make(targets, TARGETS),
        make(towns, "name string, region string, x double, y double"), make([("Wien", "AT", *at(0, -100_000))], "name string, country string, x double, y double"), make([], "group_id int, token string"),
    )


def test_repaired_names_and_regions(fixed):
    got = {(r["batch_id"], r["stop_id"]): tuple(r)[2:] for r in fixed["stops"].select("batch_id", "stop_id", "town", "district", "place", "region", "country").collect()}
    assert len(got) == 10
    assert got[0, 1] == ("Brno", "hlavní nádraží", None, "JM", "CZ") and got[0, 2] == ("Brno", "Lesná", None, "JM", "CZ")
    assert got[0, 3] == ("Neznámo", None, None, "JM", "CZ")  # along the line
    assert got[0, 4] == ("Adamov", None, None, "JM", "CZ") and got[0, 5] == ("Wien", None, None, None, "AT")
    assert got[0, 6] == ("Soběšice", "kaple", None, "JM", "CZ")  # marked in its name; a place alone is the district
    assert [got[1, i][:3] for i in (1, 2, 3)] == [("Olomouc", "Nádraží", None), ("Olomouc", "Náměstí", None), ("Olomouc", "Škola", "u lesa")]
    assert got[1, 4] == ("Adamov", "zámek", None, "JM", "CZ")  # its first part is a town


def test_repaired_positions(spark, fixed):
    from pyspark.sql import functions as F

    got = {(r["batch_id"], r["stop_id"]): (r["lat"], r["lon"], r["precision"]) for r in fixed["locations"].collect()}
    wanted = {(0, 1): at(0), (0, 2): at(1000), (0, 4): at(9000), (0, 5): at(0, -100_000), (1, 1): at(60_000), (1, 2): at(61_000), (1, 3): at(62_000), (1, 4): at(8000)}
    lat, lon = unproject(F.col("x"), F.col("y"))
    want = {(r["b"], r["s"]): (r["lat"], r["lon"]) for r in spark.createDataFrame([(*k, *v) for k, v in wanted.items()], "b int, s int, x double, y double").select("b", "s", lat.alias("lat"), lon.alias("lon")).collect()}
    assert set(got) == set(want) and all(got[k][:2] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert {k for k, v in got.items() if v[2] == "T"} == {(0, 4), (0, 5)}


def test_repair_reports(fixed):
    assert fixed["missing"].collect() == []
    assert [(r["batch_id"], r["stop_id"]) for r in fixed["far"].collect()] == [(1, 4)]  # 54 km on a line of 1 km


def test_secondary_matches_need_agreement(spark):
    """Two patterns that would put a stop in different places leave it open."""
    rows = [("p", 1, 1, 0, 0.0, 0.0), ("p", 2, 2, 5000, None, None), ("q", 1, 3, 0, 50_000.0, 0.0), ("q", 2, 2, 5000, None, None), ("p", 3, 4, 9000, None, None)]
    patterns = spark.createDataFrame([(0, *r) for r in rows], "batch_id int, pattern string, pos int, stop_id int, metres int, x double, y double")
    found = [(2, 4000.0), (2, 46_000.0), (4, 8500.0), (4, 30_000.0)]
    candidates = spark.createDataFrame([(0, s, x, 0.0, "S", "JM", "CZ") for s, x in found], "batch_id int, stop_id int, x double, y double, precision string, t_region string, t_country string")
    got = repair.secondary_matches(patterns, candidates, ["batch_id"]).collect()
    assert [(r["stop_id"], r["cx"]) for r in got] == [(4, 8500.0)]


def test_region_guard(spark):
    """A region is carried on only as far as its edge."""
    stops = spark.createDataFrame([(0, 1, "a", "JM", "CZ"), (0, 2, "b", None, None), (0, 3, "c", None, None)], "batch_id int, stop_id int, town string, region string, country string")
    profiles = spark.createDataFrame([(0, 1, "t", i, i, m) for i, m in ((1, 0), (2, 2000), (3, 9000))], "batch_id int, direction int, pattern string, pos int, stop_id int, metres int")
    places = spark.createDataFrame([(0, 1, 5000.0, 5000.0)], "batch_id int, stop_id int, cx double, cy double")
    ring = [(0.0, 0.0), (10_000.0, 0.0), (10_000.0, 10_000.0), (0.0, 10_000.0)]
    regions = spark.createDataFrame([("JM", ring)], "region string, ring array<struct<x:double,y:double>>")
    towns = spark.createDataFrame([("c", "OL", 5000.0, 13_000.0), ("c", "ZL", 90_000.0, 0.0)], "name string, region string, x double, y double")
    got = {r["stop_id"]: (r["region"], r["country"]) for r in repair.regions_along(stops, places, profiles, regions, towns, False).collect()}
    assert got == {1: ("JM", "CZ"), 2: ("JM", "CZ"), 3: ("OL", "CZ")}
    square = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d)]
    areas = spark.createDataFrame([("c", "OL", square(5000.0, 14_900.0, 900.0)), ("c", "ZL", square(4000.0, 15_100.0, 900.0)), ("b", "ZL", square(0.0, 0.0, 9.0))], "name string, region string, ring array<struct<x:double,y:double>>")
    near = {r["stop_id"]: (r["region"], r["country"]) for r in repair.regions_along(stops, places, profiles, regions, towns, False, areas).collect()}
    assert near == got  # its edge, not its middle, lies within 9000 + 1000 m; the other town's does not


def test_coverage_report_and_pages(spark):
    stops = spark.createDataFrame([(1, "Brno", None), (2, "Praha", "123"), (3, "Nikde", None), (4, "Brno", "9")], "stop_id int, name string, sr70 string")
    targets = spark.createDataFrame([("Brno", None, "ext", 0, 0), ("Brno hlavní", None, "map", 10, 0), ("Jinak", "00123", "map", 5, 5), ("Praha", None, "ext", 1, 1)], "name string, sr70 string, kind string, x int, y int")
    none = spark.createDataFrame([], "group_id int, token string")
    report = matching.coverage_report(stops, targets, none)
    got = sorted((r["stop_id"], r["target"] or "", r["match_type"], r["score"]) for r in report.collect())
    assert got == [(1, "Brno hlavní", "map by name", 0.5), (2, "Jinak", "map by code", 1.0), (3, "", "none", None), (4, "Brno hlavní", "map by name", 0.5)]
    assert [r["stop_id"] for r in matching.report_page(report, sort="name").collect()] == [1, 4, 3, 2]
    assert [r["stop_id"] for r in matching.report_page(report, perfect=True).collect()] == [2]
    assert [r["stop_id"] for r in matching.report_page(report, text="BRN", sort="match", page=2, size=1).collect()] == [4]
    assert {r["match_type"]: r["n"] for r in matching.match_summary(report).collect()} == {"map by name": 2, "map by code": 1, "none": 1}


def test_written_tables_do_not_pass_through_the_driver(spark):
    """Rows that repeat themselves make small files; their joins by stop are no broadcasts."""
    from timetide.functions.lineage import cut
    from timetide.operators import matching

    rows = cut(spark.range(1000).selectExpr("id AS k", "1.0D AS x", "2.0D AS y", "'PH' AS t_region", "'CZ' AS t_country", "'S' AS precision"))
    top = matching.top_stop_match(rows, ["k"])
    stops = spark.range(1000).selectExpr("id AS k", "'a' AS town", "CAST(NULL AS STRING) AS district", "CAST(NULL AS STRING) AS place")
    towns = spark.createDataFrame([("a",)], "name string")
    placed = matching.primary_matches(top, cut(stops), towns, towns, ["k"])
    plan = placed._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [k#" in plan and "BroadcastHashJoin [k#" not in plan


def test_pairs_of_one_name_are_dealt_to_many_tasks(spark):
    """Stops and targets that all share a name: no task makes most of the pairs, and none is lost or made twice."""
    from pyspark.sql import functions as F

    from timetide.functions.lineage import spread_join

    left, right = spark.range(300).selectExpr("id AS a", "concat('n', id % 1) AS name"), spark.range(200).selectExpr("id AS b", "concat('n', id % 1) AS name")
    joined = spread_join(left, right, ["name"], cell=20, pairs=2000)
    per_task = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert joined.select("a", "b").distinct().count() == joined.count() == sum(per_task) == 60_000
    assert max(per_task) < 10_000
    few = spread_join(left.where("a < 3"), right.unionByName(right), ["name"])
    assert few.count() == 1200 and set(few.columns) == set(joined.columns) == {"name", "a", "b"}


def test_coverage_by_classes(spark):
    """Ids that several rows share, or none: the report holds best matches only and sorts no others out; its pages need no report."""
    stops = [(1, "Brno", None), (1, "Praha", None), (2, "Praha", "123"), (3, "Nikde", None), (4, "Brno", "9"), (4, "Brno", "9"), (5, "Lom", "7"), (5, "Nikde", None), (None, "Brno", None), (None, "Nikde", None)]
    stops = spark.createDataFrame(stops, "stop_id int, name string, sr70 string")
    targets = [("Brno", None, "ext", 0, 0), ("Brno hlavní", None, "map", 10, 0), ("Brno hlavní", None, "map", 30, 0), ("Jinak", "00123", "map", 5, 5), ("Praha", None, "ext", 1, 1), ("Praha", None, "map", 100, 40), ("Sedm", "7", "ext", 3, 4), ("Lom", "8", "other", None, None)]
    targets = spark.createDataFrame(targets, "name string, sr70 string, kind string, x int, y int")
    given = stops, targets, spark.createDataFrame([], "group_id int, token string")
    report = matching.coverage_report(*given)
    got = sorted((r["stop_id"] or 0, r["name"], r["target"] or "", r["priority"], r["x"] or 0) for r in report.collect())
    both = [("Brno hlavní", 2, 10), ("Brno hlavní", 2, 30)]
    want = [(0, "Brno", *b) for b in both] + [(0, "Brno", "", 5, 0), (0, "Nikde", "", 5, 0)] + [(1, "Brno", *b) for b in both] + [(1, "Praha", "Praha", 2, 100), (2, "Praha", "Jinak", 1, 5), (3, "Nikde", "", 5, 0)] + [(4, "Brno", *b) for b in both * 2] + [(5, "Lom", "Sedm", 3, 3)]
    assert got == sorted(want)
    assert "rank(" not in report._jdf.queryExecution().toString()
    for options in ({}, {"perfect": True}, {"sort": "radius"}, {"sort": "match", "size": 3, "page": 2}, {"text": "brn"}):
        assert matching.coverage_page(*given, **options).collect() == matching.report_page(report, **options).collect(), options
