"""Hand-computed cases."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from timetide.functions import geo
from timetide.operators import calendars, matching, merging, realtime

D = datetime.date


def test_easter_and_holidays(spark):
    got = {r["day"] for r in calendars.czech_holidays(spark, 2020, 2020).collect()}
    assert got == {D(2020, m, d) for d, m in ((1, 1), (10, 4), (13, 4), (1, 5), (8, 5), (5, 7), (6, 7), (28, 9), (28, 10), (17, 11), (24, 12), (25, 12), (26, 12))}
    assert D(1997, 3, 31) in {r["day"] for r in calendars.czech_holidays(spark, 1997, 1997).collect()}
    years = spark.createDataFrame([(y,) for y in (1954, 1981, 2000, 2019, 2020, 2024, 2038, 2049, 2076)], "y int")
    got = [r[0] for r in years.select(calendars.easter_sunday(F.col("y"))).collect()]
    assert got == [D(1954, 4, 18), D(1981, 4, 19), D(2000, 4, 23), D(2019, 4, 21), D(2020, 4, 12), D(2024, 3, 31), D(2038, 4, 25), D(2049, 4, 18), D(2076, 4, 19)]


def bare(spark, times, fixed, clock):
    rows = [("t", i, t, fixed, clock.date(), clock.hour * 3600 + clock.minute * 60) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "trip string, pos int, time_sec int, fixed_pos int, clock_date date, clock_sec int")
    return [r["day"] for r in realtime.date_bare_times(df, ["trip"]).orderBy("pos").collect()]


def test_bare_times(spark):
    h = lambda a, b: a * 3600 + b * 60
    clock = datetime.datetime(2020, 1, 10, 1, 0)
    assert bare(spark, [h(23, 10), 0, h(0, 10), h(1, 0)], 1, clock) == [D(2020, 1, 9), D(2020, 1, 10), D(2020, 1, 10), D(2020, 1, 10)]
    assert bare(spark, [None, h(23, 10), 0, None, h(0, 10), h(1, 0)], 2, clock) == [None, D(2020, 1, 9), D(2020, 1, 10), None, D(2020, 1, 10), D(2020, 1, 10)]


def resolved(*variants):
    return sorted(merging._resolved(list(variants)))


def test_route_overlaps():
    jan, jun, dec = D(2024, 1, 1), D(2024, 6, 1), D(2024, 12, 31)
    day = datetime.timedelta(days=1)
    plain, late = (1, jan, dec, False, D(2023, 1, 1)), (2, jan, dec, False, D(2023, 5, 1))
    assert resolved(plain, late) == [(2, 2, jan, dec)]
    assert resolved(plain, (2, jan, dec, False, D(2023, 1, 1))) == [(1, 1, jan, dec)]  # of equal rank the first stays
    inside = (2, jun, jun + 9 * day, True, D(2023, 5, 1))
    assert resolved(plain, inside) == [(1, 1, jan, jun - day), (1, 3, jun + 10 * day, dec), (2, 2, jun, jun + 9 * day)]
    staggered = (2, jun, D(2025, 3, 1), False, D(2023, 5, 1))
    assert resolved(plain, staggered) == [(1, 1, jan, jun - day), (2, 2, jun, D(2025, 3, 1))]
    assert resolved((1, jan, dec, True, D(2023, 9, 1)), staggered) == [(1, 1, jan, dec), (2, 2, dec + day, D(2025, 3, 1))]
    assert resolved(plain, (2, D(2025, 1, 1), D(2025, 2, 1), False, None)) == [(1, 1, jan, dec), (2, 2, D(2025, 1, 1), D(2025, 2, 1))]


def test_resolved_routes_do_not_overlap(spark):
    import random

    rng = random.Random(6)
    for _ in range(300):
        rows = []
        for d in range(1, 6):
            a = D(2024, 1, 1) + datetime.timedelta(days=rng.randrange(60))
            rows.append((d, a, a + datetime.timedelta(days=rng.randrange(40)), rng.random() < 0.3, D(2023, 1, 1) + datetime.timedelta(days=rng.randrange(9))))
        out = sorted((a, b) for _, _, a, b in merging._resolved(rows))
        assert all(x[1] < y[0] for x, y in zip(out, out[1:])), (rows, out)


def test_many_variants_of_one_number():
    """Each day goes to the variant of the highest priority that has it; thousands of variants take no square of their number."""
    import random
    import time

    rng = random.Random(8)
    for n, span in ((12, 60), (40, 200), (4000, 40_000)):
        rows = [(d, first := D(1950, 1, 1) + datetime.timedelta(days=rng.randrange(span)), first + datetime.timedelta(days=rng.randrange(25)), d > 0.7 * n, D(2020, 1, 1) + datetime.timedelta(days=x)) for d, x in zip(range(1, n + 1), [*range(n - n * 3 // 10), *rng.sample(range(n), n * 3 // 10)])]
        began = time.time()
        pieces = merging._resolved(rows)
        assert time.time() - began < 5
        rank, owner = {d: (t, c) for d, _, _, t, c in rows}, {}
        for d, a, b, _, _ in rows:
            for k in range((b - a).days + 1):
                day = a + datetime.timedelta(days=k)
                owner[day] = max(owner.get(day, d), d, key=rank.get)
        got = [(a + datetime.timedelta(days=k), s) for s, _, a, b in pieces for k in range((b - a).days + 1)]
        assert dict(got) == owner and len(got) == len(owner)


def test_projection_round_trip(spark):
    points = spark.createDataFrame([(52.0, 10.0), (50.0875, 14.4213), (48.1486, 17.1077), (38.7, -9.1)], "lat double, lon double")
    x, y = geo.project(F.col("lat"), F.col("lon"))
    got = points.select("lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = geo.unproject(F.col("x"), F.col("y"))
    rows = got.select("lat", "lon", "x", "y", lat.alias("a"), lon.alias("b")).collect()
    assert (rows[0]["x"], rows[0]["y"]) == (pytest.approx(4_321_000), pytest.approx(3_210_000))
    assert all(r["a"] == pytest.approx(r["lat"], abs=1e-7) and r["b"] == pytest.approx(r["lon"], abs=1e-7) for r in rows)


def test_polygon_cover_equals_even_odd_rule(spark):
    """Random star polygons, some with holes, against a walk along the whole ring; no cell holds more than its own edges."""
    import math
    import random

    rng = random.Random(9)

    def star(x, y, n, big):
        turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
        return [(x + math.cos(t) * r, y + math.sin(t) * r) for t in turns for r in [big * (0.3 + 0.7 * rng.random())]]

    rings = {}
    for k in range(25):
        x, y = rng.random() * 8, rng.random() * 8
        outer = star(x, y, rng.randrange(3, 40), 0.2 + 2 * rng.random())
        hole = star(x, y, 5, 0.05) if k % 3 == 0 else []
        rings[f"p{k}"] = outer + ([outer[0], *hole, hole[0], outer[0]] if hole else [])
    rings["square"] = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    points = [(k, rng.random() * 10 - 1, rng.random() * 10 - 1) for k in range(600)]

    def holds(ring, x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return odd

    polygons = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in r]) for n, r in rings.items()], "name string, ring array<struct<x:double,y:double>>")
    frame = spark.createDataFrame(points, "id int, x double, y double")
    for cell in (0.37, 5.0):
        got = {r["id"]: r["name"] for r in geo.towns_of_points(frame, polygons.union(polygons.limit(3)), ["id"], cell).collect()}
        for k, x, y in points:
            own = [n for n, r in rings.items() if holds(r, x, y)]
            assert got[k] == (own[0] if len(own) == 1 else None), (k, cell, own)
    cover = geo.polygon_cover(polygons, 0.05)
    assert cover.where("edges is null and not inside").count() == 0 and cover.agg(F.max(F.size("edges"))).first()[0] < 20


def test_name_search(spark):
    targets = spark.createDataFrame([("Hostivice", 1), ("Hostivice-Sadová", 2), ("Praha-Dejvice", 3)], "name string, data int")
    none = spark.createDataFrame([], "group_id int, token string")
    found = matching.match_stops_by_name(spark.createDataFrame([("Hostivice",), ("praha dejvice",)], "name string"), targets, none)
    best = {q: [r["data"] for r in found.where(F.col("name") == q).orderBy(F.col("score").desc()).collect()] for q in ("Hostivice", "praha dejvice")}
    assert best == {"Hostivice": [1, 2], "praha dejvice": [3]}


def test_upsert_replay_and_scd2_gaps(spark):
    rows = [("t", D(2024, 1, 1), i, f"s{i}", 10 * i, seq) for seq in (1, 2) for i in range(1, 4 - seq + 1)]
    df = spark.createDataFrame(rows, "trip_id string, trip_start_date date, trip_stop_index int, stop_id string, arrived int, seq long")
    once = realtime.upsert_stop_history(df)
    assert sorted(once.union(df).transform(realtime.upsert_stop_history).collect()) == sorted(once.collect())
    assert [r["trip_stop_index"] for r in realtime.truncate_tail(df).orderBy("trip_stop_index").collect()] == [1, 2]
    days = [("a", "n", D(2024, 1, d), x, 0) for d, x in ((1, 1), (2, 1), (4, 1), (5, 2), (6, None), (7, None))]
    got = realtime.stops_scd2(spark.createDataFrame([(i, n, d, x, y) for i, n, d, x, y in days], "id string, name string, day date, lat int, lon int"))
    assert [(r["valid_from"].day, r["valid_to"].day, r["lat"]) for r in got.orderBy("valid_from").collect()] == [(1, 3, 1), (4, 5, 1), (5, 6, 2), (6, 7, None), (7, 8, None)]


UNDATED = "trip string, pos int, fixed_pos int, clock_date date, clock_sec int, arrived int, should_arrive int, departed int, should_depart int"


def test_undated_stop_history(spark):
    """A trip of one day, and one over midnight, as seen at its third stop."""
    h = lambda a, b: a * 3600 + b * 60
    one = [(None, None, h(9, 10), h(9, 8)), (h(10, 11), h(10, 10), None, h(10, 15)), (h(10, 30), h(10, 30), h(10, 30), h(10, 30))]
    two = [(None, None, h(23, 10), h(23, 0)), (h(0, 10), h(0, 0), h(0, 10), h(0, 5)), (h(2, 0), h(2, 0), h(2, 20), h(2, 10))]
    rows = [("one", i, 0, D(2020, 1, 1), h(10, 0), *x) for i, x in enumerate(one)] + [("two", i, 2, D(2020, 1, 10), h(3, 0), *x) for i, x in enumerate(two)]
    got = realtime.date_stop_history(spark.createDataFrame(rows, UNDATED), ["trip"]).orderBy("trip", "pos").collect()
    days = [(r["trip"], r["arrived_day"], r["should_arrive_day"], r["departed_day"], r["should_depart_day"]) for r in got]
    first, late, early = D(2020, 1, 1), D(2020, 1, 10), D(2020, 1, 9)
    assert days[:3] == [("one", None, None, first, first), ("one", first, first, None, first), ("one", first, first, first, first)]
    assert days[3:] == [("two", None, None, early, early), ("two", late, late, late, late), ("two", late, late, late, late)]


def test_service_days_of_open_validity(spark):
    """A route valid to the year 3000 runs to its end; its calendar is a pattern with the holidays as exceptions."""
    trips = spark.createDataFrame([("a", D(2024, 1, 1), D(3000, 1, 1), ["X"]), ("b", D(2024, 1, 1), D(2024, 1, 5), ["7"]), ("c", D(2024, 2, 1), D(2024, 1, 1), [])], "trip string, valid_from date, valid_to date, codes array<string>")
    notes = spark.createDataFrame([("b", 2, D(2024, 1, 2), None)], "trip string, note_type int, date_from date, date_to date")
    holidays = calendars.czech_holidays(spark, 2024, 2030)
    days = calendars.service_days(trips, notes, holidays, ["trip"])
    last = {r[0]: r[1] for r in days.groupBy("trip").agg(F.max("day")).collect()}
    assert last == {"a": D(3000, 1, 1), "b": D(2024, 1, 2)}
    services, plans = calendars.service_calendar(trips, notes, holidays, ["trip"])
    got = {r["trip"]: r for r in services.join(plans, "plan").collect()}
    assert set(got) == {"a", "b"} and got["a"]["pattern"] == [True] * 5 + [False] * 2 and got["a"]["valid_to"] == D(3000, 1, 1)
    assert {c["exception_type"] for c in got["a"]["changes"]} == {2} and len(got["a"]["changes"]) == len([d for d in (r["day"] for r in holidays.collect()) if d.weekday() < 5])
    assert got["b"]["pattern"] == [False] * 6 + [True] and [(c["day"], c["exception_type"]) for c in got["b"]["changes"]] == [(D(2024, 1, 2), 1)]
    calendar, exceptions = calendars.compact_calendar(trips.where("trip <> 'a'"), days.where("trip <> 'a'"), ["trip"])
    assert [r["trip"] for r in calendar.collect()] == ["b"] and [(r["day"], r["exception_type"]) for r in exceptions.collect()] == [(D(2024, 1, 2), 1)]


def test_calendars_by_ranges_equal_calendars_by_days(spark):
    """Random validities, codes and notes: what ranges give is what a look at every day gives."""
    import random

    rng, day = random.Random(4), lambda n: D(2024, 1, 1) + datetime.timedelta(days=n)
    trips, notes = [], []
    for k in range(400):
        first = rng.randrange(40)
        trips.append((k, day(first), day(first + rng.choice([-1, 0, 3, 20, 90, 500])), rng.choice([[], ["X"], ["+"], ["X", "+"], ["6"], ["1", "2"], ["7", "@"], ["{"], ["+", "6"]])))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            a = rng.randrange(-10, 130)
            notes.append((k, rng.choice([None, *range(1, 9)]), day(a) if rng.random() < 0.85 else None, day(a + rng.choice([-2, 0, 1, 7, 60, 600])) if rng.random() < 0.7 else None))
    trips = spark.createDataFrame(trips, "trip int, valid_from date, valid_to date, codes array<string>")
    notes = spark.createDataFrame(notes, "trip int, note_type int, date_from date, date_to date")
    holidays = calendars.czech_holidays(spark, 2024, 2026)
    services, plans = calendars.service_calendar(trips, notes, holidays, ["trip"])
    got = {r["trip"]: (r["valid_from"], r["pattern"], [tuple(c) for c in r["changes"]]) for r in services.join(plans, "plan").collect()}
    days = calendars.service_days(trips, notes, holidays, ["trip"])
    calendar, exceptions = calendars.compact_calendar(trips, days, ["trip"])
    base = {r["trip"]: (r["valid_from"], r["pattern"]) for r in calendar.collect()}
    listed = {}
    for r in exceptions.collect():
        listed.setdefault(r["trip"], []).append((r["day"], r["exception_type"]))
    want = {t: (*base.get(t, (None, None)), sorted(listed.get(t, []))) for t in base.keys() | listed.keys()}
    assert got == want and len(want) > 200


def test_a_long_validity_costs_its_holidays(spark):
    plans = spark.createDataFrame([(1, D(2024, 1, 1), D(3000, 1, 1), ["X"], None), (2, D(2024, 1, 1), D(3000, 1, 1), ["1"], None)], "_sign long, valid_from date, valid_to date, codes array<string>, notes array<struct<note_type:int,date_from:date,date_to:date>>")
    holidays = calendars.czech_holidays(spark, 2020, 2030)
    assert {r["_sign"]: r["count"] for r in calendars.odd_days(plans, holidays).groupBy("_sign").count().collect()} == {1: 7 * 13}
    changed = {r["_sign"]: r for r in calendars.signature_changes(plans, holidays).collect()}
    assert len(changed[1]["changes"]) == len([h for h in holidays.collect() if h["day"].year >= 2024 and h["day"].weekday() < 5]) and changed[2]["changes"] == []


def test_latest_run_of_any_trip_id(spark):
    from timetide.operators import analytics

    details = spark.createDataFrame([("115_23_1", D(2024, 1, 2), "R", None), ("115_23_0", D(2024, 1, 2), "R", "Nine"), ("z", D(2024, 1, 1), "R", None)], "trip_id string, trip_start_date date, route_id string, route_short_name string")
    history = spark.createDataFrame([("115_23_0", D(2024, 1, 2), 1, "S1"), ("115_23_0", D(2024, 1, 2), 2, "S2")], "trip_id string, trip_start_date date, trip_stop_index int, stop_id string")
    versions = spark.createDataFrame([("S2", D(2024, 1, 1), D(2024, 2, 1), "Two")], "id string, valid_from date, valid_to date, name string")
    got = analytics.route_summaries(details, history, versions).collect()
    assert [(r["trip_id"], r["name"], r["first_stop"], r["last_stop"]) for r in got] == [("115_23_0", "Nine", "S1", "Two")]


def test_day_table_survives_a_cut_merge(spark, tmp_path, monkeypatch):
    """A run that ends after the merged days are written, with a day already deleted, loses nothing."""
    import shutil

    from timetide.streaming import history

    schema = "trip_id string, trip_start_date date, trip_stop_index int, stop_id string, arrived int, seq long"
    table = history.DayTable(spark, str(tmp_path / "stops"), schema)
    row = lambda t, day, i, seq: (t, day, i, f"s{i}", 10 * i, seq)
    put = lambda *rows: table.merge(spark.createDataFrame(list(rows), schema), realtime.truncate_tail)
    put(row("a", D(2024, 1, 1), 1, 1), row("a", D(2024, 1, 1), 2, 1), row("b", D(2024, 1, 2), 1, 1), row("n", None, 1, 1))
    monkeypatch.setattr(history.DayTable, "put_in_place", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        put(row("a", D(2024, 1, 1), 1, 2))
    shutil.rmtree(tmp_path / "stops" / "trip_start_date=2024-01-01")
    monkeypatch.undo()
    put(row("c", D(2024, 1, 3), 1, 3))
    got = sorted((r["trip_id"], r["trip_stop_index"], r["seq"]) for r in table.read().collect())
    assert got == [("a", 1, 2), ("b", 1, 1), ("c", 1, 3), ("n", 1, 1)]


def test_poll_delta_counts_take_unchanged_records(spark, tmp_path):
    """Two records of a train that say the same, in snapshots next to each other."""
    import duckdb

    from timetide.jobs import catalog

    first = datetime.datetime(2024, 1, 1, 1)
    rows = [(2, first, 7, "a"), (2 + 2 * 1440, first + datetime.timedelta(hours=6), 7, "a"), (3, first + datetime.timedelta(hours=12), 7, "a")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sql = catalog.oracles()["rt8_poll_delta_counts"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT train, n, full_rows FROM ({sql}) x").fetchall()
    got = catalog.queries()["rt8_poll_delta_counts"](spark, str(tmp_path))
    assert [tuple(r) for r in got.select("train", "n", "full_rows").collect()] == want == [("U7", 3, 1)]


def test_variants_created_past_the_last_year_of_python(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, 1, DATE'2024-01-01', DATE'2024-01-31', FALSE, date_add(DATE'1990-01-01', 30000000)),
        (1, 2, DATE'2024-01-10', DATE'2024-01-20', FALSE, date_add(DATE'1990-01-01', 30000001)), (1, 3, DATE'2024-03-01', DATE'2024-03-02', FALSE, NULL) t(route_id, dist, valid_from, valid_to, detour, created)""")
    got = sorted((r["source_dist"], r["valid_from"], r["valid_to"]) for r in merging.resolve_route_overlaps(rows).collect())
    assert got == [(1, D(2024, 1, 1), D(2024, 1, 9)), (1, D(2024, 1, 21), D(2024, 1, 31)), (2, D(2024, 1, 10), D(2024, 1, 20)), (3, D(2024, 3, 1), D(2024, 3, 2))]


def test_tails_are_cut_in_one_pass_over_the_writes(spark):
    """The plan has no frame that shrinks from row to row, which Spark works out anew for each row of a run."""
    rows = spark.range(10).selectExpr("'t' AS trip_id", "DATE'2024-01-01' AS trip_start_date", "CAST(id % 3 AS INT) AS trip_stop_index", "id AS seq")
    plan = realtime.truncate_tail(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$(), -1" in plan and "unboundedfollowing$()" not in plan


def test_signatures_are_judged_in_their_own_rows(spark):
    """A calendar is made of its signature's row alone, without a shuffle; its holidays are those of both years of a short validity."""
    note = "array<struct<note_type:int,date_from:date,date_to:date>>"
    plans = [(1, D(2023, 12, 20), D(2024, 1, 5), ["X"], [(4, D(2023, 12, 28), None)]), (2, D(2023, 1, 1), D(2024, 12, 31), ["+"], None), (3, D(2024, 1, 2), D(2024, 1, 1), ["X"], None)]
    plans = spark.createDataFrame(plans, f"_sign long, valid_from date, valid_to date, codes array<string>, notes {note}")
    made = calendars.judged_signatures(plans, calendars.czech_holidays(spark, 2020, 2030))
    assert "hashpartitioning(_sign" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["_sign"]: r for r in made.collect()}
    assert set(got) == {1, 2}
    assert [(c["day"], c["exception_type"]) for c in got[1]["changes"]] == [(D(2023, 12, 25), 2), (D(2023, 12, 26), 2), (D(2023, 12, 28), 2), (D(2024, 1, 1), 2)]
    assert got[1]["n_on"] == 9 and not got[1]["by_list"]
    days = calendars.signature_days(plans, calendars.czech_holidays(spark, 2020, 2030)).where("runs").groupBy("_sign").count()
    assert {r["_sign"]: r["count"] for r in days.collect()} == {k: r["n_on"] for k, r in got.items()}


def test_attributes_are_resolved_without_a_shuffle(spark):
    """A batch's attributes are one row: trips are not brought together by batch."""
    from timetide.operators.timetable import resolve_attributes

    rows = spark.range(10).selectExpr("CAST(id % 2 AS INT) AS batch_id", "array(CAST(id % 3 AS INT)) AS attributes")
    refs = spark.range(6).selectExpr("CAST(id % 2 AS INT) AS batch_id", "CAST(id DIV 2 AS INT) AS attribute_id", "concat('c', id) AS code")
    made = resolve_attributes(rows, refs)
    assert "strategy=broadcast" in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["batch_id"], r["attributes"][0]) for r in made.distinct().collect()) == [(0, "c0"), (0, "c2"), (0, "c4"), (1, "c1"), (1, "c3"), (1, "c5")]


def test_growing_tables_of_a_feed_are_not_broadcast(spark):
    """Routes, trips, plans and days have small files and many rows: joins by their keys pass by the driver."""
    import re

    from timetide.jobs import catalog, timetable
    from timetide.jobs.shapes import Shapes

    sf = "/root/testdata/sf0.001"
    feed = timetable.feed(Shapes(spark, sf), "trips", "stop_times", "calendar", "calendar_dates")
    made = [*feed.values(), timetable.feed(Shapes(spark, sf), "stop_times")["stop_times"], catalog.queries()["g1_feed_service_days"](spark, sf)]
    keys = r"BroadcastHashJoin \[[^\]]*\b(dist|trip_id|plan|_sign|service_id)#"
    assert [re.findall(keys, df._jdf.queryExecution().sparkPlan().toString()) for df in made] == [[]] * 6


def test_stops_of_trips_are_shuffled_once(spark):
    """Zones come to a trip's stops with the trip, and flags to a trip with its calendar."""
    from timetide.jobs import timetable as jobs
    from timetide.jobs.shapes import Shapes
    from timetide.operators import timetable

    rows = [(0, "r", 1, 1, "A"), (0, "r", 1, 1, "B"), (0, "r", 1, 1, None), (0, "r", 1, 2, None), (0, "r", 1, None, "C"), (0, "q", 1, 3, "A")]
    zones = timetable.route_zones(spark.createDataFrame(rows, "batch_id int, route_id string, dist int, route_stop_id int, zone string"))
    assert {r["route_id"]: r["zones"] for r in zones.collect()} == {"r": {1: "B", 2: None}, "q": {3: "A"}}
    feed = jobs.feed(Shapes(spark, "/root/testdata/sf0.001"), "trips", "stop_times")
    plan = feed["stop_times"]._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "route_stop_id" in line.split("hashpartitioning")[1]]
    assert not dealt
    assert "attribute_id" not in feed["trips"]._jdf.queryExecution().optimizedPlan().toString()


def test_railway_feed_reads_its_locations_once(spark, monkeypatch):
    """The feed's tables are made of written locations, and trains and days are not broadcast."""
    import re

    from timetide.jobs import catalog, rail

    plans, written = [], rail.written_feed

    def seen(s, tables):
        plans.extend(df._jdf.queryExecution().sparkPlan().toString() for k, df in tables.items() if k != "feed_info")
        return written(s, tables)

    monkeypatch.setattr(rail, "written_feed", seen)
    out = catalog.queries()["g2_czptt_feed_days"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 6 and not any("lineitem" in p for p in plans)
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert not [x for p in plans for x in re.findall(r"BroadcastHashJoin \[[^\]]*\b(plan|trip_id|service_id)#", p)]
