"""One broken batch of each kind: the others are read, converted and merged, and each has its reject."""

from __future__ import annotations

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F
from tests.test_sources import record

from timetide.operators import calendars, rejects
from timetide.sources import czptt, jdf

D = datetime.date


def files(n: int, **other) -> dict[str, str]:
    """A whole small batch; other: files put in place of its own, None for a missing one."""
    own = {
        "verzejdf": record("1.11", "", "", "", "01012024", "x"),
        "zastavky": record("1", "Brno", "", "", "", "CZ", "5", *[""] * 5) + record("2", "Zlín", "", "", "", "CZ", *[""] * 6),
        "dopravci": record("11", "", "Dopravce", *[""] * 9, "1"),
        "linky": record(f"10000{n}", "Linka", "11", "A", "A", *["0"] * 4, "", "", "", "", "01012024", "31012024", "1", "1"),
        "spoje": record(f"10000{n}", "1", "5", *[""] * 9, "7", "1"),
        "spojskup": record("7", "", ""),
        "zaslinky": record(f"10000{n}", "1", "", "1", "", "", "", "", "1") + record(f"10000{n}", "2", "", "2", "", "", "", "", "1"),
        "zasspoje": record(f"10000{n}", "1", "1", "1", "", "", "", "", "0", "", "0615", "", "", "1") + record(f"10000{n}", "1", "2", "2", "", "", "", "", "9", "0630", "", "", "", "1"),
        "pevnykod": record("5", "X", ""),
        "caskody": record(f"10000{n}", "1", "1", "", "1", "05012024", "", "", "1"),
    }
    return {k: v for k, v in (own | other).items() if v is not None}


BROKEN = {
    "version": dict(verzejdf=record("2.0", "", "", "", "01012024", "x")),
    "flag": dict(linky=record("100001", "Linka", "11", "A", "A", "ano", *["0"] * 3, "", "", "", "", "01012024", "31012024", "1", "1")),
    "date": dict(caskody=record("100002", "1", "1", "", "1", "05132024", "", "", "1")),
    "time": dict(zasspoje=record("100003", "1", "1", "1", "", "", "", "", "0", "", "2515", "", "", "1")),
    "number": dict(zastavky=record("eins", "Brno", "", "", "", "CZ", *[""] * 6)),
    "attribute": dict(pevnykod=record("6", "X", "")),
    "route": dict(linky="\r\n"),
    "stop": dict(zastavky=record("1", "Brno", "", "", "", "CZ", "5", *[""] * 5)),
    "passed": dict(zasspoje=record("100009", "1", "1", "1", "", "", "", "", "0", "|", "0615", "", "", "1")),
    "file": dict(spoje=None),
}


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("batches")
    for n, (name, other) in enumerate([("good", {}), *BROKEN.items()]):
        (root / name).mkdir()
        for file, text in files(n, **other).items():
            (root / name / f"{file}.txt").write_bytes(text.encode("cp1250"))
    (root / "torn.zip").write_bytes(b"PK\x03\x04 torn")
    with zipfile.ZipFile(root / "zipped.zip", "w") as z:
        for file, text in files(5).items():
            z.writestr(f"{file}.txt", text.encode("cp1250"))
    (root / "letters").mkdir()
    for file, text in files(8).items():
        (root / "letters" / f"{file}.txt").write_bytes(b"\x81" if file == "dopravci" else text.encode("cp1250"))
    (root / "nothing").mkdir()
    (root / "nothing" / "readme.txt").write_bytes(b"\x81")
    return root


def short(rows):
    return {(r["batch_id"].rpartition("/")[2], r["step"], r["reason"].partition(":")[0]) for r in rows.collect()}


def test_reading_goes_on(spark, batches):
    tables, found = jdf.read_batches(spark, str(batches), complete=True)
    assert short(found) == {
        ("version", "read", "unknown version"), ("flag", "cast", "detour of routes"), ("date", "cast", "date_from of service_notes"), ("time", "cast", "dep of trip_stops"), ("number", "cast", "stop_id of stops"),
        ("file", "read", "file missing"), ("torn.zip", "read", "BadZipFile"), ("letters", "read", "UnicodeDecodeError"),
    }
    left = {r["batch_id"].rpartition("/")[2] for r in tables["version"].collect()}
    assert left == {"good", "zipped.zip", "attribute", "route", "stop", "passed"}
    with pytest.raises(ValueError, match="cannot be read"):
        jdf.read_jdf(spark, str(batches))


def test_conversion_and_merge_go_on(spark, batches):
    tables, _ = jdf.read_batches(spark, str(batches), complete=True)
    feed, found = rejects.convert(tables, calendars.czech_holidays(spark, 2024, 2024))
    assert short(found) == {("attribute", "stops", "attribute not found"), ("attribute", "trips", "attribute not found"), ("route", "trips", "route not found"), ("stop", "trip_stops", "stop not found"), ("passed", "trip_stops", "arrival passed, departure not")}
    for table in ("stop_times", "trips", "routes", "stops", "agency"):
        assert {r["batch_id"].rpartition("/")[2] for r in feed[table].collect()} == {"good", "zipped.zip"}, table
    assert feed["stop_times"].count() == 4
    merged, left = rejects.merge(tables, F.lit(D(2024, 6, 2)))
    assert {b for b, _, _ in short(left)} == {"attribute", "route", "stop"}
    assert merged["routes"].count() == 3 and merged["trip_stops"].count() == 5


def test_messages_of_no_kind(spark):
    texts = spark.createDataFrame([("a", "unknown", "<x/>"), ("b", "timetable", "<CZPTTCISMessage/>")], "message_id string, kind string, xml string")
    assert [tuple(r) for r in czptt.message_rejects(texts).collect()] == [("a", "no known message")]
    assert [r["message_id"] for r in czptt.parse_messages(texts, strict=False)[0].collect()] == ["b"]


def test_feed_tables_on_demand(spark):
    """Agencies are made without a look at trips, and the trips that run are those that have a calendar."""
    from timetide.jobs import calendars as jobs
    from timetide.jobs import timetable
    from timetide.jobs.shapes import Shapes

    s = Shapes(spark, "/root/testdata/sf0.001")
    feed = timetable.feed(s, "agency")
    assert list(feed) == ["agency"] and not any("lineitem" in f for f in feed["agency"].inputFiles())
    made = (jobs.trips(s), s.notes, calendars.czech_holidays(spark, 1995, 2010), jobs.KEYS)
    running = calendars.running_trips(*made)
    with_days = calendars.service_calendar(*made)[0].select(*jobs.KEYS)
    assert running.count() == with_days.count() > 0 and running.exceptAll(with_days).isEmpty()
