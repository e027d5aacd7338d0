"""Readers and writers on small hand-made files."""

from __future__ import annotations

import datetime
import gzip
import zipfile

import pytest

from timetide.sources import czptt, gtfs, jdf, realtime

D = datetime.date


def record(*cols):
    return '"' + '","'.join(cols) + '";\r\n'


def write_batch(put, version="1.11"):
    """The files of one batch: put(name, bytes)."""
    new = version == "1.11"
    old = version in ("1.8", "1.9")
    files = {
        "VerzeJDF.txt": record(version, "", "", "", "01012024", "x"),
        "Zastavky.TXT": record("1", "Příbor", "", 'u "lípy"', "", "CZ", *(["2"] + [""] * 5)) + "\r\n" + record("2", "Brno", "", "", "", "", *[""] * 6) if not old else record("1", "Příbor", "", "x", *[""] * 6),
        "Dopravci.txt": record("11", "", "Dopravce", "1", "", "", "", "", "", "", "", "www.a.cz", *([] if old else ["1"])),
        "Linky.txt": record(*(["100001", "Linka", "11", "A", "A", "0", "0", "0", *(["0"] if new else []), "", "", "", "", "01012024", "", "1", "1"] if not old else ["100001", "Linka", "11", "A", "", "", "", "", "01012024", "31122024"])),
        "Spoje.txt": record("100001", "1", "1", *[""] * 9, *([] if old else ["", "1"])),
        "Zasspoje.txt": record(*(["100001", "1", "1", "1", "", "", "", "", "0", "", "0615", *(["", ""] if new else []), "1"] if not old else ["100001", "1", "1", "1", "", "", "0", "", "0615"])) + (record("100001", "1", "2", "2", "", "", "", "", "12.5", "|", "<", *(["", ""] if new else []), "1") if not old else ""),
        "Pevnykod.txt": record("1", "X", "") + record("2", "@", ""),
        "Caskody.txt": record(*(["100001", "1", "1", "10", "1", "05012024", "", "", "1"] if not old else ["100001", "1", "1", "10", "4", "05012024", "", ""])),
        "Zaslinky.txt": "",
    }
    for name, text in files.items():
        put(name, text.encode("cp1250"))


@pytest.fixture(scope="module")
def batches(tmp_path_factory):
    root = tmp_path_factory.mktemp("jdf")
    (root / "one").mkdir()
    write_batch(lambda n, b: (root / "one" / n).write_bytes(b))
    for name, version in (("two.zip", "1.10"), ("three.zip", "1.8")):
        with zipfile.ZipFile(root / name, "w") as z:
            write_batch(z.writestr, version)
    return root


def test_jdf_layouts(spark, batches):
    t = jdf.read_jdf(spark, str(batches))
    assert t["version"].count() == 3
    stops = {(r["batch_id"].rpartition("/")[2], r["stop_id"]): r for r in t["stops"].collect()}
    assert stops["one", 1]["town"] == "Příbor" and stops["one", 1]["place"] == 'u "lípy"' and stops["one", 1]["attributes"] == [2] and stops["one", 2]["country"] is None
    assert len(stops) == 5 and stops["three.zip", 1]["region"] is None
    routes = {r["batch_id"].rpartition("/")[2]: r for r in t["routes"].collect()}
    assert routes["one"]["valid_from"] == D(2024, 1, 1) and routes["one"]["valid_to"] == D(3000, 1, 1)
    assert routes["two.zip"]["one_way"] is False and routes["three.zip"]["mode"] == "A" and routes["three.zip"]["dist"] == 0 and routes["three.zip"]["valid_to"] == D(2024, 12, 31)
    times = {(r["batch_id"].rpartition("/")[2], r["route_stop_id"]): r for r in t["trip_stops"].collect()}
    assert (times["one", 1]["dep_kind"], times["one", 1]["dep_sec"], times["one", 1]["arr_kind"]) == ("time", 22_500, None)
    assert (times["one", 2]["arr_kind"], times["one", 2]["dep_kind"], times["one", 2]["dep_sec"]) == ("pass", "notpass", None)
    notes = {r["batch_id"].rpartition("/")[2]: r for r in t["service_notes"].collect()}
    assert notes["one"]["note_type"] == 1 and notes["three.zip"]["note_type"] == 4 and notes["one"]["date_from"] == D(2024, 1, 5)


def test_jdf_round_trip(spark, batches, tmp_path):
    t = jdf.read_jdf(spark, str(batches / "one"))
    assert jdf.write_jdf(t, str(tmp_path / "out")).count() >= 8
    again = jdf.read_jdf(spark, str(tmp_path / "out"))
    for name in ("stops", "routes", "trips", "trip_stops", "service_notes", "attribute_refs"):
        plain = lambda df: sorted(map(repr, df.drop("batch_id").collect()))
        assert plain(t[name]) == plain(again[name]), name


def test_gtfs_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda n, s: (tmp_path / "in" / f"{n}.txt").write_text(s)
    put("agency", 'agency_id,agency_name,agency_url,agency_timezone\n1,"A, ""B""",http://a,Europe/Prague\n')
    put("stops", "stop_id,stop_name,stop_lat,stop_lon\nS1,One,50.1,14.2\n")
    put("routes", "route_id,route_type\nR,701\n")
    put("trips", "route_id,service_id,trip_id\nR,X,T\n")
    put("stop_times", "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT,25:10:00,25:11:00,S1,0\n")
    put("feedinfo", "feed_publisher_name,feed_publisher_url,feed_lang\nme,http://m,cs\n")
    feed = gtfs.read_gtfs(spark, str(tmp_path / "in"))
    assert "calendar" not in feed and feed["feed_info"].count() == 1
    assert feed["agency"].first()["agency_name"] == 'A, "B"' and feed["agency"].first()["agency_phone"] is None
    assert feed["stop_times"].first()["arrival_time"] == 90_600
    gtfs.write_gtfs(feed, str(tmp_path / "out"))
    again = gtfs.read_gtfs(spark, str(tmp_path / "out"))
    for name, df in feed.items():
        assert df.collect() == again[name].collect(), name
    put("routes", "route_id\nR\n")
    with pytest.raises(ValueError, match="route_type"):
        gtfs.read_gtfs(spark, str(tmp_path / "in"))


def test_written_feed_is_compressed(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id % 3 as batch_id", "concat('CIST-', id) as trip_id", "3600 as arrival_time", "3600 as departure_time", "'JDFS-1' as stop_id", "0 as stop_sequence")
    gtfs.write_gtfs({"stop_times": rows}, str(tmp_path))
    files = [f for f in tmp_path.rglob("part-*") if f.is_file()]
    assert files and sum(f.stat().st_size for f in files) < 20_000 * 20
    assert spark.read.option("header", True).csv(str(tmp_path / "stop_times.txt")).count() == 20_000


TIMETABLE = """<?xml version="1.0"?><CZPTTCISMessage><Identifiers><PlannedTransportIdentifiers><ObjectType>TR</ObjectType><Core>9</Core></PlannedTransportIdentifiers>
<PlannedTransportIdentifiers><ObjectType>PA</ObjectType><Company>54</Company><Core>KADR-1</Core><Variant>01</Variant><TimetableYear>2024</TimetableYear></PlannedTransportIdentifiers></Identifiers>
<CZPTTInformation><CZPTTLocation><Location><CountryCodeISO>CZ</CountryCodeISO><LocationPrimaryCode>54321</LocationPrimaryCode><PrimaryLocationName>Brno</PrimaryLocationName></Location>
<TimingAtLocation><Timing TimingQualifierCode="ALD"><Time>23:50:00.0+01:00</Time><Offset>0</Offset></Timing></TimingAtLocation><ResponsibleRU>1154</ResponsibleRU><OperationalTrainNumber>77</OperationalTrainNumber><TrainType>1</TrainType><TrafficType>Os</TrafficType><TrainActivity><TrainActivityType>0001</TrainActivityType></TrainActivity></CZPTTLocation>
<CZPTTLocation><Location><CountryCodeISO>CZ</CountryCodeISO><LocationPrimaryCode>54322</LocationPrimaryCode><PrimaryLocationName>Tišnov</PrimaryLocationName></Location><TimingAtLocation><Timing TimingQualifierCode="ALA"><Time>00:20:00</Time><Offset>1</Offset></Timing></TimingAtLocation><TrainType>1</TrainType><TrainActivity><TrainActivityType>0001</TrainActivityType></TrainActivity></CZPTTLocation>
<PlannedCalendar><BitmapDays>1101</BitmapDays><ValidityPeriod><StartDateTime>2024-01-01T00:00:00</StartDateTime><EndDateTime>2024-01-04T00:00:00</EndDateTime></ValidityPeriod></PlannedCalendar></CZPTTInformation></CZPTTCISMessage>"""
CANCELLATION = """<?xml version="1.0"?><CZCanceledPTTMessage><PlannedTransportIdentifiers><ObjectType>PA</ObjectType><Core>KADR-1</Core><Variant>01</Variant><TimetableYear>2024</TimetableYear></PlannedTransportIdentifiers>
<PlannedCalendar><BitmapDays>01</BitmapDays><ValidityPeriod><StartDateTime>2024-01-01T00:00:00</StartDateTime></ValidityPeriod></PlannedCalendar></CZCanceledPTTMessage>"""


def test_czptt(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.xml").write_text(TIMETABLE)
    (tmp_path / "deep" / "b.xml.zip").write_bytes(gzip.compress(CANCELLATION.encode()))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x.xml", TIMETABLE)
        z.writestr("y.xml", CANCELLATION)
    timetables, locations, cancellations = czptt.read_czptt(spark, str(tmp_path))
    assert timetables.count() == 2 and cancellations.count() == 2
    t = timetables.first()
    assert (t["year"], t["core"], t["variant"], t["start"], t["bitmap"]) == (2024, "KADR-1", "01", D(2024, 1, 1), "1101")
    rows = locations.where("message_id like '%a.xml'").orderBy("pos").collect()
    assert [(r["code"], r["name"], r["dep_sec"], r["arr_sec"], r["arr_offset"]) for r in rows] == [("54321", "Brno", 85_800, None, None), ("54322", "Tišnov", None, 1200, 1)]
    (tmp_path / "z.xml").write_text("<Other/>")
    with pytest.raises(Exception, match="no known message"):
        czptt.read_czptt(spark, str(tmp_path))[0].collect()


def test_czptt_reads_each_message_once(spark):
    """However the messages are made: joined ones too are parsed where they are exploded, and nowhere else."""
    ids = spark.createDataFrame([("a",)], "message_id string")
    texts = spark.createDataFrame([("a", "timetable", TIMETABLE)], "message_id string, kind string, xml string").join(ids.hint("merge"), "message_id")
    located = czptt.parse_messages(texts)[1]
    assert [r["pos"] for r in located.orderBy("pos").collect()] == [0, 1]
    assert located._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1


def test_realtime_json(spark):
    geo = '{"features":[{"geometry":{"coordinates":[14.5,50.1],"type":"Point"},"properties":{"stop_id":"U1","stop_name":"Anděl"}}]}'
    trains = '{"Status":"ok","Trains":[{"Id":7,"GPS":[50.0,14.0],"Title":"Os 1234 Praha - Brno"}]}'
    texts = lambda s: spark.createDataFrame([(s,)], "json string")
    assert tuple(realtime.stops_from_geojson(texts(geo)).first()) == ("-PIDS-U1", "Anděl", 50.1, 14.5)
    assert tuple(realtime.train_summary(texts(trains)).first()) == (7, "Os-1234", 50.0, 14.0)
    snap = '{"md":"05.01.2024 10:00:00","success":true,"result":[{"type":"Feature","properties":{"id":"x/1/2/3/4/20240105","tt":"Os","tn":"1234","na":"","cna":"Brno","de":2,"cp":"10:05","cr":"","rr":1}}]}'
    messages = [(7, snap), (8, snap.replace("10:05", "25:05")), (9, snap.replace("05.01", "35.01")), (10, "nothing"), (11, None), (12, '{"md":"05.01.2024 10:00:00","result":[]}')]
    rows, rejects = realtime.train_snapshots(spark.createDataFrame(messages, "seq long, json string"))
    assert [tuple(r) for r in rows.collect()] == [(7, datetime.datetime(2024, 1, 5, 10), "x/1/2/3/4/20240105", "Brno", True, 36_300, None, "Os 1234 ")]
    assert sorted((r["seq"], r["reason"]) for r in rejects.collect()) == [(8, "train without id or times"), (9, "time of the response"), (10, "no response"), (11, "no response")]


def vehicle(trip="t", kind=0, start="2024-06-30T22:30:00.000Z", positions=None, **last):
    """A trip as the source gives it."""
    stop = dict(id="U1", sequence=3, arrival_time="2024-07-01T09:50:00.000Z", departure_time="2024-07-01T09:51:00.000Z") | last
    at = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [14.0, 50.0]}, "properties": {"origin_timestamp": "2024-07-01T10:00:00.000Z", "last_stop": stop, "delay": {"actual": 60, "last_stop_arrival": None, "last_stop_departure": 60}}}
    trip = {"gtfs": {"trip_id": trip, "route_id": "L9", "route_short_name": "9"}, "cis": {"line_id": "none", "trip_number": 1042}, "vehicle_type": None if kind is None else {"id": kind, "description_en": "bus"}, "start_timestamp": start}
    return {"type": "Feature", "geometry": at["geometry"], "properties": {"trip": trip, "all_positions": {"type": "FeatureCollection", "features": [at, at] if positions is None else positions}}}


def test_vehicle_positions(spark):
    import json

    response = lambda *trips: json.dumps({"type": "FeatureCollection", "features": trips})
    unplaced = [{"geometry": {"coordinates": [14.0]}, "properties": {"origin_timestamp": "2024-07-01T10:00:00.000Z", "last_stop": {}, "delay": {}}}]
    rows = [
        (1, response(vehicle(), vehicle("train", None), vehicle("three", 3, sequence=None, arrival_time=None))), (2, response(vehicle(None), vehicle("late", start="2024-06-30 22:30"), vehicle("empty", positions=[]))),
        (3, response(vehicle("a", arrival_time=None), vehicle("b", positions=unplaced), vehicle("c", id=None))), (4, "{}"), (5, "<html>"), (6, None), (7, response()),
    ]
    coords, stops, details, rejected = realtime.process_positions(spark.createDataFrame(rows, "seq long, json string"))
    c = {r["trip_id"]: r for r in coords.collect()}
    assert c.keys() == {"-PIDT-t", "-PIDT-three"} and c["-PIDT-t"]["lat"] == 50.0 and c["-PIDT-t"]["lon"] == 14.0
    assert c["-PIDT-t"]["trip_start_date"] == D(2024, 7, 1) and c["-PIDT-t"]["observation_time"].astimezone(datetime.UTC).replace(tzinfo=None) == datetime.datetime(2024, 7, 1, 10)
    (s,) = stops.collect()
    at = lambda h, m: datetime.datetime(2024, 7, 1, h, m)
    assert (s["stop_id"], s["trip_stop_index"], s["arrived_at"], s["should_arrive_at"], s["departed_at"], s["should_depart_at"]) == ("-PIDS-U1", 3, at(11, 51), at(11, 50), at(11, 52), at(11, 51))
    assert {(r["trip_id"], r["route_id"], r["short_name"], r["route_short_name"]) for r in details.collect()} == {(f"-PIDT-{t}", "-PIDT-L9", "9 (1042)", "9") for t in ("t", "three", "empty")}
    assert sorted((r["seq"], r["item"] or "", r["reason"]) for r in rejected.collect()) == [
        (2, "0", "no ids"), (2, "late", "start time"), (3, "a", "last stop without id or times"), (3, "b", "position without time or place"), (3, "c", "last stop without id or times"),
        (4, "", "no response"), (5, "", "no response"), (6, "", "no response"),
    ]
    trains = realtime.process_positions(spark.createDataFrame(rows[:1], "seq long, json string"), no_trains=False)[2]
    assert {r["trip_id"] for r in trains.collect()} == {"-PIDT-t", "-PIDT-three", "-PIDT-train"}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        again = realtime.process_positions(spark.createDataFrame(rows[:1], "seq long, json string"))
        assert again[1].first()["arrived_at"] == at(11, 51) and again[2].first()["trip_start_date"] == D(2024, 7, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_dimensions(spark, tmp_path):
    (tmp_path / "n.txt").write_text('"Praha"\nBrno\n\n')
    (tmp_path / "s.txt").write_text("nám.,náměstí # square\n# nothing\nul.,ulice\n")
    assert sorted(r[0] for r in realtime.read_names(spark, str(tmp_path / "n.txt")).collect()) == ["Brno", "Praha"]
    assert realtime.read_synonyms(spark, str(tmp_path / "s.txt")).count() == 4
    (tmp_path / "p.json").write_text('{"features":[{"properties":{"name":"A","region":"PH"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}}]}')
    p = realtime.read_polygons(spark, str(tmp_path / "p.json")).first()
    assert p["name"] == "A" and len(p["ring"]) == 4


def test_polygons_with_holes_and_parts(spark, tmp_path):
    from pyspark.sql import functions as F

    from timetide.functions.geo import towns_of_points

    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    features = [
        {"properties": {"name": "around", "region": "R"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 10), square(4, 6)]}},
        {"properties": {"name": "enclave", "region": "R"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(4, 6)], [square(20, 21)]]}},
    ]
    import json

    (tmp_path / "p.json").write_text(json.dumps({"features": features}))
    polygons = realtime.read_polygons(spark, str(tmp_path / "p.json"))
    points = spark.createDataFrame([(1, 5.0, 5.1), (2, 1.0, 1.5), (3, 20.5, 20.4), (4, 15.0, 15.5), (5, 7.0, 5.1)], "id int, x double, y double")
    got = {r["id"]: r["name"] for r in towns_of_points(points, polygons, ["id"], 1.0).select("id", F.col("name")).collect()}
    assert got == {1: "enclave", 2: "around", 3: "enclave", 4: None, 5: "around"}


def test_jdf_large_file_in_parts(spark, batches, tmp_path, monkeypatch):
    monkeypatch.setattr(jdf, "PART_LINES", 1)
    t = jdf.read_jdf(spark, str(batches / "one"))
    jdf.write_jdf(t, str(tmp_path / "out")).collect()
    again = jdf.read_jdf(spark, str(tmp_path / "out"))
    for name in ("stops", "trip_stops", "attribute_refs"):
        assert sorted(map(repr, t[name].drop("batch_id").collect())) == sorted(map(repr, again[name].drop("batch_id").collect())), name


def test_merge_of_whole_batches(spark, tmp_path):
    """Two batches of one line: a later plain version cuts the earlier one; stops, agencies and attributes meet."""
    from pyspark.sql import functions as F

    from timetide.operators.merging import merge_jdf

    for n, (first, last, created, extra) in enumerate((("01012024", "31122024", "01122023", "Olomouc"), ("01062024", "31122024", "01052024", "Zlín"))):
        folder = tmp_path / "in" / f"b{n}"
        folder.mkdir(parents=True)
        put = lambda name, text: (folder / name).write_bytes(text.encode("cp1250"))  # noqa: B023,E731
        put("verzejdf.txt", record("1.11", "", "", "", created, "x"))
        put("zastavky.txt", record("1", "Brno", "", "", "", "CZ", str(n + 5), *[""] * 5) + record("2", extra, "", "", "", "CZ", *[""] * 6))
        put("dopravci.txt", record("11", "", "Dopravce", *[""] * 9, "1"))
        put("linky.txt", record("100001", f"Linka {n}", "11", "A", "A", *["0"] * 4, "", "", "", "", first, last, "1", "1"))
        put("spoje.txt", record("100001", "1", str(n + 5), *[""] * 9, "7", "1"))
        put("spojskup.txt", record("7", "", ""))
        put("zasspoje.txt", record("100001", "1", "1", "1", "", "", "", "", "0", "", "0615", "", "", "1") + record("100001", "1", "2", "2", "", "", "", "", "9", "0630", "", "", "", "1"))
        put("pevnykod.txt", record(str(n + 5), "X", ""))
        put("polzast.txt", record("1", "49.2", "16.6", "S"))
    t = jdf.read_jdf(spark, str(tmp_path / "in"))
    merged = merge_jdf(t, F.lit(D(2024, 6, 2)))
    assert merged.pop("location_warnings").count() == 0
    jdf.write_jdf(merged, str(tmp_path / "out")).collect()
    back = jdf.read_jdf(spark, str(tmp_path / "out"))
    rows = lambda n, *c: sorted(tuple(r) for r in back[n].select(*c).collect())
    assert rows("version", "version", "created") == [("1.11", D(2024, 6, 2))]
    assert rows("stops", "stop_id", "town", "attributes") == [(1, "Brno", [1]), (2, "Olomouc", []), (3, "Zlín", [])]
    assert rows("routes", "dist", "valid_from", "valid_to", "agency_dist") == [(1, D(2024, 1, 1), D(2024, 5, 31), 1), (2, D(2024, 6, 1), D(2024, 12, 31), 1)]
    assert rows("trip_stops", "dist", "route_stop_id", "stop_id") == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 3)]
    assert rows("trips", "dist", "group_id", "attributes") == [(1, 1, [1]), (2, 2, [1])]
    assert rows("trip_groups", "group_id") == [(1,), (2,)] and len(rows("agencies", "agency_id")) == 1
    assert [(r[0], round(float(r[1]), 4), round(float(r[2]), 4)) for r in back["stop_locations"].select("stop_id", "lat", "lon").collect()] == [(1, 49.2, 16.6)]
