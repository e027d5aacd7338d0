"""Railway timetable messages: XML, plain, gzip'd or in zips."""

from __future__ import annotations

import gzip
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = """Identifiers struct<PlannedTransportIdentifiers:array<struct<ObjectType:string, Company:string, Core:string, Variant:string, TimetableYear:int, StartDate:string>>>,
  CZPTTInformation struct<CZPTTLocation:array<struct<Location:struct<CountryCodeISO:string, LocationPrimaryCode:string, PrimaryLocationName:string, LocationSubsidiaryIdentification:struct<LocationSubsidiaryCode:string>>,
    TimingAtLocation:struct<Timing:array<struct<_TimingQualifierCode:string, Time:string, Offset:int>>>, ResponsibleRU:string, OperationalTrainNumber:string, TrainType:string, TrafficType:string, CommercialTrafficType:string,
    TrainActivity:array<struct<TrainActivityType:string>>>>, PlannedCalendar:struct<BitmapDays:string, ValidityPeriod:struct<StartDateTime:string, EndDateTime:string>>>,
  PlannedTransportIdentifiers array<struct<ObjectType:string, Company:string, Core:string, Variant:string, TimetableYear:int, StartDate:string>>,
  PlannedCalendar struct<BitmapDays:string, ValidityPeriod:struct<StartDateTime:string, EndDateTime:string>>"""


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """message_id, kind ('timetable', 'cancellation', else 'unknown'), xml of every message below the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            out = []
            for name, data in zip(pdf["path"], pdf["content"]):
                if data[:2] == b"\x1f\x8b":
                    parts = [(name, gzip.decompress(data))]
                elif data[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        parts = [(f"{name}!{n}", z.read(n)) for n in z.namelist() if n.lower().endswith(".xml")]
                else:
                    parts = [(name, data)] if name.lower().endswith(".xml") else []
                for part, body in parts:
                    text = body.decode("utf-8-sig")
                    kind = "cancellation" if "<CZCanceledPTTMessage" in text else "timetable" if "<CZPTTCISMessage" in text else "unknown"
                    out.append((part, kind, text))
            yield pd.DataFrame(out, columns=["message_id", "kind", "xml"])

    return files.mapInPandas(run, "message_id string, kind string, xml string")


def _seconds(time):
    part = lambda i: F.substring(time, i, 2).cast("int")
    return part(1) * 3600 + part(4) * 60 + part(7)


def read_czptt(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """parse_messages() of every message below the path."""
    return parse_messages(read_texts(spark, path), strict)


def message_rejects(texts: DataFrame) -> DataFrame:
    """message_id, reason of the texts that are neither kind of message."""
    return texts.where("kind = 'unknown'").select("message_id", F.lit("no known message").alias("reason"))


def parse_messages(texts: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(timetables, locations, cancellations) in the columns that operators.rail and operators.calendars take; a message of neither kind is an error, or, if not strict, left out (message_rejects has it)."""
    sure = F.when(F.col("kind") == "unknown", F.raise_error(F.concat(F.lit("no known message: "), "message_id")) if strict else None).otherwise(F.col("kind"))
    parsed = texts.withColumn("kind", sure).select("message_id", "kind", F.from_xml("xml", MESSAGE, {"attributePrefix": "_"}).alias("m"))
    ids = F.coalesce("m.Identifiers.PlannedTransportIdentifiers", "m.PlannedTransportIdentifiers")
    path_id = F.get(F.filter(ids, lambda i: i["ObjectType"] == "PA"), F.lit(0))
    calendar = F.coalesce("m.CZPTTInformation.PlannedCalendar", "m.PlannedCalendar")
    head = parsed.select("message_id", "kind", path_id.alias("p"), calendar.alias("c"), F.col("m.CZPTTInformation.CZPTTLocation").alias("l"))
    facts = head.select("message_id", "kind", F.col("p.TimetableYear").alias("year"), F.col("p.Core").alias("core"), F.col("p.Variant").alias("variant"), F.to_date(F.substring("c.ValidityPeriod.StartDateTime", 1, 10)).alias("start"), F.col("c.BitmapDays").alias("bitmap"))
    # outer: for an inner one Spark tests the array's size further down, and each test reads the whole XML again
    locations = head.where("kind = 'timetable'").select("message_id", F.posexplode_outer("l").alias("pos", "x")).where("pos is not null")
    timing = lambda q: F.get(F.filter("x.TimingAtLocation.Timing", lambda t: t["_TimingQualifierCode"] == q), F.lit(0))
    located = locations.select(
        "message_id", "pos", F.col("x.Location.CountryCodeISO").alias("country"), F.col("x.Location.LocationPrimaryCode").alias("code"), F.col("x.Location.PrimaryLocationName").alias("name"),
        F.col("x.Location.LocationSubsidiaryIdentification.LocationSubsidiaryCode").alias("platform"), F.col("x.ResponsibleRU").alias("company"), F.col("x.CommercialTrafficType").alias("commercial"), F.col("x.TrafficType").alias("traffic"),
        F.col("x.OperationalTrainNumber").alias("train_no"), F.col("x.TrainType").alias("train_type"), F.lit(None).cast("string").alias("train_name"), F.coalesce(F.transform("x.TrainActivity", lambda a: a["TrainActivityType"]), F.array().cast("array<string>")).alias("activities"),
        _seconds(timing("ALA")["Time"]).alias("arr_sec"), _seconds(timing("ALD")["Time"]).alias("dep_sec"), timing("ALA")["Offset"].alias("arr_offset"), timing("ALD")["Offset"].alias("dep_offset"),
    )
    return facts.where("kind = 'timetable'").drop("kind"), located, facts.where("kind = 'cancellation'").drop("kind")
