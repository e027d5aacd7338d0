"""Batches that cannot be converted or merged: what is wrong with each, and the tables without them.

Thousands of batches share one job, and one that is broken must not stop the others. The checks are anti-joins and
validity columns over all batches at once; their result (REJECTS) has a row per batch, step and reason. What is left
meets everything that the strict operators demand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetide.functions.lineage import cut
from timetide.operators import merging, timetable

#: item: the least example as JSON, n: how many rows.
REJECTS = ["batch_id", "step", "reason", "item", "n"]
ROUTE = ["batch_id", "route_id", "dist"]


def counted(rows: DataFrame, step: str, reason: str, *item: str | Column) -> DataFrame:
    """A reject per batch of rows."""
    return rows.groupBy("batch_id").agg(F.min(F.to_json(F.struct(*item))).alias("item"), F.count("*").alias("n")).select("batch_id", F.lit(step).alias("step"), F.lit(reason).alias("reason"), "item", "n")


def missing_keys(rows: DataFrame, known: DataFrame, keys: list[str], step: str, what: str) -> DataFrame:
    """Rejects of the rows of which the key is not in known."""
    return counted(rows.join(known.select(*keys).distinct(), keys, "left_anti"), step, f"{what} not found", *keys[1:])


def unknown_attributes(rows: DataFrame, refs: DataFrame, step: str) -> DataFrame:
    used = rows.select("batch_id", F.explode("attributes").alias("attribute_id")).where("attribute_id is not null")
    return missing_keys(used, refs, ["batch_id", "attribute_id"], step, "attribute")


def contradictory_times(trip_stops: DataFrame) -> DataFrame:
    """Stops that are served on departure, or have none, but passed on arrival."""
    served = ~F.coalesce(F.col("dep_kind").isin("pass", "notpass"), F.lit(False))
    rows = trip_stops.where(served & F.col("arr_kind").isin("pass", "notpass")) if "arr_kind" in trip_stops.columns else trip_stops.limit(0)
    return counted(rows, "trip_stops", "arrival passed, departure not", "route_id", "dist", "trip_id", "route_stop_id")


def _shared_checks(t: dict[str, DataFrame]) -> list[DataFrame]:
    return [
        missing_keys(t["trips"], t["routes"], ROUTE, "trips", "route"),
        missing_keys(t["trip_stops"], t["stops"], ["batch_id", "stop_id"], "trip_stops", "stop"),
        missing_keys(t["stop_posts"], t["stops"], ["batch_id", "stop_id"], "stop_posts", "stop"),
        *[unknown_attributes(t[n], t["attribute_refs"], n) for n in ("stops", "trips", "trip_stops")],
    ]


def conversion_rejects(t: dict[str, DataFrame]) -> DataFrame:
    """REJECTS of batches that timetable.jdf_to_gtfs could not convert."""
    more = [missing_keys(t["trip_stops"], t["route_stops"], [*ROUTE, "route_stop_id"], "trip_stops", "route stop"), contradictory_times(t["trip_stops"])]
    return reduce(DataFrame.unionByName, [*_shared_checks(t), *more])


def merging_rejects(t: dict[str, DataFrame]) -> DataFrame:
    """REJECTS of batches that merging.merge_jdf could not re-key."""
    more = [
        missing_keys(t["routes"], t["agencies"], ["batch_id", "agency_id", "agency_dist"], "routes", "agency"),
        missing_keys(t["route_stops"], t["stops"], ["batch_id", "stop_id"], "route_stops", "stop"),
    ]
    if "trip_groups" in t:
        more.append(missing_keys(t["trips"].where("group_id is not null"), t["trip_groups"], ["batch_id", "group_id"], "trips", "trip group"))
    return reduce(DataFrame.unionByName, [*_shared_checks(t), *more])


def without(t: dict[str, DataFrame], rejects: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rejected batches."""
    gone = rejects.select("batch_id").distinct()
    return {name: df.join(gone, "batch_id", "left_anti").select(*df.columns) for name, df in t.items()}


def convert(t: dict[str, DataFrame], holidays: DataFrame, **options) -> tuple[dict[str, DataFrame], DataFrame]:
    """(jdf_to_gtfs of the batches that can be converted, REJECTS of the others)."""
    rejects = cut(conversion_rejects(t))
    return timetable.jdf_to_gtfs(without(t, rejects), holidays, **options), rejects


def merge(t: dict[str, DataFrame], created: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """(merge_jdf of the batches that can be merged, REJECTS of the others)."""
    rejects = cut(merging_rejects(t))
    return merging.merge_jdf(without(t, rejects), created), rejects
