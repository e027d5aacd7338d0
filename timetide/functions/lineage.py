"""Cutting long plans, and numbering rows without gathering them."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of each side that meet in one cell of spread_join(), and pairs that one of its tasks makes.
CELL, PAIRS = 500, 16_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; on a cluster it is an error, for a
    folder of the driver is not one of the executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written to the shared folder and read back: a lost executor loses none of it."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by a key of many values, in which it is never broadcast.

    Spark judges a written table by its files, and those of rows that repeat themselves are a twentieth of the
    rows and less: it would gather them on the driver."""
    return df.hint("merge")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], cell: int = CELL, pairs: int = PAIRS) -> DataFrame:
    """Inner join by keys of which few may have most rows on both sides; both sides are read twice.

    With more than `pairs` pairs a key's rows are dealt by their hash into blocks of about `cell` rows, and each pair of blocks
    is a key of its own: what a task holds does not grow with a key, and no more tasks' work goes to one than to others."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = cut(count(left, "_l").join(count(right, "_r"), keys))
    total = sizes.agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
    if total <= pairs:
        return shuffled(left).join(right, keys)
    blocks = sizes.select(*keys, *[F.ceil(F.col(c) / cell).cast("int").alias(c) for c in ("_l", "_r")])

    def dealt(df: DataFrame, own: str, mine: str, other: str, its: str) -> DataFrame:
        rows = df.join(shuffled(blocks), keys).withColumn(own, F.pmod(F.xxhash64(*df.columns), F.col(mine)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(its) - 1))).select(*df.columns, "_i", "_j")

    on = [*keys, "_i", "_j"]
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / pairs))
    a, b = dealt(left, "_i", "_l", "_j", "_r"), dealt(right, "_j", "_r", "_i", "_l")
    return a.repartition(tasks, *on).join(shuffled(b.repartition(tasks, *on)), on).drop("_i", "_j")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`: each row's number, from 1, in the total order of the given columns.

    Rows are ranged, numbered inside their range and moved by the ranges' counts, so that no task holds
    more than a range; only one count per range comes together."""
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
