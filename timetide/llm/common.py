"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timetide.functions.lineage import shared_dir

#: Words are runs of anything but ASCII white space, in SQL regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by saved() that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """What is run inside gives Python at most so many rows at once: long texts of more would stand in memory several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo a small number: the split into folds."""
    return F.crc32(doc_id.cast("string")) % modulus


#: Buckets whose totals are summed up in one task.
SPAN = 1024


def running_offsets(counts: DataFrame, group: list[str], order: str, size: str) -> DataFrame:
    """Exclusive running sum of `size` over `order` (whole numbers) inside `group`, for a table of per-bucket totals.

    Spans of SPAN buckets are summed up apart; only one total per span comes together."""
    spans = counts.withColumn("_span", F.floor(F.col(order) / SPAN))
    totals = spans.groupBy(*group, "_span").agg(F.sum(size).alias("_total"))
    upto = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_span", F.coalesce(F.sum("_total").over(upto(group, "_span")), F.lit(0)).alias("_start"))
    inside = spans.withColumn("_inside", F.coalesce(F.sum(size).over(upto([*group, "_span"], order)), F.lit(0)))
    return inside.join(starts, [*group, "_span"]).withColumn("before", (F.col("_start") + F.col("_inside")).cast("long")).drop("_span", "_start", "_inside")


#: Bytes of a text whose words are hashed at once.
_SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _hash_tables() -> dict[str, np.ndarray]:
    """A random number per byte (A-Z as a-z), white space, and the powers of an odd base and of its inverse."""
    if not _tables:
        of = np.random.default_rng(77).integers(1, 2**64, 256, dtype=np.uint64)
        of[65:91] = of[97:123]
        space = np.zeros(256, dtype=bool)
        space[[32, *range(9, 14)]] = True
        powers = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_SLICE - 1, b % 2**64, dtype=np.uint64))), dtype=np.uint64)
        _tables.update(of=of, space=space, powers=powers(_BASE), inverse=powers(pow(_BASE, -1, 2**64)))
    return _tables


def word_hashes(text: str | None) -> np.ndarray:
    """63-bit hashes of the words of a text in order, A-Z read as a-z.

    A word's hash is the sum of a random number of each byte times the powers of a base, modulo 2^64, mixed:
    all words of a text come from one running sum. Words longer than a slice are hashed one by one."""
    data = (text or "").encode()
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _SLICE)
        if end < len(data):  # up to the last white space, or over one long word
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at and not data[at : at + 1].isspace():
                word = data[at:].split(None, 1)[0]
                short = len(word) <= _SLICE
                out.append(_slice_hashes(np.frombuffer(word, dtype=np.uint8)) if short else np.array([xxhash.xxh3_64_intdigest(word.lower()) >> 1], dtype=np.uint64))
                at += len(word)
                continue
            end = max(cut, at + 1)
        out.append(_slice_hashes(np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _slice_hashes(b: np.ndarray) -> np.ndarray:
    t = _hash_tables()
    space = t["space"][b]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    begins, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(t["of"][b] * t["powers"][: len(b)], out=sums[1:])
    h = (sums[ends] - sums[begins]) * t["inverse"][begins]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h >> np.uint64(1)
