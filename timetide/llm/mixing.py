"""Mixing sources to target weights along a low-discrepancy schedule.

Sources, in code-point order with null last, weigh 5, 2, 1, repeating, and share as many words as
there are. A target stops at `max_repeats` times its source's size and the excess is shared again by
weight. Slot i of the schedule is the golden-ratio point frac((i + 1) * phi); the cumulative shares of
the targets map it to a source, and the slot's rank among the slots of its source picks that source's
next block. A source's blocks are `block` words each (the last may be shorter), cut from its documents
in an order shuffled by hash, and are taken again from the start when they run out; the last slot of a
source takes only the words that its target still lacks.

Everything is DataFrame code. Ranks and running sums are two-level (within buckets of bounded size,
then over bucket totals), so that a source with a third of all rows is spread like any other.

Edge cases: null text has size 0; a null source is a source; documents of size 0 are taken 0 times;
with no words at all every target is 0. Repeated rows are documents of their own, in any order (equal
rows share their takings alike up to one block). Reruns agree, since all orders are by hash and id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timetide.llm.common import WORD, running_offsets, saved, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 128
BUCKET_ROWS = 500
CELLS = 1024
PHI = (math.sqrt(5) - 1) / 2
SEED = 99


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h (a hash that shuffles)."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(SEED), "doc_id", "source").alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_no, weight, source_size, target: one row per source.

    The shares are level: target = least(max_repeats * size, level * weight), with the level that uses
    up all words. In order of max_repeats * size / weight the level over the sources not yet at their
    limit falls out of running sums, so no loop is needed."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("source_no", no)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.lit(float(max_repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    per = per.withColumn("level", rest / F.sum("weight").over(after))
    per = per.withColumn("ok", F.col("limit") / F.col("weight") >= F.col("level"))
    first = F.min(F.when(F.col("ok"), F.struct((F.col("limit") / F.col("weight")).alias("r"), "source_no", "level"))).over(every)
    per = per.withColumn("target", F.least("limit", F.coalesce(first["level"], F.lit(0.0)) * F.col("weight")))
    return per.select("source", "source_no", "weight", F.col("source_size").cast("long"), "target")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source_no, rank, block_no, start, stop (on the source's word line) of every slot.

    A source's share of the points is the number of slots that its target needs. Points err by a few
    slots for a source: those beyond its need stay unused, those that it lacks come at the end."""
    size = F.col("source_size")
    aim = F.round("target").cast("long")
    blocks = F.ceil(size / block)
    share = targets.where("source_size > 0").withColumn("aim", aim).where("aim > 0")
    share = share.select("source_no", "source_size", "aim", blocks.alias("blocks"), (F.floor(F.col("aim") / size) * blocks + F.ceil((F.col("aim") % size) / block)).alias("need"))
    slots = int(share.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0])
    by_no = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)  # one row per source
    share = share.withColumn("hi", F.sum("need").over(by_no))
    parts = share.withColumn("lo", (F.col("hi") - F.col("need")) / F.lit(float(slots or 1))).withColumn("hi", F.col("hi") / F.lit(float(slots or 1)))

    # intervals and points meet in cells of equal width, so that the join is an equi-join
    ends = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))
    cells = parts.withColumn("cell", F.explode(ends)).select("cell", "lo", "hi", "source_no")
    at = (F.col("id") + 1) * F.lit(PHI)
    points = targets.sparkSession.range(slots).select(F.col("id").alias("slot"), (at - F.floor(at)).alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    picked = points.join(cells, "cell").where("lo <= point and point < hi").select("slot", "source_no", F.floor(F.col("slot") / BUCKET_ROWS).alias("bucket"))
    counts = picked.groupBy("source_no", "bucket").agg(F.count("*").alias("n"))
    offsets = running_offsets(counts, ["source_no"], "bucket", "n").select("source_no", "bucket", "before")
    place = F.row_number().over(Window.partitionBy("source_no", "bucket").orderBy("slot")) - 1
    ranked = picked.withColumn("r", place).join(offsets, ["source_no", "bucket"]).select("slot", "source_no", (F.col("before") + F.col("r")).alias("rank"))
    got = counts.groupBy("source_no").agg(F.sum("n").alias("got"))
    lacking = share.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    lacking = lacking.select("source_no", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank")).select((F.lit(slots) + F.col("rank")).alias("slot"), "source_no", "rank")

    turn = F.floor(F.col("rank") / F.col("blocks"))
    start = F.col("rank") % F.col("blocks") * block
    stop = F.least(start + block, size, F.col("aim") - turn * size)
    every = ranked.unionByName(lacking).join(share, "source_no").where("rank < need")
    return every.select("slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block_no"), start.alias("start"), stop.alias("stop"))


def laid_out(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Every document with its place [start, stop) on the word line of its source, in shuffled order."""
    rows = sizes.join(targets.select(F.col("source").alias("_s"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    n = max(1, math.ceil(sizes.count() / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * n))
    counts = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    offsets = running_offsets(counts, ["source_no"], "bucket", "n").select("source_no", "bucket", "before")
    w = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("own", F.sum("size").over(w)).join(offsets, ["source_no", "bucket"])
    stop = F.col("before") + F.col("own")
    return placed.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "size", "source_no", "source_size", "target", (stop - F.col("size")).alias("start"), stop.alias("stop"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of docs."""
    sizes = saved(sized(docs), "sizes")
    targets = saved(source_targets(sizes, weights, max_repeats), "targets")
    placed = saved(laid_out(sizes, targets), "placed")
    slots = schedule(targets, block)
    used = slots.groupBy("source_no", "block_no", F.col("start").alias("from"), F.col("stop").alias("to")).agg(F.count("*").alias("times"))
    cut = placed.where("size > 0").select("row", "source_no", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("block_no"))
    overlap = F.least("stop", "to") - F.greatest("start", "from")
    took = cut.join(used, ["source_no", "block_no"]).where(overlap > 0).groupBy("row").agg(F.sum(overlap * F.col("times")).alias("taken"))
    out = placed.join(took, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix has them: a document with words comes as often as its takings fill it, rounded up, up to max_repeats
    times and not at all if nothing of it is taken; a document without words comes once."""
    takes = mix(docs, **options).groupBy(F.col("doc_id").alias("_timetide_doc")).agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size")))).alias("_timetide_n"))
    joined = docs.join(takes, docs["doc_id"].eqNullSafe(takes["_timetide_doc"])).where("_timetide_n > 0")
    return joined.withColumn("_timetide_i", F.explode(F.sequence(F.lit(1), F.col("_timetide_n").cast("int")))).select(*docs.columns)
