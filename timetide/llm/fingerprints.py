"""Document fingerprints by consistent weighted sampling.

A document is a bag of lower-cased words weighted by their counts. For each of SAMPLES samples every
word w with weight x draws, from its hash, r and c ~ Gamma(2, 1) and b ~ U(0, 1) and gets
t = floor(ln x / r + b) and ln a = ln c - r (t - b + 1); the word of the smallest a, with its t, is the
sample. Two documents agree in a sample with the probability of their generalised Jaccard similarity
(sum of minima over sum of maxima of the weights), so the share of equal samples estimates it.

All of it is DataFrame code inside generated loops: a gamma variate is minus the logarithm of a product
of two uniform numbers cut from a 64-bit hash, and the smallest a is a plain minimum of longs that hold
ln a in fixed point above 32 bits naming (word, t).
Texts are dealt once by document; counting and sampling then need no further shuffle, a third of all
rows sharing words or texts makes no hot key.

A document is a distinct (doc_id, text). Documents are in order of doc_id, those sharing an id in order
of a hash of their text, those without an id first; after the last comes the first, and a lone document
is its own next one.

Edge cases: null text counts as empty; a text without words has the empty string as its fingerprint,
alike (1.0) with another empty one and unlike (0.0) any other; every row has a result row, repeated rows
the same one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timetide.llm.common import GAP, saved, text_or_empty

SAMPLES = 32
#: What tells documents apart and orders them: the id (the least number where it is missing) and a hash of the text.
KEY = ["_id", "_text"]
SEED = 4
_RANGE_ROWS = 100_000


def _uniform(h: Column, shift: int, count: int) -> Column:
    """`count` bits of a hash as a number strictly between 0 and 1."""
    bits = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << count) - 1))
    return (bits + F.lit(0.5)) / F.lit(float(1 << count))


def _sample(term: Column, seed: int, log_weight: Column) -> Column:
    """ln a in 31 bits of fixed point over 32 bits naming the word and its t; null where log_weight is.

    r, c and b depend on the word and the seed only, and are worked out once for all weights of a row."""
    h = F.xxhash64(term, F.lit(seed))
    g = F.xxhash64(h)
    r = -F.log(_uniform(h, 0, 32) * _uniform(h, 32, 32))
    log_c = F.log(-F.log(_uniform(g, 0, 22) * _uniform(g, 22, 21)))
    b = _uniform(g, 43, 21)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1)
    fixed = ((log_a + 128.0) * float(1 << 23)).cast("long")  # ln a lies between -80 and 4
    return F.shiftleft(fixed, 32).bitwiseOR(F.xxhash64(h, t).bitwiseAND(F.lit(0xFFFFFFFF)))


def sampled(texts: DataFrame, columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """KEY and, for each text column, an array of `samples` ints (null without words), one row per document with words.

    No shuffle happens where texts is partitioned by KEY."""
    sides = texts.select(*KEY, F.posexplode(F.array(*columns)).alias("side", "t"))
    words = sides.select(*KEY, "side", F.explode(F.split(F.lower("t"), GAP)).alias("word")).where("word <> ''")
    counts = words.groupBy(*KEY, F.xxhash64("word").alias("term")).agg(*[F.sum(F.when(F.col("side") == i, 1.0)).alias(f"w{i}") for i in range(len(columns))])
    logs = counts.select(*KEY, "term", *[F.log(f"w{i}").alias(f"w{i}") for i in range(len(columns))])
    least = [F.min(_sample(F.col("term"), SEED * 1000 + k, F.col(f"w{i}"))).alias(f"m{i}_{k}") for i in range(len(columns)) for k in range(samples)]
    best = logs.groupBy(*KEY).agg(*least)
    arrays = [F.when(F.col(f"m{i}_0").isNotNull(), F.array(*[F.col(f"m{i}_{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(samples)])).alias(c) for i, c in enumerate(columns)]
    return best.select(*KEY, *arrays)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two arrays; null stands for no words."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal)


def as_text(samples: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """KEY, doc_id, text of every row."""
    id_ = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(id_, F.lit(-(2**63))).alias("_id"), F.xxhash64(text_or_empty()).alias("_text"), id_.alias("doc_id"), text_or_empty().alias("text"))


def texts_once(docs: DataFrame) -> DataFrame:
    """KEY, text of each document."""
    return keyed(docs).groupBy(*KEY).agg(F.min("text").alias("text"))


def ids_once(docs: DataFrame) -> DataFrame:
    """KEY, doc_id, n_chars, times of each document."""
    return keyed(docs).select(*KEY, "doc_id", F.length("text").cast("long").alias("n")).groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n_chars"), F.count("*").alias("times"))


def as_often(rows: DataFrame) -> DataFrame:
    """Each row `times` times."""
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("times")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, fingerprint."""
    found = ids_once(docs).join(sampled(texts_once(docs), ["text"], samples), KEY, "left")
    return as_often(found.select("doc_id", as_text(F.col("text")).alias("fingerprint"), "times"))


def followers(ids: DataFrame) -> DataFrame:
    """ids (KEY, …) with `next`: the KEY of the next document, after the last that of the first.

    Ids are dealt in ranges; only the first id of each range is compared over all ranges."""
    parts = max(1, math.ceil(ids.count() / _RANGE_ROWS))
    ranged = saved(ids.repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("part").agg(F.min(F.struct(*KEY)).alias("first"))
    wrapped = F.min("first").over(Window.partitionBy())
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), wrapped).alias("first"))
    inner = F.lead(F.struct(*KEY)).over(Window.partitionBy("part").orderBy(*KEY))
    return ranged.withColumn("n", inner).join(firsts, "part").withColumn("next", F.coalesce("n", "first")).drop("n", "part", "first")


def with_edited_and_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (floor of n_chars / 4 code points) replaced by as many (or
    all) from the start of the next document. Whole texts are shuffled once; only the part that the
    document before needs goes on a second time."""
    order = saved(followers(saved(ids_once(docs), "ids")), "order")
    base = texts_once(docs)  # with the same columns wherever it is used, so that it is shuffled once
    needs = order.select(*[F.col(f"next.{c}").alias(c) for c in KEY], F.struct(*KEY).alias("to"), F.floor(F.col("n_chars") / 4).cast("int").alias("q"))
    heads = base.join(needs, KEY).select(*[F.col(f"to.{c}").alias(c) for c in KEY], F.expr("substring(text, 1, q)").alias("head"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.col("head"))
    both = base.join(heads, KEY).select(*KEY, "text", edited.alias("edited"))
    signs = sampled(both, ["text", "edited"], samples)
    facts = both.select(*KEY, F.sha2("edited", 256).alias("edited_sha256"))
    facts = facts.join(signs, KEY, "left").join(order.select(*KEY, "doc_id", "n_chars", "times", F.col("next._id").alias("_next_id"), F.col("next._text").alias("_next_text")), KEY)
    own = saved(facts, "fingerprints")
    following = own.select(F.col("_id").alias("_next_id"), F.col("_text").alias("_next_text"), F.col("text").alias("after"))
    out = own.join(following, ["_next_id", "_next_text"])
    return as_often(out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("text")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("after")).alias("near_next"), "times"))
