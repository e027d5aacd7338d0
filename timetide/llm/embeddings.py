"""Embedding near-dedup with a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), in order. Pairs of those pivots
are the inverted lists: a list holds the vectors that have both among their nearest. Two vectors of a
list that share at least MIN_SHARED pivots, and whose 128-bit random-hyperplane sketches differ by no
more than a true pair's would, are candidates; candidates are verified by cosine in double precision
on the vectors themselves. The lists carry ids, pivots and sketches, not vectors. A long list is dealt
into blocks, and each pair of blocks is a task's group, so that no list is held in one task.

Equal vectors are one class: links are found between classes, and counted with their members.

The pivots are a bounded sample (SQRT of the number of classes, at most MAX_PIVOTS, chosen by hash) of
vectors that lie apart, filled up with random directions: pivots close together inside one dense group
would order its members by chance. Every vector is indexed. Recall against brute force is measured in tests/llm and in the README.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths never link; rows without vec_id are dropped; repeated rows are
vectors of their own with a shared id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetide.llm.common import saved
from timetide.llm.components import components

THRESHOLD = 0.9
PREFIX = 7
MIN_SHARED = 2
MIN_PIVOTS, MAX_PIVOTS = 32, 2048
#: Pivots from the sample have smaller cosines than this with each other.
APART = 0.6
SKETCH_BITS = 128
BLOCK = 1024
SEED = 7


def _max_distance(threshold: float, bits: int = SKETCH_BITS) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most, by 5 standard deviations."""
    p = math.acos(threshold) / math.pi
    return math.ceil(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


class PivotIndex:
    def __init__(self, sample: list[np.ndarray], wanted: int):
        by_dim: dict[int, list] = {}
        for v in sample:
            own, v = by_dim.setdefault(len(v), []), v / np.linalg.norm(v)
            if not own or np.max(np.array(own) @ v) < APART:
                own.append(v)
        self.pivots = {}
        for d, own in by_dim.items():
            more = np.random.default_rng(SEED + d).standard_normal((max(0, wanted - len(own)), d))
            self.pivots[d] = np.concatenate((np.array(own), more / np.linalg.norm(more, axis=1)[:, None]))

    def describe(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivots (rows of PREFIX, -1 where there are fewer), and sketches (rows of 2 words), of unit vectors."""
        n, dim = x.shape
        pivots = self.pivots.get(dim, np.zeros((0, dim)))
        near = np.full((n, PREFIX), -1, dtype=np.int64)
        k = min(PREFIX, len(pivots))
        if k:
            near[:, :k] = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k]
        planes = np.random.default_rng(SEED).standard_normal((dim, SKETCH_BITS))
        bits = np.packbits(x @ planes > 0, axis=1)
        return near, np.ascontiguousarray(bits).view(np.int64)

    def keys(self, near: np.ndarray, dim: int) -> np.ndarray:
        """The inverted lists of each row: one for each pair of its pivots."""
        a, b = np.triu_indices(PREFIX, 1)
        p = np.sort(near, axis=1) + 1
        return (np.int64(dim) << np.int64(32)) + (p[:, a] << np.int64(16)) + p[:, b]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array<double>) and a class key; vector is null where it cannot link."""
    v = F.col("embedding").cast("array<double>")
    # scaled by a power of two, which leaves the cosines as they are, so that no square of a component is too large or too small
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (top > 0), F.lit(False))
    power = F.floor(F.log2(top)).cast("double")
    scale = F.when(F.abs(power) < 300, 0.0).otherwise(-power)
    half = F.pow(F.lit(2.0), scale / 2 - F.pmod(scale, F.lit(2.0)) / 2)
    rest = F.pow(F.lit(2.0), scale / 2 + F.pmod(scale, F.lit(2.0)) / 2)
    clean = F.when(scale == 0, F.transform(v, lambda x: x + F.lit(0.0))).otherwise(F.transform(v, lambda x: x * half * rest + F.lit(0.0)))
    out = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.when(fine, clean).alias("vector"))
    # 128 bits of hash tell vectors apart
    return out.withColumn("key", F.when(F.col("vector").isNotNull(), F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(SEED), "vector")))))


def _unit_groups(vectors) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, unit vectors) of a column of vectors."""
    size = np.array([len(v) for v in vectors])
    out = []
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        x = np.array([vectors[i] for i in rows], dtype=np.float64)
        out.append((int(dim), rows, x / np.linalg.norm(x, axis=1)[:, None]))
    return out


def postings(classes: DataFrame, index: PivotIndex) -> DataFrame:
    """list, rep, near (the pivots), s0, s1 (the sketch)."""

    def run(batches):
        for pdf in batches:
            for dim, rows, x in _unit_groups(pdf["vector"].to_numpy()):
                near, sketch = index.describe(x)
                keys = index.keys(near, dim)
                rep = pdf["rep"].to_numpy()[rows]
                made = pd.DataFrame({"list": [np.unique(k) for k in keys], "rep": rep, "near": list(near.astype(np.int32)), "s0": sketch[:, 0], "s1": sketch[:, 1]})
                yield made

    rows = classes.select("rep", "vector").mapInPandas(run, "list array<long>, rep long, near array<int>, s0 long, s1 long")
    return rows.select(F.explode("list").alias("list"), "rep", "near", "s0", "s1")


def candidates(lists: DataFrame, max_distance: int) -> DataFrame:
    """Pairs (a, b) of classes of a list, each pair once: in the first list that they share."""
    sizes = lists.groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK).alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1)))
    dealt = lists.join(sizes, "list", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "near", "s0", "s1")
    dealt = dealt.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")

    def pairs_of(g: dict) -> pd.DataFrame:
        first = g["own"] == g["i"][0]
        left = np.flatnonzero(first)
        right = left if g["i"][0] == g["j"][0] else np.flatnonzero(~first)
        found = []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            far = sum(np.bitwise_count(g[s][rows, None].view(np.uint64) ^ g[s][None, right].view(np.uint64)) for s in ("s0", "s1"))  # of signed numbers numpy counts the bits of the absolute value
            x, y = np.nonzero((far <= max_distance) & (g["rep"][rows, None] != g["rep"][None, right]))
            found.append((rows[x], right[y]))
        x, y = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
        if g["i"][0] == g["j"][0]:
            keep = g["rep"][x] < g["rep"][y]
            x, y = x[keep], y[keep]
        if len(x):
            same = g["near"][x][:, :, None] == g["near"][y][:, None, :]
            shared = same.any(axis=2) & (g["near"][x] >= 0)
            pivots = np.sort(np.where(shared, g["near"][x], 2**20), axis=1) + 1  # shared ones first
            few = (g["near"][x] < 0).any(axis=1)  # fewer pivots than PREFIX: a list of all
            smallest = (pivots[:, 0].astype(np.int64) << 16) + pivots[:, 1]
            none = np.sort(g["near"][x], axis=1) + 1
            smallest = np.where(few, (none[:, 0].astype(np.int64) << 16) + none[:, 1], smallest)
            keep = (few | (shared.sum(axis=1) >= MIN_SHARED)) & (smallest == (g["list"][0] & 0xFFFFFFFF))
            x, y = x[keep], y[keep]
        a, b = g["rep"][x], g["rep"][y]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(batches):
        names, held = ["list", "i", "j", "own", "rep", "s0", "s1", "near"], None
        for pdf in batches:
            new = {n: np.array(pdf["near"].tolist(), dtype=np.int32) if n == "near" else pdf[n].to_numpy() for n in names}
            held = new if held is None else {n: np.concatenate((held[n], new[n])) for n in names}
            ends = np.flatnonzero((np.diff(held["list"]) != 0) | (np.diff(held["i"]) != 0) | (np.diff(held["j"]) != 0)) + 1
            for s, e in zip([0, *ends[:-1]], ends):
                if e - s > 1:
                    yield pairs_of({n: v[s:e] for n, v in held.items()})
            if len(ends):
                held = {n: v[ends[-1] :] for n, v in held.items()}
        if held is not None and len(held["list"]) > 1:
            yield pairs_of(held)

    return dealt.mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine in double precision reaches the threshold."""
    left = classes.select(F.col("rep").alias("a"), F.col("vector").alias("x"))
    right = classes.select(F.col("rep").alias("b"), F.col("vector").alias("y"))

    def run(batches):
        for pdf in batches:
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            keep = np.zeros(len(pdf), dtype=bool)
            size = np.array([len(v) for v in x])
            for dim in np.unique(size):
                rows = np.flatnonzero((size == dim) & (size == np.array([len(v) for v in y])))
                p, q = np.array([x[i] for i in rows], dtype=np.float64), np.array([y[i] for i in rows], dtype=np.float64)
                if len(rows):
                    keep[rows] = (p * q).sum(axis=1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)) >= threshold
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors that has an id."""
    rows = saved(usable(vectors), "vectors")
    grouped = rows.where("key is not null").groupBy("key").agg(F.min(F.struct("vec_id", "vector")).alias("m"), F.count("*").alias("members"))
    classes = saved(grouped.select("key", F.col("m.vec_id").alias("rep"), F.col("m.vector").alias("vector"), "members"), "classes")
    wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(math.sqrt(classes.count()))))
    sample = classes.orderBy(F.xxhash64(F.lit(SEED), "key"), "key").limit(wanted).select("vector").collect()  # MAX_PIVOTS rows at most
    index = PivotIndex([np.array(r[0], dtype=np.float64) for r in sample], wanted)
    found = candidates(saved(postings(classes, index), "postings"), _max_distance(threshold))
    links = saved(verified(found, classes, threshold), "links")

    both = links.select(F.col("a").alias("rep"), F.col("b").alias("o")).union(links.select("b", "a"))
    weight = classes.select(F.col("rep").alias("o"), F.col("members").alias("there"))
    degree = both.join(weight, "o").groupBy("rep").agg(F.sum("there").alias("others"))
    joined = components(links).withColumnRenamed("node", "rep")
    facts = classes.select("key", "rep", "members").join(degree, "rep", "left").join(joined, "rep", "left")
    facts = facts.select("key", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    out = rows.select("vec_id", "key").join(facts, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
