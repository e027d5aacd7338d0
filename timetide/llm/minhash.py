"""MinHash near-dedup of documents on word shingles.

A document's set is its distinct 5-word shingles, each a 64-bit hash. 96 minima of universal hash
functions (multiply, add, shift) form 24 bands of 4. Documents with equal sets are one class and only
one of them goes on. In each bucket every member is compared with the bucket's smallest member: first
by signatures (a true link falls under that check with a chance of about 1e-5), then on full sets.

A bucket of three or more members that then holds several components is finished exactly: the members
outside its largest component are compared with all others on full sets. They are dealt into blocks
of bounded size, each pair of blocks is a tile, a group of its own; a text goes to each of its tiles
once, and a tile returns only links that join components still apart there, fewer than it has
documents. So no pairs are written but those with a bucket's smallest member, and every pair of
different components that shares a bucket is decided.

A pair of similarity 0.75 misses all 24 bands with a chance of 1.1e-4; no other link is lost. Work is
linear in the members of the buckets, but for the tiles: theirs is the number of members outside the
largest component, times the size of the bucket. Components by alternating large-star and small-star.

Edge cases: no text or no word: an empty set, linked with nothing; fewer than 5 words: the whole
sequence is the one shingle. Rows without doc_id are dropped; a repeated row gives a repeated result
row, and rows sharing an id are one node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timetide.llm.common import saved, word_hashes
from timetide.llm.components import components

SHINGLE = 5
SHARE = (75, 100)
BANDS, ROWS = 24, 4
#: Least share of equal minima with which a pair goes on to the check on full sets.
SIGNATURE_SHARE = 0.55
#: Shingles (counted with repeats over documents) of a block of a bucket; a tile holds two blocks.
BLOCK = 1 << 18
SEED = 20_240_229


class Shingler:
    """Sets of 64-bit shingle hashes."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        rng = np.random.default_rng(SEED)
        self.powers = rng.integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        h = word_hashes(text)
        if not len(h):
            return np.zeros(0, np.uint64)
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out += h[i : len(h) - n + 1 + i] * self.powers[i]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _hash_parameters(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + 1)
    return rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of (a x + b) >> 32 over the set, in slices that stay in cache."""
    best = np.full(len(a), 2**32 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 512):
        hashed = shingles[None, i : i + 512] * a[:, None]
        hashed += b[:, None]
        np.minimum(best, hashed.min(axis=1) >> np.uint64(32), out=best)
    return best.astype(np.uint32)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), signature (array of ints)."""

    def run(batches):
        shingler, (a, b) = Shingler(shingle), _hash_parameters(bands * rows)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                s = shingler(text)
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                out.append((doc_id, len(s), key, minima(s, a, b).view(np.int32) if len(s) else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_key", "signature"])

    rows_in = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text"))
    return rows_in.mapInPandas(run, "doc_id long, n_shingles long, set_key binary, signature array<int>")


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are links: signatures first, then full sets."""
    left = reps.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = reps.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    likely = saved(pairs.join(left, "a").join(right, "b").where(equal >= F.lit(SIGNATURE_SHARE) * F.size("sa")).select("a", "b"), "likely")
    both = likely.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        shingler = Shingler(shingle)
        for pdf in batches:
            keep, last, x = [], None, None
            for a, ta, tb in zip(pdf["a"], pdf["ta"], pdf["tb"]):
                if a != last:
                    last, x = a, shingler(ta)
                y = shingler(tb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(len(x) > 0 and len(y) > 0 and share[1] * common >= share[0] * (len(x) + len(y) - common))
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def joined_in_tile(sets: list[np.ndarray], component: np.ndarray, asks: np.ndarray, own: np.ndarray, share: tuple[int, int]) -> list[tuple[int, int]]:
    """Positions (x, y) of links that join the components of a tile: each x that asks against every y of another
    component; own: block of each, and where there are two, only pairs across them count."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    begins, label, held, found = ends - size, np.unique(component, return_inverse=True)[1], np.zeros(len(known), dtype=np.int32), []
    # a set of which too much is in no other set here has no link; without it, other sets may be found to have none
    able, before = np.ones(len(sets), dtype=bool), -1
    while able.sum() != before:
        before = able.sum()
        times = np.bincount(ids[np.repeat(able, size)], minlength=len(known))
        able &= share[1] * np.add.reduceat(times[ids] > 1, begins, dtype=np.int64) >= share[0] * size
    two = own.min() != own.max()
    for x in np.flatnonzero(asks & able):
        apart = able & (label != label[x]) & (share[1] * np.minimum(size, size[x]) >= share[0] * np.maximum(size, size[x]))
        if two:
            apart &= own != own[x]
        if not apart.any():
            continue
        mine = ids[begins[x] : ends[x]]
        held[mine] = 1
        common = np.add.reduceat(held[ids], begins)
        held[mine] = 0
        for y in np.flatnonzero(apart & (share[1] * common >= share[0] * (size + size[x] - common))):
            if label[y] != label[x]:
                found.append((int(x), int(y)))
                label[label == label[y]] = label[x]
    return found


def _finished(members: DataFrame, label: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join components of one bucket, from the buckets of members (bucket, rep, n) that hold several."""
    marked = members.where("n > 2").join(label, "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    marked = saved(marked.join(reps.select("rep", "n_shingles"), "rep"), "marked")
    parts = marked.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.bit_xor(F.xxhash64("rep")).alias("mark"), F.bit_xor(F.xxhash64(F.lit(SEED), "rep")).alias("mark2"))
    largest = F.max(F.struct("n", -F.col("component"), "weight")).alias("main")
    mixed = parts.groupBy("bucket").agg(largest, F.count("*").alias("apart"), F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"), F.bit_xor("mark2").alias("mark2")).where("apart > 1")
    # buckets of the same members are one: 128 bits and three counts of them agree
    mixed = mixed.groupBy("n", "mark", "mark2", "weight", "apart").agg(F.min(F.struct("bucket", "main")).alias("m"))
    asking = F.ceil((F.col("weight") - F.col("m.main.weight")) / BLOCK).cast("int")
    asked = F.ceil(F.col("m.main.weight") / BLOCK).cast("int")
    one = F.col("weight") <= BLOCK
    mixed = mixed.select(F.col("m.bucket").alias("bucket"), (-F.col("m.main.col2")).alias("main"), F.when(one, 1).otherwise(asking).alias("asking"), F.when(one, 0).otherwise(asked).alias("asked"))
    dealt = marked.join(mixed, "bucket")
    asks = F.col("component") != F.col("main")
    # blocks 0 .. asking - 1 hold those that ask, the next ones the largest component (its own only where one block does not hold the bucket)
    block = F.when(F.col("asked") == 0, 0).when(asks, F.pmod(F.xxhash64(F.lit(SEED), "rep"), "asking")).otherwise(F.col("asking") + F.pmod(F.xxhash64(F.lit(SEED), "rep"), F.greatest("asked", F.lit(1)))).cast("int")
    dealt = dealt.select("bucket", "rep", "component", asks.alias("asks"), block.alias("own"), "asking", "asked")
    others = F.when(F.col("own") < F.col("asking"), F.sequence(F.lit(0), F.col("asking") + F.col("asked") - 1)).otherwise(F.sequence(F.lit(0), F.col("asking") - 1))
    dealt = dealt.withColumn("other", F.explode(others)).select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "own", "asks", "rep", "component")
    whole = dealt.join(texts, "rep")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, rep = [shingler(t) for t in pdf["text"]], pdf["rep"].to_numpy()
        found = joined_in_tile(sets, pdf["component"].to_numpy(), pdf["asks"].to_numpy(), pdf["own"].to_numpy(), share)
        return pd.DataFrame([(rep[x], rep[y]) for x, y in found], columns=["a", "b"], dtype="int64")

    shingler = Shingler(shingle)
    return whole.groupBy("tile").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs that has an id."""
    sig = saved(signatures(docs, bands, rows, shingle), "signatures")
    classes = sig.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "signature", "n_shingles")).alias("m"))
    reps = saved(classes.select("set_key", F.col("m.doc_id").alias("rep"), F.col("m.signature").alias("signature"), F.col("m.n_shingles").alias("n_shingles")), "reps")

    keys = F.array(*[F.xxhash64(F.lit(i), *[F.element_at("signature", i * rows + j + 1) for j in range(rows)]) for i in range(bands)])
    banded = reps.select("rep", F.explode(keys).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"), F.count("*").alias("n")).where("centre <> last")
    members = saved(banded.join(shared, "bucket").select("bucket", "rep", "centre", "n"), "members")
    # the texts of classes that meet another; a repeated row's only once, of rows sharing an id all different ones
    near = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text").join(members.select("rep").distinct(), "rep", "left_semi")
    texts = saved(near.groupBy("rep", F.xxhash64("text").alias("_t")).agg(F.min("text").alias("text")).drop("_t"), "texts")

    first = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = saved(_verified(first, reps, texts, shingle, share), "links")
    label = components(links).select(F.col("node").alias("rep"), "component")
    links = links.union(saved(_finished(members, label, reps, texts, shingle, share), "links"))
    found = components(links)

    named = reps.select("set_key", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_first_of_group(docs: DataFrame, **options) -> DataFrame:
    """docs without the near copies: of each component the document with the smallest id stays (rows repeating that id are the same document)."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("_timetide_doc")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_timetide_doc"], "left_anti").select(*docs.columns)
