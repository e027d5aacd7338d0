"""Packing documents into sequences by linear grouping and best fit.

Documents are tokenised word by word with a cache (the tokenizer never joins across white space, so
the ids equal those of the whole text), ended by id 0, and cut into pieces of at most `capacity` ids.
Only the number of pieces of each length, at most `capacity` numbers, goes to the driver, where the
plan is made: large lengths form groups of equal cardinality, each rounded up to its longest; a
configuration of those few sizes that fills a sequence best is found by subset sums and repeated as
often as the counts allow, until all are placed; then actual lengths take the places, and small
pieces go, longest first, into the fullest sequence that has room. Every line of the plan says where
the pieces of one length and a range of ranks go; pieces are ranked within their length on Spark (by
bucket, then over bucket totals) and joined with the plan.

Edge cases: null text counts as empty and gives one piece (the id 0); an empty table gives no rows;
repeated rows are documents of their own; rows are never dropped, and a null doc_id stays null.
"""

from __future__ import annotations

import math
import json
import os
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timetide.llm.common import arrow_rows, running_offsets, saved

CAPACITY = 2048
#: Lines of a plan that are sent to every executor: 48 bytes each.
BROADCAST_LINES = 200_000
GROUPS = 256
#: Lengths up to this share of the capacity are small ones.
SMALL = 1 / 8
BUCKET_ROWS = 500
#: Words, and word parts, that a Python worker remembers: about half a kilobyte for both.
_CACHE = 120_000
#: Texts that a worker is given at once.
BATCH_ROWS = 1000


#: What the word cache below knows of a tokenizer file; with any other file whole texts are encoded. Fixed values.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    },
}
#: Words that need none of the tokenizer's normalising but lower case; its pattern of word parts; its byte alphabet.
_SIMPLE = regex.compile(r"[!-;=-~\u00a1-\u012f\u0131-\u017f]+")
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def _as_characters(part: str) -> str:
    """The bytes of a word part as the characters that stand for them in a byte-level vocabulary."""
    return part.encode().decode("latin-1").translate(_ALPHABET)


class _Parts(dict):
    """Word part, lower case -> its ids, straight from the tokenizer's model."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part if part.isascii() else _as_characters(part))]
        found = struct.pack("<%dI" % len(ids), *ids)
        if len(self) < _CACHE:
            self[part] = found
        return found


class _Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes, remembered for the first words met, the frequent ones."""

    def __init__(self, tokenizer):
        self.tokenizer, self.parts = tokenizer, _Parts(tokenizer.model)

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            found = self.parts[word.lower().decode()]
        elif _SIMPLE.fullmatch(text := word.decode()):
            # letters of the first Latin blocks: normalising is lower(), and the parts go to the model as they are
            found = b"".join([self.parts[p] for p in _PARTS.findall(text.lower())])
        else:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) < _CACHE:
            self[word] = found
        return found


@lru_cache(maxsize=1)
def word_encoder(tokenizer_file: str):
    """text -> its ids as little-endian unsigned 32-bit bytes; tasks of one worker share what it remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(tokenizer_file)
    spec = json.loads(tokenizer.to_str())
    plain = all(spec[part] == own for part, own in _KNOWN.items()) and not any(_SIMPLE.fullmatch(t["content"]) for t in spec["added_tokens"])
    if not plain or spec["truncation"] or spec["padding"] or spec["model"]["dropout"]:
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
    known = _Words(tokenizer)

    def encode(text: str | None) -> bytes:
        # ASCII white space only; the tokenizer sees to the rest
        return b"".join(map(known.__getitem__, (text or "").encode().split()))

    return encode


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        encode = word_encoder(tokenizer_file)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encode(text) + bytes(4)
                for i, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    out.append((doc_id, i, start // 4, len(part) // 4, zlib.crc32(part)))
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Lines (length, first rank, end rank, first sequence, pieces per sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity, self.lines, self.sequences = capacity, [], 0
        self.rank = defaultdict(int)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)
        self.rooms: list[int] = []
        whole = counts.get(capacity, 0)
        if whole:
            self._place(capacity, whole, self._new(whole), 1, 0)
        small = int(capacity * SMALL)
        self._large({n: c for n, c in counts.items() if small < n < capacity and c}, groups)
        for n in sorted((n for n, c in counts.items() if 0 < n <= small and c), reverse=True):
            self._best_fit(n, counts[n])

    def _new(self, count: int) -> int:
        first, self.sequences = self.sequences, self.sequences + count
        return first

    def _place(self, length: int, count: int, first: int, per: int, offset: int) -> None:
        at = self.rank[length]
        self.rank[length] = at + count
        self.lines.append((length, at, at + count, first, per, offset))

    def _leave(self, room: int, first: int, count: int) -> None:
        if room and count:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((first, count))

    def _large(self, counts: dict[int, int], groups: int) -> None:
        total, seen = sum(counts.values()), 0
        members: dict[int, list[list[int]]] = defaultdict(list)  # group -> runs [length, count], longest first
        for n in sorted(counts, reverse=True):
            left = counts[n]
            while left:
                g = seen * groups // total
                take = min(left, -(-(g + 1) * total // groups) - seen)
                members[g].append([n, take])
                seen, left = seen + take, left - take
        rounded: dict[int, list[list[int]]] = {}
        for runs in members.values():  # groups of one size are one
            rounded.setdefault(runs[0][0], []).extend(runs)
        number = {size: sum(c for _, c in runs) for size, runs in rounded.items()}
        while number:
            chosen = self._configuration(number)
            times = min(number[s] // k for s, k in chosen.items())
            for s, k in chosen.items():
                number[s] -= k * times
                if not number[s]:
                    del number[s]
            self._substitute([s for s, k in sorted(chosen.items(), reverse=True) for _ in range(k)], times, rounded)

    def _configuration(self, number: dict[int, int]) -> dict[int, int]:
        """The largest size left, with what fills the rest of a sequence best."""
        sizes = sorted(number, reverse=True)
        room = self.capacity - sizes[0]
        mask, reach, steps = (1 << (room + 1)) - 1, 1, []
        for s in sizes:
            if s > room:
                continue
            for _ in range(min(number[s] - (s == sizes[0]), room // s)):
                more = reach | (reach << s) & mask
                if more == reach:
                    break
                steps.append((s, reach))
                reach = more
            if reach >> room & 1:
                break
        fill, chosen = reach.bit_length() - 1, defaultdict(int, {sizes[0]: 1})
        for s, before in reversed(steps):
            if not before >> fill & 1:
                chosen[s] += 1
                fill -= s
        return dict(chosen)

    def _substitute(self, sizes: list[int], times: int, rounded: dict[int, list[list[int]]]) -> None:
        """Actual lengths for `times` sequences of one configuration; each run of equal ones is a few lines."""
        first = self._new(times)
        lanes = []
        for s in sizes:
            lane, left = [], times
            while left:
                run = rounded[s][0]
                take = min(left, run[1])
                lane.append([run[0], take])
                run[1] -= take
                left -= take
                if not run[1]:
                    rounded[s].pop(0)
            lanes.append(lane)
        while lanes[0]:
            count, offset = min(lane[0][1] for lane in lanes), 0
            for lane in lanes:
                self._place(lane[0][0], count, first, 1, offset)
                offset += lane[0][0]
                lane[0][1] -= count
                if not lane[0][1]:
                    lane.pop(0)
            self._leave(self.capacity - offset, first, count)
            first += count

    def _best_fit(self, length: int, count: int) -> None:
        while count:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                need = -(-count // (self.capacity // length))
                self._leave(self.capacity, self._new(need), need)
                continue
            room = self.rooms[i]
            first, number = self.open[room].pop()
            if not self.open[room]:
                self.rooms.pop(i)
            per = room // length
            full = min(number, count // per)
            if full:
                self._place(length, full * per, first, per, self.capacity - room)
                self._leave(room - per * length, first, full)
                count -= full * per
                first, number = first + full, number - full
            if number and count and count < per:
                self._place(length, count, first, count, self.capacity - room)
                self._leave(room - count * length, first, 1)
                first, number, count = first + 1, number - 1, 0
            self._leave(room, first, number)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces() with sequence_id and offset."""
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        rows = saved(pieces(docs, tokenizer_file, capacity), "pieces")
    counts = {int(n): int(c) for n, c in rows.groupBy("length").count().collect()}  # one row per length, capacity at most
    plan = Plan(counts, capacity, groups)
    lines = spark.createDataFrame(plan.lines or [(0, 0, 0, 0, 1, 0)], "plan_length long, lo long, hi long, first long, per long, at long")
    buckets = max(1, math.ceil(sum(counts.values()) / BUCKET_ROWS))
    h = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    dealt = rows.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    totals = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    offsets = running_offsets(totals, ["length"], "bucket", "n").select("length", "bucket", "before")
    w = Window.partitionBy("length", "bucket").orderBy("h", "doc_id", "piece")
    ranked = dealt.withColumn("r", F.row_number().over(w) - 1).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("r"))
    # the plan has a few lines per length and configuration, whatever the number of documents; a longer one is joined by length
    plan_rows = F.broadcast(lines) if len(plan.lines) <= BROADCAST_LINES else lines
    hit = ranked.join(plan_rows, (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    sequence = F.col("first") + F.floor(k / F.col("per"))
    offset = F.col("at") + (k % F.col("per")) * F.col("length")
    return hit.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))
