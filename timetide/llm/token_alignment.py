"""Alignment of two tokenizers' tokens over whole texts, by divide and conquer at shared cuts.

A is a byte-level BPE (tokenizers JSON), which encodes space + text; B a sentencepiece model, which adds that space itself. Both
cover the same bytes. A cut is a byte offset where a token of A and one of B end. The cut nearest the middle of an interval is looked
for by bisection in ever wider windows, and both halves are cut on; an interval of at most LEAF tokens is cut at all its common ends
at once, and one without a cut inside is a group. Texts of more than PIECE characters are first divided at spaces that stand alone
between other characters: neither tokenizer joins anything across those (A's pattern starts a new word there, B has no
piece with a space mark behind another character, which is checked), so they are shared cuts and memory is that of one piece.

Within a group the elementary byte ranges between neighbouring ends are the links: each lies in one token of A and one of B.

Corpus-wide counts of linked id pairs: a task gathers its documents in chunks of at most CHUNK (document, pair) entries, and
sends each chunk's distinct pairs once. Spark sums them up, finds each B id's highest count, and sends every chunk the counts
of its own pairs, where they meet the chunk's documents. So pairs are shuffled per chunk and not per document or link, and no table of pairs
has to fit anywhere.

Edge cases: a text that is null or empty, or whose joined tokens of A or B are not the bytes of space + text, has no tokens:
all numbers 0 and groups_sha256 ''; rows are aligned one by one, whatever repeats, a null doc_id stays null; empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetide.llm.common import saved

#: Characters of a text that are encoded at once, tokens of an interval that are cut at once, (document, pair) entries of a chunk.
PIECE = 1 << 16
LEAF = 4096
CHUNK = 2_000_000
MARK = "▁"
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters for themselves, the
    others in order from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE. Where the file is a plain one (ids in the order of merges, no normaliser), an encoder by ranks is
    used, which gives the same ids faster; else the file's own."""

    def __init__(self, file: str, pattern: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(file)
        self.own.encode_special_tokens = True
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, special = byte_alphabet(), {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        self.ranks = None
        if self._plain(spec, vocab):
            import tiktoken

            self.ranks = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={self.bytes[i]: i for i in vocab.values()}, special_tokens={})

    def _plain(self, spec: dict, vocab: dict) -> bool:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ordered = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs)) and len(vocab) == 256 + len(pairs)
        bare = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        return ordered and bare and spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)

    def __call__(self, text: str) -> list[int]:
        return self.ranks.encode_ordinary(text) if self.ranks else self.own.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """A sentencepiece model."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.stable = not any(MARK in p.lstrip(MARK) for p in pieces)

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def shared_cuts(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B up to each common end, in order; a and b are the tokens' ends, strictly rising, the last ones equal."""
    found = [(len(a), len(b))]
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a1 - a0 + b1 - b0 <= leaf:
            at = np.searchsorted(b[b0:b1], a[a0 : a1 - 1])
            hit = np.flatnonzero(b[b0:b1][at] == a[a0 : a1 - 1])
            parts.append((a0 + hit + 1, b0 + at[hit] + 1))
            continue
        middle, wide, cut = (a0 + a1 - 1) // 2, 16, None
        while cut is None:
            low, high = max(a0, middle - wide), min(a1 - 1, middle + wide)
            at = np.searchsorted(b[b0:b1], a[low:high])
            hit = np.flatnonzero(b[b0:b1][at] == a[low:high])
            if len(hit):
                near = hit[np.argmin(np.abs(low + hit - middle))]
                cut = (int(low + near + 1), int(b0 + at[near] + 1))
            elif (low, high) == (a0, a1 - 1):
                break  # cutless: a group
            wide *= 4
        if cut:
            found.append(cut)
            todo += [(a0, cut[0], b0, cut[1]), (cut[0], a1, cut[1], b1)]
    i = np.concatenate([np.array([x[0] for x in found]), *[p[0] for p in parts]])
    j = np.concatenate([np.array([x[1] for x in found]), *[p[1] for p in parts]])
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


class Aligner:
    def __init__(self, byte_file: str, piece_file: str, pattern: str, piece: int = PIECE, leaf: int = LEAF):
        self.a, self.b, self.piece, self.leaf = ByteTokens(byte_file, pattern), PieceTokens(piece_file), piece, leaf
        self.a_size = np.array([len(x) for x in self.a.bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b.bytes], dtype=np.int64)
        self.width = len(self.b.bytes)
        # every id as it is written inside a group and at the end of its side
        self.words = [w for i in range(len(self.a.bytes)) for w in (b"%d," % i, b"%d|" % i)] + [w for i in range(self.width) for w in (b"%d," % i, b"%d;" % i)]

    def pieces(self, text: str):
        """The text in pieces; every piece but the first stood behind a space that is left out."""
        start = 0
        while self.a.ranks and self.b.stable and len(text) - start > self.piece:
            space = _LONE_SPACE.search(text, start + self.piece)
            if not space:
                break
            yield text[start : space.start()]
            start = space.end()
        yield text[start:]

    def __call__(self, text: str | None):
        """(n_a, n_b, n_groups, groups_sha256, pairs, times) of a text; pair = id of A * B's size + id of B; None without tokens."""
        if not text:
            return None
        sha, tail, n_a, n_b, n_groups, pairs, times = hashlib.sha256(), b"", 0, 0, 0, [], []
        for piece in self.pieces(text):
            a_ids, b_ids = self.a(" " + piece), self.b(piece)
            whole = (" " + piece).encode()
            if len(a_ids) == 0 or len(b_ids) == 0 or b"".join(map(self.a.bytes.__getitem__, a_ids)) != whole or b"".join(map(self.b.bytes.__getitem__, b_ids)) != whole:
                return None
            a_ids, b_ids = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
            a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
            i, j = shared_cuts(a_end, b_end, self.leaf)
            sha.update(tail)
            written = self._written(a_ids, b_ids, i, j)
            sha.update(written[:-1])
            tail = b";"
            ends = np.concatenate((a_end, b_end))
            ends.sort(kind="stable")
            ends = ends[np.concatenate((ends[1:] != ends[:-1], [True]))]
            linked = a_ids[np.searchsorted(a_end, ends)] * self.width + b_ids[np.searchsorted(b_end, ends)]
            own, many = np.unique(linked, return_counts=True)
            pairs.append(own)
            times.append(many)
            n_a, n_b, n_groups = n_a + len(a_ids), n_b + len(b_ids), n_groups + len(i)
        if len(pairs) == 1:
            return n_a, n_b, n_groups, sha.hexdigest(), pairs[0], times[0]
        own, at = np.unique(np.concatenate(pairs), return_inverse=True)
        return n_a, n_b, n_groups, sha.hexdigest(), own, np.bincount(at, weights=np.concatenate(times)).astype(np.int64)

    def _written(self, a_ids: np.ndarray, b_ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> bytes:
        """The groups as text, with a ; behind each."""
        codes = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
        before_i, before_j = np.concatenate(([0], i[:-1])), np.concatenate(([0], j[:-1]))
        a_code, b_code = a_ids * 2, len(self.a.bytes) * 2 + b_ids * 2
        a_code[i - 1] += 1
        b_code[j - 1] += 1
        codes[np.arange(len(a_ids)) + np.repeat(before_j, i - before_i)] = a_code
        codes[np.arange(len(b_ids)) + np.repeat(i, j - before_j)] = b_code
        return b"".join(itemgetter(*codes.tolist())(self.words))


_aligners: dict[tuple, Aligner] = {}


def _aligner(*key) -> Aligner:
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _packed(at: np.ndarray, times: np.ndarray) -> bytes:
    """Rising numbers and counts, small: steps and counts as bytes of one weight after the other."""
    import zstandard

    both = np.concatenate((np.diff(at, prepend=0), times)).astype("<u4")
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    both = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def aligned(docs: DataFrame, byte_file: str, piece_file: str, pattern: str, chunk: int = CHUNK, piece: int = PIECE, leaf: int = LEAF) -> DataFrame:
    """One row per document (chunk, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, entries: places of its pairs in the
    chunk's list and their counts) and one per chunk (chunk, pairs, times)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk string, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, entries binary, pairs array<long>, times array<long>"

    def run(batches):
        align, partition, number = _aligner(byte_file, piece_file, pattern, piece, leaf), TaskContext.get().partitionId(), 0
        ids, rows, held, id_type = [], [], 0, None

        def flush():
            name = f"{partition}-{number}"
            lists = [r[4] for r in rows if r]
            own, at = np.unique(np.concatenate(lists), return_inverse=True) if lists else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            total = np.bincount(at, weights=np.concatenate([r[5] for r in rows if r]), minlength=len(own)).astype(np.int64) if lists else own
            entries, start = [], 0
            for r in rows:
                entries.append(_packed(at[start : start + len(r[4])], r[5]) if r else None)
                start += len(r[4]) if r else 0
            numbers = [pa.array([int(f(r)) if r else 0 for r in rows] + [0], pa.int64()) for f in (itemgetter(0), itemgetter(1), itemgetter(2), lambda r: r[5].sum())]
            count = len(rows)
            one_list = lambda x: pa.concat_arrays([pa.nulls(count, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))])
            columns = [pa.array([name] * (count + 1)), pa.concat_arrays([*ids, pa.nulls(1, id_type)]), *numbers, pa.array([r[3] if r else "" for r in rows] + [None], pa.string()), pa.array(entries + [None], pa.binary()), one_list(own), one_list(total)]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "entries", "pairs", "times"])

        for batch in batches:
            id_type, start = batch.column("doc_id").type, 0
            for k, text in enumerate(batch.column("text").to_pylist()):
                rows.append(align(text))
                held += len(rows[-1][4]) if rows[-1] else 1
                if held >= chunk:
                    ids.append(batch.column("doc_id").slice(start, k + 1 - start))
                    yield flush()
                    ids, rows, held, number, start = [], [], 0, number + 1, k + 1
            ids.append(batch.column("doc_id").slice(start))
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(chunks: DataFrame, width: int) -> DataFrame:
    """pair, total, best: how many links of the corpus link the two ids, and whether no pair of the B id has more."""
    counts = saved(chunks.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b_id", F.col("pair") % width), "pair-counts")
    highest = counts.groupBy("b_id").agg(F.max("total").alias("highest"))
    return counts.join(highest, "b_id").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def align(docs: DataFrame, byte_file: str, piece_file: str, pattern: str, **options) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of docs."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
    rows = saved(aligned(docs, byte_file, piece_file, pattern, **options), "aligned")
    listed = rows.where("pairs is not null").select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counted = listed.select(F.col("chunk").alias("part"), "pair").join(pair_counts(listed, width), "pair")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links"]

    def meet(documents: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts.column("pair").to_numpy(), kind="stable")
        total = counts.column("total").to_numpy()[order]
        best = counts.column("best").to_numpy()[order].astype(np.int64)
        n_best, count_sum = [], []
        for data in documents.column("entries").to_pylist():
            at, times = _unpacked(data) if data else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            n_best.append(int((best[at] * times).sum()))
            count_sum.append(int((total[at] * times).sum()))
        columns = [documents.column("doc_id"), *[documents.column(c) for c in names], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), documents.column("groups_sha256")]
        return pa.Table.from_arrays(columns, names=["doc_id", *names, "n_best", "count_sum", "groups_sha256"])

    documents = rows.where("pairs is null").select("chunk", "doc_id", *names, "groups_sha256", "entries")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("chunk").cogroup(counted.groupBy("part")).applyInArrow(meet, schema)
