"""Ranked lexical search of items over whole texts with an Aho-Corasick scan, without an index of the documents.

The terms of all items, each between guards, are the patterns of one automaton, which is sent to the
tasks. Each text is read once: white space and other non-term bytes become one guard byte, so that a match
is a whole term, and the automaton's outputs give the term frequencies. The automaton's states map to terms, and
terms to the items that hold them; what a document scores for an item is summed up from there. A task keeps
the best `top` rows of each item, and the best of those are taken in two levels.

Items are dealt into blocks of at most MAX_ITEMS items and, but for a single larger item, MAX_BYTES bytes of
terms; each block is one scan, so what is broadcast has a bound whatever the number of items. N, the mean length and the
document frequencies come from all documents.

Terms are maximal runs of ASCII letters and digits and all non-ASCII characters, A-Z read as a-z. A null text has no
terms. All scores are whole numbers (see `ranked`).

Edge cases: rows sharing an item_id are one item with the terms of all their texts, a null item_id among them; every
row of documents is a document of its own, whatever repeats; equal scores go by ascending doc_id, rows without one
last; items without terms, or of which no document has a term, have no rows; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from timetide.llm.common import saved

TOP = 50
#: Bounds of a block of items.
MAX_ITEMS = 4096
MAX_BYTES = 8_000_000
#: Cells of (document, item) that a task scores at once.
CELLS = 1 << 20
#: What a term is not made of; fixed values.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GUARD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(_UPPER.encode(), _LOWER.encode()))


def term_bytes(text: str) -> bytes:
    """The text with A-Z lower-cased and each byte between terms turned into a space, a space at each end."""
    return b" " + text.encode().translate(_GUARD) + b" "


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct) of items with any."""
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    words = items.select("item_id", F.explode(F.array_distinct(F.filter(F.split(text, GAPS), lambda w: w != ""))).alias("term"))
    return words.distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def blocks(items: DataFrame, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES):
    """Lists of (item_id, terms), one block after the other; one block and one partition are held at a time."""
    block, size = [], 0
    for row in item_terms(items).toLocalIterator():
        own = sum(len(t.encode()) + 8 for t in row["terms"])
        if block and (len(block) >= max_items or size + own > max_bytes):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["terms"]))
        size += own
    if block:
        yield block


_automata: dict[str, object] = {}


def _automaton(shared):
    """The block's automaton, made once per worker; texts and patterns are bytes read as Latin-1."""
    if shared.id not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for number, term in enumerate(shared.terms.value):
            made.add_word(f" {term.encode().decode('latin-1')} ", number)
        made.make_automaton()
        _automata.clear()
        _automata[shared.id] = made
    return _automata[shared.id]


class _Shared:
    """A block's terms in a broadcast variable, with a name of its own."""

    def __init__(self, spark, terms: list[str]):
        self.terms, self.id = spark.sparkContext.broadcast(terms), uuid.uuid4().hex


def scan(docs: DataFrame, shared: _Shared) -> DataFrame:
    """doc_id, n (terms of the text, with repeats), terms and tfs (numbers and counts of the block's terms in it)."""

    def run(batches):
        automaton, number = _automaton(shared), itemgetter(1)
        for batch in batches:
            length, ends, terms, tfs = [], [0], [], []
            for text in batch.column("text").to_pylist():
                data = term_bytes(text) if text else b" "
                b = np.frombuffer(data, dtype=np.uint8) != 32
                length.append(int(np.count_nonzero(b[1:] & ~b[:-1])))
                found = Counter(map(number, automaton.iter(data.decode("latin-1"))))
                terms.extend(found.keys())
                tfs.extend(found.values())
                ends.append(len(terms))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
            columns = [batch.column("doc_id"), pa.array(length, pa.int64()), lists(terms, pa.int32()), lists(tfs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def exact_sums(cell: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums of whole numbers from 0 to 2^40 by cell. Sums in doubles are exact below 2^53, so large totals are summed in two parts."""
    total = lambda v: np.bincount(cell, weights=v, minlength=1).astype(np.int64)
    if int(value.max(initial=0)) * len(value) < 1 << 53:
        return total(value)
    return (total(value >> 20) << 20) + total(value & ((1 << 20) - 1))


class Best:
    """The best `top` of (item, score, doc) rows given so far; doc is a number that orders equal scores."""

    def __init__(self, items: int, top: int):
        self.top, self.least, self.rows, self.held = top, np.zeros(items, dtype=np.int64), np.zeros((0, 4), dtype=np.int64), []

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = (score > 0) & (score >= self.least[item])
        self.held.append(np.stack((item[good], score[good], doc[good], null[good]), axis=1))
        if sum(map(len, self.held)) > 4 * self.top * len(self.least):
            self.prune()

    def prune(self) -> None:
        rows = np.concatenate((self.rows, *self.held))
        rows = rows[np.lexsort((rows[:, 2], rows[:, 3], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        rank = np.arange(len(rows)) - first
        self.rows, self.held = rows[rank < self.top], []
        last = self.rows[rank[rank < self.top] == self.top - 1]
        self.least[last[:, 0]] = last[:, 1]


def _best_of_tasks(found: DataFrame, weights: np.ndarray, of_term: list[np.ndarray], ids: list, n_docs: int, total: int, id_type: DataType, top: int) -> DataFrame:
    """item_id, doc_id, score, _task: the best `top` documents per item of each task."""
    starts = np.cumsum([0, *map(len, of_term)])
    shared = found.sparkSession.sparkContext.broadcast((weights, starts, np.concatenate(of_term)))

    def run(batches):
        w, begin, posting = shared.value
        items, best = len(ids), Best(len(ids), top)
        for batch in batches:
            docs, n = batch.column("doc_id"), batch.column("n").to_numpy()
            null = docs.is_null().to_numpy(zero_copy_only=False)
            key = docs.fill_null(0).to_numpy()
            lists = batch.column("terms")
            counts = lists.value_lengths().to_numpy()
            term, tf = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            doc = np.repeat(np.arange(len(n)), counts)
            m = 50 + (50 * n * n_docs) // max(total, 1)
            value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            size, step = begin[term + 1] - begin[term], max(1, CELLS // items)
            for low in range(0, len(n), step):
                a, b = np.searchsorted(doc, [low, low + step])
                if a == b:
                    continue
                many = size[a:b]
                at = np.repeat(begin[term[a:b]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                cell = np.repeat((doc[a:b] - low) * items, many) + posting[at]
                score = exact_sums(cell, np.repeat(value[a:b], many))
                hit = np.flatnonzero(score)
                best.add(hit % items, score[hit], key[low + hit // items], null[low + hit // items].astype(np.int64))
        best.prune()
        item, score, doc, null = best.rows.T
        columns = [pa.array([ids[i] for i in item.tolist()], to_arrow_type(id_type)), pa.array(doc, mask=null.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return found.mapInArrow(run, f"item_id {id_type.simpleString()}, doc_id long, score long").withColumn("_task", F.spark_partition_id())


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` documents of score above 0.

    With N documents that hold terms, L terms in all, n in the document and df documents that hold a term, its weight is
    floor(1000 ln((2N + 2) / (2 df + 1))), and a document scores w * (10^9 tf div (1000 tf + 20 m)) for each of the item's
    terms, m = 50 + (50 n N) div L."""
    spark, id_type = docs.sparkSession, items.schema["item_id"].dataType
    parts = []
    for block in blocks(items, max_items, max_bytes):
        terms = sorted({t for _, own in block for t in own})
        place = {t: i for i, t in enumerate(terms)}
        of_term: list[list[int]] = [[] for _ in terms]
        for i, (_, own) in enumerate(block):
            for t in own:
                of_term[place[t]].append(i)
        found = saved(scan(docs, _Shared(spark, terms)), "scan")
        n_docs, total = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # one row per term of the block
        df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
        weights = np.zeros(len(terms), dtype=np.int64)
        for term, w in df.select("term", weight).collect():
            weights[term] = w
        postings = [np.array(x, dtype=np.int64) for x in of_term]
        parts.append(_best_of_tasks(found, weights, postings, [i for i, _ in block], n_docs, total, id_type, top))
    if not parts:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = Window.partitionBy("item_id", F.col("_task") % 64).orderBy(*order)
    few = every.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top).select("item_id", "doc_id", "score")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return few.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL of ranked(documents, benchmark).
ORACLE = r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
  n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), c AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, nd),
  s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
  SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""
