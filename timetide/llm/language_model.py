"""Scoring texts with a log-bilinear model trained by noise-contrastive estimation.

Counts of all training words are exact and come from the whole corpus: every chunk of documents counts
its own distinct words, the counts meet by word, and each chunk gets back the totals of its words only;
no task or driver holds the vocabulary.

The model predicts the next word's class from the two before: h = q1 * C1 + q2 * C2. Classes are the
most frequent words, each its own, and as many buckets that all other words are dealt to by hash, inside
which words keep their smoothed unigram shares; there are about twice the square root of the vocabulary,
so that they grow with the corpus. They stand in groups of about the square root of their number:
p(class) = p(group | h) p(class | h, group), each a softmax of h . r + b, normalised over all groups and
over all classes of the group by batched matrix products.

Units of a few chunks train on all their training tokens (in shuffled blocks of bounded size) from the
common start b = log unigram, r = 0, with noise words from the unigram distributions of both levels; the
parameters are averaged by tokens on Spark. Chunks and units depend on the documents only, so that scores do not depend on how
Spark deals them to tasks.

Edge cases: null text counts as empty and has one token, the end; an empty training set gives score 0
for every token; a null doc_id counts as training; repeated rows are documents of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetide.llm.common import remainder, saved, word_hashes

MIN_WORDS = 128
DIM = 16
#: Noise groups of a batch, and noise classes of each group in a batch.
NOISE = 16
#: Tokens of a batch; fewer where that would leave less than BATCHES of them.
BATCH, LEAST_BATCH, BATCHES = 8192, 512, 64
RATE = 0.3
#: Tokens that are trained on at once, characters of a chunk of documents, and chunks that train one after the other.
TRAIN_TOKENS = 1_000_000
CHUNK_CHARS = 8 << 20
TRAIN_CHUNKS = 4
#: Parameters of a block, when they are averaged.
BLOCK = 4096
END = -1


def token_hashes(text: str | None) -> np.ndarray:
    """Words of a text as hashes, then END (negative, so apart from them)."""
    return np.append(word_hashes(text).view(np.int64), END)


def own_words(v: int) -> int:
    """Words that are classes of their own, and buckets for the others, in a vocabulary of v: a power of two about its square root."""
    return max(MIN_WORDS, 1 << math.ceil(math.log2(math.sqrt(v) + 1)))


@dataclass
class Model:
    tops: np.ndarray  # sorted hashes of the words that are classes of their own
    top_class: np.ndarray  # their classes
    bucket_class: np.ndarray  # classes of the buckets
    mass: np.ndarray  # smoothed counts of the classes, most first
    size: int  # classes of a group
    q: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    u: np.ndarray
    a: np.ndarray
    r: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(tops: list[tuple[int, int]], buckets: np.ndarray) -> Model:
        """From the most frequent words (hash, count) and, for each bucket, the smoothed counts of its words and of one unknown word."""
        tops = sorted(tops)
        mass = np.concatenate((np.array([c + 0.5 for _, c in tops], dtype=np.float64), buckets))
        order = np.argsort(-mass, kind="stable")
        place = np.empty(len(mass), dtype=np.int64)
        place[order] = np.arange(len(mass))
        mass, k = mass[order], len(mass)
        size = math.ceil(math.sqrt(k))
        groups = np.add.reduceat(mass, np.arange(0, k, size))
        rng = np.random.default_rng(11)
        q = rng.normal(0, 0.3, (k, DIM)).astype(np.float32)
        inside = np.log(mass / groups[np.arange(k) // size])
        zeros = lambda n: np.zeros((n, DIM), np.float32)
        return Model(np.array([h for h, _ in tops], dtype=np.int64), place[: len(tops)], place[len(tops) :], mass, size, q, np.ones(DIM, np.float32), np.full(DIM, 0.5, np.float32), zeros(len(groups)), np.log(groups / groups.sum()).astype(np.float32), zeros(k), inside.astype(np.float32))

    def classes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class of each word, whether it is the word's own)."""
        other = self.bucket_class[hashes % len(self.bucket_class)]
        if not len(self.tops):
            return other, np.zeros(len(hashes), dtype=bool)
        shift, places = self.places()
        at = places[(hashes >> shift) & (len(places) - 1)]
        own = self.tops[at] == hashes
        return np.where(own, self.top_class[at], other), own

    def places(self) -> tuple[int, np.ndarray]:
        """A table of where in tops a hash can be, by bits of the hash in which no two tops agree."""
        if "_places" not in self.__dict__:
            bits = 20
            while True:
                for shift in range(0, 63 - bits, 3):
                    keys = (self.tops >> shift) & ((1 << bits) - 1)
                    if len(np.unique(keys)) == len(keys):
                        places = np.zeros(1 << bits, dtype=np.int32)
                        places[keys] = np.arange(len(keys))
                        self.__dict__["_places"] = shift, places
                        return self.__dict__["_places"]
                bits += 1
        return self.__dict__["_places"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_places"}

    def contexts(self, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """k * (class before the last) + last class, for each token; END stands before a text."""
        k, end = len(self.mass), int(self.classes(np.array([END]))[0][0])
        last, before = np.empty_like(classes), np.empty_like(classes)
        last[1:], before[2:] = classes[:-1], classes[:-2]
        last[starts] = end
        before[:2] = end
        before[starts] = end
        second = starts + 1
        before[second[second < len(classes)]] = end
        return before * k + last

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        k = len(self.mass)
        return self.q[contexts % k] * self.c1 + self.q[contexts // k] * self.c2

    def log_probability(self, classes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Natural logarithm of the normalised class probabilities."""
        out = np.empty(len(classes), dtype=np.float64)
        for i in range(0, len(classes), 1 << 15):
            own = classes[i : i + (1 << 15)]
            rows = _order(own, len(self.mass))
            own = own[rows]
            h, group = self.hidden(contexts[i : i + (1 << 15)][rows]), own // self.size
            found = _log_softmax(h @ self.u.T + self.a, group)
            for first, last in _runs(group):
                low = int(group[first]) * self.size
                inside = h[first:last] @ self.r[low : low + self.size].T + self.b[low : low + self.size]
                found[first:last] += _log_softmax(inside, own[first:last] - low)
            out[i + rows] = found
        return out

    def learnt(self) -> tuple[np.ndarray, ...]:
        return self.q, self.c1, self.c2, self.u, self.a, self.r, self.b

    def parameters(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.learnt()])

    def with_parameters(self, flat: np.ndarray) -> Model:
        parts, at = [], 0
        for x in self.learnt():
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*[getattr(self, f.name) for f in fields(self)[:5]], *parts)


def _order(numbers: np.ndarray, n: int) -> np.ndarray:
    """A stable order of numbers below n; short ones are sorted by their digits."""
    return np.argsort(numbers.astype(np.uint16) if n <= 1 << 16 else numbers, kind="stable")


def _log_softmax(scores: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The picked column's logarithm of the softmax of each row."""
    top = scores.max(axis=1)
    own = scores[np.arange(len(scores)), picked]
    scores -= top[:, None]
    return own - top - np.log(np.exp(scores, out=scores).sum(axis=1))


def _runs(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    ends = np.flatnonzero(np.diff(sorted_)) + 1
    return list(zip(np.concatenate(([0], ends)).tolist(), np.concatenate((ends, [len(sorted_)])).tolist()))


def _sum_runs(sorted_: np.ndarray, grad: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of grad by number, below n; the numbers are in order."""
    first = np.concatenate(([0], np.flatnonzero(np.diff(sorted_)) + 1))
    out = np.zeros((n, grad.shape[1]), np.float32)
    out[sorted_[first]] = np.add.reduceat(grad, first, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation on both levels with AdaGrad; the tokens of a batch share its noise groups, those of one group in it its noise classes."""

    def __init__(self, model: Model):
        self.m = model.with_parameters(model.parameters())
        self.squares = [np.full(x.shape, 1e-3, np.float32) for x in self.m.learnt()]
        self.rng = np.random.default_rng(23)
        self.groups = np.add.reduceat(model.mass, np.arange(0, len(model.mass), model.size))
        self.log_group = np.log(self.groups / self.groups.sum() * NOISE).astype(np.float32)
        self.log_class = np.log(model.mass / self.groups[np.arange(len(model.mass)) // model.size] * NOISE).astype(np.float32)
        self.group_sums, self.class_sums = np.cumsum(self.groups), np.concatenate(([0.0], np.cumsum(model.mass)))

    def train(self, contexts: np.ndarray, classes: np.ndarray) -> None:
        order = self.rng.permutation(len(classes))
        size = max(LEAST_BATCH, min(BATCH, len(classes) // BATCHES))
        for i in range(0, len(order), size):
            take = order[i : i + size]
            take = take[_order(classes[take], len(self.m.mass))]
            self._batch(contexts[take], classes[take])

    def _batch(self, contexts: np.ndarray, target: np.ndarray) -> None:
        m, n, k = self.m, len(target), len(self.m.mass)
        last, before, group = contexts % k, contexts // k, target // m.size
        q1, q2 = m.q[last], m.q[before]
        h = q1 * m.c1 + q2 * m.c2
        rise = lambda x: 1 / (1 + np.exp(np.clip(x, -30, 30))) / n  # noqa: E731  of a true word's score; of a noise word's, minus that of -x

        noise = np.minimum(np.searchsorted(self.group_sums, self.rng.random(NOISE) * self.group_sums[-1]), len(self.groups) - 1)
        u_t, u_n = m.u[group], m.u[noise]
        g = rise(np.einsum("ij,ij->i", h, u_t) + m.a[group] - self.log_group[group])
        gn = -rise(-(h @ u_n.T + (m.a[noise] - self.log_group[noise])))
        gh = g[:, None] * u_t + gn @ u_n
        gu, ga = np.zeros_like(m.u), np.zeros_like(m.a)
        np.add.at(gu, noise, gn.T @ h)
        np.add.at(ga, noise, gn.sum(axis=0))

        r_t = m.r[target]
        gt = rise(np.einsum("ij,ij->i", h, r_t) + m.b[target] - self.log_class[target])
        gh += gt[:, None] * r_t
        gr, gb = _sum_runs(target, gt[:, None] * h, k), np.bincount(target, gt, k).astype(np.float32)
        gu += _sum_runs(group, g[:, None] * h, len(gu))
        ga += np.bincount(group, g, len(ga)).astype(np.float32)
        for first, end in _runs(group):
            own, hs = int(group[first]), h[first:end]
            low, high = own * m.size, min((own + 1) * m.size, k)
            points = self.class_sums[low] + self.rng.random(NOISE) * self.groups[own]
            noise = np.clip(np.searchsorted(self.class_sums, points, side="right") - 1, low, high - 1)
            r_n = m.r[noise]
            gn = -rise(-(hs @ r_n.T + (m.b[noise] - self.log_class[noise])))
            gh[first:end] += gn @ r_n
            np.add.at(gr, noise, gn.T @ hs)
            np.add.at(gb, noise, gn.sum(axis=0))
        gq = np.zeros_like(m.q)
        for words, weight in ((last, m.c1), (before, m.c2)):
            rows = _order(words, k)
            gq += _sum_runs(words[rows], gh[rows], k) * weight
        grads = gq, (gh * q1).sum(axis=0), (gh * q2).sum(axis=0), gu, ga, gr, gb
        for x, squares, grad in zip(m.learnt(), self.squares, grads):
            squares += grad * grad
            x += RATE * grad / np.sqrt(squares)


def _starts(lengths: list[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def chunked(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """doc_id, held_out, chunk, text: chunks of about CHUNK_CHARS characters, by hash."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / CHUNK_CHARS))
    held = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("chunk"), "text")


def word_counts(parts: DataFrame) -> DataFrame:
    """chunk, h, own: each distinct word of a chunk with its count in the chunk's training documents."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, counts = [], []
        for held in (False, True):
            ids = [token_hashes(t) for t in pdf["text"][pdf["held_out"] == held]]
            if ids:
                h, n = np.unique(np.concatenate(ids), return_counts=True)
                kept.append(h)
                counts.append(n if not held else np.zeros_like(n))
        h = np.concatenate(kept)
        distinct, which = np.unique(h, return_inverse=True)
        own = np.bincount(which, np.concatenate(counts), len(distinct)).astype(np.int64)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "h": distinct, "own": own})

    return parts.groupBy("chunk").applyInPandas(count, "chunk long, h long, own long")


def starting_model(totals: DataFrame, v: int) -> Model:
    """The model before training, of the counts (h, c) of v training words."""
    words = own_words(v)
    tops = [(r["h"], r["c"]) for r in totals.orderBy(F.col("c").desc(), "h").limit(words).collect()]
    if END not in {h for h, _ in tops} and v:
        tops = tops[:-1] + [(r["h"], r["c"]) for r in totals.where(F.col("h") == END).collect()]
    # a row per bucket; the buckets' words without those that are classes of their own
    found = totals.groupBy(F.pmod("h", F.lit(words)).alias("bucket")).agg(F.sum(F.col("c") + 0.5).alias("mass")).collect()
    buckets = np.zeros(words)
    for r in found:
        buckets[r["bucket"]] = r["mass"]
    for h, c in tops:
        buckets[h % words] -= c + 0.5
    return Model.start(tops, np.maximum(buckets, 0.0) + 0.5)


def trained(parts: DataFrame, model: Model) -> Model:
    """The model after one pass over the training documents, in units of TRAIN_CHUNKS chunks, averaged by tokens."""
    if not len(model.tops):
        return model
    units = max(1, math.ceil(parts.select("chunk").distinct().count() / TRAIN_CHUNKS))
    ways = math.ceil(math.sqrt(units))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])  # in an order of its own, whatever way the rows came
        trainer, waiting, seen, ids = Trainer(model), 0, 0.0, []
        for k, text in enumerate(pdf["text"]):
            ids.append(token_hashes(text))
            waiting += len(ids[-1])
            seen += len(ids[-1])
            if waiting >= TRAIN_TOKENS or k == len(pdf) - 1:
                classes, _ = model.classes(np.concatenate(ids))
                trainer.train(model.contexts(classes, _starts([len(y) for y in ids])), classes)
                waiting, ids = 0, []
        flat = trainer.m.parameters().astype(np.float64) * seen
        blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
        return pd.DataFrame({"block": range(len(blocks)), "way": int(pdf["unit"].iloc[0]) % ways, "x": [b.tobytes() for b in blocks], "n": seen})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, dtype=np.float64) for x in pdf.sort_values(["n", "x"])["x"]], axis=0)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "way": [pdf["way"].iloc[0]], "x": [total.tobytes()], "n": [pdf["n"].sum()]})

    schema = "block int, way int, x binary, n double"
    learnt = parts.where("not held_out").select("doc_id", (F.col("chunk") % units).alias("unit"), "text").groupBy("unit").applyInPandas(learn, schema)
    # in two steps, so that no task adds up more than about the square root of the units
    mean = learnt.groupBy("block", "way").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema).toPandas().sort_values("block")
    if not len(mean):
        return model
    return model.with_parameters(np.concatenate([np.frombuffer(x, dtype=np.float64) / n for x, n in zip(mean["x"], mean["n"])]))


def scored(parts: DataFrame, known: DataFrame, model: Model, n: int, v: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""

    def score(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(docs):
            return pd.DataFrame({c: [] for c in columns})
        words = words.sort_values("h")
        hashes, counts = words["h"].to_numpy(np.int64), words["c"].to_numpy(np.float64)
        ids = [token_hashes(t) for t in docs["text"]]
        lengths = np.array([len(x) for x in ids])
        starts, h = _starts(lengths.tolist()), np.concatenate(ids)
        # what a word brings is worked out once per distinct word; the last place stands for all unknown ones
        base = np.log10((np.append(counts, 0.0) + 0.5) / (n + 0.5 * (v + 1)))
        at = np.full(len(h), len(hashes))
        if len(hashes):
            found = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            at = np.where(hashes[found] == h, found, at)
        log_p = np.zeros(len(h))
        if n:
            classes, _ = model.classes(h)
            log_p = model.log_probability(classes, model.contexts(classes, starts))
            of_word, own = model.classes(hashes)
            shares = np.where(own, 0.0, np.log((counts + 0.5) / model.mass[of_word]))
            log_p += np.append(shares, 0.0)[at]
            unknown = at == len(hashes)
            log_p[unknown] += np.log(0.5 / model.mass[classes[unknown]])
        known_ = (at < len(hashes)).astype(np.int64)
        base = base[at]
        sums = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({"doc_id": docs["doc_id"].to_numpy(), "held_out": docs["held_out"].to_numpy(), "n_tokens": lengths, "n_known": sums(known_), "train_tokens": n, "base_score": sums(base), "score": sums(log_p) / math.log(10)}, columns=columns).astype({"doc_id": "Int64"})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(score, schema)


def score_documents(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """One row per row of docs: learns from the documents outside the held-out fold, scores all."""
    parts = chunked(docs.select(F.col("doc_id").cast("long"), "text"), folds, held_out)
    counts = saved(word_counts(parts), "counts")
    totals = saved(counts.groupBy("h").agg(F.sum("own").alias("c")).where("c > 0"), "totals")
    known = counts.select("chunk", "h").join(totals, "h").select("chunk", "h", "c")
    n = int(counts.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0])
    v = totals.count()
    model = trained(parts, starting_model(totals, v))
    return scored(parts, known, model, n, v)
