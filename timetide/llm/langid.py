"""Language identification by nearest centroid.

Texts become hashed letter 1- to 3-gram TF-IDF vectors of unit length; each language has several
centroids from spherical k-means; a text takes the language of the most similar centroid. A text
whose cosine falls under that language's threshold is rejected.

Edge cases: null text, or text without a letter, gives ('und', 0.0, rejected). An empty or
unlabelled training table gives 'und' for every row. Repeated rows are predicted alike. Equal
cosines go to the first centroid in order of language name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetide.llm.common import remainder, saved

DIM = 4096
CENTROIDS_PER_LANG = 3
#: Bound on the labelled rows that the classifier is fitted on, over all languages.
MAX_SAMPLE = 2000
#: A text is rejected under this share of the 1st percentile of its language's training cosines.
REJECT_SHARE = 0.5

_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> lower-case letter, or a space for anything that is not a letter."""
    if not _letters:
        lut = np.full(0x110000, 32, dtype=np.uint32)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                lut[cp] = ord(ch.lower()[0])
        _letters.append(lut)
    return _letters[0]


def text_vector(text: str | None) -> np.ndarray | None:
    """Dampened n-gram counts of the whole text, or None when it has no letter."""
    if not text:
        return None
    letters = _letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    if not (letters != 32).any():
        return None
    padded = np.concatenate(([np.uint32(32)], letters, [np.uint32(32)])).astype(np.uint32)
    keep = ~((padded[1:] == 32) & (padded[:-1] == 32))
    padded = np.concatenate((padded[:1], padded[1:][keep]))
    key = np.zeros_like(padded)
    out = np.zeros(DIM)
    for n, mult in enumerate(_MULTIPLIERS):
        if len(padded) <= n:
            break
        key = (key[: len(padded) - n] ^ padded[n:]) * mult
        hashed = key ^ (key >> np.uint32(15))
        out += np.bincount((hashed * np.uint32(2654435769)) >> np.uint32(20), minlength=DIM)
    return np.log1p(out)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


@dataclass
class LanguageModel:
    langs: list[str]
    owner: np.ndarray  # centroid -> index in langs
    centroids: np.ndarray  # unit rows
    idf: np.ndarray
    thresholds: np.ndarray  # per language

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        v = text_vector(text)
        if v is None or not self.langs:
            return "und", 0.0, True
        cosines = self.centroids @ _unit(v * self.idf)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        lang = int(self.owner[best])
        return self.langs[lang], score, score < self.thresholds[lang]


def _clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means with farthest-first seeds."""
    seeds = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        seeds.append(x[int(np.argmin((x @ _unit(np.array(seeds)).T).max(axis=1)))])
    centres = _unit(np.array(seeds))
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        centres = _unit(np.array([x[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))]))
    return centres


def fit(labelled: DataFrame, max_sample: int = MAX_SAMPLE) -> LanguageModel:
    """Fit on a sample of at most about max_sample rows of (doc_id, text, lang), even over the languages."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    totals = rows.groupBy("lang").count()
    share = F.lit(float(max_sample)) / F.greatest(F.lit(1), F.lit(totals.count()))
    # one row per language, written so that its size is known and the texts need no shuffle
    rates = saved(totals.select("lang", (share / F.col("count")).alias("rate")), "rates")
    point = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000)) / 1e6
    sample = rows.join(rates, "lang").where(point < F.col("rate")).select("lang", "text")

    def vectors(batches):
        for pdf in batches:
            found = [text_vector(t) for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"], "v": [None if v is None else v.astype(np.float16).tobytes() for v in found]})

    got = sample.mapInPandas(vectors, "lang string, v binary").where("v is not null").limit(2 * max_sample).toPandas()
    if not len(got):
        return LanguageModel([], np.zeros(0, int), np.zeros((0, DIM)), np.ones(DIM), np.zeros(0))
    got = got.assign(key=[bytes(v) for v in got["v"]]).sort_values(["lang", "key"])
    x = np.array([np.frombuffer(v, dtype=np.float16) for v in got["key"]], dtype=np.float64)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x = _unit(x * idf)
    langs, owner, centres, thresholds = sorted(set(got["lang"])), [], [], []
    for i, lang in enumerate(langs):
        own = x[(got["lang"] == lang).to_numpy()]
        c = _clusters(own, CENTROIDS_PER_LANG)
        owner += [i] * len(c)
        centres.append(c)
        thresholds.append(REJECT_SHARE * float(np.quantile((own @ c.T).max(axis=1), 0.01)))
    return LanguageModel(langs, np.array(owner), np.vstack(centres), idf, np.array(thresholds))


def predicted(model: LanguageModel, text: Column) -> Column:
    """Struct (lang_pred, score, rejected) of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per row of docs."""
    p = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), predicted(model, F.col("text")).alias("p"))
    return p.select("doc_id", "held_out", "p.*")


def training_rows(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    return docs.where(remainder(F.col("doc_id"), folds) != held_out)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows whose language is known; every column stays as it was."""
    name = "_timetide_language"
    return docs.withColumn(name, predicted(model, F.col("text"))).where(~F.col(f"{name}.rejected")).drop(name)
