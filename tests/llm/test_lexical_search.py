"""Ranked lexical search against brute force."""

from __future__ import annotations

import math
import random
import re

import pytest
from tests.compare import oracle_rows, spark_rows

from timetide.llm import lexical_search, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=50):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    texts = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(x) for _, x in texts), sum(len(x) for _, x in texts)
    df = {}
    for _, x in texts:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    out = []
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(terms(t))
    for i, own in of.items():
        scored = []
        for d, x in texts:
            m = 50 + (50 * len(x) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * x.count(t) // (1000 * x.count(t) + 20 * m)) for t in own if t in x)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as rank", "'x' as item_id", "0.5 as score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
    return sorted(map(tuple, lexical_search.ranked(d.repartition(3), i, **options).collect()), key=repr)


ODD = [(1, "The cat. The\x00cat_the-DOG 9lives naïve"), (2, None), (3, ""), (4, " -- ..."), (5, "the cat sat"), (5, "the cat sat"), (None, "cat cat Cat"), (7, "dogÀ dogà DOG" + " word" * 3000), (8, "İstanbul ſ K k"), (9, "concatenate cats catalog")]
ITEMS = [(0, "the CAT"), (1, None), (2, "..."), (3, "dogà"), (4, "unknown words"), (None, "lives 9lives"), (5, "dog"), (5, "cat"), (6, "k K ſ")]


@pytest.mark.parametrize("options", [{}, {"max_items": 2}, {"max_bytes": 10}, {"top": 2}])
def test_ranked_against_brute_force(spark, options):
    assert run(spark, ODD, ITEMS, **options) == brute(ODD, ITEMS, options.get("top", 50))


def test_many_ties_and_more_than_top(spark):
    rng = random.Random(5)
    words = ["ab", "a", "b", "abc", "bc", "é", "x1"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(5)))) for k in range(300)]
    items = [(k, " ".join(rng.sample(words, 3))) for k in range(6)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == [] and run(spark, ODD, []) == []


def test_large_sums_are_exact():
    import numpy as np

    value = np.full(400_000, (1 << 36) + 1, dtype=np.int64)
    assert lexical_search.exact_sums(np.zeros(400_000, dtype=np.int64), value).tolist() == [400_000 * ((1 << 36) + 1)]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(queries.QUERIES["op11_lexical_search"](spark, sf)) == oracle_rows(queries.ORACLES["op11_lexical_search"], sf)
