"""Alignment of two tokenizers against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from timetide.llm import queries
from timetide.llm import token_alignment as X

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(FILES[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
LETTERS = X.byte_alphabet()


def tokens(text):
    """[(id, bytes)] of A and of B by the libraries alone, or two empty lists."""
    if not text:
        return [], []
    a = [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def groups_and_links(a, b):
    groups, links, i, j = [], [], 0, 0
    while i < len(a):
        x, y, na, nb = [a[i][0]], [b[j][0]], len(a[i][1]), len(b[j][1])
        links.append((a[i][0], b[j][0]))
        while na != nb:
            if na < nb:
                i += 1
                na += len(a[i][1])
                x.append(a[i][0])
            else:
                j += 1
                nb += len(b[j][1])
                y.append(b[j][0])
            links.append((a[i][0], b[j][0]))
        groups.append((x, y))
        i, j = i + 1, j + 1
    return groups, links


def brute(docs):
    of = [(d, *(ab := tokens(t)), *groups_and_links(*ab)) for d, t in docs]
    counts = Counter(p for *_, links in of for p in links)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for d, a, b, groups, links in of:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as chunk", "1 as n_a", "2 as pairs")
    out = X.align(df.repartition(3), *FILES, public_tokenizers.PATTERN, **options)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


ODD = [
    (1, "The quick brown fox, tokenization's unbelievable antidisestablishmentarianism 12345 €uro naïve"), (2, None), (3, ""), (4, " "), (5, "  two  spaces \n\n lines\t"), (6, "has ▁ mark"),
    (7, "<s> </s> <|endoftext|> <unk> <0x41>"), (8, "日本語のテキスト 🙂🙂 \u0000 é"), (9, "a"), (10, "The quick brown fox"), (10, "The quick brown fox"), (None, "The fox"), (11, "word " * 4000 + "end"), (12, "x" * 9000), (13, "１２ ﬁ ½ Å̊"),
]


@pytest.mark.parametrize("options", [{}, {"chunk": 5}, {"piece": 16, "leaf": 4}, {"piece": 200, "leaf": 2, "chunk": 60}])
def test_against_brute_force(spark, options):
    assert run(spark, ODD, **options) == brute(ODD)


def test_empty_and_all_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


rising = st.lists(st.integers(1, 60), min_size=1, max_size=40, unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(rising, rising, st.integers(2, 50))
def test_cuts_of_any_ends(a, b, leaf):
    a, b = np.array([*a, 61]), np.array([*b, 61])
    i, j = X.shared_cuts(a, b, leaf)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[i - 1].tolist() == b[j - 1].tolist() == common


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab '.\n1é▁日s "), min_size=1, max_size=60))
def test_pieces_do_not_change_tokens(text):
    small, whole = _aligners()
    got, want = small(text), whole(text)
    a, b = tokens(text)
    assert (got is None) == (want is None) == (not a)
    if got:
        assert got[:4] == want[:4] and got[4].tolist() == want[4].tolist() and got[5].tolist() == want[5].tolist()
        assert (want[0], want[1]) == (len(a), len(b))


def _aligners():
    if not hasattr(_aligners, "made"):
        _aligners.made = X.Aligner(*FILES, public_tokenizers.PATTERN, 5, 2), X.Aligner(*FILES, public_tokenizers.PATTERN)
        assert all(x.a.ranks and x.b.stable for x in _aligners.made)
    return _aligners.made


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_token_alignment"](spark, sf).collect()), key=repr) == brute(docs)
