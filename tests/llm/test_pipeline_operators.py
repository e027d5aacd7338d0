"""Operators 2, 4, 5, 9, 10 and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import DOC_SCHEMA, SF, documents, near_duplicate_components, odd_documents, reachable, words
from tokenizers import Tokenizer

from timetide.llm import common, components, langid, line_dedup, minhash, mixing, packing, queries

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOC_SCHEMA).withColumn("component_id", F.lit("x")).withColumn("size", F.lit(1)).withColumn("length", F.lit(2)).withColumn("line_dedup", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_equals_brute_force(spark):
    want = near_duplicate_components({d["doc_id"]: d["text"] for d in documents()})
    got = queries.op5_minhash_near_dedup(spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_large_group_of_near_copies(spark):
    """Copies of copies: one chain of small edits, far more than a block has members."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(400):
        own = list(base)
        own[int(rng.integers(0, 120))] = f"edit{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"u{i}x{k}" for k in range(50)) + " " + " ".join(base[:30])) for i in range(60)]
    want = near_duplicate_components(dict(rows))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_minhash_finishes_mixed_buckets(spark, monkeypatch):
    """Documents just under the threshold (100 of 134 shingles), and a few pairs just over it (101 of 133) that meet in crowded buckets only."""
    monkeypatch.setattr(minhash, "BLOCK", 64 * 117)  # blocks of 64 documents
    base = [f"b{k}" for k in range(104)]
    texts = {i: [*base, *(f"t{i}x{k}" for k in range(17))] for i in range(300)}
    for i in range(10, 250, 20):
        texts[i][104] = texts[i + 7][104]
    got = minhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string"))
    want = {i: i for i in texts} | {i + 7: i for i in range(10, 250, 20)}
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_minhash_loose_group_loses_no_link(spark):
    """1000 documents that collide in the bands at a similarity of 0.735, and 12 pairs among them at 0.774."""
    rng = np.random.default_rng(5)
    ids, common = [int(i) for i in rng.permutation(5000)[:1000]], [f"c{i}" for i in range(104)]
    tails = [[f"u{k}x{j}" for j in range(18)] for k in range(1000)]
    for k in range(12):
        tails[2 * k + 1][:3] = tails[2 * k][:3]
    rows = [(i, " ".join(common + tail)) for i, tail in zip(ids, tails)]
    want = {i: i for i in ids} | {i: min(ids[2 * (k // 2)], ids[2 * (k // 2) + 1]) for k, i in enumerate(ids[:24])}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_minhash_tiles_split(spark, monkeypatch):
    """Blocks of a few documents: the pairs of blocks together decide what one block decides."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(300):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            w[at] = f"m{rng.integers(40)}"
        texts[i] = " ".join(w)
    monkeypatch.setattr(minhash, "BLOCK", 1500)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == near_duplicate_components(texts)


def test_tile_links_equal_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(30):
        sets = [np.unique(rng.choice(40, int(rng.integers(5, 20)))).astype(np.uint64) for _ in range(25)]
        component, own = np.arange(25), np.zeros(25, dtype=int)
        links = [(a, b) for a in range(25) for b in range(a) if 3 * len(np.union1d(sets[a], sets[b])) <= 4 * len(np.intersect1d(sets[a], sets[b]))]
        found = minhash.joined_in_tile(sets, component, np.ones(25, dtype=bool), own, (75, 100))
        assert reachable(range(25), found) == reachable(range(25), links) and len(found) < 25


def test_minhash_edges(odd, empty):
    got = sorted(tuple(r) for r in minhash.near_duplicates(odd).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (5, 977, 5, True), (6, 978, 5, False), (7, 0, 7, True), (8, 2, 8, True)]
    assert minhash.near_duplicates(empty).count() == 0
    assert sorted(r["doc_id"] for r in minhash.keep_first_of_group(odd).collect()) == [1, 2, 3, 5, 7, 8]


def test_line_dedup_drops_recurring_templates(spark, odd, empty):
    rows = [
        (1, "alpha beta gamma delta epsilon zeta\nrequest 12 took 30 ms on host a7\nonly here one two three"),
        (2, "request 99 took 4 ms on host b2\nsomething of its own in here"),
        (3, "alpha beta gamma delta epsilon zeta\nnothing else repeats in this text"),
        (4, "the quick brown fox jumps over one lazy dog today"),
        (5, "the quick brown fox jumps over one sleepy dog today"),
        (6, "short one\nshort one"),
    ]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[0][1]
    assert out[2]["text"] == "something of its own in here"
    assert out[3]["text"] == "nothing else repeats in this text"
    assert out[4]["text"] == rows[3][1] and out[5]["text"] == ""  # one varying token of ten
    assert out[6]["text"] == rows[5][1]
    kept = line_dedup.keep_new_lines(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 4, 5, 6, 7, 8]
    assert line_dedup.keep_new_lines(empty).count() == 0


def test_line_dedup_exact_lines_brute_force(spark):
    docs = documents()
    first, n_docs = {}, defaultdict(set)
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        for line in (d["text"] or "").split("\n"):
            if len(line.split()) >= line_dedup.MIN_TOKENS:
                first.setdefault(tuple(line.encode().split()), d["doc_id"])
                n_docs[tuple(line.encode().split())].add(d["doc_id"])
    drops = {(r[0], r[1]) for r in line_dedup.recurring_lines(spark.createDataFrame(docs, DOC_SCHEMA)).select("doc_id", "line_no").collect()}
    for d in docs:
        for i, line in enumerate((d["text"] or "").split("\n")):
            key = tuple(line.encode().split())
            if len(n_docs.get(key, ())) > 1 and first[key] != d["doc_id"]:
                assert (d["doc_id"], i) in drops
            elif (d["doc_id"], i) in drops:  # a template with a variable field: some earlier line is alike
                assert any(len(k) == len(key) and sum(x == y for x, y in zip(k, key)) >= 0.6 * len(key) for k in n_docs if k != key)


def line_templates(form: tuple) -> set:
    """All templates of a masked line."""
    n, out = len(form), {form}
    open_tokens = (n - n * 4 // 5) if n % 5 == 0 else n // 5
    if n < 4 or not open_tokens:
        return out
    step, most = max(1, open_tokens // 2), min(2, open_tokens)
    runs = [form[i : i + step] for i in range(4, n, step)]
    for hidden in itertools.combinations_with_replacement(range(len(runs)), 2):
        if most == 2 or hidden[0] == hidden[1]:
            out.add((form[:4], n, hidden, tuple(r for k, r in enumerate(runs) if k not in hidden)))
    return out


def brute_line_drops(texts, min_tokens: int) -> set:
    """(doc, line_no) of the lines to drop, one form after the other in the order of their first lines. texts: {doc: text}, docs in order."""
    docs, first = defaultdict(set), {}
    lines = []
    for doc in sorted(texts):
        for number, line in enumerate((texts[doc] or "").encode().split(b"\n")):
            t = line.split()
            if t and len(t) >= min_tokens:
                form = tuple(b"<*>" if len(t) >= 4 and any(48 <= c <= 57 for c in x) else x for x in t)
                lines.append((doc, number, form))
                first.setdefault(form, doc)
                for template in line_templates(form):
                    docs[template].add(doc)
    held, goes = defaultdict(set), {}
    for form in first:
        recurring = [t for t in line_templates(form) if len(docs[t]) > 1]
        for_it = set().union(*[held[t] for t in recurring])
        if for_it:
            goes[form] = for_it
        else:
            for t in recurring:
                held[t].add(first[form])
    return {(d, i) for d, i, f in lines if any(d != x for x in goes.get(f, {first[f]})) and (f in goes or len(docs[f]) > 1)}


def line_drops(frame, **options) -> set:
    return {(r[0], r[1]) for r in line_dedup.recurring_lines(frame, **options).select("doc_id", "line_no").collect()}


def test_line_dedup_equals_brute_force(spark):
    texts = {d["doc_id"]: d["text"] for d in documents()}
    out = {r["doc_id"]: r for r in queries.op2_line_dedup(spark, SF).collect()}
    want = brute_line_drops(texts, 1)
    assert len(want) > 50
    for doc_id, text in texts.items():
        kept = "\n".join(x for i, x in enumerate((text or "").split("\n")) if (doc_id, i) not in want)
        assert out[doc_id]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest() and out[doc_id]["n_dropped"] == len([1 for d, _ in want if d == doc_id])


def test_line_dedup_random_leaves(spark):
    """Lines of a few leaves that differ in 0 to 4 places."""
    rng = np.random.default_rng(8)
    texts = {}
    for i in range(120):
        n = int(rng.choice([4, 5, 6, 9, 10, 12, 16, 23, 40]))
        line = [f"t{'abcd'[int(rng.integers(2))]}{'qrst'[k % 4]}" if k < 1 else "w" + "xyz"[k % 3] for k in range(n)]
        for at in rng.choice(n, min(n, int(rng.integers(0, 5))), replace=False):
            line[at] = "v" + "klmno"[int(rng.integers(5))]
        texts[i] = " ".join(line)
    got = line_drops(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), min_tokens=1)
    assert got == brute_line_drops(texts, 1) and got


def test_line_dedup_templates_of_one_leaf(spark):
    """Two templates of one leaf: the lines of one never save those of the other."""
    a = lambda name: "one two three four " + " ".join(f"a{'bcdefghijkl'[i]}" for i in range(11)) + f" {name}"
    b = lambda name: "one two three four " + f"{name} " + " ".join(f"z{'bcdefghijkl'[i]}" for i in range(11))
    for n_a, n_b in ((3, 0), (0, 3), (3, 3), (4, 2)):
        lines = [a(x) for x in ("ann", "bob", "cid", "dot")[:n_a]] + [b(x) for x in ("eve", "fay", "gus", "hal")[:n_b]]
        frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
        assert line_drops(frame) == {(i, 0) for i in range(n_a + n_b) if i not in (0, n_a)}


def test_line_dedup_shared_ids(spark):
    """Rows of one id are documents of their own: what only one of them has stays."""
    rows = [(2, "unique first line of this row here\nalpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon\nnever seen text of the other row"), (2, "alpha beta gamma delta epsilon\nnever seen text of the other row"), (3, "alpha beta gamma delta epsilon\nthird"), (None, "alpha beta gamma delta epsilon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.lit("x")).withColumn("doc", F.lit(1))
    out = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs, min_tokens=1).drop("line_dedup").collect()]
    assert len(out) == 5 and (None, rows[4][1]) in out and (3, "third") in out
    text = "\n".join(t for _, t in out if _ == 2)
    assert "unique first line" in text and text.count("never seen text") == 2
    kept = [t for i, t in out if i == 2 and t.count("alpha")]
    assert len({*kept}) == 1  # the first of the two texts, in each row that has it
    again = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.keep_new_lines(docs, min_tokens=1).collect())
    assert again == sorted((i or 0, t) for i, t in out)


def chain(n: int) -> list[str]:
    """Lines of 20 tokens, each two tokens from the one before, ever further from the first."""
    words = [f"w{'abcdefghijklmnopqrst'[k]}" for k in range(20)]
    lines = [" ".join(words)]
    for k in range(1, n):
        for at in (4 + 2 * k % 16, 4 + (2 * k + 1) % 16):
            words[at] = f"v{'abcdefghijklmnopqrst'[at]}{'klmnopqr'[k % 8]}{'xyz'[k // 8 % 3]}"
        lines.append(" ".join(words))
    return lines


@pytest.mark.parametrize("rounds", [16, 1])
def test_line_dedup_chain_keeps_what_is_new(spark, rounds):
    """A line goes only if one that stays is alike: no line of a chain goes with another that has gone."""
    lines = chain(9 if rounds == 16 else 24)
    drops = {d for d, _ in line_drops(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), ordered_rounds=rounds)}
    if rounds == 16:
        assert drops == {d for d, _ in brute_line_drops(dict(enumerate(lines)), 4)} and drops.isdisjoint({0, 3, 6})
    kept = [k for k in range(len(lines)) if k not in drops]
    for k in drops:
        assert any(sum(x == y for x, y in zip(lines[k].split(), lines[j].split())) >= 16 for j in kept)
    assert not any(line_templates(tuple(lines[a].encode().split())) & line_templates(tuple(lines[b].encode().split())) for a in kept for b in kept if a < b)


def test_line_dedup_more_documents(spark):
    """min_docs of 3: what two documents share stays."""
    rows = [(1, "one two three four five six\na b c d e"), (2, "one two three four five six\na b c d e"), (3, "one two three four five six")]
    got = line_drops(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3)
    assert got == {(2, 0), (3, 0)}


def test_line_dedup_short_lines(spark, tmp_path):
    """The query and the stage drop short lines too, as exact repeats."""
    import corpus_pipeline

    rows = [(1, "All rights reserved.\nPage 12\n\nx\nx"), (2, "own words\n All  rights\treserved.\nPage 13\n"), (3, "Page 12\n\nthird text"), (4, "ALL RIGHTS RESERVED.\n<*>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["n_dropped"] for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert kept == dict(rows) | {2: "own words\nPage 13\n", 3: "\nthird text"}


def test_language_accuracy_and_rejection(spark, odd, empty):
    rows = {d["doc_id"]: d for d in documents("/root/testdata/sf0.01")}
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in got]) < 0.01
    model = langid.fit(langid.training_rows(spark.createDataFrame(list(rows.values()), DOC_SCHEMA)))
    assert model.predict("12 34 -- !!") == ("und", 0.0, True) and model.predict(None)[0] == "und"
    assert model.predict("漢字かな交じり文テキスト日本語" * 20)[2]
    out = {r["doc_id"]: r for r in langid.identify(odd, langid.fit(odd)).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[7]["lang_pred"] == "und" and out[3]["lang_pred"] in ("en", "fr", "de")
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    lone = langid.identify(odd.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")), langid.fit(odd)).collect()
    assert [r["held_out"] for r in lone] == [False]
    assert langid.keep_identified(odd, langid.fit(odd)).columns == odd.columns


def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check_mix(got, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(words(d["text"]))
    want = brute_targets(sizes)
    source = {d["doc_id"]: d["source"] for d in docs}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.01, abs=3), s


def test_mixing(spark, empty):
    docs = documents("/root/testdata/sf0.01")
    got = queries.op10_source_mixing(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((d["doc_id"], len(words(d["text"]))) for d in docs)
    check_mix(got, docs)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op10_source_mixing(spark, "/root/testdata/sf0.01").collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_edges(spark, odd):
    got = mixing.mix(odd).collect()
    check_mix(got, [dict(zip(("doc_id", "text", "lang", "source"), r)) for r in odd_documents()])
    small = spark.createDataFrame([(i, "a b c", "en", "s%d" % (i % 50), 1) for i in range(60)], DOC_SCHEMA)
    check_mix(mixing.mix(small).collect(), [r.asDict() for r in small.collect()])
    assert mixing.mixed_documents(odd).columns == odd.columns


def check_packing(got, docs, capacity=2048):
    tok = Tokenizer.from_file(TOKENIZER)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[doc_id] += [(i, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for i, s in enumerate(range(0, len(ids), capacity))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in got) // capacity)


def test_packing(spark, odd, empty):
    used, least = check_packing(queries.op4_best_fit_packing(spark, "/root/testdata/sf0.01").collect(), [(d["doc_id"], d["text"]) for d in documents("/root/testdata/sf0.01")])
    assert used <= 1.02 * least + 1
    check_packing(packing.pack(odd, TOKENIZER).collect(), [(r[0], r[1]) for r in odd_documents()])
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_word_encoder_equals_whole_text():
    tok, encode = Tokenizer.from_file(TOKENIZER), packing.word_encoder(TOKENIZER)
    rng = np.random.default_rng(5)
    parts = ["it's", "I'LL", "ΣΑΣ", "é", "́x", "a b", "c d", "x\x1cy", "\x85", "<|endoftext|>", "<|endoftext|>z", "12ab", "日本語", "😀😀", "ǅ", "İ", "​", "...!?", "'s", "'", "﻿"]
    for _ in range(300):
        text = "".join(p + str(rng.choice([" ", "\n", "\t ", "", "\r\n", "\x0b", "\x0c"])) for p in rng.choice(parts, 12))
        assert np.frombuffer(encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def brute_language_vector(text: str) -> np.ndarray | None:
    """Dampened counts of hashed 1- to 3-grams of letters, runs of anything else being one space, gram by gram."""
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    if not letters.strip():
        return None
    padded = " " + " ".join(letters.split()) + " "
    counts = np.zeros(langid.DIM)
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            key = 0
            for c, mult in zip(padded[i : i + n], langid._MULTIPLIERS):
                key = (key ^ ord(c)) * int(mult) % 2**32
            counts[(key ^ key >> 15) * 2654435769 % 2**32 >> 20] += 1
    return np.log1p(counts)


def test_language_equals_brute_force(spark):
    """The nearest of all centroids by cosine, worked out one by one, with rejection under the threshold."""
    docs = spark.createDataFrame(documents(), DOC_SCHEMA)
    model = langid.fit(langid.training_rows(docs))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for d in documents():
        v = brute_language_vector(d["text"] or "")
        r = got[d["doc_id"]]
        if v is None:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        x = v * model.idf
        cosines = [float(np.dot(x, c) / np.linalg.norm(x)) for c in model.centroids]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        lang = int(model.owner[best])
        assert r["lang_pred"] == model.langs[lang] and r["score"] == pytest.approx(cosines[best], abs=1e-9)
        assert r["rejected"] == (r["score"] < model.thresholds[lang])


def test_packing_holds_little_at_once(spark):
    """Tasks of a worker share one cache of words, and get few texts at once."""
    assert packing.word_encoder(TOKENIZER) is packing.word_encoder(TOKENIZER)
    sizes = lambda df: [r["n"] for r in df.mapInPandas(lambda it: (p.assign(n=len(p))[["n"]].head(1) for p in it), "n long").collect()]
    with common.arrow_rows(spark, 7):
        assert max(sizes(spark.range(50))) == 7
    assert max(sizes(spark.range(50, numPartitions=1))) == 50


def test_word_encoder_of_any_tokenizer():
    """The cache of words is for the file that it knows; any other one encodes whole texts."""
    texts = ["The  Cat's 12 tails\n<|endoftext|> naïve ÀÉ", "", None, "x" * 3000]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tok = Tokenizer.from_file(public_tokenizers.path(name))
        encode = packing.word_encoder(public_tokenizers.path(name))
        for text in texts:
            assert np.frombuffer(encode(text), dtype="<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids


def test_pipeline_equals_brute_force(spark):
    """Stage by stage: what each keeps of its own input."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    source = spark.createDataFrame(documents(), DOC_SCHEMA)
    model = langid.fit(langid.training_rows(source))
    docs = {d["doc_id"]: d for d in documents()}
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    known = stages["language ID"](spark, source, SF).persist()
    want = {i: d["text"] for i, d in docs.items() if not model.predict(d["text"])[2]}
    assert texts(known) == want

    drops = brute_line_drops(want, 1)
    lined = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in drops) for i, t in want.items()}
    lined = {i: t for i, t in lined.items() if t.strip(" ") or not any(d == i for d, _ in drops)}
    new = stages["line dedup"](spark, known, SF).persist()
    assert texts(new) == lined
    assert all(r["n_chars"] == len(r["text"]) for r in new.collect() if any(d == r["doc_id"] for d, _ in drops))

    kept = stages["MinHash near-dedup"](spark, new, SF).persist()
    assert texts(kept) == {i: lined[i] for i, c in near_duplicate_components(lined).items() if i == c}

    rows = [r.asDict() for r in kept.collect()]
    taken = {r["doc_id"]: r for r in mixing.mix(kept).collect()}
    check_mix(taken.values(), rows)
    mixed = stages["source mixing"](spark, kept, SF).persist()
    times = defaultdict(int)
    for r in mixed.collect():
        times[r["doc_id"]] += 1
    assert times == {i: n for i, n in ((i, 1 if r["size"] == 0 else -(-r["taken"] // r["size"])) for i, r in taken.items()) if n}

    packed = stages["best-fit packing"](spark, mixed, SF).collect()
    tok = Tokenizer.from_file(TOKENIZER)
    own = {i: len(tok.encode(lined[i] or "", add_special_tokens=False).ids) + 1 for i in times}
    lengths, places = defaultdict(int), defaultdict(list)
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert lengths == {i: n * own[i] for i, n in times.items()}
    for sequence in places.values():
        end = 0
        for offset, length in sorted(sequence):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "best-fit packing":
            assert docs.columns == columns, name
        if name == "MinHash near-dedup":
            left = near_duplicate_components({r["doc_id"]: r["text"] for r in docs.collect()})
            assert all(k == v for k, v in left.items())
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_pipeline_on_odd_and_empty(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for k, docs in enumerate((odd, empty)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{i}"))


def test_word_encoder_on_documents():
    tok, encode = Tokenizer.from_file(TOKENIZER), packing.word_encoder(TOKENIZER)
    for d in documents():
        assert np.frombuffer(encode(d["text"]), "<u4").tolist() == tok.encode(d["text"] or "", add_special_tokens=False).ids
    for cp in [*range(1, 0x250), 0x1C4, 0x3A3, 0x2581, 0x1E9E, 0xFB01]:
        for text in (chr(cp), f"a{chr(cp)}b", f"1{chr(cp)}'S"):
            assert np.frombuffer(encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, hex(cp)


def test_running_offsets(spark, monkeypatch):
    from timetide.llm import common

    monkeypatch.setattr(common, "SPAN", 3)
    rows = [(g, b, (7 * b + len(g)) % 5) for g in ("a", "bb") for b in range(17) if (b + len(g)) % 4]
    got = {(r["g"], r["b"]): r["before"] for r in common.running_offsets(spark.createDataFrame(rows, "g string, b long, n long"), ["g"], "b", "n").collect()}
    assert got == {(g, b): sum(n for h, c, n in rows if h == g and c < b) for g, b, _ in rows}


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    from timetide.llm import common

    monkeypatch.setattr(common, "_SLICE", 64)
    monkeypatch.setattr(common, "_tables", {})
    rng, seen = np.random.default_rng(4), {}
    lengths = [1, 2, 3, 62, 63, 64, 65, 66, 200]
    words_ = ["".join("abcé"[int(k)] for k in rng.integers(0, 4, n)) for n in lengths for _ in range(4)]
    for _ in range(60):
        picked = [words_[int(i)] for i in rng.integers(0, len(words_), int(rng.integers(0, 12)))]
        text = "".join(w + " \t\n\r\x0b\x0c"[int(rng.integers(6))] * int(rng.integers(1, 90)) for w in picked)
        text = text.upper().replace("É", "é") if rng.random() < 0.5 else text
        got = common.word_hashes(text.rstrip() if rng.random() < 0.3 else text).tolist()
        assert len(got) == len(picked)
        for w, h in zip(picked, got):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) and len(common.word_hashes(None)) == len(common.word_hashes(" \n")) == 0
