"""Operators 1, 3, 6, 7, 8 against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tests.llm.helpers import DOC_SCHEMA, SF, documents, odd_documents, reachable, words

from timetide.llm import embeddings, fingerprints, language_model, queries, token_counts, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOC_SCHEMA).withColumn("h", F.lit("x")).withColumn("chunk", F.lit(1)).withColumn("term", F.lit(2)).withColumn("side", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def jaccard(a: str, b: str) -> float:
    x, y = Counter(words(a)), Counter(words(b))
    every = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in every) / sum(max(x[k], y[k]) for k in every) if every else 1.0


def test_fingerprints(spark):
    texts = {d["doc_id"]: d["text"] or "" for d in documents()}
    ids = sorted(texts)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    got = queries.op1_fingerprints(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == ids
    errors, of = [], {}
    for r in got:
        text, after = texts[r["doc_id"]], texts[following[r["doc_id"]]]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, after)]
        for t, f in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert of.setdefault(t, f) == f
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.1


def test_fingerprint_edges(spark, odd, empty):
    got = fingerprints.with_edited_and_next(odd).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 4, 4, 5, 6, 7, 8]
    out = {r["doc_id"]: r for r in got}
    assert out[1]["fingerprint"] == out[2]["fingerprint"] == out[7]["fingerprint"] == ""
    assert out[1]["near_next"] == 1.0 and out[2]["near_next"] == 0.0 and out[3]["near_next"] == 1.0 and out[3]["fingerprint"] == out[4]["fingerprint"]
    assert out[5]["near_next"] > 0.9
    assert fingerprints.with_edited_and_next(empty).count() == 0 and fingerprints.fingerprints(empty).count() == 0
    # an id shared by different texts, and rows without an id: all have their own fingerprints
    texts = [(5, "one two three"), (5, "four five six seven"), (5, "four five six seven"), (None, "eight"), (None, "nine ten")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    both = [(r["doc_id"], r["n_chars"], r["fingerprint"]) for r in fingerprints.with_edited_and_next(rows).collect()]
    assert sorted((str(i), n) for i, n, _ in both) == sorted((str(i), len(t)) for i, t in texts) and len(set(both)) == 4
    assert sorted(map(str, fingerprints.fingerprints(rows).collect())) == sorted(f"Row(doc_id={i}, fingerprint='{f}')" for i, _, f in both)


def brute_links(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float64)
    links = []
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links.append((a, b))
    return links


def test_embeddings_equal_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()]
    links = brute_links(rows)
    degree, component = Counter(x for ab in links for x in ab), reachable([i for i, _ in rows], links)
    got = queries.op3_embedding_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (degree[i], component[i], component[i] == i) for i, _ in rows}


def test_embedding_recall_at_the_threshold(spark):
    """Random pairs with a cosine just over the threshold, the hardest to find."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.standard_normal((1500, 64))
    other -= (other * base).sum(axis=1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    near = 0.91 * base + np.sqrt(1 - 0.91**2) * other
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((base, near)))]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).agg(F.sum("n_links")).first()[0]
    assert got / 3000 >= 0.95


def test_embedding_edges(spark):
    one = [0.5, 0.5, 0.1]
    rows = [(1, one), (2, one), (3, [1.0, 1.0, 0.2]), (3, [1.0, 1.0, 0.2]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, []), (10, [1.0, 1.0]), (11, [-0.0, 1.0, 0.0]), (12, [0.0, 2.0, 0.0]), (None, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("rep", F.lit("x"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect())
    assert got[:4] == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (3, 3, 1)]
    assert got[4:] == [(4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 1, 11), (12, 1, 11)]
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_long_lists_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.2 * rng.standard_normal(16)).tolist()) for i in range(150)]
    links = Counter(x for ab in brute_links(rows) for x in ab)
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = np.array([links[r["vec_id"]] for r in got])
    assert all(r["n_links"] <= links[r["vec_id"]] for r in got) and sum(r["n_links"] for r in got) >= 0.95 * want.sum()


def test_warc_round_trip(spark):
    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = {r["page_id"]: r for r in queries.op6_warc(spark, SF).collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault((pages[i]["html"] or "").encode(), i)
    assert sorted(got) == sorted(pages)
    for i, p in pages.items():
        body = (p["html"] or "").encode()
        again = first[body] != i and len(body) >= 100
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None)


def test_warc_texts_order_and_edges(spark):
    same = "x" * 120
    rows = [(5, "http://b.example.org/2", same), (2, "https://www.b.example.org:80/1?q#f", same), (9, None, same), (None, "u", same), (7, "http://a.example.org", "short"), (8, "http://a.example.org/", "short"), (3, "http://é.cz/\r\nx", None), (2, "https://www.b.example.org:80/1?q#f", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("x")).withColumn("file", F.lit(1)).repartition(3)
    index, records, _ = warc.archive(df, file_bytes=200, range_rows=2)
    got = {r["page_id"]: r for r in records.collect()}
    assert len(records.collect()) == 8
    assert got[5]["refers_to"] == got[9]["refers_to"] == got[None]["refers_to"] == 2 and got[2]["record_type"] == "response" and got[2]["html"] == same
    assert got[7]["record_type"] == got[8]["record_type"] == "response" and got[3]["payload_bytes"] == 0 and got[5]["html"] is None
    order = [(r["url_key"], r["captured_at"]) for r in index.orderBy("part", "place").collect()]
    assert order == sorted(order) and "org,example,b)/1?q" in [k for k, _ in order]
    assert warc.archive(df.limit(0))[1].count() == 0


def test_embedding_sizes_beyond_squares(spark):
    """Cosines do not depend on the length of the vectors, however long or short."""
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 0.0]), (4, [1e-200, 0.0]), (5, [3.0, 0.0]), (6, [1.0, 1.0]), (7, [5e-324, 0.0]), (8, [1.7e308, -1.7e308])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 6: (2, 1), 3: (3, 3), 4: (3, 3), 5: (3, 3), 7: (3, 3), 8: (0, 8)}


def test_warc_capture_times_and_read_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    rows = [(i, "http://a.example.org/", f"{i} " + hashlib.sha256(str(i).encode()).hexdigest() * 3, None if i == 7 else f"2020-01-{1 + (60 - i) % 28:02d} 00:00:{i:02d}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, captured_at string").withColumn("captured_at", F.col("captured_at").cast("timestamp")).repartition(5)
    index, records, _ = warc.archive(df, range_rows=10)
    assert records.rdd.getNumPartitions() > 4  # one URL, a few files: the readers share them
    assert {(r["page_id"], r["html"]) for r in records.collect()} == {(r[0], r[2]) for r in rows}
    times = [(r["captured_at"], r["page_id"]) for r in index.orderBy("part", "place").collect()]
    assert times == sorted((f"{t[:10]}T{t[11:]}Z" if t else "2024-01-01T00:00:07Z", i) for i, _, _, t in rows)
    assert index.select("part").distinct().count() > 3


def test_warc_reading_checks_payloads(spark, tmp_path):
    record = warc.record_bytes(1, "u", "2024-01-01T00:00:00Z", b"payload", hashlib.sha256(b"another").hexdigest(), "response", None)
    import gzip

    data = gzip.compress(record)
    (tmp_path / "x.warc.gz").write_bytes(data)
    index = spark.createDataFrame([("x.warc.gz", 0, len(data))], "file string, offset long, length long")
    with pytest.raises(Exception, match="not the one of the record"):
        warc.read_archives(index, str(tmp_path)).collect()


def test_loser_tree():
    rng = random.Random(4)
    for k in range(0, 9):
        runs = [sorted((rng.randrange(30), i) for _ in range(rng.randrange(12))) for i in range(k)]
        assert [x[0] for x in warc.LoserTree(runs)] == sorted(x[0] for r in runs for x in r)


def test_token_counts(spark, odd, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r for r in queries.op7_token_counts(spark, "/root/testdata/sf0.01").collect()}
    for d in documents("/root/testdata/sf0.01"):
        text = d["text"] or ""
        n = len(sp.encode(text))
        assert tuple(got[d["doc_id"]])[1:] == (len(text.encode()), n, n > 4096)
    out = [tuple(r) for r in token_counts.token_counts(odd, MODEL).orderBy("doc_id").collect()]
    assert out[0] == (1, 0, 0, False) and len(out) == 9 and out[5][2] == len(sp.encode(odd_documents()[5][1]))
    assert token_counts.token_counts(empty, MODEL).count() == 0


def test_spliced_counts_equal_whole_ones():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    small = token_counts.TokenCounter(MODEL, chunk=64, overlap=4)
    rng = random.Random(9)
    parts = ["word", "Ärger", "日本語テキスト", "  ", "   x", "▁", "▁▁y", "😀", "<s>", "\n\n", "a" * 90, "12345", "é", "\t", " ", "."]
    for _ in range(150):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", " "]) for _ in range(60))
        assert small(text) == len(sp.encode(text)), repr(text)
    assert small("x" * 5000) == len(sp.encode("x" * 5000)) and small.widened > 0


def test_language_model(spark):
    docs = documents("/root/testdata/sf0.01")
    train = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 != 1]
    counts = Counter(w for d in train for w in words(d["text"]))
    counts["end"] += 0
    ends = len(train)
    del counts["end"]
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = {r["doc_id"]: r for r in queries.op8_lm_scoring(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    floor = np.log10(n + 0.5 * (v + 1))
    for d in docs:
        w, r = words(d["text"]), got[d["doc_id"]]
        c = np.array([*(counts.get(x, 0) for x in w), ends])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 1, len(c), int((c > 0).sum()), n)
        assert r["base_score"] == pytest.approx(float((np.log10(c + 0.5) - floor).sum()))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def small_model(rng, words=60):
    """A model of a few counted words with random parameters, and the counts."""
    counts = {int(h): int(c) for h, c in zip(rng.integers(0, 2**60, words), rng.integers(1, 90, words))} | {language_model.END: 20}
    tops = sorted(counts.items(), key=lambda x: -x[1])[:20]
    if language_model.END not in dict(tops):
        tops = tops[:-1] + [(language_model.END, 20)]
    buckets = np.full(20, 0.5)
    for h, c in counts.items():
        if h not in dict(tops):
            buckets[h % 20] += c + 0.5
    model = language_model.Model.start(tops, buckets)
    return model.with_parameters(model.parameters() + rng.normal(0, 0.2, len(model.parameters()))), counts, buckets


def test_language_model_equals_brute_force():
    """Scores as written out word by word, normalised over all words and one unknown word of each bucket."""
    rng = np.random.default_rng(1)
    m, counts, buckets = small_model(rng)
    k = len(m.mass)
    end = int(m.classes(np.array([language_model.END]))[0][0])

    def brute(word: int, last: int, before: int) -> float:
        (c,), (own,) = m.classes(np.array([word]))
        h = m.q[last] * m.c1 + m.q[before] * m.c2
        groups = np.exp([h @ u + a for u, a in zip(m.u, m.a)])
        g = c // m.size
        inside = np.exp([h @ m.r[x] + m.b[x] for x in range(g * m.size, min(k, (g + 1) * m.size))])
        share = 1.0 if own else (counts.get(word, 0) + 0.5) / buckets[word % 20]
        return float(groups[g] / groups.sum() * inside[c - g * m.size] / inside.sum() * share)

    unknown = []
    for bucket in range(20):
        unknown.append(next(x for x in range(bucket + 20_000, 10**6, 20) if x not in counts))
    assert sum(brute(w, 3, 5) for w in [*counts, *unknown]) == pytest.approx(1, abs=1e-5)
    text = np.array([*rng.choice([*counts, *unknown], 50), language_model.END])
    classes, own = m.classes(text)
    got = m.log_probability(classes, m.contexts(classes, np.array([0])))
    got = got + np.where(own, 0.0, np.log((np.array([counts.get(int(w), 0) for w in text]) + 0.5) / m.mass[classes]))
    want = [np.log(brute(int(w), int(classes[i - 1]) if i else end, int(classes[i - 2]) if i > 1 else end)) for i, w in enumerate(text)]
    assert got == pytest.approx(np.array(want), abs=1e-4)


def test_language_model_training_follows_the_gradient():
    """Over many noise samples, training brings the probabilities of a repeated pair of words up."""
    rng = np.random.default_rng(2)
    m, counts, _ = small_model(rng, 30)
    classes = np.tile(m.classes(np.array(list(counts)[:4]))[0], 3000)
    contexts = m.contexts(classes, np.array([0]))
    trainer = language_model.Trainer(m)
    before = m.log_probability(classes, contexts).mean()
    for _ in range(20):
        trainer.train(contexts, classes)
    assert trainer.m.log_probability(classes, contexts).mean() > max(before, -1.0)


def test_language_model_does_not_depend_on_tasks(spark, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK_CHARS", 200_000)
    docs = spark.createDataFrame([(d["doc_id"], d["text"]) for d in documents()], "doc_id long, text string")
    scores = [{r["doc_id"]: r["score"] for r in language_model.score_documents(docs.repartition(n)).collect()} for n in (2, 7)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)


def test_language_model_edges(odd, empty):
    got = {r["doc_id"]: r for r in language_model.score_documents(odd).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == got[7]["n_tokens"] == 1 and got[5]["n_tokens"] == 30_001
    assert language_model.score_documents(odd).count() == 9
    assert language_model.score_documents(empty).count() == 0
    alone = language_model.score_documents(odd.where("crc32(cast(doc_id as string)) % 5 = 1")).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 for r in alone)
