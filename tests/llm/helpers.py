"""Small inputs and brute-force versions for the tests of the training-data operators."""

from __future__ import annotations

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(sf: str = SF) -> list[dict]:
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, n: int = 5) -> set:
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def reachable(nodes, links) -> dict:
    """node -> smallest node reachable."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_duplicate_components(texts: dict) -> dict:
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return reachable(ids, links)


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, "one two three", None, "a", 13),
        (4, "one two three", "fr", "b", 13),
        (4, "one two three", "fr", "b", 13),
        (5, long, "en", "a", None),
        (6, long + " tail", "en", "", None),
        (7, " \t\n ", "en", "a", 4),
        (8, "é́ ÀÉ straße 123 4 !!", "de", "c", None),
    ]
