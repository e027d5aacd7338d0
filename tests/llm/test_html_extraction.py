"""HTML extraction: the cut against brute force, hand-made pages, the test pages' articles."""

from __future__ import annotations

import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from timetide.llm import html_extraction as X
from timetide.llm import queries

MODEL = X.shape_model(np.zeros((X.SHAPES, 2)))


def energy(label, costs, edges):
    return sum(abs(c) for c, x in zip(costs, label) if x != (c >= 0) and c) + sum(w for i, j, w in edges if label[i] != label[j])


def test_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(1, 9)
        costs = [rng.randrange(-6, 7) for _ in range(n)]
        edges = [(*rng.sample(range(n), 2), rng.randrange(0, 9)) for _ in range(rng.randrange(0, 14))] if n > 1 else []
        got = X.min_cut(costs, edges)
        least = min(energy(x, costs, edges) for x in itertools.product((False, True), repeat=n))
        best = max((x for x in itertools.product((False, True), repeat=n) if energy(x, costs, edges) == least), key=sum)
        assert tuple(got) == best, (costs, edges)


def test_cut_of_a_long_undecided_chain():
    n = 20_000
    costs = [3 if k % 4 < 2 else -3 for k in range(n)]
    began = time.time()
    X.min_cut(costs, [(k, k + 1, 5) for k in range(n - 1)])
    assert time.time() - began < 20


CASES = [
    (
        '<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies. Accept them now.</p></div><main><h2>Title &amp; more</h2>'
        '<p>Long text of several words, with <a href="x">a link</a>. And<br>more.</p><form><label>Mail</label><input></form><aside><p>Side text that is long enough to look like prose.</p></aside>'
        '<ul><li>One point of the text</li><li>Two</li></ul></main><section id="comments"><article class="comment"><p>Great article, thanks a lot for this. I liked it.</p></article></section><footer>&copy; x</footer></body></html>',
        "Title & more\nLong text of several words, with a link. And more.\nOne point of the text\nTwo",
    ),
    (
        '<body class="has-sidebar"><div class="sidebar-left"><a href="a">A</a><a href="b">B</a></div><div class="entry-content no-sidebar"><div class="entry-header"><h1>Head</h1></div>First\n words  of\ttext.<p>Second block &#8212; here.'
        '<div class="advertisement">Buy now!</div>Third piece of text that goes on.</div>',
        "Head\nFirst words of text.\nSecond block — here.\nThird piece of text that goes on.",
    ),
    ("<p>only text", "only text"),
    ("plain text without tags", "plain text without tags"),
    ('<div hidden>no</div><p>yes it is text here.</p><noscript>js</noscript><script>if(a<b){x="</div>"}</script><p title="a>b">z &lt;b&gt; is.</p><style>p{}</style>', "yes it is text here.\nz <b> is."),
    ('<p>un"closed <b title="x>bold</b> end', 'un"closed bold end'),
    ("<p>kept text is here.<!-- never closed <p>text", "kept text is here."),
    ("<p>kept text is here.<!-- a --> b<!-- never closed", "kept text is here. b"),
    ("<p>kept text is here.</p><a href='x", "kept text is here."),
    ("<p>1 < 2 is kept text.</p>a < b", "1 < 2 is kept text.\na < b"),
    ("", ""),
    (None, ""),
    ("<nav>a</nav>", ""),
    ("<script>never closed <p>x", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_hand_made_pages(page, text):
    assert X.main_text(page, MODEL) == text


def test_hostile_pages_take_linear_time():
    n = 30_000
    pages = ["<a " * n + ">", '<a ">" ' * n, "<!--" * n, "<div>" * n + "x" + "</p>" * n + "</div>" * n, "<p>a<div class=ad>b</div>" * n, '<a <a "' * n + '">"', "<script>" * n, "<li>a <b>x.</b>" * n, "<div class='x'>w w w. " * n]
    for page in pages:
        began = time.time()
        X.main_text(page, MODEL)
        assert time.time() - began < 10, page[:20]


def test_rows_nulls_repeats_and_clashing_names(spark):
    rows = [(k, f"u{k}", page, "x", 3) for k, (page, _) in enumerate(CASES)] + [(0, "u0", CASES[0][0], None, None), (None, None, CASES[2][0], "", 0), (99, None, None, "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = X.extract(pages, MODEL).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    want = sorted([(k, f"u{k}", t) for k, (_, t) in enumerate(CASES)] + [(0, "u0", CASES[0][1]), (None, None, CASES[2][1]), (99, None, "")], key=repr)
    assert sorted(((r["page_id"], r["url"], r["text"]) for r in out), key=repr) == want and all(r["n_chars"] == len(r["text"]) for r in out)
    empty = spark.createDataFrame([], pages.schema)
    assert X.extract(empty, X.fit(empty)).count() == 0


def test_query_gives_the_articles(spark):
    """Each test page's article, read by rule."""
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.QUERIES["op13_html_extraction"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<(?!/?(?:p|h1)>)[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_model_learns_from_marked_pages(spark):
    """Unmarked menus and prose are told apart by what marked pages teach."""
    rng = random.Random(1)
    prose = lambda: "Some words of prose that go on for a while and then end here. " * rng.randrange(1, 4)
    rows = [(k, f"u{k}", f"<nav>{'<li><a href=x>go there now.</a></li>' * 5}</nav><article>{''.join(f'<p>{prose()}</p>' for _ in range(4))}</article>") for k in range(50)]
    model = X.fit(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shape", F.lit(1)))
    assert X.main_text(f"<div><ul>{'<li><a href=x>go there now.</a></li>' * 5}</ul></div><div><p>{prose()}</p><p>{prose()}</p></div>", model).count("go there") == 0
