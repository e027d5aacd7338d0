"""Main text of web pages by a minimum cut.

A page is read into blocks of text (what stands between two block-level tags) and the tree of its
block-level elements. Each block is a node of a graph:

- terminal capacities are the costs of a classifier, log odds that a block belongs to the article: marks of the
  elements around it (names, roles, class and id words) and a logistic model of its shape (words, links,
  sentence ends, kind);
- smoothness edges join blocks that follow each other, the stronger the nearer they are in the tree, and blocks that
  follow each other under one parent, whatever stands between.

The minimum cut of that graph separates article from boilerplate. Nodes that outweigh all their edges
are labelled first, which changes no minimum; max-flow decides the rest. Of several minima the one with the
most text counts. Capacities are whole numbers, so the cut is exact.

The shape model is trained here: on a sample of about MAX_SAMPLE pages, blocks in marked containers are its labelled rows;
only counts per shape (SHAPES at most) reach the driver, and a ridge prior keeps it usable where there are none.

White space is that of Unicode, `<br>` counts as white space. Elements never shown (scripts, styles, form
fields, `hidden`) are left out before. Edge cases: a null or empty page, or one without text, has text '' and
n_chars 0; unclosed, misnested and cut off tags are closed as browsers do, a tag that never ends goes up to the next `<`;
pages of any length are read whole, in time linear in their length but for the max-flow of blocks that stay undecided; repeated rows
are extracted one by one; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the shape model is fitted on, about.
MAX_SAMPLE = 2000

# Names of HTML elements and usual words of class and id. Fixed values.
BLOCKS = set(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = set("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = set("head noscript template svg math object canvas audio video select button datalist dialog map optgroup option".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
AGAINST_TAGS = set("nav footer aside form menu".split())
ARTICLE_TAGS = set("article main".split())
AGAINST_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
AGAINST = set(
    "ad ads adv advert adverts advertisement advertising adsense advertorial banner breadcrumb breadcrumbs comment comments commentary commentlist consent cookie cookies copyright discussion disqus dropdown feedback flash footer footnav gdpr header headers login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted promotion recommended recommendations register related replies respond search share sharing shoutbox sidebar sidenav signin signup skip social sponsor sponsored submenu subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: In front of a word they say what a page has, not what an element is.
ASIDE = set("has hide is no open status type with without".split())
FOR = set("article articlebody body content entry main maincontent post story text".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'){0,500}+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/<>]*+)(?P<rest2>[^<>]*+)>?"
    r"|<[!?/][^<>]*+>?",
    re.S,
)
#: Behind the last ">" of a page: a comment that is still open, and tags that were cut off.
_OPEN_COMMENT = re.compile("<!--(?!.*?-->)", re.S)
_CUT_OFF = re.compile("<[a-zA-Z/!?][^<]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDED = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")

#: Log odds of marks for and against, of blocks outside a page's marked article, and of all blocks of a page without marks.
MARKED, UNMARKED, OUTSIDE, BARE = 3.0, -9.0, -2.5, 1.0
#: Weight of a smoothness edge between siblings; it halves with each further step in the tree.
SMOOTH = 1.2
SCALE = 1000


class Page:
    """Blocks of a page: text, shape, and the elements around them."""

    def __init__(self, html: str):
        #: Of each element: parent, depth, marks against and for it (with those around it), unseen.
        self.parent, self.depth, self.against, self.of_article, self.unseen = [-1], [0], [0], [False], [False]
        self.texts: list[str] = []
        self.elements: list[int] = []
        self.shapes: list[int] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, opened, at, last, links, pieces, linked = [("", 0)], Counter(), 0, 0, 0, [], 0
        end_of_tags = html.rfind(">") + 1

        def flush():
            nonlocal linked
            if pieces:
                self._block("".join(pieces), linked, stack)
                pieces.clear()
            linked = 0

        def said(text):
            nonlocal linked
            if not self.unseen[stack[-1][1]]:
                text = entities.unescape(text) if "&" in text else text
                pieces.append(text)
                linked += len(text) if links else 0

        def pop(depth):
            for tag, _ in stack[depth:]:
                opened[tag] -= 1
            del stack[depth:]

        found = _TAG.search(html, 0, end_of_tags)
        while found:
            if found.start() > at:
                said(html[at : found.start()])
            last, at = found.span()
            name, end, rest = found["name"] or found["name2"], found["end"] or found["end2"], found["rest"] or found["rest2"] or ""
            if not name:
                found = _TAG.search(html, at, end_of_tags)
                continue
            name = name.lower()
            block = name in BLOCKS or "-" in name
            if block:
                flush()
            if name == "a":
                links = 0 if end else 1
            elif name == "br":
                pieces.append(" ")
            elif end:
                if opened[name]:
                    links = 0 if block else links
                    pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            elif name in RAW and not rest.endswith("/"):
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, at)
                at = close.start() if close else len(html)
            elif (block or name in UNSEEN) and name not in VOID:
                if block and stack[-1][0] == "p":
                    pop(len(stack) - 1)
                if name in CLOSED_BY:
                    same, inside = CLOSED_BY[name]
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in inside:
                            break
                        if stack[k][0] in same:
                            pop(k)
                            break
                if not (rest.endswith("/") and "-" in name):
                    stack.append((name, self._element(name, rest, stack[-1][1])))
                    opened[name] += 1
            found = _TAG.search(html, at, end_of_tags)
        if at < end_of_tags or not _OPEN_COMMENT.match(html, last):
            said(_CUT_OFF.sub("", html[at:]))
        flush()

    def _element(self, name: str, rest: str, parent: int) -> int:
        found, unseen = {}, name in UNSEEN
        if rest and rest != "/":
            for key, *values in _ATTRIBUTE.findall(rest):
                found.setdefault(key.lower(), values[0] or values[1] or values[2])
            unseen |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        role, whole, inside = found.get("role", "").lower(), name in ("html", "body"), self.of_article[parent]
        said_for = said_against = False
        for label in f"{found.get('class', '')} {found.get('id', '')} {name if '-' in name else ''}".split():
            words = [w.lower() for w in _WORD.findall(label)]
            if ASIDE.isdisjoint(words):
                bad, good = AGAINST.intersection(words), not FOR.isdisjoint(words)
                if bad <= {"header", "headers"} and (good or inside):
                    bad = ()  # the head of an article, which holds its title
                said_against |= bool(bad)
                said_for |= good and not bad
        against = not whole and (name in AGAINST_TAGS or name == "header" and not inside or role in AGAINST_ROLES or said_against and not said_for)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.against.append(self.against[parent] + against)
        self.of_article.append(inside or not whole and not against and (name in ARTICLE_TAGS or role in ("main", "article") or said_for and not said_against))
        self.unseen.append(self.unseen[parent] or unseen)
        return len(self.parent) - 1

    def _block(self, text: str, linked: int, stack: list) -> None:
        total = len(text)
        words = text.split()
        if not words:
            return
        self.texts.append(" ".join(words))
        self.elements.append(stack[-1][1])
        size = min(len(words).bit_length() - 1, 6)
        links = 0 if not linked else 1 + int(linked * 3 > total) + int(linked * 3 > 2 * total)
        ended = int(_ENDED.search(words[-1]) is not None)
        names = {tag for tag, _ in stack[-3:]}
        kind = 0 if names & {"h1", "h2", "h3", "h4", "h5", "h6"} else 1 if names & {"li", "td", "th", "dt", "dd"} else 2
        self.shapes.append(((size * 4 + links) * 2 + ended) * 3 + kind)

    def labels(self) -> list[int | None]:
        """What the marks around each block say: 1 article, 0 not, None nothing."""
        return [0 if self.against[e] else 1 if self.of_article[e] else None for e in self.elements]

    def costs(self, log_odds: np.ndarray) -> list[float]:
        """Log odds of each block for belonging to the article."""
        marked = any(self.of_article[e] and not self.against[e] for e in self.elements)
        rest = OUTSIDE if marked else 0.0 if any(self.against) else BARE
        return [float(log_odds[s]) + UNMARKED * self.against[e] + (MARKED if self.of_article[e] else rest) for e, s in zip(self.elements, self.shapes)]

    def distance(self, a: int, b: int) -> int:
        """Steps from one element to the other in the tree."""
        steps = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps

    def edges(self) -> list[tuple[int, int, float]]:
        """Smoothness edges (block, later block, weight)."""
        out, last = [], {}
        for k, e in enumerate(self.elements):
            if k:
                out.append((k - 1, k, SMOOTH / 2 ** max(0, min(self.distance(self.elements[k - 1], e), 24) - 2)))
            before = last.get(self.parent[e])
            if before is not None and before < k - 1:
                out.append((before, k, SMOOTH / 2))
            last[self.parent[e]] = k
        return out


def min_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling x that has the least sum of costs of false labels (cost of x_i = 0 where it is above 0, of x_i = 1 where it is
    below) and weights of edges whose ends differ; of several the one with the most ones."""
    n, costs = len(costs), list(costs)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if w > 0 and i != j:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    weight, label = [sum(x.values()) for x in near], [None] * n
    todo = deque(range(n))
    while todo:  # a node that outweighs its edges has its own label in a minimum; its edges become costs
        i = todo.popleft()
        if label[i] is not None or not (costs[i] >= weight[i] or -costs[i] > weight[i]):
            continue
        label[i] = costs[i] >= weight[i]
        for j, w in near[i].items():
            if label[j] is None:
                costs[j] += w if label[i] else -w
                weight[j] -= w
                del near[j][i]
                todo.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        blocked = _reach_sink(left, costs, near)
        for i in left:
            label[i] = i not in blocked
    return label


def _reach_sink(nodes: list[int], costs: list[int], near: list[dict[int, int]]) -> set[int]:
    """Nodes from which the sink can still be reached after a maximum flow: those that every minimum labels 0."""
    room = {i: dict(near[i]) for i in nodes}
    supply, drain = {i: max(costs[i], 0) for i in nodes}, {i: max(-costs[i], 0) for i in nodes}
    while True:
        level, queue = {i: 0 for i in nodes if supply[i]}, deque(i for i in nodes if supply[i])
        while queue:  # levels from the source
            i = queue.popleft()
            for j, w in room[i].items():
                if w and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not any(drain[i] for i in level):
            break
        tried = {i: iter(list(room[i])) for i in level}
        for source in [i for i in level if not level[i]]:
            path = [source]
            while path and supply[source]:
                i = path[-1]
                if drain[i]:
                    flow = min(supply[source], drain[i], *(room[a][b] for a, b in zip(path, path[1:])))
                    supply[source] -= flow
                    drain[i] -= flow
                    full = len(path)
                    for k, (a, b) in enumerate(zip(path, path[1:])):
                        room[a][b] -= flow
                        room[b][a] += flow
                        if not room[a][b]:
                            full = min(full, k + 1)
                    del path[full:]
                    continue
                for j in tried[i]:
                    if room[i][j] and level.get(j) == level[i] + 1:
                        path.append(j)
                        break
                else:
                    path.pop()
                    level[i] = -1
    reach, queue = {i for i in nodes if drain[i]}, deque(i for i in nodes if drain[i])
    while queue:
        j = queue.popleft()
        for i in room[j]:
            if room[i][j] and i not in reach:
                reach.add(i)
                queue.append(i)
    return reach


def main_text(html: str | None, log_odds: np.ndarray) -> str:
    page = Page(html or "")
    costs = [round(SCALE * c) for c in page.costs(log_odds)]
    label = min_cut(costs, [(i, j, round(SCALE * w)) for i, j, w in page.edges()])
    return "\n".join(t for t, content in zip(page.texts, label) if content)


#: Shapes of blocks: words (7), links (4), sentence end (2), kind (3).
SHAPES = 7 * 4 * 2 * 3


def _design() -> np.ndarray:
    """One row per shape: a constant and an indicator of each feature's value."""
    values = np.stack(np.unravel_index(np.arange(SHAPES), (7, 4, 2, 3)), axis=1)
    return np.concatenate([np.ones((SHAPES, 1)), *[np.eye(k)[values[:, c]] for c, k in enumerate((7, 4, 2, 3))]], axis=1)


#: What the shape model is before it has seen a page, and is drawn to: long blocks with sentences count for, links against.
PRIOR = np.array([0.0, -1.0, -0.8, -0.4, 0.2, 0.6, 1.0, 1.4, 0.4, -0.2, -1.2, -2.0, -0.3, 0.5, 0.2, -0.4, 0.2])
RIDGE, MOST = 20.0, 2.5


def shape_model(counts: np.ndarray) -> np.ndarray:
    """Log odds of each shape, at most MOST either way, from counts (SHAPES, 2) of blocks outside and inside articles: logistic
    regression with both classes of equal weight, by Newton steps."""
    x, weights = _design(), PRIOR.copy()
    per_class = counts.sum(axis=0)
    if per_class.min() > 0:
        share = counts / per_class * min(per_class.sum(), 10_000) / 2
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            gradient = x.T @ (share[:, 1] - share.sum(axis=1) * p) - RIDGE * (weights - PRIOR)
            curve = (x * (share.sum(axis=1) * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
            weights = weights + np.linalg.solve(curve, gradient)
    return np.clip(x @ weights, -MOST, MOST)


def fit(pages: DataFrame, sample: int = MAX_SAMPLE) -> np.ndarray:
    """The shape model of about `sample` pages, chosen by a hash of the row."""
    share = max(1, -(-pages.count() // sample))
    chosen = pages.where(F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(share)) == 0).select("html")

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for html in batch.column(0).to_pylist():
                page = Page(html or "")
                counts.update((s, y) for s, y in zip(page.shapes, page.labels()) if y is not None)
            keys = list(counts)
            columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shape", "label", "n"])

    table = np.zeros((SHAPES, 2))
    for shape, label, n in chosen.mapInArrow(run, "shape int, label int, n long").groupBy("shape", "label").agg(F.sum("n")).collect():
        table[shape, label] = n
    return shape_model(table)


def extract(pages: DataFrame, log_odds: np.ndarray) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches):
        for batch in batches:
            texts = [main_text(html, log_odds) for html in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
