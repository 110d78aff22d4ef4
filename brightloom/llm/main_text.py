"""Main text of web pages by a minimum cut over blocks.

A page is read as blocks of text in a tree of elements. A classifier says how likely each block
is content; its log odds become capacities to the terminals. Neighbouring blocks are joined by
edges, and so is each block to its element and each element to its parent: to part them costs
something. The minimum cut then labels all blocks of the page at once.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what HTML says of them, and words that names of elements are made of.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head template noscript svg canvas object audio video select datalist annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img"
    " math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HINTS = {
    "advert": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted",
    "notice": "notice notices cookie cookies consent gdpr popup modal overlay dialog alert newsletter subscribe subscription paywall banner disclaimer",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs toc pagination pager topbar toolbar skip",
    "head": "header masthead logo",
    "foot": "footer foot copyright colophon legal",
    "side": "sidebar aside rail widget widgets related recommended recommendations trending popular",
    "comment": "comment comments commentlist disqus reply replies respond discussion",
    "share": "share sharing social follow tags tagcloud",
    "form": "form login signin signup search",
    "content": "article content post entry story main body text",
}
ROLES = {"navigation": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "main": "main", "article": "article"}
ELEMENTS = {"nav": "menu", "menu": "menu", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "button": "form", "dialog": "notice", "article": "article", "main": "main"}

FEATURES = (
    "any article main content advert notice menu head foot side comment share form hidden heading words8 words25 linked30 linked60".split()
)
BIT = {name: 1 << i for i, name in enumerate(FEATURES)}
HINT_OF = {word: BIT[kind] for kind, words in HINTS.items() for word in words.split()}
ARTICLE = BIT["article"] | BIT["main"]
WORDS8, WORDS25, LINKED30, LINKED60, HEADING = (BIT[name] for name in ("words8", "words25", "linked30", "linked60", "heading"))
BOILERPLATE = sum(BIT[kind] for kind in "advert notice menu head foot side comment share form hidden".split())

# A quoted value goes to its closing quote, however far. Where there is none the quote stands for itself; no
# further one follows then, so each kind of quote is looked for in vain once a page, and reading stays linear.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?|=\s*+(?:\"[^\"]*+\"|'[^']*+')")
READ = frozenset("class id role style hidden aria-hidden".split())
LONG = 4096  # Attributes of more characters are read each time, not remembered.
WORDS = re.compile(r"[a-z]+")
NAMES = re.compile(r"[^\s]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Labelling:
    """prior: log odds of content for each feature, added up; `fit_weights` moves them towards what pages show, with
    the prior worth `prior_rows` rows. pages, patterns: pages with the smallest ids, and different sets of
    features, that are learnt from at most. beside: cost of parting two neighbouring blocks of one
    element; across: of parting neighbours in different ones; within: a block and its element, or
    an element and its parent.
    """

    prior: tuple[tuple[str, float], ...] = (
        ("any", 0.6), ("article", 3.0), ("main", 2.5), ("content", 1.5), ("advert", -9.0), ("notice", -8.0), ("menu", -8.0), ("head", -7.0),
        ("foot", -8.0), ("side", -8.0), ("comment", -9.0), ("share", -7.0), ("form", -7.0), ("hidden", -10.0), ("heading", 0.5), ("words8", 0.8),
        ("words25", 1.0), ("linked30", -1.2), ("linked60", -1.8),
    )
    prior_rows: float = 200.0
    pages: int = 400
    patterns: int = 10_000
    beside: float = 0.6
    across: float = 0.2
    within: float = 0.3

    def weights(self) -> np.ndarray:
        return np.array([dict(self.prior)[name] for name in FEATURES])


def hints(name: str, attributes: str, in_article: bool) -> int:
    """Features an element gives to all blocks in it."""
    return (_hints if len(attributes) <= LONG else _hints.__wrapped__)(name, attributes, in_article)


@lru_cache(100_000)
def _hints(name: str, attributes: str, in_article: bool) -> int:
    found = BIT[ELEMENTS[name]] if name in ELEMENTS else 0
    if name == "header" and not in_article:
        found |= BIT["head"]
    for match in ATTRIBUTE.finditer(attributes) if attributes.strip("/ \n") else ():
        key, value = (match[1] or "").lower(), next((x for x in match.groups()[1:] if x), "")
        if key not in READ:
            continue
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            found |= BIT["hidden"]
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            found |= BIT["hidden"]
        elif key == "role" and value.lower() in ROLES:
            found |= BIT[ROLES[value.lower()]]
        elif key in ("class", "id") and name not in ("html", "body"):
            for one in NAMES.findall(HUMP.sub("-", value)):
                words = WORDS.findall(one.lower())
                if words and words[0] in ("has", "no", "with", "is"):
                    continue
                kinds = sum({HINT_OF.get(w, 0) for w in words})
                if kinds & BIT["content"]:
                    kinds &= ~BIT["head"]  # the head of an article belongs to it
                found |= kinds & BIT["content"] if name in ("main", "article") and not kinds & BIT["comment"] else kinds
    return found


class Page:
    """Blocks of a page: texts, features, and the element each is in; `parents` is the tree of elements."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.features: list[int] = []
        self.owners: list[int] = []
        self.parents = [0]
        self._open: list[tuple[str, int, int]] = [("", 0, BIT["any"])]  # name, number, features
        self._count: dict[str, int] = {}
        self._pieces: list[str] = []
        self._linked, self._in_link = 0, False
        self._dropped = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while True:
            match = TOKEN.search(source, at)
            if match is None:
                self._text(source[at:])
                break
            self._text(source[at : match.start()])
            at = match.end()
            if match[1] is None:
                continue
            name = match[1].lower()
            if source[match.start() + 1] == "/":
                self._end(name)
                continue
            self._start(name, match[2])
            if name == "plaintext":
                self._text(source[at:])
                break
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
        self._finish()

    def _text(self, raw: str) -> None:
        if raw and not self._dropped:
            self._pieces.append(raw)
            if self._in_link:
                self._linked += len(raw)

    def _finish(self) -> None:
        """End the block that is being read."""
        if self._pieces:
            raw = "".join(self._pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                _, owner, found = self._open[-1]
                words = text.count(" ") + 1
                share = self._linked / len(raw)
                found |= WORDS8 * (words >= 8) | WORDS25 * (words >= 25) | LINKED30 * (share >= 0.3) | LINKED60 * (share >= 0.6)
                if not HEADINGS.isdisjoint(self._count):
                    found |= HEADING
                self.texts.append(text)
                self.features.append(found)
                self.owners.append(owner)
        self._pieces.clear()
        self._linked = 0

    def _start(self, name: str, attributes: str) -> None:
        if name in INLINE:
            if name == "a":
                self._in_link = True
            elif attributes and not self._dropped and self._hides(attributes):
                self._push(name, attributes)  # kept open like a block, as what it holds is not shown
            return
        self._finish()
        if name in VOID or name in RAW:
            return
        if name in CLOSES_P and "p" in self._count:
            self._close("p")
        for other in ENDED_BY.get(name, ()):
            if self._open[-1][0] == other:
                self._close(other)
        self._push(name, attributes)

    @staticmethod
    def _hides(attributes: str) -> bool:
        return bool(hints("span", attributes, False) & BOILERPLATE)

    def _push(self, name: str, attributes: str) -> None:
        if name in INLINE:
            self._finish()
        _, parent, inside = self._open[-1]
        self.parents.append(parent)
        self._open.append((name, len(self.parents) - 1, inside | hints(name, attributes, inside & ARTICLE > 0)))
        self._count[name] = self._count.get(name, 0) + 1
        self._dropped += name in DROPPED
        self._in_link = False

    def _end(self, name: str) -> None:
        if name == "a":
            self._in_link = False
        if name in INLINE and name not in self._count:
            return
        self._finish()
        if name in self._count:
            self._close(name)

    def _close(self, name: str) -> None:
        """Close the innermost open element of that name, and what is open in it."""
        self._finish()
        while True:
            closed, _, _ = self._open.pop()
            self._count[closed] -= 1
            if not self._count[closed]:
                del self._count[closed]
            self._dropped -= closed in DROPPED
            if closed == name:
                break
        self._in_link = False


def minimum_cut(gains: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut.

    gains: capacity from the source (positive) or to the sink (negative) of each node; edges:
    capacities both ways. Nodes whose own capacity outweighs all their edges are settled at once,
    which changes no minimum cut; the rest by augmenting along shortest paths, level by level.
    Nodes that may be on either side are on the sink's.
    """
    n = len(gains)
    gains = list(gains)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), cost in edges.items():
        if a != b and cost > 0:
            near[a][b] = near[a].get(b, 0.0) + cost
            near[b][a] = near[b].get(a, 0.0) + cost
    side: list[bool | None] = [None] * n
    loads = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is not None or abs(gains[i]) <= loads[i] and near[i]:
            continue
        side[i] = gains[i] > 0
        for j, cost in near[i].items():
            gains[j] += cost if side[i] else -cost
            loads[j] -= cost
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if not rest:
        return [bool(x) for x in side]
    source, sink = n, n + 1
    residual: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
    residual[source], residual[sink] = {}, {}
    for i in rest:
        if gains[i] > 0:
            residual[source][i], residual[i][source] = gains[i], 0.0
        elif gains[i] < 0:
            residual[i][sink], residual[sink][i] = -gains[i], 0.0
    tiny = 1e-12
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, room in residual[a].items():
                if room > tiny and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return [bool(side[i]) if side[i] is not None else i in level for i in range(n)]
        ways = {a: iter(list(residual[a])) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(residual[x][y] for x, y in zip(path, path[1:]))
                cut = len(path)
                for k, (x, y) in enumerate(zip(path, path[1:])):
                    residual[x][y] -= flow
                    residual[y][x] = residual[y].get(x, 0.0) + flow
                    if residual[x][y] <= tiny and cut > k + 1:
                        cut = k + 1
                ways[path[cut - 1]] = iter([path[cut], *ways[path[cut - 1]]])
                path = path[:cut]
                continue
            for b in ways[a]:
                if residual[a][b] > tiny and level.get(b, -1) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()


def content_blocks(page: Page, weight_of: dict[int, float], rule: Labelling) -> list[bool]:
    """Whether each block is content, by the minimum cut of the page."""
    n = len(page.texts)
    gains = [weight_of[f] for f in page.features]
    most = 2 * max(rule.beside, rule.across) + rule.within  # the edges of one block
    if all(abs(g) > most for g in gains):
        return [g > 0 for g in gains]  # each block's own capacity outweighs its edges, so this is the cut
    node: dict[int, int] = {}
    edges: dict[tuple[int, int], float] = {}
    for i, owner in enumerate(page.owners):
        if i:
            edges[i - 1, i] = rule.beside if page.parents[owner] == page.parents[page.owners[i - 1]] else rule.across
        child, element = i, owner
        while True:  # up to an element that is known already
            known = element in node
            up = node.setdefault(element, n + len(node))
            edges[child, up] = rule.within
            if known or element == 0:
                break
            child, element = up, page.parents[element]
    return minimum_cut(gains + [0.0] * len(node), edges)[:n]


class Weights(dict):
    """Log odds of a set of features."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, features: int) -> float:
        self[features] = found = sum(w for i, w in enumerate(self.weights) if features >> i & 1)
        return found


def main_text(source: str | None, weight_of: Weights, rule: Labelling = Labelling()) -> str:
    page = Page(source or "")
    return " ".join(text for text, kept in zip(page.texts, content_blocks(page, weight_of, rule)) if kept)


def fit_weights(pages: DataFrame, rule: Labelling = Labelling(), id_column: str = "page_id", html_column: str = "html") -> np.ndarray:
    """Weights of the features, learnt from pages that mark their article or main part themselves.

    Blocks in such a part and in nothing that is named boilerplate are content; blocks in what is
    named boilerplate are none; others teach nothing. Only counts of feature sets reach the
    driver, `rule.patterns` of them at most, from the pages of the `rule.pages` smallest ids.
    """
    ids = pages.select(id_column).dropna().orderBy(id_column).limit(rule.pages)
    last = ids.agg(F.max(id_column)).first()[0]
    if last is None:
        return rule.weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for source in batch.column(0) for f in Page(source.as_py() or "").features]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["features"])

    seen = pages.filter(F.col(id_column) <= F.lit(last)).select(html_column).mapInArrow(run, "features bigint").groupBy("features").count()
    rows = seen.orderBy(F.desc("count"), "features").limit(rule.patterns).collect()
    rows = [(f, c, not f & BOILERPLATE) for f, c in rows if f & BOILERPLATE or f & ARTICLE]
    if not rows or len({good for _, _, good in rows}) < 2:
        return rule.weights()
    x = np.array([[f >> i & 1 for i in range(len(FEATURES))] for f, _, _ in rows], float)
    y = np.array([good for _, _, good in rows], float)
    count = np.array([c for _, c, _ in rows], float)
    share = count / count.sum()
    prior = rule.weights()
    weights = prior.copy()
    for _ in range(50):  # Newton's method; the problem is convex
        p = 1 / (1 + np.exp(-x @ weights))
        slope = rule.prior_rows * (x.T @ (share * (p - y))) + (weights - prior)
        bend = rule.prior_rows * (x.T * (share * p * (1 - p))) @ x + np.eye(len(prior))
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-10:
            break
    return np.round(weights, 6)


def extract(
    pages: DataFrame, weights: np.ndarray | None = None, rule: Labelling = Labelling(), id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",)
) -> DataFrame:
    """(page_id, *keep, text) of every whole page; no shuffle. weights: of `fit_weights`, else the prior ones.

    A null or empty page and one without text have an empty text; unclosed or stray tags end
    blocks as far as they can; null ids, nulls of kept columns and repeated rows pass through; no
    rows give no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(rule.weights() if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight_of = Weights(shared.value)
        for batch in batches:
            texts = [main_text(source.as_py(), weight_of, rule) for source in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    chosen = pages.select(F.col(id_column).alias("page_id"), *keep, F.col(html_column).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", text string"
    return chosen.mapInArrow(run, schema)
