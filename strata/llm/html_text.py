"""HTML extraction by minimum-cut labelling.

A page is cut into blocks of text. A block's cost is the log odds of being content: a logistic classifier over its text
(length, sentences, links, digits, headings, notices) plus the evidence of its containers (element names; words of class,
id and role values). Positive costs are capacities from the source (content), negative ones capacities to the sink
(boilerplate). Smoothness edges tie blocks that are adjacent in the page and blocks that follow each other below one
parent or grandparent, however far apart they stand. The minimum cut (Dinic's maximum flow) is the labelling of least
total cost: short blocks go with what they stand among, and weak text can't overrule a container that says what it is.

The classifier is trained here, by distant supervision: blocks below elements that say what they are (article, main; nav,
footer, aside, ...) label its features, which don't include those elements. fit() reads at most `rows` pages and
`characters` of them, by a hash of id, url and html; its weights are pulled to PRIOR, so few labels change little.

Defined cases: null or empty html gives an empty text; unclosed, stray and overlapping tags are read as browsers read
them as far as blocks are concerned; character references are decoded, also without their semicolon; repeated rows each
get their row; other columns are ignored; an empty table gives an empty result. Pages of any length are whole, and
parsing takes time in proportion to them, however deep elements are nested.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import map_arrow, whole_id

#: Names of HTML elements by role.
RAW = "script|style|template|textarea|title|iframe|svg"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key closes open elements of these that it stands in directly.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"br", "body", "head", "html", "option", "button"}
NOTHING: frozenset = frozenset()
BOILERPLATE = frozenset("nav footer aside form menu dialog button select option fieldset head".split())
MAIN = frozenset("article main".split())
#: Words in class, id and role values.
SPEAKS_AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget cookie cookies consent gdpr notice notification alert "
    "comment comments reply replies respond disqus menu nav navigation navbar breadcrumb breadcrumbs footer header masthead topbar share sharing social related "
    "recommended newsletter subscribe signup login search popup modal overlay pagination pager tags skip copyright legal toolbar".split()
)
SPEAKS_FOR = frozenset("article articlebody content post entry story main body text".split())
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*+>|<({RAW})\b(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>""",
    re.S | re.I,
)
WORD = re.compile(r"[A-Za-z]+")
SENTENCE = re.compile(r"[.!?…]")
DIGIT = re.compile(r"\d")
NOTICE = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Weights of features(): what the classifier is without any labelled block, in log odds.
PRIOR = (-1.6, 0.8, 0.6, -4.0, 0.5, -1.5, -2.5)
#: How strongly weights are pulled to PRIOR (so many blocks' worth), and the most that text alone may say.
PULL, MOST = 20.0, 3.0
#: What a container says, in log odds.
MAIN_SAYS, AGAINST_SAYS = 3.0, -8.0
#: Smoothness between adjacent blocks, and between those that follow each other below one parent or grandparent.
ADJACENT, SIBLINGS, COUSINS = 0.2, 1.0, 0.4
ROWS, CHARACTERS = 2000, 8_000_000


class Element:
    __slots__ = ("name", "parent", "home", "against", "main", "link")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        self.name, self.parent = name, parent
        self.home = self if name in BLOCK or parent is None else parent.home  # the nearest element that makes blocks
        self.against = bool(parent and parent.against)
        self.main = bool(parent and parent.main)
        self.link = bool(parent and parent.link) or name == "a"
        against = name in BOILERPLATE or (name == "header" and not self.main)
        main = name in MAIN
        if attributes and ("=" in attributes or "hidden" in attributes):
            said = {w.lower() for groups in NAMES.findall(attributes) for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(groups)))}
            if name not in ("html", "body"):
                against = against or bool(said & SPEAKS_AGAINST)
                main = main or bool(said & SPEAKS_FOR and not said & SPEAKS_AGAINST)
            against = against or bool(HIDDEN.search(attributes))
        self.against |= against
        self.main |= main


class Block:
    __slots__ = ("text", "parent", "linked")

    def __init__(self, text: str, parent: Element, linked: int):
        self.text, self.parent, self.linked = text, parent, linked


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order."""
    top = Element("html", "", None)
    now, out = top, []
    open_: dict[str, list[Element]] = {}  # elements by name, innermost last
    parts: list[str] = []
    linked = 0
    home = top

    def end() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, home, linked))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked, home
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            if not parts:
                home = now.home
            parts.append(text)
            if now.link:
                linked += len(text.strip())

    def close(element: Element) -> None:
        """The element and all inside it end. Each element ends once, so this takes constant time for each."""
        nonlocal now
        while now is not element:
            open_[now.name].pop()
            now = now.parent
        open_[element.name].pop()
        now = element.parent

    at, last = 0, page.rfind(">") + 1  # no tag begins without an end, so what is behind the last is text
    for m in TOKEN.finditer(page, 0, last):
        add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1] and m[1].lower() == "title":
                end()
            continue
        name = name.lower()
        if m[2]:
            if name in BLOCK:
                end()
            if same := open_.get(name):
                if name in BLOCK or same[-1].home is now.home:
                    close(same[-1])
            continue
        if name in BLOCK:
            end()
        ends = CLOSES.get(name, NOTHING) | ({"p"} if name in ENDS_P else NOTHING)
        while ends and now.home is not top and now.home.name in ends:
            close(now.home)
        if name not in VOID and not m[4].endswith("/"):
            now = Element(name, m[4], now)
            open_.setdefault(name, []).append(now)
    add(page[at:last])
    rest = page[max(at, last) :]
    add(rest[: i if (i := rest.find("<!--")) >= 0 else None])
    end()
    return out


def features(block: Block) -> tuple[float, ...]:
    """1 and what the text says; nothing about its containers but whether it is a heading."""
    text = block.text
    n = len(text)
    return (
        1.0,
        log1p(text.count(" ") + 1),
        float(bool(SENTENCE.search(text))),
        min(1.0, block.linked / n),
        float(block.parent.name in HEADINGS),
        len(DIGIT.findall(text)) / n,
        float(bool(NOTICE.search(text))),
    )


def score(block: Block, weights: tuple[float, ...] = PRIOR) -> float:
    """Log odds of being content."""
    said = sum(w * x for w, x in zip(weights, features(block), strict=True))
    return max(-MOST, min(MOST, said)) + MAIN_SAYS * block.parent.main + AGAINST_SAYS * block.parent.against


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: three for each block at most."""
    out, last = [], {}
    for k, b in enumerate(found):
        if k:
            out.append((k - 1, k, ADJACENT))
        above = b.parent.parent
        for element, weight in ((above, SIBLINGS), (above.parent if above else None, COUSINS)):
            if element is not None:
                key = (id(element), weight)
                if key in last:
                    out.append((last[key], k, weight))
                last[key] = k
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source when flow is maximal. Edges hold in both directions."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(c)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k in range(n):
        if source[k] > 0:
            edge(s, k, source[k], 0.0)
        if sink[k] > 0:
            edge(k, t, sink[k], 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for i, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    found = blocks(page or "")
    scores = [score(b, weights) for b in found]
    content = minimum_cut([max(x, 0.0) for x in scores], [max(-x, 0.0) for x in scores], ties(found))
    return " ".join(b.text for b, keep in zip(found, content, strict=True) if keep)


def train(pages: list[str]) -> tuple[float, ...]:
    """Weights by logistic regression on blocks whose containers say what they are, with a normal prior around PRIOR."""
    rows = [(features(b), b.parent.main and not b.parent.against) for page in pages for b in blocks(page) if b.parent.main or b.parent.against]
    start = w = np.array(PRIOR)
    if not rows:
        return PRIOR
    x, y = np.array([r for r, _ in rows]), np.array([label for _, label in rows], float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(w)), x.T @ (p - y) + PULL * (w - start))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def fit(pages: DataFrame, rows: int = ROWS, characters: int = CHARACTERS) -> tuple[float, ...]:
    """Train on at most `rows` pages, of at most `characters` in all and a hundredth of that each."""
    html_ = F.col("html").cast("string")
    some = pages.select(html_.alias("html"), F.xxhash64(whole_id("page_id"), F.col("url").cast("string"), html_).alias("h")).where(F.length(html_) * 100 <= characters)
    # Hashes are sorted first, so no more pages move than are read; copies have one hash and count once.
    bound = some.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if bound is None:
        return PRIOR
    read, taken = 0, []
    for row in sorted(some.where(F.col("h") <= bound).groupBy("h").agg(F.first("html").alias("html")).toLocalIterator(), key=lambda r: r.h):
        read += len(row.html)
        if read > characters:
            break
        taken.append(row.html)
    return train(taken)


def extract(pages: DataFrame, weights: tuple[float, ...] = PRIOR) -> DataFrame:
    """Per row: page_id, url, text, n_chars. No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(whole_id("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, work, "page_id bigint, url string, text string, n_chars bigint")
