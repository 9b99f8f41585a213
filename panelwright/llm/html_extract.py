"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of elements and text runs. Every node has a hidden label, content or not,
with a potential from its own features and one from each parent-child pair. Sum-product message
passing, once up and once down the tree, gives every node's exact marginal. Text runs whose
marginal says content are the page's text, laid out block by block.

The potentials are log-linear and are fitted by gradient ascent on the likelihood of labelled
pages (observed minus expected counts, both exact on a tree). Labelled pages are a bounded sample
of the table's own pages whose markup says what is what (``article`` or ``main`` against ``nav``,
``footer``, ``aside`` and the like); the names of those landmarks are features beside wording,
link density, length and place, so that pages with few landmarks are still judged by the rest.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import unit_draw

#: Pages the model is fitted on (drawn by id), and passes over them: the documented bounds of the fit.
FIT_PAGES, PASSES = 400, 30
SLOTS = 1 << 12

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp".split())
HIDDEN = RAW | {"head", "form", "button", "input", "option", "canvas", "audio", "video", "dialog", "datalist"}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
}
_ITEMS = frozenset().union(CLOSED_BY, *CLOSED_BY.values())
SCOPE = frozenset("html body table ul ol dl article section div main aside nav header footer td th form blockquote".split())

# What page furniture is called, in element names, classes, ids and roles; one stem each.
FURNITURE = (
    "nav menu sidebar aside footer header masthead banner comment reply disqus cookie consent gdpr notice alert popup modal "
    "overlay advert sponsor promo social share related recommend newsletter subscribe signup login search form breadcrumb "
    "pagination pager toolbar widget copyright legal skip tags meta"
).split()
_CONTENT = frozenset("article main content post story entry prose articlebody maincontent".split())
_STEMS = tuple(x for x in FURNITURE if len(x) > 4)
# An article or main part is furniture only if it is called one of these; a topic may be called like the others.
_NO_ARTICLE = ("comment", "repl", "related", "recommend", "advert", "sponsor", "promo", "widget", "popup", "newsletter", "sidebar", "cookie")
_SHORT = frozenset(FURNITURE) | {"ad", "ads", "navs", "menus", "metas", "forms", "popups"}

# Possessive, so that broken markup costs no more than sound markup: a quote ends at the next one, however far.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f\v\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _called(tag: str, names: str) -> str:
    """What an element is called: ``furniture``, ``content`` or nothing of either."""
    tokens = re.split(r"[^a-z0-9]+", f"{tag} {names}")
    if tag in ("article", "main"):
        return "furniture" if any(t.startswith(_NO_ARTICLE) for t in tokens) else "content"
    if any(t in _SHORT or t.startswith(_STEMS) for t in tokens):
        return "furniture"
    return "content" if any(t in _CONTENT for t in tokens) else ""


@dataclass
class Page:
    """Nodes in page order: the parent of each, its element name, its attributes or its text."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


def parse(source: str) -> Page:
    """A forgiving parser: unclosed and stray tags never lose text."""
    page = Page()
    # open elements: node, place of the nearest paragraph or scope, place of the nearest item or scope
    stack: list[tuple[int, int, int]] = []
    opened: Counter[str] = Counter()  # names that are open now

    def push(node: int) -> None:
        tag, here = page.tag[node], len(stack)
        _, near, item = stack[-1] if stack else (0, 0, 0)
        stack.append((node, here if tag == "p" or tag in SCOPE else near, here if tag in _ITEMS or tag in SCOPE else item))
        opened[tag] += 1

    def close(depth: int) -> None:
        """Close the element at a depth and all within it."""
        for node, _, _ in stack[depth:]:
            opened[page.tag[node]] -= 1
        del stack[depth:]

    def add(tag: str, names: str = "", text: str = "") -> int:
        page.parent.append(stack[-1][0] if stack else -1)
        page.tag.append(tag)
        page.names.append(names)
        page.text.append(text)
        return len(page.tag) - 1

    push(add("html"))
    at, raw = 0, ""
    n = len(source)
    while at < n:
        if raw:  # everything up to the end tag is that element's own
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            stop = end.start() if end else n
            if stop > at:
                add("#text", text=source[at:stop])
            close(len(stack) - 1)
            at, raw = (end.end() if end else n), ""
            continue
        m = _TOKEN.search(source, at)
        stop = m.start() if m else n
        if stop > at:
            add("#text", text=source[at:stop])
        if not m:
            break
        at = m.end()
        slash, tag, rest = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if opened[tag]:  # each step closes an element
                for depth in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[depth][0]] == tag:
                        close(depth)
                        break
            continue
        if tag in BLOCK:  # a block ends an open paragraph, and the inline elements in it
            near = stack[-1][1]
            if page.tag[stack[near][0]] == "p":
                close(near)
        if tag in CLOSED_BY:
            depth = stack[-1][2]
            while depth > 0:
                own = page.tag[stack[depth][0]]
                if own in CLOSED_BY[tag]:
                    close(depth)
                    break
                if own in SCOPE and own not in ("td", "th"):
                    break
                depth = stack[depth - 1][2]
        if tag in ("html", "body") and tag in page.tag:
            continue
        said = {a.lower(): b or c or d or "" for a, b, c, d in _ATTRIBUTE.findall(rest)}
        names = " ".join(said.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label")).lower()
        if "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", said.get("style", "")):
            names += " :hidden"
        node = add(tag, names)
        if tag in VOID or rest.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        push(node)
        if tag in RAW:
            raw = tag
    return page


_MEMO: dict = {}  # of slots and features; emptied when it has grown


def _slot(name: str) -> int:
    if name in _MEMO:
        return _MEMO[name]
    h = 0xCBF29CE484222325
    for b in name.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    _MEMO[name] = (h ^ h >> 31) % SLOTS
    return _MEMO[name]


def _element(tag: str, names: str) -> tuple[str, ...]:
    if (tag, names) in _MEMO:
        return _MEMO[tag, names]
    own = [f"tag={tag}"]
    if called := _called(tag, names):
        own.append(called)
    if ":hidden" in names or tag in HIDDEN:
        own.append("hidden")
    own.append("block" if tag in BLOCK else "inline")
    if len(_MEMO) > 50_000:
        _MEMO.clear()
    _MEMO[tag, names] = tuple(own)
    return tuple(own)


def features(page: Page) -> list[tuple[str, ...]]:
    """Names of the features that each node has."""
    n = len(page.tag)
    size, linked, signs = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(n):
        up = page.parent[k]
        in_link[k] = page.tag[k] == "a" or (up >= 0 and in_link[up])
        if page.tag[k] == "#text":
            text = page.text[k].strip()
            size[k] = len(text)
            linked[k] = size[k] if in_link[k] else 0
            signs[k] = sum(map(text.count, ".,;:!?"))
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        size[up] += size[k]
        linked[up] += linked[k]
        signs[up] += signs[k]
    out, under = [], [""] * n  # the nearest element around that says what it is
    for k in range(n):
        tag = page.tag[k]
        if k:
            under[k] = under[page.parent[k]]
        own = ("tag=#text", f"in={page.tag[page.parent[k]]}") if tag == "#text" else _element(tag, page.names[k])
        if tag != "#text" and len(own) > 2 and own[1] in ("furniture", "content"):
            under[k] = own[1]
        own += (f"under={under[k]}",)
        if size[k] or tag == "#text":
            whole = max(1, size[k])
            own += (
                f"size={bisect((1, 20, 60, 150, 400, 1500), size[k])}",
                f"links={bisect((0.01, 0.25, 0.5, 0.9), linked[k] / whole)}",
                f"signs={bisect((0.1, 1.0, 3.0), 100 * signs[k] / whole)}",
            )
        out.append(own)
    return out


@dataclass
class Model:
    """Weights of node features for label content, and of parent-child pairs by child's kind."""

    node: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS))
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))


@dataclass
class Tree:
    parent: np.ndarray
    levels: list[np.ndarray]
    slots: np.ndarray
    owner: np.ndarray
    kind: np.ndarray


def tree(page: Page) -> Tree:
    parent = np.asarray(page.parent)
    depth = np.zeros(len(parent), np.int64)
    for k in range(1, len(parent)):
        depth[k] = depth[parent[k]] + 1
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    named = features(page)
    slots = np.array([_slot(f) for own in named for f in own], np.int64)
    owner = np.repeat(np.arange(len(named)), [len(own) for own in named])
    # pairs differ by whether the child may change what it is in: furniture and landmarks do
    kind = np.fromiter((("furniture" in own or "content" in own or "hidden" in own) for own in named), np.int64, len(named))
    return Tree(parent, levels, slots, owner, kind)


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(t: Tree, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals by sum-product: P(content) per node, and joint tables of (parent, child)."""
    n = len(t.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(t.owner, model.node[t.slots], n)
    pair = model.pair[t.kind]  # node x parent label x own label
    up = np.zeros((n, 2))  # message to the parent
    below = own.copy()
    for level in reversed(t.levels[1:]):
        message = _log_add(pair[level, :, 0] + below[level, 0, None], pair[level, :, 1] + below[level, 1, None])
        message -= message.max(axis=1, keepdims=True)
        up[level] = message
        np.add.at(below, t.parent[level], message)
    down = np.zeros((n, 2))  # message from the parent
    joint = np.zeros((n, 2, 2))
    for level in t.levels[1:]:
        outside = down[t.parent[level]] + below[t.parent[level]] - up[level]
        message = _log_add(pair[level, 0, :] + outside[:, 0, None], pair[level, 1, :] + outside[:, 1, None])
        down[level] = message - message.max(axis=1, keepdims=True)
        table = outside[:, :, None] + pair[level] + below[level][:, None, :]
        table = np.exp(table - table.max(axis=(1, 2), keepdims=True))
        joint[level] = table / table.sum(axis=(1, 2), keepdims=True)
    belief = below + down
    return 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def landmarks(page: Page) -> np.ndarray | None:
    """Labels that a page's own markup gives, or None if it has no article or main element."""
    n = len(page.tag)
    label = np.zeros(n, bool)
    seen = False
    for k in range(1, n):
        tag, names = page.tag[k], page.names[k]
        inside = label[page.parent[k]]
        if tag in HIDDEN or ":hidden" in names or _called(tag, names) == "furniture":
            inside = False
        elif tag in ("article", "main") or "articlebody" in names:
            inside = seen = True
        label[k] = inside
    return label if seen else None


def fit(pages: list[str], passes: int = PASSES, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Gradient ascent on the log-likelihood of labelled pages, with a step size per weight."""
    labelled = [(tree(p), y) for p in map(parse, pages) if (y := landmarks(p)) is not None]
    model = Model()
    squares, pair_squares = np.full(SLOTS, 1e-8), np.full((2, 2, 2), 1e-8)
    for _ in range(passes if labelled else 0):
        gradient, pair_gradient = -decay * model.node, -decay * model.pair
        for t, y in labelled:
            p, joint = marginals(t, model)
            n = len(y)
            gradient += np.bincount(t.slots, (y - p)[t.owner], SLOTS) / n
            table = -joint
            child = np.arange(1, n)
            table[child, y[t.parent[child]].astype(int), y[child].astype(int)] += 1
            np.add.at(pair_gradient, t.kind[1:], table[1:] / n)
        squares += gradient**2
        pair_squares += pair_gradient**2
        model.node += rate * gradient / np.sqrt(squares)
        model.pair += rate * pair_gradient / np.sqrt(pair_squares)
    return model


def lay_out(page: Page, content: np.ndarray) -> str:
    """Text runs that are content: white space becomes one space, one line per block."""
    lines: list[list[str]] = [[]]
    last_block = -1
    block = [0] * len(page.tag)
    for k in range(1, len(page.tag)):
        up = page.parent[k]
        block[k] = k if page.tag[k] in BLOCK else block[up]
        if page.tag[k] == "br":
            if lines[-1] and block[k] == last_block:
                lines[-1].append(" ")
            continue
        if page.tag[k] != "#text" or not content[k]:
            continue
        if block[k] != last_block:
            lines.append([])
            last_block = block[k]
        lines[-1].append(page.text[k])
    out = []
    for parts in lines:
        line = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if line:
            out.append(line)
    return "\n".join(out)


def main_text(source: str, model: Model) -> str:
    """The article of one page; script, style, form and hidden parts are never text."""
    if not source:
        return ""
    page = parse(source)
    content = marginals(tree(page), model)[0] > 0.5
    shut = np.zeros(len(page.tag), bool)
    for k in range(1, len(page.tag)):
        shut[k] = shut[page.parent[k]] or page.tag[k] in HIDDEN or ":hidden" in page.names[k]
    return lay_out(page, content & ~shut)


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", size: int = FIT_PAGES) -> Model:
    """Fit on about ``size`` pages drawn by a hash of the id (``size`` pages reach the driver)."""
    rows = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(html_col).alias("h"))
    n = rows.count()
    drawn = rows.where(unit_draw(F.xxhash64("i", "h"), "html") < min(1.0, size / max(1, n)))
    return fit([r.h for r in drawn.select("h").collect()])


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: ``page_id, url, text, n_chars``. A null or empty page, or one without content, has an empty text.

    Pages are read whole; repeated rows are treated alike and other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model.node, model.pair))  # plain values: tasks need no package
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def work(batches):
        model = Model(*shared.value)
        for batch in batches:
            texts = [main_text(h or "", model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(id_col, url_col, html_col).mapInArrow(
        work, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint"
    )
