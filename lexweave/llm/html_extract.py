"""Main-text extraction from HTML with a tree-structured graphical model.

A page becomes a forest of nodes: block elements, and as leaves the runs of text inside them. Every node is content or
not. Node potentials are log-linear in the tag, cue words of class, id and role, and figures of the text; parent-child
potentials depend on the child's kind. Sum-product message passing, once upward and once downward, gives every node's
content marginal exactly; leaves above one half are the main text. The weights maximise the likelihood of labelled
pages. As no labelled pages are given, ``sample_pages`` writes them from templates of common page layouts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import arrow_batches

_TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*>?|(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"<]*\"|'[^'<]*')*+[^>]*)(?:>|\Z))", re.S
)
#: What these hold is never text of the page: up to the end of the page if they aren't closed, as browsers read them.
_RAW = {"script", "style", "title", "textarea"}
#: These are left out if they are closed before they begin again; else only their start tag is.
_ASIDE = {"noscript", "template", "iframe", "noembed", "noframes", "select", "datalist"}
#: Words inside these, between block boundaries, aren't text of the page; not closed, they are.
_MUTE = {"button", "svg", "canvas", "audio", "video", "object"}
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in _RAW | _ASIDE | {"xmp"}}
_STARTS = {t: re.compile(rf"<{t}(?=[\s/>])", re.I) for t in _ASIDE}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCKS = (
    "html", "head", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption",
    "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "fieldset", "legend", "address", "details", "summary", "dialog", "center", "menu", "hgroup", "search",
)
_BLOCK = {t: i for i, t in enumerate(BLOCKS)}
#: A start tag closes an open element of these, up to the nearest of the stops.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, set()),
}
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

CUES = (
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "top", "logo", "footer", "bottom", "colophon", "copyright", "legal", "sidebar", "side", "aside", "rail", "widget",
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "form", "search", "login", "signup",
    "subscribe", "newsletter", "share", "social", "sharing", "related", "recommended", "more", "popular", "trending", "tags", "meta", "byline", "author", "date", "notice", "cookie", "cookies", "consent", "gdpr", "alert",
    "warning", "popup", "modal", "overlay", "pagination", "pager", "article", "content", "main", "post", "entry", "story", "text", "body", "page", "news", "blog", "container", "wrapper", "wrap", "row", "col", "inner", "outer",
)
_CUE = {c: i for i, c in enumerate(CUES)}


@dataclass
class Nodes:
    """A forest of pages' nodes: parents come before children, -1 is none; ``kind`` is the block's tag or that of a leaf."""

    parent: list[int]
    depth: list[int]
    kind: list[int]
    features: list[list[int]]
    text: list[str]
    mark: list[str]

    @classmethod
    def empty(cls) -> Nodes:
        return cls([], [], [], [], [], [])


LEAF = len(BLOCKS)
#: Feature numbers: tags of blocks, the parent's tag of leaves, cues of a node, text figures.
_F_PARENT = LEAF + 1
_F_CUE = _F_PARENT + LEAF + 1
_F_WORDS = _F_CUE + len(CUES)
_F_LINK = _F_WORDS + 6
_F_STOPS = _F_LINK + 4
_F_SIGNS = _F_STOPS + 3
N_FEATURES = _F_SIGNS + 3


def _figures(text: str, linked: int) -> list[int]:
    words = text.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 8 else 2 if words < 16 else 3 if words < 30 else 4 if words < 60 else 5
    share = linked / max(1, len(text))
    link = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3
    stops = sum(text.count(c) for c in ".!?") + sum(text.count(c) for c in "。！？।")
    out = [_F_WORDS + size, _F_LINK + link, _F_STOPS + min(stops, 2)]
    if "©" in text or "(c)" in text[:40].lower():
        out.append(_F_SIGNS)
    if text[-1:] in ".!?…\"'»”":
        out.append(_F_SIGNS + 1)
    if "|" in text or "·" in text:
        out.append(_F_SIGNS + 2)
    return out


def parse(page: str | None, to: Nodes) -> None:
    """Append the nodes of one page. Null and empty pages have none; unclosed and stray tags are put up with."""
    page = page or ""
    opened: list[tuple[str, int]] = []  # tag, node
    places: dict[str, list[int]] = {}  # where in ``opened`` each tag stands, so that no stray tag has to look for it
    runs: list[str] = []
    muted: list[tuple[str, int, int]] = []  # tag, how many runs and linked characters were before it
    mutes: dict[str, int] = {}
    state = {"linked": 0, "links": 0}
    ahead: dict[re.Pattern, tuple[int, re.Match | None]] = {}  # the next match of a pattern, and from where it was sought

    def node(kind: int, features: list[int], text: str = "", mark: str = "") -> int:
        parent = opened[-1][1] if opened else -1
        to.parent.append(parent)
        to.depth.append(to.depth[parent] + 1 if parent >= 0 else 0)
        to.kind.append(kind)
        to.features.append(features)
        to.text.append(text)
        to.mark.append(mark)
        return len(to.parent) - 1

    def flush() -> None:
        text = " ".join("".join(runs).split())
        runs.clear()
        muted.clear()
        mutes.clear()
        if text:
            # text outside of all elements stands in the body
            above = _BLOCK[opened[-1][0] if opened else "body"]
            node(LEAF, [LEAF, _F_PARENT + above, *_figures(text, state["linked"])], text)
        state["linked"] = 0

    def say(raw: str, decode: bool = True) -> None:
        if raw:
            text = html.unescape(raw) if decode and "&" in raw else raw
            runs.append(text)
            if state["links"]:
                state["linked"] += len(text)

    def last(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close(names: set[str], stops: set[str]) -> None:
        k = last(names)
        if k >= 0 and k > last(stops):
            flush()
            while len(opened) > k:
                places[opened.pop()[0]].pop()

    def following(pattern: re.Pattern, at: int) -> re.Match | None:
        since, m = ahead.get(pattern, (len(page) + 1, None))
        if at < since or (m is not None and m.start() < at):
            m = pattern.search(page, at)
            ahead[pattern] = (at, m)
        return m

    def unmute(name: str) -> None:
        while mutes.get(name):
            tag, size, linked = muted.pop()
            mutes[tag] -= 1
            if tag == name:
                del runs[size:]
                runs.append(" ")
                state["linked"] = linked
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name == "a":
                state["links"] = max(0, state["links"] - 1)
            elif name in _MUTE:
                unmute(name)
            elif name in _BLOCK:
                close({name}, set())
            continue
        if name in _RAW:
            stop = following(_ENDS[name], at)
            at = stop.end() if stop else end
            runs.append(" ")
        elif name == "xmp":
            stop = following(_ENDS[name], at)
            say(page[at : stop.start() if stop else end], decode=False)
            at = stop.end() if stop else end
        elif name in _ASIDE:
            stop, again = following(_ENDS[name], at), following(_STARTS[name], at)
            if stop and not (again and again.start() < stop.start()):
                at = stop.end()
            runs.append(" ")
        elif name in _MUTE:
            if not m["attrs"].endswith("/"):
                muted.append((name, len(runs), state["linked"]))
                mutes[name] = mutes.get(name, 0) + 1
            runs.append(" ")
        elif name == "a":
            state["links"] += 1
        elif name in _VOID:
            runs.append(" ")
            if name == "hr":
                flush()
        elif name in _BLOCK:
            if name in _CLOSES:
                close(*_CLOSES[name])
            if opened and opened[-1][0] == "p":
                close({"p"}, set())
            flush()
            words = {w for got in _NAMES.findall(m["attrs"]) for w in _WORD.findall("".join(got).lower())} if m["attrs"] else ()
            mark = (re.search(r"data-keep=\"(\d)\"", m["attrs"]) or [None, ""])[1] if "data-keep" in m["attrs"] else ""
            new = node(_BLOCK[name], [_BLOCK[name], *(_F_CUE + _CUE[w] for w in words if w in _CUE)], mark=mark)
            places.setdefault(name, []).append(len(opened))
            opened.append((name, new))
    flush()


@dataclass(frozen=True)
class Model:
    """``unary``: a weight per feature; ``pair[kind]``: log-potentials of (parent, child) states by the child's kind."""

    unary: np.ndarray
    pair: np.ndarray


@dataclass
class _Tree:
    parent: np.ndarray
    kind: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, nodes: Nodes) -> _Tree:
        depth = np.array(nodes.depth, np.int64)
        rows = np.repeat(np.arange(len(depth)), [len(f) for f in nodes.features]) if len(depth) else np.empty(0, np.int64)
        columns = np.array([x for f in nodes.features for x in f], np.int64)
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else []
        return cls(np.array(nodes.parent, np.int64), np.array(nodes.kind, np.int64), rows, columns, levels)


def sum_product(tree: _Tree, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Exact marginals: of content per node, of the four (parent, child) states per node with a parent; the log-partition."""
    n = len(tree.parent)
    unary = np.zeros((n, 2))
    unary[:, 1] = np.bincount(tree.rows, model.unary[tree.columns], n) if n else 0
    pair = model.pair[tree.kind]  # node, parent state, own state
    belief, upward = unary.copy(), np.zeros((n, 2))
    for level in reversed(tree.levels):  # from the deepest: each node tells its parent
        below = level[tree.parent[level] >= 0]
        upward[below] = np.logaddexp.reduce(pair[below] + belief[below][:, None, :], axis=2)
        np.add.at(belief, tree.parent[below], upward[below])
    edge = np.zeros((n, 2, 2))
    for level in tree.levels:  # from the roots: each parent tells its children what the rest says
        below = level[tree.parent[level] >= 0]
        parents = tree.parent[below]
        rest = belief[parents] - upward[below]
        joint = rest[:, :, None] + pair[below] + belief[below][:, None, :]
        belief[below] += np.logaddexp.reduce(rest[:, :, None] + pair[below], axis=1)
        edge[below] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(below), 4), axis=1)[:, None, None])
    total = np.logaddexp(belief[:, 0], belief[:, 1])
    roots = tree.parent < 0
    return np.exp(belief[:, 1] - total), edge, float(total[roots].sum())


def train(nodes: Nodes, labels: np.ndarray, steps: int = 250, ridge: float = 0.5) -> Model:
    """Maximise the labelled forest's penalised log-likelihood by Adam on exact gradients from the marginals."""
    tree = _Tree.of(nodes)
    kinds = LEAF + 1
    weights = np.zeros(N_FEATURES + kinds * 4)
    inner = tree.parent >= 0
    seen = np.bincount(tree.columns, labels[tree.rows], N_FEATURES)
    seen_pair = np.zeros((kinds, 2, 2))
    np.add.at(seen_pair, (tree.kind[inner], labels[tree.parent[inner]], labels[inner]), 1)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        model = Model(weights[:N_FEATURES], weights[N_FEATURES:].reshape(kinds, 2, 2))
        content, edge, _ = sum_product(tree, model)
        expected = np.bincount(tree.columns, content[tree.rows], N_FEATURES)
        expected_pair = np.zeros((kinds, 2, 2))
        np.add.at(expected_pair, tree.kind[inner], edge[inner])
        slope = np.r_[seen - expected, (seen_pair - expected_pair).ravel()] - ridge * weights
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        weights = weights + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(weights[:N_FEATURES], weights[N_FEATURES:].reshape(kinds, 2, 2))


def sample_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Labelled pages from templates of common layouts: ``data-keep="1"`` opens content, ``"0"`` ends it for a subtree."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[r.integers(len(x))]
    word = lambda: "".join(pick("ba", "ten", "or", "is", "la", "mi", "ku", "re", "so", "van") for _ in range(r.integers(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.integers(a, b)))
    sentence = lambda: words(4, 18).capitalize() + pick(".", ".", ".", "!", "?")
    prose = lambda a, b: " ".join(sentence() for _ in range(r.integers(a, b)))
    odd = lambda: pick(words(1, 6), words(3, 30), " | ".join(word() for _ in range(r.integers(2, 20))), words(2, 12) + " &amp; " + sentence())
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.integers(a, b)))
    named = lambda tag, *names: f'{tag} {pick("class", "id")}="{pick(*names)}"'

    def junk() -> str:
        kind = r.integers(13)
        if kind == 0:
            return f"<nav data-keep=\"0\"><ul>{links(3, 9)}</ul></nav>"
        if kind == 1:
            return f'<{named("div", "menu", "main-menu", "navbar", "breadcrumbs")} data-keep="0"><ul>{links(2, 8)}</ul></div>'
        if kind == 2:
            return f'<{named("div", "ad", "ads", "advert", "ad-box", "sponsored", "promo")} data-keep="0">{pick(words(2, 6), prose(1, 3), "<p>" + prose(1, 2) + "</p>")}</div>'
        if kind == 3:
            return f'<aside data-keep="0"><h3>{words(1, 4)}</h3>{pick("<ul>" + links(2, 6) + "</ul>", "<p>" + prose(1, 3) + "</p>")}</aside>'
        if kind == 4:
            return f'<{named("div", "sidebar", "side-rail", "widget", "related", "popular")} data-keep="0"><h4>{words(1, 4)}</h4><p>{prose(1, 3)}</p><ul>{links(1, 6)}</ul></div>'
        if kind == 5:
            return f'<form data-keep="0" action="/{word()}"><label>{words(1, 4)}</label><input name="q"><p>{prose(1, 2)}</p><button>{word()}</button></form>'
        if kind == 6:
            return f'<{named("div", "cookie-notice", "cookie-banner", "notice", "consent", "alert")} data-keep="0"><p>{prose(1, 3)}</p><button>{word()}</button></div>'
        if kind in (7, 8):
            inside = "".join(f'<div class="{pick("comment", "reply", "c")}"><p>{pick("<b>" + word() + "</b> ", "")}{prose(1, 5)}</p></div>' for _ in range(r.integers(1, 6)))
            return f'<{pick("section", "div")} {pick("class", "id")}="{pick("comments", "comment-list", "discussion", "replies")}" data-keep="0"><h3>{words(1, 3)}</h3>{inside}</' + "{}>"
        if kind == 9:
            return f'<{named("div", "share", "social", "newsletter", "subscribe", "tags", "pagination")} data-keep="0">{pick("<ul>" + links(2, 5) + "</ul>", "<p>" + prose(1, 2) + "</p>")}</div>'
        if kind == 10:
            return f'<header data-keep="0"><div class="logo">{words(1, 3)}</div><p>{pick(words(2, 8), sentence())}</p></header>'
        if kind == 11:
            return f'<div data-keep="0"><ul>{links(4, 12)}</ul></div>'
        return f'<footer data-keep="0">&copy; {words(1, 4)} &middot; {pick(sentence(), words(2, 9))}</footer>'

    def fixed(text: str) -> str:
        return text.replace("{}", re.match(r"<(\w+)", text)[1])

    def story() -> str:
        parts = [f"<h1>{pick(words(2, 9), sentence(), odd())}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.15:
            parts.append(f'<div class="{pick("byline", "meta", "date")}" data-keep="0">{words(2, 5)}</div>')
        if r.random() < 0.15:  # verse, lists of short lines, refrains
            refrain = pick("", words(1, 4) + pick("", "."))
            parts += [f"<p>{refrain if refrain and r.random() < 0.5 else pick(words(1, 5), sentence())}</p>" for _ in range(r.integers(5, 60))]
        for _ in range(r.integers(1, 14)):
            kind = r.random()
            if kind < 0.66:
                body = prose(1, 6) if r.random() < 0.75 else odd()
                parts.append(f"<p>{pick('', '', '<b>', '<i>')}{body}{pick('', '', '<br>')}{pick('</p>', '</p>', '</p>', '')}")
            elif kind < 0.72:
                parts.append(f"<p>{sentence()} <a href=\"/x\">{words(1, 4)}</a> {prose(1, 3)}</p>")
            elif kind < 0.78:
                parts.append(f"<{(h := pick('h2', 'h3'))}>{words(1, 7)}</{h}>")
            elif kind < 0.84:
                parts.append(f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{pick(sentence(), words(2, 8))}</li>" for _ in range(r.integers(2, 6))) + f"</{t}>")
            elif kind < 0.88:
                parts.append(f"<blockquote>{pick('<p>' + prose(1, 3) + '</p>', prose(1, 3))}</blockquote>")
            elif kind < 0.91:
                parts.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr>" for _ in range(r.integers(1, 4))) + "</table>")
            elif kind < 0.94:
                parts.append(f"<div>{prose(1, 4)}</div>")
            elif kind < 0.96:
                parts.append(f"<pre>{odd()}</pre>")
            else:
                parts.append(fixed(junk()) if r.random() < 0.6 else f"<figure><img src=\"x\"><figcaption>{sentence()}</figcaption></figure>")
        return "".join(parts)

    pages = []
    for _ in range(n):
        top = "".join(fixed(junk()) for _ in range(r.integers(0, 4)))
        if r.random() < 0.5:
            top = f"<nav data-keep=\"0\"><ul>{links(3, 9)}</ul></nav>" + top
        low = "".join(fixed(junk()) for _ in range(r.integers(0, 4)))
        if r.random() < 0.6:
            low += f'<footer data-keep="0">&copy; {words(1, 4)} &middot; {pick(sentence(), words(2, 9), prose(1, 3))}</footer>'
        shell = r.integers(7)
        inner = story()
        if shell <= 1:
            core = f'<article data-keep="1">{inner}</article>'
        elif shell == 2:
            core = f'<main><article data-keep="1">{inner}</article></main>'
        elif shell == 3:
            core = f'<main data-keep="1">{inner}</main>'
        elif shell == 4:
            core = f'<{named("div", "content", "post", "entry-content", "article-body", "story", "main-content", "post-text")} data-keep="1">{inner}</div>'
        elif shell == 5:
            core = f'<div class="{pick("container", "wrapper", "row")}"><div data-keep="1">{inner}</div></div>'
        if shell == 6:  # the body itself holds the story, or a page is nothing but text
            bare = r.random()
            inner = inner if bare < 0.6 else "<br><br>".join(prose(1, 5) for _ in range(r.integers(1, 5))) if bare < 0.9 else prose(1, 4)
            junk_at = "" if bare >= 0.9 else top
            pages.append(f'<html><head><title>{words(1, 6)}</title></head><body data-keep="1">{junk_at}{inner}{low if junk_at else ""}</body></html>')
            continue
        if r.random() < 0.3:
            core, low = f'<div class="{pick("container", "wrapper", "page", "row")}">{core}{low}</div>', ""
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title></head><body>{top}{core}{low}</body></html>")
    return pages


def labelled(pages: list[str]) -> tuple[Nodes, np.ndarray]:
    """Nodes of labelled pages and their labels, which marks pass down to all that is inside."""
    nodes = Nodes.empty()
    for page in pages:
        parse(page, nodes)
    labels = np.zeros(len(nodes.parent), np.int64)
    for i, (parent, mark) in enumerate(zip(nodes.parent, nodes.mark)):
        labels[i] = int(mark) if mark else labels[parent] if parent >= 0 else 0
    return nodes, labels


@cache
def default_model() -> Model:
    return train(*labelled(sample_pages()))


def extract_many(pages: list[str | None], model: Model) -> list[str]:
    """Main texts of the pages, empty where there is none."""
    nodes, ends = Nodes.empty(), []
    for page in pages:
        parse(page, nodes)
        ends.append(len(nodes.parent))
    content, _, _ = sum_product(_Tree.of(nodes), model)
    kept, out, at = content >= 0.5, [], 0
    for end in ends:
        out.append("\n".join(nodes.text[i] for i in range(at, end) if nodes.text[i] and kept[i]))
        at = end
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` to ``page_id, url, text, n_chars``, a row per row.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by line breaks in
    page order. A null or empty page, or one without main text, has an empty text. Null ids and repeated rows are
    carried along; other columns are ignored; an empty table gives no rows. The model is a few kilobytes.
    """
    arrow_batches(pages.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, texts = batch.column("html").to_pylist(), []
            for k in range(0, len(whole), 50):  # message passing goes over a few pages at once
                texts += extract_many(whole[k : k + 50], model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
