"""Main text of web pages by a tree-structured graphical model over the DOM.

The block elements of a page are the nodes; each is content or not. A node has a
potential of its own (a logistic model of its tag, the words of its attributes
and of those of the nearest element around it that has any, the kind of section it
is in, its text and links) and one with its parent. Sum-product messages, once upward
and once downward, give the exact marginal of every node; the text of the nodes
whose marginal is at least one half is the result. Both potentials are trained
from labelled pages (``html_pages``), on the driver, once.

Inline elements belong to the block around them; scripts, styles, comments and
controls have no text. Character references are decoded after the markup is cut.

Defined cases: a null or empty page has no text; text outside of any element
belongs to the root, so that a page without markup is judged as one block by its text; unclosed and stray tags are tolerated (whatever a head cannot
hold ends it, and a block's start ends a control without an end tag), nesting of any depth
and pages of any length are handled without recursion; repeated rows are read
each by itself; an empty table gives an empty result; other columns are not read.
Where no tag or name tells, as on a page of plain ``div`` or table cells, size,
links, sentences and the place among the neighbours decide: blocks of sentences
are kept, blocks of links and the short ones at the ends of a page go. A
``header`` goes also inside an article, and its heading with it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.llm.common import table
from amplispark.llm.html_pages import labelled_pages

# Kinds of HTML elements.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary dialog menu center hgroup search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video select option button textarea head title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
ENDS_P = BLOCKS - {"html", "body"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SECTIONS = frozenset("article main aside nav header footer form".split())
LISTS = frozenset("ul ol dl table menu".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|data-content)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: list[str] = field(default_factory=list)
    label: str | None = None
    chars: int = 0
    link_chars: int = 0
    stops: int = 0


def closed_controls(page: str) -> set[int]:
    """Where those silent elements start that have an end tag of their own, before the end of the element around them."""
    out: set[int] = set()
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()  # so that an end tag without a start is not looked for in the stack
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if m[1] or m[4]:
            if opened[tag]:
                open_at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if tag in SILENT:
                    out.add(stack[open_at][1])
                opened.subtract(t for t, _ in stack[open_at:])
                del stack[open_at:]
        elif tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag in BLOCKS or (tag in SILENT and not (m[3] or m[6] or "").endswith("/")):
            stack.append((tag, m.start()))
            opened[tag] += 1
    return out


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """The block nodes, each after its parent, and (node, block run, text) in page order.

    A run is a stretch of one block's own text; a block within it ends it.
    """
    nodes = [Node("root", -1)]
    texts: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int, int]] = [("root", 0, 0)]  # open elements with the node that their text belongs to, -1 in silent ones, and their place
    closed: set[int] | None = None  # looked up when a block first starts in a silent element
    opened: Counter[str] = Counter()
    run, at = 0, 0
    page = page or ""

    def shut(k: int) -> None:
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if stack[-1][0] == "head" and page[at:end].strip():
            shut(len(stack) - 1)
        if end > at and stack[-1][1] >= 0:
            raw = page[at:end]
            if text := html.unescape(raw) if "&" in raw else raw:
                n = stack[-1][1]
                texts.append((n, run, text))
                size = len(text.strip())
                nodes[n].chars += size
                nodes[n].link_chars += size if opened["a"] else 0
                nodes[n].stops += text.count(".") + text.count(",")
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened[tag]:
                open_at = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if any(x[0] in BLOCKS for x in stack[open_at:]):
                    run += 1
                shut(open_at)
            continue
        if stack[-1][0] == "head" and tag not in HEAD:
            shut(len(stack) - 1)
        if tag in VOID:
            if stack[-1][1] >= 0:
                texts.append((stack[-1][1], run, " "))
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in BLOCKS and stack[-1][1] < 0:
            closed = closed_controls(page) if closed is None else closed
            outer = next(i for i, x in enumerate(stack) if x[1] < 0)
            if not any(t in SILENT and place in closed for t, _, place in stack[outer:]):
                shut(outer)
        closes = CLOSED_BY.get(tag, ())
        if tag in ENDS_P and (opened["p"] or any(opened[t] for t in closes)):
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i][0]
                if t == "p" or t in closes:
                    shut(i)
                    if t == "p" and closes:
                        continue
                    if t != "td" and t != "th":
                        break
                elif t in BLOCKS:
                    break
        owner = stack[-1][1]
        if tag in BLOCKS and owner >= 0:
            run += 1
            node = Node(tag, owner)
            for a in _ATTRIBUTE.finditer(m[3] or m[6] or ""):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "data-content":
                    node.label = value
                else:
                    node.names += [x.lower() for x in _NAMES.findall(value)]
            nodes.append(node)
            owner = len(nodes) - 1
        elif tag in SILENT:
            owner = -1
        if not (m[3] or m[6] or "").endswith("/") or tag in BLOCKS:
            stack.append((tag, owner, m.start()))
            opened[tag] += 1
    return nodes, texts


def _level(x: float, bounds: tuple[float, ...]) -> int:
    return sum(x > b for b in bounds)


@lru_cache(maxsize=20_000)
def of_name(x: str) -> tuple[str, ...]:
    """The features of a name: itself, and how it begins and ends, so that a name not seen in training is known by its parts."""
    return (f"name={x}", *(f"head={x[:k]}" for k in (2, 3, 4) if len(x) >= k), *(f"tail={x[-k:]}" for k in (3, 4) if len(x) >= k))


@lru_cache(maxsize=20_000)
def of_name_around(x: str) -> tuple[str, ...]:
    """The same of a name of the nearest element around that has one."""
    return tuple(f"within-{f}" for f in of_name(x))


def features(nodes: list[Node]) -> list[list[str]]:
    """The names of each node's binary features."""
    chars, links, stops = [n.chars for n in nodes], [n.link_chars for n in nodes], [n.stops for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        links[p] += links[i]
        stops[p] += stops[i]
    # Of the blocks with text below a node: the first, the last, the largest, and the kinds of section among them.
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    largest: dict[int, int] = {}
    kinds: dict[int, set[str]] = {}
    for i, n in enumerate(nodes):
        if i and chars[i]:
            first.setdefault(n.parent, i)
            last[n.parent] = i
            if n.parent not in largest or chars[i] > chars[largest[n.parent]]:
                largest[n.parent] = i
            if n.tag in SECTIONS:
                kinds.setdefault(n.parent, set()).add(n.tag)
    out = []
    around: list[tuple[list[str], str]] = []  # for the nodes within one: the nearest names, the nearest section
    for i, n in enumerate(nodes):
        share = links[i] / chars[i] if chars[i] else 0.0
        parent = nodes[n.parent].tag if n.parent >= 0 else ""
        names, section = around[n.parent] if n.parent >= 0 else ([], "")
        own = list(dict.fromkeys(n.names))
        around.append((own or names, n.tag if n.tag in SECTIONS else section))
        found = [f"tag={n.tag}", f"in={parent}", f"section={section}", f"size={_level(chars[i], (0, 15, 60, 200, 800))}", f"links={_level(share, (0, 0.3, 0.7))}", f"stops={_level(stops[i], (0, 2, 6))}"]
        if i and chars[i]:
            p = n.parent
            found.append("place=" + ("only" if first[p] == last[p] else "first" if first[p] == i else "last" if last[p] == i else "inner"))
            found.append("largest" if largest[p] == i else f"of-largest={_level(chars[i] / chars[largest[p]], (0.02, 0.1, 0.4))}")
            if not (own or names):
                found += [f"beside={x}" for x in kinds.get(p, ()) if x != n.tag]
        for x in own:
            found += of_name(x)
        for x in names:
            found += of_name_around(x)
        out.append(found)
    return out


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    pair: list[list[float]]  # log potentials of (parent, child)

    def own(self, names: list[str]) -> float:
        """Log odds of content from a node's own features."""
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in names)


def marginals(nodes: list[Node], own: list[float], pair: list[list[float]]) -> list[float]:
    """The probability of content of each node, by sum-product messages to the root and back."""
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    up0, up1 = [0.0] * len(nodes), list(own)
    sent = [(0.0, 0.0)] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        to0, to1 = add(pair[0][0] + up0[i], pair[0][1] + up1[i]), add(pair[1][0] + up0[i], pair[1][1] + up1[i])
        sent[i] = (to0, to1)
        up0[p] += to0
        up1[p] += to1
    out = [0.0] * len(nodes)
    for i, n in enumerate(nodes):
        if i:
            p = n.parent
            rest0, rest1 = up0[p] - sent[i][0], up1[p] - sent[i][1]
            up0[i] += add(pair[0][0] + rest0, pair[1][0] + rest1)
            up1[i] += add(pair[0][1] + rest0, pair[1][1] + rest1)
        out[i] = 1 / (1 + math.exp(min(700.0, max(-700.0, up0[i] - up1[i]))))
    return out


def labels(nodes: list[Node]) -> list[int]:
    """Each node's label: its region's; above the regions, content where content lies below."""
    out = [0] * len(nodes)
    for i, n in enumerate(nodes):
        inherited = out[n.parent] if i else -1
        out[i] = inherited if n.label is None else int(n.label)
    for i in range(len(nodes) - 1, 0, -1):
        if out[i] == 1:
            out[nodes[i].parent] = max(out[nodes[i].parent], 1)
    return [max(0, x) for x in out]


def forest_marginals(parent: np.ndarray, levels: list[np.ndarray], own: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`marginals` of many trees at once, a level of depth at a time, and the summed probabilities of (parent, child) labels."""
    up = np.stack([np.zeros(len(own)), own])
    sent = np.zeros_like(up)
    for at in reversed(levels[1:]):
        sent[:, at] = np.logaddexp(pair[:, :1] + up[0, at], pair[:, 1:] + up[1, at])
        for x in (0, 1):
            np.add.at(up[x], parent[at], sent[x, at])
    below, joint = up.copy(), np.zeros((2, 2))
    for at in levels[1:]:
        rest = up[:, parent[at]] - sent[:, at]
        both = rest[:, None] + pair[:, :, None] + below[None, :, at]
        both = np.exp(both - both.max(axis=(0, 1)))
        joint += (both / both.sum(axis=(0, 1))).sum(axis=2)
        up[:, at] += np.logaddexp(pair[0][:, None] + rest[0], pair[1][:, None] + rest[1])
    return 1 / (1 + np.exp(np.clip(up[0] - up[1], -700, 700))), joint


def train(pages: list[str], steps: int = 80, rate: float = 0.9, decay: float = 1e-7) -> Model:
    """Own and pair potentials together, by the likelihood of the labels: observed less expected features, the latter by sum-product."""
    parsed = [parse(p)[0] for p in pages]
    # Every other name is hidden, so that its beginning and end learn to stand for it.
    hidden = lambda i, fs: fs if i % 2 else [f for f in fs if not f.startswith(("name=", "within-name="))]
    named = [hidden(i, f) for i, f in enumerate(f for nodes in parsed for f in features(nodes))]
    y = np.array([x for nodes in parsed for x in labels(nodes)])
    first = np.cumsum([0, *map(len, parsed)])
    parent = np.array([max(0, n.parent) + a for nodes, a in zip(parsed, first[:-1].tolist(), strict=True) for n in nodes])
    depth = np.zeros(len(y), np.int64)
    for i, p in enumerate(parent.tolist()):
        depth[i] = depth[p] + 1 if p != i else 0
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
    inner = np.flatnonzero(depth > 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[inner]], y[inner]), 1)
    index = {f: k for k, f in enumerate(sorted({f for fs in named for f in fs}))}
    rows = np.repeat(np.arange(len(named)), [len(f) for f in named])
    cols = np.array([index[f] for fs in named for f in fs])
    n = len(index)
    w, m, v = (np.zeros(n + 5) for _ in range(3))
    for t in range(1, steps + 1):
        own, pair = np.bincount(rows, w[cols], len(y)) + w[n], w[n + 1 :].reshape(2, 2)
        p, joint = forest_marginals(parent, levels, own, pair)
        e = (p - y) / len(y)
        g = np.concatenate([np.bincount(cols, e[rows], n), [e.sum()], ((joint - seen) / len(y)).ravel()]) + decay * w / 10
        m, v = 0.9 * m + 0.1 * g, 0.95 * v + 0.05 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1e-9)
    return Model(float(w[n]), {f: float(w[k]) for f, k in index.items()}, w[n + 1 :].reshape(2, 2).tolist())


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the generated pages."""
    return train(labelled_pages())


def main_text(page: str | None, model: Model) -> str:
    """The text of a page's content blocks, one a line."""
    nodes, texts = parse(page)
    kept = marginals(nodes, [model.own(f) for f in features(nodes)], model.pair)
    blocks: list[tuple[int, int, list[str]]] = []
    for node, run, text in texts:
        if kept[node] >= 0.5:
            if not blocks or blocks[-1][:2] != (node, run):
                blocks.append((node, run, []))
            blocks[-1][2].append(text)
    lines = (" ".join("".join(parts).split()) for _, _, parts in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), sent.value) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLES: dict[str, str] = {}
