"""HTML extraction: a tree-structured graphical model over DOM nodes.

Each element is content or not. Its own potential comes from its tag, the words of its class, id and
role, and how much of its text is link text; a potential on each parent-child edge, by the kind of the
child's tag, says how far a child follows its parent. Sum-product messages go up the tree and down
again and give exact marginals; text whose element's marginal reaches one half is the main text.
Weights are trained by gradient ascent on the likelihood of labelled pages (LABELLED, marked with
data-main), for which the same messages give the expectations.

Trees of many pages are passed through together, level by level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracksift.llm import words as W
from tracksift.session import ship

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
#: Elements whose insides are no text, and how each ends.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "title", "noscript", "template", "svg", "iframe", "canvas")}
#: Of these, the ones whose insides are no markup: without an end tag they reach to the page's end, and "/>" doesn't close them.
_OPEN_ENDED = frozenset(("script", "style"))
_ATTR = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLANK = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: An opening tag of these ends an open p.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open element of these, up to a border.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
BORDER = frozenset("ul ol dl table div section article body main aside nav header footer form blockquote".split())

#: Fixed word groups of class, id, role and aria-label values.
GROUPS = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc skip tabs",
    "header": "header masthead topbar banner logo branding",
    "footer": "footer foot colophon copyright legal",
    "side": "sidebar side aside rail widget widgets complementary related recommended trending popular",
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall subscribe newsletter signup toast",
    "comment": "comment comments reply replies disqus respond discussion reader",
    "share": "share sharing social follow tags author byline meta",
    "form": "form search login contact survey poll",
    "main": "article content main post entry story body text prose page",
}
_GROUP_OF = {w: g for g, ws in GROUPS.items() for w in ws.split()}
_TAGS = "html body div section article main nav header footer aside form button select textarea fieldset ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table tr td th blockquote pre figure figcaption details summary a label dialog menu address".split()
_KINDS = ("inline", "block", "container", "list", "heading")
_KIND_OF = {**{t: "inline" for t in INLINE}, **{t: "container" for t in ("html", "body", "div", "section", "main", "article", "td", "th", "table", "tr", "tbody")}, **{t: "list" for t in ("ul", "ol", "li", "dl", "dt", "dd")}, **{t: "heading" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "header")}}
FEATURES = {name: i for i, name in enumerate(["bias", *(f"tag:{t}" for t in _TAGS), *(f"is:{g}" for g in GROUPS), "links:high", "links:some", "text:long", "text:short", "under:article", "under:body"])}
N_FEATURES = len(FEATURES)


class Node:
    __slots__ = ("parent", "tag", "attrs", "depth", "own", "linked", "block")

    def __init__(self, parent: int, tag: str, attrs: str, depth: int, block: int) -> None:
        self.parent, self.tag, self.attrs, self.depth, self.block = parent, tag, attrs, depth, block
        self.own = self.linked = 0


def parse(html: str) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """Nodes in page order (the first is the page), and pieces of text: node, block, decoded text.

    Pieces of one block follow each other without a gap; scripts, styles, titles, drawings, comments and markup
    give no text. A head needs no end tag: what it holds gives no text anyway. An element whose insides are passed
    over ends with its own tag if that is closed by "/>" or no end tag follows (scripts and styles reach to the end).
    """
    nodes = [Node(-1, "#page", "", 0, 0)]
    stack, pieces, block, at = [0], [], 0, 0
    unclosed: set[str] = set()

    def text(raw: str) -> None:
        if raw:
            t = unescape(raw) if "&" in raw else raw
            node = stack[-1]
            pieces.append((node, block, t))
            n = len(t.strip())
            nodes[node].own += n
            if any(nodes[i].tag == "a" for i in stack[-3:]):
                nodes[node].linked += n

    def pop_to(i: int) -> None:
        nonlocal block
        for k in stack[i:]:
            if nodes[k].tag not in INLINE:
                block += 1
        del stack[i:]

    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "head":
            block += tag == "head"
            continue
        if tag in _RAW and not m[1]:
            block += 1
            if tag in unclosed or (tag not in _OPEN_ENDED and m[3].endswith("/")):
                continue
            end = _RAW[tag].search(html, at)
            if end:
                at = end.end()
            elif tag in _OPEN_ENDED:
                at = len(html)
            else:
                unclosed.add(tag)
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == tag:
                    pop_to(i)
                    break
            else:
                block += tag not in INLINE
            continue
        if tag in VOID:
            block += tag not in INLINE
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                t = nodes[stack[i]].tag
                if t == "p":
                    pop_to(i)
                    break
                if t in BORDER:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in ENDS else ():
            t = nodes[stack[i]].tag
            if t in ENDS[tag]:
                pop_to(i)
                if tag != "tr" and tag != "tbody":
                    break
            elif t in BORDER:
                break
        if tag not in INLINE:
            block += 1
        nodes.append(Node(stack[-1], tag, m[3] or "", len(stack), block))
        if tag != "math" or not m[3].endswith("/"):
            stack.append(len(nodes) - 1)
    text(html[at:])
    return nodes, pieces


def features(nodes: list[Node]) -> list[list[int]]:
    """Active features of each node."""
    total, linked = [n.own for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        total[p] += total[i]
        linked[p] += linked[i]
    out = []
    under = [False] * len(nodes)
    for i, n in enumerate(nodes):
        f = [0]
        if i:
            under[i] = under[n.parent] or nodes[n.parent].tag in ("article", "main")
        k = FEATURES.get(f"tag:{n.tag}")
        if k is not None:
            f.append(k)
        if n.attrs and ("=" in n.attrs):
            seen = set()
            for name, *values in _ATTR.findall(n.attrs):
                if name.lower() in ("class", "id", "role", "aria-label"):
                    for w in _WORD.findall(values[0] or values[1] or values[2]):
                        g = _GROUP_OF.get(w.lower())
                        if g and g not in seen:
                            seen.add(g)
                            f.append(FEATURES[f"is:{g}"])
        if total[i]:
            r = linked[i] / total[i]
            if r > 0.6:
                f.append(FEATURES["links:high"])
            elif r > 0.25:
                f.append(FEATURES["links:some"])
            f.append(FEATURES["text:long" if total[i] > 140 else "text:short"])
        f.append(FEATURES["under:article" if under[i] else "under:body"])
        out.append(f)
    return out


class Forest(NamedTuple):
    """Nodes of several pages: parent (-1 for roots), depth, kind of tag, and features as (node, feature) pairs."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    owner: np.ndarray
    feature: np.ndarray


def forest(pages: list[list[Node]]) -> Forest:
    parent, depth, kind, owner, feature, base = [], [], [], [], [], 0
    for nodes in pages:
        for i, (n, f) in enumerate(zip(nodes, features(nodes), strict=True)):
            parent.append(n.parent + base if i else -1)
            depth.append(n.depth)
            kind.append(_KINDS.index(_KIND_OF.get(n.tag, "block")))
            owner += [base + i] * len(f)
            feature += f
        base += len(nodes)
    return Forest(*(np.array(x, np.int64) for x in (parent, depth, kind, owner, feature)))


class Weights(NamedTuple):
    """unary: for content, by feature; edge: by kind of child, parent's state, child's state."""

    unary: np.ndarray
    edge: np.ndarray


def marginals(w: Weights, t: Forest) -> tuple[np.ndarray, np.ndarray, float]:
    """P(content) of each node, pair marginals of each edge (zeros at roots), and the log partition sum."""
    n = len(t.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(t.owner, w.unary[t.feature], minlength=n)
    edge = w.edge[t.kind]  # node, parent's state, own state
    order = [np.flatnonzero(t.depth == d) for d in range(int(t.depth.max()) + 1)] if n else []
    up, belief = np.zeros((n, 2)), own.copy()
    for at in reversed(order[1:]):
        up[at] = np.logaddexp(edge[at, :, 0] + belief[at, None, 0], edge[at, :, 1] + belief[at, None, 1])
        np.add.at(belief, t.parent[at], up[at])
    roots = order[0] if order else np.zeros(0, np.int64)
    log_z = float(np.logaddexp(belief[roots, 0], belief[roots, 1]).sum())
    pair, full = np.zeros((n, 2, 2)), belief.copy()
    for at in order[1:]:
        rest = full[t.parent[at]] - up[at]
        full[at] = belief[at] + np.logaddexp(edge[at, 0] + rest[:, 0, None], edge[at, 1] + rest[:, 1, None])
        joint = edge[at] + rest[:, :, None] + belief[at][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pair[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), pair, log_z


def train(pages: list[str], steps: int = 300, rate: float = 0.3, decay: float = 0.002) -> Weights:
    """Weights from pages whose elements carry data-main="1" or "0" (children inherit the mark)."""
    trees = [parse(p)[0] for p in pages]
    y = []
    for nodes in trees:
        mark: list[int] = []
        for n in nodes:
            m = re.search(r'data-main="([01])"', n.attrs)
            mark.append(int(m[1]) if m else (mark[n.parent] if n.parent >= 0 else 0))
        y += mark
    t, y = forest(trees), np.array(y)
    inner = t.parent >= 0
    goal = np.bincount(t.feature, y[t.owner], minlength=N_FEATURES)
    goal_edge = np.zeros((len(_KINDS), 2, 2))
    np.add.at(goal_edge, (t.kind[inner], y[t.parent[inner]], y[inner]), 1)
    w = Weights(np.zeros(N_FEATURES), np.zeros((len(_KINDS), 2, 2)))
    sq_u, sq_e = np.full_like(w.unary, 1e-6), np.full_like(w.edge, 1e-6)
    for _ in range(steps):
        p, pair, _ = marginals(w, t)
        g = (goal - np.bincount(t.feature, p[t.owner], minlength=N_FEATURES)) / len(pages) - decay * w.unary
        e = np.zeros_like(w.edge)
        np.add.at(e, t.kind[inner], pair[inner])
        e = (goal_edge - e) / len(pages) - decay * w.edge
        sq_u += g**2
        sq_e += e**2
        w = Weights(w.unary + rate * g / np.sqrt(sq_u), w.edge + rate * e / np.sqrt(sq_e))
    return w


_LOREM = "Long ago the river changed its bed and the mill fell silent, so people went to the hills, where the soil was thin but the air was dry and clear for most of the year."


def _labelled() -> list[str]:
    """Training pages: layouts of the open web by hand, with what is main marked; combined so that each part occurs with and without others."""
    p = f"<p>{_LOREM}</p>"
    bodies = [
        f"<h1>A title here</h1>{p}{p}<p>Short one.</p>",
        f"<h1>A title here</h1><p><b>Lead in bold<br>{p}{p}",
        f"<h1>A title here</h1><p><b>Lead in bold<br></p>",
        f'{p}<h2>Part</h2><ul><li>One point of some length</li><li>Another <a href="/x">linked</a> point</li></ul>{p}',
        f"<h1>A title</h1>{p}<blockquote>{p}</blockquote><figure><img src=x><figcaption>What it shows</figcaption></figure><pre>x = 1</pre>",
        f'<p>See <a href="/a">this long link text inside a sentence</a> and <em>more</em>.</p>{p}<table><tr><th>Year</th><td>1990</td></tr></table>',
        "<p>Brief.</p>",
        f"<div><p>{_LOREM}</p><div>{_LOREM}</div></div><ol><li>First step</li><li>Second step</li></ol>",
    ]
    wraps = [
        '<article data-main="1">{}</article>',
        '<main data-main="1">{}</main>',
        '<div class="content" data-main="1">{}</div>',
        '<div id="main"><div class="post-body" data-main="1">{}</div></div>',
        '<main data-main="1"><article class="entry">{}</article></main>',
        '<section class="story" data-main="1">{}</section>',
        '<article data-main="1">{}<aside class="related" data-main="0"><p>Read more about this</p><ul><li><a href="/r">Other story</a></li></ul></aside></article>',
        '<article data-main="1">{}<div class="share" data-main="0"><a href="#">Share</a> <a href="#">Post</a></div></article>',
        '<article data-main="1">{}<div class="ad" data-main="0">Buy the new thing now, it is cheap and good.</div></article>',
        '<article data-main="1">{}<section class="comments" data-main="0"><h3>Comments</h3><div class="comment"><p>' + _LOREM + "</p></div></section></article>",
        '<article data-main="1">{}<form data-main="0"><label>Mail</label><input name=m><button>Send</button></form></article>',
        '<article data-main="1"><nav class="toc" data-main="0"><a href="#1">One</a><a href="#2">Two</a></nav>{}</article>',
    ]
    links = "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(5))
    before = [
        "",
        f"<nav><ul>{links}</ul></nav>",
        f'<header><div class="logo">Site</div><ul class="menu">{links}</ul></header>',
        f'<nav><ul>{links}</ul></nav><div class="ad">Some words of an advert that may be a full sentence. Or two.</div>',
        f'<div class="navbar"><a href="/">Home</a><a href="/n">News</a></div><div class="cookie-notice"><p>We use cookies to make the site work. {_LOREM}</p><button>OK</button></div>',
        f'<header><h1>Name of the site</h1><p>Its motto in words</p></header><div id="banner">{_LOREM}</div>',
        f'<div role="navigation">{links}</div><aside class="notice"><p>{_LOREM}</p></aside>',
    ]
    after = [
        "",
        "<footer>&copy; example &middot; A line of words to end.</footer>",
        f'<aside><h3>Popular</h3><ul>{links}</ul></aside><footer><p>{_LOREM}</p></footer>',
        f'<div class="sidebar"><p>{_LOREM}</p><ul>{links}</ul></div><div id="footer">Imprint</div>',
        f'<section id="comments"><h2>Comments</h2><div class="comment"><p>{_LOREM}</p></div><ol><li>I agree with all of it.</li></ol></section><footer>End</footer>',
        f'<form class="newsletter"><p>Get our letter.</p><input><button>Join</button></form><div class="promo">{_LOREM}</div>',
        f'<div class="advert"><p>{_LOREM}</p></div><div class="related"><a href="/q">Other</a></div><footer><nav><a href="/i">Imprint</a></nav></footer>',
    ]
    out = []
    for i, wrap in enumerate(wraps):
        for j, body in enumerate(bodies):
            b, a = before[(i + j) % len(before)], after[(2 * i + j) % len(after)]
            out.append(f"<html><body>{b}{wrap.format(body)}{a}</body></html>")
    return out


_weights: Weights | None = None


def default_weights() -> Weights:
    global _weights
    if _weights is None:
        _weights = train(_labelled())
    return _weights


def main_texts(w: Weights, htmls: list[str]) -> list[str]:
    """The main text of each page."""
    parsed = [parse(h) for h in htmls]
    p, _, _ = marginals(w, forest([nodes for nodes, _ in parsed]))
    out, base = [], 0
    for nodes, pieces in parsed:
        blocks: list[str] = []
        last = -1
        for node, block, text in pieces:
            # a page without elements is all text
            if len(nodes) == 1 or p[base + node] >= 0.5:
                if block == last:
                    blocks[-1] += text
                else:
                    blocks.append(text)
                last = block
        out.append(" ".join(x for b in blocks if (x := _BLANK.sub(" ", b).strip())))
        base += len(nodes)
    return out


def extract(pages: DataFrame, html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """Every row of pages with its other columns, text (its main text; empty if none) and n_chars (code points).

    Null html is empty; html without any element is all text. Broken markup is read as far as it goes: open
    elements end with the page, stray end tags are passed over, an open comment or script reaches to the end. Columns named text or n_chars
    are replaced. An empty table gives no rows; rows that repeat are read each.
    """
    spark = pages.sparkSession
    ship(spark)
    w = spark.sparkContext.broadcast(weights or default_weights())
    other = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in W.blocks(batch.column(0)):
                texts = main_texts(w.value, [h or "" for h in batch.column(0).slice(lo, hi - lo).to_pylist()])
                cols = [c.slice(lo, hi - lo) for c in batch.columns[1:]]
                yield pa.record_batch([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])

    own = pages.select(html_col, *other)
    schema = T.StructType([*own.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return own.mapInArrow(scan, schema)
