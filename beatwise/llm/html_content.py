"""Main text of web pages by a tree-structured graphical model.

Block elements and the text runs inside them are binary variables (content or not) on the page's tree. A variable has
a potential from its features, a parent and child share one; sum-product messages go from the leaves to the root and
back and give the marginal of every text run. Both kinds of potential are learned from labelled pages.
"""
from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwise.llm.tables import text_chunks

#: Fixed values of HTML: elements without content, elements inside a line (formulas too), elements whose content is no text of
#: the page. The content of the RAW ones is no markup and ends with the end tag alone.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span "
                   "strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msup msub msubsup "
                   "munder mover munderover mstyle mpadded mtable mtr mtd".split())
RAW = "script|style|textarea"
SKIPPED = frozenset("noscript template iframe object svg select button xmp".split()) | frozenset(RAW.split("|"))
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
        "option": {"option"}}
SCOPES = frozenset("html body div article main section aside nav table td th ul ol dl blockquote form header footer".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:[^>]*[^/>])?>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
                   re.S | re.I)
NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LABEL = re.compile(r"\bdata-content=\"([01])\"")

EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                          T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False),
                          T.StructField("n_blocks", T.LongType(), False)])


@dataclass
class Tree:
    """Nodes in page order; a parent comes before its children. ``text`` is None for elements."""
    parent: list[int] = field(default_factory=list)
    features: list[tuple] = field(default_factory=list)
    text: list = field(default_factory=list)
    label: list = field(default_factory=list)

    def add(self, parent: int, features: tuple, text=None, label=None) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.label.append(label)
        return len(self.parent) - 1


def _element(tag: str, attributes: str) -> tuple:
    names = ["tag " + tag]
    for kind, *values in NAMES.findall(attributes) if "=" in attributes else ():
        names += [f"name {w}" for w in re.split(r"[^a-z]+", "".join(values).lower()) if w]
    return tuple(dict.fromkeys(names))


def _run(text: str, linked: int, tag: str) -> tuple:
    words = text.count(" ") + 1
    share = 0 if not linked else 1 if 2 * linked < len(text) else 2
    return ("run in " + tag, f"words {min(5, int(math.log2(words)) // 1 if words else 0)}", f"linked {share}",
            f"stop {text[-1] in '.!?:;'}", f"rights {'©' in text or 'copyright' in text.lower()}")


def _skips(tokens: list[re.Match]) -> dict[int, int]:
    """Number of the end tag by number of the start tag of the skipped elements that are closed; an end tag closes the
    last one open."""
    ends: dict[int, int] = {}
    started: dict[str, list[int]] = {}
    for i, token in enumerate(tokens):
        tag = (token.group(3) or "").lower()
        if tag in SKIPPED:
            if not token.group(2):
                if not token.group(4).endswith("/"):
                    started.setdefault(tag, []).append(i)
            elif started.get(tag):
                ends[started[tag].pop()] = i
    return ends


def parse(page: str) -> Tree:
    """The tree of block elements and text runs. Broken markup is read as browsers do in the common cases: a block ends
    an open paragraph, an end tag closes what is open inside its element, one without a start is left out, and a tag
    that the end of the page cuts off is dropped. Skipped elements go up to their end tag; of those that close
    themselves or are never closed the tag alone goes, but script, style, textarea and comments run to the end of the
    page. Elements with a hyphen in their name are inside a line. The time is in proportion to the page."""
    tree = Tree()
    root = tree.add(-1, ("tag root",))
    stack: list[tuple[str, int]] = [("root", root)]
    blocks = [root]
    block_tags = ["root"]
    bounds: list[int] = []          # places in the stack of what a start tag may end or stop at
    opened: dict[str, int] = {}
    piece: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            tree.add(blocks[-1], _run(text, linked, block_tags[-1]), text, tree.label[blocks[-1]])
        linked = 0

    def pop() -> None:
        nonlocal links
        tag, node = stack.pop()
        opened[tag] -= 1
        if bounds and bounds[-1] == len(stack):
            bounds.pop()
        if node >= 0:
            flush()
            blocks.pop()
            block_tags.pop()
        elif tag == "a":
            links -= 1

    at = 0
    tokens = list(TOKEN.finditer(page))
    ends = _skips(tokens)
    skipped = -1
    for number, token in enumerate(tokens):
        if number <= skipped:
            at = token.end()
            continue
        if token.start() > at:
            text = html.unescape(page[at:token.start()])
            piece.append(text)
            if links:
                linked += len(text)
        at = token.end()
        tag = token.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            skipped = ends.get(number, -1)
            continue
        if token.group(2):
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            piece.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        attributes = token.group(4)
        inline = tag in INLINE or "-" in tag
        if inline:
            stack.append((tag, -1))
            links += tag == "a"
        else:
            for k in reversed(bounds):
                other = stack[k][0]
                ended = other in ENDS and (ENDS[other] is None or tag in ENDS[other])
                if ended:
                    while len(stack) > k:
                        pop()
                if ended and other != "p" or not ended and other in SCOPES:
                    break
            flush()
            label = LABEL.search(attributes)
            node = tree.add(blocks[-1], _element(tag, attributes), None, int(label.group(1)) if label else tree.label[blocks[-1]])
            if tag in ENDS or tag in SCOPES:
                bounds.append(len(stack))
            stack.append((tag, node))
            blocks.append(node)
            block_tags.append(tag)
        opened[tag] = opened.get(tag, 0) + 1
        if inline and attributes.endswith("/"):
            pop()
    if at < len(page):
        piece.append(html.unescape(page[at:]))
    flush()
    return tree


@dataclass
class Model:
    """Log-odds of content by feature, and log potentials of (parent, child) for child elements and text runs."""
    node: dict[str, float]
    edge: tuple[list, list]

    def __post_init__(self):
        self.cache: dict[tuple, float] = {}
        self.factors = [[[math.exp(x) for x in row] for row in kind] for kind in self.edge]

    def odds(self, features: tuple) -> float:
        found = self.cache.get(features)
        if found is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            found = self.cache[features] = math.exp(max(-30.0, min(30.0, sum(self.node.get(f, 0.0) for f in features))))
        return found


def marginals(tree: Tree, model: Model) -> tuple[list[float], list[tuple]]:
    """Probability of content for every node, and of (parent, child) = 00, 01, 10, 11 for every edge, by sum-product."""
    n = len(tree.parent)
    own = [model.odds(f) for f in tree.features]
    up0, up1 = [1.0] * n, [1.0] * n          # product of the children's messages
    to0, to1 = [1.0] * n, [1.0] * n          # message to the parent, by the parent's state
    for i in range(n - 1, 0, -1):
        m = model.factors[tree.text[i] is not None]
        a, b = up0[i], own[i] * up1[i]
        x, y = m[0][0] * a + m[0][1] * b, m[1][0] * a + m[1][1] * b
        s = x + y
        to0[i], to1[i] = x / s, y / s
        p = tree.parent[i]
        up0[p] *= to0[i]
        up1[p] *= to1[i]
        s = up0[p] + up1[p]
        up0[p] /= s
        up1[p] /= s
    down0, down1 = [1.0] * n, [1.0] * n
    prob, pairs = [0.0] * n, [()] * n
    for i in range(n):
        a, b = down0[i] * up0[i], down1[i] * own[i] * up1[i]
        if i:
            p = tree.parent[i]
            m = model.factors[tree.text[i] is not None]
            # The parent's belief without this child's message.
            out0 = down0[p] * up0[p] / max(to0[i], 1e-300)
            out1 = down1[p] * own[p] * up1[p] / max(to1[i], 1e-300)
            s = out0 + out1
            out0, out1 = out0 / s, out1 / s
            d0, d1 = out0 * m[0][0] + out1 * m[1][0], out0 * m[0][1] + out1 * m[1][1]
            s = d0 + d1
            down0[i], down1[i] = d0 / s, d1 / s
            a, b = down0[i] * up0[i], down1[i] * own[i] * up1[i]
            c0, c1 = up0[i], own[i] * up1[i]
            q = (out0 * m[0][0] * c0, out0 * m[0][1] * c1, out1 * m[1][0] * c0, out1 * m[1][1] * c1)
            s = sum(q) or 1.0
            pairs[i] = tuple(x / s for x in q)
        prob[i] = b / ((a + b) or 1.0)
    return prob, pairs


def fit(trees: list[Tree], steps: int = 60, rate: float = 0.3) -> Model:
    """Maximum likelihood of the labels by gradient ascent (Adagrad): seen minus expected counts under the marginals."""
    model = Model({}, ([[0.0, 0.0], [0.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]]))
    squares: dict = {}
    for _ in range(steps):
        gradient: dict = {}
        for tree in trees:
            prob, pairs = marginals(tree, model)
            for i, y in enumerate(tree.label):
                gap = (y or 0) - prob[i]
                for f in tree.features[i]:
                    gradient[f] = gradient.get(f, 0.0) + gap
                if i:
                    kind, seen = tree.text[i] is not None, 2 * (tree.label[tree.parent[i]] or 0) + (y or 0)
                    for k in range(4):
                        key = (kind, k)
                        gradient[key] = gradient.get(key, 0.0) + (k == seen) - pairs[i][k]
        edge = [[list(r) for r in kind] for kind in model.edge]
        node = dict(model.node)
        for key, g in gradient.items():
            old = edge[key[0]][key[1] // 2][key[1] % 2] if isinstance(key, tuple) else node.get(key, 0.0)
            g -= 0.02 * old
            squares[key] = squares.get(key, 1e-6) + g * g
            new = old + rate * g / math.sqrt(squares[key])
            if isinstance(key, tuple):
                edge[key[0]][key[1] // 2][key[1] % 2] = new
            else:
                node[key] = new
        model = Model(node, (edge[0], edge[1]))
    return model


#: Labelled pages are drawn from these parts; C marks content.
_CONTENT = ['<article{}>', '<main{}>', '<div class="post-content"{}>', '<div id="content"{}>', '<section class="entry-content"{}>', '<div class="article-body"{}>',
            '<div class="story text"{}>', '<article class="post"{}>', '<div role="main"{}>', '<article itemprop="articleBody"{}>']
_OTHER = ['<nav{}>', '<header{}>', '<footer{}>', '<aside{}>', '<form{}>', '<div class="ad"{}>', '<div class="advert banner"{}>', '<div class="sidebar"{}>',
          '<div id="menu"{}>', '<div class="cookie-notice"{}>', '<div class="comments"{}>', '<section id="comments"{}>', '<div class="comment-list"{}>',
          '<div class="related"{}>', '<div class="share social"{}>', '<div class="newsletter signup"{}>', '<ul class="breadcrumb"{}>', '<div class="promo sponsored"{}>',
          '<div id="footer"{}>', '<div id="header"{}>', '<div class="notice"{}>', '<div class="widget"{}>', '<div role="navigation"{}>', '<div class="ads"{}>', '<div class="popup modal"{}>',
          '<div class="login form"{}>', '<div role="complementary"{}>', '<div class="navbar"{}>', '<div class="site-header"{}>', '<div class="site-footer copyright"{}>']


def labelled_pages(n: int = 120, seed: int = 3) -> list[str]:
    """Training pages; ``data-content`` marks what is main text and what is not."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join("".join(rng.choice(("ka", "lo", "mi", "ter", "sun", "ve")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))
    close = lambda start: f"</{re.match(r'<([a-z]+)', start).group(1)}>"
    sentence = lambda a, b: words(a, b).capitalize() + "."

    def prose() -> str:
        kind = rng.random()
        if kind < 0.6:
            return f"<p>{sentence(1, 90)}</p>"
        if kind < 0.7:
            return f"<h2>{words(1, 9)}</h2>"
        if kind < 0.78:
            return "<ul>" + "".join(f"<li>{sentence(1, 14)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.84:
            return f"<blockquote><p>{sentence(5, 40)}</p></blockquote>"
        if kind < 0.9:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(2)) + "</table>"
        if kind < 0.95:
            return f"<p>{sentence(3, 20)} <a href=x>{words(1, 4)}</a> {sentence(3, 20)}</p>"
        return f"<div>{sentence(1, 60)}</div><pre>{words(3, 20)}</pre>"

    def other() -> str:
        start = rng.choice(_OTHER)
        kind = rng.random()
        if kind < 0.35:
            inside = "<ul>" + "".join(f"<li><a href=x>{words(1, 2)}</a></li>" for _ in range(rng.randint(2, 8))) + "</ul>"
        elif kind < 0.75:
            inside = sentence(3, 40)
        else:
            inside = "".join(f"<p>{sentence(3, 40)}</p>" for _ in range(rng.randint(1, 4)))
        if "footer" in start:
            inside = f"&copy; {words(1, 5)} {inside}"
        return start.format(' data-content="0"') + inside + close(start)

    out = []
    for _ in range(n):
        start = rng.choice(_CONTENT)
        body = [f"<h1>{words(1, 10)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            body.append(other() if rng.random() < 0.12 else prose())
        content = start.format(' data-content="1"') + "".join(body) + close(start)
        before, after = "".join(other() for _ in range(rng.randint(0, 4))), "".join(other() for _ in range(rng.randint(0, 4)))
        middle = before + content + after
        if rng.random() < 0.4:
            middle = f'<div class="{rng.choice(("wrapper", "container", "page", "row"))}">{middle}</div>'
        out.append(f'<html data-content="0"><head><title>{words(2, 9)}</title></head><body>{middle}</body></html>')
    return out


def train() -> Model:
    return fit([parse(p) for p in labelled_pages()])


def main_text(page: str | None, model: Model) -> tuple[str, int]:
    tree = parse(page or "")
    prob, _ = marginals(tree, model)
    blocks = [t for t, p in zip(tree.text, prob) if t is not None and p >= 0.5]
    return "\n".join(blocks), len(blocks)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of every row of ``pages`` (page_id, url, html).

    A null or empty html, or a page without content, has an empty text. Repeated rows are read each; other columns are
    ignored. The model has a fixed size and goes with the tasks.
    """
    model = model or train()
    node, edge = model.node, model.edge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(node, edge)
        for batch, texts in text_chunks(batches, "html"):
            got = [main_text(t, own) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.int64())], names=EXTRACTED.names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, EXTRACTED)
