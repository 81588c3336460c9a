"""Operator 2: main text of HTML pages by a tree-structured graphical model.

The DOM's block elements and text runs are the nodes of a tree. Each node is content or not; a logistic
model of its tag, class and id words, links and text gives its own potential, and each edge has a
potential for parent and child by the child's kind. Sum-product messages pass from the leaves up and
from the root down, which gives every node's exact marginal; text runs with a marginal of at least one
half are the text. Potentials are trained from labelled pages (``labelled_pages``: pages of many layouts
whose blocks carry their label) by maximum likelihood, with the same messages giving the gradient.

Defined cases: null html is empty and has no text; unclosed or misnested tags and cut pages are read as
far as they go, and an unclosed script, style, title or textarea to the page's end; formulas and the text in
drawings are text like other; pages without tags are one block; a marginal of exactly one half counts as
content (ties); very long and very deep pages are read whole, one at a time, in time in proportion to their
length; repeated rows get equal text; an empty table gives an empty one; other columns stay, clashing ones
are replaced.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import table, with_columns

#: HTML's element kinds.
BLOCKS = set("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style template noscript title textarea iframe noembed noframes xmp".split())
TO_THE_END = {"script", "style", "title", "textarea"}  # without an end tag these run to the page's end
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "table", "dl", "select", "td", "th", "body", "html", "div", "article", "section", "main"}
#: Class, id and role words that features tell apart.
WORDS = "nav menu navbar navigation breadcrumb breadcrumbs topbar header masthead footer foot copyright sidebar side aside rail ad ads advert advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay comment comments disqus reply respond discussion form search login signup subscribe newsletter social share sharing related recommended more tags widget toolbar pagination pager skip legal disclaimer contentinfo complementary article content main post entry story body text page wrapper container column hentry prose".split()
_KNOWN = set(WORDS)
_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
EDGES = ("#", "p", "li", "ul", "div", "section", "td", "h1", "h2", "h3", "article", "main", "body", "header")
_SIZES = (1, 25, 80, 250, 1000)


class Node:
    __slots__ = ("chars", "commas", "label", "links", "parent", "tag", "text", "tokens")

    def __init__(self, tag: str, parent: int, tokens: tuple = (), label: int | None = None) -> None:
        self.tag, self.parent, self.tokens, self.label = tag, parent, tokens, label
        self.text, self.chars, self.links, self.commas = "", 0, 0, 0


class Open:
    """The open elements; the nearest of some tags is found from each tag's own stack, however deep the page nests."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["html"]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def nearest(self, tags) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        while len(self.nodes) > place:
            self.nodes.pop()
            self.places[self.tags.pop()].pop()


def dom(page: str, labelled: bool = False) -> list[Node]:
    """Block elements and text runs (tag ``#``), parents before children, in page order.

    ``labelled``: whether the page is one to train on, whose ``data-l`` are labels.
    """
    nodes = [Node("html", -1)]
    stack = Open()
    run: list[str] = []
    linked = 0
    in_link = False
    ended: set[str] = set()  # raw tags of which no end tag follows

    def close_run() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                n = Node("#", stack.nodes[-1])
                n.text, n.chars, n.links, n.commas = text, len(text), min(linked, len(text)), len(re.findall(r"[.,;:!?。、]", text))
                nodes.append(n)
            run.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            run.append(text)
            if in_link:
                linked += len(" ".join(text.split()))

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = m.end()
        if m[2] is None or not m[4] and at >= n:  # a comment, a declaration, or a tag that the page's end cuts
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            if tag == "a":
                in_link = False
            if tag in BLOCKS and (place := stack.nearest((tag,))):
                close_run()
                stack.close(place)
                in_link = False
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at) if tag not in ended else None
            if end:
                at = page.find(">", end.start()) + 1 or n
            else:
                ended.add(tag)
                at = n if tag in TO_THE_END else at
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag == "a":
            in_link = True
            continue
        if tag not in BLOCKS:
            continue
        close_run()
        in_link = False
        if stack.tags[-1] == "p":
            stack.close(len(stack.nodes) - 1)
        if tag in CLOSES and (place := stack.nearest(CLOSES[tag])) > stack.nearest(SCOPE - CLOSES[tag]):
            stack.close(place)
        if tag == "html" or tag == "hr":
            continue
        tokens, label = [], None
        for a in _ATTR.finditer(m[3]) if m[3] else ():
            name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if name == "data-l" and labelled:
                label = int(value)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                tokens.append("*hidden")
            elif name in ("class", "id", "role"):
                tokens += [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w in _KNOWN]
        nodes.append(Node(tag, stack.nodes[-1], tuple(dict.fromkeys(tokens)), label))
        stack.push(len(nodes) - 1, tag)
    close_run()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[nodes[i].parent]
        p.chars += nodes[i].chars
        p.links += nodes[i].links
        p.commas += nodes[i].commas
    return nodes


def kind_of(node: Node) -> str:
    """Of edges: by the child."""
    return node.tag if node.tag in EDGES else "block"


def clues(node: Node, nodes: list[Node]) -> list[str]:
    out = [f"tag:{node.tag}"] + [f"word:{w}" for w in node.tokens]
    parent = nodes[node.parent] if node.parent >= 0 else None
    if parent:
        out.append(f"in:{parent.tag}")
        out += [f"within:{w}" for w in parent.tokens]
        if parent.parent >= 0:
            out.append(f"under:{nodes[parent.parent].tag}")
    if node.tag != "#" and nodes[0].chars:
        out.append(f"share:{sum(node.chars >= s * nodes[0].chars for s in (0.05, 0.2, 0.5, 0.8))}")
    share = node.links / node.chars if node.chars else 0.0
    kind = "#" if node.tag == "#" else "e"
    out.append(f"{kind}links:{0 if share == 0 else 1 if share < 0.25 else 2 if share < 0.6 else 3}")
    out.append(f"{kind}size:{sum(node.chars >= s for s in _SIZES)}")
    out.append(f"{kind}marks:{min(4, int(100 * node.commas / node.chars)) if node.chars else 0}")
    return out


class Model:
    def __init__(self, weights: dict[str, float], bias: float, edges: dict[str, tuple]) -> None:
        self.weights, self.bias, self.edges = weights, bias, edges

    def marginals(self, nodes: list[Node]) -> list[float]:
        w = self.weights
        own = [self.bias + sum(w.get(c, 0.0) for c in clues(x, nodes)) for x in nodes]
        return sum_product([x.parent for x in nodes], own, [self.edges[kind_of(x)] for x in nodes])


def sum_product(parent: list[int], own: list[float], edges: list[tuple], pairs: list | None = None) -> list[float]:
    """Each node's probability of content; messages go from the leaves up, then from the root down.

    ``own``: log-odds; ``edges``: potentials (parent, child) 00, 01, 10, 11. ``pairs`` gets the edges' joint marginals.
    """
    n = len(parent)
    on = [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in own]
    off = [1 - p for p in on]  # belief from below
    up: list = [None] * n
    for i in range(n - 1, 0, -1):
        e = edges[i]
        a = off[i] * e[0] + on[i] * e[1]  # parent off
        b = off[i] * e[2] + on[i] * e[3]
        up[i] = (a, b)
        p = parent[i]
        x, y = off[p] * a, on[p] * b
        t = x + y
        off[p], on[p] = x / t, y / t
    out = [0.0] * n
    out[0] = on[0]
    for i in range(1, n):
        p = parent[i]
        e, (a, b) = edges[i], up[i]
        x = (1 - out[p]) / max(a, 1e-300)  # the parent's belief without this child
        y = out[p] / max(b, 1e-300)
        j = (off[i] * x * e[0], on[i] * x * e[1], off[i] * y * e[2], on[i] * y * e[3])
        t = sum(j)
        out[i] = (j[1] + j[3]) / t
        if pairs is not None:
            pairs.append((j[0] / t, j[1] / t, j[2] / t, j[3] / t))
    return out


def labels_of(nodes: list[Node]) -> list[int]:
    """Text runs take the nearest labelled element's label; an element is content if it holds any."""
    out = [0] * len(nodes)
    given: list = [None] * len(nodes)
    for i, x in enumerate(nodes):
        given[i] = x.label if x.label is not None else given[x.parent] if x.parent >= 0 else 0
        out[i] = int(bool(given[i])) if x.tag == "#" else 0
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i].parent] |= out[i]
    return out


def train(pages: list[str], steps: int = 120, rate: float = 0.3, ridge: float = 1e-5) -> Model:
    """Maximum likelihood of the labels under the whole tree model, by Adam on exact gradients.

    The gradient of a clue or an edge potential is its count in the labelled pages less its expected
    count under the marginals that message passing gives.
    """
    names: dict[str, int] = {}
    kinds = {k: i for i, k in enumerate((*EDGES, "block"))}
    trees, rows, ys, joint = [], [], [], []
    for page in pages:
        nodes = dom(page, labelled=True)
        y = labels_of(nodes)
        rows += [[names.setdefault(c, len(names)) for c in clues(x, nodes)] for x in nodes]
        ys += y
        trees.append(([x.parent for x in nodes], [kinds[kind_of(x)] for x in nodes]))
        joint += [2 * y[x.parent] + y[i] for i, x in enumerate(nodes) if i]
    clue = np.array([c for r in rows for c in [*r, len(names)]])  # the last one is the bias
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    y = np.array(ys, float)
    of_edge = np.array([k for _, ks in trees for k in ks[1:]])
    seen = np.zeros((len(kinds), 4))
    np.add.at(seen, (of_edge, np.array(joint)), 1)
    params = [np.zeros(len(names) + 1), np.tile(np.array([1.0, -1.0, 0.0, 0.0]), (len(kinds), 1))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        own = np.bincount(row, params[0][clue], len(rows)).tolist()
        pots = [tuple(r) for r in np.exp(params[1]).tolist()]
        at, p, pairs = 0, [], []
        for parent, ks in trees:
            p += sum_product(parent, own[at : at + len(parent)], [pots[k] for k in ks], pairs)
            at += len(parent)
        expected = np.zeros_like(seen)
        np.add.at(expected, of_edge, np.array(pairs))
        grads = [np.bincount(clue, (np.array(p) - y)[row], len(names) + 1) / len(y) + ridge * params[0], (expected - seen) / len(y) + ridge * params[1]]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    pots = np.exp(params[1])
    return Model({c: float(params[0][i]) for c, i in names.items()}, float(params[0][-1]), {k: tuple(pots[i].tolist()) for k, i in kinds.items()})


def labelled_pages(n: int = 200, seed: int = 7) -> list[str]:
    """Pages of many layouts with invented words; blocks carry ``data-l``, 1 for the article and 0 for the rest."""
    rng = random.Random(seed)
    syllables = "an ba co de el fi gor ha in ju ka lo mi no or pa qu ri sa ten ur vi wo xe yo zu ich heit ción que the ing".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    noisy = lambda: rng.choice(["", "", "", "", " -", " /", "..."])

    def words(a: int, b: int) -> str:
        tail = noisy()
        return " ".join(word() + (rng.choice([",", ".", "", "", ""])) + tail for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", ".", ".", ""])

    def attr(*names: str) -> str:
        if rng.random() < 0.2:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'

    links = lambda a, b: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randint(a, b)))
    link_div = lambda: " | ".join(f'<a href="#">{word()} {word()}</a>' for _ in range(rng.randint(2, 8)))

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.62:
            return f"<p>{words(1, 120)}{rng.choice(['</p>', '</p>', ''])}"
        if kind < 0.7:
            return f'<p>{words(5, 50)} <a href="/{word()}">{words(1, 4)}</a> {words(5, 40)}</p>'
        if kind < 0.76:
            return f"<h2>{words(1, 8)}</h2>"
        if kind < 0.81:
            return "<ul>" + "".join(f"<li>{words(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.85:
            return f"<blockquote><p>{words(5, 50)}</p></blockquote>"
        if kind < 0.89:
            return f"<p><b>{words(2, 10)}<br><p>{words(1, 80)}</p>"
        if kind < 0.92:
            return f"<pre>{words(5, 30)}</pre>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{words(1, 5)}</td><td>{words(1, 9)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.97:
            return f'<figure><img src="/{word()}.png"><figcaption>{words(2, 25)}</figcaption></figure>'
        if kind < 0.98:
            return f"<p>{words(3, 20)} <math><mi>{word()}</mi><mo>=</mo><mn>{rng.randint(2, 99)}</mn></math> {words(2, 30)}</p>"
        return f"<div>{words(5, 60)}</div>"

    def junk(inside: bool = False) -> str:
        n, m = lambda t: f' data-l="0"{t}', rng.random()
        pick = [
            lambda: f"<div{n(attr('ad', 'ads', 'advert', 'ad-box', 'sponsored', 'advertisement', 'promo'))}>{words(3, 40)}</div>",
            lambda: f"<aside{n(attr('sidebar', 'related', 'side', ''))}><h3>{words(1, 4)}</h3>{rng.choice([f'<ul>{links(2, 6)}</ul>', f'<p>{words(4, 40)}</p>'])}</aside>",
            lambda: f"<div{n(attr('share', 'social', 'share-buttons', 'sharing'))}>{link_div()}</div>",
            lambda: f"<form{n(attr('newsletter', 'search', 'subscribe', 'login', 'form'))}><label>{words(1, 6)}</label><input name=q><p>{words(2, 15)}</p><button>{word()}</button></form>",
            lambda: f"<div{n(attr('related', 'recommended', 'more', 'related-posts'))}><h3>{words(1, 4)}</h3><ul>{links(2, 6)}</ul></div>",
            lambda: f"<{rng.choice(['div', 'section'])}{n(rng.choice([' class=\"comments\"', ' id=\"comments\"', ' class=\"comment-list\"', ' class=\"discussion\"', ' id=\"respond\"']))}><h3>{words(1, 3)}</h3>" + "".join(f"<div class=\"comment\"><p>{words(3, 40)}</p></div>" for _ in range(rng.randint(1, 4))),
            lambda: f"<div{n(rng.choice([' class=\"cookie\"', ' id=\"cookie-notice\"', ' class=\"notice\"', ' class=\"consent banner\"', ' role=\"alert\"', ' class=\"alert\"', ' class=\"gdpr\"']))}><p>{words(5, 35)}</p><button>{word()}</button></div>",
            lambda: f"<div{n(' style=\"display:none\"')}>{words(2, 20)}</div>",
        ]
        f = pick[int(m * (6 if inside else len(pick)))]
        out = f()
        return out + ("</div>" if "omment" in out[:40] and out.startswith("<div") else "</section>" if out.startswith("<section") else "") if "<h3>" in out and not out.endswith(("</aside>", "</ul></div>")) else out

    pages = []
    for _ in range(n):
        body = f'<h1>{words(2, 10)}</h1>' if rng.random() < 0.9 else ""
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20, 30])):
            body += paragraph()
            if rng.random() < 0.05:
                body += junk(inside=True)
        if rng.random() < 0.15:
            body = f"<header><h1>{words(2, 9)}</h1></header>{body}"
        shape = rng.random()
        if shape < 0.45:
            main = f'<article data-l="1"{attr("post", "entry", "article", "hentry", "")}>{body}</article>'
        elif shape < 0.6:
            main = f'<main data-l="1">{body}</main>'
        elif shape < 0.7:
            main = f'<main><article data-l="1">{body}</article></main>'
        elif shape < 0.9:
            main = f'<div data-l="1" {rng.choice(["class", "id"])}="{rng.choice(["content", "main", "post-content", "entry-content", "article-body", "story", "main-content", "post", "text", "page-content"])}">{body}</div>'
        else:
            main = f'<section data-l="1"{attr("content", "article", "story", "")}>{body}</section>'
        top = rng.choice([f'<nav data-l="0"><ul>{links(3, 9)}</ul></nav>', f'<div data-l="0"{attr("menu", "nav", "navbar", "topbar", "breadcrumb")}>{link_div()}</div>', f'<header data-l="0"{attr("masthead", "header", "")}><h2>{words(1, 4)}</h2><p>{words(1, 8)}</p><nav><ul>{links(2, 6)}</ul></nav></header>', f'<ul data-l="0"{attr("menu", "nav", "navigation")}>{links(3, 9)}</ul>', f'<div data-l="0" class="header"><p>{words(1, 10)}</p></div>'])
        foot = rng.choice([f'<footer data-l="0">&copy; {words(1, 25)}</footer>', f'<footer data-l="0"><p>{words(2, 30)}</p><ul>{links(2, 5)}</ul></footer>', f'<div data-l="0" class="{rng.choice(["footer", "copyright", "legal", "disclaimer"])}">{words(2, 30)}</div>', ""])
        parts = [top] + [junk() for _ in range(rng.randint(0, 2))] + [main] + [junk() for _ in range(rng.randint(0, 3))] + [foot]
        inner = "".join(parts)
        if rng.random() < 0.4:
            inner = f'<div class="{rng.choice(["wrapper", "container", "page"])}">{inner}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><script>var a='<p>';</script></head><body>{inner}</body></html>")
    return pages


@lru_cache(maxsize=1)
def model() -> Model:
    return train(labelled_pages())


def main_text(page: str | None, m: Model) -> str:
    if not page:
        return ""
    nodes = dom(page)
    p = m.marginals(nodes)
    return "\n\n".join(x.text for x, q in zip(nodes, p, strict=True) if x.tag == "#" and q >= 0.5)


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of ``html`` as ``out``. The model is trained on the driver, from the labelled pages alone."""
    m = model()

    def run(batches: Iterator[list]) -> Iterator[list[list]]:
        for pages in batches:
            yield [[main_text(x, m) for x in pages]]

    return with_columns(df, html, [T.StructField(out, T.StringType())], run, as_bytes=False)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    got = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
