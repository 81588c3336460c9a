"""HTML pages as Markdown, and as chunks under their headings.

A page's tree has no bounded depth and its tags need not be closed, so each page is read by a parser in one
pass, in a pandas function; what comes out are rows that Spark numbers and links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADINGS = {f"h{i}": i for i in range(1, 7)}
SILENT = {"script", "style", "template", "noscript", "head"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "aside", "nav", "address", "figure", "figcaption", "form", "fieldset", "body", "html", "dl", "dt", "dd", "details", "summary", *HEADINGS}
#: What an opening tag ends, if it is open and nothing else of its kind is opened since.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}


class Tree(HTMLParser):
    """Nested lists [tag, attributes, children]; text is str. Tags left open end where their surroundings do."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in {"ul", "ol", "table", "pre", "blockquote", "hr"}:
            self._end({"p"}, {"li", "td", "th", "blockquote", "div", "section", "article", "main", "aside", "table"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1][0] == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in {"table", "li", "td", "th"} and tag not in {"ul", "ol", "table", "tr", "body", "html"}:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)

    def _end(self, tags: set[str], within: set[str]) -> None:
        """Ends the innermost open tag of ``tags``, and for rows the outermost, not beyond one of ``within``."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in within and self.open[i][0] not in tags:
                return
            if self.open[i][0] in tags:
                del self.open[i:]
                if "tr" not in tags:
                    return


def _events(root: list) -> Iterator[tuple[str, object]]:
    """("in", node), ("text", str), ("out", node) in page order, without recursion."""
    todo: list = [("in", root)]
    while todo:
        kind, x = todo.pop()
        yield kind, x
        if kind == "in":
            todo.append(("out", x))
            todo += [("text", c) if isinstance(c, str) else ("in", c) for c in reversed(x[2]) if isinstance(c, str) or c[0] not in SILENT]


def _squeezed(text: str) -> str:
    return re.sub(r"[ \t\r\n\f\v ]+", " ", text)


def markdown(html: str | None) -> str:
    """Headings, paragraphs, nested lists, quotes, code, tables, links, pictures and emphasis; everything else is its text.

    Each open element gathers its own text; what it reads when it closes goes to the one around it, so all nesting is alike.
    """
    held: list[list[str]] = []
    lists: list[int | None] = []
    pre = cells = 0
    marks = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "kbd": "`", "del": "~~", "s": "~~"}
    row: list[list[str]] = []  # open tables' rows, as lists of cells
    for kind, x in _events(Tree(html or "").root):
        if kind == "text":
            held[-1].append(x if pre else _squeezed(x))
            continue
        tag, attrs = x[0], x[1]
        if kind == "in":
            held.append([])
            pre += tag == "pre"
            cells += tag in ("td", "th")
            if tag in ("ul", "ol"):
                start = attrs.get("start", "1")
                lists.append((int(start) if start.isdigit() else 1) if tag == "ol" else None)
            if tag == "table":
                row.append([])
            continue
        raw = "".join(held.pop())
        text = raw if pre else raw.strip()
        out = raw
        if tag in HEADINGS:
            out = f"\n\n{'#' * HEADINGS[tag]} {_line(text)}\n\n" if text else ""
        elif tag == "pre":
            pre -= 1
            lang = re.search(r"(?:language|lang|highlight)-([\w+#-]+)", " ".join(c[1].get("class", "") for c in [x, *[c for c in x[2] if not isinstance(c, str)]]))
            out = f"\n\n```{lang[1] if lang else ''}\n{raw.strip(chr(10))}\n```\n\n"
        elif tag in marks and text and not pre:
            gap = (" " if raw[:1] == " " else "", " " if raw[-1:] == " " else "")
            out = f"{gap[0]}{marks[tag]}{text}{marks[tag]}{gap[1]}"
        elif tag == "a" and not pre:
            out = f"[{text}]({attrs['href']})" if attrs.get("href") and text else raw
        elif tag == "img":
            out = f"![{attrs.get('alt', '')}]({attrs['src']})" if attrs.get("src") else attrs.get("alt", "")
        elif tag == "br":
            out = "\n"
        elif tag == "hr":
            out = "\n\n---\n\n"
        elif tag == "li":
            n = lists[-1] if lists else None
            mark = "- " if n is None else f"{n}. "
            if n is not None:
                lists[-1] = n + 1
            body = re.sub(r"\n{3,}", "\n\n", text)
            out = f"\n{mark}" + re.sub(r"\n\n(?=- |\d+\. )", "\n", body).replace("\n", "\n" + " " * len(mark))
        elif tag in ("ul", "ol"):
            lists.pop()
            out = f"\n\n{raw.strip(chr(10) + ' ')}\n\n"
        elif tag == "blockquote":
            body = re.sub(r"\n{3,}", "\n\n", text)
            out = "\n\n" + "\n".join(f"> {q}".rstrip() for q in body.split("\n")) + "\n\n"
        elif tag in ("td", "th"):
            cells -= 1
            if row:
                if not row[-1]:
                    row[-1].append([])
                row[-1][-1].append(_line(text).replace("|", "\\|"))
                out = ""
        elif tag == "tr" and row:
            row[-1].append([])
            out = f"{text} " if text else ""  # outside its cells: beside the caption
        elif tag == "table" and row:
            rows = [r for r in row.pop() if r]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
            caption = text + "\n\n" if text else ""
            out = f"\n\n{caption}" + "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) + "\n\n" if rows else raw
            out = _line(" ".join([text, *(" ".join(r) for r in rows)])) if cells else out  # a table in a cell is its text
        elif tag in BLOCKS:
            out = f"\n\n{text}\n\n"
        if held:
            held[-1].append(out)
        else:
            whole = out
    return _trimmed(whole)


def _line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _trimmed(text: str) -> str:
    """One empty line between blocks, none but in code; no white space at line ends."""
    out, code = [], False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            code = not code
        if not code:
            line = line.rstrip()
            line = line if line.lstrip(" ")[:2] in ("- ", "> ") or re.match(r" *\d+\. ", line) or line.startswith("  ") else line.lstrip(" ")
            if not line and out and not out[-1]:
                continue
        out.append(line)
    return "\n".join(out).strip("\n")


def chunks(html: str | None, size: int, overlap: int = 0, headers: tuple[str, ...] = tuple(HEADINGS), link_class: str | None = None) -> list[dict]:
    """(path, level, text, links) in page order.

    A chunk holds blocks under one heading, joined by line ends; its path names the headings above it, outermost
    first, its own last, and a heading ends those of its level and below. Where the next block would pass ``size``
    characters a new chunk begins; a block longer than that is cut, and a cut repeats ``overlap`` characters.
    ``links`` are those of the class asked for, or all. Without overlap, the chunks' texts hold every block once.
    """
    out: list[dict] = []
    path: list[tuple[int, str]] = []
    text: list[str] = []
    links: list[str] = []
    pre = 0

    def add(block: str, found: list[str], fresh: bool) -> None:
        names, level = [h for _, h in path], path[-1][0] if path else 0
        rest = block
        while rest:
            last = out[-1] if out and not fresh and out[-1]["path"] == names else None
            if last and len(last["text"]) + 1 + len(rest) <= size:
                last["text"] += "\n" + rest
                last["links"] += found
                return
            part = rest[:size]
            out.append({"path": names, "level": level, "text": part, "links": found})
            rest = rest[size - overlap :] if len(rest) > size else ""
            found, fresh = [], bool(rest)

    def flush() -> None:
        block = "".join(text) if pre else _squeezed("".join(text)).strip()
        if block.strip():
            add(block.strip("\n"), links[:], False)
        text.clear()
        links.clear()

    for kind, x in _events(Tree(html or "").root):
        if kind == "text":
            text.append(x)
            continue
        tag = x[0]
        edge = tag in BLOCKS or tag in {"li", "ul", "ol", "tr", "td", "th", "table", "pre", "blockquote", "hr", ""}
        if kind == "in" and tag == "a" and x[1].get("href") and (link_class is None or x[1].get("class") == link_class):
            links.append(x[1]["href"])
        if kind == "out" and tag in headers:
            title = _squeezed("".join(text)).strip()
            text.clear()
            if title:
                while path and path[-1][0] >= HEADINGS[tag]:
                    path.pop()
                path.append((HEADINGS[tag], title))
                add(title, links[:], True)
                links.clear()
            continue
        if edge:
            flush()
        elif tag == "br":
            text.append("\n" if pre else " ")
        pre += (tag == "pre") * (1 if kind == "in" else -1)
    return out


def to_markdown(html: Column) -> Column:
    return F.pandas_udf(lambda pages: pages.map(markdown), T.StringType())(html)


def page_chunks(pages: DataFrame, key: str, html: str, size: int = 1_000, overlap: int = 0, link_class: str | None = None) -> DataFrame:
    """(key, chunk, path, level, text, links, prev_id, next_id): chunks of every page, numbered from 0 and linked.

    Pages without text have none. ``overlap`` is less than ``size``.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap is less than the size")

    @F.pandas_udf("array<struct<path:array<string>,level:int,text:string,links:array<string>>>")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda h: chunks(h, size, overlap, link_class=link_class))

    rows = pages.select(F.col(key), cut(F.col(html)).alias("__c"))
    name = lambda i: F.format_string("%s::chunk::%04d", F.col(key).cast("string"), i)
    n, i = F.size("__c"), F.col("chunk")
    each = rows.select(key, n.alias("__n"), F.posexplode("__c").alias("chunk", "__x"))
    return each.select(key, "chunk", "__x.*", F.when(i > 0, name(i - 1)).alias("prev_id"), F.when(i + 1 < F.col("__n"), name(i + 1)).alias("next_id"))
