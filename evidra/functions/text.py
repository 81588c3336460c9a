"""Text functions that make several rows or pieces of one document: headed sections and token windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What opens a section, the mark around a code block, and a heading's own link.
HEADING = r"(#{1,6})\s+(.+?)\s*"
FENCE = "```"
_PERMALINK = re.compile(r"\s*\[¶\]\([^)]*\)\s*$")


def sections_of(text: str | None) -> list[tuple[list[str], str]]:
    """(path of headings, text) of each section with text. Headings in code blocks are text; without any section the whole text is one."""
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    cuts: list[tuple[int, int, str]] = [(-1, 0, "")]  # line, level, title
    fenced = False
    for i, line in enumerate(lines):
        if line.strip().startswith(FENCE):
            fenced = not fenced
        elif not fenced and (m := re.fullmatch(HEADING, line)):
            cuts.append((i, len(m[1]), " ".join(_PERMALINK.sub("", m[2]).split())))
    out: list[tuple[list[str], str]] = []
    path: list[str] = []
    for (at, level, title), (end, *_) in zip(cuts, [*cuts[1:], (len(lines), 0, "")]):
        if title:
            path = [*path[: level - 1], title]
        if body := "\n".join(lines[at + 1 : end]).strip():
            out.append((path, body))
    return out or [([], " ".join((text or "").split()))]


_SECTION = T.StructType([T.StructField("heading_path", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())])


@F.pandas_udf(T.ArrayType(_SECTION))
def _sections(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: [{"heading_path": p, "text": b} for p, b in sections_of(t)])


def md_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per section: key, section_index, heading_path, text. Null counts as empty: one section without text."""
    return docs.select(key, F.posexplode(_sections(text)).alias("section_index", "s")).select(key, "section_index", "s.heading_path", "s.text")


def chunk_windows(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` words that share ``overlap`` words with the one before; documents without words have none.

    Links and counts follow from the window's number and the document's length, so nothing is shuffled.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under size")
    step = size - overlap
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    base = docs.select(F.col(key), words.alias("words")).where(F.size("words") > 0).withColumn("n", F.ceil(F.size("words") / step).cast("int"))
    rows = base.select(key, "words", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_index"))
    name = lambda i: F.format_string("%s::chunk::%04d", F.col(key).cast("string"), i)
    at: Column = F.col("chunk_index")
    part = F.slice("words", at * step + 1, size)
    return rows.select(
        key, "chunk_index", name(at).alias("chunk_id"), F.when(at > 0, name(at - 1)).alias("prev_id"), F.when(at + 1 < F.col("n"), name(at + 1)).alias("next_id"),
        F.array_join(part, " ").alias("chunk_text"), F.size(part).cast("long").alias("token_count"), F.when(at > 0, overlap).otherwise(0).cast("long").alias("overlap_tokens"),
    )
