"""Turn packing: the messages of a ticket, in order, into chunks under a budget of tokens and turns.

Each chunk repeats the end of the one before as context, so the order matters and no window function
gives it. Rows are dealt by ticket and sorted there; a task reads them as a stream and holds one chunk,
so a ticket of any length takes bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["chunk_index", "chunk_type", "chunk_text", "first_turn", "last_turn", "speakers", "n_tokens", "has_overlap", "prev_index", "next_index"]
SCHEMA = "chunk_index long, chunk_type string, chunk_text string, first_turn string, last_turn string, speakers array<string>, n_tokens long, has_overlap boolean, prev_index long, next_index long"
_ARROW = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]


def words(text: str) -> int:
    return len(text.split())


@dataclass(frozen=True)
class Budget:
    size: int = 800
    overlap: int = 80
    most_turns: int | None = 3
    count: Callable[[str], int] = words
    context: bool = True


@dataclass
class _Open:
    """The chunk that still takes messages."""

    prefix: str
    body: str = ""
    last: str = ""  # the text of the last message
    turns: list[str] = field(default_factory=list)
    speakers: list[str] = field(default_factory=list)
    follows: bool = False


def _parts(turn: str, role: str, text: str, prefix: str, b: Budget) -> list[tuple[str, str]]:
    """(block, its text): the message, or paragraphs of it joined as far as they fit."""
    text = text.strip()
    whole = f"<MESSAGE id={turn} role={role}>\n{text}\n</MESSAGE>"
    if not text or b.count(prefix + whole) <= b.size:
        return [(whole, text)]
    room = b.size - b.count(prefix + f"<MESSAGE id={turn}zz role={role} part=100/100 original_id={turn}>\n\n</MESSAGE>")
    if room <= 0:
        raise ValueError("the budget holds no message after prefix and header")
    texts: list[str] = []
    for p in filter(None, map(str.strip, text.split("\n\n"))):
        if texts and b.count(joined := f"{texts[-1]}\n\n{p}") <= room:
            texts[-1] = joined
        else:
            texts.append(p)
    n = len(texts)
    if n == 1:
        return [(whole, text)]
    return [(f"<MESSAGE id={turn}{_letters(i)} role={role} part={i + 1}/{n} original_id={turn}>\n{t}\n</MESSAGE>", t) for i, t in enumerate(texts)]


def _letters(i: int) -> str:
    """a to z, then aa, ab and so on."""
    out = chr(97 + i % 26)
    return _letters(i // 26 - 1) + out if i >= 26 else out


def fold(messages: Iterator[tuple[str, str, str]], b: Budget, summary: str | None = None) -> Iterator[list]:
    """Chunks of one ticket, whose first message is its description. A message that fits no chunk stands alone."""
    head = f"[TICKET_SUMMARY] {summary}\n\n" if summary is not None else ""
    _, _, first = next(messages)
    text = f"{head}[INITIAL_DESCRIPTION]\n{(first or '').strip()}"
    held = [0, "initial", text, None, None, ["TICKET_CREATOR"], b.count(text), False, None, None]
    plain = head + "[CONVERSATION]\n"

    def fresh(before: _Open | None) -> _Open:
        if before is None or not (b.context and b.overlap):
            return _Open(plain, follows=False)
        tail = " ".join(before.last.split()[-b.overlap :])
        return _Open(f"{head}[CONTEXT]\n{tail}\n\n[CONVERSATION]\n", follows=True)

    def closed(o: _Open) -> list:
        text = o.prefix + o.body
        return [held[0] + 1, "conversation", text, o.turns[0], o.turns[-1], o.speakers, b.count(text), o.follows, held[0], None]

    now = fresh(None)
    for turn, role, said in messages:
        for block, inner in _parts(turn, role, said or "", plain, b):
            many = b.most_turns is not None and turn not in now.turns and len(now.turns) >= b.most_turns
            if now.body and (many or b.count(now.prefix + now.body + block) > b.size):
                done = closed(now)
                held[9] = done[0]
                yield held
                held, now = done, fresh(now)
            now.body += block
            now.last = inner
            if now.turns[-1:] != [turn]:
                now.turns.append(turn)
            now.speakers.append(role)
    if now.body:
        done = closed(now)
        held[9] = done[0]
        yield held
        held = done
    yield held


def pack_turns(df: DataFrame, key: str, order: str, role: str, text: str, budget: Budget = Budget(), summary: str | None = None) -> DataFrame:
    """A row per chunk: the key and ``COLUMNS``. Rows of one turn keep the order of role and text; null texts are empty messages."""
    cols = [F.col(key).alias("k"), F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t"), (F.col(summary) if summary else F.lit(None).cast("string")).alias("s")]
    src = df.select(*cols).repartition("k").sortWithinPartitions("k", "o", "r", "t")
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []  # the key column's type, from the first batch

        def rows() -> Iterator[tuple]:
            for b in batches:
                kept[:] = [b.schema.field("k").type]
                yield from zip(*(b.column(c).to_pylist() for c in ("k", "o", "r", "t", "s")))

        out: list[list] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out), [kept[0], *_ARROW])]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["k", *COLUMNS])

        for k, own in groupby(rows(), key=lambda r: r[0]):
            one = next(own)
            for chunk in fold(((str(o), str(r), t) for _, o, r, t, _ in chain([one], own)), budget, one[4]):
                out.append([k, *chunk])
                if len(out) >= 256:
                    yield batch()
        if out:
            yield batch()

    return src.mapInArrow(run, f"k {kind}, {SCHEMA}").withColumnRenamed("k", key)
