"""Operator 6: SentencePiece encoding and decoding by a streaming Viterbi search.

Text is read character by character. The search keeps, since the last commit, the best score and the
backpointer of each boundary; only boundaries within one maximum piece length of the newest can still be
extended, so as soon as their backpointer paths all pass one boundary, the ids before it are final and
are given out. The window is what no such boundary has yet closed: a few piece lengths in prose. In a run of
one character paths of different phase never meet, so such a run is held whole, at a number and a character
for each of its places; whether paths meet is looked up each time the window has doubled, so the whole search
takes time in proportion to the text.

Pieces and scores come from a model file; the search maximises the sum of scores, as the library does for
unigram models. For a file of BPE type, merge order and best sum can differ: the ids are those of the
library's unigram mode over the same pieces, and decode to the same text. Where no piece of the file spans a word
boundary, every path passes each of them: the search commits there, and as it then starts anew, a bounded
cache keeps what it gave for a word.

Defined cases: null text counts as empty and has no ids; characters without a piece become byte pieces,
or the unknown id where the file has none; U+2581 in a text decodes to a space; repeated rows get equal
ids; an empty table gives an empty one; other columns stay, clashing ones are replaced.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import table, with_columns

SPACE = "▁"
NONE = float("-inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message, one level deep."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[i : i + n]
            i += n


def trie_of(score: dict[str, float]) -> dict:
    """Character to (score of the piece that ends there or None, the characters after it)."""
    root: dict = {}
    for piece, s in score.items():
        node = root
        for c in piece[:-1]:
            node = node.setdefault(c, (None, {}))[1]
        node[piece[-1]] = (s, node[piece[-1]][1] if piece[-1] in node else {})
    return root


class Model:
    def __init__(self, data: bytes) -> None:
        self.text: list[str] = []
        self.kind: list[int] = []
        score: list[float] = []
        prefix, squeeze, charsmap = True, True, b""
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.text.append(piece.get(1, b"").decode())
                score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kind.append(piece.get(3, NORMAL))
            elif number == 3:
                spec = dict(fields(value))
                prefix, squeeze, charsmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if charsmap:
            raise ValueError("models with a character map aren't supported")
        self.prefix, self.squeeze = prefix, squeeze
        self.score = {t: s for t, s, k in zip(self.text, score, self.kind) if k in (NORMAL, USER)}
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k in (NORMAL, USER)}
        self.longest = max(map(len, self.score))
        self.trie = trie_of(self.score)
        self.unknown = next(i for i, k in enumerate(self.kind) if k == UNKNOWN)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.worst = min(s for s, k in zip(score, self.kind) if k == NORMAL) - 10
        #: what each id decodes to
        self.spelt = [bytes([self.byte_of[i]]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else t.replace(SPACE, " ").encode() for i, (t, k) in enumerate(zip(self.text, self.kind))]
        self.by_words = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.score)

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Stream:
    """Feed characters, get ids; ``window`` is the most characters it ever held."""

    EVERY = 32

    def __init__(self, model: Model) -> None:
        self.m = model
        self.text = ""  # since the last commit
        self.best: list[float] = [0.0]  # of each boundary; NONE where no path ends
        self.back: list[int] = [0]
        self.done = 0  # starts whose pieces are entered
        self.window = 0
        self.look = 0  # the window at which to look for a common boundary again

    def feed(self, text: str, last: bool = False) -> list[int]:
        out: list[int] = []
        m, at = self.m, 0
        while True:
            step = max(self.EVERY, len(self.text) // 4)
            self.text += text[at : at + step]
            at += step
            ends = last and at >= len(text)
            n = len(self.text)
            self.window = max(self.window, n)
            self.best += [NONE] * (n + 1 - len(self.best))
            self.back += [0] * (n + 1 - len(self.back))
            self._enter(n if ends else n - m.longest + 1)
            if ends:
                out += self._commit(n)
            elif self.done > 0 and n >= self.look:
                if to := self._agreed():
                    out += self._commit(to)
                    self.look = 0
                else:
                    self.look = 2 * n
            if at >= len(text):
                return out

    def _enter(self, end: int) -> None:
        text, best, back, worst = self.text, self.best, self.back, self.m.worst
        for i in range(self.done, end):
            base, node = best[i], self.m.trie
            j = i
            for c in text[i : i + self.m.longest]:
                got = node.get(c)
                if got is None:
                    break
                s, node = got
                j += 1
                if s is not None and s + base > best[j]:
                    best[j], back[j] = s + base, i
            if text[i] not in self.m.score and base + worst > best[i + 1]:
                best[i + 1], back[i + 1] = base + worst, i
        self.done = max(self.done, end)

    def _agreed(self) -> int:
        """The last boundary that all paths still open pass."""
        # piece starts that are not entered yet lie at ``done`` or later, so every path passes some boundary of the last piece length
        open_ = [-j for j in range(self.done, len(self.best)) if self.best[j] > NONE]
        heapify(open_)
        while len(open_) > 1:
            top = -heappop(open_)
            if -open_[0] != top:
                heappush(open_, -self.back[top])
        return -open_[0] if open_ else 0

    def _commit(self, to: int) -> list[int]:
        if to <= 0:
            return []
        cuts, j = [], to
        while j > 0:
            cuts.append(j)
            j = self.back[j]
        out, at = [], 0
        for j in reversed(cuts):
            out += self.m.ids_of(self.text[at:j])
            at = j
        self.text = self.text[to:]
        self.best = self.best[to:]
        self.back = [max(0, b - to) for b in self.back[to:]]
        self.done -= to
        base = self.best[0]
        self.best = [b - base for b in self.best]
        return out


class Words(dict):
    def __init__(self, model: Model, most: int = 300_000) -> None:
        super().__init__()
        self.model, self.most, self.old = model, most, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = packed(Stream(self.model).feed(word, last=True))
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = got
        return got


@lru_cache(maxsize=2)
def loaded(path: str) -> tuple[Model, Words]:
    with open(path, "rb") as f:
        m = Model(f.read())
    return m, Words(m)


def encode(path: str, text: str) -> bytes:
    """Packed little-endian 32-bit ids of a whole text."""
    m, words = loaded(path)
    text = m.normal(text)
    if not m.by_words:
        s = Stream(m)
        out = [s.feed(text[a : a + 4096]) for a in range(0, len(text), 4096)]
        return packed([i for x in [*out, s.feed("", last=True)] for i in x])
    if SPACE * 2 in text or text[-1:] == SPACE:
        return b"".join([words[w] for w in re.findall(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", text)])
    first, *rest = text.split(SPACE)
    return (words[first] if first else b"") + b"".join([words[w] for w in map(SPACE.__add__, rest)])


def decode(path: str, ids: bytes) -> str:
    return loaded(path)[0].decode(np.frombuffer(ids, "<u4").tolist())


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers as P

    return P.path(name)


def encode_pieces(df: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) to any table."""
    path = model or model_path()

    def run(batches: Iterator[list]) -> Iterator[list[list]]:
        for texts in batches:
            yield [[np.frombuffer(encode(path, t), "<u4").tolist() if t else [] for t in texts]]

    return with_columns(df, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], run, as_bytes=False)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: number and CRC-32 of its ids, and of the text decoded from them."""
    path = model_path()

    def run(batches: Iterator[list]) -> Iterator[list[list]]:
        for texts in batches:
            ids = [encode(path, t) if t else b"" for t in texts]
            back = [decode(path, i) for i in ids]
            yield [[len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], [zlib.crc32(b.encode()) for b in back], [b == (t or "") for b, t in zip(back, texts)]]

    new = [T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return with_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", new, run, as_bytes=False).select("doc_id", *[f.name for f in new])
