"""Operator 8: best-fit decreasing packing of tokenised documents.

Each document becomes its ids and one end id. Full windows are cut off its start and stand alone as
sequences; the rest, shorter than a window, is packed by falling length into the open window with the
least room that holds it, which a segment tree over remaining capacities finds. Packing runs within
buckets of some thousand documents, dealt by a hash of document and text, so memory is bounded and a
task that runs again gives the same rows; a bucket leaves a few sequences partly filled.

Ids are those of the tokenizer file, also for special tokens' strings in a text. Words between single
spaces are looked up in a bounded cache of their ids, as no token crosses such a space.

Defined cases: null text is empty, and an empty document is the end id alone; repeated rows are packed
as often as they occur; rows of a null key are packed like others; of pieces of equal length the smaller
key goes first; very long texts are encoded whole, one at a time; an empty table gives an empty result;
other columns aren't read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import table

WINDOW, END_ID, BUCKET_DOCS = 1024, 0, 4096
BUCKET_DOCS_IDS = 1024  # where the ids travel with the pieces, a task holds a bucket's ids several times over
SLICE = 256  # documents whose ids a task holds at once
WORDS, WORDS_ALONE = 150_000, 400_000  # cached words of a generation, where the ids travel and where they don't
_UNSURE = re.compile(r"\s \S|\S \s|\s\s")


class Ids(dict):
    """Word after a space to its packed ids; two generations of at most ``most`` words bound it."""

    def __init__(self, encode, most: int = WORDS) -> None:
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes to id of a byte-level BPE file whose ids rise in the order of its merges, and special tokens to theirs.

    Such files write each byte as a printable character: itself where it prints, else one of those from 256 on.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}, special


@lru_cache(maxsize=2)
def encoder(name: str, words: int = WORDS):
    """text to packed little-endian 32-bit ids; a special token's string in a text is that token, as for the library."""
    import public_tokenizers as P
    import tiktoken

    ranks, special = vocabulary(P.path(name))
    enc = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    ids = Ids(enc, words)
    parted = re.compile("|".join(f"({re.escape(t)})" for t in sorted(special, key=len, reverse=True)) or "(?!)")
    packed = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}

    def plain(text: str) -> bytes:
        if len(text) < 2 or _UNSURE.search(text):
            out, at = [], 0
            for m in re.finditer(r"(?<=\S)(?= \S)", text):  # no token spans these places
                out.append(text[at : m.start()])
                at = m.start()
            out.append(text[at:])
            return b"".join([ids[p[1:]] if p[:1] == " " and len(p) < 40 else np.array(enc(p), "<u4").tobytes() for p in out])
        first, *rest = text.split(" ")
        return np.array(enc(first), "<u4").tobytes() + b"".join(map(ids.__getitem__, rest))

    def encode(text: str) -> bytes:
        out, at = [], 0
        for m in parted.finditer(text):
            out += [plain(text[at : m.start()]), packed[m[0]]]
            at = m.end()
        return plain(text) if not out else b"".join([*out, plain(text[at:])])

    return encode


class Rooms:
    """Open windows by remaining capacity: a segment tree finds the tightest that holds a length."""

    def __init__(self, window: int) -> None:
        self.half = 1 << window.bit_length()
        self.count = [0] * (2 * self.half)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.half
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.open[room].append(window)
            self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the least room of at least ``length``."""
        i = length + self.half
        while not self.count[i]:
            while i & 1:  # a right child: go up
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            if i == 1:
                return None
        while i < self.half:
            i = 2 * i + (not self.count[2 * i])
        room = i - self.half
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length; at most ``window`` each."""
    out: list = [None] * len(lengths)
    rooms, n = Rooms(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if got := rooms.take(lengths[i]):
            room, seq = got
        else:
            room, seq, n = window, n, n + 1
        out[i] = (seq, window - room)
        rooms.put(room - lengths[i], seq)
    return out


def _narrow(ids: bytes) -> bytes:
    """32-bit ids as 16-bit ones where all are small enough."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else ids


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k.json", bucket_docs: int | None = None, keep_ids: bool = True) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    buckets = max(1, -(-df.count() // (bucket_docs or (BUCKET_DOCS_IDS if keep_ids else BUCKET_DOCS))))
    src = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("bucket", F.pmod(F.xxhash64("key", "text"), F.lit(buckets)).cast("long"))
    kind = src.schema["key"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, WORDS if keep_ids else WORDS_ALONE), np.array([end_id], "<u4").tobytes()
        for b in (whole.slice(s, SLICE) for whole in batches for s in range(0, len(whole), SLICE)):
            rows: list[tuple] = []
            at: list[int] = []
            for i, t in enumerate(b.column("text")):
                data = encode(t.as_py()) + end
                n = len(data) // 4
                for s in range(0, n, window):
                    part = data[4 * s : 4 * (s + window)]
                    rows.append((s, len(part) // 4, zlib.crc32(part), n, _narrow(part) if keep_ids else None))
                    at.append(i)
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            take = pa.array(at, pa.int64())
            names = ["key", "bucket", "start", "length", "ids_crc32", "doc_tokens", "packed"]
            cols = [b.column("key").take(take), b.column("bucket").take(take), *cols]
            out = pa.RecordBatch.from_arrays(cols, names=names)
            step = 50_000 if not keep_ids else 2000
            for s in range(0, len(out), step):
                yield out.slice(s, step)

    cut = src.mapInArrow(pieces, f"key {kind}, bucket long, start long, length long, ids_crc32 long, doc_tokens long, packed binary")
    cut = cut if keep_ids else cut.drop("packed")
    fields = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        place = best_fit_decreasing(pdf["length"].tolist(), window)
        base = int(pdf["bucket"].iloc[0]) << 32
        out = pdf.assign(sequence_id=[base + s for s, _ in place], offset=[o for _, o in place])
        if keep_ids:
            out["ids"] = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("<i4") for x, n in zip(out.pop("packed"), out["length"])]
        return out.drop(columns="bucket")

    return cut.groupBy("bucket").applyInPandas(pack, fields).withColumnRenamed("key", key)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
