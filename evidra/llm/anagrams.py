"""Operator 12: grouping of spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, the same for all orders of its
letters. Two words that differ by one added letter have keys apart by that letter's power; two that differ by
an exchanged letter have keys that meet when each gives up one letter's power. So every word is sent to its
own key and to its key less the power of each of its distinct letters; words that meet at a key are
candidates, and the order of the letters that are left decides: the same letters in the same order with the
same place left open are an exchange, and the letters left of one word that are another word are an addition.
Places are looked up in a table, so a key's words are never paired with each other. A key that more than
``CROWD`` words share (the orders of few letters can be very many) is divided by the order of the letters
left, each order being open to one letter at one of its places only.

Keys wrap around 64 bits and may meet by chance: the check of the order makes that harmless.

Defined cases: null text has no words; a null id is written as nothing before the colon; repeated rows count
as often as they occur; of equally frequent forms the smallest in code-point order is taken (ties); very long
texts and words are read whole, long words' orders are compared by hash and then letter by letter; an empty
table gives an empty one; only id and text are read, so no other column clashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import table, written

#: A form occurs so many times as often as its variant; words are of this many letters and occurrences at least.
TIMES, LETTERS, OCCURRENCES = 10, 7, 2
#: Words at a key beyond which it is divided; letters beyond which orders are compared by hash.
CROWD, LONG = 2_000, 64

_U = np.uint64
_POWERS = np.arange(0x250, dtype=_U) ** _U(5)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n): the runs of letters of all texts after the deletions that the checksums ask for."""
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.explode(F.expr(f"regexp_extract_all(`{text}`, '[A-Za-z\\\\u00C0-\\\\u00FF]{{{LETTERS},}}', 0)")).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run")).select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("cast(h % char_length(run) as int)")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OCCURRENCES)


def letters_of(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-16-le"), np.uint16)


def open_orders(word: str, letter: str) -> list[tuple[object, int]]:
    """(order of the letters left, place) for each place of ``letter``: the letters themselves, of long words a hash of them."""
    if len(word) <= LONG:
        out, i = [], word.find(letter)
        while i >= 0:
            out.append((word[:i] + word[i + 1 :], i))
            i = word.find(letter, i + 1)
        return out
    codes = letters_of(word)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[_U(1)], np.full(len(codes) - 1, _U(_BASE))]))
        sums = np.concatenate([[_U(0)], np.cumsum(codes.astype(_U) * power)])
        at = np.flatnonzero(codes == ord(letter))
        left = sums[at] + (sums[-1] - sums[at + 1]) * _U(pow(_BASE, -1, 1 << 64))
    return [(-1 - x, i) for x, i in zip(left.tolist(), at.tolist())]


def own_order(word: str) -> object:
    """What ``open_orders`` gives where the letters left are this word."""
    if len(word) < LONG:
        return word
    codes = letters_of(word).tolist()
    h = 0
    for c in reversed(codes):
        h = (h * _BASE + c) & _MASK
    return -1 - h


def _salt(order: object) -> int:
    """Of an order of letters, for dividing a key; 0 stands for a key that isn't divided."""
    return (xxhash.xxh3_64_intdigest(order) if isinstance(order, str) else xxhash.xxh3_64_intdigest(str(order))) >> 2 | 1


def near_in_group(rows: list[tuple[int, str, int, str | None]]) -> dict[tuple[str, int], list]:
    """Of rows (salt, word, n, letter given up or None) at one key: {(word, n): [near words here, (-n, word) of the best]}."""
    out: dict[tuple[str, int], list] = {}

    def add(a: tuple[str, int], k: int, best: tuple[int, str]) -> None:
        held = out.setdefault(a, [0, best])
        held[0] += k
        held[1] = min(held[1], best)

    whole = {own_order(w): (w, n) for _, w, n, letter in rows if letter is None}
    places: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
    for salt, w, n, letter in rows:
        if letter is None:
            continue
        met = set()
        for order, i in open_orders(w, letter):
            if salt and _salt(order) != salt:
                continue
            places[order, i].append((w, n))
            if order in whole and order not in met:
                met.add(order)
                v, m = whole[order]
                if w[:i] + w[i + 1 :] == v:
                    add((w, n), 1, (-m, v))
                    add((v, m), 1, (-n, w))
    for (_, i), words in places.items():
        if len(words) < 2:
            continue
        same: dict[tuple[str, str], list[tuple[str, int]]] = defaultdict(list)  # one alone, but for long words of equal hash
        for w in words:
            same[w[0][:i], w[0][i + 1 :]].append(w)
        for group in same.values():
            if len(group) > 1:
                first, second = sorted((-n, w) for w, n in group)[:2]
                for w, n in group:
                    add((w, n), len(group) - 1, second if (-n, w) == first else first)
    return out


_SENT = "key long, word string, n long, letter string"
_SENT_ARROW = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("letter", pa.string())])


def sent(words: DataFrame) -> DataFrame:
    """(word, n) to (key, word, n, letter): a word at its key, and at its key less each letter's power."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2_000):
                b = whole.slice(s, 2_000)
                keys, at, letters = [], [], []
                for r, w in enumerate(b.column("word").to_pylist()):
                    codes = letters_of(w)
                    with np.errstate(over="ignore"):
                        key = int(_POWERS[codes].sum(dtype=_U))
                    own = sorted(set(w))
                    keys.append(key)
                    keys += [(key - ord(c) ** 5) & _MASK for c in own]
                    at += [r] * (len(own) + 1)
                    letters += [None, *own]
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, _U).astype(np.int64)), b.column("word").take(at), b.column("n").take(at), pa.array(letters, pa.string())], schema=_SENT_ARROW)

    return words.mapInArrow(run, _SENT)


def _divided(rows: DataFrame) -> DataFrame:
    """Rows of crowded keys with the salts of their orders, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, w, n, letter in zip(*(b.column(c).to_pylist() for c in ("key", "word", "n", "letter")), strict=True):
                salts = sorted({_salt(o) for o, _ in open_orders(w, letter)} if letter else {_salt(own_order(w))})
                for s in range(0, len(salts), 1_000):
                    part = salts[s : s + 1_000]
                    k = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * k, pa.int64()), pa.array([w] * k), pa.array([n] * k, pa.int64()), pa.array([letter] * k, pa.string()), pa.array(part, pa.int64())], names=["key", "word", "n", "letter", "salt"])

    return rows.mapInArrow(run, _SENT + ", salt long")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, k, best): parts of how many words are near each word of (word, n), and (-n, word) of the best of a part."""
    rows = written(sent(words), "anagrams")
    crowded = rows.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > crowd).select("key", F.lit(True).alias("crowded"))
    marked = rows.join(crowded, "key", "left")
    apart = _divided(marked.where("crowded").select("key", "word", "n", "letter"))
    plain = marked.where("crowded is null").select("key", "word", "n", "letter", F.lit(0).cast("long").alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[tuple]]:
            held, last = [], None
            for b in batches:
                if not b.num_rows:
                    continue
                key, salt = b.column("key").to_numpy(), b.column("salt").to_numpy()
                cuts = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
                bounds = [0, *cuts.tolist(), len(key)]
                cols = [b.column(c) for c in ("salt", "word", "n", "letter")]
                if held and last != (key[0], salt[0]):
                    yield held
                    held = []
                for i, (s, e) in enumerate(zip(bounds, bounds[1:])):
                    if not (e - s == 1 and not (held and i == 0) and e < len(key)):  # a key with one word has no pair
                        held += zip(*(c.slice(s, e - s).to_pylist() for c in cols))
                    if e < len(key):
                        if held:
                            yield held
                        held = []
                last = (key[-1], salt[-1])
            if held:
                yield held

        out: list[tuple] = []
        for group in groups():
            if len(group) > 1:
                out += [(w, k, neg, best) for (w, _), (k, (neg, best)) in near_in_group(group).items()]
            if len(out) > 10_000:
                yield _near_batch(out)
                out = []
        if out:
            yield _near_batch(out)

    met = plain.unionByName(apart).repartition("key", "salt").sortWithinPartitions("key", "salt")
    return met.select("key", "salt", "word", "n", "letter").mapInArrow(run, "word string, k long, best struct<neg:bigint,word:string>")


def _near_batch(rows: list[tuple]) -> pa.RecordBatch:
    w, k, neg, best = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(w), pa.array(k, pa.int64()), pa.StructArray.from_arrays([pa.array(neg, pa.int64()), pa.array(best)], ["neg", "word"])], names=["word", "k", "best"])


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root); a form occurs ten times as often as its word, so there are few rounds."""
    links = written(forms.select("word", "form"), "forms")
    step = links.select(F.col("word").alias("root"), F.col("form").alias("next"))
    roots = links.select("word", F.col("form").alias("root"))
    while True:
        moved = roots.join(step, "root", "left")
        if moved.where("next is not null").isEmpty():
            return roots
        roots = written(moved.select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, n) to (word, form, root, n, n_near, form_n)."""
    near = near_words(words, crowd).withColumn("n", F.lit(0).cast("long"))
    none = F.lit(None).cast("struct<neg:bigint,word:string>")
    both = words.select("word", F.lit(0).cast("long").alias("k"), none.alias("best"), "n").unionByName(near)
    each = both.groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("n_near"), F.min("best").alias("best"))
    often = -F.col("best.neg") >= TIMES * F.col("n")
    each = written(each.select("word", F.when(often, F.col("best.word")).alias("form"), "n", "n_near", F.when(often, -F.col("best.neg")).alias("form_n")), "variants")
    roots = with_roots(each.where("form is not null"))
    return each.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, the more frequent word one letter away, and the last of such a chain."""
    return variants(written(word_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "words"))
