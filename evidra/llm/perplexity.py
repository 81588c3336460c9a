"""Operator 11: quality rules, with the perplexity of a modified Kneser-Ney model as the last of them.

The units are the bytes of the UTF-8 text, so a model's parts saturate with a language instead of growing
with every new word. A document starts after ``ORDER - 1`` boundary bytes, which are context only. Spark
counts all n-grams of all documents; the lower orders' counts (of distinct left neighbours), discounts and
back-off shares are group-bys over these. A text is judged by a model that has not read it: texts are dealt
into two halves by the smallest hash of their three-word windows, so that near copies mostly share a half,
and each half is scored by the other's model. Since every n-gram to be scored is among those counted, joins
give its bits, and scoring looks them up in one sorted array of hashes.

That array is broadcast. It holds the n-grams of most occurrences, ``HEAD`` of them at most; where there are
more, the rest are found by a join, so that the result is the same at every size. Bits are whole numbers of
1/65536, so sums don't depend on their order.

A language's band reaches from the lower quartile of bits a byte less ``REACH`` times the distance of the
quartiles (``NARROWEST`` at least) to the upper one and as much more, over all its documents, each with the
weight of its bytes.

Defined cases: null text has no words and fails the base rules, as does every text of under 50 words; equal
texts of one language get equal verdicts (ties with a band's edge are kept); repeated rows count as often as
they occur; a null language is one of its own, the same as the empty one; a language whose texts are all in
one half is scored by an even guess at each byte; very long texts are read whole, one at a time; an empty table gives
an empty one; of the columns only id, text and language are read, so none clashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.llm.common import table, written
from evidra.llm.shingles import mixed, shingle_hashes

#: Bytes an n-gram; n-grams that are broadcast; bits as whole numbers of 1 / UNIT, quartiles in bins of 1 / BINS bit.
ORDER, HEAD, UNIT, BINS = 5, 1 << 22, 1 << 16, 1024
#: Distances of the quartiles on either side of them, and the least distance in bins.
REACH, NARROWEST = 4, 32
#: Bytes of text and n-grams that a task holds at once.
CHUNK, HELD = 2_000_000, 2_000_000

_U = np.uint64
SYMBOLS = b"#*$%&|<>"
BASE_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def words_of(data: bytes) -> np.ndarray:
    """Hashes of the words as they are spelt, parted by space and the bytes 9 to 13."""
    words = data.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def base_counts(text: str, data: bytes, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    blank = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(data.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    repeated = 0
    if len(words) > 3:
        windows = shingle_hashes(words, 3)
        _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
        twice = n[at] > 1
        if twice.any():
            covered = np.zeros(len(words), bool)
            for j in range(3):
                covered[j : len(windows) + j] |= twice
            repeated = int(covered.sum())
    return len(words), len(text) - blank, symbols, len(lines) - len(set(lines)), repeated


def half_of(words: np.ndarray) -> int:
    """0 or 1, the same for most near copies."""
    return int(shingle_hashes(words, 3).min() & _U(1)) if len(words) else 0


def grams_of(data: bytes, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as a number; its lowest byte is the last."""
    a = np.frombuffer(bytes(order - 1) + data, np.uint8).astype(_U)
    n = len(data)
    out = np.zeros(n, _U)
    for j in range(order):
        out = (out << _U(8)) | a[j : n + j]
    return out


def _seed(model: str, half: int) -> np.uint64:
    return _U(xxhash.xxh3_64_intdigest(f"{half}:{model}"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (tuples of Python values, the text last but one) of some ``CHUNK`` characters together."""
    held, size = [], 0
    for b in batches:
        for row in zip(*b.columns, strict=True):
            row = tuple(v.as_py() for v in row)
            held.append(row)
            size += len(row[-2]) + 64
            if size > CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(text, model) to (model, half, gram, n): every n-gram of every text, added up in the tasks first."""
    schema = pa.schema([("model", pa.string()), ("half", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (model, half), parts in held.items():
            keys, n = merged(parts)
            for s in range(0, len(keys), 100_000):
                k = keys[s : s + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(k)), pa.array(np.full(len(k), half, np.int32)), pa.array(k), pa.array(n[s : s + 100_000])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(list)
        size = 0
        for rows in _chunks(batches):
            found: dict = defaultdict(list)
            for text, model in rows:
                data = text.encode()
                found[model, half_of(words_of(data))].append(grams_of(data, order))
            for at, arrays in found.items():
                held[at].append(np.unique(np.concatenate(arrays), return_counts=True))
                size += len(held[at][-1][0])
            if size > HELD:
                held = defaultdict(list, {at: [merged(parts)] for at, parts in held.items()})
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD // 2:
                    yield from emit(held)
                    held, size = defaultdict(list), 0
        yield from emit(held)

    found = docs.mapInArrow(run, "model string, half int, gram long, n long")
    return found.groupBy("model", "half", "gram").agg(F.sum("n").alias("n"))


def discounts(grams: DataFrame) -> DataFrame:
    """(model, half, d1, d2, d3) from how many n-grams have the counts 1 to 4, each between 0.05 and its count."""
    n = {i: F.greatest(F.sum((F.col("n") == i).cast("double")), F.lit(1.0)) for i in (1, 2, 3, 4)}
    c = grams.groupBy("model", "half").agg(*[v.alias(f"c{i}") for i, v in n.items()])
    y = F.expr("c1 / (c1 + 2 * c2)")
    held = lambda v, top: F.least(F.greatest(v, F.lit(0.05)), F.lit(float(top)))
    d = [held(F.lit(i) - (i + 1) * y * F.expr(f"c{i + 1} / c{i}"), i).alias(f"d{i}") for i in (1, 2, 3)]
    return c.select("model", "half", *d)


def scored_grams(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(model, half, gram, n) with ``bits``: those of the last byte after the others, by the other half's model."""
    levels = {order: written(grams, "grams")}
    for k in range(order - 1, 0, -1):
        shorter = (F.col("gram").bitwiseAND((1 << (8 * k)) - 1)).alias("gram")
        levels[k] = written(levels[k + 1].groupBy("model", "half", shorter).agg(F.count("*").alias("n")), "grams")
    key = ["model", "half"]
    low = None
    for k in range(1, order + 1):
        g = levels[k]
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        other = g.join(discounts(g), key).select("model", (1 - F.col("half")).alias("half"), "gram", F.col("n").alias("seen"), less.alias("less"))
        history = other.groupBy(*key, F.shiftrightunsigned("gram", 8).alias("history")).agg(F.sum("seen").alias("all"), F.sum("less").alias("kept"))
        rows = g.withColumn("history", F.shiftrightunsigned("gram", 8))
        rows = rows.join(other, [*key, "gram"], "left").join(history, [*key, "history"], "left")
        if low is None:
            rows = rows.withColumn("p", F.lit(1 / 256))
        else:
            rows = rows.withColumn("shorter", F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1))
            rows = rows.join(low.select(*key, F.col("gram").alias("shorter"), "p"), [*key, "shorter"])
        p = F.coalesce((F.col("seen") - F.col("less")) / F.col("all"), F.lit(0.0)) + F.coalesce(F.col("kept") / F.col("all"), F.lit(1.0)) * F.col("p")
        low = written(rows.select(*key, "gram", "n", p.alias("p")), "scores")
    return low.select(*key, "gram", "n", F.round(-F.log2("p") * UNIT).cast("int").alias("bits"))


class Bits:
    """Bits of n-grams in one array sorted by hash; the hash's top bits point to where to look."""

    def __init__(self, hashes: np.ndarray, bits: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.bits = np.append(hashes[order], _U(0)), np.append(bits[order], np.int32(0))
        self.shift = 64 - max(1, int(len(hashes)).bit_length())
        self.starts = np.searchsorted(hashes[order], np.arange(1 << (64 - self.shift), dtype=_U) << _U(self.shift)).astype(np.int32)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits, whether the n-gram is held) of each."""
        end = len(self.hashes) - 1
        at = self.starts[(hashes >> _U(self.shift)).astype(np.int64)].astype(np.int64)
        left = np.flatnonzero((at < end) & (self.hashes[at] < hashes))
        while len(left):
            at[left] += 1
            left = left[(at[left] < end) & (self.hashes[at[left]] < hashes[left])]
        hit = (at < end) & (self.hashes[at] == hashes)
        return np.where(hit, self.bits[at], 0), hit


def head_and_tail(scored: DataFrame, head: int = HEAD) -> tuple[Bits, DataFrame | None]:
    """The most frequent n-grams, ``head`` at most, as an array, and the others as a table, if there are any."""
    octave = F.floor(F.log2("n")).cast("int")
    sizes = {r.octave: r["count"] for r in scored.groupBy(octave.alias("octave")).count().collect()}
    total, least = 0, 64
    for o in range(63, -1, -1):
        total += sizes.get(o, 0)
        if total > head:
            break
        least = o
    kept = scored.where(octave >= least).select("model", "half", "gram", "bits").toArrow()
    hashes = kept["gram"].to_numpy().astype(_U)
    models = kept["model"].combine_chunks().dictionary_encode() if len(kept) else pa.array([], pa.string()).dictionary_encode()
    names = models.dictionary.to_pylist()
    seeds = np.array([[_seed(m, h) for h in (0, 1)] for m in names], _U).reshape(-1, 2)
    hashes = mixed(hashes ^ seeds[models.indices.to_numpy(), kept["half"].to_numpy()]) if len(kept) else hashes
    return Bits(hashes, kept["bits"].to_numpy().astype(np.int32)), scored.where(octave < least) if least else None


def judged(docs: DataFrame, key: str, text: str, lang: str, order: int = ORDER, head: int = HEAD) -> DataFrame:
    """(key, base counts, base_failed, kept, perplexity a byte, the language's band) of every document."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("model"))
    scored = written(scored_grams(gram_counts(texts.select("text", "model"), order), order), "bits")
    bits, tail = head_and_tail(scored, head)
    shared = spark.sparkContext.broadcast((bits.hashes, bits.bits, bits.shift, bits.starts))

    def found(rows: list[tuple]) -> Iterator[tuple]:
        """(row, bytes, words, half, n-grams, bits, held) of each row of a chunk."""
        b = Bits.__new__(Bits)
        b.hashes, b.bits, b.shift, b.starts = shared.value
        made = []
        for row in rows:
            data = row[-2].encode()
            words = words_of(data)
            made.append((row, data, words, half_of(words), grams_of(data, order)))
        cost, hit = b.of(mixed(np.concatenate([g ^ _seed(row[-1], half) for row, _, _, half, g in made])))
        end = 0
        for row, data, words, half, g in made:
            start, end = end, end + len(g)
            yield row, data, words, half, g, cost[start:end], hit[start:end]

    names = ["key", "digest", "model", *[f.split()[0] for f in BASE_FIELDS.split(", ")], "n_bytes", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            out = [(row[0], xxhash.xxh3_128_digest(data), row[-1], *base_counts(row[-2], data, words), len(data), int(cost.sum(dtype=np.int64))) for row, data, words, _, _, cost, _ in found(rows)]
            kinds = [key_type, pa.binary(), pa.string(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=names)

    key_type = pa.int64() if texts.schema["key"].dataType.simpleString() in ("bigint", "int") else pa.string()
    texts = texts.withColumn("key", F.col("key").cast("long" if key_type == pa.int64() else "string"))
    rows = texts.mapInArrow(run, f"key {'long' if key_type == pa.int64() else 'string'}, digest binary, model string, {BASE_FIELDS}, n_bytes long, bits long")
    if tail is not None:

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _chunks(batches):
                seen = set()
                for row, data, _, half, g, _, hit in found(part):
                    at = (xxhash.xxh3_128_digest(data), row[-1])
                    if hit.all() or at in seen:
                        continue
                    seen.add(at)
                    grams, n = np.unique(g[~hit], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(n)), pa.array([row[-1]] * len(n)), pa.array(np.full(len(n), half, np.int32)), pa.array(grams.astype(np.int64)), pa.array(n)], names=["digest", "model", "half", "gram", "times"])

        # one task may give a text's part that another one gives too: each n-gram of a text is taken once
        asked = texts.select("text", "model").mapInArrow(rest, "digest binary, model string, half int, gram long, times long").distinct()
        more = asked.join(tail.select("model", "half", "gram", F.col("bits").alias("each")), ["model", "half", "gram"]).groupBy("digest", "model").agg(F.sum(F.col("times") * F.col("each")).alias("more"))
        rows = rows.join(more, ["digest", "model"], "left").withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0)))
    rows = written(rows.select(*[n for n in names if n != "digest"]), "judged").withColumn("bin", F.expr(f"(bits * {BINS}) div (nullif(n_bytes, 0) * {UNIT})"))  # null without a byte
    each = rows.where("bin is not null").groupBy("model", "bin").agg(F.sum("n_bytes").alias("n"))
    to = Window.partitionBy("model").orderBy("bin")
    sums = each.withColumn("upto", F.sum("n").over(to)).withColumn("of", F.sum("n").over(Window.partitionBy("model")))
    quarter = lambda i: F.min(F.when(4 * F.col("upto") >= i * F.col("of"), F.col("bin")))
    bands = sums.groupBy("model").agg(quarter(1).alias("q1"), quarter(3).alias("q3")).withColumn("reach", REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(NARROWEST)))
    bands = bands.select("model", (F.col("q1") - F.col("reach")).alias("low"), (F.col("q3") + F.col("reach")).alias("high"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    power = lambda c: F.pow(F.lit(2.0), c)
    return rows.join(bands, "model", "left").select(
        F.col("key").alias(key), *[f.split()[0] for f in BASE_FIELDS.split(", ")], failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("bin").between(F.col("low"), F.col("high")), F.lit(False))).alias("kept"),
        power(F.expr(f"bits / (nullif(n_bytes, 0) * {UNIT})")).alias("perplexity"), power(F.col("low") / BINS).alias("least"), power(F.col("high") / BINS).alias("most"),
    )


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of its language's band of perplexity."""
    return judged(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
