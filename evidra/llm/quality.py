"""Operator 4: quality classifier by positive-unlabelled learning.

Trusted positives are the learning labels of quality 1; the unlabelled text is the corpus itself; labels of
quality 0 aren't used. A small network over statistics of the whole text minimises the non-negative unbiased
risk: with prior p, ``p R+(positives) + max(0, R-(unlabelled) - p R-(positives))``, stepping back up where the
second part falls below zero.

The class prior is estimated from positives and unlabelled text: networks tell one half of the positives from
one half of the corpus and score the other halves; at the score where that is surest, the share of all documents
above it, divided by the share of positives above it, is the estimate (best-bin estimation).

Statistics of every text are written once. The fit starts on a sample of at most about ``most`` positives and as
many unlabelled rows, a documented bound; its last steps take mean, spread, prior and gradient over all documents,
each a pass of sums over the written statistics. Sums are of whole numbers, so their order doesn't matter.

Labels, lang, source and doc_id are no inputs of a score. Defined cases: null text is scored as empty; equal
texts get equal scores (ties stay ties); repeated rows are scored as often as they occur; rows of a null key are
scored like others; without a trusted positive every score is 0.5; very long texts are read whole, one at a time;
an empty table gives an empty result; other columns stay, and those that clash with a new one are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import own_names, table, with_columns, written

#: About the most trusted positives, and the most unlabelled documents of the fit's start; steps of that and of the
#: prior's networks; passes over all documents.
MOST, HIDDEN, STEPS, APART_STEPS, PASSES, SEED = 15_000, 24, 500, 80, 8, 4
#: The prior's confidence and margin; bins of scores; parts of one in which sums are counted; weight decay.
DELTA, MARGIN, BINS, UNIT, RIDGE = 0.1, 0.01, 2000, 1 << 20, 1e-3

_CLASS = np.full(256, 7, np.int8)  # other ASCII signs
_CLASS[128:] = 0
for _k, _s in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\t\r\x0b\x0c", b".,;:'\"()-?!")):
    _CLASS[list(_s)] = _k + 1
_CLASS[0:9] = 7
N_FEATURES = 26


def features(data: bytes) -> list[float]:
    """Statistics of a whole text: kinds of bytes, words, repetition and lines."""
    n = len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=hist, minlength=8) / max(n, 1)
    words = data.split()
    m = len(words)
    count = Counter(words)
    top = count.most_common(1)[0][1] / m if m else 0.0
    runs = sum(map(bytes.__eq__, words, words[1:])) / m if m else 0.0
    ends = Counter(w[-1] for w in words)
    odd = sum(v for c, v in ends.items() if _CLASS[c] == 7) / m if m else 0.0
    plain = sum(v for c, v in ends.items() if c in b".,;:") / m if m else 0.0
    bang = sum(v for c, v in ends.items() if c in b"!?") / m if m else 0.0
    signs = sum(v for w, v in count.items() if not w.isalnum() and len(w) <= 3 and w.isascii() and not any(chr(c).isalnum() for c in w)) / m if m else 0.0
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = len(lines)
    same = 1 - len(set(lines)) / k if k else 0.0
    caps = sum(v for w, v in count.items() if w.isupper()) / m if m else 0.0
    title = sum(v for w, v in count.items() if w.istitle()) / m if m else 0.0
    p = np.fromiter(count.values(), float, len(count)) / max(m, 1)
    entropy = float(-(p * np.log(p)).sum()) / max(np.log(max(m, 2)), 1e-9)
    h = hist[hist > 0] / max(n, 1)
    by_byte = float(-(h * np.log(h)).sum())
    sizes = Counter(map(len, words))
    mean = sum(a * b for a, b in sizes.items()) / m if m else 0.0
    long_ = sum(b for a, b in sizes.items() if a > 16) / m if m else 0.0
    short = sum(b for a, b in sizes.items() if a < 3) / m if m else 0.0
    return [*kinds, np.log1p(n), np.log1p(m), len(count) / max(m, 1), top, runs, odd, plain, bang, signs, same, caps, title, entropy, by_byte, mean / 10, long_, short, np.log1p(m / max(k, 1))]


class Model:
    """Standardised statistics, one hidden layer; all in double precision and fixed by the seed."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.steps = mean, scale, 0
        self.p = [rng.standard_normal((len(mean), hidden)) / np.sqrt(len(mean)), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        self.m, self.v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.standard(x)
        out = np.empty(len(z))
        for i, row in enumerate(z):  # row by row: equal texts score equal in any batch
            out[i] = np.tanh(row @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]
        return sigmoid(out)

    def pull(self, z: np.ndarray, h: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """The gradient, given that of each row's output."""
        dh = np.outer(d, self.p[2]) * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        self.steps += 1
        t = self.steps
        for i, g in enumerate(grads):
            g = g + RIDGE * self.p[i] if i in (0, 2) else g
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9**t)) / (np.sqrt(self.v[i] / (1 - 0.999**t)) + 1e-9)


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -500, 500)))


def risk_step(model: Model, zp: np.ndarray, prior: float, rest: float, grads: list[np.ndarray], rate: float) -> None:
    """One step on the non-negative risk; ``rest`` and ``grads``: R-(unlabelled) and its gradient."""
    h, g = model.forward(zp)
    s, n = sigmoid(g), len(zp)
    if rest - prior * np.logaddexp(0, g).mean() >= 0:
        own = model.pull(zp, h, prior * (s - 1) / n - prior * s / n)
        model.step([a + b for a, b in zip(own, grads)], rate)
    else:  # back up along the part that went below zero
        own = model.pull(zp, h, prior * s / n)
        model.step([a - b for a, b in zip(own, grads)], rate)


def negative_risk(model: Model, z: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The sum over rows of the loss of calling them negative, and its gradient."""
    h, g = model.forward(z)
    return float(np.logaddexp(0, g).sum()), model.pull(z, h, sigmoid(g))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> Model:
    """Adam on the non-negative risk of the logistic loss, over the whole samples."""
    model = Model(unlabelled.mean(0) if mean is None else mean, unlabelled.std(0) + 1e-6 if scale is None else scale)
    zp, zu = model.standard(positive), model.standard(unlabelled)
    for t in range(1, steps + 1):
        total, grads = negative_risk(model, zu)
        risk_step(model, zp, prior, total / len(zu), [g / len(zu) for g in grads], 0.02 * (1 - t / (steps + 1)))
    return model


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior, from how many positives and unlabelled rows lie in each bin of scores, lowest bin first."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p, above_u = (np.cumsum(a[::-1]) / max(a.sum(), 1) for a in (positive, unlabelled))
    doubt = np.sqrt(np.log(4 / DELTA) / 2) * (n_u**-0.5 + n_p**-0.5)
    held = above_p > 0
    at = np.argmin((above_u[held] + (1 + MARGIN) * doubt) / above_p[held])
    return float(np.clip(above_u[held][at] / above_p[held][at], 1e-3, 1 - 1e-3))


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics) of every whole text; statistics as packed doubles."""

    def run(batches: Iterator[list]) -> Iterator[list[list]]:
        for texts in batches:
            yield [[np.array(features(t or b""), "<f8").tobytes() for t in texts]]

    return with_columns(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", [T.StructField("statistics", T.BinaryType())], run).select("key", "statistics")


def _rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, N_FEATURES)


def _sums(stats: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``of`` gives for a batch of statistics, in parts of ``UNIT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                got = of(_rows(b.column("statistics")))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.round(total * UNIT).astype(np.int64))], names=["at", "value"])

    rows = stats.select("statistics").mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()  # as many rows as a model has numbers
    return np.array([r.value for r in sorted(rows)], np.float64) / UNIT


def learning(key: str = "doc_id"):
    """The condition for rows whose labels may be learnt from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1


def train(stats: DataFrame, labels: DataFrame, most: int = MOST, passes: int = PASSES) -> Model | None:
    """A model from written ``statistics`` of all documents and labels (doc_id, quality)."""
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality") == 1) & learning()).select("doc_id").distinct()
    n_good, total = known.count(), stats.count()
    share = lambda n: int(min(1.0, most / max(n, 1)) * (1 << 20))
    good = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < share(n_good)))  # about ``most`` ids
    half = F.pmod(F.xxhash64("statistics"), F.lit(2))

    def take(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """About ``most`` rows of 26 numbers at most, in an order of their own, and which half each is of."""
        rows = sorted((r.statistics, r.half) for r in df.select("statistics", half.alias("half")).collect())
        return np.array([np.frombuffer(x, "<f8") for x, _ in rows]).reshape(-1, N_FEATURES), np.array([h for _, h in rows], int)

    trusted = stats.join(good, F.col("key") == F.col("doc_id")).groupBy("key").agg(F.min("statistics").alias("statistics"))
    positive, p_half = take(trusted)
    unlabelled, u_half = take(stats.where(F.rand(SEED) < share(total) / (1 << 20)))
    if not len(positive) or not len(unlabelled):
        return None
    n, x, xx = np.split(_sums(stats, lambda a: np.concatenate([[float(len(a))], a.sum(0), (a * a).sum(0)])), [1, 1 + N_FEATURES])
    mean = x / n
    scale = np.sqrt(np.maximum(xx / n - mean**2, 0)) + 1e-6
    prior = 0.5
    if len(set(p_half)) == 2 and len(set(u_half)) == 2:
        spreads = []
        for h in (0, 1):  # each half is scored by what the other taught
            apart = fit(positive[p_half != h], unlabelled[u_half != h], 0.5, APART_STEPS, mean, scale)
            spread = lambda a, m=apart: np.histogram(sigmoid(m.forward(m.standard(a))[1]), BINS, (0, 1))[0].astype(float)
            spreads.append((spread(positive[p_half == h]), _sums(stats.where(half == h), spread)))
        prior = best_bin(spreads[0][0] + spreads[1][0], spreads[0][1] + spreads[1][1])
    model = fit(positive, unlabelled, prior, STEPS, mean, scale)
    model.prior = prior
    zp, shapes = model.standard(positive), [a.shape for a in model.p]
    cuts = np.cumsum([a.size for a in model.p])[:-1]
    for _ in range(passes):

        def risk(a: np.ndarray) -> np.ndarray:
            total, grads = negative_risk(model, model.standard(a))
            return np.concatenate([[total], *[g.ravel() for g in grads]])

        got = _sums(stats, risk) / n[0]
        risk_step(model, zp, prior, float(got[0]), [g.reshape(s) for g, s in zip(np.split(got[1:], cuts), shapes)], 0.002)
    return model


def score_quality(df: DataFrame, model: Model | None, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``."""

    def run(batches: Iterator[list]) -> Iterator[list[list]]:
        for texts in batches:
            s = model.scores(np.array([features(t or b"") for t in texts], np.float64).reshape(-1, N_FEATURES)) if model else np.full(len(texts), 0.5)
            yield [s.tolist(), [int(x >= 0.5) for x in s]]

    return with_columns(df, text, [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())], run)


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that the classifier doesn't reject, with their own columns, whatever these are called."""
    model = train(written(statistics(df, key, text), "quality-statistics"), labels)
    score, predicted = own_names(df, "quality", "score", "predicted")
    return score_quality(df, model, text, score, predicted).where(F.col(predicted) == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every whole text of ``documents``."""
    stats = written(statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    model = train(stats, table(spark, sf_dir, "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(_rows(b.column("statistics"))) if model else np.full(len(b), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    src = stats.select(F.col("key").alias("doc_id"), (~learning("key")).alias("held_out"), "statistics")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
