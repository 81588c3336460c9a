"""Operator 5: exact Jaccard join of five-word shingle sets by PartEnum signatures.

Sets fall into bands of size, each a third wider than the last. For a band, two sets of Jaccard 3/4 or
more differ in at most ``bound`` shingles. The hash domain is split into n1 first-level partitions of
n2 = 2 parts each, more parts than ``bound``; all subsets of n2 - k2 = 1 part are enumerated, and a set's
projection on such a subset is a signature. Similar sets of a band agree on at least one. A set signs for
its own band, and as the larger set of a pair for the band below.

Three things keep it whole and small. Shingles in very many documents are left out of the signed domain
(differences only get fewer, so the guarantee stays). Only the ``bound`` + 1 smallest of a set's nonempty
signatures are sent (two sets that agree in one agree in one of these). Sets with too few nonempty parts
for the guarantee sign the whole domain too and, if that is still too little, their empty parts.

Sets that share a signature become candidates: all pairs in a group of a few, else a star around one
centre. A bound from counts of a set's shingles prunes pairs, and the rest are verified on their whole texts.
Larger groups whose members then lie in several components are searched again across components, by counts and
then in blocks of whole sets, and only links that join two components are given out: no link is lost, and rows
grow with the sets, not with their pairs. Equal sets are one class from the start.

Shingles and sets are compared by 64-bit hashes. Defined cases: texts without words (null, empty) have an
empty set and link with nothing, not even each other; repeated rows belong to one component; rows whose key
is null count their shingles, make no links, and take the component of an equal set with a key, else null;
very long texts are read whole, one at a time; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import own_names, partitions, split_by_ids, table, written
from evidra.llm.components import components, stars
from evidra.llm.shingles import mixed, shingle_set

U = np.uint64
CELLS, ALL_PAIRS, CENTRES = 256, 8, 1
#: Counts compared at once.
AT_ONCE = 4_000_000
#: Sets, and shingles of all of them, that a task of the search across components holds on either side, on average.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Those of which a task before it holds the counts.
NEAR_BLOCK, NEAR_SHINGLES = 8192, 8_000_000
#: Shingles of all documents for each bucket of signatures; a set sends about a third as many signatures.
BUCKET_SHINGLES = 12_000_000
#: A shingle in this share of all documents (and in 64 at least) is frequent: at most mean set size / share of them.
FREQUENT, FREQUENT_LEAST, SEEN_IN_BATCH = 1 / 1000, 64, 4


def _bands() -> np.ndarray:
    lo = [1]
    while lo[-1] < 1 << 40:
        lo.append(max(lo[-1] + 1, -(-lo[-1] * 4 // 3)))
    return np.array(lo)


LO = _bands()


def linked(both: int, a: int, b: int) -> bool:
    return 100 * both >= 75 * (a + b - both)


def set_class(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def cells(s: np.ndarray) -> bytes:
    """Counts of shingles by hash; their differences bound from below in how many shingles two sets differ.

    At most four shingles to a count on average: with more, chance alone evens out the counts of any two long sets.
    """
    width = max(CELLS, 1 << (-(-len(s) // 4) - 1).bit_length())
    return np.minimum(np.bincount((s & U(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


def _signed(s: np.ndarray, n: int, band: int, larger: bool, whole: int) -> tuple[np.ndarray, bool]:
    """The signatures sent for one band, and whether they carry the guarantee."""
    hi = int(LO[band + 1]) - 1
    bound = 2 * n // 7 if larger else n // 3
    # parts of the band: n1 * n2, from the band's limits alone; more than any bound in it
    parts = 2 * ((hi if hi <= 48 else int(0.42 * hi) + 1) // 2 + 1)
    parts = max(parts, 2 * (2 * (4 * hi // 3) // 7 // 2 + 1))
    tag = U((2 * band + whole) * 0x1000003 + 1)
    part = ((s >> U(32)) * U(parts)) >> U(32)
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(s) else np.zeros(0, np.int64)
    sums = np.add.reduceat(mixed(s ^ tag), at) if len(s) else np.zeros(0, U)
    sig = mixed(sums + part[at] * U(0x9E3779B97F4A7C15) + tag)
    if len(sig) > bound:
        return np.partition(sig, bound)[: bound + 1], True
    if whole:
        none = np.setdiff1d(np.arange(parts, dtype=U), part[at])
        return np.concatenate([sig, mixed(none * U(0xD1342543DE82EF95) + tag * U(3))]), False
    return sig, False


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """All that a set sends."""
    n = len(s)
    rare = s
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        rare = s[frequent[at] != s]
    own = int(np.searchsorted(LO, n, side="right")) - 1
    out = []
    for band, larger in ((own, False), (own - 1, True)):
        if band < 0 or larger and n > 4 * (int(LO[band + 1]) - 1) // 3:
            continue
        sig, sure = _signed(rare, n, band, larger, 0)
        out.append(sig)
        if not sure:
            out.append(_signed(s, n, band, larger, 1)[0])
    return np.concatenate(out)


def _documents(src: DataFrame) -> DataFrame:
    """A row per document (doc_id, n, class, cells), and rows (shingle, seen), n null, of those often seen in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, cel, sets = [], [], [], []
            held = 0

            def often() -> pa.RecordBatch:
                u, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, U), np.zeros(0, np.int64))
                u, c = u[c >= SEEN_IN_BATCH], c[c >= SEEN_IN_BATCH]
                k = len(u)
                return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=names)

            for t in b.column("text"):
                s = shingle_set(t.as_py())
                n.append(len(s))
                cls.append(set_class(s) if len(s) else None)
                cel.append(cells(s) if len(s) else None)
                sets.append(s)
                held += len(s)
                if held > 6_000_000:
                    yield often()
                    sets, held = [], 0
            yield often()
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(cel, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)

    names = ["doc_id", "n", "class", "cells", "shingle", "seen"]
    return src.mapInArrow(run, "doc_id long, n long, class long, cells binary, shingle long, seen long")


def _send(src: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Signatures by bucket, packed: a blob holds classes, how many signatures each has there, and those as 6 bytes.

    A class is sent once by a task, however many copies the task reads.
    """
    held = src.sparkSession.sparkContext.broadcast(frequent)  # bounded by mean set size / FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        of: list[int] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sigs, of, size
            if not sigs:
                return
            every = np.concatenate(sigs)
            cls = np.repeat(np.array(of, np.int64), [len(x) for x in sigs])
            bucket = (every % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            every, cls, bucket = every[order], cls[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blobs = []
            for a, z in zip(cut, [*cut[1:], len(every)]):
                c = cls[a:z]
                at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                count = np.diff(np.r_[at, z - a]).astype("<u4")
                short = every[a:z].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]  # the bucket tells the low bits apart
                blobs.append(np.array([len(at)], "<u8").tobytes() + c[at].astype("<i8").tobytes() + count.tobytes() + short.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
            sigs, of, size = [], [], 0

        for b in batches:
            for t in b.column("text"):
                s = shingle_set(t.as_py())
                if not len(s) or (c := set_class(s)) in seen:
                    continue
                seen.add(c)
                x = signatures(s, held.value)
                sigs.append(x)
                of.append(c)
                size += len(x)
                if size > 1_500_000:
                    yield from flush()
        yield from flush()

    return src.mapInArrow(run, "bucket int, blob binary")


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int(np.frombuffer(blob, "<u8", 1)[0])
    cls = np.frombuffer(blob, "<i8", k, 8)
    count = np.frombuffer(blob, "<u4", k, 8 + 8 * k)
    raw = np.frombuffer(blob, np.uint8, -1, 8 + 12 * k).reshape(-1, 6)
    sig = np.zeros((len(raw), 8), np.uint8)
    sig[:, :6] = raw
    return sig.view("<u8").ravel(), np.repeat(cls, count)


def _groups(sent: DataFrame, buckets: int) -> DataFrame:
    """Rows (a, b) of candidates, and rows (gid, members) of groups that these don't cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob"), strict=True):
                by.setdefault(k, []).append(_opened(blob.as_py()))
        for k in list(by):
            parts = by.pop(k)
            sig, cls = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((cls, sig))
            sig, cls = sig[order], cls[order]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])] if len(sig) else np.zeros(0, bool)
            sig, cls = sig[new], cls[new]
            at = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
            n = np.diff(np.r_[at, len(sig)])
            pairs: list[np.ndarray] = []
            done: set[bytes] = set()
            large: list[tuple[int, bytes]] = []
            for a, g in zip(at[n > 1].tolist(), n[n > 1].tolist()):
                m = cls[a : a + g]
                if (raw := m.tobytes()) in done:
                    continue
                done.add(raw)
                if g <= ALL_PAIRS:
                    i, j = np.triu_indices(g, 1)
                    pairs.append(np.stack([m[i], m[j]], 1))
                    continue
                large.append((xxhash.xxh3_64_intdigest(raw) - (1 << 63), raw))
                for c in range(CENTRES):
                    mid = m[np.argmin(mixed(m.astype(U) + U(c * 0x632BE59BD9B4E019 + 1)))]
                    rest = m[m != mid]
                    pairs.append(np.stack([np.minimum(rest, mid), np.maximum(rest, mid)], 1))
            if pairs:
                got = np.unique(np.concatenate(pairs), axis=0)
                for s in range(0, len(got), 50_000):
                    p = got[s : s + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.binary())], names=names)
            for s in range(0, len(large), 1000):
                p = large[s : s + 1000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.int64()), pa.array([x for x, _ in p], pa.int64()), pa.array([x for _, x in p], pa.binary())], names=names)

    names = ["a", "b", "gid", "members"]
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "a long, b long, gid long, members binary")


def _folded(c: np.ndarray, width: int) -> np.ndarray:
    """Counts as a set of fewer of them has them."""
    return c if c.shape[1] == width else np.minimum(c.reshape(len(c), -1, width).sum(1, dtype=np.int64), 255)


def possible(na: np.ndarray, nb: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and counts leave room for a link, and by how many shingles the sets differ at least.

    Linked pairs differ in (na + nb) / 7 shingles at most. A side has as many counts in all its rows.
    """
    width = min(ca.shape[1], cb.shape[1])
    apart = np.abs(_folded(ca, width).astype(np.int16) - _folded(cb, width).astype(np.int16)).sum(1, dtype=np.int64)
    return (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (7 * apart <= na + nb), apart


class Counts:
    """Counts of many sets, those of one width as a matrix."""

    def __init__(self, n: np.ndarray, blobs: list[bytes]) -> None:
        self.n, self.width = n, np.array([len(x) for x in blobs], np.int64)
        self.row, self.of = np.zeros(len(blobs), np.int64), {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.of[w] = np.frombuffer(b"".join([blobs[i] for i in at]), np.uint8).reshape(len(at), w)

    def room(self, x: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``possible`` of x with each of y."""
        ok, apart = np.zeros(len(y), bool), np.zeros(len(y), np.int64)
        own = self.of[int(self.width[x])][self.row[x]][None]
        for w in np.unique(self.width[y]).tolist():
            at = np.flatnonzero(self.width[y] == w)
            ok[at], apart[at] = possible(np.full(len(at), self.n[x]), self.n[y[at]], own, self.of[w][self.row[y[at]]])
        return ok, apart


def _pruned(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda x: classes.select(F.col("class").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b").select("rep_a", "rep_b", "n_a", "n_b", "cells_a", "cells_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = len(b)
            n = [b.column(c).to_numpy() for c in ("n_a", "n_b")]
            col = [b.column(c) for c in ("cells_a", "cells_b")]
            wide = np.stack([pc.binary_length(c).to_numpy().astype(np.int64) for c in col], 1)
            ok = np.zeros(k, bool)
            for w in np.unique(wide, axis=0):
                every, step = np.flatnonzero((wide == w).all(1)), max(1, AT_ONCE // int(w.max()))
                for s in range(0, len(every), step):
                    at = every[s : s + step]
                    mat = [np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), x) for c, x in zip(col, w)]
                    ok[at] = possible(n[0][at], n[1][at], *mat)[0]
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(c).take(keep) for c in ("rep_a", "rep_b")], names=["a", "b"])

    return wide.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, src: DataFrame) -> DataFrame:
    """Those pairs of doc_ids that link, by their whole texts. Only texts that may be needed are moved."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    need = written(split_by_ids(src, ids, "doc_id")[0], "jaccard-texts")
    need = need.repartition("doc_id").dropDuplicates(["doc_id", "text"])  # in the partitions that the joins use
    one = lambda x: need.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    wide = pairs.join(one("a"), "a").join(one("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            ok = []
            for x, y in zip(b.column("text_a"), b.column("text_b"), strict=True):
                x, y = x.as_py(), y.as_py()
                s = last[1] if last[0] == y else shingle_set(y)
                last = (y, s)
                r = shingle_set(x)
                ok.append(linked(len(np.intersect1d(r, s, assume_unique=True)), len(r), len(s)) if len(r) and len(s) else False)
            keep = pa.array(np.flatnonzero(np.array(ok, bool)))
            yield pa.RecordBatch.from_arrays([b.column(c).take(keep) for c in ("a", "b")], names=["a", "b"])

    return wide.mapInArrow(run, "a long, b long").distinct()


def _sets(src: DataFrame, ids: DataFrame) -> DataFrame:
    """(class, rep, shingles) of the documents ``ids`` (one column rep), from their whole texts."""
    need, _ = split_by_ids(src, ids, "doc_id")
    need = need.join(ids.withColumnRenamed("rep", "doc_id"), "doc_id")  # each id once; a semi-join would be moved before the split, onto all texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 256):
                part = b.slice(s, 256)
                sets = [shingle_set(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([pa.array([set_class(x) if len(x) else None for x in sets], pa.int64()), part.column("doc_id"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["class", "rep", "shingles"])

    return written(need.select("doc_id", "text").mapInArrow(run, "class long, rep long, shingles binary").dropDuplicates(["class"]), "jaccard-sets")


def _near(unit: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``unit`` that may link with one of another component, by sizes and counts: only their whole sets are moved."""
    asks = F.col("component") != F.col("main")
    asked, asking = _dealt(_sized(unit, asks, NEAR_BLOCK, NEAR_SHINGLES).join(classes.select("class", "cells"), "class"), asks, ["class", "n", "component", "cells"])

    def search(pdf):
        n, name, asking = (pdf[c].to_numpy() for c in ("n", "component", "asks"))
        counts = Counts(n, list(pdf["cells"]))
        order = np.argsort(n, kind="stable")
        asked = order[~asking[order]]
        sizes = n[asked]
        near = np.zeros(len(pdf), bool)
        for x in order[asking[order]].tolist():
            lo, hi = np.searchsorted(sizes, [-(-3 * n[x] // 4), 4 * n[x] // 3 + 1])
            y = asked[lo:hi]
            y = y[(name[y] != name[x]) & ~(near[x] & near[y])]
            y = y[counts.room(x, y)[0]]
            near[y] = True
            near[x] |= len(y) > 0
        return pdf.loc[near, ["main", "class"]]

    found = asked.unionByName(asking).groupBy("main", "block", "slice").applyInPandas(search, "main long, class long").distinct()
    return unit.join(found, ["main", "class"])


def _sized(unit: DataFrame, asks: Column, sets: int, shingles: int) -> DataFrame:
    """Adds the numbers of blocks and slices of each main component."""
    parts = lambda who: F.ceil(F.greatest(F.sum(F.when(who, 1)) / sets, F.sum(F.when(who, F.col("n"))) / shingles)).cast("int")
    return unit.join(unit.groupBy("main").agg(parts(F.lit(True)).alias("blocks"), parts(asks).alias("slices")), "main")


def _dealt(wide: DataFrame, asks: Column, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows by main component, block and slice: all are asked, each in a block, by all slices; those that ask lie in a slice and ask all blocks."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("class", F.lit(salt)), F.col(n)).cast("int")
    to = ["main", "block", "slice", "asks", *columns]
    asked = wide.where("slices is not null").select("*", own("blocks", 0).alias("block"), every("slices").alias("slice"), F.lit(False).alias("asks")).select(*to)
    asking = wide.where(asks).select("*", every("blocks").alias("block"), own("slices", 1).alias("slice"), F.lit(True).alias("asks")).select(*to)
    return asked, asking


def _across(groups: DataFrame, classes: DataFrame, comp: DataFrame, src: DataFrame) -> DataFrame:
    """Links (a, b) between the names of components that meet in a group, one for two components that link.

    A task gives at most one fewer than it has components, and what tasks say twice is left out as far as it meets.

    A group that meets one component only is done. Each other group goes to its main component, the one with
    most members there, and a component's groups are one search: a set is moved to it once, however many of the
    groups hold it. Sets of other components ask; all sets are asked, since two of the main one need no link.
    Counts are moved before whole sets, which follow where counts leave room for a link.
    The asked lie in blocks and the asking in slices of some thousand sets, so no task holds a whole component.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, m in zip(b.column("gid").to_pylist(), b.column("members"), strict=True):
                m = np.frombuffer(m.as_py(), np.int64)
                for s in range(0, len(m), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m[s : s + 50_000]), g)), pa.array(m[s : s + 50_000])], names=["gid", "class"])

    name = comp.select(F.col("id").alias("rep"), "component")
    known = classes.join(name, "rep", "left").select("class", "rep", "n", F.coalesce("component", "rep").alias("component"))
    rows = written(groups.mapInArrow(members, "gid long, class long").join(known, "class"), "jaccard-members")
    most = rows.groupBy("gid", "component").agg(F.count(F.lit(1)).alias("held")).groupBy("gid").agg(F.max(F.struct("held", "component")).alias("most"), F.count(F.lit(1)).alias("met"))
    main = most.where("met > 1").select("gid", F.col("most.component").alias("main"))
    unit = written(rows.join(main, "gid").select("main", "class", "rep", "n", "component").distinct(), "jaccard-search")
    unit = written(_near(unit, classes), "jaccard-near")
    asks = F.col("component") != F.col("main")
    wide = _sized(unit, asks, BLOCK, BLOCK_SHINGLES).join(_sets(src, unit.select("rep").distinct()).select("class", "shingles"), "class")
    asked, asking = _dealt(wide, asks, ["rep", "component", "shingles"])

    def search(pdf):
        import pandas as pd

        sets = [np.frombuffer(x, U) for x in pdf["shingles"]]
        n = np.array([len(x) for x in sets])
        counts = Counts(n, [cells(x) for x in sets])
        rep, name, asking = (pdf[c].to_numpy() for c in ("rep", "component", "asks"))
        comp_of = name.copy()
        order = np.lexsort((rep, n))  # by size, so a set's partners lie together
        asked = order[~asking[order]]
        sizes = n[asked]
        out = []
        for x in order[asking[order]].tolist():
            lo, hi = np.searchsorted(sizes, [-(-3 * n[x] // 4), 4 * n[x] // 3 + 1])
            y = asked[lo:hi]
            y = y[comp_of[y] != comp_of[x]]
            ok, apart = counts.room(x, y)
            y = y[ok]
            for j in y[np.argsort(apart[ok], kind="stable")].tolist():
                if comp_of[j] != comp_of[x] and linked(len(np.intersect1d(sets[x], sets[j], assume_unique=True)), n[x], n[j]):
                    out.append((name[x], name[j]))
                    comp_of[comp_of == comp_of[j]] = comp_of[x]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    links = asked.unionByName(asking).groupBy("main", "block", "slice").applyInPandas(search, "a long, b long").distinct()
    return stars(links).select(F.col("u").alias("a"), F.col("v").alias("b"))  # links of different tasks that say the same


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_shingles, component_id of every row: components under Jaccard of 3/4 or more."""
    spark = df.sparkSession
    every = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = written(_documents(every), "jaccard-documents")
    docs = found.where("n is not null").select("doc_id", "n", "class", "cells")
    src = every.where("doc_id is not null")
    total, shingles = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(FREQUENT_LEAST, int(total * FREQUENT))
    often = found.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least).select("shingle").collect()
    frequent = np.sort(np.array([r.shingle for r in often], np.int64).view(U))
    buckets = max(1, partitions(spark), -(-shingles // BUCKET_SHINGLES))  # a task holds one bucket
    classes = written(docs.where("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("cells").alias("cells")), "jaccard-classes")
    found = written(_groups(_send(src, frequent, buckets), buckets), "jaccard-groups")
    pairs = written(_pruned(found.where("a is not null").select("a", "b").distinct(), classes), "jaccard-pairs")
    links = written(_verified(pairs, src), "jaccard-links")
    comp = written(components(links), "jaccard-components")
    groups = found.where("gid is not null").select("gid", "members").dropDuplicates(["gid"])
    more = written(_across(groups, classes, comp, src), "jaccard-more")
    if more.limit(1).count():
        comp = written(components(links.unionByName(more)), "jaccard-components")
    copies = docs.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    of = copies.join(classes.select("class", "rep"), "class").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("class", "copies", F.coalesce("component", "rep").alias("component_id"))
    hot = F.col("copies") >= max(2, total // 500)  # at most 500 classes
    few = F.broadcast(of.where(hot).select("class", F.col("component_id").alias("hot_id")))
    rows = docs.select("doc_id", "n", "class").join(few, "class", "left")
    done = rows.where("hot_id is not null or class is null").select("doc_id", "n", F.coalesce("hot_id", "doc_id").alias("component_id"))
    rest = rows.where("hot_id is null and class is not null").join(of.where(~hot), "class", "left").select("doc_id", "n", "component_id")
    return done.unionByName(rest).select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose key is the smallest of its component; rows that repeat such a key stay too."""
    found = written(jaccard_components(df, key, text), "jaccard-found")
    going = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    maybe, rest = split_by_ids(df, going, key)
    (gone,) = own_names(df, "jaccard", "gone")
    left = maybe.join(going.withColumn(gone, F.lit(True)), key, "left").where(F.col(gone).isNull())  # an anti-join would be moved before the split, onto all texts
    return rest.unionByName(left.select(*df.columns))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard of 3/4 or more of their five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))
