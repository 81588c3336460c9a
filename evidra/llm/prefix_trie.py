"""Operator 13: the trie of conversation prefixes and what sharing them saves.

Every conversation has a path from the root, one node a turn. A node belongs to its smallest member; what is
below a node has members of that node only, so a conversation that owns a node owns all deeper ones of its
path: it owns a suffix. Summing over the members of a node what their paths have from there on, less what
they own from there on, leaves each node below as often as it has members less one, and counting the members
that own a leaf counts the leaves. So one group-by over all prefixes gives the sums over all subtrees, and no
tree is walked.

A node is named by its depth and two 64-bit hashes, running exclusive ors over the turns of its path. Turns
are sorted over the whole cluster; windows run along a conversation inside one range of that order only, and
the sums of the ranges before are added to them, so that a conversation of any length is many tasks' work.
The ids that end at a node are joined to blocks by range first; one hash then reads the node's blocks in order.

Defined cases: null role and text are empty; null turns come first; turns of equal number (ties) are ordered
by role and then by the SHA-256 of the text; repeated rows are turns of their own; rows of a null conv_id are
in no conversation and take no part; of a negative id the remainder is taken as positive; very long texts are
read once, to be hashed; an empty table has no conversation and so no root; columns other than the four named
aren't read, so none clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.llm.common import partitions, table, written

#: Conversations whose first turns are taken from the same one; heads are shorter than this; ids a block.
FAMILY, HEADS, BLOCK = 5, 9, 4_096

NODE = ["depth", "k1", "k2"]


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, part, pos, a, b, bytes): the place of each turn from 1, hashes of role and text, bytes of the text.

    ``part`` is the range of the cluster-wide order that the turn is in.
    """
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.unhex(F.sha2(words, 256)).alias("digest"), F.octet_length(words).cast("long").alias("bytes"),
    )
    rows = written(rows, "turns").withColumn("copy", F.monotonically_increasing_id())  # deals equal rows out as well
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = written(rows.repartitionByRange(partitions(turns.sparkSession), "conv", *order, "copy").withColumn("part", F.spark_partition_id()), "placed")
    local = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    before = F.sum("many").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("conv", "part").agg(F.count("*").alias("many")).select("conv", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    content = [F.xxhash64(F.lit(i), "role", "digest").alias(c) for i, c in ((1, "a"), (2, "b"))]
    return placed.withColumn("local", local).join(offsets, ["conv", "part"]).select("conv", "part", (F.col("local") + F.col("offset")).alias("pos"), *content, "bytes")


def _head(conv: str) -> Column:
    return F.crc32(F.col(conv).cast("string").cast("binary")) % HEADS


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``numbered`` rows: (conv, part, depth, a, b, bytes) after every head was replaced, and (conv, length)."""
    long = rows.groupBy("conv").agg(F.count("*").alias("turns"))
    plan = long.select("conv", "turns", (F.col("conv") - F.pmod("conv", F.lit(FAMILY))).alias("first"), _head("conv").alias("head"))
    first = long.where(F.pmod("conv", F.lit(FAMILY)) == 0).select(F.col("conv").alias("first"), F.col("turns").alias("there"))
    plan = plan.join(first, "first", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    plan = written(plan.select("conv", "first", "head", "taken", (F.col("taken") + F.greatest(F.col("turns") - F.col("head"), F.lit(0))).alias("length")), "rebuilt")
    own = rows.join(plan.select("conv", "head", "taken"), "conv").where("pos > head").select("conv", "part", (F.col("pos") - F.col("head") + F.col("taken")).alias("depth"), "a", "b", "bytes")
    heads = rows.where((F.pmod("conv", F.lit(FAMILY)) == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv", "first")
    heads = heads.join(plan.select("conv", "first", "head"), "first").where("pos <= head").select("conv", F.lit(-1).alias("part"), F.col("pos").alias("depth"), "a", "b", "bytes")
    return own.unionByName(heads), plan.select("conv", "length")


def occurrences(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, bytes, upto, last): every prefix of every conversation and its parent's name.

    ``upto`` are the bytes of all the prefix's texts, ``last`` is 1 where the conversation ends.
    """
    own = [F.xxhash64(F.lit(i), "a", "b", "depth").alias(c) for i, c in ((3, "h1"), (4, "h2"))]
    rows = written(rows.select("conv", "part", "depth", "bytes", *own), "steps")
    whole = rows.groupBy("conv", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sum("bytes").alias("s"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = whole.select("conv", "part", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"b{c}") for f, c in ((F.bit_xor, "x1"), (F.bit_xor, "x2"), (F.sum, "s"))])
    along = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    steps = rows.select("*", F.bit_xor("h1").over(along).alias("r1"), F.bit_xor("h2").over(along).alias("r2"), F.sum("bytes").over(along).alias("r"))
    k1, k2 = F.col("r1").bitwiseXOR(F.col("bx1")), F.col("r2").bitwiseXOR(F.col("bx2"))
    steps = steps.join(parts, ["conv", "part"]).join(lengths, "conv").select(
        "conv", F.col("depth").cast("long").alias("depth"), k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("h1")).alias("p1"), k2.bitwiseXOR(F.col("h2")).alias("p2"),
        "bytes", (F.col("r") + F.col("bs")).alias("upto"), (F.col("depth") == F.col("length")).cast("long").alias("last"),
    )
    zero = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    roots = lengths.select("conv", *zero("depth", "k1", "k2", "p1", "p2", "bytes", "upto"), (F.col("length") == 0).cast("long").alias("last"))
    return steps.unionByName(roots)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv) to (depth, k1, k2, ends_sha256); a node's ids become blocks of text in many tasks, and one hash reads the blocks."""
    blocks_of = "depth long, k1 long, k2 long, first long, ids string"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for b in batches:
            for *at, conv in zip(*(b.column(c).to_pylist() for c in (*NODE, "conv")), strict=True):
                if ids and (at != node or len(ids) == BLOCK):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                    if len(out) >= 1_000:
                        yield _batch(out, [*NODE, "first", "ids"])
                        out = []
                node = at
                ids.append(conv)
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        if out:
            yield _batch(out, [*NODE, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for b in batches:
            for *at, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if at == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = at, hashlib.sha256(ids.encode())
            if len(out) >= 10_000:
                yield _batch(out, [*NODE, "ends_sha256"])
                out = []
        if node:
            out.append((*node, sha.hexdigest()))
        if out:
            yield _batch(out, [*NODE, "ends_sha256"])

    sorted_ids = ends.repartitionByRange(partitions(ends.sparkSession), *NODE, "conv").sortWithinPartitions(*NODE, "conv")
    joined = sorted_ids.mapInArrow(blocks, blocks_of).repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return joined.mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    text = {"ids", "ends_sha256"}
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in text else pa.int64()) for n, c in zip(names, zip(*rows), strict=True)], names=names)


def prefix_trie(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations, as the module says."""
    occ = written(occurrences(*rebuilt(written(numbered(turns, conv, turn, role, text), "numbered"))), "prefixes")
    nodes = occ.groupBy(*NODE).agg(
        F.min("conv").alias("owner"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min(F.col("upto") - F.col("bytes")).alias("before"), (F.sum("last") == F.count("*")).alias("leaf"),
    )
    nodes = written(nodes, "nodes")
    owned = nodes.groupBy("owner").agg(F.min(F.struct("depth", "before")).alias("start"), F.max(F.col("leaf").cast("long")).alias("leaf"))
    owned = owned.select(F.col("owner").alias("conv"), F.col("start.depth").alias("own"), F.col("start.before").alias("before"), "leaf")
    paths = occ.where("last = 1").select("conv", "upto").join(owned, "conv", "left").select("conv", "own", F.coalesce("before", "upto").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    paths = written(paths, "paths")
    owns = F.col("own").isNotNull() & (F.col("depth") >= F.col("own"))
    sums = occ.join(paths, "conv").groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(owns, 0).otherwise(F.col("shared") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"),
    )
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    # a node's parent has the same owner, but for the first node that a conversation owns
    (top,) = nodes.agg(F.min("owner")).first()
    mine = nodes.join(paths.select(F.col("conv").alias("owner"), "own"), "owner")
    branch = mine.where("depth = own and depth > 1").select(F.col("depth").alias("at"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    above = branch.join(nodes.select(*NODE, F.col("owner").alias("above")), NODE).select(F.col("at").alias("depth"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), "above")
    out = sums.join(children, NODE, "left").join(above, NODE, "left").join(ends_digests(occ.where("last = 1").select(*NODE, "conv")), NODE, "left")
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") == 1, F.lit(top).cast("long")).otherwise(F.coalesce("above", "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
