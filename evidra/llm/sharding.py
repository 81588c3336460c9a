"""Operator 3: shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

Equal texts form one group, which stays whole. Groups are summed before they move (text digest, bytes, rows).
Differencing takes the two partial partitions of largest spread, merges them in opposite order, and goes on
until one partial partition of ``shards`` parts is left. It is done twice: first for the heavy groups, those of
at least 1 / ``HEAVY`` of a shard, of which there are at most ``shards * HEAVY``, on the driver; then for the
others, dealt by digest into buckets of some thousand groups, each on its own. A bucket starts from its share of
the heavy groups' partial partition, so its groups level what these left uneven, and its parts are the shards.
Slots count up within (shard, part), with offsets from the parts' counts, so no shard is one task's work.

Defined cases: null text is empty and so equal to empty text; repeated rows are one group and get a slot each;
groups of equal bytes go by their digest (ties); rows of a null key are placed like others; the size of a very
long text is all that moves of it; an empty table gives an empty result; columns other than the named ones
aren't read, so none clashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.llm.common import table, written

#: Heavy groups hold at least this part of a shard's mean bytes; groups of a bucket.
HEAVY, BUCKET_GROUPS = 512, 20_000
#: Groups of at least this share of all rows are joined by broadcast: there are at most 1 / share.
HOT_SHARE = 1 / 500
SLOT_PARTS = 64


def differencing(tuples: list[list[int]], k: int) -> list[list[int]]:
    """Karmarkar-Karp over partial partitions of ``k`` parts. Returns, for each, the final part of its part j.

    A partial partition enters as its sums; the answer for entry i is a list of k final parts.
    """
    if not tuples:
        return []
    #: node: (sums sorted downwards, which of its left child's and right child's parts lie at each place)
    nodes: list[tuple] = []
    heap = []
    for sums in tuples:
        order = sorted(range(k), key=lambda j: -sums[j])
        s = [sums[j] for j in order]
        nodes.append((s, order, None, None))
        heap.append((s[-1] - s[0], len(nodes) - 1))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sa, sb = nodes[a][0], nodes[b][0]
        both = [x + y for x, y in zip(sa, reversed(sb), strict=True)]
        order = sorted(range(k), key=lambda j: -both[j])
        s = [both[j] for j in order]
        nodes.append((s, order, a, b))
        heapq.heappush(heap, (s[-1] - s[0], len(nodes) - 1))
    final: list = [None] * len(nodes)  # of each place of a node
    final[-1] = list(range(k))
    for i in range(len(nodes) - 1, -1, -1):
        _, order, a, b = nodes[i]
        place = [0] * k
        for p, j in enumerate(order):
            place[j] = final[i][p]
        if a is not None:
            final[a], final[b] = place, place[::-1]
            final[i] = None
        else:
            final[i] = place
    return final[: len(tuples)]


def shard_groups(groups: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """(group, bytes, n) to (group, n, bytes, shard), and the number of buckets."""
    count, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bound = max(1, -(-total // (shards * HEAVY)))
    heavy = sorted(groups.where(F.col("bytes") >= bound).collect(), key=lambda r: (-r.bytes, r.group))  # at most shards * HEAVY rows
    zero = [0] * (shards - 1)
    home = [p[0] for p in differencing([[r.bytes, *zero] for r in heavy], shards)]
    load = [0] * shards
    for r, s in zip(heavy, home, strict=True):
        load[s] += r.bytes
    light = total - sum(load)
    buckets = max(1, -(-(count - len(heavy)) // BUCKET_GROUPS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True])
        own = int(pdf["bytes"].sum())
        first, *place = differencing([[x * own // light for x in load], *[[int(b), *zero] for b in pdf["bytes"]]], shards)
        shard_of = {part: shard for shard, part in enumerate(first)}
        return pd.DataFrame({"group": pdf["group"], "n": pdf["n"], "bytes": pdf["bytes"], "shard": [shard_of[p[0]] for p in place]})

    fields = "group binary, n long, bytes long, shard int"
    rest = groups.where(F.col("bytes") < bound).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int"))
    placed = groups.sparkSession.createDataFrame([(r.group, r.n, r.bytes, s) for r, s in zip(heavy, home, strict=True)], fields)
    return placed.unionByName(rest.groupBy("bucket").applyInPandas(run, fields)), buckets


def shard_by_bytes(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Columns key, size, text_crc32, shard, slot. ``shard`` 0 to shards - 1; ``slot`` gapless in each from 0."""
    spark = df.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), (F.octet_length(content) + overhead).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("crc"), F.unhex(F.md5(content.cast("binary"))).alias("group"))
    rows = written(rows, "shard-rows")  # 48 bytes a row; the texts aren't read again
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    parts, buckets = shard_groups(written(groups, "shard-groups"), shards)
    parts = written(parts, "shard-parts")
    total = rows.count()
    hot = F.col("n") >= max(2, int(total * HOT_SHARE))
    few = F.broadcast(parts.where(hot).select("group", F.col("shard").alias("hot_shard")))
    rows = rows.join(few, "group", "left")
    placed = rows.where("hot_shard is not null").select("key", "size", "crc", F.col("hot_shard").alias("shard")).unionByName(rows.where("hot_shard is null").join(parts.where(~hot), "group").select("key", "size", "crc", "shard"))
    placed = written(placed.withColumn("piece", F.pmod(F.xxhash64("key", "crc"), F.lit(SLOT_PARTS * max(1, buckets // 8))).cast("int")), "shard-placed")
    counts = placed.groupBy("shard", "piece").count()
    before = F.sum("count").over(W.partitionBy("shard").orderBy("piece")) - F.col("count")
    offsets = F.broadcast(counts.select("shard", "piece", before.alias("before")))  # shards * pieces rows
    within = F.row_number().over(W.partitionBy("shard", "piece").orderBy("key", "crc", "size"))
    return placed.withColumn("within", within).join(offsets, ["shard", "piece"]).select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``bytes``: sizes near equal, equal texts together."""
    got = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
