import random
import zlib

import pytest
from pyspark.sql import functions as F

from evidra.llm import sharding
from evidra.llm.sharding import differencing, op3_sharding, shard_by_bytes


def test_differencing_beats_dealing():
    rng = random.Random(3)
    sizes = [rng.randint(1, 5000) for _ in range(600)]
    place = differencing([[s] + [0] * 7 for s in sizes], 8)
    sums = [0] * 8
    for s, p in zip(sizes, place):
        sums[p[0]] += s
    assert sum(sums) == sum(sizes)
    assert max(sums) - min(sums) <= 10
    assert all(sorted(p) == list(range(8)) for p in place)


def test_small_known():
    place = differencing([[s, 0] for s in (8, 7, 6, 5, 4)], 2)
    sums = [sum(s for s, p in zip((8, 7, 6, 5, 4), place) if p[0] == j) for j in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2  # what two-way differencing of these gives


def test_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_sharding(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    shards, homes, slots = {}, {}, {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        shards[r.shard] = shards.get(r.shard, 0) + r["size"]
        homes.setdefault(data, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(x) == 1 for x in homes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(shards) <= set(range(40))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("groups_a_bucket", [20_000, 700])
def test_balance(spark, sf, groups_a_bucket, monkeypatch):
    """As even as one differencing of all groups, or as the largest group allows, in one bucket or many."""
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", groups_a_bucket)
    rows = op3_sharding(spark, f"/root/testdata/{sf}").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    sums, groups = [0] * 40, {}
    for r in rows:
        sums[r.shard] += r["size"]
        groups[texts[r.doc_id]] = groups.get(texts[r.doc_id], 0) + r["size"]
    mean, largest = sum(sums) / 40, max(groups.values())
    print(sf, groups_a_bucket, "largest shard over the mean", max(sums) / mean, "least", min(sums) / mean)
    assert max(sums) <= max(largest, 1.002 * mean) + min(groups.values()) * (sf == "sf0.001") * 8
    if largest < mean:
        assert min(sums) >= 0.99 * mean


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a", 3), (3, "a", 3)], "doc_id long, text string, shard int").withColumn("size", F.lit("x"))
    rows = sorted(shard_by_bytes(df, 3).collect(), key=lambda r: (r.doc_id, r.slot))
    assert [r["size"] for r in rows] == [16, 16, 17, 17]
    assert rows[0].shard == rows[1].shard and rows[2].shard == rows[3].shard != rows[0].shard
    assert rows[0].text_crc32 == 0 and {rows[2].slot, rows[3].slot} == {0, 1}
    assert shard_by_bytes(df.limit(0), 3).count() == 0
    more = df.unionByName(df.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("y" * 300_000)))
    assert sorted(r["size"] for r in shard_by_bytes(more, 3).where("doc_id is null").collect()) == [300_016] * 4
