import json
import os
import random

import pytest
from pyspark.sql import functions as F

from evidra.streaming import tickets as T

HOUR = 3_600_000
SCHEMA = "ticket string, ts timestamp, text string, resolves boolean"


def brute(rows, end, silence):
    """Closed tickets of (ticket, ms, text, resolves) rows that came in time, at the watermark ``end``."""
    out, by = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    for ticket, ms in by.items():
        held = []
        close = lambda why: out.extend((ticket, i, m[1] * 1000, m[2], why) for i, m in enumerate(held))  # noqa: B023, E731
        for m in ms:
            if held and m[1] - held[-1][1] >= silence:
                close("timed_out")
                held = []
            held.append(m)
            if m[3]:
                close("resolved")
                held = []
        if held and held[-1][1] + silence <= end:
            close("timed_out")
    return sorted(out)


def put(folder, name, rows):
    (folder / name).write_text("".join(json.dumps({"ticket": t, "ts": f"{1_700_000_000 + s // 1000}", "text": x, "resolves": r}) + "\n" for t, s, x, r in rows))


def stream(spark, folder):
    raw = spark.readStream.schema("ticket string, ts string, text string, resolves boolean").option("maxFilesPerTrigger", 1).json(str(folder))
    return raw.withColumn("ts", F.timestamp_seconds(F.col("ts").cast("long")))


def test_restart_gives_equal_rows(spark, tmp_path):
    r = random.Random(1)
    rows = sorted(((f"T{r.randint(0, 5)}", HOUR * i + 1000 * r.randint(0, 3599), f"m{i}", r.random() < 0.2) for i in range(40)), key=lambda x: x[1])
    parts = [rows[:14], rows[14:15], rows[15:30], rows[30:]]
    silence = 5 * HOUR
    base = 1_700_000_000_000

    def read(at):
        return sorted(map(tuple, spark.read.schema(T.CLOSED).parquet(f"{tmp_path}/{at}").collect()))

    want = brute([(t, base + s, x, z) for t, s, x, z in rows], base + rows[-1][1], silence)
    assert {w[4] for w in want} == {"resolved", "timed_out"} and len(want) < len(rows)
    folder = tmp_path / "in"
    folder.mkdir()
    for i, p in enumerate(parts):  # a run for each file: every one starts from the state that the last one left
        put(folder, f"{i}.json", p)
        T.run(stream(spark, folder), silence, f"{tmp_path}/step", f"file://{tmp_path}/cp").awaitTermination(120)
    assert read("step") == want
    T.run(stream(spark, folder), silence, f"{tmp_path}/whole", f"file://{tmp_path}/cp2").awaitTermination(120)
    assert read("whole") == want
    with pytest.raises(ValueError, match="another plan"):
        T.run(stream(spark, folder), silence + 1, f"{tmp_path}/step", f"file://{tmp_path}/cp")


def test_signature():
    assert T.signature({"a": 1, "b": [2]}) == T.signature({"b": [2], "a": 1}) != T.signature({"a": 1, "b": [3]})


@pytest.mark.parametrize("buckets", [1, 1024])
def test_buckets_and_batches(spark, tmp_path, monkeypatch, buckets):
    """Many tickets of a bucket over many batches: some resolved, some silent at the very watermark, one without a name; held messages come out once."""
    monkeypatch.setattr(T, "BUCKETS", buckets)
    r = random.Random(5)
    rows = [(None if i % 9 == 0 else f"T{r.randint(0, 30)}", HOUR * (i // 4) + 60_000 * (i % 4), f"m{i} é\"", r.random() < 0.15) for i in range(400)]
    silence, base = 5 * HOUR, 1_700_000_000_000
    rows.append(("edge", rows[-1][1] - silence, "a", False))
    want = brute([(t or "", base + s, x, z) for t, s, x, z in rows], base + max(x[1] for x in rows), silence)
    rows.sort(key=lambda x: x[1])
    assert {w[4] for w in want} == {"resolved", "timed_out"} and len(want) < len(rows)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(7):
        (folder / f"{i}.json").write_text("".join(json.dumps({"ticket": t, "ts": f"{1_700_000_000 + s // 1000}", "text": x, "resolves": z}) + "\n" for t, s, x, z in rows[i * 60 : i * 60 + 60]))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # the order in which they are read
    T.run(stream(spark, folder), silence, f"{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(300)
    got = sorted((x.ticket or "", *x[1:]) for x in spark.read.schema(T.CLOSED).parquet(f"{tmp_path}/out").collect())
    assert [x for x in got if x[0] != "edge"] == [x for x in want if x[0] != "edge"]
