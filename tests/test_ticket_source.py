import json
import os
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from evidra.sources import tickets as T


@pytest.fixture()
def export(tmp_path):
    """Ten tickets a day for twelve days, in two files a day; every fifth one is open."""
    n = 0
    for d in range(12):
        day = date(2024, 3, 1) + timedelta(days=d)
        for part in range(2):
            at = tmp_path / "export" / f"day={day}"
            at.mkdir(parents=True, exist_ok=True)
            with open(at / f"part-{part}", "w") as f:
                for i in range(5):
                    made = datetime(day.year, day.month, day.day, 23 - part * 10 - i, tzinfo=timezone.utc)
                    f.write(json.dumps({"key": f"DEMO-{n}", "created": made.isoformat(), "status": "Open" if n % 5 == 4 else "Resolved", "summary": f"job {n} {'failed' if n % 3 else 'slow'}", "fields": {"b": n, "a": "é"}}) + "\n\n")
                    n += 1
    (tmp_path / "calls").mkdir()
    return T.Export(str(tmp_path / "export"), str(tmp_path / "calls"))


def calls(export):
    n = len(os.listdir(export.calls))
    for f in os.listdir(export.calls):
        os.remove(os.path.join(export.calls, f))
    return n


def test_query_text():
    q = T.Query(start=date(2024, 1, 1), end=date(2024, 2, 1), words=("a", "b"), keys=("K-1",), exclude=("K-2", "K-3"))
    assert q.text() == "project = DEMO AND status = Resolved AND created >= '2024-01-01' AND created < '2024-02-01' AND (summary ~ \"a\" OR summary ~ \"b\") AND key NOT IN (\"K-2\", \"K-3\") AND key IN (\"K-1\") ORDER BY created DESC"


def test_pages_filters_and_limit(spark, export):
    df = T.read(spark, export, pageSize=4, windowDays=3)
    rows = df.collect()
    assert len(rows) == 96 and df.rdd.getNumPartitions() == 4 and {r.status for r in rows} == {"Resolved"}
    assert json.loads(rows[0].fields)["a"] == "é" and sorted(r.key for r in rows) == sorted({r.key for r in rows})
    calls(export)
    df.count()
    whole = calls(export)
    got = df.where((F.col("created") >= "2024-03-11 05:00:00") & ~F.col("key").isin("DEMO-100", "DEMO-101"))
    assert sorted(r.key for r in got.collect()) == sorted(r.key for r in rows if r.created >= datetime(2024, 3, 11, 5) and r.key not in ("DEMO-100", "DEMO-101"))
    pushed = calls(export)
    assert pushed < whole / 3
    assert [r.key for r in df.where("key = 'DEMO-7'").collect()] == ["DEMO-7"] and df.where("key = 'DEMO-7' and key = 'DEMO-8'").count() == 0 and df.where("status = 'Open'").count() == 0
    calls(export)
    newest = T.read(spark, export, pageSize=4, windowDays=1, limit=11).collect()
    assert {r.key for r in newest} == {r.key for r in sorted(rows, key=lambda r: r.created, reverse=True)[:11]} and calls(export) == 3
    assert T.read(spark, export, limit=11).where("key = 'DEMO-0'").count() == 0  # the limit comes first
    assert T.read(spark, export, start="2024-03-02", end="2024-03-04", words=["SLOW"], status="").count() == sum(1 for n in range(10, 30) if n % 3 == 0)


class Flaky:
    """Fails twice a page."""

    def __init__(self):
        self.left = 2

    def page(self, query, token, size):
        if self.left:
            self.left -= 1
            raise T.Busy
        self.left = 2
        i = int(token or 0)
        return T.Page([(f"K-{i}",)] * size, str(i + 1) if i < 2 else None)


def test_retries():
    waits = []
    with pytest.raises(T.Busy):
        T.tried(lambda: (_ for _ in ()).throw(T.Busy()), tries=4, first=1, most=3, jitter=0, sleep=waits.append)
    assert waits == [1, 2, 3]
    assert [r[0] for r in T.walked(Flaky(), T.Query(), 2, wait=0)] == ["K-0", "K-0", "K-1", "K-1", "K-2", "K-2"]
    assert len(list(T.walked(Flaky(), T.Query(), 2, 3, wait=0))) == 3
    with pytest.raises(ValueError):
        T.Plan.of({"service": T.service_option(Flaky()), "pagesize": "0"})


def test_stream_resumes(spark, export, tmp_path):
    """A second run reads only the days that have come since, and a day that isn't over is left for later."""

    def run():
        q = T.read_stream(spark, export, pageSize=4, windowDays=2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out").collect())

    resolved = lambda n: sorted(f"DEMO-{i}" for i in range(n) if i % 5 != 4)
    assert run() == resolved(110)
    calls(export)
    for day in ("2024-03-13", "2024-03-14"):
        os.mkdir(f"{export.root}/day={day}")
        with open(f"{export.root}/day={day}/part-0", "w") as f:
            f.write(json.dumps({"key": f"NEW-{day}", "created": f"{day}T10:00:00Z", "status": "Resolved"}))
    assert run() == sorted([*resolved(120), "NEW-2024-03-13"]) and 0 < calls(export) <= 4


class Counting:
    """An export whose bytes read are counted."""

    def __init__(self, raw, seen):
        self.raw, self.seen = raw, seen

    def read(self, n):
        block = self.raw.read(n)
        self.seen.append(len(block))
        return block


@pytest.mark.parametrize("packed", [False, True])
def test_pages_begin_where_the_last_one_ended(tmp_path, monkeypatch, packed):
    """All tickets come once in order, from lines of any length; a page doesn't read again what came before it."""
    import gzip

    want = []
    for d in (2, 1):
        (tmp_path / f"day=2024-03-0{d}").mkdir()
        for part in range(3):
            rows = [{"key": f"K{d}-{part}-{i}", "created": f"2024-03-0{d}T10:00:00Z", "status": "Resolved" if i % 7 else "Open", "summary": "é" * (i % 50) + "x" * (600_000 if i == 30 else 0)} for i in range(0 if part == 1 else 3000)]
            text = "\n\r\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n" * part
            at = tmp_path / f"day=2024-03-0{d}" / f"part-{part}"
            gzip.open(f"{at}.gz", "wt", encoding="utf-8").write(text) if packed else at.write_text(text, encoding="utf-8")
            want += [r["key"] for r in rows if r["status"] == "Resolved"]
    seen: list = []
    split = T._split
    monkeypatch.setattr(T, "_split", lambda raw, at: split(Counting(raw, seen), at))
    export = T.Export(str(tmp_path))
    assert [r[0] for r in T.walked(export, T.Query(), 100)] == want
    if not packed:
        size = sum(f.stat().st_size for f in tmp_path.glob("*/*"))
        assert sum(seen) < size + len(want) / 100 * 300_000 + 2_000_000
    assert [r[0] for r in T.walked(export, T.Query(), 7, 23)] == want[:23]
    assert export.page(T.Query(), export.page(T.Query(), None, len(want) - 1).token, 5).tickets[0][0] == want[-1] and export.page(T.Query(), None, len(want)).token is None
