import base64
import gzip
import hashlib
import io
import zlib

import pytest

from evidra.llm.warc import normalise, op7_warc, parsed, read_member, record, split_records, write_archives


def test_normalise_round_trip():
    recs = [record(i, f"http://x/{i}", b"body\r\n\r\n" * i, "D", None if i % 3 else 9) for i in range(50)]
    whole = gzip.compress(b"".join(recs[:20])) + gzip.compress(b"".join(recs[20:]))
    out = io.BytesIO()
    index = list(normalise(io.BytesIO(whole), out))
    assert len(index) == 50 and gzip.decompress(out.getvalue()) == b"".join(recs)
    for i in (49, 0, 17):
        assert read_member(out, index[i]["offset"], index[i]["length"]) == parsed(recs[i])
        assert zlib.decompress(out.getvalue()[index[i]["offset"] :][: index[i]["length"]], 31) == recs[i]


def test_damage_is_told():
    with pytest.raises(ValueError):
        list(split_records(iter([record(1, None, b"abc", "D", None)[:-5]])))


def want(rows):
    last = {}
    for p, h in rows:
        last[h or ""] = max((x for x in (p, last.get(h or "")) if x is not None), default=None)
    out = []
    for p, h in rows:
        data = (h or "").encode()
        ref = last[h or ""]
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if ref == p else "revisit", None if ref == p else ref))
    return sorted(out, key=str)


def test_query(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(map(tuple, op7_warc(spark, sf_dir).collect()), key=str) == want(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 9), (6, "u", "same"), (6, "u", "same"), (None, "u", "same"), (None, None, "alone"), (None, None, "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha1", "2 as holder")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, op7_warc(spark, str(tmp_path)).collect()), key=str) == want([(p, h) for p, _, h in rows])
    df.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op7_warc(spark, f"{tmp_path}/none").count() == 0
    assert len(write_archives(df, f"file://{tmp_path}/w", least=5)) >= 1
