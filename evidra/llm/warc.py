"""Operator 7: WARC archives from a whole-file gzip stream to one member per record.

Pages are written as WARC records into one whole-file gzip stream per task (what many tools leave
behind). The normaliser inflates such a stream once, writes every record again as a gzip member of its
own and lists the members' offsets in a sidecar index, one JSON line each. Readers then seek by that
index. Files lie in ``spark.checkpoint.dir`` (any file system that pyarrow opens); each is written
under a name of its attempt and renamed when complete, so a task that runs again does no harm.

Records with equal payloads of at least ``least`` bytes: the row with the largest page_id becomes the
response, the others revisit it. Groups are counted before they move; groups with a large share of all
rows are joined by broadcast (their number is bounded by the share), the others by a hash join.

Defined cases: null html is an empty payload; null urls have no target header; rows of a null page_id are records
of an empty id, which revisit a row of equal payload that has one and else are responses; repeated rows are
written as often as they occur (of equal rows with the largest page_id all are responses); an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import partitions, shared_path, table, written

HOT_SHARE = 1 / 500
#: Raw bytes after which a task begins another archive.
ROLL = 128 << 20
DATE = "1970-01-01T00:00:00Z"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def urn(page: int) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC 1.1 record; a revisit keeps the HTTP head, with the payload's length, and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP head and payload of one record; raises on damaged records."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is not what its header says")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return {"fields": fields, "http": http.decode(), "payload": payload}


def inflated(f: BinaryIO, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip stream, of one or many members, read once."""
    d = zlib.decompressobj(31)
    while chunk := f.read(size):
        while chunk:
            if out := d.decompress(chunk):
                yield out
            chunk = d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)
                chunk = chunk.lstrip(b"\0")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream; holds one record at most."""
    buf = bytearray()
    need = -1
    for c in chunks:
        buf += c
        while True:
            if need < 0:
                at = buf.find(b"\r\n\r\n")
                if at < 0:
                    break
                m = re.search(rb"\r\ncontent-length:\s*(\d+)", bytes(buf[:at]), re.I)
                if not m:
                    raise ValueError("a record has no length")
                need = at + 4 + int(m[1]) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = -1
    if buf:
        raise ValueError("the stream ends inside a record")


def normalise(source: BinaryIO, target: BinaryIO) -> Iterator[dict]:
    """Writes each record of ``source`` as a member of its own; gives the index entries."""
    at = 0
    for raw in split_records(inflated(source)):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = c.compress(raw) + c.flush()
        target.write(member)
        f = parsed(raw)["fields"]
        yield {"offset": at, "length": len(member), "type": f["warc-type"], "id": f["warc-record-id"], "uri": f.get("warc-target-uri"), "digest": f.get("warc-payload-digest")}
        at += len(member)


def read_member(f, offset: int, length: int) -> dict:
    f.seek(offset)
    return parsed(zlib.decompress(f.read(length), 31))


def marked_revisits(pages: DataFrame, least: int) -> DataFrame:
    """Adds ``holder``: the page_id of the response for equal payloads, null where a row is a response."""
    keys = pages.where(F.octet_length("payload") >= least)
    groups = written(keys.groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-groups")
    hot = F.col("n") >= max(2, int(pages.count() * HOT_SHARE))
    few = F.broadcast(groups.where(hot).select(F.col("sha1").alias("hot_sha1"), F.col("holder").alias("hot_holder")))
    out = pages.join(few, pages.sha1 == F.col("hot_sha1"), "left")
    # rows that are settled get a key of their own, so that no group meets in one task
    key = F.when(F.col("hot_holder").isNotNull(), F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).otherwise(F.col("sha1"))
    rest = groups.where(~hot).select(F.col("sha1").alias("join_key"), F.col("holder").alias("cold_holder")).hint("shuffle_hash")
    out = out.withColumn("key", key).join(rest, F.col("key") == F.col("join_key"), "left")
    holder = F.coalesce("hot_holder", "cold_holder")
    return out.select("page_id", "url", "payload", "sha1", F.when(holder == F.col("page_id"), None).when(F.octet_length("payload") >= least, holder).alias("holder"))


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> list[str]:
    """Writes the records as whole-file gzip streams; returns their paths, one or a few for each task."""
    pages = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    pages = marked_revisits(pages, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs.create_dir(base)
        names: list[str] = []
        out = gz = None
        raw = 0

        def close() -> None:
            out.write(gz.flush())
            out.close()
            fs.move(f"{base}/.{attempt}-{len(names)}", f"{base}/{part:06d}-{len(names):04d}.warc.gz")
            names.append(f"{part:06d}-{len(names):04d}.warc.gz")

        for b in batches:
            for p, u, data, sha, holder in zip(*(b.column(c) for c in ("page_id", "url", "payload", "sha1", "holder")), strict=True):
                if out is None:
                    out, gz, raw = fs.open_output_stream(f"{base}/.{attempt}-{len(names)}"), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                rec = record(p.as_py(), u.as_py(), data.as_py(), digest, holder.as_py())
                out.write(gz.compress(rec))
                raw += len(rec)
                if raw >= ROLL:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    return sorted(f"{folder}/{r.name}" for r in pages.mapInArrow(run, "name string").collect())  # archives, not records


def _over(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string").repartition(max(1, min(len(paths), 4 * partitions(spark))))


def normalise_archives(spark: SparkSession, paths: list[str], folder: str) -> list[tuple[str, str]]:
    """(archive, index) of each whole-file stream, one gzip member per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for b in batches:
            for p in b.column("path").to_pylist():
                fs, src = opened(p)
                _, base = opened(folder)
                fs.create_dir(base)
                name, attempt = src.rsplit("/", 1)[1], TaskContext.get().taskAttemptId()
                with fs.open_input_stream(src, compression=None) as f, fs.open_output_stream(f"{base}/.{attempt}-{name}", compression=None) as g, fs.open_output_stream(f"{base}/.{attempt}-{name}.idx") as idx:
                    for entry in normalise(f, g):
                        idx.write(json.dumps(entry).encode() + b"\n")
                for end in ("", ".idx"):
                    fs.move(f"{base}/.{attempt}-{name}{end}", f"{base}/{name}{end}")
                done.append(f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"path": pa.array(done, pa.string())})

    return sorted((r.path, r.path + ".idx") for r in _over(spark, paths).mapInArrow(run, "path string").collect())


def read_archives(spark: SparkSession, archives: list[tuple[str, str]]) -> DataFrame:
    """A row per record, read by its offset in the sidecar index; payloads are held against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("path").to_pylist():
                fs, path = opened(p)
                rows = []
                with fs.open_input_file(path) as f, fs.open_input_stream(path + ".idx", compression=None) as idx:
                    for line in idx.read().splitlines():
                        e = json.loads(line)
                        rows.append(_row(read_member(f, e["offset"], e["length"])))
                for s in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[s : s + 10_000], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    if not archives:
        return spark.createDataFrame([], FIELDS)
    return _over(spark, [a for a, _ in archives]).mapInArrow(run, FIELDS)


def _row(r: dict) -> dict:
    f = r["fields"]
    number = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    digest = f["warc-payload-digest"].removeprefix("sha1:")
    length = int(re.search(r"(?im)^content-length:\s*(\d+)", r["http"])[1])
    if f["warc-type"] == "response" and (len(r["payload"]) != length or base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest):
        raise ValueError(f"{f['warc-record-id']}: the payload is not what its header says")
    return {"page_id": number(f["warc-record-id"]), "payload_bytes": length, "payload_digest": digest, "record_type": f["warc-type"], "refers_to": number(f["warc-refers-to"]) if "warc-refers-to" in f else None}


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, normalised and read back."""
    folder = shared_path(spark, "warc")
    streams = write_archives(table(spark, sf_dir, "pages"), f"{folder}/streams")
    return read_archives(spark, normalise_archives(spark, streams, f"{folder}/archives"))
