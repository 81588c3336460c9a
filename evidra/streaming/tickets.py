"""Open tickets as state of a stream: messages wait until their ticket is resolved or falls silent.

Tickets are dealt to buckets by hash, and a bucket's rows of a batch are read together. What a batch leaves open of a
ticket is one packed value of the bucket's state that names the one before it; a batch adds to them and reads them only
when the ticket closes, so neither a batch nor a task holds a ticket that stays open for long. A ticket closes with the
message that resolves it, or when nothing came for ``silence``, by the next message's time or by the watermark,
whichever is seen first: how rows are dealt to batches makes no difference. What comes later opens it anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

CLOSED = "ticket string, seq long, at long, text string, outcome string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that one piece of the output has, and buckets that tickets are dealt to.
PIECE, BUCKETS = 10_000, 1024


class OpenTickets(StatefulProcessor):
    """Of a bucket: each open ticket's next number, last time and newest packed messages; these, with those before them; its next timer."""

    def __init__(self, silence_ms: int) -> None:
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.info = handle.getMapState("info", "ticket string", "n long, last long, newest long")
        self.messages = handle.getMapState("messages", "ticket string, start long", "before long, packed string")
        self.timer = handle.getValueState("timer", "at long")

    def _taken(self, name: str, newest: int, outcome: str) -> Iterator[tuple]:
        """The held messages of a ticket, the newest pack first; they and the ticket leave the state."""
        ticket = json.loads(name)
        while newest >= 0:
            before, packed = self.messages.getValue((name, newest))
            self.messages.removeKey((name, newest))
            yield from ((ticket, seq, at, text, outcome) for seq, at, text in json.loads(packed))
            newest = before
        self.info.removeKey((name,))

    def _wake(self, at: int) -> None:
        """A bucket has one timer, for the ticket that falls silent first."""
        held = self.timer.get() if self.timer.exists() else None
        if held is None or at < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        code, tickets = pd.factorize(pdf["ticket"], use_na_sentinel=False)
        pdf = pdf.assign(code=code).sort_values(["code", "at", "text"], kind="stable", ignore_index=True)
        code, at, done = pdf["code"].to_numpy(), pdf["at"].to_numpy(), pdf["resolves"].to_numpy(bool)
        names = [json.dumps(None if pd.isna(t) else t) for t in tickets]
        held = [self.info.getValue((n,)) for n in names] if self.info.exists() else [None] * len(names)
        first = np.concatenate([[True], code[1:] != code[:-1]])
        silent = np.concatenate([[False], at[1:] - at[:-1] >= 1000 * self.silence])
        begins = first | silent | np.concatenate([[False], done[:-1]])  # a ticket opens, is resolved or falls silent before this row
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(at))
        seq = np.arange(len(at)) - np.repeat(start, end - start)
        last = np.append(first[start[1:]], True)  # the last part of its ticket
        resolved = done[end - 1]
        taken: list[Iterator[tuple]] = []
        lead = np.flatnonzero(first[start])  # of each ticket the first part
        before = {}
        for part in lead.tolist() if any(h is not None for h in held) else []:
            i = int(code[start[part]])
            if held[i] is None:
                continue
            n, late, newest = held[i]
            if at[start[part]] - late >= 1000 * self.silence:
                taken.append(self._taken(names[i], newest, "timed_out"))
                continue
            seq[start[part] : end[part]] += n
            if resolved[part] or not last[part]:
                taken.append(self._taken(names[i], newest, "resolved" if resolved[part] else "timed_out"))
            else:
                before[part] = newest
        rest: list[tuple] = []
        for some in taken:  # before what is left open is put
            for row in some:
                rest.append(row)
                if len(rest) == PIECE:
                    yield _frame(rest)
                    rest = []
        if rest:
            yield _frame(rest)
        open_ = last & ~resolved
        closed = np.repeat(~open_, end - start)
        out = pd.DataFrame({"ticket": pdf["ticket"], "seq": seq, "at": at, "text": pdf["text"], "outcome": np.where(np.repeat(resolved, end - start), "resolved", "timed_out")})[closed]
        for s in range(0, len(out), PIECE):
            yield out.iloc[s : s + PIECE]
        texts, wakes = pdf["text"].to_numpy(), []
        for part in np.flatnonzero(open_).tolist():
            a, b = int(start[part]), int(end[part])
            name = names[int(code[a])]
            packed = json.dumps(list(zip(seq[a:b].tolist(), at[a:b].tolist(), texts[a:b].tolist())))
            self.messages.updateValue((name, int(seq[a])), (before.get(part, -1), packed))
            self.info.updateValue((name,), (int(seq[b - 1]) + 1, int(at[b - 1]), int(seq[a])))
            wakes.append(int(at[b - 1]) // 1000 + self.silence)
        if wakes:
            self._wake(min(wakes))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes all tickets of the bucket that are silent by now; the timer may have been set for one that went on."""
        self.timer.clear()  # this timer is gone already
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = [(name, newest, last // 1000 + self.silence) for (name,), (_, last, newest) in self.info.iterator()]
        rows: list[tuple] = []
        for name, newest, until in held:
            if until <= now:
                for row in self._taken(name, newest, "timed_out"):
                    rows.append(row)
                    if len(rows) == PIECE:
                        yield _frame(rows)
                        rows = []
        if rows:
            yield _frame(rows)
        if left := [until for _, _, until in held if until > now]:
            self._wake(min(left))

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["ticket", "seq", "at", "text", "outcome"])


def closed_tickets(messages: DataFrame, silence_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Messages (ticket, ts, text, resolves) of a stream to those of closed tickets, ``CLOSED``; ``at`` is in microseconds.

    Messages of the same time are ordered by text; rows later than the watermark are dropped, as ever.
    """
    rows = messages.select(F.col("ticket").cast("string").alias("ticket"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("resolves", F.lit(False)).alias("resolves"))
    rows = rows.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts")).withColumn("bucket", F.pmod(F.xxhash64("ticket"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(OpenTickets(silence_ms), CLOSED, "Append", "EventTime")


def signature(plan: Mapping[str, object]) -> str:
    """SHA-256 of what a run depends on, keys in order."""
    return hashlib.sha256(json.dumps(plan, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def guarded(spark: SparkSession, checkpoint: str, plan: Mapping[str, object]) -> str:
    """``checkpoint``, signed by the first run's plan. Another plan is refused with ``ValueError``: its state would be read wrongly."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}-plan")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    mine = signature(plan)
    if fs.exists(path):
        held = spark.read.text(path.toString()).first()[0]
        if held != mine:
            raise ValueError(f"the checkpoint was made by another plan ({held[:12]}, not {mine[:12]})")
        return checkpoint
    out = fs.create(path, True)
    out.write(bytearray(mine.encode()))
    out.close()
    return checkpoint


def run(messages: DataFrame, silence_ms: int, out: str, checkpoint: str, delay: str = "0 seconds") -> StreamingQuery:
    """Reads all there is, appends the messages of closed tickets to ``out`` (Parquet) and stops; runs again from where it was."""
    spark = messages.sparkSession
    at = guarded(spark, checkpoint, {"silence_ms": silence_ms, "delay": delay, "state": "buckets/2", "buckets": BUCKETS})
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        return closed_tickets(messages, silence_ms, delay).writeStream.format("parquet").option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start(out)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
