"""Chat records that the answer stream itself completes.

Chunks (message_id, seq from 0, delta, is_end, at) are held per message in a list that grows by appends, so a batch writes its own
chunks and no others; a message that comes whole in one batch is told without it. A message is told once: when its end mark and all chunks before it are there, or, cut short, when
nothing came for `idle` and the watermark has passed. Then its state goes. Each batch of finished messages is merged into
the table of records, which is in partitions; a mark for the batch is set after the merge, and a batch that has one is not
merged again. Without the mark (the driver was lost half-way) the merge runs again and leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.operators import merge
from millrace.streaming.chat import record_fields
from millrace.streaming.feed import disk_state, run_once
from millrace.streaming.fold import Chunks, joined, packed

TOLD = "message_id long, answer_text string, n_chunks long, began timestamp, ended timestamp, whole boolean"
RECORD = "id long, answer_text string, answer_tokens int, run_time double, details string, status string, version long, part int"


class Answers(StatefulProcessor):
    """A message's chunks until it has ended or has been idle too long."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.chunks = handle, Chunks(handle, "n long, last long, began long, ended long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        facts = self.chunks.facts()
        n, last, began, ended, timer = facts or (0, -1, 1 << 62, 0, None)
        new: dict[int, str] = {}
        for r in rows:
            began, ended = min(began, r.began), max(ended, r.ended)
            last = r.last if r.last >= 0 else last
            new.update(zip(r.seqs or (), r.deltas or ()))
        n += len(new)
        if 0 <= last <= n and len(held := (self.chunks.held() | new if facts else new)) >= last:
            if facts:  # a message that came whole in one batch never was in the state
                self.handle.deleteTimer(timer)
                self.chunks.forget()
            yield self._told(key, held, began, ended, True)
            return
        self.chunks.add(new)
        if timer is None:  # later chunks don't move it: when it rings, the message may have gone on
            timer = ended + self.idle_ms
            self.handle.registerTimer(timer)
        self.chunks.value.update((n, last, began, ended, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        facts = self.chunks.facts()
        if facts is None:
            return
        n, last, began, ended, timer = facts
        if ended + self.idle_ms > timerValues.getCurrentWatermarkInMs():  # it went on
            timer = ended + self.idle_ms
            self.handle.registerTimer(timer)
            self.chunks.value.update((n, last, began, ended, timer))
            return
        held = self.chunks.held()
        self.chunks.forget()
        yield self._told(key, held, began, ended, False)

    def close(self) -> None:
        pass

    def _told(self, key, held: dict, began: int, ended: int, whole: bool) -> Row:
        return Row(message_id=key[0], answer_text=joined(held), n_chunks=len(held), began=began, ended=ended, whole=whole)


def finished(chunks: DataFrame, idle_ms: int, late: str) -> DataFrame:
    """Messages that end, of a stream of chunks. late: how far behind the newest chunk one may be, an interval; packed chunks are as late as their newest."""
    rows = packed(chunks).withColumn("at", F.timestamp_millis("ended")).withWatermark("at", late)
    told = rows.groupBy("message_id").transformWithState(Answers(idle_ms), "message_id long, answer_text string, n_chunks long, began long, ended long, whole boolean", "append", "eventTime")
    return told.withColumn("began", F.timestamp_millis("began")).withColumn("ended", F.timestamp_millis("ended"))


def save_batch(spark: SparkSession, records: str, marks: str, batch: DataFrame, number: int, buckets: int) -> bool:
    """Merges a batch of finished messages into the records, unless it has been merged; tells whether it did."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{marks}/batch={number}/_SUCCESS")
    if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return False
    done = record_fields(batch.select(F.col("message_id").alias("id"), "answer_text", F.lit(None).cast("int").alias("message_tokens"), "began", "ended", "whole"))
    done = done.withColumn("status", F.when(F.col("whole"), "done").otherwise("cut")).withColumn("version", F.lit(number + 1).cast("long")).withColumn("part", merge.key_bucket("id", buckets=buckets))
    merge.merge(spark, records, done.select("id", "answer_text", "answer_tokens", "run_time", "details", "status", "version", "part"), ["id"], ["version"], "part")
    spark.range(1).write.mode("overwrite").parquet(f"{marks}/batch={number}")
    return True


def run_finalise(chunks: DataFrame, records: str, work: str, idle_ms: int = 600_000, late: str = "1 hour", buckets: int = 8) -> StreamingQuery:
    """Completes the records of all messages that end in what is there of the stream. work: a folder for checkpoint and marks."""
    spark = chunks.sparkSession
    with disk_state(spark):
        writer = finished(chunks, idle_ms, late).writeStream.outputMode("append").foreachBatch(lambda b, n: save_batch(b.sparkSession, records, f"{work}/marks", b, n, buckets) and None)
        return run_once(writer, f"{work}/checkpoint")
