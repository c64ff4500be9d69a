"""Running streams: records finished by the stream, retention, the event sink."""

from __future__ import annotations

import glob
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace.operators import merge
from millrace.sources import frames
from millrace.streaming import chat, feed, finalise, retention

CHUNK = "message_id long, seq long, delta string, is_end boolean, at timestamp, step int"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.fixture(scope="module")
def answers(spark, tmp_path_factory):
    """Message 1 ends over two steps with a chunk that comes twice; 2 ends before its last chunk is there; 3 never ends; 4 is one end mark; 5 goes on when its timer rings; 9 moves the clock."""
    root = f"{tmp_path_factory.mktemp('answers')}"
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, 0, "a", False, at(0), 0), (1, 1, "b", False, at(1), 0), (1, 1, "b", False, at(1), 1), (1, 2, "c", False, at(2), 1), (1, 3, "", True, at(4), 1)]
    rows += [(5, 0, "goes", False, at(0), 0), (5, 1, " on", False, at(5), 1), (5, 2, " and on", False, at(1300), 3), (5, 3, "", True, at(1500), 4)]
    rows += [(2, 2, "", True, at(3), 0), (2, 0, "x", False, at(1), 0), (2, 1, "y", False, at(2), 2), (3, 0, "un", False, at(0), 0), (3, 1, "done", False, at(2), 1), (4, 0, "", True, at(5), 1), (9, 0, "tick", False, at(5000), 4)]
    records, work = f"{root}/records", f"{root}/work"
    merge.create(spark.createDataFrame([(k, None, None, None, None, "open", 0, 0) for k in (1, 7)], finalise.RECORD).withColumn("part", merge.key_bucket("id", buckets=4)), records, "part")
    queries = feed.in_steps(spark.createDataFrame(rows, CHUNK), "step", [0, 1, 2, 3, 4], f"{work}/chunks", lambda s: finalise.run_finalise(s, records, work, idle_ms=600_000, late="10 minutes", buckets=4))
    return records, work, queries


def test_records_are_finished_by_the_stream(spark, answers):
    records, _, _ = answers
    got = {r.id: r for r in spark.read.schema(finalise.RECORD).parquet(records).collect()}
    assert {k: (r.answer_text, r.run_time, r.status) for k, r in got.items() if k != 9} == {1: ("abc", 4.0, "done"), 2: ("xy", 2.0, "done"), 3: ("undone", 2.0, "cut"), 4: ("", 0.0, "done"), 5: ("goes on and on", 1500.0, "done"), 7: (None, None, "open")}
    assert got[1].details == '{"chat_step":{"run_time":4.0,"answer_tokens":1,"step_type":"chat_step"}}'


def test_state_of_ended_messages_goes(answers):
    """Timers took the message that never ended; only the clock's is left."""
    told = feed.progress(answers[2])
    assert max(p["state"] for p in told) > told[-1]["state"]


def test_a_replayed_batch_changes_nothing(spark, answers):
    records, work, _ = answers
    before = files(records)
    batch = spark.createDataFrame([(1, "abc", 3, START, START + timedelta(seconds=4), True)], finalise.TOLD)
    assert finalise.save_batch(spark, records, f"{work}/marks", batch, 1, 4) is False and files(records) == before
    rows = sorted(map(tuple, spark.read.schema(finalise.RECORD).parquet(records).collect()))
    version = next(r[6] for r in rows if r[0] == 1)
    other = f"{work}/lost-marks"  # the mark of the batch was lost: the merge runs again
    assert finalise.save_batch(spark, records, other, batch, version - 1, 4) is True
    assert sorted(map(tuple, spark.read.schema(finalise.RECORD).parquet(records).collect())) == rows


EVENT = "id long, ts timestamp, v int, step int"


def test_retention_as_a_running_job(spark, tmp_path):
    """Repeats within and across steps count once, late rows are refused, old days go from the disk, and the state shrinks."""
    day = lambda d, h=0: START + timedelta(days=d, hours=h)
    rows = [(k, day(0, k % 24), k, 0) for k in range(200)] + [(5, day(0, 5), 5, 0)]
    rows += [(7, day(0, 7), 7, 1), (300, day(3), 1, 1), (301, day(0, 22), 1, 1)]  # a repeat and a row, neither too late yet
    rows += [(302, day(0, 23), 1, 2), (300, day(3), 1, 2), (303, day(9), 1, 2), (None, None, 1, 2)]  # too late, a repeat, the newest
    path, work, keep = f"{tmp_path}/live", f"{tmp_path}/work", timedelta(days=6)
    queries = feed.in_steps(spark.createDataFrame(rows, EVENT), "step", [0, 1, 2], f"{work}/in", lambda s: retention.run_retention(s, path, work, "id", "ts", keep, "1 day"))
    schema = "id bigint, ts timestamp, v int"
    assert sorted(r.id for r in retention.live(spark, path, schema, "ts", keep).collect()) == [300, 303]
    assert sorted(os.path.basename(p) for p in glob.glob(f"{path}/day=*")) == ["day=20240104", "day=20240110"]
    told = feed.progress(queries)
    assert max(p["state"] for p in told) >= 200 and told[-1]["state"] <= 2 and sum(p["late"] for p in told) >= 1


def test_a_retention_batch_that_runs_again_is_written_once(spark, tmp_path):
    batch = spark.createDataFrame([(1, START, 1), (2, START + timedelta(days=1), 2)], "id long, ts timestamp, v int")
    schema, keep = "id bigint, ts timestamp, v int", timedelta(days=5)
    assert retention.live(spark, f"{tmp_path}/none", schema, "ts", keep).count() == 0
    for _ in range(2):
        assert retention.save_and_purge(batch, 3, f"{tmp_path}/t", schema, "ts", keep) == []
    assert retention.live(spark, f"{tmp_path}/t", schema, "ts", keep).count() == 2
    later = spark.createDataFrame([(3, START + timedelta(days=6, hours=1), 3)], "id long, ts timestamp, v int")
    assert retention.save_and_purge(later, 4, f"{tmp_path}/t", schema, "ts", keep) == ["20240101"]
    assert [r.id for r in retention.live(spark, f"{tmp_path}/t", schema, "ts", keep).collect()] == [3]


def test_frames_are_read_once_after_a_restart(spark, tmp_path):
    frames.register(spark)
    path, work = f"file://{tmp_path}/sink", f"{tmp_path}/work"
    rows = spark.createDataFrame([(k, f"line {k}\nand «more»", k % 2) for k in range(40)], "id long, text string, step int")

    def push(s):
        return feed.run_once(s.select("id", chat.frames(F.lit("message"), F.col("text")).alias("frame")).writeStream.format(frames.NAME), f"{work}/checkpoint", path)

    feed.in_steps(rows, "step", [0, 1], f"{work}/in", push)
    want = sorted((k, f"event: message\ndata: line {k}\ndata: and «more»\n\n") for k in range(40))
    assert sorted(map(tuple, frames.read(spark, path, "id long, frame string").collect())) == want
    last = sorted(glob.glob(f"{work}/checkpoint/commits/[0-9]*"))[-1]
    os.remove(last)  # the driver was lost after the sink's commit and before the query's: the batch runs again
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    push(spark.readStream.schema("id long, text string").parquet(f"{work}/in"))
    assert len(glob.glob(f"{tmp_path}/sink/data/*.json")) > frames.committed(spark, path).count()
    assert sorted(map(tuple, frames.read(spark, path, "id long, frame string").collect())) == want


def test_an_aborted_batch_leaves_nothing(tmp_path):
    writer = frames.FrameWriter(f"{tmp_path}", ["id", "frame"])
    done = [writer.write(iter([(1, "a"), (2, "b")])), writer.write(iter([]))]
    assert [m.frames for m in done] == [2, 0] and os.listdir(f"{tmp_path}/data") == [done[0].file]
    writer.abort([*done, None], 0)
    assert os.listdir(f"{tmp_path}/data") == []


def test_an_idle_message_is_told_as_it_is(spark, tmp_path):
    """A running fold with timers of processing time: what never ends is told after the idle time, in a later batch."""
    import time

    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    chunk = "message_id long, seq long, delta string, is_end boolean"
    spark.createDataFrame([(1, 0, "a", False), (2, 0, "b", False), (2, 1, "", True)], chunk).write.parquet(src)
    told = chat.fold_stream(spark.readStream.schema(chunk).parquet(src), 1500).writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    q = told.option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            done = spark.read.schema("message_id long, answer_text string, n_chunks long, whole boolean").parquet(out).collect() if os.path.isdir(out) and len(os.listdir(out)) > 0 else []
            if len(done) == 2:
                break
    finally:
        q.stop()
    assert {(r.message_id, r.answer_text, r.whole) for r in done} == {(2, "b", True), (1, "a", False)}
