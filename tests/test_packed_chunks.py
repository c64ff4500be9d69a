"""Chunks of answers are packed before they are shuffled and held."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from millrace.streaming import chat, fold

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_a_row_for_each_message(spark):
    at = lambda k: START + timedelta(seconds=k)
    rows = [(1, k, f"w{k}", False, at(k)) for k in range(50)] + [(1, 50, "", True, at(60)), (1, 3, "w3", False, at(3)), (2, 0, "", True, at(1)), (None, 0, "x", None, at(2)), (3, 0, None, False, at(4))]
    got = {r.message_id: r for r in fold.packed(spark.createDataFrame(rows, "message_id long, seq long, delta string, is_end boolean, at timestamp").coalesce(1)).collect()}
    assert len(got) == 4
    zero = int(START.timestamp() * 1000)
    assert (got[1].seqs, got[1].deltas) == ([*range(50), 3], [*(f"w{k}" for k in range(50)), "w3"])
    assert (got[1].last, got[1].began, got[1].ended) == (50, zero, zero + 60_000)
    assert (got[2].seqs, got[2].last, got[2].began) == (None, 0, zero + 1_000)
    assert (got[None].seqs, got[None].deltas, got[None].last) == ([0], ["x"], -1) and got[3].deltas == [None]


def test_the_fold_gets_packed_chunks(spark, tmp_path):
    """Each word was a row of the stream's shuffle and of its groups before."""
    src = f"{tmp_path}/chunks"
    rows = [(m, k, f"{k} ", False) for m in range(5) for k in range(30)] + [(m, 30, "", True) for m in range(4)]
    chunks = spark.createDataFrame(rows, "message_id long, seq long, delta string, is_end boolean").coalesce(1)
    chunks.write.parquet(src)
    asked = []
    real = chat.packed
    chat.packed = lambda c: asked.append(c.columns) or real(c)
    try:
        got = chat.run_fold(spark, src, f"{tmp_path}/out", f"{tmp_path}/state").collect()
    finally:
        chat.packed = real
    assert asked and sorted(map(tuple, got)) == [(m, "".join(f"{k} " for k in range(30)), 30) for m in range(4)]
