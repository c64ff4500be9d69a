"""Norm-bucketed hard negatives against brute force and SQL."""

from __future__ import annotations

import math
import random

import numpy as np
from oracle import compare

from millrace.llm import hard_negatives as hn

SCHEMA = "vec_id long, label long, embedding array<double>"


def brute(rows, positives=5, negatives=10, every=100):
    """The contract, in whole numbers; rows with nulls or non-finite components take no part."""
    use = [(v, lab, [math.floor(256 * x) for x in e]) for v, lab, e in rows if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, (v, lab, e) in enumerate(use):
        if v is None or v % every:
            continue
        scores = [(sum(a * b for a, b in zip(e, f)), w, m == lab) for j, (w, m, f) in enumerate(use) if j != i]
        for ps, p, _ in sorted((s for s in scores if s[2]), key=order)[:positives]:
            fits = sorted((s for s in scores if not s[2] and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:negatives]
            out += [(v, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sql(spark):
    assert compare(hn.query(spark, "/root/testdata/sf0.001"), hn.ORACLE, "/root/testdata/sf0.001") == ""


def test_odd_rows_in_small_buckets(spark):
    """Norms far apart, ties, repeated rows, nulls anywhere, shorter and empty vectors, over many buckets and blocks."""
    rng = random.Random(3)
    near = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(3)]
    rows = []
    for k in range(500):
        label = rng.randrange(3)
        size = rng.choice([0.2, 1, 1, 9])
        rows.append((k, label, [size * (x + rng.gauss(0, 0.5)) for x in near[rng.randrange(3)]]))
    rows += [rows[0], rows[100], rows[7], (600, 1, near[1]), (601, 0, near[1]), (602, 0, near[1]), (603, None, near[0]), (604, 1, None), (605, 1, [1.0, None]), (700, 1, [float("inf"), 1.0]), (701, 1, [float("nan")]), (None, 0, near[1]), (None, 0, near[1]), (800, 0, near[0][:2]), (900, 2, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, bucket int, norms string").repartition(3)
    want = brute(rows)
    assert len(want) > 200 and got(hn.mine(df, size=40, block=2)) == want
    assert got(hn.mine(df)) == want


def test_scores_beyond_doubles(spark):
    rng = random.Random(5)
    rows = [(k, k % 2, [rng.randrange(1 << 20) * 1.0 for _ in range(3)]) for k in range(120)]
    rows = [(v, lab, [x * 8 + 1 for x in e]) for v, lab, e in rows]
    rows += [(200, 0, [float(1 << 22), 3.0, float(1 << 21)]), (201, 0, [float(1 << 22), 5.0, 7.0])]
    assert any(s > 1 << 53 for *_, s in brute(rows))
    assert got(hn.mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_fewer_than_asked_and_empty(spark):
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (100, 5, [1.0]), (300, 1, [-1.0])]
    assert got(hn.mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows) != []
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(1, 1, [1.0])], SCHEMA)).count() == 0


def test_short_buckets_are_left_out(spark):
    """With norms far apart, most buckets are never scored, and the result is the same."""
    rng = np.random.default_rng(1)
    norms = np.concatenate([np.full(200, 8.0), np.full(4000, 0.25)])
    v = rng.standard_normal((4200, 16))
    v *= (norms / np.linalg.norm(v, axis=1))[:, None]
    ids = np.concatenate([np.arange(0, 20_000, 100), np.arange(1, 4001) * 100 + 7])
    rows = spark.createDataFrame([(int(i), k % 2, x.tolist()) for k, (i, x) in enumerate(zip(ids, v))], SCHEMA)
    buckets = [hn.opened(r.asDict()) for r in sorted(hn.buckets_of(rows, size=100).collect(), key=lambda r: r.bucket)]
    assert [b["longest"] for b in buckets] == sorted((b["longest"] for b in buckets), reverse=True) and len(buckets) >= 42
    block = next(hn._anchors(100, 50)([_batch(buckets[0])])).to_pylist()[0]
    told: dict = {}
    found = hn.search_block(hn.opened(block), buckets, 5, True, told)
    assert len(found) == 5 * block["n"] and told["pairs"] < len(buckets) / 4


def _batch(bucket):
    import pyarrow as pa

    whole = {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in bucket.items()}
    return pa.RecordBatch.from_pylist([{k: bytes(v) if isinstance(v, bytearray) else v for k, v in whole.items()}])
