"""Rolling window features against brute force and SQL."""

from __future__ import annotations

import random
import zlib

from oracle import compare

from millrace.llm import rolling_features as rf

COLUMNS = ["doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars"]


def brute(rows, windows=rf.WINDOWS):
    """rows: (id, grp, t, v, kind)."""
    out = []
    for i, g, t, _, _ in rows:
        for w in windows:
            inside = [r for r in rows if t is not None and r[2] is not None and r[1] == g and t - w <= r[2] < t]
            lengths = sorted(r[3] for r in inside if r[3] is not None)
            m = len(lengths)
            out.append((i, w, t, len(inside), sum(lengths), len({r[4] for r in inside if r[4] is not None}), lengths[-(-m // 2) - 1] if m else None, lengths[-(-75 * m // 100) - 1] if m else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sql(spark):
    assert compare(rf.query(spark, "/root/testdata/sf0.001"), rf.ORACLE, "/root/testdata/sf0.001") == ""


def test_random_rows_over_block_edges(spark):
    rng = random.Random(1)
    kinds, groups = [None, "a", "b", "c"], [None, "", "x", "y"]
    rows = [(k, rng.choice(groups), rng.choice([None, *range(-200_000, 200_000, 1800)]), rng.choice([None, 0, 5, 7, 7, 900]), rng.choice(kinds)) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, grp string, t long, v long, kind string")
    assert got(rf.rolling(df)) == brute(rows)
    small = rf.rolling(df, windows=(1800, 60), blocks=1, buckets=3)
    assert got(small) == brute(rows, (60, 1800))


def test_crowded_moments_are_weighted(spark):
    """Most rows are repeats: the lists hold counts, and a third of all rows has one group and one time."""
    rng = random.Random(2)
    rows = [(k, "x" if k < 400 else rng.choice("yz"), 3600 if k < 400 else 60 * rng.randrange(200), 7 if k < 300 else rng.choice([None, 1, 9]), "a") for k in range(900)]
    assert got(rf.rolling(spark.createDataFrame(rows, "id long, grp string, t long, v long, kind string"))) == brute(rows)


def test_documents(spark, odd_docs, no_docs):
    """Nulls, empty texts, repeated rows, ids whose time is beyond 64 bits, and columns with names that the operator uses."""
    from pyspark.sql import functions as F

    docs = odd_docs.withColumns({"source": F.expr("CASE WHEN doc_id > 3 THEN 's' END"), "lang": F.expr("CASE WHEN doc_id % 2 = 0 THEN 'en' END"), "t": F.lit(1), "grp": F.lit("g"), "id": F.lit(None)})
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(2**63 - 1))).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(-50)))

    def event(i):
        return None if i is None or i > 1 << 60 else 60 * ((i + zlib.crc32(str(i).encode()) % 4000) // 6)

    rows = [(r.doc_id, r.source, event(r.doc_id), None if r.text is None else len(r.text), r.lang) for r in docs.collect()]
    assert got(rf.rolling(rf.document_events(docs)).select("id", *COLUMNS[1:2], "t", *COLUMNS[3:])) == brute(rows)
    none = no_docs.withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    assert rf.rolling(rf.document_events(none)).count() == 0
