"""Lookups by layout, pages by position, dense ids, bitmaps, variants, the streamed cache."""

from __future__ import annotations

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import semi
from millrace.operators import cache, layout, stats
from millrace.streaming import embeddings, feed

# --- lookups ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sorted_table(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('sorted')}/t"
    df = spark.range(40_000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("mail"), (F.col("id") % 7).alias("v"))
    layout.write_sorted(df.repartition(5), path, "id", {"mail": 40_000}, files=4, group_bytes=64 << 10)
    return path


def test_a_lookup_reads_the_groups_that_may_have_the_key(spark, sorted_table):
    found = layout.lookup(spark, sorted_table, "id", 12_345, ["id", "v"])
    assert [tuple(r) for r in found.collect()] == [(12_345, 12_345 % 7)]
    assert layout.rows_scanned(found) < 40_000 / 8
    assert layout.rows_scanned(spark.read.parquet(sorted_table).where("v = 3")) == 40_000


def test_bloom_filters_leave_out_groups_by_a_secondary_key(spark, sorted_table):
    mail = spark.range(1).select(F.md5(F.lit("777")).alias("m")).first().m
    found = layout.lookup(spark, sorted_table, "mail", mail, ["id"])
    assert [r.id for r in found.collect()] == [777] and layout.rows_scanned(found) < 40_000 / 4
    middle = layout.lookup(spark, sorted_table, "mail", "7" * 32, ["id"])
    assert middle.count() == 0 and layout.rows_scanned(middle) < 40_000 / 4


def test_many_lookups_and_odd_values(spark, sorted_table):
    asked = spark.createDataFrame([(5,), (5,), (None,), (10**9,)], "id long")
    assert [r.id for r in layout.lookup_all(spark, sorted_table, "id", asked, ["id", "v"]).collect()] == [5]
    assert layout.lookup(spark, sorted_table, "id", None, ["id"]).count() == 0


# --- pages by position --------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [[("a", False), ("id", False)], [("a", True), ("b", False), ("id", True)], [("b", True), ("a", True), ("id", False)]])
def test_pages_cover_the_table_once_and_in_order(spark, order):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for k in range(53)] + [(None, 1, "x")]
    df = spark.createDataFrame(rows, "id long, a int, b string")

    def rank(r):
        key = []
        for name, down in order:
            v = {"id": r[0], "a": r[1], "b": r[2]}[name]
            n = ord(v) if isinstance(v, str) else v
            key.append((v is None, 0 if v is None else -n if down else n))
        return key

    seen, last = [], None
    while page := layout.page_after(df, order, 8, last).collect():
        seen += [tuple(r) for r in page]
        last = layout.next_position(spark.createDataFrame(page, df.schema), order)
    assert seen == sorted(rows, key=rank)


def test_a_late_page_costs_no_offset(spark, sorted_table):
    """The seek reaches the scan: files and row groups before the position are not read."""
    page = layout.page_after(spark.read.parquet(sorted_table).select("id", "v"), [("id", False)], 20, {"id": 39_000})
    assert [r.id for r in page.collect()] == list(range(39_001, 39_021)) and layout.rows_scanned(page) < 40_000 / 4
    assert layout.next_position(page.limit(0), [("id", False)]) is None


# --- ids ------------------------------------------------------------------------------------------------


def test_ids_are_dense_over_appends_and_lost_batches(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(1000).select((F.col("id") % 10).alias("v"))
    assert layout.append_with_ids(rows.repartition(7), path) == (0, 1000)
    assert layout.append_with_ids(rows.limit(0), path) == (1000, 0)
    assert layout.append_with_ids(rows.union(rows).repartition(3), path) == (1000, 2000)
    shutil.rmtree(f"{path}/log/batch=000002")  # that batch was lost before its line: its ids and its place are given again
    assert layout.with_ids(spark, path).count() == 1000
    assert layout.append_with_ids(rows.limit(500), path) == (1000, 500)
    got = layout.with_ids(spark, path)
    assert sorted(r.id for r in got.select("id").collect()) == list(range(1500)) and got.columns == ["id", "v"]


# --- bitmaps --------------------------------------------------------------------------------------------


def test_bitmaps_add_up_over_increments(spark):
    rng = random.Random(2)
    rows = [(f"2024-01-{rng.randrange(1, 29):02d}", rng.choice([None, 0, 1, 32_767, 32_768, 32_769, 5_000_000_000, rng.randrange(100_000)])) for _ in range(800)]
    df = spark.createDataFrame(rows, "day string, u long").withColumn("n", F.monotonically_increasing_id())
    parts = [stats.day_bitmaps(df.where(F.col("n") % 3 == k), F.to_date("day"), "u") for k in range(3)]
    both = stats.merged_bitmaps(*parts)
    for unit in ("day", "week", "month"):
        got = {tuple(r) for r in stats.distinct_users(both, F.trunc("day", unit) if unit != "day" else F.col("day")).collect()}
        want = df.where("u IS NOT NULL").groupBy((F.trunc(F.to_date("day"), unit) if unit != "day" else F.to_date("day")).alias("p")).agg(F.countDistinct("u"))
        assert got == {tuple(r) for r in want.collect()}
    again = stats.merged_bitmaps(both, parts[1])  # an increment that comes twice counts once
    assert {tuple(r) for r in stats.distinct_users(again, F.lit(1)).collect()} == {(1, len({u for _, u in rows if u is not None}))}


# --- variants -------------------------------------------------------------------------------------------


def test_documents_of_mixed_shapes(spark):
    texts = ['{"k": 1, "d": {"x": "a"}}', '{"k": "2", "l": [1, "b", {"q": null}]}', '{"k": null, "l": []}', "[1]", "7", "", None, '{"k": 3', '{"d": {"x": 5, "y": true}}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").withColumn("p", semi.document("t"))
    got = df.select("id", semi.field("p", "$.k", "int").alias("k"), semi.field("p", "$.d.x", "string").alias("x"), semi.broken("t").alias("b")).orderBy("id").collect()
    assert [r.k for r in got] == [1, 2, None, None, None, None, None, None, None]
    assert [r.x for r in got] == ["a"] + [None] * 7 + ["5"]
    assert [r.b for r in got] == [False] * 5 + [True, False, True, False]
    e = semi.elements(df, "p", "$.l").select("id", "place", semi.field("element", "$", "string").alias("v")).collect()
    assert [(r.id, r.place) for r in e] == [(1, 0), (1, 1), (1, 2)] and [r.v for r in e][:2] == ["1", "b"]


def test_merged_schema_types_all_documents(spark):
    texts = ['{"k": 1, "d": {"x": "a"}}', '{"k": "two", "l": [1, 2]}', '{"d": {"y": 2.5}, "n": null}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").withColumn("p", semi.document("t"))
    kind = semi.merged_schema(df, "p")
    assert kind.startswith("STRUCT<") and "k: VARIANT" in kind and "l: ARRAY<BIGINT>" in kind and "VOID" not in kind
    got = semi.typed(df, "p", "x").orderBy("id").select("x.d.x", "x.d.y", "x.l", F.try_variant_get("x.k", "$", "string").alias("k")).collect()
    assert [(r.x, None if r.y is None else float(r.y), r.l, r.k) for r in got] == [("a", None, None, "1"), (None, None, [1, 2], "two"), (None, 2.5, None, None)]


# --- the cache that a stream fills ----------------------------------------------------------------------


def test_each_text_is_computed_once_over_batches(spark, tmp_path):
    """Overlapping batches, a cache that is there already, a batch that runs again, and an answer that fails."""
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    rows = [("aa", "m", 0), ("bbb", "m", 0), ("aa", "m", 0), ("aa", "n", 1), ("bbb", "m", 1), ("c", "m", 1), (None, "m", 1), ("bad", "m", 2), ("c", "m", 2), ("held", "m", 2)]
    known = cache.keyed(spark.createDataFrame([("held", "m")], "text string, model string"))
    path, work = f"{tmp_path}/cache", f"{tmp_path}/work"
    result = lambda t: cache.model_result(t, embed, T.ArrayType(T.DoubleType()), tries=1, at_once=1)
    run = lambda s: embeddings.run_cache(s, known, path, work, result)
    feed.in_steps(spark.createDataFrame(rows, "text string, model string, step int"), "step", [0, 1, 2], f"{work}/in", run)
    assert calls.value == 5  # aa m, bbb m, aa n, c m, bad m
    assert sorted((r.model, r.answer) for r in embeddings.cached(spark, path).collect()) == [("m", [1.0]), ("m", [2.0]), ("m", [3.0]), ("n", [2.0])]
    assert [r.error for r in embeddings.errors(spark, path).collect()] == ["ValueError: no"]
    last = sorted(glob.glob(f"{work}/checkpoint/commits/[0-9]*"))[-1]
    for f in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        if os.path.exists(f):
            os.remove(f)
    run(spark.readStream.schema("text string, model string").parquet(f"{work}/in"))
    assert embeddings.cached(spark, path).count() == 4 and embeddings.errors(spark, path).count() == 1


def test_a_refused_text_does_not_spoil_its_batch(spark):
    def call(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(k, "bad" if k == 11 else None if k == 3 else f"t{k}") for k in range(40)], "id int, t string").coalesce(1)
    got = {r.id: r.x for r in df.select("id", cache.model_result("t", call, T.StringType(), tries=2).alias("x")).collect()}
    assert all(got[k].answer == f"T{k}" and got[k].error is None for k in got if k not in (3, 11))
    assert (got[11].answer, got[11].error, got[3].answer, got[3].error) == (None, "ValueError: refused", None, None)
