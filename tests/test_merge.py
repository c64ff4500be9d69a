"""Merges that rewrite only what they touch."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dml, merge

SCHEMA = "id long, day string, v int, note string, version long"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def rows(spark, path):
    return sorted((tuple(r) for r in spark.read.parquet(path).select("id", "day", "v", "note", "version").collect()), key=repr)


def made(spark, path, n=40):
    base = [(k, f"d{k % 8}", k, "old", 1) for k in range(n)] + [(None, None, 5, "no key", 1)]
    merge.create(spark.createDataFrame(base, SCHEMA).repartition(2, "day"), path, "day")
    return base


def test_untouched_files_keep_their_names(spark, tmp_path):
    path = f"{tmp_path}/t"
    base = made(spark, path)
    before = files(path)
    changes = [(3, "d3", 30, "new", 2), (11, "d3", None, "new", 2), (100, "d5", 1, "added", 1), (None, None, 6, "null key", 2)]
    told = merge.merge(spark, path, spark.createDataFrame(changes, SCHEMA), ["id"], ["version"], "day")
    after = files(path)
    assert told.partitions == ["d3", "d5", None] and told.changed == 4
    same = {f for f in before if after.get(f) == before[f]}
    assert {os.path.basename(os.path.dirname(f)) for f in before.keys() - same} == {"day=d3", "day=d5", "day=__HIVE_DEFAULT_PARTITION__"}
    assert {os.path.basename(os.path.dirname(f)) for f in same} == {f"day=d{k}" for k in (0, 1, 2, 4, 6, 7)}
    changed = {c[0]: c for c in changes}
    assert rows(spark, path) == sorted([changed.pop(b[0], b) for b in base] + list(changed.values()), key=repr)
    read = spark.read.parquet(path).select("day", F.col("_metadata.file_path").alias("file")).distinct().where("day = 'd0'").collect()
    assert {os.path.basename(r.file) for r in read} <= {os.path.basename(f) for f in before}


def test_merges_in_any_order_and_twice(spark, tmp_path):
    """Repeated keys are resolved by version; random batches in another order, or given twice, leave the same table."""
    rng = random.Random(6)
    log = [(k := rng.randrange(60), f"d{k % 8}", rng.choice([None, 1, 2]), rng.choice("ab"), rng.randrange(2, 40)) for _ in range(300)]
    ends = []
    for order in (1, -1):
        path = f"{tmp_path}/t{order}"
        base = made(spark, path)
        for part in [log[:100], log[100:200], log[200:], log[50:150]][::order]:
            merge.merge(spark, path, spark.createDataFrame(part, SCHEMA), ["id"], ["version"], "day")
        ends.append(rows(spark, path))
    best = {}
    for r in base + log:
        best[r[0]] = max(best.get(r[0], r), r, key=lambda x: (x[4], x[2] is not None, x[2] or 0, x[3]))
    assert [(r[0], r[4]) for r in ends[0]] == [(r[0], r[4]) for r in ends[1]] == [(r[0], r[4]) for r in sorted(best.values(), key=repr)]


def test_patch_keeps_what_is_null(spark, tmp_path):
    path = f"{tmp_path}/t"
    made(spark, path, 10)
    patch = spark.createDataFrame([(3, None, 2), (4, 44, 2), (4, 43, 1), (99, 1, 5), (5, 7, 0)], "id long, v int, version long")
    told = merge.merge(spark, path, patch, ["id"], ["version"], "day", insert=False, patch=True)
    got = {r[0]: r for r in rows(spark, path)}
    assert told.partitions == ["d3", "d4", "d5"] and len(got) == 11
    assert (got[3][2:], got[4][2:], got[5][2:]) == ((3, "old", 2), (44, "old", 2), (5, "old", 1))


def test_a_row_can_not_move(spark, tmp_path):
    path = f"{tmp_path}/t"
    base = made(spark, path)
    with pytest.raises(Exception, match="another day"):
        merge.merge(spark, path, spark.createDataFrame([(3, "d4", 1, "x", 2)], SCHEMA), ["id"], ["version"], "day")
    assert rows(spark, path) == sorted(base, key=repr)


def test_no_changes_and_lacking_columns(spark, tmp_path):
    path = f"{tmp_path}/t"
    made(spark, path)
    before = files(path)
    assert merge.merge(spark, path, spark.createDataFrame([], SCHEMA), ["id"], ["version"], "day") == merge.Merged([], 0)
    with pytest.raises(ValueError, match="lack"):
        merge.merge(spark, path, spark.createDataFrame([(1, 2)], "id long, version long"), ["id"], ["version"], "day")
    assert files(path) == before


def test_remove_drops_empty_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    made(spark, path)
    gone = spark.createDataFrame([(k,) for k in (3, 11, 19, 27, 35, 4, 4, 777)], "id long")
    for _ in range(2):
        merge.remove(spark, path, gone, ["id"], "day")
        left = {r[0] for r in rows(spark, path)}
        assert left == {None, *range(40)} - {3, 11, 19, 27, 35, 4} and not os.path.exists(f"{path}/day=d3")


def test_update_with_repeated_changes(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], "id long, v string, n int")
    twice = spark.createDataFrame([(1, "x", 5), (1, "y", 4), (None, "z", 9)], "id long, v string, at int")
    got = dml.update(base, twice, ["id"], version="at")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "x", 1), (2, "b", 1), (None, "n", 1)], key=repr)
    with pytest.raises(Exception, match="more than one change"):
        dml.update(base, twice.drop("at"), ["id"]).collect()


def test_a_table_without_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    none = spark.createDataFrame([], SCHEMA)
    merge.create(none, path, "day")
    assert merge.remove(spark, path, spark.createDataFrame([(1,)], "id long"), ["id"], "day") == merge.Merged([], 0)
    merge.merge(spark, path, none, ["id"], ["version"], "day")
    merge.merge(spark, path, spark.createDataFrame([(1, "d1", 1, "x", 1), (2, "d2", 2, "y", 1)], SCHEMA), ["id"], ["version"], "day")
    assert rows(spark, path) == [(1, "d1", 1, "x", 1), (2, "d2", 2, "y", 1)]
