"""Block-skipping search: the same rows as a full scan, from fewer blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval, vector_blocks


def clustered(spark, seed=3, clusters=30, each=40, dim=8):
    """Tight groups of directions, of many lengths, with ties, null and zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    rows = [(c * each + k, k % 3, (rng.uniform(0.1, 9) * (centres[c] + 0.1 * rng.standard_normal(dim))).astype(float).tolist()) for c in range(clusters) for k in range(each)]
    rows += [(5000 + k, 0, rows[k][2]) for k in range(20)] + [(6000, 0, None), (6001, 1, [0.0] * dim)]
    return centres, spark.createDataFrame(rows, "id long, kind int, embedding array<double>")


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('blocks')}/t"
    centres, df = clustered(spark)
    vector_blocks.build(df, path, pivots=30)
    return path, centres, df


@pytest.mark.parametrize("k,t", [(1, 0.0), (7, 0.0), (60, 0.5), (500, -2.0), (2000, -2.0), (10, 0.9999)])
def test_same_rows_as_a_full_scan(spark, laid, k, t):
    path, centres, df = laid
    rng = np.random.default_rng(k)
    for v in (centres[3], rng.standard_normal(8), np.array(df.where("id = 5").first().embedding)):
        query = spark.createDataFrame([(v.tolist(),)], "v array<double>")
        got = vector_blocks.search(spark, path, query, ["id", "kind"], t, k).collect()
        assert got == retrieval.knn(df, query, ["id", "kind"], t, k).collect()


def test_most_blocks_are_not_read(spark, laid):
    path, centres, df = laid
    told = vector_blocks.Told()
    query = spark.createDataFrame([(centres[4].tolist(),)], "v array<double>")
    got = vector_blocks.search(spark, path, query, ["id"], 0.0, 10, told=told)
    assert got.count() == 10 and told.blocks >= 25 and len(told.first) + len(told.second) <= 5
    rows = spark.read.parquet(f"{path}/rows").where(F.col("_block").isin(told.first))
    assert rows.count() < df.count() / 4


def test_conditions_and_joins_before_the_best(spark, laid):
    """Flags and joins narrow the matches; the k-th score is that of what passes."""
    path, centres, df = laid
    names = spark.createDataFrame([(0, "a"), (1, "b")], "kind int, name string")
    query = spark.createDataFrame([(centres[9].tolist(),)], "v array<double>")
    got = vector_blocks.search(spark, path, query, ["id", "name"], 0.0, 30, where=F.col("id") % 2 == 0, refine=lambda m: m.join(names, "kind")).collect()
    want = retrieval.top(retrieval.scored(df.where("id % 2 = 0"), query).join(names, "kind"), 0.0, 30).select("id", "name", "similarity").collect()
    assert got == want and len(got) == 30


def test_odd_queries_and_tables(spark, laid, tmp_path):
    path, _, df = laid
    for v in (None, [0.0] * 8):
        assert vector_blocks.search(spark, path, spark.createDataFrame([(v,)], "v array<double>"), ["id"], -2.0, 5).count() == 0
    vector_blocks.build(df.where("id >= 6000"), f"{tmp_path}/none")
    query = spark.createDataFrame([([1.0] * 8,)], "v array<double>")
    assert vector_blocks.search(spark, f"{tmp_path}/none", query, ["id"], -2.0, 5).count() == 0
    vector_blocks.build(df.limit(0), f"{tmp_path}/empty")
    assert vector_blocks.search(spark, f"{tmp_path}/empty", query, ["id"], -2.0, 5).count() == 0
    vector_blocks.build(df.where("id < 3"), f"{tmp_path}/few", pivots=64)
    assert vector_blocks.search(spark, f"{tmp_path}/few", query, ["id"], -2.0, 5).count() == 3
    with pytest.raises(ValueError, match="pivots"):
        vector_blocks.build(df, f"{tmp_path}/x", pivots=0)
