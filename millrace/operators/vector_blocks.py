"""Exact top-k by cosine over vectors that are laid out in blocks, most of which a search never reads.

Layout: pivots are the centres of a bounded sample (spherical k-means on SAMPLE vectors). Every row goes to the block of its
nearest pivot, a partition of the table, in order of its angle to the pivot. A block's statistics are its pivot and the least
and largest angle.

Search: by the triangle inequality of angles, a row at angle a to a pivot is at least |q - a| away from a query at angle q to
it. So a block's statistics bound its best score. The blocks with the best bounds are read until they hold k matches; the k-th
score then leaves out every block whose bound is below it, and in the blocks that stay a range of angles goes to the
Parquet scan, which skips row groups. The result is that of a full scan. Rows without a direction (null and zero vectors)
have a block of their own that is never read. Pivots and statistics are metadata: at most PIVOTS rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vector import cosine
from millrace.schema import DEFAULT_SIMILARITY, DEFAULT_TOP_N
from millrace.session import reachable

#: Vectors that pivots are fitted on; most pivots.
SAMPLE, PIVOTS = 20_000, 4_096
#: Scores are rounded to six digits; angles are doubles near which cosines are flat.
SLACK, ANGLE_SLACK = 2e-6, 1e-6
NO_DIRECTION = -1


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of unit vectors by spherical k-means; fewer if there are fewer vectors."""
    x = _unit(sample[np.linalg.norm(sample, axis=1) > 0])
    if not len(x):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    pivots = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    for _ in range(rounds):
        near = (x @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(length > 0, sums / np.maximum(length, 1e-300), pivots)
    return pivots


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _placed(pivots: np.ndarray, vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their block and angle."""
        for batch in batches:
            column = batch.column(vector)
            block, angle = np.full(batch.num_rows, NO_DIRECTION, np.int32), np.zeros(batch.num_rows)
            known = np.flatnonzero(~np.array(column.is_null()))
            if len(known) and len(pivots):
                own = column.take(pa.array(known))
                if set(own.value_lengths().unique().to_pylist()) != {pivots.shape[1]}:
                    raise ValueError(f"vectors differ in dimension: {sorted(set(own.value_lengths().to_pylist()))} and {pivots.shape[1]}")
                x = _matrix(own)
                far = np.linalg.norm(x, axis=1) > 0
                near = _unit(x) @ pivots.T
                best = near.argmax(axis=1)
                block[known] = np.where(far, best, NO_DIRECTION)
                angle[known] = np.arccos(np.clip(near[np.arange(len(x)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(block)], names=[*batch.schema.names, "_angle", "_block"])

    return run


def build(rows: DataFrame, path: str, pivots: int = 64, vector: str = "embedding", files: int = 1) -> None:
    """Writes rows in blocks to path. files: into how many files a block is dealt at most."""
    spark = rows.sparkSession
    reachable(spark)
    if not 0 < pivots <= PIVOTS:
        raise ValueError(f"pivots: 1 to {PIVOTS}")
    known = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    sample = known.orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()["v"].combine_chunks()
    found = fit_pivots(_matrix(sample), pivots) if len(sample) else np.zeros((0, 0))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(_placed(found, vector), f"{types}, _angle double, _block int")
    deal = F.pmod(F.xxhash64(vector), F.lit(files))
    placed.repartition("_block", deal).sortWithinPartitions("_block", "_angle").write.partitionBy("_block").parquet(f"{path}/rows")
    spark.createDataFrame([], placed.schema).coalesce(1).write.parquet(f"{path}/schema")
    spread = _rows(spark, path).groupBy("_block").agg(F.count(F.lit(1)).alias("n"), F.min("_angle").alias("nearest"), F.max("_angle").alias("farthest"))
    names = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(found)], "_block int, pivot array<double>")
    spread.join(names, "_block").coalesce(1).write.parquet(f"{path}/blocks")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a laid-out table, which may be empty."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


@dataclass
class Told:
    """What a search read: blocks of all there are, in its first and second pass."""

    blocks: int = 0
    first: list = field(default_factory=list)
    second: list = field(default_factory=list)


def bounds(blocks: list, query: np.ndarray) -> np.ndarray:
    """The best cosine that any row of each block can have."""
    q = _unit(query[None, :])[0]
    angle = np.arccos(np.clip(np.array([np.dot(b.pivot, q) for b in blocks]), -1, 1))
    low, high = np.array([b.nearest for b in blocks]) - ANGLE_SLACK, np.array([b.farthest for b in blocks]) + ANGLE_SLACK
    return np.cos(np.clip(np.maximum(low - angle, angle - high), 0, np.pi))


def _scores(rows: DataFrame, query: np.ndarray, vector: str, similarity: float, refine: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    v = F.lit(query.tolist()).cast("array<double>") if len(query) else F.array().cast("array<double>")
    found = rows.withColumn("similarity", cosine(vector, v, b_squared=F.lit(float((query.astype(np.float64) ** 2).sum())))).where(F.col("similarity") > similarity).drop(vector)
    return refine(found) if refine else found


def search(spark: SparkSession, path: str, query: DataFrame, columns: list[str], similarity: float | None = None, k: int | None = None, vector: str = "embedding", key: str = "id", where: Column | None = None, refine: Callable[[DataFrame], DataFrame] | None = None, told: Told | None = None) -> DataFrame:
    """The best k rows for the one row of query (v): columns and similarity, as a scan of all rows gives them.

    where: a condition on stored columns; refine: joins that matches must pass before the best k are taken.
    """
    t, n = DEFAULT_SIMILARITY if similarity is None else float(similarity), DEFAULT_TOP_N if k is None else k
    told = told if told is not None else Told()
    rows = _rows(spark, path)
    rows = rows if where is None else rows.where(where)
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("_block").collect()
    asked = query.select("v").first()
    v = np.array(asked.v if asked and asked.v is not None else [], np.float64)
    told.blocks = len(blocks)
    best = bounds(blocks, v) if blocks and len(v) and np.linalg.norm(v) > 0 else np.zeros(0)
    order = [i for i in np.argsort(-best, kind="stable").tolist() if best[i] > t - SLACK]

    def top(df: DataFrame) -> DataFrame:
        return df.orderBy(F.desc("similarity"), key).limit(n)

    def read(numbers: list[int], angles: dict[int, tuple[float, float]] | None = None) -> DataFrame:
        own = rows.where(F.col("_block").isin([blocks[i]._block for i in numbers]))
        if angles:
            near = F.lit(False)
            for i in numbers:
                near = near | (F.col("_block") == blocks[i]._block) & F.col("_angle").between(*angles[i])
            own = own.where(near).where(F.col("_angle").between(min(a for a, _ in angles.values()), max(b for _, b in angles.values())))
        return _scores(own, v, vector, t, refine)

    kth, at, held = None, 0, None
    while at < len(order) and kth is None:  # twice as many blocks each time, until they hold k matches
        to = min(len(order), max(2 * at, at + 1))
        while to < len(order) and sum(blocks[i].n for i in order[:to]) < 2 * n:
            to += 1
        told.first = [blocks[i]._block for i in order[:to]]
        held = top(read(order[:to])).persist()
        scores = [r.similarity for r in held.select("similarity").collect()]
        kth, at = (scores[-1] if len(scores) == n else None), to
        if at < len(order) and kth is None:
            held.unpersist()
    if held is None:
        return top(_scores(rows.where(F.lit(False)), v, vector, t, refine)).select(*columns, "similarity")
    first = spark.createDataFrame(held.collect(), held.schema)  # k rows
    held.unpersist()
    rest = [i for i in order[at:] if kth is not None and best[i] >= kth - SLACK]
    told.second = [blocks[i]._block for i in rest]
    if not rest:
        return top(first).select(*columns, "similarity")
    q = _unit(v[None, :])[0]
    reach = float(np.arccos(np.clip(kth - SLACK, -1, 1))) + ANGLE_SLACK
    turned = {i: float(np.arccos(np.clip(np.dot(blocks[i].pivot, q), -1, 1))) for i in rest}
    more = read(rest, {i: (a - reach, a + reach) for i, a in turned.items()})
    return top(first.unionByName(more)).select(*columns, "similarity")
