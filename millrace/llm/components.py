"""Connected components of a graph in a DataFrame: forests of bounded parts, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import remove, trimmed, written_with_sums

#: Edges that one task contracts to a forest.
PART = 1_000_000


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n members' component, by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the smallest node of its component there, itself left out."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = components(len(ids), place[: len(a)], place[len(a) :])
    own = np.flatnonzero(label != np.arange(len(ids)))
    for at in range(0, len(own), 50_000):
        some = own[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"a": pa.array(ids[some]), "b": pa.array(ids[label[some]])})


def stars(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (a, b): each node with the smallest node of its component, itself left out.

    Each PART edges are first contracted to a forest by one task; where one part holds all, that is the result. Then
    minima are aggregated before each shuffle, and each round's edges are written to the shared folder, where the job that
    writes them also observes whether they changed; the round before is deleted. Joins run on the side with one row a
    node, so AQE splits the rows of a hub.
    """
    spark = edges.sparkSession

    def kept(some: DataFrame) -> tuple[DataFrame, tuple[int, int], str]:
        df, seen, folder = written_with_sums(some.where("a <> b").distinct(), "edges", n=F.count(F.lit(1)), total=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        return df, (seen["n"], int(seen["total"] or 0)), folder

    edges, now, folder = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if now[0]:
        parts, old = -(-now[0] // PART), folder
        edges, now, folder = kept(edges.repartition(parts).mapInArrow(trimmed(_forest), "a long, b long"))
        remove(spark, old)
        if parts == 1:
            return edges
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # In `large` every edge goes from a node to a smaller one; each node links its smaller neighbours to their least.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        before, old = now, folder
        edges, now, folder = kept(small)
        remove(spark, old)
        if before == now:
            break
    return edges
