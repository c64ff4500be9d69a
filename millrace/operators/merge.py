"""Merges into partitioned Parquet tables that rewrite the touched partitions alone.

A merge reads the table's keys to find the partitions that hold a changed one (a semi join over two or three columns), reads
those partitions whole, and replaces them in one commit by dynamic partition overwrite. The other partitions' files are
neither read for their rows nor written again. How many partitions are touched is metadata: their values reach the
driver, at most MANY of them, so that Spark prunes the rest before it reads.

Of repeated changes to a key the one with the latest version counts, and a change wins over a stored row whose version
isn't later. So a merge that runs a second time, or whose changes come in another order, leaves the same rows. A key's
partition is fixed: a change that would move a row is an error. Null keys are keys; null versions are the earliest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch

#: Most partition values that reach the driver.
MANY = 100_000


@dataclass(frozen=True)
class Merged:
    """What a merge did: the values of the partitions that it replaced, and the keys that it changed or added."""

    partitions: list
    changed: int


def latest(changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row for each key: the one with the latest version, and of equal versions the one with the largest fields. Partial results, no sort of whole groups."""
    rest = [c for c in changes.columns if c not in keys and c not in version]
    best = changes.groupBy(*keys).agg(F.max(F.struct(*version, *rest)).alias("_row"))
    return best.select(*keys, "_row.*").select(*changes.columns)


def key_bucket(*keys: str, buckets: int) -> Column:
    """A partition that a key determines."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def create(df: DataFrame, path: str, partition: str) -> None:
    """Writes a table in partitions, each in as few files as its size allows."""
    df.hint("rebalance", partition).write.partitionBy(partition).parquet(path)


def stored(spark: SparkSession, path: str, otherwise) -> DataFrame:
    """The table at path; one that has no rows yet has the schema `otherwise`."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*=*")
    if not list(files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files) or []):
        return spark.createDataFrame([], otherwise)
    return spark.read.parquet(path)


def _replace(df: DataFrame, path: str, partition: str) -> None:
    """One file or a few for each partition that df has, in one commit."""
    df.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _touched(base: DataFrame, new: DataFrame, keys: list[str], partition: str, added: bool) -> list:
    """The partitions that hold a key of `new`, or that rows of `new` belong to."""
    held = base.select(*keys, partition).alias("b").join(new.select(*keys).alias("n"), same_keys("b", "n", keys), "left_semi").select(partition)
    values = (held.union(new.select(partition)) if added else held).distinct().limit(MANY + 1).collect()
    if len(values) > MANY:
        raise ValueError(f"a merge touches more than {MANY} partitions: choose a coarser one")
    return sorted((r[0] for r in values), key=lambda v: (v is None, v))


def in_partitions(partition: str, values: list) -> Column:
    """A condition that prunes partitions."""
    own = F.col(partition).isin([v for v in values if v is not None])
    return own | F.col(partition).isNull() if None in values else own


def merge(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], version: list[str], partition: str, insert: bool = True, patch: bool = False) -> Merged:
    """Puts changes (all columns of the table, or with patch some of them) into the table at path.

    insert: changes to keys that aren't stored add rows, or else they are ignored. patch: null fields leave what is stored,
    as do columns that the changes don't have; those are null in added rows.
    """
    base = stored(spark, path, changes.schema)
    missing = [c for c in base.columns if c not in changes.columns]
    if missing and (not patch or set(missing) & {*keys, *version} or insert and partition in missing):
        raise ValueError(f"changes lack {missing}")
    out = scratch(spark, "merge-changes")
    latest(changes, keys, version).write.parquet(out)  # read three times
    new = spark.read.schema(changes.schema).parquet(out)
    values = _touched(base, new, keys, partition, insert)
    if not values:
        return Merged([], 0)

    old = base.where(in_partitions(partition, values)).withColumn("_old", F.lit(True)).alias("o")
    fresh = new.withColumn("_new", F.lit(True)).alias("n")
    both = old.join(fresh, same_keys("o", "n", keys), "full" if insert else "left")
    at = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in version])
    wins = F.col("n._new").isNotNull() & (F.col("o._old").isNull() | (at("n") >= at("o")))
    if partition in new.columns:
        moved = F.col("n._new").isNotNull() & F.col("o._old").isNotNull() & ~F.col("n." + partition).eqNullSafe(F.col("o." + partition))
        wins = F.when(moved, F.raise_error(F.lit(f"a change would move a row to another {partition}"))).otherwise(wins)
    picked = []
    for c in base.columns:
        if c not in new.columns:
            picked.append(F.col(f"o.{c}").alias(c))
            continue
        field = F.coalesce(f"n.{c}", f"o.{c}") if patch else F.col(f"n.{c}")
        picked.append(F.when(wins, field).otherwise(F.col(f"o.{c}")).alias(c))
    _replace(both.select(*picked), path, partition)
    return Merged(values, new.count())


def remove(spark: SparkSession, path: str, gone: DataFrame, keys: list[str], partition: str) -> Merged:
    """Takes the rows with the keys of `gone` out of the table at path. A partition that has no rows left goes; doing it twice changes nothing."""
    base = stored(spark, path, gone.select(*keys).withColumn(partition, F.lit(None)).schema)
    gone = gone.select(*keys).distinct()
    values = _touched(base, gone, keys, partition, False)
    if not values:
        return Merged([], 0)
    old = base.where(in_partitions(partition, values)).alias("b")
    left = scratch(spark, "merge-left")
    old.join(gone.alias("n"), same_keys("b", "n", keys), "left_anti").write.parquet(left)
    rows = spark.read.schema(base.schema).parquet(left)
    _replace(rows, path, partition)
    kept = {r[0] for r in rows.select(partition).distinct().collect()}
    drop_partitions(spark, path, partition, [v for v in values if v not in kept])
    return Merged(values, gone.count())


def drop_partitions(spark: SparkSession, path: str, partition: str, values: list) -> None:
    """Deletes whole partitions by their folders."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = {f"{partition}={'__HIVE_DEFAULT_PARTITION__' if v is None else jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(v))}" for v in values}
    for name in sorted(names):
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, name), True)
