"""Several tables written in one commit, and children that a commit replaces.

A commit writes its rows of each table under its number and then puts one mark, which makes all of them visible together.
Readers take the numbers that have a mark and let Spark prune the others' folders. A commit that died before its mark was
never there; its number is taken again, and what it left is overwritten. One writer at a time.

Children are replaced without deletes: a commit names the parents whose children it gives (a parent may have none any more),
and a child is current if it is of its parent's last commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """The commits that have a mark."""
    jvm = spark._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{root}/_commits/n=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found)


def write(spark: SparkSession, root: str, tables: dict[str, DataFrame], mark: bool = True) -> int:
    """Adds rows to several tables in one commit, and tells its number. mark: tests leave it out, as a driver does that is lost before it."""
    number = max(_numbers(spark, root), default=-1) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/commit={number}")
    if mark:
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{root}/_commits/n={number}")
    return number


def read(spark: SparkSession, root: str, name: str, schema: str, until: int | None = None) -> DataFrame:
    """A table's rows with the number of their commit. until: the last commit to see, the same for tables that are read together."""
    seen = [n for n in _numbers(spark, root) if until is None or n <= until]
    if not seen:
        return spark.createDataFrame([], f"{schema}, commit int")
    return spark.read.schema(f"{schema}, commit int").parquet(f"{root}/{name}").where(F.col("commit").isin(seen))


def snapshot(spark: SparkSession, root: str) -> int:
    """The last commit; -1 if there is none."""
    return max(_numbers(spark, root), default=-1)


def replace_children(spark: SparkSession, root: str, parents: DataFrame, children: DataFrame, parent: str, more: dict[str, DataFrame] | None = None, mark: bool = True) -> int:
    """In one commit: `children` become all the children of `parents` (a table with the column `parent`), and other tables get their rows."""
    return write(spark, root, {"parents": parents.select(parent).distinct(), "children": children} | (more or {}), mark)


def current_children(spark: SparkSession, root: str, parent: str, parent_type: str, schema: str, until: int | None = None) -> DataFrame:
    """The children of each parent's last commit."""
    last = read(spark, root, "parents", f"{parent} {parent_type}", until).groupBy(parent).agg(F.max("commit").alias("commit"))
    return read(spark, root, "children", schema, until).join(last, [parent, "commit"], "left_semi").drop("commit")
