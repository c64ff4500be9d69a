"""Tables laid out for their reads: lookups that skip row groups, pages by position, dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import scratch

# --- lookups ------------------------------------------------------------------------------------------


def write_sorted(df: DataFrame, path: str, key: str, also: dict[str, int] | None = None, files: int = 8, group_bytes: int = 32 << 20) -> None:
    """Writes df in ranges of its key, each file sorted, so that a lookup by key reads the row groups whose range has it.

    also: secondary keys with about how many values each has; they get Parquet bloom filters, so that a lookup by one of
    them skips the row groups that don't have the value. group_bytes: the size of a row group.
    """
    w = df.repartitionByRange(files, key).sortWithinPartitions(key).write.option("parquet.block.size", group_bytes)
    for name, values in (also or {}).items():
        w = w.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{name}", values)
    w.parquet(path)


def lookup(spark: SparkSession, path: str, column: str, value, columns: list[str]) -> DataFrame:
    """The rows whose column has the value; only these columns and the row groups that may have it are read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(value)).select(*columns)


def lookup_all(spark: SparkSession, path: str, column: str, values: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose column has one of the values (a table with that column)."""
    return spark.read.parquet(path).select(*dict.fromkeys([*columns, column])).join(values.select(column).distinct(), column, "left_semi").select(*columns)


def rows_scanned(df: DataFrame) -> int:
    """Runs df and tells how many rows its Parquet scans gave on, after row groups were skipped."""
    run = df._jdf.queryExecution()
    run.executedPlan().executeCollect()
    plan, total = [run.executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        plan += [children.apply(k) for k in range(children.size())]
        if node.nodeName().endswith("QueryStage"):
            plan.append(node.plan())
    return total


# --- pages by position --------------------------------------------------------------------------------


def after(order: list[tuple[str, bool]], last: dict) -> Column:
    """Rows that come after the row `last` in an order [(column, descending)]; nulls come last in each column."""
    out, same = F.lit(False), F.lit(True)
    for name, descending in order:
        value = last[name]
        if value is not None:
            beyond = F.col(name) < F.lit(value) if descending else F.col(name) > F.lit(value)
            out = out | (same & (beyond | F.col(name).isNull()))
        same = same & F.col(name).eqNullSafe(F.lit(value))
    return out


def page_after(df: DataFrame, order: list[tuple[str, bool]], size: int, last: dict | None = None) -> DataFrame:
    """The next `size` rows after the row `last` (none: the first page). The order must tell all rows apart.

    A page costs the rows that a seek finds and a top-k of its own size, whatever its number: nothing before it is sorted
    or skipped, and on a table that is sorted by the first column its files before `last` aren't read.
    """
    rows = df if last is None else df.where(after(order, last))
    return rows.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]).limit(size)


def next_position(page: DataFrame, order: list[tuple[str, bool]]) -> dict | None:
    """What the next page comes after: the last row of this one, which has at most a page's rows."""
    rows = page.select(*[c for c, _ in order]).collect()
    return rows[-1].asDict() if rows else None


# --- dense ids ----------------------------------------------------------------------------------------


def append_with_ids(df: DataFrame, path: str, name: str = "id") -> tuple[int, int]:
    """Appends df to the table at path with ids that follow those it has, without gaps or collisions; (first id, rows).

    Two passes: the rows are written once; the files' row counts are summed up in the order of their names, which is
    metadata; a row's id is its file's offset and its place in the file. The batch has a folder of its own and a line
    in the table's log. A batch that died before its line is in the log is written again in the same place, with
    the same ids. One writer at a time.
    """
    spark = df.sparkSession
    batch, first = _next_batch(spark, path)
    staged = scratch(spark, "numbered")
    df.write.parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    file = F.col("_metadata.file_name")
    counts = rows.select(file.alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = rows.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    numbered = placed.join(F.broadcast(starts.select("_file", "_start")), "_file").withColumn(name, F.lit(first) + F.col("_start") + F.col("_row"))
    numbered.select(name, *df.columns).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    n = spark.read.schema(df.schema).parquet(f"{path}/rows/batch={batch}").count()
    spark.createDataFrame([(batch, first, n)], "batch int, first long, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch={batch:06d}")
    return first, n


def _next_batch(spark: SparkSession, path: str) -> tuple[int, int]:
    """(number of the next batch, the id that it begins with)."""
    jvm = spark._jvm
    log = jvm.org.apache.hadoop.fs.Path(f"{path}/log/batch=*/_SUCCESS")
    if not list(log.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(log) or []):
        return 0, 0
    last = spark.read.schema("first long, n long").parquet(f"{path}/log/batch=*").agg(F.max(F.struct("first", "n")).alias("x"), F.count(F.lit(1)).alias("batches")).first()
    return last.batches, last.x["first"] + last.x["n"]


def with_ids(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, of batches that are in its log."""
    done = spark.read.schema("batch int").parquet(f"{path}/log").select("batch")
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").join(F.broadcast(done), "batch", "left_semi").drop("batch")
