"""Inserts, updates, upserts, deletes and paging over DataFrames (Parquet has no in-place DML)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both tables' rows, the latest version of each key; a change wins over a base row of the same version."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max(F.struct(version, "_new", *[c for c in rest if c != version])).alias("_row"))  # partial aggregation: no window's sort
    return latest.select(*keys, "_row.*").select(*base.columns)


def update(base: DataFrame, changes: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """base with the non-null fields of the changes to its keys; other keys are ignored.

    Of several changes to a key the one with the latest version counts; without a version they are an error.
    """
    fields = [c for c in changes.columns if c not in (*keys, version)]
    if version:
        best = F.max(F.struct(version, *fields))
    else:
        best = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one change to a key"))).otherwise(F.max(F.struct(*fields)))
    new = changes.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(f"_{c}") for c in fields])
    out = base.join(new, keys, "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(datasets: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Datasets without `gone` (id), and every child table given without the rows of a dataset that goes. Tables that are not given, such as sentences, stay."""
    out = {"dataset": delete(datasets, gone, ["id"])}
    for name, (df, key) in children.items():
        out[name] = df.join(gone.select(F.col("id").alias(key)), key, "left_anti")
    return out


def replace_children(base: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """base with all children of the parents that `fresh` has replaced by fresh's. Doing it twice changes nothing."""
    return delete(base, fresh, [parent]).unionByName(fresh.select(*base.columns))


def soft_delete(df: DataFrame, gone: Column) -> DataFrame:
    return df.withColumn("deleted", F.when(gone, F.lit(1)).otherwise(F.col("deleted")))


def recover(df: DataFrame, back: Column) -> DataFrame:
    return df.withColumn("deleted", F.when(back, F.lit(0)).otherwise(F.col("deleted")))


def page(df: DataFrame, number: int, size: int, order: list) -> DataFrame:
    """Page `number` (from 1) with the table's row count as `total`. The count is an aggregate of its own, not a window over all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def purge(df: DataFrame, moment: str, as_of: Column, interval: str = "INTERVAL 1 DAY") -> DataFrame:
    """Rows no older than the interval; those without a time stay."""
    return df.where(~F.coalesce(F.col(moment) < as_of - F.expr(interval), F.lit(False)))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


#: Rows of a batch insert that go into one file, or into one statement of a database.
BATCH = 2000


def insert(df: DataFrame, path: str, partition: str | None = None, batch: int | None = None) -> None:
    """Appends rows in one commit; batch: rows a file at most."""
    w = df.write.mode("append")
    w = w.option("maxRecordsPerFile", batch) if batch else w
    (w.partitionBy(partition) if partition else w).parquet(path)


def natural_id(*parts: Column) -> Column:
    """An id from a row's natural key, the same on every run: sixty bits of its md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replaces only the partitions that df has, in one commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def apply_spec(df: DataFrame, spec: dict) -> DataFrame:
    """A request's query: {columns, where: [(column, operator, value)], order: [(column, descending)], page, size}, all of them optional.

    Columns are checked against the table and operators against a list, so nothing from a request reaches SQL text.
    Without an order pages are cut by the first column.
    """
    from millrace.operators.predicates import checked

    tests = {
        "=": lambda c, v: c.eqNullSafe(F.lit(v)), "!=": lambda c, v: ~c.eqNullSafe(F.lit(v)), ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
        "in": lambda c, v: c.isin(list(v)), "between": lambda c, v: c.between(*v), "contains": lambda c, v: c.contains(v), "starts": lambda c, v: c.startswith(v), "null": lambda c, v: c.isNull() if v else c.isNotNull(),
    }
    for column, operator, value in spec.get("where", []):
        checked(df, [column])
        if operator not in tests:
            raise ValueError(f"no such operator: {operator}")
        df = df.where(tests[operator](F.col(column), value))
    order = spec.get("order", [])
    checked(df, [c for c, _ in order])
    if order or "page" in spec:
        df = df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order] or [df.columns[0]])
    if "page" in spec:
        df = df.offset((spec["page"] - 1) * spec.get("size", 20)).limit(spec.get("size", 20))
    return df.select(*checked(df, spec["columns"])) if spec.get("columns") else df
