"""Sources: Parquet, JSON catalogues, uploaded files, metadata, JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import reachable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_catalogue(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """The rows of a multi-line JSON file {code, data: [...]}."""
    raw = spark.read.schema(f"code int, data array<struct<{item_schema}>>").option("multiLine", True).json(path)
    return raw.select(F.explode("data").alias("item")).select("item.*")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """md5, filename, suffix, file_size of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.md5("content").alias("md5"), name.alias("filename"), suffix(name).alias("suffix"), F.col("length").alias("file_size"))


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([^.]+)$", 1)


def file_url(prefix: str, bucket: Column, target: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix), bucket, target)


def new_uploads(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each (bucket, md5) that is not stored yet: the one with the smallest id."""
    first = incoming.groupBy("bucket_name", "md5").agg(F.min("id").alias("id"))
    fresh = first.join(known.select("bucket_name", "md5"), ["bucket_name", "md5"], "left_anti")
    return incoming.join(fresh.select("id"), "id", "left_semi")


def columns_of(df: DataFrame, name: str) -> list[tuple[str, str, str]]:
    return [(name, f.name, f.dataType.simpleString()) for f in df.schema.fields]


#: The driver of an embedded database that comes with Spark.
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, driver: str | None = None) -> DataFrame:
    """A table of a database, read in parallel ranges of its key."""
    o = {"url": url, "dbtable": name, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**o, **({"driver": driver} if driver else {})).load()
