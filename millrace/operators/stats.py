"""Per-dataset statistics, daily trends, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dataset_stats(datasets: DataFrame, documents: DataFrame, mappings: DataFrame) -> DataFrame:
    """Counts of mapped applications and of documents (0 without any) and the sum of lengths (null without any)."""
    maps = mappings.groupBy(F.col("dataset_id").alias("id")).agg(F.count(F.lit(1)).alias("application_mapping_count"))
    docs = documents.groupBy(F.col("dataset_id").alias("id")).agg(F.count(F.lit(1)).alias("document_count"), F.sum("n_chars").alias("char_length"))
    out = datasets.join(maps, "id", "left").join(docs, "id", "left")
    return out.select("id", "name", F.coalesce("application_mapping_count", F.lit(0)).alias("application_mapping_count"), F.coalesce("document_count", F.lit(0)).alias("document_count"), "char_length")


def spine(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row for each day from start to end, both included; df gives the session and may be an aggregate that start and end read."""
    return df.select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).alias("day"))


def daily_trend(events: DataFrame, days: DataFrame) -> DataFrame:
    """For each day of the spine: stars, tramples, tokens, records, customers and customers seen for the first time; zero without any."""
    e = events.select(F.to_date("ts").alias("day"), "event_type", "user_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    daily = e.groupBy("day").agg(
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("star_num"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("trample_num"),
        F.sum("tokens").alias("tokens_num"),
        F.count(F.lit(1)).alias("chat_record_count"),
        F.countDistinct("user_id").alias("customer_num"),
    )
    added = e.groupBy("user_id").agg(F.min("day").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("customer_added_count"))
    out = days.join(daily, "day", "left").join(added, "day", "left")
    return out.select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("star_num", "trample_num", "tokens_num", "chat_record_count", "customer_num", "customer_added_count")])


def permission_strings(operations: DataFrame, targets: DataFrame) -> DataFrame:
    """TYPE:OPERATION:id for each operation of a target's type. Spark broadcasts the operations where their size allows it."""
    return targets.join(operations, "type").select(F.concat_ws(":", "type", "operation", F.col("id").cast("string")).alias("permission"))


def existence(rows: DataFrame, others: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows and whether others have their key."""
    keys = others.select(*on).distinct().withColumn(name, F.lit(True))
    return rows.join(keys, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def day_bitmaps(events: DataFrame, day: Column, user: str) -> DataFrame:
    """Who was there, as bitmaps: day, bucket, bits. Counts of distinct users can be added up from them over days and increments, without the events."""
    own = events.where(F.col(user).isNotNull()).select(day.alias("day"), F.bitmap_bucket_number(user).alias("bucket"), F.bitmap_bit_position(user).alias("bit"))
    return own.groupBy("day", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged_bitmaps(*parts: DataFrame) -> DataFrame:
    """The bitmaps of several increments as one: a day's late events don't need its earlier ones."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("day", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_users(bitmaps: DataFrame, period: Column, name: str = "period") -> DataFrame:
    """Exact distinct users of each period (a day, a week, all) from the days' bitmaps."""
    wide = bitmaps.groupBy(period.alias(name), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return wide.groupBy(name).agg(F.sum(F.bitmap_count("bits")).alias("users"))
