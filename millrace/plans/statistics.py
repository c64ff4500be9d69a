"""Counts, trends and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import stats
from millrace.plans.ctes import with_tables
from millrace.plans.registry import register
from millrace.sources import knowledge as kb
from millrace.sources.readers import table


@register(
    with_tables(
        """SELECT ds.id, ds.name, (SELECT count(*) FROM app WHERE app.dataset_id = ds.id) AS application_mapping_count, (SELECT count(*) FROM dd WHERE dd.dataset_id = ds.id) AS document_count,
        (SELECT CAST(sum(n_chars) AS BIGINT) FROM dd WHERE dd.dataset_id = ds.id) AS char_length FROM (SELECT id, name FROM ds UNION ALL SELECT 1000000, 'empty') ds""",
        "ds", "dd", "app",
    )
)
def dataset_page_stats(spark: SparkSession, d: str) -> DataFrame:
    """A dataset without documents has no length, which is not a length of zero."""
    docs = table(spark, d, "documents").select(F.expr(kb.DATASET).alias("dataset_id"), "n_chars")
    datasets = kb.datasets(spark, d).select("id", "name").unionByName(spark.range(1).select(F.lit(1_000_000).alias("id"), F.lit("empty").alias("name")))
    return stats.dataset_stats(datasets, docs, kb.applications(spark, d))


@register(
    """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events),
    s AS (SELECT CAST(unnest(generate_series(min(day) - INTERVAL 2 DAY, max(day) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
    a AS (SELECT day, count(*) FILTER (event_type = 'purchase') AS star_num, count(*) FILTER (event_type = 'error') AS trample_num, CAST(sum(tokens) AS BIGINT) AS tokens_num, count(*) AS chat_record_count, count(DISTINCT user_id) AS customer_num FROM e GROUP BY day),
    f AS (SELECT day, count(*) AS customer_added_count FROM (SELECT user_id, min(day) AS day FROM e GROUP BY user_id) GROUP BY day)
    SELECT s.day, coalesce(star_num, 0) AS star_num, coalesce(trample_num, 0) AS trample_num, coalesce(tokens_num, 0) AS tokens_num, coalesce(chat_record_count, 0) AS chat_record_count,
    coalesce(customer_num, 0) AS customer_num, coalesce(customer_added_count, 0) AS customer_added_count FROM s LEFT JOIN a ON a.day = s.day LEFT JOIN f ON f.day = s.day"""
)
def daily_trend_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    """The spine reaches two days beyond the events on either side, so it has days of zeros."""
    e = table(spark, d, "events")
    span = e.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return stats.daily_trend(e, stats.spine(span, F.date_sub("a", 2), F.date_add("b", 2)))


@register("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_tokens, count(*) AS calls FROM events GROUP BY event_type")
def token_usage_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total_tokens"), F.count(F.lit(1)).alias("calls"))


@register("SELECT user_id, round((epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) / 1000.0, 3) AS run_time FROM events GROUP BY user_id")
def elapsed_seconds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    return e.select("user_id", F.round((F.unix_millis("b") - F.unix_millis("a")) / 1000.0, 3).alias("run_time"))


@register("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL")
def grouped_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
