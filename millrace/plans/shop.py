"""Merges, streams, paging and lookups over the shop's tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import merge
from millrace.plans.registry import register
from millrace.session import scratch
from millrace.sources import frames
from millrace.sources.readers import table
from millrace.streaming import chat, feed, finalise, retention

_STATE = ["client_id", "source", "segment", "city", "balance", "gone", "seq", "change_id"]


def _client_table(spark: SparkSession, d: str, path: str) -> None:
    """Clients as they are at first, in partitions by their key; `seq` and `change_id` are the version of a row."""
    base = table(spark, d, "clients").select("client_id", "source", "segment", "city", "balance", F.lit(False).alias("gone"), F.lit(-1).cast("long").alias("seq"), F.lit(-1).cast("long").alias("change_id"))
    merge.create(base.withColumn("part", merge.key_bucket("client_id", buckets=16)), path, "part")


_MERGED = """WITH c AS (SELECT client_id, source, segment, city, balance, op = 'D' AS gone, seq, change_id FROM client_changes QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST, source DESC NULLS LAST, segment DESC NULLS LAST, city DESC NULLS LAST, balance DESC NULLS LAST, op = 'D' DESC NULLS LAST) = 1)
SELECT coalesce(c.client_id, b.client_id) AS client_id, CASE WHEN c.client_id IS NULL THEN b.source ELSE c.source END AS source, CASE WHEN c.client_id IS NULL THEN b.segment ELSE c.segment END AS segment, CASE WHEN c.client_id IS NULL THEN b.city ELSE c.city END AS city, CASE WHEN c.client_id IS NULL THEN b.balance ELSE c.balance END AS balance, coalesce(c.seq, -1) AS seq
FROM clients b FULL JOIN c ON c.client_id = b.client_id WHERE NOT coalesce(c.gone, false)"""


@register(_MERGED)
def merge_client_changes(spark: SparkSession, d: str) -> DataFrame:
    """A log of inserts, updates and deletes merged month by month, the last month first: late and repeated changes don't undo later ones. A deleted client stays as a marker, so that an older change doesn't bring it back."""
    path = scratch(spark, "clients")
    _client_table(spark, d, path)
    log = table(spark, d, "client_changes").withColumn("gone", F.col("op") == "D").withColumn("part", merge.key_bucket("client_id", buckets=16))
    late = F.coalesce(F.col("valid_at") >= F.lit("2024-03-01").cast("timestamp_ntz"), F.lit(False))
    for own in (late, ~late):
        merge.merge(spark, path, log.where(own).select(*_STATE, "part"), ["client_id"], ["seq", "change_id"], "part")
    return spark.read.parquet(path).where("NOT gone").select("client_id", "source", "segment", "city", "balance", "seq")


@register(
    """WITH s AS (SELECT sale_id, sum(quantity) AS units, sum(CASE WHEN flag = 'returned' THEN 1 ELSE 0 END) AS returned FROM sale_lines WHERE shipped_at >= TIMESTAMP '2024-04-20' GROUP BY 1)
    SELECT sale_id, client_id, CASE WHEN s.sale_id IS NOT NULL THEN 'shipped' ELSE status END AS status, total FROM sales LEFT JOIN s USING (sale_id)"""
)
def merge_touched_days(spark: SparkSession, d: str) -> DataFrame:
    """Sales in partitions by day; those with lines shipped late become `shipped`. Only days that hold one of them are written again; lines of unknown sales add nothing."""
    path = scratch(spark, "sales-by-day")
    sales = table(spark, d, "sales").select("sale_id", "client_id", "status", "total", F.to_date("sold_at").alias("day"), F.lit(0).alias("version"))
    merge.create(sales, path, "day")
    shipped = table(spark, d, "sale_lines").where("shipped_at >= timestamp_ntz'2024-04-20'").select("sale_id", F.lit("shipped").alias("status"), F.lit(1).alias("version")).where("sale_id IS NOT NULL")
    merge.merge(spark, path, shipped, ["sale_id"], ["version"], "day", insert=False, patch=True)
    return spark.read.schema(sales.schema).parquet(path).select("sale_id", "client_id", "status", "total")


_TOKENS = "CAST(len(regexp_extract_all(answer_text, '[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\r\\n]')) AS INT)"


@register(
    f"""WITH m AS (SELECT conv_id * 1000 + turn AS id, text AS answer_text, len(string_split(text, ' ')) AS n, turn % 5 = 4 AS cut FROM conversations),
    r AS (SELECT id, answer_text, {_TOKENS} AS answer_tokens, round(((n - CASE WHEN cut THEN 1 ELSE 0 END) * 50) / 1000.0, 3) AS run_time, CASE WHEN cut THEN 'cut' ELSE 'done' END AS status FROM m)
    SELECT id, answer_text, answer_tokens, CAST(run_time AS DOUBLE) AS run_time, status, '{{"chat_step":{{"run_time":' || CAST(CAST(run_time AS DOUBLE) AS VARCHAR) || ',"answer_tokens":' || answer_tokens || ',"step_type":"chat_step"}}}}' AS details FROM r"""
)
def chat_finalise_stream(spark: SparkSession, d: str) -> DataFrame:
    """Answers arrive word by word in three steps, out of order; the stream completes their records as they end, and those that never end once they have been idle for ten minutes."""
    c = table(spark, d, "conversations").withColumn("message_id", F.expr("conv_id * 1000 + turn")).withColumn("start", F.expr("1700000000000 + (conv_id % 1000) * 10"))
    words = c.select("message_id", "start", F.posexplode(F.split("text", " ")).alias("k", "w"))
    moment = lambda k: F.timestamp_millis(F.col("start") + k * 50)
    chunks = words.select("message_id", F.col("k").cast("long").alias("seq"), F.concat(F.when(F.col("k") > 0, " ").otherwise(""), "w").alias("delta"), F.lit(False).alias("is_end"), moment(F.col("k")).alias("at"), (F.col("k") % 2).alias("step"))
    n = F.size(F.split("text", " "))
    ends = c.where("turn % 5 <> 4").select("message_id", n.cast("long").alias("seq"), F.lit("").alias("delta"), F.lit(True).alias("is_end"), moment(n).alias("at"), F.lit(1).alias("step"))
    clock = spark.range(1).select(F.lit(-1).cast("long").alias("message_id"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("delta"), F.lit(False).alias("is_end"), F.timestamp_millis(F.lit(1800000000000)).alias("at"), F.lit(2).alias("step"))
    records, work = scratch(spark, "chat-records"), scratch(spark, "chat-finalise")
    first = c.select(F.col("message_id").alias("id"), *[F.lit(None).cast(t).alias(x) for x, t in (("answer_text", "string"), ("answer_tokens", "int"), ("run_time", "double"), ("details", "string"))], F.lit("open").alias("status"), F.lit(0).cast("long").alias("version")).withColumn("part", merge.key_bucket("id", buckets=8))
    merge.create(first, records, "part")
    feed.in_steps(chunks.unionByName(ends).unionByName(clock), "step", [0, 1, 2], f"{work}/chunks", lambda s: finalise.run_finalise(s, records, work))
    return spark.read.schema(finalise.RECORD).parquet(records).select("id", "answer_text", "answer_tokens", "run_time", "status", "details")


_STEPS, _DAYS = 5, 25


@register(
    f"""WITH c AS (SELECT click_id, ts, client_id, kind, least({_STEPS - 1}, greatest(0, (epoch(arrived_at) - epoch(TIMESTAMP '2024-01-01')) // ({_DAYS} * 86400))) AS step FROM clicks WHERE ts IS NOT NULL),
    w AS (SELECT step, epoch_ms(max(ts)) AS newest FROM c GROUP BY 1),
    a AS (SELECT DISTINCT click_id, ts, client_id, kind FROM c WHERE epoch_us(ts) > 1000 * coalesce((SELECT max(newest) FROM w WHERE w.step < c.step) - 86400000, -1000000000000))
    SELECT * FROM a WHERE ts >= (SELECT max(ts) FROM a) - INTERVAL 20 DAY"""
)
def retention_stream(spark: SparkSession, d: str) -> DataFrame:
    """Clicks arrive in five steps, repeated and late ones among them. The stream admits each once, unless it is over a day late, and a table in days keeps the last twenty days."""
    arrival = F.expr("unix_seconds(CAST(arrived_at AS TIMESTAMP)) - unix_seconds(timestamp'2024-01-01')")
    step = F.least(F.lit(_STEPS - 1), F.greatest(F.lit(0), F.floor(arrival / (_DAYS * 86400)))).cast("int")
    clicks = table(spark, d, "clicks").withColumn("step", step).select("click_id", F.col("ts").cast("timestamp").alias("ts"), "client_id", "kind", "step")
    path, work, keep = scratch(spark, "live-clicks"), scratch(spark, "retention"), timedelta(days=20)
    feed.in_steps(clicks, "step", list(range(_STEPS)), f"{work}/arrived", lambda s: retention.run_retention(s, path, work, "click_id", "ts", keep, "1 day"))
    live = retention.live(spark, path, "click_id bigint, ts timestamp, client_id bigint, kind string", "ts", keep)
    return live.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("SELECT conv_id, turn, 'event: message' || chr(10) || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS frame FROM conversations")
def sse_sink_stream(spark: SparkSession, d: str) -> DataFrame:
    """Answers that arrive in two steps are pushed to an event sink as a stream, and read back from what it committed."""
    frames.register(spark)
    path, work = scratch(spark, "frames"), scratch(spark, "frames-work")
    rows = table(spark, d, "conversations").withColumn("step", F.coalesce(F.pmod("turn", F.lit(2)), F.lit(0)).cast("int"))

    def push(s: DataFrame):
        told = s.select("conv_id", "turn", chat.frames(F.lit("message"), F.col("text")).alias("frame"))
        return feed.run_once(told.writeStream.format(frames.NAME), f"{work}/checkpoint", path)

    feed.in_steps(rows, "step", [0, 1], f"{work}/arrived", push)
    return frames.read(spark, path, "conv_id long, turn long, frame string")
