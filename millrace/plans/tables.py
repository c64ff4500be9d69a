"""DML, retention, streams and metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dml, predicates
from millrace.plans.ctes import with_tables
from millrace.plans.registry import register
from millrace.session import scratch
from millrace.sources import knowledge as kb
from millrace.sources.readers import DERBY, columns_of, jdbc, table
from millrace.sources.sqltexts import SqlTexts
from millrace.streaming import chat, retention


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS version FROM orders UNION ALL SELECT -1 - o_orderkey, 'N', 1 FROM orders WHERE o_orderkey % 100 = 0")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    newer = base.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("status"), F.lit(2).alias("version"))
    added = base.where("o_orderkey % 100 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("status"), F.lit(1).alias("version"))
    return dml.upsert(base, newer.union(added), ["o_orderkey"], "version")


@register("WITH f AS (SELECT * FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber <= 2) SELECT l_orderkey, l_linenumber, l_linestatus AS state FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM f) UNION ALL SELECT l_orderkey, l_linenumber, 'NEW' FROM f")
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("state"))
    fresh = base.where("l_orderkey % 7 = 0 AND l_linenumber <= 2").withColumn("state", F.lit("NEW"))
    return dml.replace_children(base, fresh, "l_orderkey")


@register(with_tables("SELECT 'dataset' AS name, CAST(id AS BIGINT) AS id FROM ds WHERE id NOT IN (2, 4) UNION ALL SELECT 'document', id FROM dd WHERE dataset_id NOT IN (2, 4) UNION ALL SELECT 'paragraph', id FROM p WHERE dataset_id NOT IN (2, 4) UNION ALL SELECT 'mapping', application_id * 1000 + dataset_id FROM app WHERE dataset_id NOT IN (2, 4) UNION ALL SELECT 'sentence', id FROM ss", "ds", "dd", "ss", "app", "p"))
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Two datasets go with their documents, paragraphs and mappings; sentences stay."""
    children = {"document": (kb.documents(spark, d), "dataset_id"), "paragraph": (kb.paragraphs(spark, d), "dataset_id"), "mapping": (kb.applications(spark, d).withColumn("id", F.expr("application_id * 1000 + dataset_id")), "dataset_id")}
    left = dml.cascade(kb.datasets(spark, d), children, spark.createDataFrame([(2,), (4,)], "id int")) | {"sentence": kb.sentences(spark, d)}
    out = None
    for name, df in left.items():
        rows = df.select(F.lit(name).alias("name"), F.col("id").cast("long").alias("id"))
        out = rows if out is None else out.union(rows)
    return out


@register(with_tables("SELECT id, CASE WHEN id % 4 = 0 THEN 0 WHEN id % 2 = 0 THEN 1 ELSE deleted END AS deleted FROM dd", "dd"))
def soft_delete_recover(spark: SparkSession, d: str) -> DataFrame:
    docs = kb.documents(spark, d).select("id", "deleted")
    return dml.recover(dml.soft_delete(docs, F.col("id") % 2 == 0), F.col("id") % 4 == 0)


@register(with_tables("SELECT id, deleted FROM dd WHERE deleted = 1", "dd"))
def recycle_bin(spark: SparkSession, d: str) -> DataFrame:
    return kb.documents(spark, d).select("id", "deleted").where("deleted = 1")


@register("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'brand' ELSE p_brand END AS p_brand, p_size FROM part")
def batch_update(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return dml.update(base, base.where("p_partkey % 3 = 0").select("p_partkey", F.lit("brand").alias("p_brand"), F.lit(None).cast("int").alias("p_size")), ["p_partkey"])


@register("SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def update_by_composite_key(spark: SparkSession, d: str) -> DataFrame:
    """Updates by (id, user_id): changes to a right id under a wrong user do nothing."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"))
    change = base.where("id % 4 = 0").select("id", F.expr("CASE WHEN user_id % 2 = 0 THEN user_id ELSE -1 - user_id END").alias("user_id"), F.lit("X").alias("status"))
    return dml.update(base, change, ["id", "user_id"])


@register("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 1000000000, 'one more'")
def insert_rows(spark: SparkSession, d: str) -> DataFrame:
    """A batch insert of at most 2000 rows a file, and a single one, read back."""
    out = scratch(spark, "inserted")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    dml.insert(rows.where("id % 2 = 0"), out, batch=dml.BATCH)
    dml.insert(spark.createDataFrame([(1_000_000_000, "one more")], "id long, name string"), out)
    return spark.read.schema("id long, name string").parquet(out)


@register("SELECT c_custkey AS id, CASE WHEN c_nationkey IN (3, 5) THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS segment, c_nationkey AS part FROM customer")
def transaction_by_partition(spark: SparkSession, d: str) -> DataFrame:
    """All rows of some partitions replaced in one commit; the other partitions stay."""
    out = scratch(spark, "partitions")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("part"))
    dml.overwrite_partitions(rows, out, "part")
    dml.overwrite_partitions(rows.where("part IN (3, 5)").withColumn("segment", F.concat(F.upper("segment"), F.lit("!"))), out, "part")
    return spark.read.schema("id long, segment string, part int").parquet(out)


@register("SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 30 AND p_brand IN ('Brand#1', 'Brand#12', 'Brand#13', 'Brand#2', 'Brand#3') OR false ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 25")
def spec_query(spark: SparkSession, d: str) -> DataFrame:
    """A request's columns, conditions, order and page in one object."""
    spec = {"columns": ["p_partkey", "p_name", "p_size"], "where": [("p_size", "between", (5, 30)), ("p_brand", "in", ["Brand#1", "Brand#12", "Brand#13", "Brand#2", "Brand#3"])], "order": [("p_size", True), ("p_partkey", False)], "page": 2, "size": 25}
    return dml.apply_spec(table(spark, d, "part"), spec)


@register("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def request_filter(spark: SparkSession, d: str) -> DataFrame:
    """A request's parameters, renamed and typed, as an example that rows must equal."""
    asked = predicates.normalised_params({"cMktsegment": "BUILDING", "cNationkey": "7", "pageNo": "1"}, drop=["pageNo"])
    return predicates.by_example(table(spark, d, "customer"), asked, ["c_custkey", "c_name"])


_TEXTS = """
--# customers.of_nation
SELECT c_custkey, c_name FROM {customer} WHERE c_nationkey = :nation AND c_acctbal > :least;
--# customers.count
SELECT count(*) AS n FROM {customer};
"""


@register("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 4 AND c_acctbal > 100")
def named_sql_text(spark: SparkSession, d: str) -> DataFrame:
    return SqlTexts(_TEXTS).run(spark, "customers.of_nation", {"customer": table(spark, d, "customer")}, nation=4, least=100)


@register("SELECT o_orderkey, o_totalprice FROM orders")
def jdbc_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows inserted into a database in batches and read back in parallel ranges of their key. The database is an embedded one, so this runs on one machine."""
    url = f"jdbc:derby:memory:millrace{uuid.uuid4().hex};create=true"
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    low, high = rows.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    rows.write.format("jdbc").options(url=url, dbtable="orders", driver=DERBY, batchsize=dml.BATCH).save()
    return jdbc(spark, url, "orders", "O_ORDERKEY", low or 0, (high or 0) + 1, 4, DERBY).select(F.col("o_orderkey").alias("o_orderkey"), F.col("o_totalprice").alias("o_totalprice"))


@register("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)")
def delete_by_keys(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_nationkey = 1").select(F.col("c_custkey").alias("o_custkey"))
    return dml.delete(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"]).select("o_orderkey")


@register("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def purge_ttl(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts")
    as_of = e.agg(F.max("ts").alias("as_of"))
    return dml.purge(e.crossJoin(F.broadcast(as_of)), "ts", F.col("as_of")).select("event_id", "ts")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "text")
    return c.select("message_id", F.posexplode(F.split("text", " ")).alias("k", "w")).select("message_id", F.col("k").cast("long").alias("seq"), F.concat(F.when(F.col("k") > 0, " ").otherwise(""), "w").alias("delta"))


_FOLD = "SELECT conv_id * 1000 + turn AS message_id, text AS answer_text, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_chunks FROM conversations"


@register(_FOLD)
def chat_fold(spark: SparkSession, d: str) -> DataFrame:
    return chat.fold(_chunks(spark, d), ["message_id"])


@register("SELECT conv_id * 1000 + turn AS message_id, text AS answer_text, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_chunks, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\r\\n]')) AS INT) AS answer_tokens FROM conversations")
def chat_record_finalise(spark: SparkSession, d: str) -> DataFrame:
    return chat.finalise(chat.fold(_chunks(spark, d), ["message_id"]))


@register(_FOLD)
def chat_fold_stream(spark: SparkSession, d: str) -> DataFrame:
    """Deltas and end marks as a stream; a message is told when it has ended, and its state goes."""
    source = scratch(spark, "chat-chunks")
    ends = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.size(F.split("text", " ")).cast("long").alias("seq"), F.lit("").alias("delta"), F.lit(True).alias("is_end"))
    _chunks(spark, d).withColumn("is_end", F.lit(False)).unionByName(ends).write.parquet(source)
    return chat.run_fold(spark, source, scratch(spark, "chat-folded"), scratch(spark, "chat-state"))


@register(
    """SELECT conv_id * 1000 + turn AS id, text AS answer_text, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\r\\n]')) AS INT) AS answer_tokens, CAST(turn AS INT) AS message_tokens, CAST((turn % 50) * 0.25 AS DOUBLE) AS run_time, 1 AS version,
    '{"chat_step":{"run_time":' || CAST((turn % 50) * 0.25 AS DOUBLE) || ',"answer_tokens":' || len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\r\\n]')) || ',"message_tokens":' || turn || ',"step_type":"chat_step"}}' AS details FROM conversations WHERE turn % 3 <> 0
    UNION ALL SELECT conv_id * 1000 + turn, NULL, NULL, NULL, NULL, 0, NULL FROM conversations WHERE turn % 3 = 0"""
)
def chat_complete(spark: SparkSession, d: str) -> DataFrame:
    """Records are there from the start; those whose answer has ended get its text, tokens, run time and details."""
    c = table(spark, d, "conversations").withColumn("id", F.expr("conv_id * 1000 + turn"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("answer_text", "string"), ("answer_tokens", "int"), ("message_tokens", "int"), ("run_time", "double"), ("details", "string"))]
    began = F.expr("timestamp_millis(1700000000000)")
    done = c.where("turn % 3 <> 0").select("id", F.col("text").alias("answer_text"), F.col("turn").cast("int").alias("message_tokens"), began.alias("began"), F.expr("timestamp_millis(1700000000000 + (turn % 50) * 250)").alias("ended"))
    return chat.complete(c.select("id", *none, F.lit(0).alias("version")), done)


@register("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS delta, false AS is_end, turn % 4 = 3 AS is_error FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, '', true, false FROM conversations GROUP BY conv_id")
def sse_parse(spark: SparkSession, d: str) -> DataFrame:
    """Event lines, as an answer service sends them: blank keep-alives, deltas as JSON, errors, an end mark."""
    return chat.parse_events(_lines(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    failed = F.to_json(F.struct(F.struct(F.concat(F.lit("no answer to "), F.col("turn").cast("string")).alias("message")).alias("error")))
    lines = c.select("conv_id", "turn", F.explode(F.array(F.concat(F.lit("data: "), F.when(F.col("turn") % 4 == 3, failed).otherwise(body)), F.lit("\n"))).alias("line"))
    ends = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("line", F.lit(f"data: {chat.DONE}"))
    return lines.unionByName(ends)


@register("SELECT conv_id, turn, 'no answer to ' || turn AS message, 'event: error' || chr(10) || 'data: no answer to ' || turn || chr(10) || chr(10) AS frame FROM conversations WHERE turn % 4 = 3")
def sse_errors(spark: SparkSession, d: str) -> DataFrame:
    """The error events that clients get."""
    return chat.error_events(_lines(spark, d), ["conv_id", "turn"])


@register("SELECT conv_id, turn, 'event: message' || chr(10) || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS frame FROM conversations")
def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    """Answers framed as server-sent events, a data line for each of their lines."""
    return table(spark, d, "conversations").select("conv_id", "turn", chat.frames(F.lit("message"), F.col("text")).alias("frame"))


@register("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: daily tumbling windows."""
    return retention.event_counts(table(spark, d, "events"))


@register(
    """SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END AS data_type
    FROM information_schema.columns WHERE table_name IN ('documents', 'embeddings', 'labels', 'pages', 'benchmark', 'conversations', 'events')"""
)
def metadata_columns(spark: SparkSession, d: str) -> DataFrame:
    names = ("documents", "embeddings", "labels", "pages", "benchmark", "conversations", "events")
    rows = [x for n in names for x in columns_of(table(spark, d, n), n)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
