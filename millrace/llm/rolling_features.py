"""Rolling window features of each row's group: RANGE frames that DuckDB computes inside Arrow partitions.

1. Equal (group, time, length, kind) rows are counted before anything moves by group.
2. A partition is a hashed bucket of groups in a block of time of BLOCKS longest windows. A row goes to its own block and, if it
   lies within a longest window of that block's end, to the next one too. So a group that holds a third of all rows is
   cut by time, and a partition holds the rows of a stretch of time that doesn't grow with the table.
3. DuckDB takes RANGE frames over it: sums, distinct kinds, and the ordered list of lengths, of which numbers are taken.
   Where most rows are repeats, lists hold lengths with their counts instead of one number a row.
4. A frame depends on its group and time alone: there is one result for each of these, and rows take theirs by a join.

A frame holds the rows of the same group (null is a group) with time - w <= their time < time. Rows without a length
count as rows, and add no length; null kinds aren't counted. Rows without a time are in no frame and have an empty one.
Repeated rows count as often as they occur and are all returned; an empty table gives no row. Nothing is gathered at
the driver, in one task or in a broadcast.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written

WINDOWS = (3600, 21600)
#: Length of a block of time in longest windows; hashed buckets of groups.
BLOCKS, BUCKETS = 4, 8
#: (numerator, denominator) of the place in the ordered list of m lengths: number ceil(numerator * m / denominator).
RANKS = {"median_chars": (1, 2), "high_chars": (75, 100)}

_CONNECTIONS: dict = {}


def _connection():
    if not _CONNECTIONS:
        import duckdb

        _CONNECTIONS["own"] = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
    return _CONNECTIONS["own"]


def _place(rank: tuple[int, int], m: str) -> str:
    return f"(({rank[0]} * {m} + {rank[1] - 1}) // {rank[1]})"


def frames_sql(windows, ranks: dict, weighted: bool) -> str:
    """DuckDB's query over `rows` (grp, t, v, kind, c): a struct w<seconds> for each window, once for each group and time from `since` to before `until`."""
    if weighted:  # the length at which the counts of the ordered lengths reach the place
        ordered = "list_sort(list({'v': v, 'c': c}) FILTER (v IS NOT NULL) OVER f{w})"
        pick = "list_reduce(l{w}, lambda a, x: CASE WHEN a.c >= {place} THEN a ELSE {{'v': x.v, 'c': a.c + x.c}} END, {{'v': NULL::BIGINT, 'c': 0::BIGINT}}).v"
    else:
        ordered, pick = "list_sort(list(v) FILTER (v IS NOT NULL) OVER f{w})", "l{w}[{place}]"
    inner, outer, frames = [], [], []
    for w in windows:
        frames.append(f"f{w} AS (PARTITION BY grp ORDER BY t RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)")
        inner.append(f"coalesce(sum(c) OVER f{w}, 0)::BIGINT AS n{w}, coalesce(sum(c * v) OVER f{w}, 0)::BIGINT AS s{w}, coalesce(sum(c) FILTER (v IS NOT NULL) OVER f{w}, 0)::BIGINT AS m{w}, count(DISTINCT kind) OVER f{w} AS k{w}, {ordered.replace('{w}', str(w))} AS l{w}")
        picks = ", ".join(f"'{name}': CASE WHEN m{w} > 0 THEN {pick.format(w=w, place=_place(rank, f'm{w}'))} END" for name, rank in ranks.items())
        outer.append(f"{{'n_events': n{w}, 'sum_chars': s{w}, 'n_langs': k{w}, {picks}}} AS w{w}")
    rows = "rows" if weighted else "(SELECT grp, t, v, kind, 1 AS c FROM rows, range(rows.c))"
    own = "t >= $since AND t < $until"
    return f"SELECT grp, t, {', '.join(outer)} FROM (SELECT grp, t, row_number() OVER (PARTITION BY grp, t) AS once, {', '.join(inner)} FROM {rows} WINDOW {', '.join(frames)}) WHERE once = 1 AND {own}"


def _frames(windows: tuple, ranks: dict, block: int, schema: pa.Schema):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        con = _connection()
        con.register("rows", rows.select(["grp", "t", "v", "kind", "c"]))
        weighted = pc.sum(rows["c"]).as_py() > 2 * rows.num_rows
        at = key[1].as_py()
        try:
            return con.sql(frames_sql(windows, ranks, weighted), params={"since": at * block, "until": (at + 1) * block}).to_arrow_table().cast(schema)
        finally:
            con.unregister("rows")

    return run


def rolling(rows: DataFrame, windows=WINDOWS, ranks: dict = RANKS, blocks: int = BLOCKS, buckets: int = BUCKETS) -> DataFrame:
    """rows (id, grp, t in whole seconds, v: a length, kind) as id, window_s, t, n_events, sum_chars, n_langs and the ranks, a row for each window."""
    windows = tuple(sorted(windows))
    block = blocks * windows[-1]
    rows = written(rows.select("id", "grp", "t", "v", "kind"), "rolling-rows")
    counted = rows.where("t IS NOT NULL").groupBy("grp", "t", "v", "kind").agg(F.count(F.lit(1)).alias("c"))
    home = F.expr(f"(t - pmod(t, {block}L)) div {block}L")
    last = F.col("home") * block + (block - windows[-1])
    dealt = counted.withColumn("home", home).withColumn("block", F.explode(F.when(F.col("t") >= last, F.array(F.col("home"), F.col("home") + 1)).otherwise(F.array("home")))).withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)))
    names = ["n_events", "sum_chars", "n_langs", *ranks]
    kind = f"struct<{', '.join(f'{n}: bigint' for n in names)}>"
    group = rows.schema["grp"].dataType.simpleString()
    made = f"grp {group}, t bigint, {', '.join(f'w{w} {kind}' for w in windows)}"
    arrow = pa.schema([("grp", _arrow_type(group)), ("t", pa.int64()), *[(f"w{w}", pa.struct([(n, pa.int64()) for n in names])) for w in windows]])
    found = dealt.groupBy("bucket", "block").applyInArrow(_frames(windows, ranks, block, arrow), made)
    none = F.struct(*[(F.lit(None) if n in ranks else F.lit(0)).cast("long").alias(n) for n in names])
    timed = rows.where("t IS NOT NULL").select("id", "grp", "t").alias("r").join(found.hint("merge").alias("f"), F.expr("r.grp <=> f.grp AND r.t = f.t")).select("r.id", "r.t", *[f"f.w{w}" for w in windows])
    untimed = rows.where("t IS NULL").select("id", "t", *[none.alias(f"w{w}") for w in windows])
    wide = timed.unionByName(untimed)
    return wide.select("id", "t", F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("window_s"), F.col(f"w{w}").alias("x")) for w in windows])).alias("y")).select("id", "y.window_s", "t", "y.x.*")


def _arrow_type(name: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]


def document_events(docs: DataFrame) -> DataFrame:
    """Documents as rows of rolling(): the time is made of doc_id, the length is the text's code points. A doc_id that is null or whose time is beyond 64 bits has no time."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    sixths = F.try_add(F.col("doc_id").cast("long"), F.pmod(h, F.lit(4000)))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("grp"), sixths.alias("x"), F.length(text).cast("long").alias("v"), F.col("lang").cast("string").alias("kind"))
    return rows.withColumn("t", F.expr("try_multiply(60L, (x - pmod(x, 6L)) div 6L)"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rolling(document_events(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id").withColumnRenamed("t", "event_s")


#: crc32 by its table of 256 entries, made of eight shifts each, over the digits of doc_id; then the frames over whole sources.
ORACLE = """WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i)) AS v),
e AS (SELECT doc_id, source, lang, length(text) AS len,
  60 * CAST(floor((doc_id + xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda a, b: xor(a // 256, v[xor(a % 256, b) + 1]), 4294967295), 4294967295) % 4000) // 6) AS BIGINT) AS event_s
  FROM documents, tbl),
w AS (SELECT doc_id, window_s, event_s, n_events, sum_chars, n_langs, l FROM (
  SELECT doc_id, event_s, CAST(3600 AS BIGINT) AS window_s, count(*) OVER f AS n_events, coalesce(sum(len) OVER f, 0) AS sum_chars, count(DISTINCT lang) OVER f AS n_langs, list_sort(list(len) FILTER (len IS NOT NULL) OVER f) AS l
  FROM e WINDOW f AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING)
  UNION ALL
  SELECT doc_id, event_s, CAST(21600 AS BIGINT), count(*) OVER f, coalesce(sum(len) OVER f, 0), count(DISTINCT lang) OVER f, list_sort(list(len) FILTER (len IS NOT NULL) OVER f)
  FROM e WINDOW f AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 21600 PRECEDING AND 1 PRECEDING)))
SELECT doc_id, window_s, event_s, n_events, CAST(sum_chars AS BIGINT) AS sum_chars, n_langs, l[(len(l) + 1) // 2] AS median_chars, l[(75 * len(l) + 99) // 100] AS high_chars FROM w"""
