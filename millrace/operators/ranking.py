"""Ranking of texts for a question: scores of the words they share (BM25), and of an injected model, kept beside the ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.cache import model_result
from millrace.session import scratch

#: How fast repeats of a word stop counting, and how much a text's length does.
K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    """A text's runs of letters and digits, in lower case; the first and the last may be empty."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _is(word: str) -> Callable[[Column], Column]:
    return lambda w: w == word


def bm25(texts: DataFrame, question: str, key: str = "id", text: str = "text", digits: int = 6) -> DataFrame:
    """key and score of the texts that share a word with the question.

    One pass counts each text's question words in the JVM and writes the counts; the statistics (texts, mean length, texts
    with each word) are one aggregate over them, a row that is broadcast. Nothing is exploded, and nothing is shuffled but partial sums.
    """
    asked = sorted({w for w in _split(question)})
    if not asked:
        return texts.select(key, F.lit(0.0).alias("score")).limit(0)
    own = texts.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    first, last = F.element_at("_w", 1) == "", F.element_at("_w", -1) == ""
    n = F.size("_w") - F.when(first, 1).otherwise(0) - F.when(last & (F.size("_w") > 1), 1).otherwise(0)
    hits = own.select(key, n.alias("_n"), F.filter("_w", lambda w: w.isin(asked)).alias("_h"))  # one pass over the words; few are asked for
    counted = hits.select(key, "_n", *[F.size(F.filter("_h", _is(q))).alias(f"_f{i}") for i, q in enumerate(asked)])
    out = scratch(texts.sparkSession, "question-words")
    counted.write.parquet(out)  # a few numbers a text, so that texts are read once
    counted = texts.sparkSession.read.schema(counted.schema).parquet(out)
    totals = counted.agg(F.count(F.lit(1)).alias("_texts"), F.avg("_n").alias("_mean"), *[F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(asked))])
    both = counted.where(F.greatest(F.lit(0), *[F.col(f"_f{i}") for i in range(len(asked))]) > 0).crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(len(asked)):
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        rarity = F.log(1 + (F.col("_texts") - d + 0.5) / (d + 0.5))
        score = score + rarity * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))
    return both.select(key, F.round(score, digits).alias("score"))


def _split(text: str) -> list[str]:
    out, run = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def best(scored: DataFrame, k: int, key: str = "id", group: str | None = None) -> DataFrame:
    """The k best by score, ties by key, with their rank and their score; of each group, if one is named."""
    if group is None:
        top = scored.orderBy(F.desc("score"), key).limit(k)  # k rows, which then have their rank
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
    order = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_model(candidates: DataFrame, ask: Callable[[list[str]], list], text: str = "text", tries: int = 3) -> DataFrame:
    """candidates with the model's score of their text and, where it gave none, the cause. Their earlier score stays as `first_score`."""
    from pyspark.sql import types as T

    x = model_result(text, ask, T.DoubleType(), tries)
    return candidates.withColumnRenamed("score", "first_score").withColumn("_x", x).withColumn("score", F.col("_x.answer")).withColumn("error", F.col("_x.error")).drop("_x")
