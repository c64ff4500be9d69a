"""Tables written in one commit, and ranking with scores kept."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import ranking, together


def test_tables_become_visible_together(spark, tmp_path):
    root = f"{tmp_path}/r"
    a, b = spark.range(5).toDF("id"), spark.range(3).toDF("id")
    count = lambda name, until=None: together.read(spark, root, name, "id long", until).count()
    assert together.snapshot(spark, root) == -1 and count("a") == 0
    assert together.write(spark, root, {"a": a, "b": b}) == 0 and (count("a"), count("b")) == (5, 3)
    assert together.write(spark, root, {"a": a}, mark=False) == 1  # lost: `b` was never written, so neither counts
    assert (count("a"), count("b")) == (5, 3)
    assert together.write(spark, root, {"a": b, "b": a}) == 1  # its number and its place are taken again
    assert (count("a"), count("b"), count("a", 0), count("b", 0)) == (8, 8, 5, 3) and together.snapshot(spark, root) == 1


def test_children_are_replaced(spark, tmp_path):
    root = f"{tmp_path}/r"
    kids = lambda rows: spark.createDataFrame(rows, "parent long, v string")
    all_of = lambda n: spark.range(n).toDF("parent")
    now = lambda until=None: sorted(map(tuple, together.current_children(spark, root, "parent", "long", "parent long, v string", until).collect()))
    assert now() == []
    together.replace_children(spark, root, all_of(4), kids([(0, "a"), (0, "b"), (1, "c"), (2, "d")]), "parent")
    together.replace_children(spark, root, all_of(2), kids([(0, "x"), (0, "x")]), "parent", {"log": spark.range(1).toDF("n")})
    want = [(0, "x"), (0, "x"), (2, "d")]  # 1 has none left
    assert now() == want and together.read(spark, root, "log", "n long").count() == 1
    together.replace_children(spark, root, all_of(4), kids([]), "parent", mark=False)
    assert now() == want and now(0) == [(0, "a"), (0, "b"), (1, "c"), (2, "d")]
    together.replace_children(spark, root, all_of(2), kids([(0, "x"), (0, "x")]), "parent")  # doing it twice
    assert now() == want


TEXTS = ["The cat sat. The cat!", "a dog sat", "", None, "Café cat's café", "nothing of it", "cat " * 50]


def brute(question):
    docs = [[w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w] for t in TEXTS]
    asked, mean = {w for w in re.split(r"[^\w]+", question.lower()) if w}, sum(map(len, docs)) / len(docs)
    out = {}
    for k, d in enumerate(docs):
        s = 0.0
        for q in asked:
            n, f = sum(q in x for x in docs), d.count(q)
            s += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean))
        if asked & set(d):
            out[k] = round(s, 6)
    return out


@pytest.mark.parametrize("question", ["the cat", "CAFÉ, sat?", "absent", "", "cat cat cat dog"])
def test_scores_against_brute_force(spark, question):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, text string")
    got = {r.id: r.score for r in ranking.bm25(df, question).collect()}
    want = brute(question)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_best_and_second_opinion(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, text string")
    top = ranking.best(ranking.bm25(df, "cat sat"), 2)
    assert [r["rank"] for r in top.orderBy("rank").collect()] == [1, 2]

    def model(texts):
        if "a dog sat" in texts:
            raise RuntimeError("no dogs")
        return [float(len(t)) for t in texts]

    again = {r.id: r for r in ranking.by_model(ranking.bm25(df, "cat sat").join(df, "id"), model, tries=1).collect()}
    assert again[1].score is None and again[1].error == "RuntimeError: no dogs" and again[1].first_score > 0
    assert again[0].score == len(TEXTS[0]) and again[0].error is None
    tied = spark.createDataFrame([(3, 1.0, "g"), (2, 1.0, "g"), (1, 0.5, "g"), (9, 0.1, None)], "id int, score double, g string")
    assert sorted((r.id, r["rank"]) for r in ranking.best(tied, 2, group="g").collect()) == [(2, 1), (3, 2), (9, 1)]
    assert ranking.best(tied.where(F.lit(False)), 5).count() == 0
