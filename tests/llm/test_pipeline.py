from __future__ import annotations

import pytest
from oracle import compare

import corpus_pipeline
from millrace.llm import queries as llm
from millrace.llm.common import table


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, sf, name):
    assert compare(llm.queries()[name](spark, sf), llm.oracle_sql()[name], sf) == ""


def test_run_and_its_decisions(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    base = 10_000
    fine = docs.where("doc_id = 4").first().text
    item = table(spark, sf, "benchmark").first().text
    toxic = table(spark, sf, "labels").where("toxic = 1").join(docs, "doc_id").where("lang = 'en'").orderBy("doc_id").first().text
    planted = [(base, "Fresh words: " + fine), (base + 1, "fresh  words: " + fine), (base + 2, fine + "\n" + item + "\n" + fine), (base + 3, toxic + " again"), (base + 4, "Fresh words: " + fine)]
    out = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in planted], docs.schema))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        if name == "sentencepiece":
            break
        out = stage(spark, out, sf)
        assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/t-{name}")
        out = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/t-{name}")
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
    toxicity, exact, near, clean = kept
    assert base + 3 not in toxicity and base in toxicity
    assert base in exact and base + 4 not in exact
    assert base + 1 not in near and (base in near or 4 in near)
    assert base + 2 not in clean
    assert len(clean) > 0.7 * docs.count()


def test_whole_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and got.where("NOT round_trip").count() == 0


def _tables(spark, folder, docs, labels, benchmark):
    kinds = {"documents": ("doc_id long, text string, lang string, source string, n_chars long", docs), "labels": ("doc_id long, quality int, toxic int", labels), "benchmark": ("item_id long, text string", benchmark)}
    for name, (schema, rows) in kinds.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows: each kind of text is there once at the end, and no stage fails."""
    long = " ".join(f"word{k % 97}x{k}" for k in range(20_000))
    docs = [(1, "Same  text here, with\tsix words"), (2, "Same text here, with six words"), (3, None), (4, ""), (5, " \n "), (None, "alone without an id"), (None, None), (7, long), (8, long), (9, "twice given"), (9, "twice given"), (10, "a"), (11, "é ß İ 漢字 🙂"), (12, "before the secret item of eight words here after")]
    docs = [(d, t, None if k % 2 else "en", None if k % 3 else "s", None) for k, (d, t) in enumerate(docs)]
    sf = _tables(spark, f"{tmp_path}", docs, [(1, 1, 0), (None, 0, 1), (99, None, None)], [(1, "the secret item of eight words here"), (2, None), (None, "")])
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} - {None} == {1, 3, 7, 9, 10, 11} and len(got) == 7  # texts without words are copies of one another
    assert all(r.round_trip for r in got)


def test_empty_tables_go_through_all_stages(spark, tmp_path):
    sf = _tables(spark, f"{tmp_path}", [], [], [])
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == 0 and out.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
