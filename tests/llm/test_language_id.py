"""Error-correcting output codes for languages: codes, n-grams against brute force, accuracy on texts that were not learnt from."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id as li
from millrace.llm.common import strings, table


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 9, 40])
def test_codewords_are_apart(n):
    code = li.codewords(n)
    apart = [(a != b).sum() for k, a in enumerate(code) for b in code[:k]]
    assert min(apart) >= (code.shape[1] // 4 if n > 5 else (code.shape[1] + 1) // 2)
    assert (np.abs(code.sum(axis=0)) < n).all()


def test_grams_against_brute_force():
    """The same n-grams whatever texts stand around a text, and wherever a stretch ends."""
    texts = ["Ab  c!", "", None, "É 12 ß", "x" * 50, "..", "word " * 30]

    def brute(text):
        b = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in (text or "").lower().encode())
        while b"  " in b:
            b = b.replace(b"  ", b" ")
        b = b"   " + b.lstrip(b" ")
        whole = b + b" " * 8
        return sorted(int(((int.from_bytes(whole[p : p + n], "little") + n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - li.BITS)) for n in li.GRAMS for p in range(len(b)))

    def grams(column, size):
        out = [[] for _ in column]
        for text, begin, bucket in li.grams(strings(pa.array(column)), size):
            for t, a, b in zip(text.tolist(), begin.tolist(), [*begin[1:].tolist(), len(bucket)]):
                out[t] += bucket[a:b].tolist()
        return [sorted(x) for x in out]

    whole = grams(texts, 1 << 17)
    for k, t in enumerate(texts):
        assert grams([t], 1 << 17)[0] == whole[k] == grams(texts, 7)[k]
    for t in ("Ab  c", "É 12 ß", "x" * 50):
        assert grams([t], 1 << 17)[0] == brute(t)


def test_held_out_accuracy_and_short_texts(spark):
    """The third that isn't learnt from, whole and cut to six words."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    codes = li.train(docs.where(li.third() != 1))
    for text, least in ((F.col("text"), 0.995), (F.array_join(F.slice(F.split("text", " "), 1, 6), " "), 0.93)):
        held = docs.where(li.third() == 1).withColumn("text", text)
        found = li.identify(held, codes).join(held.select("doc_id", "lang"), "doc_id")
        right, n = found.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
        assert n > 300 and right >= least * n, (right, n)


def test_labels_of_the_held_out_third_are_not_used(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.withColumn("lang", F.when(li.third() == 1, "no").otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = (sorted(map(tuple, li.query(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b and {r[0]: r[1] for r in a} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs.collect()}


def test_odd_rows(spark, odd_docs, no_docs):
    """und where there is no letter or no text; one row out for each row in."""
    rng = random.Random(1)
    rows = [(w, lang) for lang, words in (("aa", ["kala", "mina"]), ("bb", ["oxtu", "pyru"])) for w in [" ".join(rng.choices(words, k=9)) for _ in range(30)]]
    codes = li.train(spark.createDataFrame([*rows, (None, "aa"), ("x", None), ("", "aa")], "text string, lang string"))
    assert codes.languages == ["aa", "bb"]
    found = li.identify(odd_docs, codes).collect()
    assert len(found) == odd_docs.count()
    assert all((r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, False) for r in found if r.doc_id in (3, 4, 5))
    assert all(r.lang_pred in ("aa", "bb") and 0 <= r.score <= 1 for r in found if r.doc_id in (1, 2, 7, 10, 11))
    assert len({tuple(r) for r in found if r.doc_id == 9}) == 1
    both = li.identify(spark.createDataFrame([(1, "kala mina kala"), (2, "oxtu pyru pyru"), (3, "kala pyru mina oxtu"), (4, "123 ... 漢")], "doc_id long, text string"), codes).collect()
    assert [r.lang_pred for r in both[:2]] == ["aa", "bb"] and not both[0].ambiguous and both[2].ambiguous and both[3].lang_pred != "und"
    assert li.identify(no_docs, codes).count() == 0


def test_one_language_or_none(spark, odd_docs):
    one = li.train(spark.createDataFrame([("abc", "xx")], "text string, lang string"))
    found = {r.doc_id: r for r in li.identify(odd_docs, one).collect()}
    assert (found[1].lang_pred, found[1].score, found[3].lang_pred) == ("xx", 1.0, "und")
    none = li.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in li.identify(odd_docs, none).collect()} == {"und"}


def test_many_languages(spark):
    rng = random.Random(4)
    syllables = {f"l{k}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(12)] for k in range(9)}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(n))
    codes = li.train(spark.createDataFrame([(make(x, 40), x) for x in syllables for _ in range(6)], "text string, lang string"))
    rows = [(k, x, make(x, 12)) for k, x in enumerate([*syllables] * 10)]
    found = {r.doc_id: r.lang_pred for r in li.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), codes).collect()}
    assert sum(found[k] == x for k, x, _ in rows) >= 85
