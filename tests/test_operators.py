"""Golden cases and properties of the operators."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.vector import cosine
from millrace.operators import cache, chunk, context, dml, predicates, retrieval
from millrace.streaming import chat

P = "id long, document_id long, title string, content string, dataset_id int, is_active boolean, deleted int, embedding array<float>, status string, hit_num int, create_time timestamp_ntz, update_time timestamp_ntz"
LATE = (0, None, None)


def test_cosine_nulls_zeros_and_dimensions(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "id long, v array<float>").withColumn("q", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")))
    assert {r.id: r.s for r in rows.select("id", cosine("v", "q").alias("s")).collect()} == {1: 1.0, 2: None, 3: None, 4: 0.707107}
    kept = {r.id: r.s for r in rows.select("id", cosine("v", "q", nan_policy="keep").alias("s")).collect()}
    assert kept[3] != kept[3] and kept[2] is None
    with pytest.raises(Exception, match="dimension"):
        spark.createDataFrame([([1.0, 2.0, 3.0], [1.0])], "a array<float>, b array<float>").select(cosine("a", "b")).collect()


def test_threshold_is_strict_and_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None)], "id long, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "v array<float>")
    assert [(r.id, r.similarity) for r in retrieval.knn(df, q, ["id"], 0.0, 10).collect()] == [(1, 1.0), (3, 1.0)]
    assert retrieval.knn(df, q, ["id"], 1.0).count() == 0
    with pytest.raises(ValueError):
        retrieval.knn(df, q, ["id; DROP TABLE x"])


def test_sentences_by_type_and_flags(spark):
    v = [1.0, 0.0]
    d = spark.createDataFrame([(1, "d1", True), (2, "d2", False)], "id long, name string, is_active boolean")
    ds = spark.createDataFrame([(7, "ds", 0)], "id int, name string, deleted int")
    p = spark.createDataFrame([(10, 1, "t", "c", 7, False, 0, v, "1", *LATE), (11, 2, "u", "c", 7, True, 0, v, "1", *LATE)], P)
    s = [(1, 1, 1, 7, 10, 0, v), (2, 2, 1, 7, 99, 0, v), (3, 1, 2, 7, 11, 0, v), (4, 2, 2, 7, 11, 0, v), (5, 1, 2, 7, 11, 1, v)]
    s = spark.createDataFrame([(*r, f"s{r[0]}", 0) for r in s], "id long, type int, document_id long, dataset_id int, paragraph_id long, deleted int, embedding array<float>, content string, hit_num int")
    q = spark.createDataFrame([(v,)], "v array<float>")
    got = {r.id: (r.title, r.status, r.content) for r in retrieval.sentence_search(s, p, d, ds, q, [7]).collect()}
    assert got == {2: ("", "1", "s2"), 3: ("u", "1", "s3")}  # inactive paragraph, inactive document and a deleted sentence drop out


def test_a_deleted_document_of_a_live_dataset_still_hits(spark):
    v = [1.0]
    d = spark.createDataFrame([(1, "d1", True, 1)], "id long, name string, is_active boolean, deleted int")
    ds = spark.createDataFrame([(7, "ds", 0)], "id int, name string, deleted int")
    p = spark.createDataFrame([(10, 1, "t", "c", 7, True, 0, v, "1", *LATE)], P)
    assert retrieval.paragraph_search(p, d, ds, spark.createDataFrame([(v,)], "v array<float>"), [7]).count() == 1


@pytest.mark.parametrize("at_once,queries", [(512, 200_000), (2, 3)])
def test_batch_search_is_the_prefix_of_a_full_sort(spark, monkeypatch, at_once, queries):
    """Also in blocks of queries and over several passes; ties go to the smaller id."""
    import numpy as np

    monkeypatch.setattr(retrieval, "AT_ONCE", at_once)
    monkeypatch.setattr(retrieval, "QUERIES", queries)
    rng = np.random.default_rng(3)
    data = [(k, rng.integers(-2, 3, 3).astype(float).tolist()) for k in range(160)] + [(160, None), (161, [0.0] * 3)]
    rows = spark.createDataFrame(data, "id long, embedding array<float>").repartition(5)
    found = retrieval.batch_search(rows, rows.where("id % 10 = 0"), 4, -1.5).collect()
    got = {(r.query_id, r.rank): r.id for r in found}
    x = np.array([d[1] for d in data[:160]])
    length = np.linalg.norm(x, axis=1)
    for q in range(0, 160, 10):
        if not length[q]:
            continue
        own = [k for k in range(160) if length[k]]
        s = {k: np.round(x[k] @ x[q] / length[k] / length[q], 6) for k in own}
        assert [got[q, k] for k in range(1, 5)] == sorted(own, key=lambda k: (-s[k], k))[:4]
    assert len(found) == len(got)


def test_xml_escape_and_context(spark):
    one = spark.createDataFrame([("a<b & \"c\" 'd'",), (None,)], "s string")
    assert [r.x for r in one.select(tx.xml_escape(F.col("s")).alias("x")).collect()] == ["a&lt;b &amp; &quot;c&quot; &apos;d&apos;", ""]
    hits = spark.createDataFrame([(1, 5, "B<", "x"), (2, 4, "A", "y"), (3, 5, "B<", "z")], "rank int, document_id long, document_name string, content string")
    assert context.xml_context(hits).first().context == '<data><source id="1" name="B&lt;">x\r\nz</source>\r\n<source id="2" name="A">y</source></data>'


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n", min_size=0, max_size=30), max_size=12), st.integers(2, 12))
def test_recursive_spans_cover_fit_and_overlap(parts, size):
    """Tokens here are characters and pairs of them. Chunks cover the text, none is too long, and neighbours share at most the overlap."""
    import numpy as np

    text, overlap = "\n\n".join(parts), size // 3
    tokens = np.array([k for k in range(len(text)) if k % 3 != 1], np.int64)
    found = chunk.spans(text, tokens, size, overlap)
    count = lambda a, b: int(((tokens >= a) & (tokens < b)).sum())
    assert all(count(a, b) <= size for a, b in found)
    if text:
        assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, e) in zip(found, found[1:]):
        assert a < c <= b < e and count(c, b) <= overlap


def test_token_chunks_and_counts(spark):
    """Whole texts come back from their chunks; counts are the library's; nulls and blanks have no chunk."""
    from millrace.functions import tokens

    known = tokens.tokenizer(tokens.default_path())
    long = " ".join(f"word{k}" + (". " if k % 9 == 0 else "") + ("\n\n" if k % 50 == 0 else "") for k in range(3000))
    rows = [(1, long), (2, "short"), (3, None), (4, " \n "), (5, "x" * 4000), (2, "short"), (6, "é 漢字 🙂 <|endoftext|>")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = chunk.token_chunks(df, "id", "t", 150, 50).orderBy("id", "seq").collect()
    assert {r.id for r in got} == {1, 2, 5, 6} and sum(r.id == 2 for r in got) == 2 and all(r.tokens <= 150 for r in got)
    own = [r.chunk for r in got if r.id == 1]
    at = 0
    for c in own:
        begin = long.index(c)
        assert not long[at:begin].strip() if begin > at else True
        at = max(at, begin + len(c))
    assert not long[at:].strip() and "".join(r.chunk for r in got if r.id == 5) == "x" * 4000
    assert all(len(known.encode(c, add_special_tokens=False).ids) <= 155 for c in own)
    counted = {r.id: r.n for r in df.select("id", tokens.count_tokens("t").alias("n")).collect()}
    assert counted == {i: len(known.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_windows_overlap(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, "x")], "id long, t string")
    got = [(r.id, r.seq, r.chunk.split()) for r in chunk.windows(df, "t", 10, 4).orderBy("id", "seq").collect()]
    assert [g[2][0] for g in got if g[0] == 1] == ["0", "6", "12", "18"] and got[-1][2] == ["x"]
    assert all(a[2][-4:] == b[2][:4] for a, b in zip(got, got[1:]) if a[0] == b[0] == 1)


def test_cache_is_idempotent(spark):
    wanted = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")
    old = spark.createDataFrame([("b", 1)], "t string, v int")
    _, grown = cache.get_or_compute(wanted, old, ["t"], "v", lambda m: m.withColumn("v", F.lit(2)))
    again = cache.get_or_compute(wanted, grown, ["t"], "v", lambda m: m.withColumn("v", F.lit(3)))[1]
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, again.collect())) == [("a", 2), ("b", 1)]


def test_dml(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, x string, version int")
    change = spark.createDataFrame([(2, "c", 2), (3, "d", 1), (1, "z", 1)], "id int, x string, version int")
    assert sorted(map(tuple, dml.upsert(base, change, ["id"], "version").collect())) == [(1, "z", 1), (2, "c", 2), (3, "d", 1)]
    once = dml.replace_children(base, change.where("id = 2"), "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, dml.replace_children(once, change.where("id = 2"), "id").collect())) == [(1, "a", 1), (2, "c", 2)]
    page = dml.page(base, 2, 1, ["id"]).collect()
    assert [(r.id, r.total) for r in page] == [(2, 2)]


def test_partition_overwrite_and_export(spark, tmp_path):
    path = str(tmp_path / "t")
    dml.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), path, "k")
    dml.overwrite_partitions(spark.createDataFrame([(2, "c")], "k int, x string"), path, "k")
    assert sorted((r.k, r.x) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    dml.export_csv(spark.read.parquet(path), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_sources(spark, tmp_path):
    from millrace.sources import readers

    (tmp_path / "c.json").write_text('{"code": 1,\n "data": [{"name": "a"}, {"name": "b"}]}')
    assert [r.name for r in readers.json_catalogue(spark, str(tmp_path / "c.json"), "name: string").collect()] == ["a", "b"]
    files = tmp_path / "up"
    files.mkdir()
    (files / "x.PDF").write_bytes(b"abc")
    got = readers.uploads(spark, str(files)).first()
    assert (got.md5, got.suffix, got.file_size) == ("900150983cd24fb0d6963f7d28e17f72", "PDF", 3)


def test_params_and_events(spark):
    assert predicates.normalised_params({"pageNo": "2", "isActive": "true", "x": "y", "z": 1}, drop=["z"]) == {"page_no": 2, "is_active": True, "x": "y"}
    lines = spark.createDataFrame([('data: {"choices":[{"delta":{"content":"hi"}}]}',), ("data: [DONE]",), ("\n",), ('data: {"error":{"message":"no"}}',)], "line string")
    assert [tuple(r) for r in chat.parse_events(lines).collect()] == [("hi", False, False), ("", True, False), ("", False, True)]


CHUNK = "message_id long, seq long, delta string, is_end boolean"


def test_stream_folds_across_batches(spark, tmp_path):
    """A message is told once, when its end mark and all before it are there; chunks may come twice and in any order."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([(1, 1, "b", False), (2, 0, "x", False), (2, 1, "", True), (1, 3, "", True)], CHUNK).write.mode("append").parquet(src)
    assert [r.message_id for r in chat.run_fold(spark, src, out, ck).collect()] == [2]
    spark.createDataFrame([(1, 0, "a", False), (1, 2, "c", False), (1, 1, "b", False), (3, 0, "open", False)], CHUNK).write.mode("append").parquet(src)
    got = {r.message_id: (r.answer_text, r.n_chunks) for r in chat.run_fold(spark, src, out, ck).collect()}
    assert got == {1: ("abc", 3), 2: ("x", 1)}


def test_running_streams_are_stopped_by_id(spark, tmp_path):
    spark.createDataFrame([(1, 0, "a", False)], CHUNK).write.parquet(str(tmp_path / "src"))
    query = spark.readStream.schema(CHUNK).parquet(str(tmp_path / "src")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).start()
    running = chat.Registry()
    running.put(7, query)
    assert running.stop(7) and not query.isActive and not running.stop(7)
    running.put(8, query)
    running.remove(8)
    assert not running.stop(8)


def test_models_are_tried_again_and_then_given_up(spark):
    calls = []

    def busy(texts):
        calls.append(texts)
        raise ConnectionError

    assert cache.tried(busy, ["a", "b"], 3) == [None, None] and len(calls) == 3
    assert cache.tried(lambda t: t[1:], ["a"]) == [None]

    def failing(texts):
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    from pyspark.sql import types as T

    rows = spark.createDataFrame([("a",), ("bad",), (None,), ("c",)], "t string").coalesce(1)
    assert [r.x for r in rows.select(cache.model_call("t", failing, T.StringType(), at_once=1).alias("x")).collect()] == ["A", None, None, "C"]


def test_lookups_expire():
    now, loads = [0.0], []
    held = cache.LookupCache(live=60, idle=20, clock=lambda: now[0], most=2)
    load = lambda k: loads.append(k) or len(loads)
    assert [held.get("a", load), held.get("a", load)] == [1, 1]
    for now[0] in (15, 30, 45, 59):
        assert held.get("a", load) == 1
    now[0] = 61
    assert held.get("a", load) == 2
    now[0] = 82
    assert held.get("a", load) == 3
    held.get("b", load), held.get("c", load)
    assert len(held._held) == 2


def test_pdf_pages(spark, tmp_path):
    from millrace.sources import pdf

    (tmp_path / "a.pdf").write_bytes(pdf.simple_pdf(["one (1) \\ é\nline two", "page two"]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = sorted((r.path.rpartition("/")[2], r.page, r.text) for r in pdf.pdf_pages(spark, str(tmp_path)).collect())
    assert got == [("a.pdf", 0, "one (1) \\ é\nline two"), ("a.pdf", 1, "page two")]
    moved = b"BT 1 0 0 1 50 700 Tm (right) Tj 1 0 0 1 10 700 Tm [(le) -20 (ft )] TJ 0 -14 Td <6C6F77> Tj ET"
    assert pdf._page_text(moved) == "left right\nlow"

    def refusing(data):
        raise ValueError

    files = spark.createDataFrame([(1, b"x")], "id long, content binary")
    assert [tuple(r) for r in pdf.pages_of(files, "id", refusing).collect()] == [(1, None, None)]


def test_conversion_reads_what_the_caches_lack(spark):
    from millrace.operators.convert import to_markdown
    from millrace.sources.pdf import simple_pdf

    files = spark.createDataFrame([(1, simple_pdf(["a", "b"])), (2, simple_pdf(["a", "b"])), (3, simple_pdf(["b", "c"])), (4, b"")], "id long, content binary")
    none = spark.createDataFrame([], "md5 string, markdown string")
    known = spark.createDataFrame([("92eb5ffee6ae2fec3ad71c777531578f", "B!")], "md5 string, markdown string")
    rows, documents, pages = to_markdown(files, none, known, lambda m: m.withColumn("markdown", F.upper("text")))
    assert {r.id: r.markdown for r in rows.collect()} == {1: "A\n\nB!", 2: "A\n\nB!", 3: "B!\n\nC", 4: ""}
    assert documents.count() == 3 and sorted(r.markdown for r in pages.collect()) == ["A", "B!", "C"]


def test_web_pages_by_suffix(spark):
    from millrace.sources.pdf import simple_pdf
    from millrace.sources.web import web_pages

    rows = [(1, "http://a/x.PDF?y=1", simple_pdf(["p", "q"])), (2, "http://a/pdf", b"<p>a &amp; b&nbsp;c &lt;i&gt;</p>"), (3, None, b"\xff<b>z</b>"), (4, "http://a/none.pdf", b"")]
    got = {r.page_id: (r.text, r.html is None) for r in web_pages(spark.createDataFrame(rows, "page_id long, url string, content binary"), "page_id").collect()}
    assert got[1] == ("p\nq", True) and got[2] == ("a & b c <i>", False) and got[3][0].endswith("z") and got[4] == ("", True)


def test_named_sql_texts():
    from millrace.sources.sqltexts import parse

    assert parse("--# a.b\nSELECT 1;\n\n--# c\nSELECT 2\nFROM x") == {"a.b": "SELECT 1", "c": "SELECT 2\nFROM x"}
    with pytest.raises(ValueError):
        parse("--# a\nx\n--# a\ny")


def test_specs_are_checked(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "ab", 7)], "id int, name string, n int")
    ids = lambda **spec: [r.id for r in dml.apply_spec(df, spec).collect()]
    assert ids() == [1, 2, 3] and ids(where=[("name", "contains", "b"), ("n", ">", 5)]) == [3] and ids(where=[("n", "null", True)]) == [1] and ids(where=[("n", "=", None)]) == [1]
    assert ids(order=[("id", True)], page=1, size=2) == [3, 2] and ids(page=2, size=2) == [3] and ids(where=[("name", "starts", "a"), ("id", "in", [1, 2])]) == [1]
    for bad in ({"columns": ["x"]}, {"where": [("id; --", "=", 1)]}, {"where": [("id", "~", 1)]}, {"order": [("x", True)]}):
        with pytest.raises(ValueError):
            dml.apply_spec(df, bad)


def test_error_events(spark):
    lines = spark.createDataFrame([(1, 'data: {"error":{"message":"no\nway"}}'.replace("\n", "\\n")), (2, None), (3, "data: [DONE]")], "id long, line string")
    assert {r.id: r.frame for r in chat.error_events(lines, ["id"]).collect()} == {1: "event: error\ndata: no\ndata: way\n\n", 2: "event: error\ndata: response body is null\n\n"}


def test_scratch_folders_need_a_shared_one_on_a_cluster(spark, monkeypatch):
    from millrace import session

    assert session.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.scratch(Session(), "x")
