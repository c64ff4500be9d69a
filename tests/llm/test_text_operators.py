from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import decontaminate, license_scan, license_templates, toxicity
from millrace.llm.common import span_hashes, strings, table, word_spans, raw


def test_word_spans_and_hashes():
    texts = ["ab cd", "", "éa,b", "cd ab", "x" * 40, "x" * 40 + "y"]
    buf, offsets = raw(strings(pa.array(texts)))
    s, e, d = word_spans(buf, offsets)
    words = [bytes(buf[a:b]).decode() for a, b in zip(s, e)]
    assert words == ["ab", "cd", "éa", "b", "cd", "ab", "x" * 40, "x" * 40 + "y"] and d.tolist() == [0, 0, 2, 2, 3, 3, 4, 5]
    h = span_hashes(buf, s, e)
    assert h[0] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 6


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    fit_on = labels.where("doc_id % 3 <> 0")
    model = toxicity.train(docs, fit_on, 2000)
    got = toxicity.severities(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth"), "doc_id").collect()
    hit = sum(r.toxic and r.truth == 1 for r in got)
    assert hit >= 0.8 * sum(r.truth == 1 for r in got) and hit >= 0.97 * sum(r.toxic for r in got)


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 400)
    row = np.concatenate([np.arange(400), np.flatnonzero(grade > 0), np.flatnonzero(grade > 1)])
    bucket = np.concatenate([np.zeros(400, int), np.full((grade > 0).sum(), 1), np.full((grade > 1).sum(), 2)])
    m = toxicity.fit(row, bucket, grade)
    assert len(m.thresholds) == 2 and m.thresholds[0] < m.thresholds[1] and 0 < m.weights[1] and 0 < m.weights[2]


def test_gradient_and_fit_against_brute_force():
    """The gradient is that of the loss by differences, the fit ends where it is zero, and a grid of models has none better."""
    rng = np.random.default_rng(1)
    n, width = 60, 3
    x = rng.random((n, width)) < 0.4
    grade = np.clip((x @ [1.5, -1.0, 0.7] + rng.logistic(size=n) > 0.3).astype(int) + (x[:, 0] & (rng.random(n) < 0.5)), 0, 2)
    row, column = np.nonzero(x)
    w = np.concatenate([rng.standard_normal(width), [0.3, -0.4]])
    _, g = toxicity.loss(w, row, column, grade, width, 0.1)
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-5
        assert abs((toxicity.loss(w + step, row, column, grade, width, 0.1)[0] - toxicity.loss(w - step, row, column, grade, width, 0.1)[0]) / 2e-5 - g[k]) < 1e-6
    m = toxicity.fit(row, column, grade)
    at = np.concatenate([m.weights[:width], [m.thresholds[0], np.log(m.thresholds[1] - m.thresholds[0])]])
    least, g = toxicity.loss(at, row, column, grade, width, 0.1)
    assert np.abs(g).max() < 1e-4
    for _ in range(300):
        assert toxicity.loss(at + rng.standard_normal(len(at)) * rng.choice([0.01, 0.3, 2.0]), row, column, grade, width, 0.1)[0] >= least - 1e-7
    texts = strings(pa.array(["", "a"]))
    p = [1 / (1 + np.exp(-(0 - t))) for t in m.thresholds]
    assert m.severity(texts)[0] == pytest.approx(sum(p))


def test_a_fit_is_bounded_in_rows_and_features(spark):
    docs = spark.range(3000).selectExpr("id % 30 AS doc_id", "concat('word', id % 7, if(id % 30 < 10, ' badword nasty', ' fine good'), ' x', id) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "if(id < 10, 1, 0) AS toxic")
    sample = toxicity.sampled(docs, labels, 20).collect()
    assert len(sample) == len({r.doc_id for r in sample}) == 20
    model = toxicity.train(docs, labels, 20, 5)
    assert 0 < (model.weights != 0).sum() <= 5
    got = toxicity.severities(docs, model).collect()
    assert all(r.toxic == (r.doc_id < 10) for r in got)


def test_few_labels_are_enough_for_most(spark):
    """Some 400 labelled rows, 51 of them toxic and 36 of these English, tested on other documents: what five examples of a language can't teach is missed."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.train(docs, labels)
    far = table(spark, "/root/testdata/sf0.1", "documents").where("doc_id >= 1000")
    got = toxicity.severities(far, model).join(table(spark, "/root/testdata/sf0.1", "labels").withColumnRenamed("toxic", "truth"), "doc_id").join(far.select("doc_id", "lang"), "doc_id").collect()
    hit = sum(r.toxic and r.truth == 1 for r in got)
    english = [r for r in got if r.truth == 1 and r.lang == "en"]
    assert hit >= 0.65 * sum(r.truth == 1 for r in got) and hit >= 0.85 * sum(r.toxic for r in got) and sum(r.toxic for r in english) >= 0.85 * len(english)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    assert toxicity.severities(odd_docs, model).count() == odd_docs.count()
    one = toxicity.train(odd_docs, labels.where("doc_id = 1"))
    assert {r.severity for r in toxicity.severities(odd_docs, one).collect()} == {0.0}
    none = toxicity.train(no_docs, labels)
    assert toxicity.drop_toxic(odd_docs, none).columns == odd_docs.columns and toxicity.drop_toxic(no_docs, none).count() == 0


def test_lcs():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        assert decontaminate.lcs(a, b) == slow(a, b)


def plain(t):
    return " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "


def test_verbatim_leaks_against_brute_force(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if plain(i.text) in plain(d.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert want and want == got


def test_paraphrases_are_found_and_their_neighbours_left_alone(spark, sf):
    """Items with a quarter of their words replaced, inside other documents."""
    rng = random.Random(2)
    items = [r for r in table(spark, sf, "benchmark").collect()]
    docs = [r for r in table(spark, sf, "documents").where("lang = 'en'").collect()][:60]
    rows = []
    for k, i in enumerate(items):
        w = i.text.split()
        for j in rng.sample(range(len(w)), len(w) // 4):
            w[j] = f"other{j}"
        d = docs[k].text.split()
        rows.append((k, " ".join(d[:40] + w + d[40:])))
    clean = [(1000 + k, " ".join(d.text.split()[:40])) for k, d in enumerate(docs)]
    leaks = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows + clean, "doc_id long, text string"), table(spark, sf, "benchmark")).collect()}
    found = sum((k, i.item_id) in leaks for k, i in enumerate(items))
    assert found >= 0.9 * len(items)


def test_candidate_search_recall(spark):
    """The latent space has fewer directions than the benchmark has passages, and candidates hold nine in ten or more of the windows that brute force puts at a cosine of 0.5."""
    docs, items = table(spark, "/root/testdata/sf0.1", "documents").where("doc_id < 2500"), table(spark, "/root/testdata/sf0.1", "benchmark")
    idf, sample = decontaminate.survey(docs)
    passages = decontaminate.Passages(decontaminate.passages_of(items).toArrow().combine_chunks(), idf)
    packed = [(decontaminate.bucket_of(w).astype(np.int32).tobytes(),) for w in passages.words]
    space = decontaminate.latent_space(sample.unionByName(spark.createDataFrame(packed, "words binary")), idf)
    assert space.shape == (decontaminate.COARSE + 1, decontaminate.RANK) and decontaminate.RANK < len(passages.words) < sample.count() <= decontaminate.SAMPLE
    h, doc = decontaminate.words(strings(docs.toArrow().column("text")))
    got = {(s, k) for s, _, k, _ in decontaminate.Searcher(passages, idf, space).candidates(h, doc)}
    full = np.zeros((len(packed), decontaminate.BUCKETS), np.float32)
    for k, w in enumerate(passages.words):
        b, n = np.unique(decontaminate.bucket_of(w), return_counts=True)
        full[k, b] = n * idf[b] / np.linalg.norm(n * idf[b])
    want = set()
    begin, size = decontaminate.runs(doc)
    for a, n in zip(begin.tolist(), size.tolist()):
        for s in range(a, max(a + 1, a + n - decontaminate.STEP), decontaminate.STEP):
            b, times = np.unique(decontaminate.bucket_of(h[s : min(s + decontaminate.WINDOW, a + n)]), return_counts=True)
            x = times * idf[b]
            want.update((s, int(k)) for k in np.flatnonzero(full[:, b] @ x / np.linalg.norm(x) >= 0.5))
    assert len(want) > 50 and len(want & got) >= 0.9 * len(want)


def test_projected_windows_are_those_of_brute_force(monkeypatch):
    """Places and cosines of the windows of texts of many lengths, by the plain sums of their words' coordinates."""
    rng = np.random.default_rng(3)
    sizes = [1, 5, 15, 16, 17, 31, 32, 33, 48, 49, 200, 3]
    h = rng.integers(0, 1 << 63, sum(sizes)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    doc = np.repeat(np.arange(len(sizes)) * 2, sizes)
    idf = rng.random(decontaminate.BUCKETS) + 0.5
    space = np.concatenate([rng.standard_normal((decontaminate.COARSE, 12)), np.zeros((1, 12))]).astype(np.float32)
    passages = decontaminate.Passages.__new__(decontaminate.Passages)
    passages.item, passages.words, passages.answer = [1, 2, 3], [h[40:80], h[100:105], h[10:17]], [h[:1]] * 3
    searcher = decontaminate.Searcher(passages, idf, space)
    monkeypatch.setattr(decontaminate, "LEAST_COSINE", -2)
    got = {(s, e, k): c for s, e, k, c in searcher.candidates(h, doc)}
    want = {}
    begin = np.cumsum(sizes) - sizes
    for step, wide, own in ((16, 32, [0]), (8, 16, [1, 2])):
        for a, n in zip(begin.tolist(), sizes):
            for s in range(a, a + max(1, -(-(n - wide) // step) * step + 1), step):
                e = min(s + wide, a + n)
                x = (idf[decontaminate.bucket_of(h[s:e])][:, None] * space[decontaminate.bucket_of(h[s:e]) >> decontaminate.WIDER]).sum(axis=0)
                for k in own:
                    b = decontaminate.bucket_of(passages.words[k])
                    q = (idf[b][:, None] * space[b >> decontaminate.WIDER]).sum(axis=0)
                    want[s, e, k] = x @ q / np.linalg.norm(x) / np.linalg.norm(q)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_short_passages_occur_whole(spark):
    items = spark.createDataFrame([(1, "quokka zeppelin"), (2, "Wombat!"), (3, "five little numbat friends here")], "item_id long, text string")
    far = " ".join(f"w{k}" for k in range(100))
    rows = [(1, f"{far} quokka was seen far away from the old zeppelin {far}"), (2, f"{far} the Quokka, zeppelin {far}"), (3, f"{far} a wombat"), (4, far), (5, f"{far} five little numbat friends here {far}"), (6, "zeppelin quokka")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(2, 1), (3, 2), (5, 3)}


def test_leaks_are_dropped_by_row(spark, sf):
    """Rows under the doc_id of a leak stay if they have none, and rows without a doc_id go if they have one."""
    item = table(spark, sf, "benchmark").orderBy("item_id").first().text
    far = " ".join(f"w{k}" for k in range(100))
    rows = [(1, f"{far} {item}"), (1, far), (None, f"{item} {far}"), (None, far), (1, f"{far} {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in decontaminate.drop_leaks(docs, table(spark, sf, "benchmark")).collect()] == [(1, far), (None, far)]
    assert sum(r.doc_id == 1 for r in decontaminate.leaks(docs, table(spark, sf, "benchmark").orderBy("item_id").limit(1)).collect()) == 2


def test_leaks_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Same text here, with six words", "six"), (2, None, None), (3, "", None), (None, "alone without an id", None), (4, "absent words that nobody wrote down", "x")], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd_docs, items).collect()}
    assert got == {(1, 1), (2, 1), (None, None)}
    kept = decontaminate.drop_leaks(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert decontaminate.leaks(no_docs, items).count() == 0 and decontaminate.leaks(odd_docs, items.limit(0)).count() == 0


def test_benchmark_in_blocks(spark, sf, monkeypatch):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 15)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == whole


def test_verbatim_leaks_of_a_benchmark_of_thousands(spark):
    """Far more passages than the latent space has directions; each is found where it was put."""
    texts = [r.text.split() for r in table(spark, "/root/testdata/sf0.1", "documents").where("lang = 'en'").orderBy("doc_id").limit(4000).collect()]
    texts = [t for t in texts if len(t) >= 160]
    n = 2000
    assert len(texts) > 1
    rng = random.Random(4)
    items = []
    for k in range(n):
        t = texts[rng.randrange(len(texts))]
        at = rng.randrange(len(t) - 40)
        items.append((k, " ".join(t[at : at + 38])))
    items.append((n, " ".join(f"own{j}" for j in range(64 * 300))))
    docs = []
    for k, text in items[:n]:
        t = texts[rng.randrange(len(texts))][:80]
        docs.append((k, " ".join([*t[:40], *text.split(), *t[40:]])))
    docs.append((n, " ".join(f"own{j}" for j in range(64 * 280, 64 * 281))))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(got) == len(found) and {(k, k) for k in range(n + 1)} <= got


WORD = r"[a-z0-9\u0080-\U0010ffff]+"


def brute_licenses(texts, threshold=0.8):
    def grams(t):
        w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        return set(zip(w, w[1:]))

    known = [(k, grams(t)) for k, t in license_templates.templates() if len(t) < 4000]
    out = {}
    for i, t in enumerate(texts):
        units = t.split("\n") + [t] + re.split(r"\n(?:[^A-Za-z0-9\u0080-\U0010ffff\n]*\n)+", t) + re.split(r"\n|(?<=[.!?])(?=[ \n\r\t])", t)
        for g in filter(None, map(grams, units)):
            dice, name = min((-2 * len(g & x) / (len(g) + len(x)), k) for k, x in known)
            if -dice >= threshold:
                out[i, name] = max(out.get((i, name), 0), -dice)
    return out


def test_licenses_against_brute_force(spark, sf):
    own = [(k, t) for k, t in license_templates.templates() if len(t) < 4000]
    texts = [r.text for r in table(spark, sf, "documents").collect()][:80]
    texts += [f"x y z\n\n{own[0][1]}\n\nmore words", own[2][1].replace("CONTRIBUTORS", "OTHERS"), "Licensed under CC BY-SA 4.0. And more.", "Licensed under the MIT licence", "Released under the MIT License."]
    got = license_scan.Matcher(own).scan(strings(pa.array(texts)))
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v, 9) for k, v in brute_licenses(texts).items()}


def test_licenses_of_odd_rows(odd_docs, no_docs):
    assert license_scan.scan(odd_docs).count() == 0 and license_scan.scan(no_docs).count() == 0


def test_every_template_matches_itself():
    known = license_templates.templates()
    got = license_scan.Matcher(known).scan(strings(pa.array([t for _, t in known])))
    assert all((k, name) in got for k, (name, _) in enumerate(known))
    whole = {name for name, t in known if len(t) > 4000}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= whole


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"])
def test_whole_licences_inside_long_texts(name):
    """A whole text with a copyright line of its own and code around it; its parts are not taken for other licences."""
    text = max((t for k, t in license_templates.templates() if k == name), key=len)
    code = "\n".join(f"value{k} = call_{k % 7}(value{k - 1}, {k})" for k in range(300))
    got = license_scan.Matcher(license_templates.templates()).scan(strings(pa.array([f"{code}\n\nCopyright 2020 Some Body\n\n{text}\n\n{code}"])))
    assert got[0, name][0] >= 0.95


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "Unlicense", "BSL-1.0", "Zlib"])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_licenses_of_several_paragraphs_inside_long_texts(name, mark):
    """A blank or empty comment line after each of the licence's lines, or most of them, then code."""
    text = next(t for k, t in license_templates.templates() if k == name and len(t) > 120)
    notice = "\n".join(mark + line + ("\n" + mark.rstrip() if k % 3 else "") for k, line in enumerate(text.split("\n")))
    code = "\n".join(f"value{k} = call_{k % 7}(value{k - 1}, {k})" for k in range(200))
    got = license_scan.Matcher(license_templates.templates()).scan(strings(pa.array([f"{notice}\n\n{code}", f"{code}\n\n{notice}\n\n{code}", code])))
    assert {k: v[0] >= 0.95 for k, v in got.items()} == {(0, name): True, (1, name): True}


def test_windows_against_all_runs_of_pieces():
    """The best coefficient of a licence is that of the best run of lines, and repeated licences cost no more than their length."""
    rng, own = random.Random(3), license_templates.templates()[:2]
    lines = [x for _, t in own for x in t.split("\n")]
    matcher = license_scan.Matcher(own)
    hits = 0
    for _ in range(30):
        text = []
        for line in own[0][1].replace(".", "").split("\n"):
            text += [line] + ["", "other words here"] * rng.randint(0, 1) + [rng.choice(lines).replace(".", "")] * (rng.random() < 0.1)
        text = ["begin of file"] * rng.randint(0, 40) + text + [f"end{k} of{k} file{k}" for k in range(60)]
        want = 0.0
        for a in range(len(text)):
            for b in range(a + 1, len(text) + 1):
                w = re.findall(WORD, " ".join(text[a:b]).lower())
                g, x = set(zip(w, w[1:])), re.findall(WORD, own[0][1].lower())
                x = set(zip(x, x[1:]))
                want = max(want, 2 * len(g & x) / (len(g) + len(x)))
        got = matcher.scan(strings(pa.array(["\n".join(text)]))).get((0, "MIT"), (0.0, 0))[0]
        hits += want >= 0.8
        assert round(got, 9) == (round(want, 9) if want >= 0.8 else 0)
    assert hits
    assert set(matcher.scan(strings(pa.array(["\n\n".join([own[0][1]] * 400)])))) == {(0, "MIT")}


def test_verbatim_copies_of_any_length(spark):
    """Pieces of 5 to 64 words of real texts, put whole into other texts, at their edges and among repeats of one word; none is lost."""
    texts = [r.text.split() for r in table(spark, "/root/testdata/sf0.1", "documents").where("lang <> 'de'").orderBy("doc_id").limit(3000).collect()]
    texts = [t for t in texts if len(t) >= 160]
    rng, items, docs = random.Random(8), [], []
    for k in range(360):
        t, size = texts[rng.randrange(len(texts))], (5, 6, 7, 8, 9, 12, 16, 17, 24, 33, 48, 64)[k % 12]
        at = rng.randrange(len(t) - size)
        piece = t[at : at + size]
        other = texts[rng.randrange(len(texts))][: rng.choice([0, 20, 90])]
        junk = ["again"] * rng.choice([0, 0, 80])
        items.append((k, " ".join(piece)))
        docs.append((k, " ".join([*other, *junk, *piece, *junk, *other[: rng.choice([0, 30])]])))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    words = {k: [w for w in re.findall(r"[^\W_]+|[^\x00-\x7f]+", t)] for k, t in items}
    assert {(k, k) for k, w in words.items() if w} <= {(r.doc_id, r.item_id) for r in found}
    assert all(r.lcs == 1.0 for r in found if r.doc_id == r.item_id)
