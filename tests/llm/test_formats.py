from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import chat_format, dac, html_extract, maxplus, sentencepiece_codec, token_output, warc
from millrace.llm.common import put_file, shared_dir, strings, table

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.sampled_from([8, 16]))
def test_dac_round_trip_and_random_access(ids, bits):
    f = dac.DacFile(dac.encode(np.array(ids, np.uint32), [None, 5], np.array([0, len(ids) // 2, len(ids)]), bits))
    assert f.ids().tolist() == ids and f.doc_ids == [None, 5]
    data, reads = dac.encode(np.array(ids, np.uint32), [None, 5], np.array([0, len(ids) // 2, len(ids)]), bits), []
    far = dac.DacFile(lambda offset, n: reads.append(n) or data[offset : offset + n])
    for i in random.Random(0).sample(range(len(ids)), min(len(ids), 40)):
        reads.clear()
        assert f.token(i) == far.token(i) == ids[i] and sum(reads) <= 4 * (2 + 64 + 8)
    assert far.ids().tolist() == ids and far.starts.tolist() == [0, len(ids) // 2, len(ids)]
    with pytest.raises(IndexError):
        f.token(len(ids))


def test_words_are_encoded_as_the_library_does():
    t = Tokenizer.from_file(WORDS)
    texts = ["it's <|endoftext|> ÀÉ×÷ ªº µ İ ΣΑΣ áb ́x 漢字 x y DON'T, 'S' \"q\" é.. A1b2 _x_ ~~ ½ ß ẞ ÿ! é'l ü&&& <|startoftext|>,", "", None, "a" * 5000, "Tabs\tand\n\n\nlines\x0b\x0c"]
    ids, starts = token_output.encode_texts(strings(pa.array(texts)), WORDS)
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_token_files(spark, sf, odd_docs, no_docs):
    t = Tokenizer.from_file(WORDS)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    at = 0
    got = {r.doc_id: r for r in token_output.token_files(docs, WORDS, ids_per_file=5000).collect()}
    for r in sorted(docs.collect()):
        ids = t.encode(r.text, add_special_tokens=False).ids + [1]
        assert tuple(got[r.doc_id])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    folder = shared_dir(spark, "t-ids")
    manifest = token_output.write_ids(docs, folder, WORDS, ids_per_file=3000)
    whole = np.concatenate([t.encode(r.text, add_special_tokens=False).ids + [1] for r in sorted(docs.collect())])
    for position in [0, 2999, 3000, len(whole) - 1, *random.Random(1).sample(range(len(whole)), 8)]:
        assert token_output.token_at(manifest, folder, position) == whole[position]
    odd = sorted(token_output.token_files(odd_docs, WORDS, 16, 100).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in odd] == [None, None, 1, 2, 3, 4, 5, 7, 8, 9, 9, 10, 11]
    assert [r.start for r in odd][1:] == np.cumsum([r.n_tokens for r in odd])[:-1].tolist()
    assert token_output.token_files(no_docs, WORDS).count() == 0


@pytest.fixture(scope="module")
def model():
    path = sentencepiece_codec.model_path()
    return path, *sentencepiece_codec.load(path)


def by_chunks(path, v, text, size):
    parts = maxplus.split(v, sentencepiece_codec.marked(text), size)
    states = maxplus.scan([maxplus.Chunk(v, *p).transfer() for p in parts])
    return [i for p, s in zip(parts, states) for i in sentencepiece_codec.encode_chunk(path, *p, *s)]


def test_chunked_encoding_is_the_librarys(model):
    path, sp, v = model
    rng = random.Random(4)
    makers = [lambda: "".join(rng.choice("aàbcé漢字語🙂 \n") for _ in range(200)), lambda: " " * rng.randint(1, 150) + "The cat  sat" + " " * 90, lambda: "".join(rng.choice("abcdefgh") for _ in range(400)), lambda: "some words and<s> ▁▁ more international considerations " * 9]
    for k in range(60):
        text = makers[k % 4]()
        assert by_chunks(path, v, text, rng.choice([3, 17, 40, 100])) == sp.encode(text)


def test_transfer_matrices_have_the_states_of_cut_words(model):
    """A chunk that begins inside a word has several entries, and its matrix is that of a scan without safe edges."""
    path, sp, v = model
    text = sentencepiece_codec.marked("the international considerations of unbelievable misunderstandings " * 3)
    several = 0
    for p in maxplus.split(v, text, 50)[1:-1]:
        c = maxplus.Chunk(v, *p)
        whole = c._dense(c.body + c.right, len(c.body), c.entries(), c._exit)
        got = c.transfer()
        assert got == whole
        several += len(got) > 1
    assert several


def _field(number, value):
    return bytes([number << 3, value]) if isinstance(value, int) else bytes([number << 3 | 2, len(value)]) + value


def test_models_that_normalise_are_refused(model):
    with open(model[0], "rb") as f:
        assert sentencepiece_codec.kind_of(f.read()) == 2
    plain = _field(4, 0)
    bpe = _field(3, 2)
    assert sentencepiece_codec.kind_of(_field(2, bpe) + _field(3, plain)) == 2
    for trainer, rules, more in ((bpe, b"", b""), (bpe, plain + _field(2, b"x"), b""), (bpe, plain + _field(3, 0), b""), (bpe, plain + _field(5, 0), b""), (_field(3, 3), plain, b""), (bpe, plain, _field(1, _field(1, b"abc") + _field(3, 4)))):
        with pytest.raises(ValueError):
            sentencepiece_codec.kind_of(more + _field(2, trainer) + _field(3, rules))


def test_unigram_scan_against_brute_force():
    rng = random.Random(1)
    pieces = {p: (k, -rng.random() * 5) for k, p in enumerate(["▁", "a", "b", "ab", "ba", "aab", "▁a", "bb", "abab", "▁ab"])}
    v = maxplus.Vocabulary(pieces, False, None, 99)
    for _ in range(60):
        text = maxplus.SPACE + "".join(rng.choice("abc") for _ in range(40))
        best, back = {0: 0.0}, {}
        for p in range(len(text)):
            for piece in v.starting(text, p):
                score = best[p] + v.weight("", piece)
                if score > best.get(p + len(piece), float("-inf")):
                    best[p + len(piece)], back[p + len(piece)] = score, piece
        parts = maxplus.split(v, text, 9)
        matrices = [maxplus.Chunk(v, *p).transfer() for p in parts]
        left, right = matrices[0], matrices[-1]
        for m in matrices[1:]:
            left = maxplus.combine(left, m)
        for m in matrices[-2::-1]:
            right = maxplus.combine(m, right)
        assert left[maxplus.SAFE][maxplus.SAFE] == pytest.approx(best[len(text)]) == pytest.approx(right[maxplus.SAFE][maxplus.SAFE])
        got = [x for p, s in zip(parts, maxplus.scan(matrices)) for x in maxplus.Chunk(v, *p).trace(*s)]
        assert "".join(got) == text and sum(v.weight("", x) for x in got) == pytest.approx(best[len(text)])


def test_giants_over_spark(spark, model, odd_docs, no_docs):
    path, sp, _ = model
    docs = spark.createDataFrame([(1, "a" * 900 + "漢字" * 300), (2, " ".join(f"w{k}" for k in range(900))), (3, " " * 700 + "x"), (3, "short")], "doc_id long, text string")
    coded = sentencepiece_codec.encode(docs, path, giant=300, chunk=150, block=3)
    got = coded.collect()
    assert sorted(r.ids for r in got) == sorted(sp.encode(r.text) for r in docs.collect()) and all(r.round_trip for r in got)
    assert sorted(r.text for r in sentencepiece_codec.decode(coded, path).collect()) == sorted(r.text for r in docs.collect())
    odd = sentencepiece_codec.encode(odd_docs, path).collect()
    assert sorted(map(len, (r.ids for r in odd))) == sorted(len(sp.encode(r.text or "")) for r in odd_docs.collect()) and all(r.round_trip for r in odd)
    assert sentencepiece_codec.encode(no_docs, path).count() == 0


PAGES = "page_id long, url string, html string, digest string"


def test_warc(spark):
    big, other = "<p>" + "x" * 200, "é" * 60
    rows = [(3, "http://a/1", big), (2, None, big), (9, "http://a b/\r\n", big), (1, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (None, "n", other), (None, "n", other), (2, "again", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES).repartition(3)
    folder = shared_dir(spark, "t-warc")
    assert warc.write_archives(pages, folder, bytes_per_file=300).agg({"n_records": "sum"}).first()[0] == len(rows)
    got = warc.resolve(warc.read_archives(spark, f"{folder}/archives")).collect()
    assert len(got) == len(rows) and sorted((r.page_id, r.refers_to, r.payload_bytes) for r in got if r.record_type == "revisit" and r.page_id) == [(3, 2, 203), (9, 2, 203)]
    assert sum(r.record_type == "revisit" and r.page_id is None and r.refers_to == 2 for r in got) == 1
    assert sum(r.payload_digest == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" for r in got) == 2
    assert warc.write_archives(pages.limit(0), shared_dir(spark, "t-warc")).count() == 0


def test_archives_of_lost_tasks_and_repeated_rows(spark):
    """What a manifest doesn't name isn't read; each record has an id of its own, and revisits refer to one that is there; dates are those of the writing."""
    big = "<p>" + "x" * 200
    rows = [(2, "a", big), (2, "a", big), (2, "b", big), (5, "c", big), (7, "d", "tiny"), (7, "d", "tiny"), (None, "e", "tiny"), (None, "e", "tiny")]
    folder = shared_dir(spark, "t-warc")
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), folder)
    put_file(f"{folder}/archives/pages-000000-999999-000000.warc.gz", warc.record(2, "a", big.encode()))
    heads = warc.read_archives(spark, f"{folder}/archives", manifest).collect()
    assert len(heads) == len(rows) == len({h.record_id for h in heads}) == warc.read_archives(spark, f"{folder}/archives").count() - 1
    assert {h.refers_to_record for h in heads if h.record_type == "revisit"} <= {h.record_id for h in heads if h.page_id == 2}
    head, _ = next(warc.records(warc.record(1, "u", b"y")))
    assert head["warc-date"][:4] >= "2024" and head["warc-date"] != "2024-01-01T00:00:00Z"


def test_long_payloads_are_kept_whole(spark):
    long = "".join(chr(97 + k % 26) + "é" for k in range(3_000_000))
    pages = spark.createDataFrame([(1, "http://a/", long), (2, "http://a/", long), (3, "http://a/", long + "x")], "page_id long, url string, html string")
    folder = shared_dir(spark, "t-warc")
    warc.write_archives(pages, folder)
    got = {r.page_id: tuple(r)[1:] for r in warc.resolve(warc.read_archives(spark, f"{folder}/archives")).collect()}
    digest = hashlib.sha256(long.encode()).hexdigest()
    assert got[1] == (9_000_000, digest, "response", None) and got[2] == (9_000_000, digest, "revisit", 1) and got[3][:1] == (9_000_001,) and got[3][2] == "response"


def test_records_of_plain_archives():
    import gzip

    data = b"".join(gzip.decompress(warc.record(k, "http://x/", b"y" * k)) for k in (1, 300))
    assert [len(b.partition(b"\r\n\r\n")[2]) for _, b in warc.records(data)] == [1, 300]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header class="site-header"><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav>
<div class="cookie-notice">We use cookies for everything that you do here, always.</div><div id="main"><div class="post p{0}"><h1>Title {0} &amp; more</h1><p>First&nbsp;paragraph of some length,<br>with <b>bold</b> text.
<p>Second one &lt;here&gt;<ul><li>item one<li>item two</ul><form><input name=x><button>Send</button></form><div class="ad">Buy this</div><script>var t="</p>";</script></div>
<div class="sidebar"><p>Related reading that is rather long as well, in truth.</p></div><div class="comments"><p>A reader says something long about the article above, and more.</p></div></div><footer>&copy; x</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(k, f"https://Host.example.com:80/{k}", PAGE.format(k)) for k in range(5)] + [(5, None, None), (6, "no url", ""), (7, "http://o/", "plain words only"), (8, "http://o/", "<div><p>Unclosed <b>tags <i>here"), (None, "http://o/", "<svg/><p>x</p><!-- open"), (9, "http://t/", '<article class="has-comments"><table><tr><td>a<td>b</td></tr><tr><th>c</th></tr></table></article>')]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame([(*r, "x") for r in rows], PAGES)).collect()}
    for k in range(5):
        assert got[k] == f"Title {k} & more\nFirst paragraph of some length, with bold text.\nSecond one <here>\nitem one\nitem two"
    assert (got[5], got[6], got[7], got[8], got[None]) == ("", "", "plain words only", "Unclosed tags here", "x")
    assert got[9] == "a b\nc"
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_host_path_serves_pages_that_score_otherwise():
    page = html_extract.Page('<body><div class="a1"><p>short</p></div><div class="b"><p>' + "long " * 50 + "</p></div></body>")
    other = html_extract.Page('<body><div class="a22">x</div></body>')
    assert page.text(page.at_path(other.path[2])) == "short"


def extracted(html):
    return html_extract.main_text(html, None)


FILL = "Some words of the article itself that make it long enough to win. " * 4


@pytest.mark.parametrize(
    "inside,want",
    [
        ('<h2 id="related-work">Related work</h2><h3 id="search">Search</h3><p class="alert-level">Level</p>', "Related work\nSearch\nLevel"),
        ('<section id="comments-on-method"><p>On method</p></section><section id="search"><p>Searching</p></section>', "On method\nSearching"),
        ("<p><math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><xmp>a &amp; <b>b</b></xmp><object>shown</object>", "x=2 holds\na &amp; <b>b</b>\nshown"),
        ('<ul class="menu-items"><li>Menu</li></ul><div class="ad-slot">Buy</div><section class="comments"><p>Reader</p></section><div id="comments">Reader</div><div class="share-buttons">Share</div><div role="alert">Now</div>', ""),
        ('<header><p>By someone</p></header><div class="has-comments no-sidebar"><p>Kept</p></div><footer>Gone</footer><aside>Gone</aside>', "By someone\nKept"),
        ('<table class="results"><tr><td>a<td>b<tr><td>c</table><ul><li>one<li>two<ul><li>deep</ul></ul><dl><dt>t<dd>d</dl>', "a b\nc\none\ntwo\ndeep\nt\nd"),
    ],
)
def test_what_goes_and_what_stays_inside_an_article(inside, want):
    for opening in ("<article>", '<main id="main">'):
        got = extracted(f'<body><div class="sidebar">Side</div>{opening}<h1>Title</h1><p>{FILL}</p>{inside}</body>')
        assert got == "\n".join(filter(None, ["Title", FILL.strip(), want]))


@pytest.mark.parametrize(
    "page,want",
    [
        ('<form id="aspnetForm"><input type="hidden" value="x"><div class="top"><a href="/">Home</a></div><div id="c"><h1>Title</h1><p>{}</p></div><input type="submit"></form>', "Title\n{}"),
        ('<form><article><h1>Title</h1><p>{}</p></article><select><option>x</select></form>', "Title\n{}"),
        ('<article><h1>Title</h1><p>{}</p><form><p>Your mail</p><input><button>Go</button></form></article>', "Title\n{}"),
        ('<body><form class="login"><p>Name</p><input name="a"><p>Password</p><input name="b"></form></body>', ""),
        ('<article><p>{}</p><section class="discussion"><p>We discuss.</p></section><div class="responses"><p>They answered.</p></div><div class="dialog"><p>Speak, he said.</p></div></article>', "{}\nWe discuss.\nThey answered.\nSpeak, he said."),
        ('<article><p>{}</p><div class="reader-responses"><p>First!</p></div><section class="comments discussion"><p>Second!</p></section></article>', "{}"),
        ('<article><p>{}</p><p class="advert">Buy</p><p class="cookie-notice">We use them</p><ul><li class="ad">Now</li><li class="admission">Kept</li></ul><span class="comments">3 comments</span><p class="notice-of-terms">Terms</p></article>', "{}\nKept\nTerms"),
        ('<header><h1>Site</h1></header><div class="post"><header><h1>Title</h1></header><p>{}</p></div>', "Title\n{}"),
        ('<div class="post-template"><header>Site</header><div class="entry-content"><p>{}</p></div></div>', "{}"),
        ('<article><p>{}</p><div class="' + "x" * 250 + ' ad-slot">Buy</div></article>', "{}"),
    ],
)
def test_pages_by_what_is_main_text(page, want):
    assert extracted(page.replace("{}", FILL)) == want.replace("{}", FILL.strip())


def test_names_are_matched_whole():
    assert extracted(f'<div class="article subscriber-content"><p>{FILL}</p></div><div>tail</div>') == FILL.strip()
    for name in ("cookie-notice", "site-header", "related-posts", "commentList", "left_sidebar", "ad-728x90", "newsletter-signup", "skip-link"):
        assert html_extract.out_name(name), name
    for name in ("subscriber-content", "related-work", "comments-on-method", "header", "entry-header", "has-sidebar", "alert-level", "adventure", "navigator", "content", "research", ""):
        assert not html_extract.out_name(name), name


@pytest.mark.parametrize("html", ["<b>" * 60_000 + "x", "<div>" * 30_000 + "x", "<p><b>" * 30_000 + "x", "<li><i>" * 30_000 + "x", "</b>" * 60_000 + "x", "<a " * 60_000 + "x", "<table>" * 20_000 + "<tr><td>" * 20_000 + "x", "<div class='a'>" * 20_000 + "x" + "</p>" * 20_000, '<i x="' * 40_000 + "x", "<!-- " * 30_000 + "x"])
def test_odd_pages_take_linear_time(html):
    import time

    began = time.process_time()
    page = html_extract.Page(html + "<p>end " + "long words " * 20_000)
    page.votes()
    page.text([0])
    assert time.process_time() - began < 4


def test_votes_against_brute_force(spark):
    """The winner of each host has the greatest sum of its pages' best scores; all containers vote."""
    rng = random.Random(6)
    rows = []
    for k in range(60):
        boxes = "".join(f'<div class="c{rng.choice("abcdef")}"><p>{"word " * rng.randint(1, 40)}</p></div>' for _ in range(6))
        rows.append((k, f"http://h{k % 4}/{k}", f"<body>{boxes}</body>", "x"))
    total = {}
    for _, url, html, _ in rows:
        best = {}
        page = html_extract.Page(html)
        for s, i in page.scores():
            best[page.path[i]] = max(best.get(page.path[i], 0), round(s * 1000))
        for p, s in best.items():
            total[url[7:9], p] = total.get((url[7:9], p), 0) + s
    want = {h: max((s, html_extract._signed(p)) for (g, p), s in total.items() if g == h)[1] for h, _ in total}
    assert {r.host: r.path for r in html_extract.host_paths(spark.createDataFrame(rows, PAGES)).collect()} == want


def test_given_pages_against_a_pattern(spark, sf):
    import html
    import re

    for r in html_extract.query(spark, sf).join(table(spark, sf, "pages").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


TURNS = "conv_id long, turn long, role string, text string, part long"


def rendered(rows):
    """Brute force: whole texts and spans of each conversation and speaker."""
    out = {}
    convs = {r[0] for r in rows}
    for c in convs:
        own = sorted(((t is not None, t or 0, role or "unknown", x or "") for k, t, role, x in rows if k == c), key=lambda r: (*r[:2], hashlib.md5(f"{r[2]}|{r[3]}".encode()).hexdigest()))
        for s in {o[2] for o in own} - {"system"}:
            text, spans = "", []
            for _, _, role, x in own:
                text += "<|im_start|>" + ("assistant" if role == s else "system" if role == "system" else f"user name={role}") + "\n"
                if role == s:
                    spans.append((len(text), len(text) + len(x) + len("<|im_end|>")))
                text += x + "<|im_end|>\n"
            out[c, s] = text, spans
    return out


@pytest.mark.parametrize("crowd", [4096, 3], ids=["whole turns", "crowded turns"])
def test_rotation_in_parts(spark, crowd):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["amy", "bob", "eve", "system"]), "é🙂" * rng.randint(0, 4)) for c in range(3) for t in range(23)]
    rows += [(7, None, "amy", "late"), (7, 1, None, None), (7, 1, "amy", "tie"), (7, 1, "amy", "tie"), (None, 0, "amy", "x"), (0, 0, "amy", "zero"), (8, 0, "system", "alone"), (9, 5, "amy", "long " * 50_000), (9, 6, "bob", "")]
    rows += [(4, rng.choice([None, 2, 3]), rng.choice(["amy", "bob"]), f"text {k}") for k in range(60)]
    got = chat_format.rotate(spark.createDataFrame([(*r, 5) for r in rows], TURNS), 4, crowd=crowd).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (r.part, r.sub)):
        text, spans = whole.get((r.conv_id, r.speaker), ("", []))
        assert r.char_start == len(text)
        whole[r.conv_id, r.speaker] = text + r.text, spans + [(r.char_start + a, r.char_start + b) for a, b in zip(r.mask_starts, r.mask_ends)]
    assert whole == rendered(rows)
    assert (max(r.n_turns for r in got if r.conv_id == 4) < 20) == (crowd == 3) and any(r.sub for r in got) == (crowd == 3)
    assert chat_format.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_crowded_conversations_are_small_groups(spark, monkeypatch, tmp_path):
    """Equal turns without a number, few numbers with many turns each, and one conversation over many tasks: no group has more than the bound, and the SQL gives the same rows."""
    rng = random.Random(5)
    rows = [(1, None, "amy", "same")] * 900 + [(1, None, "bob", "other")] * 70 + [(2, t, rng.choice(["amy", "bob"]), f"text {rng.randrange(40)}") for t in range(0, 300, 100) for _ in range(200)]
    rows += [(None, 5, "eve", "x")] * 40 + [(3, t, "amy", "calm") for t in range(20)]
    path = f"{tmp_path}/sf"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{path}/conversations.parquet")
    monkeypatch.setattr(chat_format.rotate, "__defaults__", (chat_format.PART, "system", 32))
    found = chat_format.query(spark, path)
    assert found.agg({"n_turns": "max"}).first()[0] == 32 and found.where("conv_id = 3").count() == 1
    own = connection_with(path)
    sql = chat_format.ORACLE.replace(f"// {4096}", "// 32")
    want = sorted(map(repr, own.execute(sql).fetchall()))
    names = [c[0] for c in own.execute(sql).description]
    assert sorted(repr(tuple(r)) for r in found.select(*names).collect()) == want


def connection_with(path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet/*.parquet')")
    return con
