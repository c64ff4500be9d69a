"""Token places looked up word by word, against the library's own offsets."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from millrace.functions import tokens as tk


def _texts() -> list[str]:
    draw = random.Random(3)
    pool = "ab é漢😀'’s1٣.!\n\t\r\x0b\x0c\x1c\x1f\x85\xa0　 ᠎​﻿<|endoftext|>ñ"
    return ["", " ", "  a", "a\xa0 b", "a \x1cb"] + ["".join(draw.choices(pool, k=draw.randint(0, 60))) for _ in range(3_000)]


def _same(words: tk.Words, texts: list[str]) -> None:
    library = tk.tokenizer(tk.default_path())
    for text, got in zip(texts, words.starts(texts), strict=True):
        assert got.tolist() == [a for a, _ in library.encode(text, add_special_tokens=False).offsets], repr(text)


def test_places_are_the_library_s(monkeypatch):
    texts = _texts()
    words = tk.Words(tk.default_path())
    assert words.apart
    _same(words, texts)
    monkeypatch.setattr(tk, "_KNOWN", 20)  # words are forgotten and learnt again
    for at in range(0, len(texts), 50):
        _same(words, texts[at : at + 50])
        assert len(words.known) < 20 + len({w for t in texts[at : at + 50] for w in tk._WORD.findall(t)})


def test_the_library_gets_a_bounded_part_of_a_batch(spark):
    """A whole Arrow batch was encoded at once before; the memory grew with the rows of a batch."""
    column = pa.array(["a b" * 1_000, None, "c"] * 1_000)
    slices = list(tk.in_slices(column))
    assert [at for at, _ in slices] == np.cumsum([0, *(len(t) for _, t in slices[:-1])]).tolist()
    assert [x for _, t in slices for x in t] == [x or "" for x in column.to_pylist()]
    assert max(sum(map(len, t)) for _, t in slices) < tk._TOGETHER + 3_000
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(_texts()[:200])] + [(200, None)], "k int, t string").repartition(2)
    library = tk.tokenizer(tk.default_path())
    assert all(r.n == len(library.encode(r.t or "", add_special_tokens=False).ids) for r in rows.select("t", tk.count_tokens("t").alias("n")).collect())
