"""Token counts and token places by an offline tokenizer, over Arrow batches. A worker loads each file once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import reachable

_LOADED: dict = {}
#: A word with the white space before it. A byte-level vocabulary ends a token wherever white space begins, so these are encoded apart.
_WORD = re.compile(r"\s*\S+|\s+")
#: White space to Python and not to the library: texts that hold it are encoded whole.
_UNSURE = re.compile("[\x1c-\x1f]")
#: Characters of texts that are worked on together; words kept in memory, and the longest of them.
_TOGETHER, _KNOWN, _LONGEST = 1 << 18, 200_000, 64


def default_path() -> str:
    """A byte-level vocabulary; its place is a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str):
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their names in a text are ordinary text
        _LOADED[path] = t
    return _LOADED[path]


class Words:
    """Token places of texts, word by word: a word that was met before is looked up, not encoded again. Memory is bounded by twice _KNOWN words of at most _LONGEST characters: when there are so many, those not met since the last time go.

    Texts of vocabularies that are not byte-level and regex-cut, or that change or add to a text, are encoded whole.
    """

    def __init__(self, path: str):
        import json

        self.library = tokenizer(path)
        told = json.loads(self.library.to_str())
        cut, model = told["pre_tokenizer"] or {}, told["model"]
        self.apart = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")) and not told["normalizer"] and not told["post_processor"] and not told["truncation"] and not told["padding"] and all(t["special"] for t in told["added_tokens"])
        if self.apart:
            self.bytes_of = np.zeros(max(model["vocab"].values()) + 1, np.int64)
            for token, k in model["vocab"].items():
                self.bytes_of[k] = len(token)  # a character stands for a byte
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _places(self, text: str) -> np.ndarray:
        """The characters that a text's tokens begin in, by their lengths in bytes: the library's own offsets are slow to read."""
        sizes = self.bytes_of[self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids]
        at = np.cumsum(sizes) - sizes
        return at if text.isascii() else (np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1)[at]

    def _learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Words that begin with white space and end without it are encoded in a row: each is cut from the next."""
        row = [w for w in words if w[0].isspace() and not w[-1].isspace()]
        out = {w: tuple(self._places(w).tolist()) for w in words if not w[0].isspace() or w[-1].isspace()}
        if row:
            places, ends = self._places("".join(row)), np.cumsum(list(map(len, row)))
            upto = np.searchsorted(places, ends)
            own = (places - np.repeat(ends - list(map(len, row)), np.diff(upto, prepend=0))).tolist()
            out.update((w, tuple(own[a:b])) for w, a, b in zip(row, [0, *upto.tolist()], upto.tolist()))
        return out

    def _looked_up(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The places of each word. They are learnt together."""
        out, new = {}, []
        for w in words:
            if (x := self.known.get(w)) is None:
                if (x := self.older.get(w)) is None:
                    new.append(w)
                    continue
                self.known[w] = x
            out[w] = x
        told = self._learn(new)
        if len(self.known) + len(told) > _KNOWN:
            self.older, self.known = self.known, {}
        self.known.update((w, x) for w, x in told.items() if len(w) <= _LONGEST)
        return out | told

    def starts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The places (characters) at which each text's tokens begin, in order. The texts' words are looked up together."""
        cut = [_WORD.findall(t) if self.apart and not _UNSURE.search(t) else None for t in texts]
        known = self._looked_up(set(chain.from_iterable(filter(None, cut))))
        for text, words in zip(texts, cut):
            if words is None:
                yield np.array([a for a, _ in self.library.encode(text, add_special_tokens=False).offsets], np.int64)
                continue
            each = list(map(known.__getitem__, words))
            size = np.fromiter(map(len, words), np.int64, len(words))
            count = np.fromiter(map(len, each), np.int64, len(words))
            yield np.fromiter(chain.from_iterable(each), np.int64, int(count.sum())) + np.repeat(np.cumsum(size) - size, count)


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def in_slices(a: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[str]]]:
    """(row of the first, texts) of a column of texts, a few at a time; null is empty."""
    at = size = 0
    own: list[str] = []
    for x in a:
        own.append(x.as_py() or "")
        size += len(own[-1])
        if size >= _TOGETHER:
            yield at, own
            at, own, size = at + len(own), [], 0
    if own:
        yield at, own


def count_tokens(c: Column | str, path: str | None = None) -> Column:
    """The number of tokens of each text; null counts as empty."""
    place = path or default_path()

    def count(a: pa.Array) -> pa.Array:
        from millrace.functions.tokens import in_slices, words_of

        return pa.array([len(s) for _, texts in in_slices(a) for s in words_of(place).starts(texts)], pa.int32())

    reachable(SparkSession.active())
    return F.arrow_udf(count, T.IntegerType())(c)
