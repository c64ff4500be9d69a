"""Licence scan: the Dice coefficient over word bigrams between units of a text and licence templates.

Units are sentences, lines, blocks of lines without a blank one between, the whole text, and windows: runs of
neighbouring sentences and lines of any length, across blank lines. Normalised words are the runs of letters, digits
and non-ASCII characters, ASCII letters in lower case; a unit's bigrams are a set. A unit with a bigrams can reach the
threshold t against a template with b only if b t / (2 - t) <= a <= b (2 - t) / t, and only if it shares at least
b t / (2 - t) bigrams; all other templates are pruned before a coefficient is computed.

Windows are tried in texts that share so many bigrams with a template, from each sentence or line that holds one of
them up to the bound of a; a window whose first piece adds no shared bigram of its own is no better without it, so
none goes on past the last recurrence of its first piece's. Of windows and units that overlap by more than half, the
one with the greatest coefficient counts: part of a licence's text is not another licence that shares that part.

A text matches a licence by the best of its units; of templates with equal coefficients the first by name counts.
Null and empty texts and texts of one word match nothing; null doc_ids and repeated rows are scanned like any other;
texts of any length are scanned whole; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import pieces_of, raw, span_hashes, strings, table, trimmed, word_spans
from millrace.llm.license_templates import templates

THRESHOLD = 0.8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_K = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes, starts, ends, text numbers, hashes) of all words."""
    buf, offsets = raw(texts)
    buf = _LOWER[buf]
    starts, ends, doc = word_spans(buf, offsets)
    return buf, starts, ends, doc, span_hashes(buf, starts, ends)


def bigrams(h: np.ndarray) -> np.ndarray:
    """A hash for each word and the next one."""
    return (h[:-1] * _K) ^ (h[1:] + (h[1:] >> np.uint64(17)))


class Matcher:
    def __init__(self, known: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.t = threshold
        self.names = [k for k, _ in known]
        self.sets = [np.unique(bigrams(words_of(strings(pa.array([text])))[4])) for _, text in known]
        self.sizes = np.array([len(s) for s in self.sets])
        self.vocabulary = np.unique(np.concatenate(self.sets))
        self.holders = [[] for _ in self.vocabulary]
        for k, s in enumerate(self.sets):
            for g in np.searchsorted(self.vocabulary, s):
                self.holders[g].append(k)
        self.least = self.sizes * threshold / (2 - threshold)
        self.pairs = np.array([len(x) for x in self.holders])  # templates that hold each bigram, and which
        self.first = np.cumsum(self.pairs) - self.pairs
        self.holder = np.concatenate([np.array(x, np.int64) for x in self.holders])
        self.low = np.zeros(1 << 20, bool)
        self.low[self.vocabulary & np.uint64((1 << 20) - 1)] = True

    def unit(self, grams: np.ndarray) -> tuple[float, str] | None:
        """(coefficient, licence) of the best template for a unit's distinct bigrams."""
        at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        shared = Counter(k for g in at[self.vocabulary[at] == grams] for k in self.holders[g])
        a, best = len(grams), None
        for k, n in shared.items():
            if self.least[k] <= a <= self.sizes[k] * (2 - self.t) / self.t and n >= self.least[k]:
                dice = 2 * n / (a + int(self.sizes[k]))
                if dice >= self.t and (best is None or (-dice, self.names[k]) < (-best[0], best[1])):
                    best = dice, self.names[k]
        return best

    def scan(self, texts: pa.Array) -> dict[tuple[int, str], tuple[float, int]]:
        """(text number, licence) -> (best coefficient, units that match)."""
        found: dict[tuple[int, str], tuple[float, int]] = {}
        buf, starts, ends, doc, h = words_of(texts)
        if len(h) < 2:
            return found
        grams, same = bigrams(h), doc[1:] == doc[:-1]
        hit = self.low[grams & np.uint64((1 << 20) - 1)] & same
        if not hit.any():
            return found
        line_feeds = np.flatnonzero(buf == 10)
        line = np.searchsorted(line_feeds, starts)
        gap = line[1:] - line[:-1]  # line feeds between a word and the next
        # The end of a sentence: . ! or ? with white space behind it, somewhere between two words.
        stops = np.flatnonzero(np.isin(buf[:-1], np.frombuffer(b".!?", np.uint8)) & np.isin(buf[1:], np.frombuffer(b" \n\r\t", np.uint8)))
        sentence = np.searchsorted(stops, starts)
        pieces = gap + (sentence[1:] != sentence[:-1])
        matched: dict[int, list[tuple[float, str, int, int]]] = {}
        for edge in (pieces, gap, self._blank(buf, line_feeds, line), None):
            cut = ~same if edge is None else ~same | (edge > 0)
            number = np.concatenate([[0], np.cumsum(cut)])
            shared = np.bincount(number[:-1][hit & ~cut], minlength=number[-1] + 1)
            begin = np.searchsorted(number, np.arange(number[-1] + 1))
            length = np.diff(np.concatenate([begin, [len(number)]])) - 1  # bigrams, repeats included
            for u in np.flatnonzero((shared >= self.least.min()) & (length >= self.least.min())):
                best = self.unit(np.unique(grams[begin[u] : begin[u] + length[u]]))
                if best:
                    key = int(doc[begin[u]]), best[1]
                    dice, n = found.get(key, (0.0, 0))
                    found[key] = max(dice, best[0]), n + (edge is gap)
                    matched.setdefault(key[0], []).append((*best, int(begin[u]), int(begin[u] + length[u])))
        for d, possible in self._possible(grams, doc, hit):
            begin, end = np.searchsorted(doc, [d, d + 1])
            own = [(dice, name, a - begin, b - begin) for dice, name, a, b in matched.get(d, [])]
            for dice, name in self._windows(grams[begin : end - 1], pieces[begin : end - 1] > 0, possible, own):
                best, n = found.get((d, name), (0.0, 0))
                found[d, name] = max(best, dice), n
        return found

    def _possible(self, grams: np.ndarray, doc: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(text, templates) where the whole text shares as many bigrams as a match must."""
        at = np.flatnonzero(hit)
        v = np.minimum(np.searchsorted(self.vocabulary, grams[at]), len(self.vocabulary) - 1)
        known = self.vocabulary[v] == grams[at]
        code = np.unique(doc[at[known]] * len(self.vocabulary) + v[known])
        d, v = code // len(self.vocabulary), code % len(self.vocabulary)
        n = self.pairs[v]
        k = self.holder[np.arange(n.sum()) + np.repeat(self.first[v] - (np.cumsum(n) - n), n)]
        code, shared = np.unique(np.repeat(d, n) * len(self.sets) + k, return_counts=True)
        code = code[shared >= self.least[code % len(self.sets)]]
        d, k = code // len(self.sets), code % len(self.sets)
        edge = np.flatnonzero(d[1:] != d[:-1]) + 1
        for of, which in zip(d[np.concatenate([[0], edge])] if len(d) else (), np.split(k, edge)):
            yield int(of), which.tolist()

    def _windows(self, grams: np.ndarray, cut: np.ndarray, possible: list[int], own: list[tuple[float, str, int, int]]) -> list[tuple[float, str]]:
        """(coefficient, licence) of the windows of one text that count, besides its units `own` that match."""
        n = len(grams)
        begin = np.concatenate([[0], np.flatnonzero(cut) + 1])  # first words of pieces; a piece's last bigram leads to the next
        last = np.append(begin[1:] - 2, n - 1)  # last bigrams of windows that end with the piece; before its begin if it is one word
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        before, after = np.full(n, -1), np.full(n, n)
        before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
        candidates = [(-dice, name, a, b, False) for dice, name, a, b in own]
        for k in possible:
            shared = np.isin(grams, self.sets[k])
            places = np.flatnonzero(shared)
            piece = np.searchsorted(begin, places, side="right") - 1
            if piece[0] == piece[-1] and places[-1] <= last[piece[0]]:
                continue  # all in one piece, which is a unit
            most, size = self.sizes[k] * (2 - self.t) / self.t, int(self.sizes[k])
            edge = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            for p, far in zip(piece[edge].tolist(), np.maximum.reduceat(after[places], edge).tolist()):
                s, reach = int(begin[p]), 2 * int(most) + 2
                while True:
                    to = min(s + reach, far)
                    new = before[s:to] < s
                    count = np.cumsum(new)
                    if to == far or count[-1] > most:
                        break
                    reach *= 2
                to = s + int(np.searchsorted(count, most, side="right"))
                held = np.cumsum(new & shared[s:to] if to - s == len(new) else new[: to - s] & shared[s:to])
                if not len(held) or held[-1] < self.least[k]:
                    continue
                ends = last[p : np.searchsorted(last, to)] - s
                ends = ends[ends >= 0]
                if len(ends):
                    dice = 2 * held[ends] / (count[ends] + size)
                    e = int(np.argmax(dice))
                    if dice[e] >= self.t:
                        candidates.append((-float(dice[e]), self.names[k], s, s + int(ends[e]) + 1, True))
        out, taken = [], np.zeros(n, bool)
        for dice, name, a, b, window in sorted(candidates):
            if 2 * int(taken[a:b].sum()) <= b - a:
                taken[a:b] = True
                if window:
                    out.append((-dice, name))
        return out

    @staticmethod
    def _blank(buf: np.ndarray, line_feeds: np.ndarray, line: np.ndarray) -> np.ndarray:
        """For each word but the last: whether a line without a word lies before the next one."""
        return np.maximum(line[1:] - line[:-1] - 1, 0)


def _scan(known: list[tuple[str, str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(known, threshold)
        for batch in batches:
            keys = batch.column("doc_id")
            for at, piece in pieces_of(strings(batch.column("text"))):
                found = sorted(matcher.scan(piece).items())
                ids = keys.slice(at, len(piece)).take(pa.array([d for (d, _), _ in found], pa.int64()))
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "license": pa.array([k for (_, k), _ in found], pa.string()), "dice": pa.array([round(x, 6) for _, (x, _) in found], pa.float64()), "n_lines": pa.array([n for _, (_, n) in found], pa.int64())})

    return run


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice (of the best unit), n_lines (lines that match) for each text and licence that match."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_scan(known or templates(), threshold)), "doc_id long, license string, dice double, n_lines long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
