"""Segmentation of text into a vocabulary's pieces as a max-plus scan over chunks.

A state at a chunk's edge says how far the last piece that began before it reaches beyond it (and, for merges, which
piece that is). A chunk's transfer matrix holds, for each entry and exit state, the best sum of weights of the pieces
that begin in the chunk. Matrices combine associatively (max over sums); with the states at its edges known, each
chunk is traced back on its own.

For unigram models a piece's weight is its score. For merge (BPE) models a piece's weight is zero where the merges of
the last piece and this one, taken together, leave both as they are, and minus infinity elsewhere: exactly one path
has weight zero, the one that the merges over the whole text give.

Chunks are cut at fixed places, mostly inside a word, so their edges have several states. An edge in front of a space
that follows another character is safe if no piece has one inside: nothing reaches over it, and it has one state. A
chunk's matrix is thus the product of that of its head, up to its first safe edge, the one-by-one matrices of the
words in between, and that of its tail; words recur, so each distinct one is solved once.
"""

from __future__ import annotations

import re
from functools import lru_cache

SPACE = "▁"
SAFE = (0, "")
#: Characters of a text up to which merging it step by step is the quicker way to its path.
SHORT = 64
_EDGE = re.compile(f"(?<=[^{SPACE}]){SPACE}")
State = tuple[int, str]
Matrix = dict[State, dict[State, float]]


class Vocabulary:
    def __init__(self, pieces: dict[str, tuple[int, float]], merges: bool, byte_ids: list[int] | None, unknown_id: int = 0):
        """pieces: piece -> (id, score); byte_ids: ids of the 256 bytes, for characters that are no piece."""
        self.pieces, self.merges, self.byte_ids, self.unknown_id = pieces, merges, byte_ids, unknown_id
        self.longest = max(map(len, pieces), default=1)
        self.unknown_score = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.safe = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.fits = lru_cache(1 << 20)(self._fits)
        self.whole = lru_cache(1 << 18)(lambda p: self.merge(p) == [p])
        self.word = lru_cache(1 << 18)(self._word)

    def merge(self, text: str) -> list[str]:
        """The pieces that merging leaves: the best-scored neighbours first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.pieces[a + b][1], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.pieces), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _fits(self, last: str, piece: str) -> bool:
        return not last or self.merge(last + piece) == [last, piece]

    def ids(self, piece: str) -> list[int]:
        if piece in self.pieces:
            return [self.pieces[piece][0]]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown_id]

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces that the text has at a place; a character that is no piece stands for itself."""
        found = [p for p in (text[at : at + n] for n in range(1, min(self.longest, len(text) - at) + 1)) if p in self.pieces]
        if self.merges:
            found = [p for p in found if len(p) == 1 or self.whole(p)]
        return found if found and len(found[0]) == 1 else [text[at], *found]

    def weight(self, last: str, piece: str) -> float | None:
        if self.merges:
            return 0.0 if self.fits(last, piece) else None
        return self.pieces[piece][1] if piece in self.pieces else self.unknown_score

    def label(self, piece: str) -> str:
        return piece if self.merges else ""

    def _word(self, text: str) -> tuple[float, tuple[str, ...]]:
        """(weight, pieces) of the best path through a text between two safe edges. Merges of a short text give the only path of weight zero."""
        if self.merges and len(text) <= SHORT:
            return 0.0, tuple(self.merge(text))
        best = paths(self, text, len(text), SAFE)
        return best_path(best, [k for k in best if k[0] == len(text)])


class Chunk:
    """text[start:end] with `longest` characters of context on either side."""

    def __init__(self, vocabulary: Vocabulary, left: str, body: str, right: str, safe_left: bool, safe_right: bool):
        self.v, self.left, self.body, self.right, self.safe_left, self.safe_right = vocabulary, left, body, right, safe_left, safe_right

    def entries(self) -> list[State]:
        if self.safe_left:
            return [SAFE]
        text, edge = self.left + self.body + self.right, len(self.left)
        found = {}
        for s in range(edge):
            for p in self.v.starting(text, s):
                if s + len(p) >= edge:
                    found[s + len(p) - edge, self.v.label(p)] = None
        return list(found)

    def _exit(self, over: int, label: str) -> State:
        return SAFE if self.safe_right and not over else (over, label)

    def _safe(self) -> list[int]:
        """The safe edges inside the chunk."""
        if not self.v.safe:
            return []
        before = self.left[-1:]
        return [p for m in _EDGE.finditer(before + self.body) if 0 < (p := m.start() - len(before))]

    def transfer(self) -> Matrix:
        edges, entries = self._safe(), self.entries()
        if not edges:
            return self._dense(self.body + self.right, len(self.body), entries, self._exit)
        head = self._dense(self.body[: edges[0]], edges[0], entries, lambda over, label: SAFE)
        words = sum(self.v.word(self.body[a:b])[0] for a, b in zip(edges, edges[1:]))
        tail = self._dense(self.body[edges[-1] :] + self.right, len(self.body) - edges[-1], [SAFE], self._exit)
        return combine(combine(head, {SAFE: {SAFE: words}}), tail)

    def _dense(self, text: str, n: int, entries: list[State], leave) -> Matrix:
        """The matrix of text[:n] from the entries to the states that leave() makes of what reaches beyond it."""
        out: Matrix = {}
        at: dict[int, dict[str, dict[State, float]]] = {}
        for over, label in entries:
            at.setdefault(over, {}).setdefault(label, {})[over, label] = 0.0
        for p in range(n):
            for last, reach in at.pop(p, {}).items():
                for piece in self.v.starting(text, p):
                    w = self.v.weight(last, piece)
                    if w is not None:
                        to = at.setdefault(p + len(piece), {}).setdefault(self.v.label(piece), {})
                        for entry, score in reach.items():
                            if score + w > to.get(entry, float("-inf")):
                                to[entry] = score + w
        for q, ends in at.items():
            for label, reach in ends.items():
                for entry, score in reach.items():
                    row = out.setdefault(entry, {})
                    state = leave(q - n, label)
                    row[state] = max(score, row.get(state, float("-inf")))
        return out

    def trace(self, entry: State, leave: State) -> list[str]:
        """The pieces that begin in the chunk on the best path between the two states."""
        edges, n = self._safe(), len(self.body)
        ends = lambda best, at: [k for k in best if k[0] >= at and self._exit(k[0] - at, k[1]) == leave]
        if not edges:
            best = paths(self.v, self.body + self.right, n, entry)
            return list(best_path(best, ends(best, n))[1])
        best = paths(self.v, self.body[: edges[0]], edges[0], entry)
        pieces = list(best_path(best, [k for k in best if k[0] == edges[0]])[1])
        for a, b in zip(edges, edges[1:]):
            pieces += self.v.word(self.body[a:b])[1]
        best = paths(self.v, self.body[edges[-1] :] + self.right, n - edges[-1], SAFE)
        return pieces + list(best_path(best, ends(best, n - edges[-1]))[1])


Paths = dict[tuple[int, str], tuple[float, tuple[int, str] | None, str]]


def paths(v: Vocabulary, text: str, n: int, entry: State) -> Paths:
    """(score, node before, piece) of the best path from the entry to each node (place, label) that pieces beginning before n reach."""
    best: Paths = {entry: (0.0, None, "")}
    at: dict[int, set[str]] = {entry[0]: {entry[1]}}
    for p in range(n):
        for last in sorted(at.get(p, ())):
            for piece in v.starting(text, p):
                w = v.weight(last, piece)
                if w is not None:
                    node, score = (p + len(piece), v.label(piece)), best[p, last][0] + w
                    if node not in best or score > best[node][0]:
                        best[node] = score, (p, last), piece
                        at.setdefault(node[0], set()).add(node[1])
    return best


def best_path(best: Paths, ends: list[tuple[int, str]]) -> tuple[float, tuple[str, ...]]:
    """(score, pieces) of the best path to one of the ends."""
    node = max(ends, key=lambda k: best[k][0])
    score, pieces = best[node][0], []
    while best[node][1] is not None:
        pieces.append(best[node][2])
        node = best[node][1]
    return score, tuple(pieces[::-1])


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: a's chunk followed by b's."""
    out: Matrix = {}
    for entry, row in a.items():
        new: dict[State, float] = {}
        for middle, score in row.items():
            for leave, more in b.get(middle, {}).items():
                if score + more > new.get(leave, float("-inf")):
                    new[leave] = score + more
        if new:
            out[entry] = new
    return out


def split(vocabulary: Vocabulary, text: str, size: int) -> list[tuple[str, str, str, bool, bool]]:
    """(left context, body, right context, safe left edge, safe right edge) of each chunk of `size` characters of a text with spaces marked."""
    edges, reach = [*range(0, max(len(text), 1), size), len(text)], vocabulary.longest
    return [(text[max(0, a - reach) : a], text[a:b], text[b : b + reach], a == 0, b == len(text)) for a, b in zip(edges, edges[1:])]


def scan(matrices: list[Matrix], entry: State = SAFE, leave: State | None = SAFE) -> list[tuple[State, State]]:
    """(entry, exit) of each chunk on the best path through all of them."""
    reach: list[dict[State, tuple[float, State | None]]] = [{entry: (0.0, None)}]
    for m in matrices:
        new: dict[State, tuple[float, State | None]] = {}
        for state, (score, _) in reach[-1].items():
            for to, w in m.get(state, {}).items():
                if to not in new or score + w > new[to][0]:
                    new[to] = score + w, state
        reach.append(new)
    state = leave if leave is not None else max(reach[-1], key=lambda s: (reach[-1][s][0], s))
    path = [state]
    for step in reversed(reach[1:]):
        path.append(step[path[-1]][1])
    path.reverse()
    return list(zip(path, path[1:]))
