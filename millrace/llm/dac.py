"""Token ids as directly addressable codes (DACs).

An id is cut into chunks of `bits` bits, lowest first. Level k holds the k-th chunk of every id that has one, and
a continuation bitmap says which of them go on to level k+1. Where an id goes on, its place in the next level is
the rank of its bit, and a rank directory holds the ones before each block of 512 bits. Any id is thus read by one
look into each of its levels; nothing else is decoded.

File: the magic, a header of little-endian unsigned 64-bit integers (bits, documents, ids, levels, then each level's
length), the documents' ids (int64) and null flags (bytes), the first id's place of each document and the end
(uint64), then for each level its chunks, its bitmap (little bit order) and its rank directory (uint64). Each part
is padded to 8 bytes.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"MRDAC\x00\x00\x01"
BLOCK = 512


def _padded(a: np.ndarray) -> bytes:
    b = np.ascontiguousarray(a).tobytes()
    return b + b"\0" * (-len(b) % 8)


def encode(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, bits: int = 8) -> bytes:
    """One file's bytes. ids: unsigned integers below 2**32; starts: a place for each document, and the end."""
    if bits not in (8, 16):
        raise ValueError("bits must be 8 or 16")
    kind = np.uint8 if bits == 8 else np.uint16
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunk, rest = rest.astype(kind), rest >> np.uint32(bits)
        more = rest > 0
        levels.append((chunk, more))
        if not more.any():
            break
        rest = rest[more]
    out = [MAGIC, _padded(np.array([bits, len(doc_ids), len(ids), len(levels), *[len(c) for c, _ in levels]], np.uint64))]
    out += [_padded(np.array([d or 0 for d in doc_ids], np.int64)), _padded(np.array([d is None for d in doc_ids], np.uint8)), _padded(starts.astype(np.uint64))]
    for chunk, more in levels:
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        out += [_padded(chunk), _padded(np.packbits(more, bitorder="little")), _padded(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint64))]
    return b"".join(out)


class DacFile:
    """A file that is readable at any place. source: its bytes, or a function (offset, length) -> bytes that reads no more than it is asked for.

    With a function only the header is read at first; the documents' directory when it is asked for; an id costs one
    short read of each part of each of its levels.
    """

    def __init__(self, source):
        whole = None if callable(source) else memoryview(source)
        self._read = source if whole is None else lambda offset, n: whole[offset : offset + n]
        if bytes(self._read(0, 8)) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.bits, self.n_docs, self.n_ids, n_levels = (int(x) for x in self._array(np.uint64, 4, 8))
        self.kind = np.uint8 if self.bits == 8 else np.uint16
        sizes = [int(x) for x in self._array(np.uint64, n_levels, 40)]
        at = 40 + 8 * n_levels
        self.places = []  # of the documents' ids, their null flags and their first ids
        for width in (8 * self.n_docs, self.n_docs, 8 * (self.n_docs + 1)):
            self.places.append(at)
            at += width + -width % 8
        self.levels = []  # (ids, place of the chunks, of the bitmap, of the ranks)
        for n in sizes:
            own = [n]
            for width in (n * self.bits // 8, -(-n // 8), 8 * (-(-n // BLOCK) + 1)):
                own.append(at)
                at += width + -width % 8
            self.levels.append(tuple(own))

    def _array(self, kind, n: int, at: int) -> np.ndarray:
        return np.frombuffer(self._read(at, n * np.dtype(kind).itemsize), kind, n)

    @property
    def doc_ids(self) -> list[int | None]:
        ids, null = self._array(np.int64, self.n_docs, self.places[0]), self._array(np.uint8, self.n_docs, self.places[1])
        return [None if z else int(d) for d, z in zip(ids, null)]

    @property
    def starts(self) -> np.ndarray:
        """The place of each document's first id, and the end."""
        return self._array(np.uint64, self.n_docs + 1, self.places[2]).astype(np.int64)

    def token(self, i: int) -> int:
        """The i-th id, by one access to each of its levels."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(self._array(self.kind, 1, chunks + i * self.bits // 8)[0]) << (self.bits * k)
            block = i // BLOCK
            own = self._array(np.uint8, (i >> 3) + 1 - block * BLOCK // 8, bitmap + block * BLOCK // 8)
            if not own[-1] >> (i & 7) & 1:
                break
            inside = np.unpackbits(own, bitorder="little")[: i - block * BLOCK]
            i = int(self._array(np.uint64, 1, ranks + 8 * block)[0]) + int(inside.sum())
        return value

    def ids(self) -> np.ndarray:
        """All ids, as little-endian unsigned 32-bit integers."""
        out, live = np.zeros(self.n_ids, "<u4"), np.arange(self.n_ids)
        for k, (n, chunks, bitmap, _) in enumerate(self.levels):
            out[live] |= self._array(self.kind, n, chunks).astype(np.uint32) << np.uint32(self.bits * k)
            live = live[np.unpackbits(self._array(np.uint8, -(-n // 8), bitmap), count=n, bitorder="little").astype(bool)]
        return out
