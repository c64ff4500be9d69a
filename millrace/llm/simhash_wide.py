"""SimHash near-duplicates of a given similarity, for the pipeline: wide fingerprints under the same byte-position index.

Texts of a Jaccard similarity of 0.8 over five-word shingles differ in about 15 % of their fingerprint's bits. In 64
bits no positional byte is then sure to be shared, so the fingerprint here has 384 bits in 48 positional bytes, dealt
into twelve groups of four. Each text is listed under the six pairs of positions of each group, so two texts meet in a
list exactly if the tally of their shared positional bytes reaches two in a group: 98.4 % of all pairs at 0.80 do, and
99.7 % of those at 0.85. That index is the only place where a pair can be missed.

1. Lists link their members that are near by the bits they carry (a bound four standard deviations above what texts of
   the wanted similarity differ by). A list tells the members of each group that such links connect, never pairs.
   Chance makes such groups, too, in numbers that grow with the square of the texts, so each is taken apart by its members'
   whole fingerprints under the same kind of bound; it tells a spanning set of links, at most one for each member.
2. What is linked forms blocks; all pairs of a block that the links have not joined yet are verified by their texts'
   whole sets of distinct shingles. Again at most one link a member goes out.
3. A list or block of more than LIST or TILE members is dealt into parts, which are larger in larger ones (up to SIDE members). Each part names the member nearest to the
   majority of its bits; the best of them, the centre, is compared with every member, and what is not joined to it
   is compared with all members, part against part. So a group of copies with a common original costs a row a member,
   and no pair within the bound is left out at any size.

Texts are equal here if they have the same set of shingles. Null and empty texts have none and are copies of one
another; a text of fewer than five words is one shingle. A set so small that one shingle more or less is too much (fewer
than four) has no near copy but its equals and isn't listed. Repeated rows and repeated or null doc_ids do no harm: rows
have numbers of their own. An empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_NUMBERS, LOWER, VISIBLE, majority, numbered, pieces_of, raw, small_side, span_hashes, strings, trimmed, word_spans, written
from millrace.llm.components import components, stars

WORDS, SIMILARITY = 5, 0.8
POSITIONS, GROUP, SHARED = 48, 4, 2
#: Members that one task compares with one another: of a list by bits, of a block by whole sets. Bytes of a block's sets.
LIST, TILE, TILE_BYTES = 1024, 256, 64 << 20
#: Parts that a large list or block has at least before they get larger, and most members of a part: members move once for each part of the others.
PARTS, SIDE = 8, 2048
#: 64-bit words of the fingerprint that the lists carry; standard deviations above the mean of differing bits.
CARRIED, MARGIN = 2, 4
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_CHOICES = np.array([[g + p for p in chosen] for g in range(0, POSITIONS, GROUP) for chosen in combinations(range(GROUP), SHARED)])
#: Keys hold a choice of positions and the bytes there. Three shared bytes, for far more texts, need longer ones.
_KEY, _KEY_TYPE = ("int", np.int32) if SHARED < 3 else ("long", np.int64)
MEMBER = "block long, id long, code binary, value binary"


def most_bits(similarity: float, bits: int = 64 * CARRIED) -> int:
    """Differing bits of texts of this Jaccard similarity, as sets of equal size: the mean and MARGIN standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + MARGIN * math.sqrt(bits * share * (1 - share)))


# --- fingerprints -------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """The hashes of each text's distinct shingles of words, in order. Words lie between ASCII white space, ASCII letters in lower case."""
    buf, offsets = raw(texts)
    buf = LOWER[buf]
    starts, ends, doc = word_spans(buf, offsets, VISIBLE)
    h = span_hashes(buf, starts, ends)
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    count = np.where(n, np.maximum(1, n - size + 1), 0)
    edge = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(edge[-1]) + np.repeat(first - edge[:-1], count)
    long = np.repeat(np.minimum(n, size), count)
    x = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = long > k
        x[inside] = x[inside] * np.uint64(0x9FB21C651E98DF25) + h[at[inside] + k]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return [np.unique(x[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, POSITIONS) bytes. A bit is 1 if set in over half of the set's hashes; an empty set has none."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), POSITIONS), np.uint8)
    own = np.flatnonzero(sizes)
    if not len(own):
        return out
    h, n = np.concatenate([sets[i] for i in own]), sizes[own]
    for w, seed in enumerate(_SEEDS):
        x = (h ^ seed) * _SEEDS[w - 1]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        out[own, 8 * w : 8 * w + 8] = majority(x, n)
    return out


def alone(n: int, similarity: float) -> bool:
    """Whether a set of n shingles can be similar to none but its equals: the nearest other set has one shingle more."""
    return not n or n < similarity * (n + 1) - 1e-9


def _coded(size: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in pieces_of(strings(batch.column("text")), 4 << 20):
                sets = shingle_sets(piece, size)
                codes = fingerprints(sets)
                yield pa.RecordBatch.from_pydict(
                    {
                        "at": batch.column("at").slice(at, len(piece)),
                        "doc_id": batch.column("doc_id").slice(at, len(piece)),
                        "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        "code": pa.array([c.tobytes() for c in codes], pa.binary()),
                        "alone": pa.array([alone(len(s), similarity) for s in sets]),
                    }
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in pieces_of(strings(batch.column("text")), 4 << 20):
                sets = shingle_sets(piece, size)
                columns = {c: batch.column(c).slice(at, len(piece)) for c in ("block", "id")}
                columns |= {"code": pa.array([c.tobytes() for c in fingerprints(sets)], pa.binary()), "value": pa.array([s.tobytes() for s in sets], pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)

    return run


# --- the index and its lists --------------------------------------------------------------------


def index_keys(code: np.ndarray) -> np.ndarray:
    """(texts, choices) keys: the choice of positions and the bytes there."""
    keys = np.broadcast_to(np.arange(len(_CHOICES), dtype=_KEY_TYPE), (len(code), len(_CHOICES)))
    for k in range(SHARED):
        keys = (keys << 8) | code[:, _CHOICES[:, k]]
    return keys


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and choice of positions of a group."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, POSITIONS)
        words = np.repeat(np.ascontiguousarray(code[:, : 8 * CARRIED]).view(np.int64), len(_CHOICES), axis=0)
        columns = {"key": index_keys(code).reshape(-1), "id": np.repeat(batch.column("id").to_numpy(), len(_CHOICES))}
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in (columns | {f"w{k}": np.ascontiguousarray(words[:, k]) for k in range(CARRIED)}).items()})


def _told(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member that is not its component's first, with that one; each pair once, the greater id first."""
    at = np.flatnonzero(label != np.arange(len(label)))
    x, y = ids[at], ids[label[at]]
    both = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def _grouped(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, id) of the members of components of two or more. A group's number is a hash of its members, the same in every list."""
    at = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
    at = at[np.argsort(label[at], kind="stable")]
    if not len(at):
        return ids[:0], ids[:0]
    mixed = ids[at].astype(np.uint64) * _SEEDS[0]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _SEEDS[1]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(label[at]) > 0]))
    group = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts).view(np.int64)
    return np.repeat(group, np.diff(np.append(starts, len(at)))), ids[at]


def _lists(bits: int, most: float, told=_grouped, key_type=_KEY_TYPE, carried: int = CARRIED):
    """told: what is given as (a, b) of a list's ids and the labels of the components that near pairs make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a list that a batch cuts is carried over. A list of more than `most` gives its key alone (b is null)."""
        keys, ids, codes = np.zeros(0, key_type), np.zeros(0, np.int64), np.zeros((0, carried), np.uint64)
        passed = None  # the key of a long list that has been told of

        def linked(keys, ids, codes):
            a, b = [], []
            live, d = np.arange(len(keys)), 0
            while len(live):  # pairs at a distance of d rows in one list, over all lists
                d += 1
                live = live[: np.searchsorted(live, len(keys) - d)]
                live = live[keys[live] == keys[live + d]]
                near = live[np.bitwise_count(codes[live] ^ codes[live + d]).sum(axis=-1, dtype=np.int64) <= bits]
                a.append(near)
                b.append(near + d)
            x, y = told(ids, components(len(ids), np.concatenate(a), np.concatenate(b))) if a else (ids[:0], ids[:0])
            return pa.RecordBatch.from_pydict({"a": pa.array(x), "b": pa.array(y)})

        def long(found):
            return pa.RecordBatch.from_pydict({"a": pa.array(found.astype(np.int64)), "b": pa.nulls(len(found), pa.int64())})

        def done(keys, ids, codes):
            own, size = np.unique(keys, return_counts=True)
            if (size > most).any():
                yield long(own[size > most])
                short = np.repeat(size <= most, size)
                keys, ids, codes = keys[short], ids[short], codes[short]
            yield linked(keys, ids, codes)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            codes = np.concatenate([codes, np.stack([batch.column(f"w{k}").to_numpy().view(np.uint64) for k in range(carried)], axis=1)])
            if passed is not None:
                rest = keys != passed
                keys, ids, codes = keys[rest], ids[rest], codes[rest]
                if not len(keys):
                    continue
                passed = None
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from done(keys[:cut], ids[:cut], codes[:cut])
                keys, ids, codes = keys[cut:], ids[cut:], codes[cut:]
            if len(keys) > most:
                yield long(keys[:1])
                passed, keys, ids, codes = keys[0], keys[:0], ids[:0], codes[:0]
        if len(keys):
            yield from done(keys, ids, codes)

    return run


# --- blocks: by bits alone, or verified by whole sets -------------------------------------------


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two texts are similar, by all their distinct shingles' hashes."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both >= similarity * (len(x) + len(y) - both)


def marked(values: list[np.ndarray]) -> np.ndarray:
    """(sets, 64) words: the 4,096 bits that a set's hashes mark."""
    out = np.zeros((len(values), 4096), bool)
    for k, v in enumerate(values):
        out[k, (v >> np.uint64(52)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def maybe_similar(a: np.ndarray, b: np.ndarray, marks: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs can be similar: a mark that only one set has stands for a hash at least that the other one lacks."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 15):
        x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
        both = np.minimum(*(sizes[p] - np.bitwise_count(marks[p] & ~marks[q]).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x))))
        out[at : at + len(x)] = both >= similarity * (sizes[x] + sizes[y] - both) - 1e-9
    return out


def joined(codes: np.ndarray, values: list[np.ndarray], left: int, bits: int, similarity: float | None) -> np.ndarray:
    """Component labels of members. The first `left` ones are compared with all after them; near is within `bits`, and similar where sets decide."""
    root = np.arange(len(codes))
    marks = None

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, left, 128):  # some rows at a time, so that pairs take bounded memory
        a, b, d = [], [], []
        for i in range(at, min(at + 128, left)):
            apart = np.bitwise_count(codes[i + 1 :] ^ codes[i]).sum(axis=-1, dtype=np.int64)
            hit = np.flatnonzero((apart <= bits) & (root[i + 1 :] != root[i]))  # pairs that others have joined need no look
            a.append(np.full(len(hit), i))
            b.append(hit + i + 1)
            d.append(apart[hit])
        a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
        if similarity is None:
            own = np.flatnonzero(root != np.arange(len(root)))
            root = components(len(codes), np.concatenate([own, a]), np.concatenate([root[own], b]))
            continue
        if len(a) > 64:
            marks = marked(values) if marks is None else marks
            fits = maybe_similar(a, b, marks, np.array([len(v) for v in values]), similarity)
            a, b, d = a[fits], b[fits], d[fits]
        for k in np.argsort(d, kind="stable").tolist():  # the nearest first
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y and similar(values[a[k]], values[b[k]], similarity):
                root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root = root[root]
    return root


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width // 8)


def _by_group(keys: list[str], work):
    """mapInArrow over rows sorted by `keys`: work gets the rows of one key, as one batch, and gives batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return work(rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if held and s == 0 and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
                    yield from flush()
                held.append(batch.slice(s, e - s))
                if e < batch.num_rows:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _pairs_of(bits: int, similarity: float | None, width: int):
    """work for a block, or for a tile: its rows with `left` before the others."""

    def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left = rows.num_rows
        if "left" in rows.schema.names:
            rows = rows.take(pa.array(np.argsort(~rows.column("left").to_numpy(zero_copy_only=False), kind="stable")))
            left = int(rows.column("left").to_numpy(zero_copy_only=False).sum())
        ids = rows.column("id").to_numpy()
        values = [np.frombuffer(v, np.uint64) for v in rows.column("value").to_pylist()] if similarity is not None else []
        a, b = _told(ids, joined(_matrix(rows.column("code"), width), values, left, bits, similarity))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    return work


def _medoid(width: int):
    def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = _matrix(rows.column("code"), width)
        bits = np.unpackbits(code.view(np.uint8), axis=1)
        apart = (bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(bits))).sum(axis=1)
        k = int(np.argmin(apart))
        yield pa.RecordBatch.from_pydict({"apart": pa.array([int(apart[k])], pa.int64()), **{c: rows.column(c).slice(k, 1) for c in ("block", "id", "code", "value")}})

    return work


def _near_centre(bits: int, similarity: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for code, value, own_code, own_value in zip(*(batch.column(c).to_pylist() for c in ("code", "value", "centre_code", "centre_value"))):
                x, y = np.frombuffer(code, np.uint64), np.frombuffer(own_code, np.uint64)
                fits = np.bitwise_count(x ^ y).sum() <= bits
                near.append(bool(fits and (similarity is None or similar(np.frombuffer(value, np.uint64), np.frombuffer(own_value, np.uint64), similarity))))
            yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "id": batch.column("id"), "centre": batch.column("centre"), "near": pa.array(near, pa.bool_()), "bytes": pc.binary_length(batch.column("value")).cast(pa.int64())})

    return run


def large_links(members: DataFrame, sizes: DataFrame, bits: int, similarity: float | None, tile: int, width: int) -> DataFrame:
    """Links (a, b) that join all members of each block that near pairs connect. sizes: block, n (members), bytes (of values); rows of members of other blocks are left out.

    Moved are the members once, and once more for each part of those that are not near their block's centre.
    """
    side = F.greatest(F.lit(tile), F.least(F.lit(SIDE), F.ceil(F.col("n") / PARTS))).cast("int")
    parts = lambda n: F.greatest(F.ceil(n / F.col("side")), F.ceil(F.col("bytes") / TILE_BYTES), F.lit(1)).cast("int")
    sizes = small_side(written(sizes.withColumn("side", side).select("block", "side", parts(F.col("n")).alias("parts")), "large-blocks"))
    dealt = members.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    medoids = dealt.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(trimmed(_by_group(["block", "part"], _medoid(width))), f"apart long, {MEMBER}")
    best = written(medoids.groupBy("block").agg(F.min(F.struct("apart", "id", "code", "value")).alias("c")), "centres")
    centres = best.select("block", F.col("c.id").alias("centre"), F.col("c.code").alias("centre_code"), F.col("c.value").alias("centre_value"))
    told = written(members.join(small_side(centres, 200), "block").mapInArrow(trimmed(_near_centre(bits, similarity)), "block long, id long, centre long, near boolean, bytes long"), "near-centres")
    links = told.where("near AND id <> centre").select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b"))

    apart = told.where("NOT near").select("block", "id")
    counts = told.where("NOT near").groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).join(sizes, "block")
    counts = small_side(written(counts.select("block", parts(F.col("n")).alias("own_parts")), "apart-blocks"))
    left = members.join(small_side(apart, BROADCAST_NUMBERS // 2), ["block", "id"], "left_semi").join(counts, "block").join(sizes, "block")
    left = left.withColumn("own_part", F.pmod(F.xxhash64("id"), F.col("own_parts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("left", F.lit(True))
    right = dealt.join(counts, "block").withColumn("own_part", F.explode(F.sequence(F.lit(0), F.col("own_parts") - 1))).withColumn("left", F.lit(False))
    columns = ["block", "own_part", "part", "left", "id", "code", "value"]
    tiles = left.select(*columns).unionByName(right.select(*columns)).repartition("block", "own_part", "part").sortWithinPartitions("block", "own_part", "part")
    return links.unionByName(tiles.mapInArrow(trimmed(_by_group(["block", "own_part", "part"], _pairs_of(bits, similarity, width))), "a long, b long").where("a <> b"))


# --- the operator -------------------------------------------------------------------------------


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, code) with the whole code in 64-bit words."""
    for batch in batches:
        if batch.num_rows:
            words = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int64).reshape(batch.num_rows, POSITIONS // 8)
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "id": batch.column("id"), **{f"w{k}": pa.array(np.ascontiguousarray(words[:, k])) for k in range(POSITIONS // 8)}})


def candidate_blocks(classes: DataFrame, similarity: float) -> DataFrame:
    """(id, block) of the texts (id, code) that lists link, the block being its smallest id."""
    schema = lambda key, words: ", ".join([f"key {key}", "id long", *[f"w{k} long" for k in range(words)]])
    codes = classes.select("id", "code")
    index, bits = codes.mapInArrow(trimmed(_index), schema(_KEY, CARRIED)), most_bits(similarity, 8 * POSITIONS)
    told = written(index.repartition("key").sortWithinPartitions("key", "id").mapInArrow(trimmed(_lists(most_bits(similarity), LIST)), "a long, b long"), "list-groups")
    hot = written(told.where("b IS NULL").select(F.col("a").cast(_KEY).alias("key")).distinct(), "long-lists")
    groups = told.where("b IS NOT NULL").select(F.col("a").alias("key"), F.col("b").alias("id")).distinct()
    whole = groups.join(codes, "id").select("key", "id", "code").mapInArrow(trimmed(_worded), schema("long", POSITIONS // 8))
    found = whole.repartition("key").sortWithinPartitions("key", "id").mapInArrow(trimmed(_lists(bits, math.inf, _told, np.int64, POSITIONS // 8)), "a long, b long")
    if hot.limit(1).count():
        rows = index.select("key", "id").join(small_side(hot), "key").select(F.col("key").cast("long").alias("block"), "id")
        members = written(rows.join(codes, "id").select("block", "id", "code", F.lit(b"").alias("value")), "long-list-members")
        found = found.unionByName(large_links(members, members.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("bytes")), bits, None, LIST, POSITIONS))
    ends = stars(found)
    roots = ends.select(F.col("b").alias("id"), F.col("b").alias("block")).distinct()
    return ends.select(F.col("a").alias("id"), F.col("b").alias("block")).unionByName(roots)


def similar_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join all members (MEMBER) of a block that similar pairs connect."""
    bits, width = most_bits(similarity, 8 * POSITIONS), POSITIONS
    sizes = written(members.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes")), "block-sizes")
    large = sizes.where(f"n > {TILE} OR bytes > {TILE_BYTES}")
    many = large.limit(1).count() > 0
    own = members.join(small_side(large.select("block")), "block", "left_anti") if many else members
    links = own.repartition("block").sortWithinPartitions("block").mapInArrow(trimmed(_by_group(["block"], _pairs_of(bits, similarity, width))), "a long, b long")
    return links.unionByName(large_links(members, large, bits, similarity, TILE, width)) if many else links


def _labelled(docs: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(content: row, at; labels: at, doc_id, group - the number of a row of its group)."""
    content = numbered(docs, "near-content")
    texts = content.select("at", F.col("row.`doc_id`").cast("long").alias("doc_id"), F.col("row.`text`").cast("string").alias("text"))
    coded = written(texts.mapInArrow(trimmed(_coded(size, similarity)), "at long, doc_id long, digest binary, code binary, alone boolean"), "wide-fingerprints")
    classes = written(coded.groupBy("digest").agg(F.min("at").alias("id"), F.first("code").alias("code"), F.first("alone").alias("alone")), "wide-classes")
    blocks = written(candidate_blocks(classes.where("NOT alone"), similarity), "blocks")
    members = written(texts.select(F.col("at").alias("id"), "text").join(small_side(blocks, BROADCAST_NUMBERS // 2), "id").mapInArrow(trimmed(_sets(size)), MEMBER), "block-members")
    roots = stars(similar_links(members, similarity))
    of = classes.join(roots.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("digest", F.coalesce("root", "id").alias("group"))
    return content, coded.select("at", "doc_id", "digest").join(of, "digest").select("at", "doc_id", "group")


def near_groups(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group, null if it has none) for each row."""
    _, labels = _labelled(docs, size, similarity)
    labels = written(labels, "near-labels")
    least = labels.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return labels.join(least, "group").select("doc_id", "component_id")


def drop_near_groups(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id (null last), of equal ones the first in docs' order."""
    content, labels = _labelled(docs, size, similarity)
    labels = written(labels, "near-labels")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first")
    stays = small_side(labels.groupBy("group").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("group", F.col("first.at").alias("stays")))
    gone = written(labels.join(stays, "group").where("at <> stays").select("at"), "near-dropped")
    return content.join(small_side(gone, BROADCAST_NUMBERS), "at", "left_anti").select("row.*")
