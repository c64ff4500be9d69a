from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import components, exact_dedup, simhash_dedup, simhash_wide
from millrace.llm.common import shared_dir, strings, table, xxh64
from millrace.llm.components import stars


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(exact_dedup.sha256(t), 1, 1)], ids=["sha256", "colliding"])
def test_exact_against_brute_force(spark, odd_docs, digest):
    docs = odd_docs.collect()
    groups = defaultdict(list)
    for r in docs:
        groups[normal(r.text)].append(r.doc_id)
    got = exact_dedup.exact_duplicates(odd_docs, digest).collect()
    want = [(r.doc_id, min((d for d in groups[normal(r.text)] if d is not None), default=None), len(groups[normal(r.text)])) for r in docs]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    if digest is exact_dedup.sha256:
        assert {r.text_sha256 for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def test_exact_keeps_columns_and_takes_empty_tables(odd_docs, no_docs):
    kept = exact_dedup.drop_exact_duplicates(odd_docs)
    assert kept.schema.names == odd_docs.schema.names and kept.where("digest = 'x'").count() == kept.count()
    assert exact_dedup.exact_duplicates(no_docs).count() == 0 and exact_dedup.drop_exact_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(exact_dedup.sha256(t), 1, 1)], ids=["sha256", "colliding"])
def test_later_batches_meet_a_standing_store(spark, digest):
    """After each batch the labels are those of all rows so far, by brute force, also where digests collide over batches."""
    store, state = shared_dir(spark, "t-store"), shared_dir(spark, "t-state")
    batches = [[(5, "a"), (6, "b"), (9, "text 1")], [(7, "a"), (2, "b"), (8, "text 2"), (None, "text 2")], [(1, "text  1"), (10, "c")], [(11, "text 2"), (12, "c")]]
    seen = []
    for rows in batches:
        seen += rows
        got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), digest, store=store, state=state).collect()
        groups = defaultdict(list)
        for d, t in seen:
            groups[normal(t)].append(d)
        want = [(d, min(x for x in groups[normal(t)] if x is not None), len(groups[normal(t)])) for d, t in seen]
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=key) == sorted(want, key=key)
        assert sum(r.kept for r in got) == len(groups)
    content = exact_dedup.contents(spark, store)
    assert content.select("locator").distinct().count() == content.count() == len(seen)
    assert {(r.locator.batch, r.id) for r in content.collect()} == {(n, d) for n, rows in enumerate(batches) for d, _ in rows}


def test_large_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_SALT", 3)
    got = exact_dedup.exact_duplicates(spark.range(20).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")))
    assert got.where("keep_id = 0 AND group_size = 20").count() == 20 and got.where("kept").count() == 1


def reference_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes):
    codes = np.array(codes, np.uint64)
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 2):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_simhash_against_brute_force(spark, sf, odd_docs):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd_docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text").where("doc_id IS NOT NULL"))
    rows = sorted(docs.distinct().collect())
    codes = [reference_fingerprint(r.text) for r in rows]
    roots = brute_components(codes)
    want = {r.doc_id: (f"{c:016x}", rows[k].doc_id) for r, c, k in zip(rows, codes, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()} == want


def test_simhash_nulls_and_empty(odd_docs, no_docs):
    got = simhash_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.component_id for r in got if r.fingerprint == "0" * 16} == {3}
    assert simhash_dedup.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("most", [512, 3])
@pytest.mark.parametrize("n", [10, 64, 700])
def test_lists_link_all_that_is_near(n, most):
    """By tallies and by flips, over several lists in one go."""
    rng = np.random.default_rng(n)
    codes = np.unique(np.array([0xABCDEF0000000000 | int(rng.integers(0, 1 << 16)) for _ in range(n)], np.uint64))
    keys = np.sort(rng.integers(0, 2, len(codes)))
    a, b = simhash_dedup.linked(keys, codes, most=most)
    label = {int(c): int(c) for c in codes}
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = label[x], label[y]
        label = {c: min(x, y) if z in (x, y) else z for c, z in label.items()}
    for k in (0, 1):
        own = codes[keys == k]
        want = [int(own[r]) for r in brute_components(own)]
        assert [label[int(c)] for c in own] == want


def test_any_near_pair_shares_an_index_key(spark):
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = int(rng.integers(0, 1 << 63))
        y = x ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
        assert any(all((x ^ y) >> 16 * k & 0xFFFF == 0 for k in chosen) for chosen in simhash_dedup.index_blocks())
    with pytest.raises(ValueError):
        simhash_dedup.index_blocks(4)
    codes = spark.createDataFrame([(-1,), (-2,), (-4,), (7,), (7 | 1 << 63 - 1,), (-(1 << 63) + 7,)], "code long")
    got = stars(simhash_dedup.links(codes)).collect()
    assert {r.a: r.b for r in got} == {-1: -4, -2: -4, 7: -(1 << 63) + 7, (7 | 1 << 62): -(1 << 63) + 7}


def test_hashes_of_spans_are_the_librarys():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4800, 400)
    ends = starts + np.concatenate([np.arange(200), rng.integers(0, 100, 200)])
    for seed in (0, 42):
        assert xxh64(data, starts, ends, seed).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), seed) for a, b in zip(starts, ends)]


@pytest.mark.parametrize("part", [1_000_000, 9], ids=["one part", "parts and rounds"])
def test_components_of_a_long_path(spark, monkeypatch, part):
    monkeypatch.setattr(components, "PART", part)
    rng = np.random.default_rng(1)
    order = rng.permutation(60).tolist()
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.a: r.b for r in stars(edges).collect()} == {k: 0 for k in range(1, 60)} | {101: 100}


def shingles(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sets_of(texts):
    return simhash_wide.shingle_sets(strings(pa.array(texts)))


def test_shingle_sets_and_fingerprints():
    texts = ["A b c d e f", "a  B\tc d\ne F", "", None, "a b", "a\x0bb", "a b c d e a b c d e a b c d e", "é É x y z w", " ".join(f"w{k}" for k in range(2000))]
    sets = sets_of(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert [[bool(np.array_equal(x, y)) for y in sets] for x in sets] == [[shingles(x) == shingles(y) for y in texts] for x in texts]
    codes = simhash_wide.fingerprints(sets)
    assert not codes[2].any() and (codes[0] == codes[1]).all()
    h, seed, turn = sets[8], simhash_wide._SEEDS[5], simhash_wide._SEEDS[4]
    x = (h ^ seed) * turn
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    assert codes[8, 40:].view("<u8")[0] == sum(1 << b for b in range(64) if 2 * int(((x >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def edited(rng, words, n, tag):
    out = list(words)
    for i in rng.choice(len(words), n, replace=False):
        out[i] = f"edit{tag}x{i}"
    return out


def test_recall_of_every_band_from_080_up(spark, sf):
    """Pairs of each band by exact sets, among documents and edited copies of theirs: nine in ten or more end up in one group, and nothing else does."""
    rng = np.random.default_rng(5)
    base = [r for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    rows = [(r.doc_id, r.text) for r in base]
    for r in base:
        w = r.text.split()
        if 14 <= len(w) <= 1200:
            for k in range(3):
                rows.append((10_000 * (k + 1) + r.doc_id, " ".join(edited(rng, w, max(1, int(len(w) * rng.uniform(0.002, 0.026))), k))))
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    seen, bands = set(), defaultdict(list)
    for own in holders.values():
        if len(own) <= 300:
            seen.update((a, b) for i, a in enumerate(own) for b in own[i + 1 :])
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in seen:
        j = jaccard(sets[a], sets[b])
        if j >= 0.8:
            bands[min(int(round(j, 9) * 20), 19)].append((a, b))
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in simhash_wide.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    label = [got[d] for d, _ in rows]
    assert set(bands) == {16, 17, 18, 19}
    for pairs in bands.values():
        assert len(pairs) >= 200 and sum(label[a] == label[b] for a, b in pairs) >= 0.97 * len(pairs)
    first = {}
    for k, own in enumerate(label):
        if sets[k]:
            assert find(first.setdefault(own, k)) == find(k)


def test_pairs_at_the_bound_share_a_list():
    rng = np.random.default_rng(12)
    texts = []
    for k in range(600):
        w = [f"p{k}w{i}" for i in range(300)]
        texts += [" ".join(w), " ".join(edited(rng, w, 6, k))]
    sets = [shingles(t) for t in texts]
    keys = simhash_wide.index_keys(simhash_wide.fingerprints(sets_of(texts)))
    told = [(keys[k] == keys[k + 1]).any() for k in range(0, len(texts), 2) if 0.8 <= jaccard(sets[k], sets[k + 1]) < 0.83]
    assert len(told) > 300 and sum(told) >= 0.97 * len(told)


def test_near_groups_of_odd_rows(odd_docs, no_docs):
    kept = simhash_wide.drop_near_groups(odd_docs)
    assert kept.columns == odd_docs.columns
    got = kept.collect()
    ids = [r.doc_id for r in got]
    assert sorted(d for d in ids if d is not None) == [1, 3, 7, 9, 10, 11] and ids.count(None) == 1
    assert next(r.text for r in got if r.doc_id is None) == "alone without an id"
    assert simhash_wide.near_groups(odd_docs).count() == odd_docs.count()
    assert simhash_wide.drop_near_groups(no_docs).count() == 0 and simhash_wide.near_groups(no_docs).count() == 0


def test_rows_of_one_doc_id_are_told_apart(spark):
    """A copy goes; a text of its own under the same doc_id, or under none, stays."""
    a, b, c = ("one two three four five six seven eight nine ten", "quite another text that nobody has copied from anywhere", "a third text which has no id but words of its own here")
    rows = [(1, a), (5, a.upper()), (5, b), (None, c), (None, c + " "), (None, a)]
    kept = simhash_wide.drop_near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text.strip()) for r in kept), key=str) == sorted([(1, a), (5, b), (None, c)], key=str)


@pytest.mark.parametrize("spread", [False, True], ids=["nested", "around one"])
def test_large_lists_and_blocks_are_dealt_into_parts(spark, monkeypatch, spread):
    """The same components with small parts as in one task: chains of copies, or copies near to their original alone."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(3):
        w = [f"g{g}w{k}" for k in range(260)]
        rows.append((100 * g, " ".join(w)))
        for k in range(1, 60):
            if spread:
                rows.append((100 * g + k, " ".join(edited(rng, w, 5, k))))
            else:
                w = edited(rng, w, 2, k)
                rows.append((100 * g + k, " ".join(w)))
    rows += [(1000 + k, " ".join(f"own{k}x{i}" for i in range(100))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, simhash_wide.near_groups(docs).collect()))
    monkeypatch.setattr(simhash_wide, "LIST", 7)
    monkeypatch.setattr(simhash_wide, "TILE", 9)
    assert sorted(map(tuple, simhash_wide.near_groups(docs).collect())) == whole
    sets = {d: shingles(t) for d, t in rows}
    for g in range(3):
        ids = [100 * g + k for k in range(60)]
        parent = {d: d for d in ids}
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if jaccard(sets[a], sets[b]) >= 0.8:
                    x, y = parent[a], parent[b]
                    parent = {d: min(x, y) if p in (x, y) else p for d, p in parent.items()}
        told = dict(whole)
        assert sum(told[d] == parent[d] for d in ids) >= 57


@pytest.mark.parametrize("most", [1024, 7], ids=["short lists", "long lists"])
def test_texts_near_by_carried_bits_alone_make_no_block(spark, monkeypatch, most):
    """Chance brings together more pairs than there are texts; whole fingerprints tell them apart, and keep those that are near."""
    monkeypatch.setattr(simhash_wide, "LIST", most)
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (200, simhash_wide.POSITIONS), np.uint8)
    codes[:, : 8 * simhash_wide.CARRIED] = codes[0, : 8 * simhash_wide.CARRIED]
    codes[7], codes[120] = codes[3], codes[60]
    codes[7, 40] ^= 3
    classes = spark.createDataFrame([(k, bytearray(c.tobytes())) for k, c in enumerate(codes)], "id long, code binary")
    assert sorted(map(tuple, simhash_wide.candidate_blocks(classes, 0.8).collect())) == [(3, 3), (7, 3), (60, 60), (120, 60)]


def test_sets_too_small_for_near_copies_are_not_listed():
    """Of n shingles, another set has n of n + 1 in common at best."""
    assert [n for n in range(9) if simhash_wide.alone(n, 0.8)] == [0, 1, 2, 3]
    for n in range(1, 30):
        for similarity in (0.5, 0.75, 0.8, 0.9):
            nested = simhash_wide.similar(np.arange(n, dtype=np.uint64), np.arange(n + 1, dtype=np.uint64), similarity)
            assert simhash_wide.alone(n, similarity) != nested


@pytest.mark.parametrize("left", [300, 40, 0])
def test_joined_against_brute_force(left):
    rng = np.random.default_rng(left)
    values = []
    for g in range(6):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        for _ in range(50):
            own = base.copy()
            own[rng.choice(60, rng.integers(0, 14), replace=False)] = rng.integers(0, 1 << 63, dtype=np.uint64)
            values.append(np.unique(own))
    order = rng.permutation(len(values))
    values = [values[k] for k in order]
    codes = simhash_wide.fingerprints(values).view(np.uint64)
    label = list(range(len(values)))
    for i in range(left):
        for j in range(i + 1, len(values)):
            if np.bitwise_count(codes[i] ^ codes[j]).sum() <= 86 and label[i] != label[j] and simhash_wide.similar(values[i], values[j], 0.8):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert simhash_wide.joined(codes, values, left, 86, 0.8).tolist() == label


def test_a_half_written_batch_is_written_again(spark, tmp_path):
    """A batch whose write died leaves no rows behind and keeps its number."""
    import os

    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    store, state = f"{tmp_path}/store", f"{tmp_path}/state"
    assert exact_dedup.exact_duplicates(docs, store=store, state=state).count() == 3
    assert exact_dedup.add_to_store(docs.where("doc_id = 3"), store) == 1
    os.remove(f"{store}/n=1/_SUCCESS")
    more = spark.createDataFrame([(4, "b"), (0, "c")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(more, store=store, state=state).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (0, 0, 1)}
