from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from boxloom.llm import shared, simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def brute_components(ids, prints):
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in zip(ids, prints):
        for j, q in zip(ids, prints):
            if i is not None and j is not None and (p ^ q).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


WORDS = "the of and to in is on by it was for with as at from this that are be or".split()


def texts():
    rng = random.Random(5)
    out = [None, "", "  \t\n", "One", "one", "Two words", "É é", "a b c", "A\x0bB\x0cC"]
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    for t in base:
        out += [t] * rng.randrange(1, 4)
        words = t.split()
        for _ in range(rng.randrange(0, 4)):
            words = list(words)
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    out.append("word " * 30000)
    return out


def test_whole_query_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], prints)
    assert got == {i: (f"{p:016x}", want[i]) for (i, _), p in zip(rows, prints)}


def test_same_table_again_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "other words that nobody has")], schema)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3), (3, 3), (None, 3), (None, None)]
    assert simhash.dedup_documents(docs).count() == 4


@pytest.mark.parametrize("top", [64, 60])
def test_trie_join_finds_every_link(top):
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1)
    flips = [seeds]
    for k in (1, 2, 3, 4):
        v = seeds.copy()
        for _ in range(k):
            v ^= np.uint64(1) << rng.integers(0, 64, len(v), dtype=np.uint64)
        flips.append(v)
    value = np.unique(np.concatenate(flips))
    if top < 64:
        value = value[value >> np.uint64(top) == 5]
    value = np.sort(value)
    found = set()
    for i, j in simhash._near(value, value, True, top):
        found |= set(zip(i.tolist(), j.tolist()))
    diff = np.bitwise_count(value[:, None] ^ value[None, :])
    half = np.bitwise_count((value[:, None] ^ value[None, :]) >> np.uint64(32))
    must = {(i, j) for i, j in zip(*np.nonzero((diff <= 3) & (half <= 1))) if i < j}
    allowed = {(i, j) for i, j in zip(*np.nonzero(diff <= 3)) if i < j}
    assert must <= found <= allowed


def test_many_levels_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTREE", 8)
    test_whole_query_against_brute_force(spark)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (205, 201), (201, 205)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {k: 100 for k in range(100, 130)} | {201: 201, 205: 201}
    assert got == want
    assert shared.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_texts_of_one_id_are_judged_each(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in ("river", "stone", "light", "hope"))
    docs = spark.createDataFrame([(2, a), (5, a), (5, b), (1, c), (1, d), (7, c), (8, d)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.dedup_documents(docs).collect())) == sorted([(2, a), (5, b), (1, c), (1, d)])
    docs = spark.createDataFrame([(3, a), (3, b), (1, a), (2, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 2), (3, 1), (3, 2)]


@pytest.mark.parametrize("limit", [2])
def test_crowded_subtrees_are_walked_further(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SUBTREE", 64)
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = np.random.default_rng(8)
    near = np.uint64(0xFEDCBA9876543210) ^ (np.uint64(1) << rng.integers(0, 64, (500, 4), dtype=np.uint64)).cumsum(axis=1, dtype=np.uint64)[:, 3]
    low = np.uint64(0xFEDCBA9800000000) | rng.integers(0, 1 << 14, 400, dtype=np.uint64)
    value = np.unique(np.concatenate([near, low, rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    fp = value.view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in fp], "fp long")
    edges = [(r.src, r.dst) for r in simhash.link_fingerprints(nodes, len(fp)).collect()]
    at = {v: k for k, v in enumerate(fp)}
    got = shared.fold_links(np.arange(len(fp)), np.array([at[a] for a, _ in edges], int), np.array([at[b] for _, b in edges], int))
    i, j = np.nonzero(np.bitwise_count(value[:, None] ^ value[None, :]) <= 3)
    assert np.array_equal(got, shared.fold_links(np.arange(len(fp)), i, j))
    assert len(set(got.tolist())) < len(fp)
