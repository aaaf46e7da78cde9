from __future__ import annotations

import numpy as np
import pytest

from boxloom.llm import embed_dedup as e


def brute(ids, vectors, threshold=0.95):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(ids)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    out = []
    for i in range(n):
        c = min(ids[j] for j in range(n) if find(j) == find(i))
        out.append((ids[i], links[i], c, c == ids[i]))
    return sorted(out)


def vectors(seed, clusters, noise, dim=32):
    rng = np.random.default_rng(seed)
    out = []
    for size in clusters:
        base = rng.standard_normal(dim)
        for _ in range(size):
            v = base + noise * rng.standard_normal(dim)
            out.append((v * rng.uniform(0.5, 2)).astype(np.float32).astype(float).tolist())
    return out


def run(spark, ids, rows):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, rows)], "vec_id long, embedding array<float>, n int, band int")
    return sorted(tuple(r) for r in e.near_duplicates(df).collect())


def test_near_copies_links_and_components(spark):
    rows = vectors(1, [1] * 60 + [2, 3, 5, 8], 0.1)
    rows += [rows[0], rows[0], rows[-1], None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] + [1.0] * 31, [float("inf")] * 32, [1.0, 0.0], [2.0, 0.0]]
    ids = [(i * 7919) % 1009 for i in range(len(rows))]
    want = brute(ids, rows)
    assert run(spark, ids, rows) == want
    assert sum(r[1] for r in want) > 50


def test_one_crowded_cluster_is_split_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 16)
    rows = vectors(2, [120] + [1] * 30, 0.02)
    ids = list(range(len(rows)))
    assert run(spark, ids, rows) == brute(ids, rows)


def test_recall_close_to_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        a = rng.standard_normal(64)
        b = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        cos = rng.uniform(0.945, 0.96)
        rows += [a.tolist(), (cos * a + np.sqrt(1 - cos**2) * b).tolist()]
    ids = list(range(len(rows)))
    df = spark.createDataFrame(list(zip(ids, rows)), "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in e.near_duplicates(df).collect())
    want = brute(ids, rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= there and found >= 0.97 * there
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_estimate_is_unbiased_and_its_bound_holds():
    rng = np.random.default_rng(4)
    cos, guess, passed = [], [], []
    for k in range(200):
        a = rng.standard_normal((20, 64))
        b = 0.5 * a + rng.standard_normal((20, 64))
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
        _, code, factor = e.sign_codes(a, turn)
        true = np.einsum("ij,ij->i", a, b)
        cos.append(true)
        guess.append(np.einsum("ij,ij->i", code, b @ turn) / factor)
        passed.append([e.may_link(code[i : i + 1], factor[i : i + 1], (b @ turn)[i : i + 1], true[i])[0] for i in range(20)])
    assert abs(np.mean(guess) - np.mean(cos)) < 0.01
    assert np.mean(passed) > 0.999


def test_pair_streams():
    got = [(i, j) for a, b in e.pairs_in_runs(np.array([0, 3, 4]), np.array([3, 4, 8]), 2) for i, j in zip(a.tolist(), b.tolist())]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)]
    got = [(i, j) for a, b in e.pairs_across(np.array([1, 2]), np.array([5, 6]), 1) for i, j in zip(a.tolist(), b.tolist())]
    assert sorted(got) == [(1, 5), (1, 6), (2, 5), (2, 6)]


@pytest.mark.parametrize("rows", [[], [None, [0.0, 0.0]]])
def test_nothing_to_link(spark, rows):
    ids = list(range(len(rows)))
    assert run(spark, ids, rows) == [(i, 0, i, True) for i in ids]


def test_bands_follow_the_number_of_vectors():
    assert e.plan_bands(0)[0] == 6
    bits, bands = e.plan_bands(10**6)
    assert e.BUCKET / 2 <= 10**6 / 2**bits <= e.BUCKET * 2
    rng, p = np.random.default_rng(5), np.arccos(0.95) / np.pi
    differ = rng.random((2000, e.WIDTH)) < p
    missed = differ[:, e.band_bits(e.WIDTH, bits, bands)].any(axis=2).all(axis=1)
    assert missed.mean() < 0.01


def test_codes_are_packed_and_their_distance_estimates_the_angle():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((4000, 64))
    b = 2.5 * a + rng.standard_normal((4000, 64))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    turn = e.turn_of(64)
    (_, code, factor), (_, other, _) = e.sign_codes(a, turn), e.sign_codes(b, turn)
    words = e.words_of(code > 0)
    assert words.shape == (4000, 3) and np.array_equal(e.signs_of(words, 192), code)
    differ = np.bitwise_count(words ^ e.words_of(other > 0)).sum(axis=1)
    angle = np.arccos(np.einsum("ij,ij->i", a, b))
    assert abs((differ / 192 * np.pi - angle).mean()) < 0.01
    at = np.array([e.most_differing(192, np.cos(x)) for x in angle])
    assert (differ <= at).mean() > 0.999
    near = e.may_link(code, factor, b @ turn, 0.95)
    assert near[np.cos(angle) >= 0.95].mean() > 0.999 and not near[np.cos(angle) < 0.7].any()


def test_vectors_of_several_lengths_share_one_plan(spark):
    rows = [v for k, dim in enumerate((1, 2, 3, 7, 200)) for v in vectors(10 + k, [1] * 5 + [3, 4], 0.05, dim)]
    ids = list(range(len(rows)))
    assert run(spark, ids, rows) == brute(ids, rows)


def test_vectors_of_one_id_are_vectors_of_their_own(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near_x, near_y = [1.0, 0.01, 0.0], [0.0, 1.0, 0.01]
    assert run(spark, [1, 1, 4, 5], [x, y, near_x, near_y]) == [(1, 1, 1, True), (1, 1, 1, True), (4, 1, 1, False), (5, 1, 1, False)]
    assert run(spark, [3, 3, 1, 5], [x, y, near_x, near_y]) == [(1, 1, 1, True), (3, 1, 1, False), (3, 1, 3, True), (5, 1, 3, False)]


def test_rows_without_an_id_link_and_name_nothing(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.01, 1.0]), (5, [-1.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (7, None)]
    out = e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=str)
    assert got == sorted([(1, 1, 1, True), (None, 1, 1, False), (None, 1, None, True), (None, 1, None, True), (5, 1, 5, True), (None, 1, 5, False), (None, 0, None, True), (7, 0, 7, True)], key=str)
