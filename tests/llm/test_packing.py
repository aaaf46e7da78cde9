from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from boxloom.llm import entry, packing
from tests.oracle import SF_DIR


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_is_a_packing(sizes):
    bins, offset, capacity = packing.best_fit(np.array(sizes, np.int64), (16, 32, 64), 2)
    assert len(bins) == len(sizes)
    for b in set(bins.tolist()):
        rows = np.flatnonzero(bins == b)
        total = sum(sizes[i] for i in rows)
        spans = sorted((offset[i], offset[i] + sizes[i]) for i in rows)
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == total
        assert {capacity[i] for i in rows} == {min(c for c in (16, 32, 64) if c >= total)}


def test_best_fit_prefers_the_tightest_room():
    bins, _, capacity = packing.best_fit(np.array([60, 50, 14, 4]), (64,), 0)
    assert bins.tolist() == [0, 1, 1, 0] and capacity.tolist() == [64] * 4


def test_open_size_weighs_cost_against_content():
    assert packing.open_size(10, 0, 0, (16, 32, 64), 4) == 16
    assert packing.open_size(10, 1000, 1, (16, 32, 64), 4) == 64
    assert packing.open_size(10, 1000, 40, (16, 32, 64), 0) == 64
    assert packing.open_size(10, 1000, 60, (16, 32, 64), 0) == 16


def test_joint_sizes_waste_less_than_any_one_size():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 4000, 3000)
    sizes = np.r_[sizes, rng.integers(8000, 16384, 300)]
    _, _, cap = packing.best_fit(sizes, packing.CAPACITIES)
    bins, _, one = packing.best_fit(sizes, packing.CAPACITIES[-1:])
    full = lambda b, c: {x: y for x, y in zip(b, c)}
    assert sum(full(packing.best_fit(sizes)[0], cap).values()) <= sum(full(bins, one).values())
    assert sizes.sum() / sum(full(packing.best_fit(sizes)[0], cap).values()) > 0.97


def test_whole_texts_come_back_in_pieces(spark):
    rows = [(1, "a" * 40000), (2, None), (3, ""), (4, "é" * 100), (4, "é" * 100), (None, "null id"), (5, "b" * 16383), (6, "c" * 16384)]
    docs = spark.createDataFrame([(d, t, 9, "x") for d, t in rows], "doc_id long, text string, piece int, bin_id string")
    out = packing.pack(docs).toPandas()
    want = {}
    for d, t in rows:
        want[str(d)] = want.get(str(d), 0) + len((t or "").encode()) + 1
    ids = out.doc_id.map(lambda v: "None" if np.isnan(v) else str(int(v)))
    assert out.groupby(ids).n_tokens.sum().to_dict() == want
    one = out[ids == "1"].sort_values("piece")
    assert one.start.tolist() == [0, 16384, 32768] and one.n_tokens.tolist() == [16384, 16384, 40001 - 32768]
    by = out.groupby("bin_id").agg(t=("n_tokens", "sum"), b=("bin_tokens", "first"), c=("bin_capacity", "first"))
    assert (by.t == by.b).all() and (by.b <= by.c).all() and set(by.c) <= set(packing.CAPACITIES)


def test_groups_are_stable_and_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 5000)) for i in range(400)], "doc_id long, text string")
    a, b = (packing.pack(docs.repartition(n), group=64).toPandas().sort_values("doc_id").reset_index(drop=True) for n in (1, 5))
    assert a.equals(b) and a.bin_id.str.split("-").str[0].nunique() == 7


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(IndexError):
        packing.best_fit(np.array([100]), (64,), 0)


def plain_best_fit(sizes, capacities, bin_cost):
    """Every open bin looked at for every piece: (contents, capacity) of each bin."""
    left, bins = sorted(sizes, reverse=True), []
    for at, size in enumerate(left):
        fitting = [b for b in bins if b[0] - sum(b[1]) >= size]
        if fitting:
            min(fitting, key=lambda b: b[0] - sum(b[1]))[1].append(size)
            continue
        later = left[at + 1 :]
        cost = {}
        for cap in capacities:
            if cap >= size:
                filled = min(cap, size + sum(later)) if min(sizes) <= cap - size else size
                cost[cap] = (cap + bin_cost) / filled
        bins.append([min(cost, key=lambda c: (cost[c], c)), [size]])
    return sorted((sorted(held), min(c for c in capacities if c >= sum(held))) for _, held in bins)


def bins_of(sizes, bins, capacity):
    held = {}
    for size, b, cap in zip(sizes, bins, capacity):
        held.setdefault(b, ([], cap))[0].append(int(size))
    return sorted((sorted(x), int(cap)) for x, cap in held.values())


def test_best_fit_equals_a_plain_version():
    rng = np.random.default_rng(1)
    for k in range(60):
        sizes = rng.integers(1, 2 + k, rng.integers(1, 90))
        bins, _, capacity = packing.best_fit(sizes, (16, 32, 64), k % 5)
        assert bins_of(sizes, bins, capacity) == plain_best_fit(sizes.tolist(), (16, 32, 64), k % 5)


def test_whole_query_equals_a_plain_version_by_group(spark):
    out = entry.op5_packing(spark, SF_DIR).toPandas()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    want = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.itertuples()}
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == want
    for name, rows in out.groupby(out.bin_id.str.split("-").str[0]):
        got = bins_of(rows.n_tokens, rows.bin_id, rows.bin_capacity)
        if name == "full":
            assert got == [([packing.CAPACITIES[-1]], packing.CAPACITIES[-1])] * len(rows)
        else:
            assert got == plain_best_fit(rows.n_tokens.tolist(), packing.CAPACITIES, packing.BIN_COST)


def test_copies_of_one_row_are_dealt_over_all_groups(spark):
    docs = spark.range(40_000).selectExpr("7L as doc_id", "repeat('x', 99) as text")
    out = packing.pack(docs).toPandas()
    groups = out.bin_id.str.split("-").str[0].value_counts()
    assert len(out) == 40_000 and len(groups) == 5 and groups.max() <= packing.GROUP
    long = packing.pack(spark.range(5000).selectExpr("7L as doc_id", "repeat('x', 16383) as text")).toPandas()
    assert len(long) == 5000 and long.bin_id.nunique() == 5000
