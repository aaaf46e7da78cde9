from __future__ import annotations

import random
import time

from boxloom.llm import line_dedup


def brute(rows, min_sites):
    sites, first = {}, {}
    for doc, text, site in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.strip(" ")
            if line:
                if site is not None:
                    sites.setdefault(line, set()).add(site)
                if doc is not None:
                    first[line] = min(first.get(line, (doc, pos)), (doc, pos))
    out = []
    for doc, text, site in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [
            x for pos, x in enumerate(lines)
            if doc is None or not x.strip(" ") or len(sites.get(x.strip(" "), ())) < min_sites or first[x.strip(" ")] == (doc, pos)
        ]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, min_sites=10):
    docs = spark.createDataFrame([(d, t, s, 1, "a") for d, t, s in rows], "doc_id long, text string, source string, pos int, line string")
    out = line_dedup.dedup_lines(docs, min_sites)
    assert out.columns == ["doc_id", "text", "source", "pos", "line", "n_lines", "n_removed"]
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()], key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    shared = [f"shared line {i}" for i in range(25)]
    rows = []
    for doc in range(150):
        lines = [f" {rng.choice(shared[: 1 + doc % 25])} " if rng.random() < 0.5 else f"own {doc} {k}" for k in range(rng.randrange(0, 9))]
        rows.append((doc, "\n".join(lines), f"s{rng.randrange(14)}"))
    assert run(spark, rows) == brute(rows, 10)
    assert any(r[3] for r in brute(rows, 10))


def test_nulls_blanks_copies_and_long_texts(spark):
    rows = [(i, "menu\n\nmenu\n" + f"text {i}", f"s{i}") for i in range(12)]
    rows += [(None, "menu\nx", "s1"), (50, None, "s1"), (51, "", "s2"), (52, "menu", None), (53, "\n \n", "s3"), (54, "menu\n" * 20000, "s4")]
    rows += [(0, "menu\n\nmenu\ntext 0", "s0")]
    got = run(spark, rows)
    assert got == brute(rows, 10)
    assert (0, "menu\n\ntext 0", 4, 1) in got and (3, "\ntext 3", 4, 2) in got and (52, "", 1, 1) in got


def test_empty_table(spark):
    assert run(spark, []) == []


def test_time_grows_with_lines_where_all_are_boilerplate(spark):
    lines = [f"menu {k}" for k in range(50_000)]
    rows = [(d, "\n".join(lines[d:] + [f"own {d}"]), f"s{d}") for d in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    began = time.perf_counter()
    out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert time.perf_counter() - began < 60
    assert out[0] == (rows[0][1], 0) and out[5] == ("menu 5\nmenu 6\nmenu 7\nmenu 8\nown 5", 50_000 - 9) and out[11] == ("own 11", 50_000 - 11)


def test_texts_of_one_id_lose_their_own_lines(spark):
    rows = [(i, f"menu\ntext {i}", f"s{i}") for i in range(12)] + [(5, "other\nmenu\nmenu", "s5"), (5, "menu", "s5"), (5, "menu", "s5")]
    assert run(spark, rows) == brute(rows, 10)
