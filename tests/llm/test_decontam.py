from __future__ import annotations

import hashlib
import random
import re

from boxloom.llm import decontam


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def brute(docs, items):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            b = words(body)
            n = min(13, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, gram string, pos int"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def cases():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "ÉTÉ", "été", "x9"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, " .,"), (93, "Single"), (94, items[3][1]), (95, "two Words")]
    docs = [(None, "w1 w2"), (1, None), (2, ""), (3, "!!!"), (4, "SINGLE"), (5, "a two; words b"), (6, "two\nwords " * 3)]
    for d in range(10, 80):
        parts = [rng.choice(vocab) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(0, 3)):
            w = words(items[rng.randrange(25)][1])
            at = rng.randrange(len(w))
            parts.insert(rng.randrange(len(parts) + 1), " ".join(w[at : at + 20]).upper().replace("ÉTÉ", "Été") + " ")
        docs.append((d, "".join(parts)))
    docs += [docs[-1], (docs[-2][0], "another text"), (200, "filler " * 50000 + items[0][1])]
    return docs, items


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()], key=str)


def test_against_brute_force(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    want = brute(docs, items)
    assert got(decontam.judge(d, b)) == want
    assert sum(r[5] for r in want) > 10 and sum(not r[5] for r in want) > 5


def test_only_long_items_and_shuffled_join(spark, monkeypatch):
    docs, items = cases()
    items = [(i, t) for i, t in items if len(words(t)) >= 13]
    d, b = frames(spark, docs, items)
    assert got(decontam.judge(d, b)) == brute(docs, items)
    monkeypatch.setattr(decontam, "MAX_BROADCAST_BYTES", -1)
    docs, items = cases()
    d, b = frames(spark, docs, items)
    assert got(decontam.judge(d, b)) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    assert got(decontam.judge(d, b.where("false"))) == brute(docs, [])
    assert got(decontam.judge(d.where("false"), b)) == []


def test_dropping_and_cutting(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    bad = {(r[0], r[1]) for r in brute(docs, items) if r[5]}
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([i for i, t in docs if (i, len(words(t))) not in bad], key=str)
    cut = {r.doc_id: r.text for r in decontam.cut_spans(d, b).where("doc_id < 10").collect()}
    assert cut == {1: None, 2: "", 3: "!!!", 4: "", 5: "a b", 6: ""}


def test_no_python_on_the_main_path(spark):
    docs, items = cases()
    hits, _ = decontam.find_hits(*frames(spark, docs, items))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
