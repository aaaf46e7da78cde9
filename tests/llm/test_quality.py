from __future__ import annotations

import random
import zlib

import numpy as np

from boxloom.llm import quality as q

WORDS = "the and of river stone light where people walk under trees every morning with quiet hope".split()


def table(spark, n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 200))]
        docs.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), 0.5, "x"))
        if i % 4:
            labels.append((i, int(good), 0))
    docs += [(n, None, 0.1, "x"), (n + 1, "", 0.1, "x"), (None, "the river and the stone", 0.1, "x"), (5, docs[5][1], 0.1, "x"), (n + 2, " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(40000)), 0.1, "x")]
    labels += [(None, 1, 0), (7, None, 0), (8, 0, 0), (8, 1, 0), (10, 5, 0), (1, 1, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score double, predicted string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        docs,
    )


def test_held_out_accuracy_and_whole_query(spark):
    docs, labels, rows = table(spark)
    out = q.classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= q.ACCEPT)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert len(held) > 50 and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.97
    by = {r.doc_id: r.score for r in out}
    assert by[400] == by[401] and by[402] < 0.3
    assert len({r.score for r in out if r.doc_id == 5}) == 1


def test_scores_do_not_depend_on_what_is_no_input(spark):
    docs, labels, rows = table(spark, 200)
    other = spark.createDataFrame([(r[0], r[1], 9.9, "y") for r in rows], docs.schema).repartition(7)
    a, b = (sorted((str(r.doc_id), round(r.score, 12)) for r in q.classify(d, labels).collect()) for d in (docs, other))
    assert a == b


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels, _ = table(spark, 200)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert q.train(docs, labels) == q.train(docs, flipped)


def test_keeping_good_rows_and_columns(spark):
    docs, labels, rows = table(spark)
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len({i for i in range(400) if i % 3 > 0} - ids) <= 2 and len({i for i in range(400) if i % 3 == 0} & ids) <= 2


def test_without_labels_or_documents(spark):
    docs, labels, rows = table(spark, 50)
    none = q.classify(docs, labels.where("false")).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5}
    assert q.classify(docs, labels.where("quality = 1")).count() == len(rows)
    assert q.classify(docs.where("false"), labels).collect() == []
    assert q.keep_good(docs, labels.where("false")).count() == len(rows)


def test_features_are_sums_over_all_windows():
    s = q.Sizer(b"good words " * 100, b"BAD!! WORDS!! " * 100)
    text = b"good words " * 300 + b"BAD!! WORDS!! " * 300
    parts = q.windows_of(text)
    assert b"".join(parts) == text and max(map(len, parts)) == q.WINDOW
    good, bad = (sum(len(c.compress(w)) for w in parts) for c in (s.good, s.bad))
    assert s.features(text) == ((bad - good) / len(text), good / len(text)) and s.features(b"") == (0, 0)
    assert s.features(b"good words " * 50)[0] > 0 > s.features(b"BAD!! WORDS!! " * 50)[0]


def test_curve_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20000, 2))
    y = (rng.random(20000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - 0.7 * x[:, 1])))).astype(float)
    centre, scale, b, w = q.fit_curve(x, y)
    slope = np.array(w) / np.array(scale)
    assert np.allclose(slope, [1.5, -0.7], atol=0.1) and abs(b - slope @ np.array(centre) - 0.5) < 0.1
    score = q.Model(b"", b"", centre, scale, b, w).score(x)
    for low in (0.1, 0.3, 0.5, 0.7):
        near = (score >= low) & (score < low + 0.2)
        assert abs(y[near].mean() - score[near].mean()) < 0.03
