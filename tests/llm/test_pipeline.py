from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from boxloom.llm import decontam, entry, license_scan
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def small(spark, tmp_path):
    rng = random.Random(6)
    words = "the and of river stone light where people walk under trees every morning with quiet hope again".split()
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    item = say(30)
    docs = []
    for i in range(260):
        text = f"{say(40)}\n{say(30)}"
        if i % 5 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split(" "))
        elif i % 11 == 0:
            text += "\nshared footer line of the sites"
        docs.append((i, text, "en", f"s{i % 13}", len(text)))
    docs += [(300 + i, docs[i][1], "en", "s1", docs[i][4]) for i in (1, 2, 3)]
    docs += [(310, f"{say(5)} {item} {say(5)}", "en", "s2", 1), (311, f"{item} {say(2000)}", "en", "s2", 1)]
    docs += [(320, None, None, None, None), (321, "", "en", "s3", 0), (None, say(50), "en", "s4", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return {d[0]: d for d in docs}


def test_every_stage_decides_and_keeps_columns(spark, tmp_path):
    rows = small(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()} if at < 4 else None
        docs = stage(spark, docs, str(tmp_path))
        if at < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
            if name == "quality":
                assert not any(i is not None and i < 260 and i % 5 == 0 for i in kept[name]) and len(kept[name]) > 200
            elif name == "line_dedup":
                assert kept[name].keys() == before.keys()
                footers = [i for i, t in kept[name].items() if t and "shared footer" in t]
                assert footers == [min(i for i, t in before.items() if t and i is not None and "shared footer" in t)]
            elif name == "simhash":
                ids = [i for i in before if i is not None]
                root = brute_components(ids, [brute_print(before[i]) for i in ids])
                assert sorted(i for i in kept[name] if i is not None) == sorted({*root.values()})
            else:
                assert before.keys() - kept[name].keys() == {310}
    out = docs.collect()
    assert {r.doc_id for r in out} == kept["decontaminate"].keys()
    assert sum(r.n_tokens for r in out) == sum(len((t or "").encode()) + 1 for t in kept["decontaminate"].values())


def test_run_equals_its_stages_and_takes_empty_tables(spark, tmp_path):
    small(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = ["doc_id", "piece", "bin_id", "bin_offset"]
    assert sorted(map(str, docs.select(*key).collect())) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select(*key).collect()))
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


CLASHES = "n_lines n_removed kept drop_at line k1 k2 first pos fp rep component_id gone_id bad_id hit_at h gram start p w score predicted q half held_out lang_pred piece bin_id all grp row_key folder up licence how".split()
CLASHES += "_lines _n _drop_id _drop_key _drop_at _gone_id _gone_key _bad_id _bad_key _hit_id _hit_key _hit_at _own_score _own_predicted __hit_at".split()


def test_extra_columns_of_any_name_pass_through(spark, tmp_path):
    small(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(name), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(name) for name in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        row = out.where("doc_id = 1").first()
        assert all(row[c] == f"{c}1" for c in CLASHES), name
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() >= docs.count()
    cut = decontam.cut_spans(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert cut.columns == docs.columns and all(cut.where("doc_id = 1").first()[c] == f"{c}1" for c in CLASHES)
    files = docs.withColumn("path", F.col("doc_id").cast("string"))
    kept = license_scan.scan(files, F.lit(True)).where("doc_id = 1").first()
    assert all(kept[c] == f"{c}1" for c in CLASHES if c not in ("licence", "how", "score"))


def test_every_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in entry.QUERIES)
    assert numbers == list(range(1, 14))
