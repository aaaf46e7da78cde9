from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from boxloom.llm import entry, token_count
from tests.oracle import SF_DIR

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", "The ", " a", "  ", "\n", "\n\n", "\r\n", ");\r", "\t", "▁", "▁▁x", "é", "日本語", "語", "🙂", "\U0010ffff", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "{", "}", "=", "1234", "thntreor", " ", " ", "ing", "    ", "."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(seed, count, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(0, most))) for _ in range(count)]


def model_bytes():
    with open(MODEL, "rb") as f:
        return f.read()


def test_pre_tokens_add_up_to_the_library(library):
    model = model_bytes()
    cut, lengths = token_count.cutter(model), token_count.Lengths({}, token_count.Encoder(model), 50)
    assert cut.newline
    for text in odd_texts(1, 3000) + ["", " ", "  ", "\n", " \n ", "a ", " a", "▁", "\n▁"]:
        assert token_count.tokens(text, cut, lengths) == len(library.encode(text)), repr(text)
        assert text == "" or "".join(sum(cut.parts(text), [])) == " " + text
    assert len(lengths) == 0 and lengths.cached.cache_info().currsize == 50


def test_texts_are_cut_between_pre_tokens(library, monkeypatch):
    monkeypatch.setattr(token_count, "PART", 7)
    model = model_bytes()
    cut, lengths = token_count.cutter(model), token_count.Lengths({}, token_count.Encoder(model))
    for text in odd_texts(2, 500):
        assert token_count.tokens(text, cut, lengths) == len(library.encode(text)), repr(text)


def test_whole_rows(spark, library):
    rows = list(enumerate(odd_texts(3, 300))) + [(None, None), (None, "null id"), (5, "a repeated id"), (5, "a repeated id"), (900, ""), (901, None)]
    rows += [(902, "long words of a text " * 60_000), (903, "x" * 5000), (904, "日本語" * 3000), (905, "\n" * 4097), (906, "\n" * 4095)]
    docs = spark.createDataFrame([(d, t, -1, "c", 5) for d, t in rows], "doc_id long, text string, N_Tokens int, _n string, n int")
    for table in (0, 100, token_count.TABLE):
        out = token_count.count_tokens(docs, MODEL, table=table)
        assert out.columns == ["doc_id", "text", "_n", "n", "n_bytes", "n_tokens", "over_limit"]
        got = sorted(((r.doc_id, r.text, r._n, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()), key=str)
        size = {t: len(library.encode(t or "")) for _, t in rows}
        assert got == sorted(((d, t, "c", len((t or "").encode()), size[t], size[t] > 4096) for d, t in rows), key=str)
    assert size["\n" * 4097] == 4098 and size["\n" * 4095] == 4096
    assert token_count.count_tokens(docs.limit(0), MODEL).collect() == []


def test_the_query_against_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in entry.QUERIES["op13_token_count"](spark, SF_DIR).collect()}
    counts = dict(zip(texts, map(len, library.encode(list(texts.values())))))
    assert got == {d: (len(t.encode()), counts[d], counts[d] > 4096) for d, t in texts.items()}
    assert any(over for _, _, over in got.values())


def test_frequent_pre_tokens_come_from_all_texts(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(3000)], k=400)) for _ in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    cut = token_count.cutter(model_bytes())
    got = token_count.frequent(docs, cut, 50, 500)
    exact = Counter(p for t in texts for p in sum(cut.parts(t), []))
    assert len(got) == 50 and {p for p, _ in exact.most_common(30)} <= set(got)


def test_a_summary_errs_by_a_bound():
    rng = random.Random(5)
    counts = Counter(int(rng.paretovariate(0.7)) for _ in range(20_000))
    some = token_count.summary(counts, 40)
    assert len(some) <= 40 and all(0 <= counts[p] - n <= 20_000 / 41 for p, n in some.items())
    assert token_count.summary(counts, 10**6) == counts


@pytest.mark.parametrize("change", ["unigram", "normalised", "inner space", "custom"])
def test_models_whose_merges_could_cross_cuts_are_refused(change):
    proto = model_pb2.ModelProto()
    proto.ParseFromString(model_bytes())
    if change == "unigram":
        proto.trainer_spec.model_type = model_pb2.TrainerSpec.UNIGRAM
    elif change == "normalised":
        proto.normalizer_spec.remove_extra_whitespaces = True
    elif change == "inner space":
        proto.pieces.add(piece="a▁b", score=-1.0)
    else:
        proto.pieces.add(piece="own", score=0.0, type=model_pb2.ModelProto.SentencePiece.USER_DEFINED)
    with pytest.raises(ValueError):
        token_count.cutter(proto.SerializeToString())
