"""Token counts of whole texts under a sentencepiece model, without tokens.

A text falls into pre-tokens that the model's merges never cross, so that its count is the sum of theirs. Lengths
of frequent pre-tokens are broadcast in a compact table; a pre-token that it lacks is encoded by the library, and
its length kept in a cache that lives as long as the Python worker. No pre-token is shuffled: what travels are
bounded summaries, one of each task, from which the table is chosen.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from boxloom.llm.shared import fresh

#: A text of more tokens is over the limit.
LIMIT = 4096
#: Entries of the broadcast table, and of each task's summary; characters of a pre-token that either holds.
TABLE, SUMMARY, LONGEST = 16_384, 4_096, 64
#: Pre-tokens that a worker's cache holds.
CACHE = 131_072
#: Characters of a text that are cut at a time.
PART = 1 << 20

SPACE = "▁"


@dataclass(frozen=True)
class Cutter:
    """How texts are cut for one model: before runs of spaces and, if ``newline``, before newlines."""

    newline: bool

    def parts(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text that is not empty, by parts of about PART characters."""
        find, begin = _pattern(self.newline)
        text = " " + text
        start = 0
        while start < len(text):
            cut = begin.search(text, start + PART) if len(text) - start > PART else None
            end = cut.start() if cut else len(text)
            yield find.findall(text, start, end)
            start = end


@functools.cache
def _pattern(newline: bool) -> tuple[re.Pattern, re.Pattern]:
    """What finds pre-tokens, and what finds the places where one begins."""
    if newline:
        return re.compile(f"[ {SPACE}]+[^ {SPACE}\n]*|\n[^ {SPACE}\n]*"), re.compile(f"(?<![ {SPACE}])[ {SPACE}]|\n")
    return re.compile(f"[ {SPACE}]+[^ {SPACE}]*"), re.compile(f"(?<![ {SPACE}])[ {SPACE}]")


def cutter(model: bytes) -> Cutter:
    """The cutter of a model; an error for a model whose merges could cross its cuts.

    That takes a model of the BPE kind that leaves texts as they are but for a space put before, and no piece
    with a space after another character. Newlines part pre-tokens if no piece but their byte holds one.
    """
    proto = model_pb2.ModelProto()
    proto.ParseFromString(model)
    norm, kinds = proto.normalizer_spec, model_pb2.ModelProto.SentencePiece
    usual = (
        proto.trainer_spec.model_type == model_pb2.TrainerSpec.BPE
        and proto.trainer_spec.byte_fallback
        and not proto.trainer_spec.treat_whitespace_as_suffix
        and not norm.precompiled_charsmap
        and norm.add_dummy_prefix
        and norm.escape_whitespaces
        and not norm.remove_extra_whitespaces
    )
    pieces = [p.piece for p in proto.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)]
    custom = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)
    if not usual or custom or SPACE not in pieces or any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("token counts need a BPE model with byte fallback whose pieces hold spaces at their start only")
    return Cutter(newline=not any("\n" in p for p in pieces))


class Encoder:
    """Lengths of pre-tokens by the library itself."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)

    def length(self, piece: str) -> int:
        """Tokens of one pre-token. The library puts a space of its own before every text."""
        if piece[0] == "\n":
            return len(self.model.encode(piece, num_threads=1)) - 1
        return len(self.model.encode(piece[1:], num_threads=1)) if len(piece) > 1 else 1


class Lengths(dict):
    """The broadcast table; what it lacks is asked of the worker's cache, or encoded where it is too long to keep."""

    def __init__(self, table: dict[str, int], encoder: Encoder, size: int = CACHE):
        super().__init__(table)
        self.encode = encoder.length
        self.cached = functools.lru_cache(size)(encoder.length)

    def __missing__(self, piece: str) -> int:
        return self.cached(piece) if len(piece) <= LONGEST else self.encode(piece)


def tokens(text: str, cut: Cutter, lengths: dict[str, int]) -> int:
    """Tokens of one text by the lengths of its pre-tokens."""
    return sum(sum(map(lengths.__getitem__, part)) for part in cut.parts(text)) if text else 0


#: Cutter, table and cache of the call that this Python worker has served last, by the call's key.
_WORKER: dict[int, tuple[Cutter, Lengths]] = {}


def _worker(shared) -> tuple[Cutter, Lengths]:
    key = shared.value["key"]
    if key not in _WORKER:
        _WORKER.clear()
        model = shared.value["model"]
        _WORKER[key] = cutter(model), Lengths(shared.value["table"], Encoder(model))
    return _WORKER[key]


def summary(counts: Counter, size: int) -> Counter:
    """The ``size`` most frequent entries, each less the count of the next: a summary that errs by that at most."""
    if len(counts) <= size:
        return counts
    top = counts.most_common(size + 1)
    least = top[-1][1]
    return Counter({piece: n - least for piece, n in top[:-1] if n > least})


def frequent(docs: DataFrame, cut: Cutter, size: int = TABLE, per_task: int = SUMMARY) -> list[str]:
    """The most frequent pre-tokens of all texts, at most ``size``, by summaries of at most ``per_task`` entries a task."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for part in cut.parts(text.as_py()):
                    counts.update(part)
                    if len(counts) > 16 * per_task:
                        counts = summary(Counter({p: n for p, n in counts.items() if len(p) <= LONGEST}), per_task)
        top = summary(Counter({p: n for p, n in counts.items() if len(p) <= LONGEST}), per_task)
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.string()), pa.array(list(top.values()), pa.int64())], ["piece", "n"])

    seen = docs.where("text <> ''").select("text").mapInArrow(summarise, "piece string, n long")
    top = seen.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    return [r.piece for r in top.collect()]


def count_tokens(docs: DataFrame, model_file: str, limit: int = LIMIT, table: int = TABLE) -> DataFrame:
    """``docs`` with n_bytes, n_tokens (long) and over_limit (boolean, more than ``limit`` tokens).

    Tokens are those of the whole text as the library encodes it: no begin, end or other added tokens, and the
    names of special tokens are ordinary text. Every row comes back with its other columns; its own columns of
    those names give way. A null text counts as an empty one, of no tokens. The model is read where this is
    called and travels to the workers; texts stay where they are. The table changes no count.
    """
    with open(model_file, "rb") as f:
        model = f.read()
    cut, encoder = cutter(model), Encoder(model)
    lengths = {piece: encoder.length(piece) for piece in frequent(docs, cut, table)} if table else {}
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast({"key": hash((model, tuple(lengths))), "model": model, "table": lengths})

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut, lengths = _worker(shared)
        for texts in batches:
            yield pa.array([tokens(text.as_py(), cut, lengths) for text in texts], pa.int64())

    own = ("n_bytes", "n_tokens", "over_limit")
    kept = [F.col(c) for c in docs.columns if c.lower() not in own]
    (n_,) = fresh(docs, "n")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn(n_, count(text))
    return rows.select(*kept, F.octet_length(text).cast("long").alias("n_bytes"), F.col(n_).alias("n_tokens"), (F.col(n_) > limit).alias("over_limit"))
