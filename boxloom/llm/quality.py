"""Quality classifier by compression.

zstandard dictionaries are built from good and from bad labelled text. Every window of a text is compressed
with each. The difference of the compressed sizes in all, over the text's own size, is what tells good from
bad; the size by the good dictionary, over the same, tells text that repeats itself, which either dictionary
fits alike. A logistic curve of both, fitted on further labelled texts, turns them into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.shared import crc_bucket, fresh
from boxloom.sources.durable import durable

#: A text is good if its score is at least this.
ACCEPT = 0.3
FOLDS, HELD_OUT = 5, 0
#: Bytes of a window, and how many windows a dictionary is built from at most: so many in all, of one text.
WINDOW, DICT_WINDOWS, TEXT_WINDOWS = 512, 6000, 8
#: Bytes of a dictionary, and labelled texts, by class, that dictionaries and curve are fitted on at most, each.
DICT_BYTES, FIT_ROWS = 112 * 1024, 1500
LEVEL = 3
#: Pull of the curve's coefficients to zero.
RIDGE = 1e-3


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text, and the curve: features' centres and scales, intercept and slopes."""

    good: bytes
    bad: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    intercept: float
    slope: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features."""
        z = self.intercept + (x - np.array(self.centre)) / np.array(self.scale) @ np.array(self.slope)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def windows_of(text: bytes) -> list[bytes]:
    """``text`` cut into windows; the last may be short, and an empty text has none."""
    return [text[i : i + WINDOW] for i in range(0, len(text), WINDOW)]


class Sizer:
    """Compresses with both dictionaries of a model."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (self._compressor(x) for x in (good, bad))

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        words = zstandard.ZstdCompressionDict(data)
        words.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, text: bytes) -> tuple[float, float]:
        """By byte of ``text``: how many bytes less good words take than bad ones, and how many they take."""
        good = bad = 0
        for w in windows_of(text):
            good += len(self.good.compress(w))
            bad += len(self.bad.compress(w))
        return ((bad - good) / len(text), good / len(text)) if text else (0.0, 0.0)


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of DICT_BYTES at most; from too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 2), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICT_BYTES]


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[tuple, tuple, float, tuple]:
    """Centres, scales, intercept and slopes of a logistic curve of ``y`` on the columns of ``x``, by Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.concatenate([np.ones((len(x), 1)), (x - centre) / scale], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w)), z.T @ (y - p) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(centre.tolist()), tuple(scale.tolist()), float(w[0]), tuple(w[1:].tolist())


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled rows outside the held-out fold; None unless both classes are there.

    Learns from at most FIT_ROWS texts of each class for the dictionaries and as many for the curve, those
    whose ids hash lowest, whatever the size of the tables. They are chosen by id alone, so that only the
    chosen ids, a table of bounded size, travel to the texts. Null texts, labels and ids, and documents with
    contradicting labels are left out; of rows that repeat an id the least text counts.
    """
    said = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    there = docs.where("text is not null and text <> ''").select("doc_id").where(crc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT).distinct()
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    known = said.join(there, "doc_id").select("doc_id", "q", half.alias("half"), F.xxhash64("doc_id", F.lit(1)).alias("h"))
    chosen = None
    for q in (0, 1):
        for k in (0, 1):
            some = known.where((F.col("q") == q) & (F.col("half") == k)).orderBy("h", "doc_id").limit(FIT_ROWS)
            chosen = some if chosen is None else chosen.union(some)
    chosen = durable(chosen)
    texts = docs.where("text is not null and text <> ''").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = durable(texts.groupBy("doc_id", "q", "half", "h").agg(F.min("text").cast("binary").alias("text")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, text, h in zip(b["q"], b["text"], b["h"]):
                parts = windows_of(bytes(text))
                at = np.sort(np.random.default_rng(h & 0xFFFFFFFF).permutation(len(parts))[:TEXT_WINDOWS])
                yield pd.DataFrame({"q": q, "h": h, "at": at, "w": [parts[k] for k in at]})

    picked = texts.where("half = 0").mapInPandas(cut, "q int, h long, at int, w binary").withColumn("o", F.xxhash64("h", "at"))
    parts: dict[int, list[bytes]] = {}
    for q in (0, 1):
        rows = picked.where(F.col("q") == q).orderBy("o", "w").limit(DICT_WINDOWS).select("w").collect()
        parts[q] = [bytes(r.w) for r in rows]
    if not parts[0] or not parts[1]:
        return None
    good, bad = (build_dictionary(parts[q]) for q in (1, 0))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizer = Sizer(good, bad)
        for b in batches:
            x = [sizer.features(bytes(t)) for t in b["text"]]
            yield pd.DataFrame({"q": b["q"], "less": [v[0] for v in x], "size": [v[1] for v in x]})

    fit = texts.where("half = 1").select("q", "text").mapInPandas(features, "q int, less double, size double").collect()
    fit.sort()
    x, y = np.array([(r.less, r.size) for r in fit]).reshape(-1, 2), np.array([float(r.q) for r in fit])
    if len(set(y)) < 2:
        return None
    # The classes are sampled apart: their true shares move the curve back.
    share = {r.q: r["count"] for r in known.where("half = 1").groupBy("q").count().collect()}
    centre, scale, intercept, slope = fit_curve(x, y)
    intercept += math.log(share[1] / share[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, centre, scale, intercept, slope)


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (doc_id, text and others) with score (double, 0 to 1) and predicted (int).

    Null and empty texts get the score of features of zero. Without a model every score is 0.5.
    """
    if model is None:
        return docs.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = Sizer(model.good, model.bad)
        for batch in texts:
            x = np.array([sizer.features(bytes(t)) if t is not None else (0.0, 0.0) for t in batch])
            yield pd.Series(model.score(x.reshape(-1, 2)))

    return docs.withColumn("score", score(F.col("text").cast("binary"))).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; a null doc_id is not held out."""
    held = F.coalesce(crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; same columns."""
    hidden = dict(zip(("score", "predicted"), fresh(docs, "own_score", "own_predicted")))
    renamed = {c: hidden[c.lower()] for c in docs.columns if c.lower() in hidden}
    scored = score_documents(docs.withColumnsRenamed(renamed), train(docs, labels))
    return scored.where("predicted = 1").select(*[F.col(renamed.get(c, c)).alias(c) for c in docs.columns])
