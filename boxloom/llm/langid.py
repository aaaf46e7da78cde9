"""Language ID by a byte convolutional network in numpy.

Texts are cut into windows of WINDOW bytes. Filters of several widths run over the bytes of a window; each
keeps its maximum, and a softmax layer turns the maxima into probabilities. A text's probabilities are the
mean of its windows', weighted by their length. As bytes are few, a filter is a sum of one table row for each
of its places, so a convolution is some look-ups and additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.shared import crc_bucket
from boxloom.sources.durable import durable

UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
#: Bytes of a window, and of the shorter windows it is trained on.
WINDOW, TRAIN_WINDOW = 256, 64
#: Widths of filters, and filters of each width.
WIDTHS, FILTERS = (2, 3, 4), 10
#: Labelled texts that are learned from at most, by language, and windows taken of each.
TRAIN_ROWS, TRAIN_CUTS = 1500, 4
EPOCHS, BATCH, RATE = 5, 128, 0.01
#: Windows that are scored at once.
SCORED = 256


@dataclass
class Network:
    """Tables (place, byte, filter), filter offsets, and the softmax layer."""

    langs: list[str]
    tables: list[np.ndarray]
    shift: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.shift, self.weight, self.bias]


def new_network(langs: list[str], seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    tables = [(rng.standard_normal((w, 256, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
    total = FILTERS * len(WIDTHS)
    return Network(langs, tables, np.zeros(total, np.float32), (rng.standard_normal((total, len(langs))) * 0.1).astype(np.float32), np.zeros(len(langs), np.float32))


def convolve(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima (rows, filters) over the places of each row of bytes ``x``, and the places of the maxima."""
    best, place = [], []
    for table in net.tables:
        w = len(table)
        n = x.shape[1] - w + 1
        act = table[0][x[:, :n]]
        for k in range(1, w):
            act += table[k][x[:, k : k + n]]
        at = act.argmax(axis=1)
        place.append(at)
        best.append(np.take_along_axis(act, at[:, None, :], axis=1)[:, 0])
    return np.concatenate(best, axis=1), np.concatenate(place, axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(net: Network, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(top + net.shift, 0)
    return hidden, softmax(hidden @ net.weight + net.bias)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 0) -> Network:
    """Train on rows of bytes ``x`` with classes ``y`` by Adam on the cross-entropy."""
    net, rng = new_network(langs, seed), np.random.default_rng(seed + 1)
    params = net.parameters()
    mean, var, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = np.bincount(y, minlength=len(langs))
    balance = (len(y) / (len(langs) * np.maximum(1, share)))[y].astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            bx = x[rows]
            top, place = convolve(net, bx)
            hidden, prob = forward(net, top)
            err = prob.copy()
            err[np.arange(len(rows)), y[rows]] -= 1
            err *= balance[rows, None] / len(rows)
            back = (err @ net.weight.T) * (hidden > 0)
            grads, col = [], 0
            for table in net.tables:
                g = np.zeros_like(table)
                part, places = back[:, col : col + FILTERS], place[:, col : col + FILTERS]
                for k in range(len(table)):
                    np.add.at(g[k], (np.take_along_axis(bx, places + k, axis=1), np.arange(FILTERS)[None, :]), part)
                grads.append(g)
                col += FILTERS
            grads += [back.sum(axis=0), hidden.T @ err, err.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, mean, var):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cut_windows(text: bytes, size: int) -> np.ndarray:
    """``text`` as rows of ``size`` bytes; the last is padded with zeros."""
    n = max(1, -(-len(text) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, size)


def train(docs: DataFrame) -> Network | None:
    """A network from the rows with a language outside the held-out fold; None without any.

    Learns from at most TRAIN_ROWS texts of each language, those whose ids hash lowest, and TRAIN_CUTS windows
    of each at places that the hash picks, whatever the size of the table. The texts are chosen by id alone,
    so that only a table of bounded size travels to them; of rows that repeat an id the least text counts,
    and the least language.
    """
    good = docs.where("text is not null and lang is not null and doc_id is not null").where(crc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT)
    ids = good.groupBy("doc_id").agg(F.min("lang").alias("known_lang")).withColumn("h", F.xxhash64("doc_id"))
    langs = sorted(r.known_lang for r in ids.select("known_lang").distinct().collect())
    chosen = None
    for lang in langs:
        some = ids.where(F.col("known_lang") == lang).orderBy("h", "doc_id").limit(TRAIN_ROWS)
        chosen = some if chosen is None else chosen.union(some)
    if chosen is None:
        return None
    chosen = durable(chosen)
    texts = good.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "known_lang", "h").agg(F.min("text").cast("binary").alias("text"))

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, part = [], []
            for name, text, h in zip(b["known_lang"], b["text"], b["h"]):
                rows = cut_windows(bytes(text), TRAIN_WINDOW)
                picked = np.random.default_rng(h & 0xFFFFFFFF).permutation(len(rows))[:TRAIN_CUTS]
                part += [rows[k].tobytes() for k in sorted(picked)]
                lang += [name] * len(picked)
            yield pd.DataFrame({"lang": lang, "part": part})

    got = sorted((r.lang, bytes(r.part)) for r in texts.mapInPandas(cuts, "lang string, part binary").collect())
    if not got:
        return None
    x = np.stack([np.frombuffer(part, np.uint8) for _, part in got])
    return fit(x, np.array([langs.index(lang) for lang, _ in got]), langs)


class Scorer:
    """Applies a network to many windows at little cost.

    The widest tables are joined by pairs of bytes, so that each place of a window takes two look-ups.
    """

    def __init__(self, net: Network):
        self.net, wide = net, max(WIDTHS)
        total = FILTERS * len(WIDTHS)
        place = np.zeros((wide + wide % 2, 256, total), np.float32)
        for k, table in enumerate(net.tables):
            place[: len(table), :, k * FILTERS : (k + 1) * FILTERS] = table
        self.pairs = [(place[k][:, None, :] + place[k + 1][None, :, :]).reshape(65536, total) for k in range(0, len(place), 2)]

    def tops(self, x: np.ndarray) -> np.ndarray:
        """Maxima of every filter over the rows of ``x``; rows end in at least max(WIDTHS) - 1 spare bytes."""
        out = np.empty((len(x), self.pairs[0].shape[1]), np.float32)
        for at in range(0, len(x), 8):
            part = x[at : at + 8].astype(np.int32)
            code = part[:, :-1] * 256 + part[:, 1:]
            n = code.shape[1] - 2 * (len(self.pairs) - 1)
            act = np.take(self.pairs[0], code[:, :n], axis=0)
            for k, table in enumerate(self.pairs[1:], 1):
                act += np.take(table, code[:, 2 * k : 2 * k + n], axis=0)
            out[at : at + 8] = act.max(axis=1)
        return out

    def windows(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Rows of WINDOW bytes and the spare ones that follow them, and their lengths."""
        spare = max(WIDTHS)
        n = max(1, -(-len(text) // WINDOW))
        held = np.zeros(n * WINDOW + spare, np.uint8)
        held[: len(text)] = np.frombuffer(text, np.uint8)
        rows = np.lib.stride_tricks.as_strided(held, (n, WINDOW + spare), (WINDOW, 1))
        return rows, np.minimum(WINDOW, np.maximum(1, len(text) - WINDOW * np.arange(n)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities (texts, languages)."""
        prob = np.zeros((len(texts), len(self.net.langs)))
        rows, lengths, owner = [], [], []

        def flush() -> None:
            if rows:
                p = forward(self.net, self.tops(np.concatenate(rows)))[1] * np.concatenate(lengths)[:, None]
                np.add.at(prob, np.concatenate(owner), p)
                rows.clear(), lengths.clear(), owner.clear()

        held = 0
        for k, text in enumerate(texts):
            r, n = self.windows(text)
            for at in range(0, len(r), SCORED):
                rows.append(r[at : at + SCORED])
                lengths.append(n[at : at + SCORED])
                owner.append(np.full(len(rows[-1]), k))
                held += len(rows[-1])
                if held >= SCORED:
                    flush()
                    held = 0
        flush()
        return prob / np.maximum(1e-12, prob.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; ``und`` and 0 where the text is null or has no letter."""
    texts = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("binary")).alias("text"))
    if net is None:
        return texts.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prob = scorer.score([t or b"" for t in texts])
            best = prob.argmax(axis=1)
            names = [UNKNOWN if t is None else net.langs[b] for t, b in zip(texts, best)]
            sure = [0.0 if t is None else float(p[b]) for t, p, b in zip(texts, prob, best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; a null doc_id is not held out."""
    held = F.coalesce(crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
