"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

A text's n-gram indicators are scaled by their class log-count ratios, and a linear model with
hinge loss is fitted to them by dual coordinate descent (Hsieh et al., 2008). N-grams are taken
of words and of word shapes, hashed into a table of fixed size, so the model is bounded whatever
the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questline.llm.common import learnable, smallest, words_of
from questline.llm.model_text import cached, mix, slot

BITS = 18            # slots of the n-gram table
FIT_ROWS = 6000      # labelled texts, at most, that the hinge loss is fitted to, half of each class
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 12
BLEND = 0.25         # share of the plain naive Bayes weights, as the paper interpolates

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_DIGITS = re.compile(rb"[0-9]+")


@dataclass(frozen=True)
class Model:
    """A weight and a log-count ratio a slot (2^18 floats each), bias, sigmoid's slope and offset."""

    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float


def _feature(word: bytes) -> tuple[int, int]:
    low = word.lower()
    shape = _DIGITS.sub(b"9", _LETTERS.sub(b"a", low))
    return slot(b"w" + low, 30), slot(b"s" + shape, 30)


def _grams(text: str | None, of) -> np.ndarray:
    """Sorted distinct slots of a text's n-grams: words 1 and 2, shapes 1 to 3, repetition."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.int64)
    w, s = np.array(of(words), dtype=np.int64).T
    # A word that also stands just before, or up to three places before, is marked.
    again = np.zeros(len(w), dtype=np.int64)
    for lag in (3, 2, 1):
        again[lag:][w[lag:] == w[:-lag]] = lag
    parts = [mix(w, bits=BITS), mix(s, s * 0 + 1, bits=BITS), mix(again, again * 0 + 2, bits=BITS)]
    for n, x in ((2, w), (2, s), (3, s), (3, again)):
        if len(x) >= n:
            parts.append(mix(*(x[i:len(x) - n + 1 + i] for i in range(n)), bits=BITS))
    return np.unique(np.concatenate(parts))


def _presence(rows: DataFrame) -> DataFrame:
    """``slot, bad, good``: texts of each class that hold an n-gram; slot -1 counts the texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = cached(_feature)
        sums = np.zeros((2, (1 << BITS) + 1), dtype=np.int64)
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                sums[y, _grams(text, of)] += 1
                sums[y, -1] += 1
        used = np.flatnonzero(sums.any(0))
        yield pd.DataFrame({"slot": np.where(used == 1 << BITS, -1, used), "bad": sums[0, used], "good": sums[1, used]})

    return rows.select("text", "y").mapInPandas(count, "slot long, bad long, good long").groupBy("slot").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )


def _fit_rows(docs: DataFrame, rows: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Label and n-gram slots of a bounded sample: half of FIT_ROWS a class, by lowest hash.

    The sample is chosen on ids and labels; at most FIT_ROWS of these are broadcast to fetch texts.
    """

    @F.pandas_udf("array<int>")
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = cached(_feature)
        for texts in batches:
            yield pd.Series([_grams(text, of).astype(np.int32) for text in texts], dtype=object)

    chosen = [smallest(rows.filter(F.col("y") == y).select("doc_id", "y"), "doc_id", FIT_ROWS // 2) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).distinct())
    # A text that stands several times under one id is taken once.
    one = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    got = one.select("doc_id", "y", grams("text").alias("g")).toPandas().sort_values("doc_id")
    return [(int(y), np.asarray(g, dtype=np.int32)) for y, g in zip(got["y"], got["g"], strict=True)]


def _dual_descent(x: list[np.ndarray], ratio: np.ndarray, lengths: np.ndarray, y: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Weights (bias last) of the hinge loss, one dual variable a text, in a seeded order.

    A text's values are the ratios of its n-grams by its length, and 1 for the bias; they are taken anew at each visit.
    """
    w = np.zeros((1 << BITS) + 1)
    alpha = np.zeros(len(x))
    norms = np.array([(v := ratio[g] / n) @ v + 1.0 for g, n in zip(x, lengths, strict=True)])
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            values = ratio[x[i]] / lengths[i]
            gradient = y[i] * (w[x[i]] @ values + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x[i]] += step * values
                w[-1] += step
                alpha[i] = new
    return w


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's sigmoid by Newton steps, classes weighted alike."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    target = np.where(y > 0, 0.98, 0.02)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = share * (p - target), share * p * (1 - p) + 1e-12
        grad = np.array([(g * margin).sum() + 1e-4 * a, g.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-4, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model of ``label`` from the rows that may be learned from.

    The log-count ratios count all of them; the hinge loss is fitted to FIT_ROWS at most. With one
    class or none there is nothing to tell apart, and the weights are zero.
    """
    rows = learnable(docs, labels, label)
    counts = _presence(rows).toPandas()
    totals = counts[counts["slot"] == -1]
    n_bad, n_good = (int(totals[c].sum()) for c in ("bad", "good"))
    if not n_bad or not n_good:
        zero = np.zeros(1 << BITS, dtype=np.float32)
        return Model(zero, zero, 0.0, 1.0, 3.0 if n_good or not n_bad else -3.0)
    bad, good = np.zeros(1 << BITS), np.zeros(1 << BITS)
    own = counts[counts["slot"] >= 0]
    bad[own["slot"]], good[own["slot"]] = own["bad"], own["good"]
    ratio = np.log((good + SMOOTHING) / (n_good + 2 * SMOOTHING)) - np.log((bad + SMOOTHING) / (n_bad + 2 * SMOOTHING))
    ratio[(bad + good) < 2] = 0.0  # one text alone shows no ratio
    sample = _fit_rows(docs, rows)
    y = np.array([1.0 if q else -1.0 for q, _ in sample])
    x = [g for _, g in sample]
    costs = COST * len(y) / 2 / np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1))
    # Long texts hold many n-grams, so each is brought to unit length.
    lengths = np.array([max(np.linalg.norm(ratio[g]), 1e-9) for g in x])
    w = _dual_descent(x, ratio, lengths, y, costs)
    bias, w = float(w[-1]), w[:-1]
    w = (1 - BLEND) * w + BLEND * np.abs(w).mean()
    margin = np.array([w[g] @ ratio[g] / n + bias for g, n in zip(x, lengths, strict=True)])
    slope, offset = _sigmoid_fit(margin, y)
    return Model(w.astype(np.float32), ratio.astype(np.float32), bias, slope, offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the chance of label 1, from all n-grams of the whole text.

    A text without words has no n-grams: it scores 0, as there is nothing in it to keep.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.ratio))
    bias, slope, offset = model.bias, model.slope, model.offset

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (weights, ratio), of = shipped.value, cached(_feature)
        for texts in batches:
            out = []
            for text in texts:
                g = _grams(text, of)
                r = ratio[g].astype(np.float64)
                margin = (weights[g] @ r) / max(np.linalg.norm(r), 1e-9) + bias
                out.append(1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500))) if len(g) else 0.0)
            yield pd.Series(out, dtype="float64")

    return docs.withColumn("score", run(F.col("text")))
