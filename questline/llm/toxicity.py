"""Toxic passages: maximum-scoring segments over token log-odds.

A token's score is the log-odds of being toxic, with a hierarchical Dirichlet prior: a word's
rate is drawn towards that of words with the same beginning or doubled mark, and this towards the corpus's.
Texts are counted, not occurrences. Less a drift, tokens of clean text score below zero; one linear pass (Ruzzo and Tompa,
1999) then finds all maximal-scoring segments of a text. The chance of segments so good is
calibrated by extreme-value statistics (Karlin and Altschul, 1990): in clean text of n tokens,
K n exp(-lambda s) segments of a score over s are expected, with lambda and K fitted to the
clean training texts. A text's score follows from its segments' sum statistic. For the score a word
that comes again in a text is no new evidence and counts as clean; passages are reported from the
plain log-odds, repeated or not, with their own lambda and K.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questline.llm.common import arrays, learnable, learnable_labels, words_of
from questline.llm.model_text import cached, slot
from questline.session import cut_lineage

WORD_BITS = 21       # the model is two arrays of 2^21 and 2^17 slots, whatever the corpus
PREFIX_BITS = 17
PREFIX_CHARS = 4
WORD_PRIOR = 4.0     # pseudo-counts of the prefix's rate in a word's
PREFIX_PRIOR = 20.0  # pseudo-counts of the corpus's rate in a prefix's
DRIFT = 1.0          # taken off every token's log-odds
MAX_CHANCE = 1e-3    # expected clean segments at least as good: the mark of a significant one


@dataclass(frozen=True)
class Model:
    """Token scores by slot, and the extreme-value parameters. Size: 2^21 floats at most."""

    scores: np.ndarray
    rates: np.ndarray  # by prefix, for words that training didn't show
    decay: float
    k: float
    passage_decay: float  # the same two for the plain log-odds
    passage_k: float


def _token(word: bytes) -> bytes:
    return word.lower().strip(b".,;:!?\"'()[]*$%&#|<>-_")


def _ids(word: bytes) -> tuple[int, int]:
    token = _token(word)
    tail = word[-2:]
    if len(tail) == 2 and tail[0] == tail[1] and not tail.isalnum() and tail[0] < 128:
        prefix = b"\x00" + tail  # a doubled mark says more than the word's beginning
    else:
        prefix = token.decode("utf-8", "replace")[:PREFIX_CHARS].encode("utf-8", "replace")
    return slot(token + prefix, WORD_BITS), slot(prefix, PREFIX_BITS)


def _counts(rows: DataFrame) -> DataFrame:
    """``kind, slot, clean, toxic, prefix``: token counts, summed in each task before the shuffle.

    Kind 0 are words and kind 1 prefixes. ``prefix`` is a word's prefix slot (the smallest, where
    words share a slot).
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = cached(_ids)
        sums = {(kind, y): np.zeros(1 << bits, dtype=np.int64)
                for kind, bits in ((0, WORD_BITS), (1, PREFIX_BITS)) for y in (0, 1)}
        least = np.full(1 << WORD_BITS, 1 << PREFIX_BITS, dtype=np.int32)
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                if ids := set(of(words_of(text))):  # a text counts once for a token
                    parts = np.array(list(ids)).T
                    for kind, part in enumerate(parts):
                        np.add.at(sums[kind, y], part, 1)
                    np.minimum.at(least, parts[0], parts[1].astype(np.int32))
        for kind in (0, 1):
            used = np.flatnonzero(sums[kind, 0] + sums[kind, 1])
            yield pd.DataFrame({"kind": np.int8(kind), "slot": used.astype(np.int32), "clean": sums[kind, 0][used],
                                "toxic": sums[kind, 1][used], "prefix": least[used] if kind == 0 else np.int32(0)})

    return rows.select("text", "y").mapInPandas(
        count, "kind byte, slot int, clean long, toxic long, prefix int"
    ).groupBy("kind", "slot").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.min("prefix").alias("prefix")
    )


def _log_odds(clean: np.ndarray, toxic: np.ndarray, prior_rate: np.ndarray, strength: float) -> np.ndarray:
    return (toxic + strength * prior_rate) / (clean + toxic + strength)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal-scoring segments, in linear time.

    Runs of tokens of one sign are one step each, so the pass is over the positive runs.
    """
    if not len(scores) or scores.max() <= 0:
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (scores > 0).astype(np.int8), [0]])))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, total left, total right, link
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        left, right = float(total[start]), float(total[end])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - l) for s, e, l, r, _ in stack]


def _scorer(scores: np.ndarray, rates: np.ndarray):
    def one(word: bytes) -> tuple[float]:
        w, p = _ids(word)
        s = scores[w]
        return (float(rates[p] if np.isnan(s) else s),)

    of = cached(one)

    def run(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the words, and the same with words that come again as clean."""
        plain = np.array([x[0] for x in of(words)], dtype=np.float64)
        s = plain.copy()
        if len(first := dict(zip(reversed(words), range(len(words) - 1, -1, -1), strict=True))) < len(words):
            again = np.ones(len(words), dtype=bool)
            again[list(first.values())] = False
            s[again] = np.minimum(s[again], -DRIFT)
        return plain, s

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Token scores and calibration from all labelled rows that may be learned from.

    Only arrays of fixed size come to the driver. Without labels every token scores below zero.
    """
    start = _uncalibrated(docs, labels, label)
    return _calibrated(best_segments(docs.select("doc_id", "text"), start), labels, label, start)


def train_and_score(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_chance: float = MAX_CHANCE) -> DataFrame:
    """:func:`score` by the model of :func:`train`, without the texts. Segments don't depend on the calibration, so every
    text is read for them once and they are written."""
    start = _uncalibrated(docs, labels, label)
    found = best_segments(docs, start)
    found = cut_lineage(found.select(*[c for c in found.columns if c != "text"]))
    return _judged(found, _calibrated(found, labels, label, start), max_chance)


def _uncalibrated(docs: DataFrame, labels: DataFrame, label: str) -> Model:
    counts = arrays(_counts(learnable(docs, labels, label)))
    own, word = counts["kind"] == 1, counts["kind"] == 0
    clean, toxic = np.zeros(1 << PREFIX_BITS), np.zeros(1 << PREFIX_BITS)
    clean[counts["slot"][own]], toxic[counts["slot"][own]] = counts["clean"][own], counts["toxic"][own]
    base = (toxic.sum() + 0.5) / (clean.sum() + toxic.sum() + 1)
    prefix_rate = _log_odds(clean, toxic, base, PREFIX_PRIOR)

    def score(rate):
        return np.log(rate / (1 - rate)) - math.log(base / (1 - base)) - DRIFT

    by_prefix = score(prefix_rate).astype(np.float32)
    scores = np.full(1 << WORD_BITS, np.nan, dtype=np.float32)
    rate = _log_odds(counts["clean"][word], counts["toxic"][word], prefix_rate[counts["prefix"][word]], WORD_PRIOR)
    scores[counts["slot"][word]] = score(rate)
    return Model(scores, by_prefix, 1.0, 1.0, 1.0, 1.0)


def _calibrated(found: DataFrame, labels: DataFrame, label: str, start: Model) -> Model:
    clean_ids = learnable_labels(labels, label).filter("y = 0").select("doc_id")
    return replace(start, **dict(zip(("decay", "k", "passage_decay", "passage_k"), _extremes(found, clean_ids), strict=True)))


def _extremes(found: DataFrame, clean_ids: DataFrame) -> tuple[float, float, float, float]:
    """lambda and K from the best segments of clean training texts, by moments of the Gumbel law.

    First those of the scored segments, then those of the passages.

    For a text of n tokens, lambda s - ln n is Gumbel distributed around ln K; lambda comes from
    the spread of s, each text weighted alike. Texts are scored before the join, so that it moves
    three numbers a text; six sums come to the driver.
    """
    best = found.select("doc_id", "n_words", "best", "best_passage")
    some = F.col("n_words") > 0  # in the sums: a filter would be pushed down and score every text twice
    got = best.join(clean_ids.hint("merge"), "doc_id").agg(
        F.count_if(some).alias("n"), F.avg(F.when(some, F.ln("n_words"))).alias("size"),
        *[F.avg(F.when(some, F.col(c))).alias(f"{c}_mean") for c in ("best", "best_passage")],
        *[F.coalesce(F.stddev(F.when(some, F.col(c))), F.lit(0.0)).alias(f"{c}_sd") for c in ("best", "best_passage")],
    ).first()
    if not got["n"]:
        return 1.0, 1.0, 1.0, 1.0
    out = []
    for c in ("best", "best_passage"):
        # A clean text without any positive token scores 0; the floor keeps lambda from running off.
        decay = math.pi / (math.sqrt(6.0) * max(got[f"{c}_sd"], 0.5))
        out += [decay, math.exp(decay * got[f"{c}_mean"] - np.euler_gamma - got["size"])]
    return tuple(out)


def best_segments(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_words, and the best score and all segments: for the score, and as passages.

    ``scored`` are the segments' scores where words that come again are clean; ``passages`` are the
    spans in words of those over plain log-odds, ``best_passage`` is the best of their scores.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.scores, model.rates))

    names = ["n_words", "best", "scored", "best_passage", "passages"]

    @F.pandas_udf("n_words long, best double, scored array<double>, best_passage double, "
                  "passages array<struct<start:int,end:int,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = _scorer(*shipped.value)
        for texts in batches:
            out = []
            for text in texts:
                words = words_of(text)
                plain, once = map(segments, of(words)) if words else ([], [])
                out.append((len(words), max((x[2] for x in once), default=0.0), [x[2] for x in once],
                            max((x[2] for x in plain), default=0.0),
                            [{"start": s, "end": e, "score": x} for s, e, x in plain]))
            yield pd.DataFrame(out, columns=names)

    return docs.withColumn("_found", run(F.col("text"))).select(
        *[c for c in docs.columns if c not in names], "_found.*"
    )


def score(docs: DataFrame, model: Model, max_chance: float = MAX_CHANCE) -> DataFrame:
    """``docs`` with n_words, score (0 to 1) and the significant passages (spans in words).

    A passage's evidence is -ln(K n exp(-lambda s)), what chance leaves unexplained; it is
    significant from -ln(max_chance) on. For the score all positive evidence of segments in which
    no word counts again is summed, less ln(r!) for r segments, as in the sum statistic; score = 1 - exp(-x ln 2 / m) with m the mark a single passage
    must reach, so a document at the mark scores 0.5. Empty texts score 0.
    """
    return _judged(best_segments(docs, model), model, max_chance)


def _judged(found: DataFrame, model: Model, max_chance: float) -> DataFrame:
    mark = -math.log(max_chance)
    offset = F.log(F.col("n_words").cast("double") * model.k)
    evidence = F.transform("scored", lambda s: s * model.decay - offset)
    good = F.filter(evidence, lambda e: e > 0)
    more = F.aggregate(good, F.lit(0.0), lambda acc, e: acc + e) - F.when(
        F.size(good) > 1, F.aggregate(F.sequence(F.lit(1), F.size(good)), F.lit(0.0),
                                      lambda acc, r: acc + F.log(r.cast("double")))
    ).otherwise(0.0)
    best = F.col("best") * model.decay - offset
    total = F.when(F.size(good) > 0, F.greatest(more, best)).otherwise(best)
    strong = 1 - F.exp(-total * math.log(2) / mark)
    passage_offset = F.log(F.col("n_words").cast("double") * model.passage_k)
    kept = F.filter("passages", lambda p: p["score"] * model.passage_decay - passage_offset >= mark)
    return found.withColumn("score", F.when((F.col("n_words") == 0) | (total <= 0), 0.0).otherwise(strong)).withColumn(
        "passages", F.when(F.col("n_words") > 0, kept).otherwise(F.col("passages"))
    ).drop("scored", "best_passage")
