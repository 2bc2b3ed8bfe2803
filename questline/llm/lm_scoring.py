"""Cross-entropy difference (Moore and Lewis, 2010).

A target and a background bigram model of the same form and over one vocabulary score each document; the difference
of their losses per word tells how much more a document is like the target texts than like the corpus.

* Vocabulary: the most frequent words of the corpus, at most 2^VOCABULARY_BITS; all other words are one unknown word.
  Bigrams over it have a count each.
* Matched: background counts are of the whole corpus, scaled to as many words as the target has, so that both models
  are smoothed alike.
* Out of sample: a text is scored by counts without its own and those of all texts equal to it.

Equal texts are one class with a number of copies, so a text that makes up much of the corpus is read once. Texts are cut
into words once and kept as numbers, in chunks of many texts. A chunk sends each of its bigrams once, packed with its own
counts, and gets back how often all other chunks hold it; no row of a bigram is ever shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questline.llm.common import arrays, words_of
from questline.operators.lookup import lookup
from questline.session import cut_lineage

VOCABULARY_BITS = 20  # at most 2^20 words have a number of their own
HOT_BITS = 18         # bigrams of 2^21 words of the corpus, 8 times 2^HOT_BITS, are added up by one task
BACKOFF = 2.0         # pseudo-counts of the unigram model in a bigram's
UNIGRAM = 0.5         # pseudo-count of every word
HELD = 1 << 20        # words of a chunk, about
HELD_TEXTS = 1 << 16  # most texts of a chunk
START, UNKNOWN = 0, 1  # numbers of the mark before a text and of words outside the vocabulary
PAIR_BITS = 32        # of the second word's number in the key of a bigram
KINDS = ("target", "background")


@dataclass(frozen=True)
class Words:
    """The vocabulary: sorted hashes (number i + 2), and counts by number: rows target, background."""

    hashes: np.ndarray
    own: np.ndarray     # as a word
    before: np.ndarray  # as the word before another
    shared: np.ndarray  # by number, whether different texts may hold the word: a bigram of two texts has only such words

    @property
    def total(self) -> np.ndarray:
        return self.own.sum(1)

    @property
    def size(self) -> int:
        return len(self.hashes) + 1  # the unknown word is one


def _hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, the lowest of all first: small numbers take little."""
    bytes_of = np.ascontiguousarray(numbers, dtype="<i8").view(np.uint8).reshape(-1, 8)
    return pa.compress(np.ascontiguousarray(bytes_of.T).tobytes(), codec="zstd", asbytes=True)


def _numbers(squeezed: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(squeezed, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, n).T).view("<i8").ravel()


def text_classes(docs: DataFrame, text: str = "text", is_target: str = "is_target", targets: DataFrame | None = None) -> DataFrame:
    """``sha, text, copies, targets``: one row a text. Null texts have none; a null mark is no target.

    With ``targets``, rows whose columns of its names stand in it are targets; only these columns and hashes are joined, not the texts.
    """
    given = docs.filter(F.col(text).isNotNull())
    sha = F.unhex(F.sha2(F.col(text), 256)).alias("sha")
    copies, longest = F.count(F.lit(1)).alias("copies"), F.max(text).alias("text")
    n_targets = F.sum(F.coalesce(F.col(is_target if targets is None else "_target"), F.lit(False)).cast("long")).alias("targets")
    if targets is None:
        return given.groupBy(sha).agg(longest, copies, n_targets)
    on = targets.columns
    # Targets grow with the corpus: never broadcast, and the plan is the same at every size.
    marked = given.select(*on, sha).join(targets.distinct().withColumn("_target", F.lit(True)).hint("merge"), on, "left")
    return given.groupBy(sha).agg(longest).join(marked.groupBy("sha").agg(copies, n_targets).hint("merge"), "sha")


_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("shas", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())),
    ("targets", pa.list_(pa.int64())), ("hashes", pa.binary()), ("places", pa.binary()),
])
_CHUNK_DDL = ("chunk long, shas array<binary>, lengths array<long>, copies array<long>, targets array<long>, hashes binary, places binary")


class _Codes(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(classes: DataFrame) -> DataFrame:
    """The texts as numbers, written: rows of about ``HELD`` words, so that each text is cut into words just once.

    ``chunk``, its texts' ``shas, lengths, copies, targets``, the hashes of its words and, for each word of its texts, the place of its hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = itertools.count(TaskContext.get().partitionId() << 33)
        codes, texts, words, held = _Codes(), [], [], 0

        def row() -> pa.RecordBatch:
            shas, copies, targets = zip(*texts, strict=True)
            hashes = np.fromiter(map(_hash, codes), dtype=np.int64, count=len(codes))
            places = np.concatenate(words)
            # The most frequent come first: small numbers.
            order = np.argsort(-np.bincount(places, minlength=len(codes)), kind="stable")
            rank = np.empty(len(codes), dtype=np.int64)
            rank[order] = np.arange(len(codes))
            return pa.RecordBatch.from_pylist([{
                "chunk": next(made), "shas": list(shas), "lengths": [len(w) for w in words], "copies": list(copies), "targets": list(targets),
                "hashes": hashes[order].tobytes(), "places": _squeezed(rank[places]),
            }], schema=_CHUNK)

        for batch in batches:
            for sha, text, n, marked in zip(batch["sha"].to_pylist(), batch["text"], batch["copies"].to_pylist(), batch["targets"].to_pylist(),
                                            strict=True):
                found = list(map(bytes.lower, words_of(text.as_py())))
                words.append(np.fromiter(map(codes.__getitem__, found), dtype=np.int64, count=len(found)))
                texts.append((sha, n, marked))
                held += len(found)
                if held > HELD or len(texts) > HELD_TEXTS:
                    yield row()
                    codes, texts, words, held = _Codes(), [], [], 0
        if texts:
            yield row()

    return cut_lineage(classes.select("sha", "text", "copies", "targets").mapInArrow(run, _CHUNK_DDL))


class _Chunk:
    """A row of :func:`chunks` as arrays."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.lengths = row["lengths"].values.to_numpy()
        self.times = np.stack([row[c].values.to_numpy() for c in ("targets", "copies")])  # of each text
        self.hashes = np.frombuffer(row["hashes"].as_py(), dtype=np.int64)
        self.places = _numbers(row["places"].as_py(), int(self.lengths.sum()))
        self.text_of = np.repeat(np.arange(len(self.lengths)), self.lengths)  # of each word

    def numbered(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in the vocabulary of the word before each word, and of the word."""
        at = np.minimum(np.searchsorted(known, self.hashes), max(len(known) - 1, 0))
        is_known = known[at] == self.hashes if len(known) else np.zeros(len(self.hashes), dtype=bool)
        w = np.where(is_known, at + 2, UNKNOWN)[self.places]
        v = np.r_[START, w][:-1]
        ends = np.cumsum(self.lengths)
        v[(ends - self.lengths)[self.lengths > 0]] = START
        return v, w

    def groups(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Values with their texts, each once, sorted by value: value, text, times in the text; and the group of each word."""
        order = np.argsort(values, kind="stable")  # words are in the order of the texts
        by_value, by_text = values[order], self.text_of[order]
        new = np.r_[True, (by_value[1:] != by_value[:-1]) | (by_text[1:] != by_text[:-1])][:len(order)]
        first = np.flatnonzero(new)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        return by_value[first], by_text[first], np.diff(np.r_[first, len(order)]), group

    def sums(self, values: np.ndarray, texts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of groups: each value, counts in target and background, number of texts, and the value's place for each group."""
        new = np.r_[True, values[1:] != values[:-1]][:len(values)]
        at = np.cumsum(new) - 1
        k = int(new.sum())
        counts = np.stack([np.bincount(at, n * t[texts], minlength=k) for t in self.times]).astype(np.int64)
        return values[new], counts, np.bincount(at, minlength=k), at


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def count_words(parts: DataFrame) -> DataFrame:
    """``word, target, background, target_before, background_before, texts`` of every word, by its 64-bit hash."""
    names = ["target", "background", "target_last", "background_last", "more"]  # mostly small, or zero

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _Chunk(row)
            places, texts, n, _ = chunk.groups(chunk.places)
            words, counts, n_texts, _ = chunk.sums(places, texts, n)
            held = chunk.lengths > 0
            last = chunk.places[np.cumsum(chunk.lengths)[held] - 1]  # the last word of a text is before no other
            lasts = [np.bincount(last, t[held], minlength=len(chunk.hashes)).astype(np.int64)[words] for t in chunk.times]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (chunk.hashes[words], *counts, *lasts, counts[1] - n_texts)], names=["word", *names])

    rows = parts.mapInArrow(run, "word long, " + ", ".join(f"{c} long" for c in names))
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]).select(
        "word", *KINDS, *[(F.col(k) - F.col(f"{k}_last")).alias(f"{k}_before") for k in KINDS],
        (F.col("background") - F.col("more")).alias("texts"))


def vocabulary(words: DataFrame) -> Words:
    """The most frequent words: all from a count on, chosen so that at most 2^VOCABULARY_BITS come to the driver."""
    step = F.floor(F.log2(F.col("background").cast("double")) * 16)  # single counts as far as 2^4, then 16 a doubling
    least, above = None, 0
    for row in words.groupBy(step.alias("step")).agg(
            F.count(F.lit(1)).alias("n"), F.min("background").alias("least")).orderBy(F.col("step").desc()).collect():
        above += row["n"]
        if above > 1 << VOCABULARY_BITS:
            break
        least = row["least"]
    names = [*KINDS, *(f"{k}_before" for k in KINDS)]
    totals = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    got = arrays(words.filter(F.col("background") >= least if least is not None else F.lit(False)))
    order = np.argsort(got["word"])
    counts = {c: got[c][order].astype(np.float64) for c in names}
    # The mark comes before every first word, so all words together come as often as all words before.
    marks = {k: totals[k] - totals[f"{k}_before"] for k in KINDS}
    return Words(
        got["word"][order].astype(np.int64),
        np.stack([np.r_[0.0, totals[k] - counts[k].sum(), counts[k]] for k in KINDS]),
        np.stack([np.r_[marks[k], totals[f"{k}_before"] - counts[f"{k}_before"].sum(), counts[f"{k}_before"]] for k in KINDS]),
        np.r_[True, True, got["texts"][order] > 1],
    )


def _bigrams(chunk: _Chunk, words: tuple, n_parts: int) -> tuple:
    """Numbers (before, word) and groups of a chunk's bigrams, their sums, and where in these each part's bigrams lie."""
    hashes, shared = words
    v, w = chunk.numbered(hashes)
    groups = chunk.groups((v << PAIR_BITS) | w)
    pairs, counts, _, at = chunk.sums(*groups[:3])
    asked = np.flatnonzero(shared[pairs >> PAIR_BITS] & shared[pairs & ((1 << PAIR_BITS) - 1)])
    part = (pairs[asked].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n_parts
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=n_parts))
    return (v, w), groups, (pairs, counts, at), [p for p in np.split(asked[order], ends[:-1])]


def counts_elsewhere(parts: DataFrame, words: Words) -> DataFrame:
    """``chunk, part, n, target, background``: for the bigrams of a chunk that two texts may hold, their counts in all other chunks.

    Each chunk sends its own counts, every bigram once, packed by parts of the bigrams; a part's task adds them up and answers each
    chunk in the order of its bigrams, so that the answer need not name them.
    """
    shipped = parts.sparkSession.sparkContext.broadcast((words.hashes, words.shared))
    n_parts = _parts_of(words)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, (pairs, counts, _), dealt = _bigrams(_Chunk(row), shipped.value, n_parts)
            some = [(p, at) for p, at in enumerate(dealt) if len(at)]
            yield pa.RecordBatch.from_arrays([
                pa.array([row["chunk"].as_py()] * len(some), type=pa.int64()), pa.array([p for p, _ in some], type=pa.int64()),
                pa.array([len(at) for _, at in some], type=pa.int64()),
                pa.array([_squeezed(np.diff(pairs[at], prepend=0)) for _, at in some], type=pa.binary()),
                *[pa.array([_squeezed(c[at]) for _, at in some], type=pa.binary()) for c in counts],
            ], names=["chunk", "part", "n", "pairs", *KINDS])

    def answer(asked: pa.Table) -> pa.Table:
        sizes = asked["n"].to_pylist()
        pairs = np.concatenate([np.cumsum(_numbers(x, n)) for x, n in zip(asked["pairs"].to_pylist(), sizes, strict=True)])
        at = np.unique(pairs, return_inverse=True)[1]
        del pairs
        told = []
        for kind in KINDS:
            own = np.concatenate([_numbers(x, n) for x, n in zip(asked[kind].to_pylist(), sizes, strict=True)])
            others = np.bincount(at, own).astype(np.int64)[at] - own
            told.append(pa.array([_squeezed(x) for x in np.split(others, np.cumsum(sizes)[:-1])], type=pa.binary()))
        return pa.table([asked["chunk"], asked["part"], asked["n"], *told], names=["chunk", "part", "n", *KINDS])

    fields = "chunk long, part long, n long"
    asked = parts.mapInArrow(ask, f"{fields}, pairs binary, target binary, background binary")
    return asked.groupBy("part").applyInArrow(answer, f"{fields}, target binary, background binary")


def _parts_of(words: Words) -> int:
    return 1 + int(words.total[1]) // (8 << HOT_BITS)


def losses(parts: DataFrame, words: Words) -> DataFrame:
    """``sha, n_words, target_loss, background_loss`` of each text of :func:`chunks`, in bits a word, rounded to six digits.

    With c other counts of a bigram its loss is log2((h + BACKOFF) / x) - log2(1 + c / x), h being the other counts of the word before and
    x BACKOFF times the word's own chance. A bigram of one text only has no other counts, here as everywhere.
    """
    shipped = parts.sparkSession.sparkContext.broadcast((words.hashes, words.shared, words.own, words.before))
    total, size, n_parts = words.total, words.size, _parts_of(words)

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        row = {name: rows[name][0] for name in rows.column_names}
        chunk, (hashes, shared, own, before) = _Chunk(row), shipped.value
        (v, w), (_, texts, n, group), (pairs, counts, at), dealt = _bigrams(chunk, (hashes, shared), n_parts)
        counts = counts.astype(np.float64)
        for part, n_told, *others in zip(*[told[c].to_pylist() for c in ("part", "n", *KINDS)], strict=True):
            for kind, x in enumerate(others):
                counts[kind, dealt[part]] += _numbers(x, n_told)
        times, k = chunk.times.astype(np.float64), len(chunk.lengths)
        left = total[:, None] - times * chunk.lengths
        scale = np.stack([np.ones(k), np.divide(left[0], left[1], out=np.zeros(k), where=left[1] != 0)])
        first = np.empty(len(n), dtype=np.int64)  # of each group, one of its words
        first[group] = np.arange(len(group))

        def others(of: np.ndarray, numbers: np.ndarray) -> np.ndarray:
            _, _, mine, place = chunk.groups(numbers)
            return of[:, numbers[first]] - times[:, texts] * mine[place[first]]

        x = BACKOFF * (others(own, w) * scale[:, texts] + UNIGRAM) / (left[0, texts] + UNIGRAM * size)
        c = (counts[:, at] - times[:, texts] * n) * scale[:, texts]
        lost = (np.log2((others(before, v) * scale[:, texts] + BACKOFF) / x) - np.log2(1 + c / x)) * n
        sums = [np.bincount(texts, one, minlength=k) for one in lost]
        return pa.table([row["shas"].values, pa.array(chunk.lengths), *map(pa.array, sums)], names=["sha", "n_words", *KINDS])

    sums = parts.groupBy("chunk").cogroup(counts_elsewhere(parts, words).groupBy("chunk")).applyInArrow(
        score, "sha binary, n_words long, target double, background double")
    return cut_lineage(sums.select("sha", "n_words", *[
        F.when(F.col("n_words") > 0, F.round(F.col(k) / F.col("n_words"), 6)).alias(f"{k}_loss") for k in KINDS]))


def score(
    docs: DataFrame, text: str = "text", is_target: str = "is_target", targets: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with n_words, target_loss, background_loss (bits a word) and difference.

    Low differences are like the target. Every text is scored by models that haven't read it: its counts and those of its
    copies are taken off. Texts without words, null ones included, have null losses and difference; a null mark is no target.
    Without any target, or without any other text, both models know nothing and the difference is zero. Columns of these names
    are replaced. An empty table gives an empty one. Targets are marked by a column, or are the rows that ``targets`` names (:func:`text_classes`).
    """
    names = ("n_words", "target_loss", "background_loss", "difference")
    parts = chunks(text_classes(docs, text, is_target, targets))
    known = losses(parts, vocabulary(cut_lineage(count_words(parts))))
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*kept, F.unhex(F.sha2(F.col(text), 256)).alias("sha"))
    # One text may be a third of all rows, which are dealt out then.
    return lookup(rows, known, ["sha"], F.monotonically_increasing_id()).select(
        *kept, F.coalesce("n_words", F.lit(0)).alias("n_words"), "target_loss", "background_loss",
        F.round(F.col("target_loss") - F.col("background_loss"), 6).alias("difference"),
    )
