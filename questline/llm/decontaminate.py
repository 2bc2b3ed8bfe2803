"""Benchmark decontamination: Wu-Manber multi-pattern search over words (Wu and Manber, 1994).

Patterns are runs of WINDOW words of the benchmark items; an item of fewer words is one pattern.
The alphabet is words, the block is two of them (one for patterns of a single word). A shift
table tells how far the search may move on when a block ends here, the words that end a
pattern select the few patterns to test, and direct comparison confirms an occurrence.
Patterns of one length form one table.

Equal item texts are one item with several names. The benchmark is searched in blocks of at most BLOCK_CHARS
characters and BLOCK_ITEMS texts, names counted too (a longer single item is a block of its own). One block at a time is
in the driver and with the executors. A benchmark of one block is searched in the pass that reads
the documents; of more blocks, each writes its hits, by the documents' texts, before the next is fetched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questline.operators.lookup import lookup
from questline.session import cut_lineage, new_path

WINDOW = 10
BLOCK_ITEMS = 50_000
BLOCK_CHARS = 64 * 1024 * 1024

SPANS = "array<struct<start:int,end:int>>"
FOUND = f"n_words long, spans {SPANS}, items array<string>"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # as item_words, before A-Z are lower-cased

# Bytes that are no part of a word turn into blanks, A-Z into a-z; bytes of other scripts stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Table:
    """Shift and suffix tables of the patterns of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.shift: dict = {}
        self.ending: dict = {}  # block at the end of a pattern -> {pattern: items}
        self.most = length - self.block + 1

    def add(self, pattern: tuple[bytes, ...], item: int) -> None:
        for end in range(self.block, self.length + 1):
            key = pattern[end - self.block:end]
            self.shift[key] = min(self.shift.get(key, self.most), self.length - end)
        self.ending.setdefault(pattern[-self.block:], {}).setdefault(pattern, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of every occurrence, in order."""
        at, n, size = self.length, len(words), self.block
        shift, most = self.shift, self.most
        while at <= n:
            key = (words[at - 2], words[at - 1]) if size == 2 else (words[at - 1],)
            move = shift.get(key, most)
            if move:
                at += move
                continue
            start = at - self.length
            items = self.ending[key].get(tuple(words[start:at]))
            if items:
                yield start, items
            at += 1


def tables(items: list[tuple[int, str]]) -> list[Table]:
    """Search tables of whole items given as (number, text)."""
    by_length: dict[int, Table] = {}
    for number, text in items:
        words = tuple(item_words(text))
        length = min(len(words), WINDOW)
        if length:
            table = by_length.setdefault(length, Table(length))
            for start in range(len(words) - length + 1):
                table.add(words[start:start + length], number)
    return [by_length[length] for length in sorted(by_length)]


Items = list[tuple[list[str], str]]  # names and text


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """``text, names, size``: each text once, with the sorted names of its items."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    grouped = rows.filter(F.col("text").isNotNull()).groupBy("text").agg(F.sort_array(F.collect_set("item")).alias("names"))
    return cut_lineage(grouped.withColumn("size", F.length("text") + F.length(F.array_join("names", ",")).cast("long")))


def _blocks(items: DataFrame, level: int = 0) -> Iterator[Items]:
    """Blocks within the bounds, fetched one by one: what is too large is dealt out by a hash, and its parts again."""
    total = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("c")).first()
    if total["n"] <= BLOCK_ITEMS and (total["c"] <= BLOCK_CHARS or total["n"] == 1):
        if total["n"] or not level:
            yield [(row["names"], row["text"]) for row in items.collect()]
        return
    parts = 1 + max(2 * total["n"] // BLOCK_ITEMS, 2 * total["c"] // BLOCK_CHARS)  # half full on average
    part = F.pmod(F.xxhash64(F.lit(level), "text"), F.lit(parts))
    for number in range(parts):
        yield from _blocks(items.filter(part == number), level + 1)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids as strings) and the hit spans in words.

    A word is hit that lies in any occurrence of a pattern. Null and empty texts have no words
    and no hits; null items have no patterns; an item without an id counts under the empty name.
    Repeated items and repeated rows change nothing and get a row each. An empty benchmark
    hits nothing.
    """
    blocks = _blocks(_items(benchmark, item_id, item_text))
    block, following = next(blocks), next(blocks, None)
    if following is None:
        found = docs.withColumn("_merged", _search(_shipped(docs, block))(F.col(text)))
    else:
        found = _joined(docs, F.col(text), chain([block, following], blocks))
    extra = ("n_words", "n_hit", "items", "spans")
    out = found.select(*[c for c in docs.columns if c not in extra], "_merged.*")
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))


def _joined(docs: DataFrame, text: Column, blocks: Iterable[Items]) -> DataFrame:
    """``docs`` with the hits of all blocks as ``_merged``.

    A block's hits are kept by the SHA-256 of the text they are in, equal texts once, and its
    broadcast goes before the next block is fetched. They are joined back to all documents, texts that many of these share
    spread over tasks.
    """
    spark = docs.sparkSession
    path = new_path(spark, "hits")
    key = F.sha2(text.cast("binary"), 256)
    for block in blocks:
        shipped = _shipped(docs, block)
        hits = docs.select(key.alias("_key"), _search(shipped)(text).alias("_hit")).filter(F.size("_hit.spans") > 0)
        hits.groupBy("_key").agg(F.any_value("_hit").alias("_hit")).write.mode("append").parquet(path)
        shipped.destroy()
    hits = spark.read.schema(f"_key string, _hit struct<{FOUND}>").parquet(path).groupBy("_key").agg(
        _union(F.flatten(F.collect_list("_hit.spans"))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hit.items")))).alias("_items"),
    )
    found = lookup(docs.withColumn("_key", key), cut_lineage(hits), ["_key"], F.spark_partition_id())
    return found.withColumn("_merged", F.struct(
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("_spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
    ))


def _union(spans):
    """Sorted spans with overlapping and touching ones made one."""
    ordered = F.array_sort(spans)
    empty = F.array().cast(SPANS)
    return F.aggregate(ordered, empty, lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"),
            F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))
    ).otherwise(F.concat(done, F.array(s))))


def _shipped(docs: DataFrame, items: Items) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(items)


def _search(shipped: Broadcast):
    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [of for of, _ in shipped.value]
        searched = tables([(number, text) for number, (_, text) in enumerate(shipped.value)])
        for texts in batches:
            out = []
            for text in texts:
                words = item_words(text)
                spans: list[list[int]] = []
                got: set[int] = set()
                hits = [(start, start + t.length, items) for t in searched for start, items in t.search(words)]
                if len(searched) > 1:
                    hits.sort(key=lambda h: h[:2])
                for start, end, items in hits:
                    got |= items
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                out.append((len(words), [{"start": s, "end": e} for s, e in spans], sorted({name for i in got for name in names[i]})))
            yield pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a pattern; columns as they were."""
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("own")
    found = contamination(docs.select(own, F.col("text")), benchmark)
    return found.filter("n_hit = 0").select("own.*")
