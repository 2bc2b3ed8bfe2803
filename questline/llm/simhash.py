"""SimHash near-dedup over deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that of any two fingerprints within the
distance one segment differs in at most one bit. Each segment is indexed once for every bit
of it, with that bit as a wildcard; an equality join on these variants therefore meets every
pair in question, and the fingerprints themselves are then compared.

Large groups. A bucket of the index may hold a third of all fingerprints, so its pairs are
never listed. One pass over the sorted index compares all pairs of small buckets, and in large
ones neighbours only; the links it finds tie dense groups together. It hands out the rows of the large
buckets, and of those cut by the border of two partitions, so that the index is made and shuffled
once. There, pairs of *different* components then meet: the rows outside a bucket's largest component
meet the others. Pairs within a component can't change the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questline.llm.common import words_of
from questline.llm.components import components
from questline.operators.lookup import lookup
from questline.session import cut_lineage

BITS = 64
SEED = 42
HASHES_AT_ONCE = 1 << 16
SWEPT = 24  # rows of a bucket whose pairs are all compared while passing over the sorted index
PAIR, NEAR, ROW = 0, 1, 2


def shingles(text: str | None, n: int) -> list[bytes]:
    """Space-joined runs of ``n`` words, A-Z lower-cased; of fewer words, the whole text."""
    words = [w.lower() for w in words_of(text)] if text else []
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))) if n > 1 else words


def fingerprint(text: str | None, n: int) -> int:
    """Signed 64-bit SimHash: a bit is set where over half of the shingles' XXH64 have it.

    Repeated shingles count each time. No words: zero.
    """
    grams = shingles(text, n)
    if not grams:
        return 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=len(grams))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        block = hashes[at:at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", n: int = 4, name: str = "fp") -> DataFrame:
    """``docs`` with a long column; fingerprints follow from the text alone (null: zero)."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, n) for t in texts], dtype="int64")

    return docs.withColumn(name, run(F.col(text)))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs in at most one bit."""
    count = max(2, distance // 2 + 1)
    ends = [round(BITS * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masks(distance: int) -> list[int]:
    return [_signed(((1 << w) - 1) << o) for o, w in segments(distance)]


def variants(fp: Column, distance: int) -> Column:
    """One index key per bit: the bit's number, and its segment with that bit cleared."""
    keys = []
    for o, w in segments(distance):
        value = F.shiftrightunsigned(fp, o).bitwiseAND(F.lit((1 << w) - 1))
        keys += [value.bitwiseAND(F.lit(((1 << w) - 1) & ~(1 << i))).bitwiseOR(F.lit((o + i) << 56))
                 for i in range(w)]
    return F.array(*keys)


def _swept(index: DataFrame, reach: int) -> DataFrame:
    """One pass over the sorted index: ``kind, a, b, x``.

    ``PAIR``: all pairs within ``reach`` bits of a bucket of at most ``SWEPT`` rows, x their bits. ``NEAR``:
    neighbours within reach in a larger bucket. ``ROW``: node, key and fingerprint of each row of a bucket
    that the pass can't finish: it is large, or may go on in the next partition.
    """
    shape = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("x", pa.int64())])

    def rows(kind: int, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(a), kind, dtype=np.int8)), pa.array(a), pa.array(b), pa.array(x.astype(np.int64)),
        ], schema=shape)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.int64)] * 3  # of the last bucket: all rows, or the last one of many
        before = 0                                # rows of that bucket which are no longer held
        opened = True                             # the next bucket is the first of this partition

        def finish(key, fp, node, size, last):
            """Pairs of the given whole buckets, and the rows of those to go on with."""
            nonlocal opened
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for lag in range(1, min(SWEPT, len(key))):
                same = key[lag:] == key[:-lag]
                if not same.any():
                    break
                bits = np.bitwise_count((fp[lag:] ^ fp[:-lag]).view(np.uint64))
                close, small = same & (bits <= reach), size[:-lag] <= SWEPT
                for kind, hit in ((PAIR, close & small), (NEAR, close & ~small if lag == 1 else None)):
                    if hit is not None and (at := np.flatnonzero(hit)).size:
                        yield rows(kind, node[at], node[at + lag], bits[at])
            report = size[start] > SWEPT
            report[0] |= opened
            report[-1] |= last
            opened = False
            at = np.flatnonzero(np.repeat(report, np.diff(np.r_[start, len(key)])))
            yield rows(ROW, node[at], key[at], fp[at])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "node")]
            key, fp, node = (np.concatenate(x) for x in zip(held, new, strict=True))
            if not len(key):
                continue
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[start, len(key)])
            sizes[0] += before
            cut = start[-1]
            if cut:
                yield from finish(key[:cut], fp[:cut], node[:cut], np.repeat(sizes[:-1], np.diff(start)), False)
                before = 0
            held = [key[cut:], fp[cut:], node[cut:]]
            if before + len(held[0]) > SWEPT and len(held[0]) > 1:
                bits = np.bitwise_count((held[1][1:] ^ held[1][:-1]).view(np.uint64))
                at = np.flatnonzero(bits <= reach)
                yield rows(NEAR, held[2][at], held[2][at + 1], bits[at])
                yield rows(ROW, held[2][:-1], held[0][:-1], held[1][:-1])
                before += len(held[0]) - 1
                held = [x[-1:] for x in held]
        if len(held[0]):
            yield from finish(*held, np.full(len(held[0]), before + len(held[0])), True)

    return index.select("key", "fp", "node").repartitionByRange("key", "fp", "node").sortWithinPartitions(
        "key", "fp", "node"
    ).mapInArrow(sweep, "kind byte, a long, b long, x long")


def _across(rows: DataFrame, placed: DataFrame, distance: int) -> DataFrame:
    """``a, b``: all pairs in the given buckets, within ``distance`` bits and of different components.

    ``rows``: key, node, fp. ``placed``: node, component. A bucket with one component has nothing to compare.
    """
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    known = placed.join(sizes, "component")
    index = cut_lineage(rows.join(known, "node", "left").select(
        "key", "node", "fp", F.coalesce("component", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size")
    ))
    buckets = index.groupBy("key").agg(
        F.max_by("comp", "size").alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    ).filter("lo != hi").select("key", "top")
    mixed = cut_lineage(lookup(index, buckets, ["key"], F.col("node"), "inner").select("key", "node", "fp", "comp", "top"))
    others = mixed.filter("comp != top").drop("top")
    everyone = mixed.select(F.col("key").alias("key2"), F.col("node").alias("node2"), F.col("fp").alias("fp2"),
                            F.col("comp").alias("comp2"), F.expr("comp = top").alias("in_top"))
    return others.join(
        everyone,
        (F.col("key") == F.col("key2")) & (F.col("comp") != F.col("comp2"))
        & (F.col("in_top") | (F.col("node") < F.col("node2"))) & _close(F.col("key"), distance),
    ).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _close(key: Column, distance: int) -> Column:
    """Whether a pair is within ``distance`` bits; true in just one of the buckets the two meet in."""
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    bit = F.shiftrightunsigned(key, 56)
    once, earlier = F.lit(False), F.lit(True)
    for (o, w), mask in zip(segments(distance), _masks(distance), strict=True):
        off = x.bitwiseAND(F.lit(mask))
        # The wildcard bit is the one that differs; equal segments count at their first bit.
        at_bit = (F.bit_count(off) == 1) & (F.getbit(off, bit.cast("int")) == 1)
        here = bit.between(o, o + w - 1) & (at_bit | ((off == 0) & (bit == o)))
        once = once | (here & earlier)
        earlier = earlier & (F.bit_count(off) > 1)
    return (F.bit_count(x) <= distance) & once


def classes(nodes: DataFrame, distance: int) -> DataFrame:
    """``node, component`` of all nodes that are linked to another.

    ``nodes``: node long and fp long, each node once. All pairs within ``distance`` bits are links. Nodes without
    a link have no row; no nodes, no rows.
    """
    index = nodes.withColumn("key", F.explode(variants(F.col("fp"), distance)))
    swept = cut_lineage(_swept(index, distance))
    near = swept.filter(F.col("kind") == NEAR).groupBy("a").agg(F.min_by("b", "x").alias("b"))
    pairs = swept.filter(F.col("kind") == PAIR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = components(near.unionByName(pairs).distinct())
    rows = swept.filter(F.col("kind") == ROW).select(F.col("b").alias("key"), F.col("a").alias("node"), F.col("x").alias("fp"))
    rest = cut_lineage(_across(rows, first, distance))
    links = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest.select("a", "b"))
    return components(links)


def _grouped(own: DataFrame, least: Column, distance: int) -> DataFrame:
    """``fp, least, comp``: a row for each fingerprint of ``own``, its least row and its group."""
    nodes = cut_lineage(own.groupBy("fp").agg(least.alias("least")))
    found = classes(nodes.select(F.col("fp").alias("node"), "fp"), distance)
    return nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("comp")
    )


def fingerprint_components(docs: DataFrame, distance: int = 4, n: int = 4, doc_id: str = "doc_id",
                           text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``distance`` bits;
    component_id is the smallest id that can be reached (null if all of them are null).
    Documents without words, null texts included, have fingerprint zero and are linked like any
    others. Repeated rows each get a row; other columns are not looked at.
    """
    own = cut_lineage(
        with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), n=n)
        .select("doc_id", "fp")
    )
    placed = _grouped(own, F.min("doc_id"), distance)
    smallest = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    # A fingerprint, that of no words for one, may be that of a third of all rows.
    return lookup(own, placed.join(smallest, "comp").select("fp", "component_id"), ["fp"], F.col("doc_id"), "inner").select(
        "doc_id", "fp", "component_id"
    )


def one_per_group(docs: DataFrame, distance: int = 4, n: int = 4) -> DataFrame:
    """``docs`` with one document of each group of :func:`fingerprint_components`, all columns kept.

    The document with the smallest id stays; one without an id stays only if the group has no other. All
    documents without words, null texts included, are one group. Of repeated rows one stays. An empty table stays
    empty.
    """
    rows = docs.withColumns({
        "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)),
        "_key": F.xxhash64("text", F.octet_length("text")),  # tells rows of one id apart
    })
    own = cut_lineage(with_fingerprint(rows.select("_id", "_key", "text"), n=n).select("_id", "_key", "fp"))
    stays = _grouped(own, F.min(F.struct("_id", "_key")), distance).groupBy("comp").agg(F.min("least").alias("least"))
    return rows.join(stays.select("least._id", "least._key"), ["_id", "_key"]).dropDuplicates(["_id", "_key"]).select(
        *docs.columns
    )
