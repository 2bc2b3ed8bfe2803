"""Sharding along a Hilbert curve.

Metadata dimensions are quantised, each row gets its index on the Hilbert curve through the
grid, rows are sorted by it and cut into runs of equal counts. Neighbours on the curve are
neighbours in every dimension, so a shard covers a compact region and a filter on any dimension prunes most
shards by their recorded bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questline.session import cut_lineage

BITS = 8      # of each dimension's grid
SHARDS = 8


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of rows of grid cells (Skilling, 2004): all rows at once, bit by bit."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def curve(dims: list[Column], bits: int = BITS) -> Column:
    """Hilbert index of integer columns that are grid cells already."""

    @F.pandas_udf("long")
    def run(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    return run(F.struct(*[d.cast("int").alias(f"d{i}") for i, d in enumerate(dims)]))


def name_cell(name: Column, bits: int = BITS) -> Column:
    """Cell of a name: a hash, so that an equality filter meets one cell. Null: cell 0."""
    return F.when(name.isNull(), 0).otherwise(F.pmod(F.xxhash64(name), F.lit(1 << bits))).cast("int")


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Cell of a size: eight cells a doubling, up to 2^32. Null: cell 0."""
    cell = F.floor(F.log2(F.greatest(size.cast("double"), F.lit(1.0))) * (1 << bits) / 32)
    return F.coalesce(F.least(cell, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def rank_rows(rows: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """``rows`` with a gapless global rank from 0 by ``order``, and ties in any but fixed order.

    Rows are sorted into ranges and written with their place in the range; a range's first
    rank is the sum of the counts before it. One row a range meets in one task, no more.
    """
    placed = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    first = counts.withColumn(
        "_first", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ).select("_part", F.coalesce("_first", F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    return placed.withColumn("_part", part).join(first, "_part").withColumn(
        rank, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ).drop("_part", "_first", "_at")


def shard(docs: DataFrame, shards: int = SHARDS, tie: tuple[str, ...] = ("doc_id",), size: Column | None = None,
          source: str = "source", lang: str = "lang") -> DataFrame:
    """``docs`` with hilbert, shard (from 0) and slot (gapless from 0 in the shard).

    The dimensions are source, language and text size. Shards are runs of the curve order, ties by
    ``tie``, whose counts are at most one apart; fewer rows than shards leave the last ones
    empty. Null metadata lie in cell 0, repeated rows next to each other. Columns called hilbert,
    shard or slot are replaced. An empty table gives an empty one.
    """
    size = F.octet_length("text") if size is None else size
    rows = docs.drop("hilbert", "shard", "slot").withColumn(
        "hilbert", curve([name_cell(F.col(source)), name_cell(F.col(lang)), size_cell(size)])
    )
    ranked = rank_rows(rows, ["hilbert", *tie], "_rank")
    small = F.expr(f"_all div {shards}")
    large = F.expr(f"_all % {shards}")  # the first shards hold one row more
    edge = large * (small + 1)
    number = F.when(F.col("_rank") < edge, F.expr("_rank") / (small + 1)).otherwise(
        large + (F.col("_rank") - edge) / F.greatest(small, F.lit(1))
    )
    number = F.floor(number).cast("int")
    start = number * small + F.least(number.cast("long"), large)
    return ranked.withColumn("shard", number).withColumn("slot", (F.col("_rank") - start).cast("long")).drop("_rank", "_all")


def bounds(sharded: DataFrame) -> DataFrame:
    """What a reader prunes by: each shard's rows and the range of every dimension."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("hilbert").alias("first_index"), F.max("hilbert").alias("last_index"),
        F.min("source").alias("min_source"), F.max("source").alias("max_source"),
        F.min("lang").alias("min_lang"), F.max("lang").alias("max_lang"),
        F.min(F.octet_length("text")).alias("min_bytes"), F.max(F.octet_length("text")).alias("max_bytes"),
    )


def contents(sharded: DataFrame, source: str = "source", lang: str = "lang", size: Column | None = None) -> DataFrame:
    """``shard, source, lang, n_rows, min_bytes, max_bytes``: what each shard holds of every source and language.

    Name cells are hashes, so the range of names in :func:`bounds` hardly prunes; these rows say exactly which shards have a name. There
    is one row for each shard and pair of names that it holds, and rows are summed before the shuffle. Null names have rows of their
    own; sizes of null texts are null and count in no range. An empty table gives an empty one.
    """
    size = F.octet_length("text") if size is None else size
    return sharded.groupBy("shard", F.col(source).alias("source"), F.col(lang).alias("lang")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"))


def shards_for(held: DataFrame, wanted: Column) -> DataFrame:
    """``shard``: the shards a reader must open for rows of :func:`contents` that fit ``wanted``, for example ``source = 'a'``."""
    return held.filter(wanted).select("shard").distinct()
