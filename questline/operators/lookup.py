"""Joins against a side with unique keys when some keys on the other side are very hot."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questline.config import HOT_ROWS

TRACKED = 1 << 16  # keys that the sketch of the most frequent ones follows
MAX_HOT = 4096     # hot keys at most: what is broadcast

_SALT, _COPIES, _HASH = "_salt", "_copies", "_hash"


def hot_keys(left: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> list[tuple[int, int]]:
    """(hash of the key, pieces of about ``hot_rows``) of keys with more rows than that, ``MAX_HOT`` at most.

    One pass over the key columns without a shuffle of rows: each task keeps a mergeable sketch of bounded size. A key that
    holds less than about 1 row in ``TRACKED`` may be missed, so of n rows no key above the larger of ``hot_rows`` and n /
    ``MAX_HOT`` is.
    """
    top = left.select(F.xxhash64(*on).alias("h")).agg(F.expr(f"approx_top_k(h, {MAX_HOT}, {TRACKED})").alias("top")).first()["top"]
    return [(x["item"], math.ceil(x["count"] / hot_rows)) for x in top or [] if x["count"] > hot_rows]


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: Column,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    found: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """``left`` joined to the unique-keyed ``right``, hot keys spread over many tasks.

    Keys with more than ``hot_rows`` rows on the left are found first (:func:`hot_keys`). Before any shuffle their rows
    are dealt out by a hash of ``spread`` into pieces of about ``hot_rows``, and their one row of ``right`` is repeated for
    each piece; all other keys join as they are. The broadcast list of hot keys is bounded by ``MAX_HOT``. Without hot
    keys this is a plain join.

    ``left`` is read twice, so a costly one should be a written table, or its hot keys be ``found`` beforehand where its keys come from.
    """
    if found is None:
        found = hot_keys(left, on, hot_rows)
    if not found:
        return left.join(right, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, f"{_HASH} long, {_COPIES} int"))
    copies = F.coalesce(F.col(_COPIES), F.lit(1))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.withColumn(_HASH, F.xxhash64(*on)).join(hot, _HASH, "left").drop(_HASH)

    dealt = marked(left).withColumn(_SALT, F.pmod(F.xxhash64(spread), copies).cast("int"))
    repeated = marked(right).withColumn(_SALT, F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.drop(_COPIES).join(repeated.drop(_COPIES), [*on, _SALT], how).drop(_SALT)
