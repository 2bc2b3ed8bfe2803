"""Exact nearest neighbours over a vector-approximation file (Weber, Schek and Blott, 1998).

Every corpus vector is kept a second time as one byte for each dimension, with a scale of its own and the length
of what the bytes leave out. For a query of unit length the score lies within that length of the product
with the coded vector, whatever the width. All pairs are bounded from the codes alone, a quarter of the
vectors' bytes; only rows whose upper bound reaches the k-th best lower bound of their query are
fetched and scored in double precision. No pivots, cells or samples: the bounds hold for any data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from questline.operators import nearest as nb
from questline.operators.lookup import lookup
from questline.session import cut_lineage

LEVELS = 127  # steps to either side of zero


def code(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of float32 vectors, brought to unit length: bytes, scales, and the length that these leave out."""
    raw, length = nb._matrix(raws)
    unit = raw / length[:, None]
    scale = np.abs(unit).max(1) / LEVELS
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    left = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1))
    return codes, scale.astype(np.float32), left.astype(np.float32)


def _coded(blocks: DataFrame, copies: int) -> DataFrame:
    """The file: one row a block. Of equal vectors a block keeps the lowest ids, all that can be among the best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for block in batch.itertuples(index=False):
                ids, raws = nb._lowest_copies(list(block.ids), list(block.raws), copies)
                codes, scale, left = code(raws)
                rows.append((block.block, ids, codes.tobytes(), scale, left))
            yield pd.DataFrame(rows, columns=["target", "cids", "codes", "scales", "lefts"])

    return cut_lineage(blocks.select("block", "ids", "raws").mapInPandas(
        run, "target int, cids array<string>, codes binary, scales array<float>, lefts array<float>"))


def _bounds(q_blocks: DataFrame, file: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """``qid, cid, lower, upper`` of all pairs that may still be among the k best of their query in its task."""
    last = file.agg(F.max("target")).first()[0] or 0
    asked = q_blocks.select(
        F.struct("grp", "block").cast("string").alias("block_name"), F.col("ids").alias("qids"), F.col("raws").alias("qraws"),
        F.explode(F.sequence(F.lit(0), F.lit(int(last)))).alias("target"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bests: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                raw, length = nb._matrix(list(row.qraws))
                query = (raw / length[:, None]).astype(np.float32)
                codes = np.frombuffer(row.codes, dtype=np.int8).reshape(len(row.cids), -1).astype(np.float32)
                about = (query @ codes.T) * np.asarray(row.scales)
                off = np.asarray(row.lefts) + nb.SLACK
                if exclude_self:
                    place = {name: i for i, name in enumerate(row.cids)}
                    for i, name in enumerate(row.qids):
                        if name in place:
                            about[i, place[name]] = -np.inf
                if len(bests) > nb.BLOCKS_REMEMBERED:
                    bests.clear()
                best = bests.setdefault(row.block_name, np.full((len(query), k), -np.inf, dtype=np.float32))
                low = about - off
                if low.shape[1] > k:
                    low = np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
                best[:] = np.sort(np.concatenate([best, low], axis=1), axis=1)[:, -k:]
                i, j = np.nonzero((about + off >= best[:, :1]) & np.isfinite(about))
                if len(i):
                    yield pd.DataFrame({
                        "qid": np.asarray(row.qids, dtype=object)[i], "cid": np.asarray(row.cids, dtype=object)[j],
                        "lower": (about[i, j] - off[j]).astype(np.float64), "upper": (about[i, j] + off[j]).astype(np.float64)})

    return asked.join(file, "target").mapInPandas(run, "qid string, cid string, lower double, upper double")


def coded_candidates(q_rows: DataFrame, c_rows: DataFrame, k: int, exclude_self: bool = False,
                     block_rows: int = nb.BLOCK_ROWS) -> DataFrame:
    """``qid, cid``: the pairs that the bounds can't rule out. Rows: id, raw, grp and cell of equal width."""
    query_rows = min(nb.QUERY_BLOCK, block_rows)
    file = _coded(nb._packed(c_rows, nb._large_cells(c_rows, block_rows)), k + exclude_self)
    q_blocks = nb._packed(q_rows, nb._large_cells(q_rows, query_rows))
    bounded = cut_lineage(_bounds(q_blocks, file, k, exclude_self))
    kth = bounded.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("lower").desc()))).filter(
        F.col("n") == k).select("qid", F.col("lower").alias("floor"))
    return bounded.join(kth, "qid", "left").filter("floor is null or upper >= floor").select("qid", "cid")


def nearest_coded(
    queries: DataFrame, corpus: DataFrame, *, query_id: str, corpus_id: str, query_vector: str, corpus_vector: str,
    k: int, dim: int, exclude_self: bool = False, block_rows: int = nb.BLOCK_ROWS,
) -> DataFrame:
    """``query_id, corpus_id, score, place`` of each query's ``k`` most similar corpus rows, ties by corpus id.

    Exact, as :func:`questline.operators.nearest.nearest` with ``ties="first"``: scores are rounded to six decimals
    before ranking, and vectors that are null, zero, not finite or of another width than ``dim`` take no part. Ids are unique.
    """
    c_rows = cut_lineage(nb._placed(nb._vectors(corpus, corpus_id, corpus_vector, None, dim), None))
    q_rows = cut_lineage(nb._placed(nb._vectors(queries, query_id, query_vector, None, dim), None))
    left = cut_lineage(coded_candidates(q_rows, c_rows, k, exclude_self, block_rows))

    @F.pandas_udf("double")
    def exact(asked: pd.Series, offered: pd.Series) -> pd.Series:
        if not len(asked):
            return pd.Series(dtype="float64")
        (q, q_len), (c, c_len) = nb._matrix(list(asked)), nb._matrix(list(offered))
        at = np.arange(len(q))
        return pd.Series(nb._exact(q, q_len, c, c_len, at, at))

    with_query = left.join(q_rows.select(F.col("id").alias("qid"), F.col("raw").alias("qraw")), "qid")
    # One corpus row may be a candidate of very many queries.
    both = lookup(with_query, c_rows.select(F.col("id").alias("cid"), F.col("raw").alias("craw")), ["cid"], F.col("qid"), how="inner")
    scored = both.select("qid", "cid", exact("qraw", "craw").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("cid"))
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(
        F.col("qid").alias("query_id"), F.col("cid").alias("corpus_id"), "score", "place")
