"""Near-duplicate vectors: coarse inverted lists, product-quantised residuals, exact rerank.

After Jegou, Douze and Schmid (2011), with bounds that keep it exact. Unit vectors lie in the list of their
nearest coarse centroid; their residual is cut into subspaces and stored as one byte for each, together with the length of
what the codes leave out. Two vectors of a cosine c or more are at most r = sqrt(2 - 2c) apart.

*Probes.* A vector within r of x lies in a list whose border with x's own list is within r of x: exactly these
lists are probed, which is sufficient. *Codes.* The asymmetric distance, from x to the coded vector, is
summed from one table a subspace; by the triangle inequality it is off by no more than the stored length, so
every pair in reach stays a candidate. *Rerank.* Candidates are compared by cosine in double precision.

*Groups.* Equal vectors of one label are one row with a count. Rows of a list are packed into blocks, and blocks
meet, not rows; a large list is many blocks, dealt over many tasks. A meeting of two blocks hands on a number of links
for each row and a spanning forest of the links it found, never the links themselves: a dense group of m
vectors gives rows in proportion to m for each block met.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questline.llm.common import bound_batches
from questline.llm.components import components
from questline.operators.lookup import lookup
from questline.session import cut_lineage

MIN_COSINE = 0.93
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 4_000_000  # the index is fitted on so many vectors at most
LIST_ROWS = 2048      # vectors of a list, about, in the largest label
MAX_LISTS = 4096
SUBSPACE = 8          # dimensions coded together
CODES = 256
ROUNDS = 8            # of k-means
BLOCK_ROWS = 2048
DEALT_ROWS = 65_536   # rows of one list that one task packs, about
PAIRS_AT_ONCE = 65_536
SLACK = 1e-5          # more than single precision can be off
SEED = 42


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` different centroids of the rows of ``x``, by Lloyd's rounds from chosen rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.sort(np.random.default_rng(SEED).permutation(len(distinct))[:k])]
    for _ in range(rounds):
        near = nearest_centre(x, centres)[0]
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return np.unique(centres, axis=0)


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres; a row that is shorter counts as filled up with zeros."""
    return (x * x).sum(1)[:, None] - 2 * x @ centres[:, :x.shape[1]].T + (centres * centres).sum(1)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = squares(x, centres)
    return d.argmin(1), d


class Quantiser:
    """Coarse centroids and codebooks, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.width = sample.shape[1]
        self.centres = k_means(sample, lists)
        apart = squares(self.centres, self.centres)
        self.apart = np.sqrt(np.maximum(apart, 0.0))
        near, _ = nearest_centre(sample, self.centres)
        rest = sample - self.centres[near]
        self.books = [k_means(np.ascontiguousarray(rest[:, a:b]), CODES) for a, b in self.spans()]

    def spans(self) -> list[tuple[int, int]]:
        return [(a, min(a + SUBSPACE, self.width)) for a in range(0, self.width, SUBSPACE)]

    def filled(self, x: np.ndarray) -> np.ndarray:
        return x if x.shape[1] == self.width else np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def place(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of unit vectors: list, codes, length that the codes leave out, and the lists to be probed."""
        home, d = nearest_centre(x, self.centres)
        rest = self.filled(x) - self.centres[home]
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        left = np.zeros(len(x))
        for m, ((a, b), book) in enumerate(zip(self.spans(), self.books, strict=True)):
            codes[:, m] = nearest_centre(rest[:, a:b], book)[0]
            left += ((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(1)
        # Distance to the border between the own list and another one.
        border = (d - d[np.arange(len(x)), home][:, None]) / np.maximum(2 * self.apart[home], 1e-12)
        probed = border <= reach + SLACK
        probed[np.arange(len(x)), home] = True
        return home, codes, np.sqrt(left), [np.flatnonzero(p).astype(np.int32) for p in probed]

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """From unit vectors to the coded vectors of list ``at``, by one table a subspace."""
        rest = (self.filled(x) - self.centres[at]).astype(np.float32)
        total = np.repeat((rest * rest).sum(1)[:, None], len(codes), axis=1)
        for m, ((a, b), book) in enumerate(zip(self.spans(), self.books, strict=True)):
            book = book.astype(np.float32)
            table = (book * book).sum(1) - 2 * rest[:, a:b] @ book.T
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0.0))


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector may link: not null, not zero, every component finite."""
    return F.coalesce(
        F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0),
        F.lit(False),
    )


def _as_bytes(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.asarray(v, dtype=np.float64).tobytes() for v in batch], dtype=object)

    return run(vector)


def _matrix(raws) -> np.ndarray:
    return np.frombuffer(b"".join(raws), dtype=np.float64).reshape(len(raws), -1)


def _by_width(raws) -> Iterator[np.ndarray]:
    sizes = np.fromiter((len(r) for r in raws), dtype=np.int64, count=len(raws))
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def fit(classes: DataFrame, list_rows: int = LIST_ROWS) -> Quantiser | None:
    """A quantiser for the vectors in ``classes`` (grp, vec as bytes, width); None if there are none.

    Fitted on the vectors of lowest hash, ``SAMPLE_ROWS`` and ``SAMPLE_VALUES`` numbers at most. The number of lists
    follows the largest group.
    """
    largest, width = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("w")).agg(
        F.max("n"), F.max("w")).first()
    if not largest:
        return None
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    raws = classes.orderBy(F.xxhash64("vec"), "vec").select("vec").limit(rows).toArrow()["vec"].to_pylist()
    sample = np.zeros((len(raws), width))
    for i, raw in enumerate(raws):
        v = np.frombuffer(raw, dtype=np.float64)
        sample[i, :len(v)] = v
    return Quantiser(unit(sample), min(MAX_LISTS, math.ceil(largest / list_rows)))


_BLOCK = "grp string, list int, nodes array<long>, copies array<long>, vecs array<binary>, codes array<binary>, left array<double>, probes array<array<int>>"


def _blocks(classes: DataFrame, model, reach: float, block_rows: int) -> DataFrame:
    """Blocks of up to ``block_rows`` vectors of one group and list, with codes and probes; written."""

    @F.pandas_udf("list int, codes binary, left double, probes array<int>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raws in batches:
            out = [None] * len(raws)
            for at in _by_width(raws):
                placed = model.value.place(unit(_matrix([raws.iloc[i] for i in at])), reach)
                for i, home, codes, left, probes in zip(at, *placed, strict=True):
                    out[i] = (int(home), codes.tobytes(), float(left), probes)
            yield pd.DataFrame(out, columns=["list", "codes", "left", "probes"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        key = None

        def block() -> pd.DataFrame:
            columns = [list(c) for c in zip(*held, strict=True)]
            held.clear()
            return pd.DataFrame([(*key, *columns)], columns=[c.split(" ")[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and ((row.grp, row.list) != key or len(held) == block_rows):
                    yield block()
                key = (row.grp, row.list)
                held.append((row.node, row.copies, row.vec, row.codes, row.left, row.probes))
        if held:
            yield block()

    parts = 16 + classes.count() // DEALT_ROWS
    placed = classes.select("grp", "node", "copies", "vec", place("vec").alias("at")).select(
        "grp", "at.list", "node", "copies", "vec", "at.codes", "at.left", "at.probes",
        F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part"),
    )
    dealt = placed.repartition("grp", "list", "part").sortWithinPartitions("grp", "list", "part", "node").drop("part")
    return cut_lineage(dealt.mapInPandas(pack, _BLOCK).withColumn("block", F.monotonically_increasing_id()))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, its component's first row) that connect just what the pairs a, b connect."""
    root = np.arange(n)
    while True:
        before = root
        root = root.copy()
        low = np.minimum(before[a], before[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            rows = np.flatnonzero(root != np.arange(n))
            return rows, root[rows]


def _links(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidate pairs those whose cosine, in double precision, is high enough."""
    good = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        good[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= min_cosine
    return i[good], j[good]


def _meetings(blocks: DataFrame) -> DataFrame:
    """Every block with each block of the lists that its rows probe, a pair of blocks once."""
    number = F.row_number().over(Window.partitionBy("grp", "list").orderBy("block"))
    index = blocks.select("grp", "list", "block")
    numbered = cut_lineage(index.withColumn("target", number - 1))
    many = numbered.groupBy("grp", "list").agg(F.count(F.lit(1)).cast("int").alias("blocks"))
    asked = blocks.select(
        "grp", F.col("block").alias("x"), F.explode(F.array_distinct(F.flatten("probes"))).alias("list")
    ).join(many, ["grp", "list"]).withColumn("target", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return asked.join(numbered.withColumnRenamed("block", "y"), ["grp", "list", "target"]).filter("x <= y").select(
        "x", "y", "list"
    )


def _found(blocks: DataFrame, model, reach: float, min_cosine: float) -> DataFrame:
    """``a, b, links``: the number of linked vectors for a row (b null), or an edge of the forest (links null)."""
    rows = F.arrays_zip("nodes", "copies", "vecs", "probes")
    asking = F.filter(rows, lambda r: F.array_contains(r["probes"], F.col("list")))
    two = blocks.select(F.col("block").alias("y"), F.col("nodes").alias("y_nodes"), F.col("copies").alias("y_copies"),
                        F.col("vecs").alias("y_vecs"), "codes", "left")
    met = _meetings(blocks).join(
        blocks.select(F.col("block").alias("x"), "nodes", "copies", "vecs", "probes"), "x"
    ).select("x", "y", "list", asking.alias("rows")).select(
        "x", "y", "list", F.col("rows.nodes").alias("x_nodes"), F.col("rows.copies").alias("x_copies"),
        F.col("rows.vecs").alias("x_vecs"),
    ).join(two, "y")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield from _met(row, model.value, reach, min_cosine)

    return met.mapInPandas(meet, "a long, b long, links long")


def _met(row, model: Quantiser, reach: float, min_cosine: float) -> Iterator[pd.DataFrame]:
    x_nodes, y_nodes = np.asarray(row.x_nodes), np.asarray(row.y_nodes)
    x, y = unit(_matrix(list(row.x_vecs))), unit(_matrix(list(row.y_vecs)))
    codes = np.frombuffer(b"".join(row.codes), dtype=np.uint8).reshape(len(y), -1)
    close = model.distances(x, row.list, codes) <= reach + np.asarray(row.left)[None, :] + SLACK
    if row.x == row.y:  # both rows of a pair ask here
        close &= x_nodes[:, None] < y_nodes[None, :]
    i, j = _links(x, y, *np.nonzero(close), min_cosine)
    if not len(i):
        return
    nodes, place = np.unique(np.concatenate([x_nodes[i], y_nodes[j]]), return_inverse=True)
    a, b = place[:len(i)], place[len(i):]
    links = np.bincount(a, np.asarray(row.y_copies)[j], len(nodes)) + np.bincount(b, np.asarray(row.x_copies)[i], len(nodes))
    yield pd.DataFrame({"a": nodes, "b": pd.array([None] * len(nodes), dtype="Int64"), "links": links.astype(np.int64)})
    low, root = _forest(len(nodes), a, b)
    yield pd.DataFrame({"a": nodes[low], "b": nodes[root], "links": pd.array([None] * len(low), dtype="Int64")})


def near_vectors(rows: DataFrame, min_cosine: float = MIN_COSINE, vec_id: str = "vec_id", vector: str = "embedding",
                 label: str = "label", list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows link if their labels are equal and not null and the cosine of their vectors is at least ``min_cosine``. A vector that is null, empty
    or zero, or holds null or non-finite components, links with nothing, nor do vectors of different widths.
    n_links counts other rows, copies and rows of the same id included; component_id is the smallest id reachable, null
    ids left aside (null if there is no other); kept: the id is its component's, or both are null. Other columns are not
    looked at. No rows: no rows.
    """
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must be over 0 and at most 1")
    spark = rows.sparkSession
    bound_batches(spark)
    reach = math.sqrt(2 - 2 * min_cosine)
    vec = F.col(vector)
    own = rows.select(
        F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), vec.alias("v"),
        (F.col(label).isNotNull() & usable(vec)).alias("fit"),
    )
    able = cut_lineage(own.filter("fit").select(
        "vec_id", F.concat_ws("/", F.size("v"), "label").alias("grp"), F.size("v").alias("width"), _as_bytes(F.col("v")).alias("vec")
    ))
    classes = cut_lineage(able.groupBy("grp", "width", "vec").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")
    ).withColumn("node", F.monotonically_increasing_id()))
    quantiser = fit(classes, list_rows)
    alone = own.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if quantiser is None:
        return alone.withColumn("kept", F.lit(True))
    model = spark.sparkContext.broadcast(quantiser)
    blocks = _blocks(classes, model, reach, block_rows)
    found = cut_lineage(_found(blocks, model, reach, min_cosine))
    links = found.filter("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    hung = components(found.filter("b is not null").select("a", "b"))
    known = cut_lineage(
        classes.join(links, "node", "left").join(hung, "node", "left").select(
            "grp", "vec", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component"))
    )
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = lookup(able, known.join(least, "component").select("grp", "vec", "n_links", "component_id"),
                    ["grp", "vec"], F.col("vec_id"), how="inner")
    out = placed.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
