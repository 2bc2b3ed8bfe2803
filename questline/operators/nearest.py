"""Exact nearest-neighbour join by cosine similarity, within groups, at any group size.

The join never pairs rows with rows in a shuffle. Vectors are packed into blocks of
bounded size; blocks meet by an equi-join whose key on the corpus side is one block, so a
group that holds much of the data is spread over as many tasks as it has blocks, and each
meeting is one matrix product that hands on only what can still be in the answer. Where most
vectors are copies, only the k lowest ids of each are offered, and equal questions are asked once.

Large corpora are first divided into cells around pivot vectors. A query is scored in its
own cell, which gives a lower bound on its k-th best score; it then visits only the cells
whose best possible score, by the triangle inequality on angles, reaches that bound. The
bound is exact, so no partner is lost: cells that cannot be ruled out are all visited.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questline.operators.lookup import lookup
from questline.session import bound_batches, cut_lineage

SCORE_DIGITS = 6       # scores carry single precision, which is what this rounding keeps
QUERY_BLOCK = 1024     # rows of one query block, about, and most that are scored at once
BLOCK_ROWS = 4096      # rows of one corpus block, about, and most that are scored at once
BLOCK_BYTES = 1 << 22  # of a corpus block's vectors where they are narrow: queries are sent once to each block
CELL_SALTS = 16        # tasks a cell's rows are spread over to learn its number of blocks
MAX_PIVOTS = 512       # also the most vectors that ever reach the driver
PRUNE_FROM = 10**12    # row pairs from which cells pay off; below, all blocks are scored
PAIRS_AT_ONCE = 65536  # pairs scored in double precision at a time
COLUMN_GROUPS = 64     # of a slice of scores: only groups whose best score may win are looked into
BLOCKS_REMEMBERED = 1024  # query blocks whose best scores a task keeps
SLACK = 1e-5           # more than single-precision products can be off

_FOUND = "qid string, cid string, score double, bound double"
_FOUND_ARROW = pa.schema([("qid", pa.string()), ("cid", pa.string()), ("score", pa.float64()), ("bound", pa.float64())])


def _vectors(df: DataFrame, key: str, vector: str, group: str | None, dim: int | None, *more: Column) -> DataFrame:
    grp = F.lit("") if group is None else F.col(group).cast("string")
    rows = df.select(F.col(key).cast("string").alias("id"), grp.alias("grp"), F.col(vector).alias("vec"), *more)
    # Every element must be a number: one NaN or null would spoil the block it lies in.
    least, most = F.array_min("vec"), F.array_max("vec")  # NaN is the largest, nulls are passed over
    usable = F.col("grp").isNotNull() & (least > -float("inf")) & (most < float("inf")) & ((least < 0) | (most > 0)) & ~F.exists(
        "vec", lambda x: x.isNull())
    if dim is not None:
        usable = usable & (F.size("vec") == dim)
    return rows.filter(usable)


def _pivots(corpus: DataFrame, block_rows: int, max_pivots: int) -> np.ndarray | None:
    """Up to ``max_pivots`` corpus vectors, or None when one cell is enough.

    Two narrow passes with bounded results: ids are hashed into ``max_pivots`` buckets, each
    bucket's lowest hash is kept, and the vectors with these hashes are fetched.
    """
    ids = corpus.select(F.xxhash64("id").alias("h"))
    lowest = (
        ids.groupBy(F.pmod("h", F.lit(max_pivots)).alias("bucket"))
        .agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    cells = min(max_pivots, sum(row["n"] for row in lowest) // (4 * block_rows))
    if cells < 2:
        return None
    chosen = sorted(row["h"] for row in lowest)[:cells]
    # The same id may stand in several groups; one vector per hash is enough.
    found = corpus.filter(F.xxhash64("id").isin(chosen)).groupBy(F.xxhash64("id").alias("h")).agg(
        F.first("vec").alias("vec")
    )
    matrix = np.array([row["vec"] for row in found.collect()], dtype=np.float64)
    return np.unique(matrix / np.linalg.norm(matrix, axis=1, keepdims=True), axis=0)


def _counted(rows: DataFrame) -> tuple[int, bool]:
    """How many rows there are, and whether most are copies of others' vectors; that only chooses the way, not the result."""
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("grp", "vec")).alias("vectors")).first()
    return got["n"], got["n"] > 2 * got["vectors"]


def _first_copies(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` lowest ids of each vector of a group; tasks leave the others out before the shuffle."""
    copies = Window.partitionBy(F.xxhash64("grp", "vec"), "grp", "vec").orderBy("id")
    return rows.withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= n).drop("nth")


def _with_groups(rows: DataFrame) -> DataFrame | None:
    """Rows with all groups of their id as JSON, or None where an id stands in a group twice or has several vectors."""
    vector = F.xxhash64("vec")
    ids = cut_lineage(rows.groupBy("id").agg(
        F.sort_array(F.collect_set("grp")).alias("groups"), F.count(F.lit(1)).alias("n"), F.min(vector).alias("v"), F.max(vector).alias("w")))
    if not ids.filter("n != size(groups) or v != w").isEmpty():
        return None
    return rows.join(ids.select("id", F.to_json("groups").alias("groups")), "id")


def _pairs(asked: DataFrame, offered: DataFrame) -> float:
    """How many pairs meet in the groups."""
    sizes = [rows.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias(name)) for rows, name in ((asked, "a"), (offered, "b"))]
    return sizes[0].join(sizes[1], "grp").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _placed(rows: DataFrame, pivots: np.ndarray | None) -> DataFrame:
    """Vectors as float32 bytes with their cell and their angle to its pivot."""

    @F.pandas_udf("binary")
    def as_bytes(vecs: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype=np.float32).tobytes() for v in vecs], dtype=object)

    @F.pandas_udf("cell int, theta double")
    def place(vecs: pd.Series) -> pd.DataFrame:
        if not len(vecs):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "theta": pd.Series(dtype="float64")})
        unit = np.stack([np.asarray(v, dtype=np.float64) for v in vecs])
        cosines = (unit / np.linalg.norm(unit, axis=1, keepdims=True)) @ pivots.T
        return pd.DataFrame(
            {"cell": cosines.argmax(axis=1).astype(np.int32), "theta": _angle(cosines.max(axis=1))}
        )

    raw = as_bytes("vec").alias("raw")
    if pivots is None:
        return rows.withColumn("raw", as_bytes("vec")).withColumn("cell", F.lit(0)).drop("vec")
    more = [c for c in rows.columns if c not in ("id", "grp", "vec")]
    placed = rows.select("id", "grp", *more, raw, place("vec").alias("at"))
    return placed.select("id", "grp", *more, "raw", "at.cell", "at.theta")


def _large_cells(rows: DataFrame, block_rows: int) -> DataFrame:
    """Cells of more than two blocks with their number of blocks: at most n / (2 * block)."""
    counts = rows.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > 2 * block_rows).select(
        "grp", "cell", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")
    )


def _with_blocks(rows: DataFrame, large: DataFrame, spread: str) -> DataFrame:
    """Rows with their cell's number of blocks (null for one); a hot cell's rows are salted."""
    salts = F.array(*[F.lit(i) for i in range(CELL_SALTS)])
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), F.col(spread)), F.lit(CELL_SALTS)).cast("int"))
    repeated = large.withColumn("_salt", F.explode(salts))
    return salted.join(repeated, ["grp", "cell", "_salt"], "left").drop("_salt")


def _packed(rows: DataFrame, large: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Blocks ``grp, cell, block, ids, raws``; a large cell's rows are dealt out by id hash."""
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    dealt = _with_blocks(rows, large, "id").withColumn(
        "block", F.pmod(F.xxhash64("id"), blocks).cast("int")
    )
    packed = dealt.groupBy("grp", "cell", "block").agg(
        F.collect_list(F.struct("id", "raw", *(extra or []))).alias("rows")
    )
    fields = {"ids": "id", "raws": "raw", **{f"{c}s" if c != "groups" else "groups": c for c in extra or []}}
    return packed.select(
        "grp", "cell", "block", *[F.col(f"rows.{f}").alias(name) for name, f in fields.items()]
    )


def _round(scores: np.ndarray) -> np.ndarray:
    scale = 10.0**SCORE_DIGITS
    return np.sign(scores) * np.floor(np.abs(scores) * scale + 0.5) / scale


def _matrix(raws) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(raws), dtype=np.float32).reshape(len(raws), -1)
    return raw, np.linalg.norm(raw.astype(np.float64), axis=1)


def _block_rows(dim: int | None) -> int:
    return BLOCK_ROWS if dim is None else max(BLOCK_ROWS, BLOCK_BYTES // (4 * dim))


def _query_rows(block_rows: int) -> int:
    return min(block_rows, max(QUERY_BLOCK, block_rows // 4))


def _by_width(raws: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and float32 matrix of the vectors of each width, read from the batch without an object for each."""
    n = len(raws)
    if not n:
        return {}
    kind = np.int64 if pa.types.is_large_binary(raws.type) else np.int32
    ends = np.frombuffer(raws.buffers()[1], dtype=kind)[raws.offset:raws.offset + n + 1]
    data, widths = np.frombuffer(raws.buffers()[2], dtype=np.uint8), np.diff(ends)
    out = {}
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        part = data[ends[0]:ends[-1]] if len(at) == n else np.concatenate([data[ends[i]:ends[i + 1]] for i in at])
        out[int(width)] = at, np.ascontiguousarray(part).view(np.float32).reshape(len(at), -1)
    return out


def _lowest(ids: pa.Array, raws: pa.Array, n: int) -> tuple[pa.Array, pa.Array]:
    """As :func:`_lowest_copies`, of Arrow arrays; nothing is moved where no vector comes more than ``n`` times."""
    copy_of = raws.dictionary_encode().indices.to_numpy()
    if not len(copy_of) or np.bincount(copy_of).max() <= n:
        return ids, raws
    order = pc.sort_indices(ids).to_numpy().astype(np.int64)
    by_vector = order[np.argsort(copy_of[order], kind="stable")]
    codes = copy_of[by_vector]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    nth = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
    kept = np.zeros(len(codes), dtype=bool)
    kept[by_vector[nth < n]] = True
    at = pa.array(order[kept[order]])
    return ids.take(at), raws.take(at)


def _lowest_copies(ids: list, raws: list, n: int) -> tuple[list, list]:
    """The ``n`` lowest ids of each distinct vector: all that can win where ties go by id."""
    seen: dict[bytes, int] = {}
    kept = []
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        seen[raws[i]] = seen.get(raws[i], 0) + 1
        if seen[raws[i]] <= n:
            kept.append(i)
    return [ids[i] for i in kept], [raws[i] for i in kept]


def _candidates(rough: np.ndarray, floor: np.ndarray, k: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of single-precision scores that may be among the k best of their row and at its floor, in slices of whole rows.

    The k-th best of the maxima of a row's column groups is no more than its k-th best score, and only groups that reach it are looked into.
    """
    n, deep = len(rough), rough.shape[1] // COLUMN_GROUPS

    def maxima() -> np.ndarray:
        if not deep:
            return rough
        tops = rough[:, :deep * COLUMN_GROUPS].reshape(n, deep, COLUMN_GROUPS).max(axis=1)
        return np.concatenate([tops, rough[:, deep * COLUMN_GROUPS:]], axis=1)

    tops = maxima()
    if np.isnan(tops).any():
        rough = np.where(np.isnan(rough), -np.inf, rough)  # NaN would be the largest
        tops = maxima()
    # No cosine is below -1, so this leaves out -inf (the query itself and what was NaN).
    reach = np.maximum(floor, -2.0) - SLACK
    if k is not None and tops.shape[1] > k:
        reach = np.maximum(reach, np.partition(tops, -k, axis=1)[:, -k] - 2 * SLACK)
    reach = np.nextafter(reach.astype(np.float32), np.float32(-np.inf))[:, None]
    r, g = np.nonzero(tops >= reach)
    if not deep or len(r) * deep > 8 * PAIRS_AT_ONCE:
        keep = rough >= reach
        for start, stop in _row_slices(keep.sum(axis=1)):
            rows, columns = np.nonzero(keep[start:stop])
            yield rows + start, columns
        return
    whole = g < COLUMN_GROUPS
    columns = g[whole][:, None] + COLUMN_GROUPS * np.arange(deep)
    at, nth = np.nonzero(rough[r[whole][:, None], columns] >= reach[r[whole]])
    rows = np.r_[r[whole][at], r[~whole]]
    columns = np.r_[columns[at, nth], g[~whole] + (deep - 1) * COLUMN_GROUPS]
    order = np.argsort(rows, kind="stable")
    if len(order):
        yield rows[order], columns[order]


def _exact(q32, q_len, c32, c_len, r, c) -> np.ndarray:
    score = np.empty(len(r))
    for start in range(0, len(r), PAIRS_AT_ONCE):
        i, j = r[start:start + PAIRS_AT_ONCE], c[start:start + PAIRS_AT_ONCE]
        dots = np.einsum("ij,ij->i", q32[i].astype(np.float64), c32[j].astype(np.float64))
        score[start:start + PAIRS_AT_ONCE] = dots / (q_len[i] * c_len[j])
    return _round(score)


def _row_slices(per_row: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows that hold about as many pairs as are scored at once."""
    start, pairs = 0, 0
    for row, n in enumerate(per_row):
        if pairs and pairs + n > PAIRS_AT_ONCE:
            yield start, row
            start, pairs = row, 0
        pairs += n
    if pairs:
        yield start, len(per_row)


def _first_shared(group: str, q_groups: pa.Array, c_groups: pa.Array) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether ``group`` is the first that two rows share: there, and nowhere else, their pair is handed on."""
    (q_of, q_sets), (c_of, c_sets) = [
        (code.indices.to_numpy().astype(np.int64), [set(json.loads(x)) for x in code.dictionary.to_pylist()])
        for code in (q_groups.dictionary_encode(), c_groups.dictionary_encode())]
    known: dict[int, bool] = {}

    def shared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        both, at = np.unique(q_of[q] * len(c_sets) + c_of[c], return_inverse=True)
        for code in both.tolist():
            if code not in known:
                known[code] = min(q_sets[code // len(c_sets)] & c_sets[code % len(c_sets)]) == group
        return np.array([known[code] for code in both.tolist()], dtype=bool)[at]

    return shared


def _score_block(queries, corpus, best, k, min_score, ties, exclude_self, shared=None) -> Iterator[pa.RecordBatch]:
    """Candidates of a query block in a corpus block, both scored in slices of bounded size.

    ``queries`` is (ids, raws, floors or None), ``corpus`` (ids, raws), all Arrow arrays. ``best`` holds the k
    best scores of each query among what this task has already met of the group; it
    is brought up to date, and what falls below its k-th score is not handed on; nor are pairs that ``shared`` leaves to another group.
    """
    q_ids, q_raws, q_floors = queries
    c_ids, c_raws = corpus
    floors = None if q_floors is None else q_floors.to_numpy(zero_copy_only=False)
    offered = _by_width(c_raws)
    for width, (rows, q_all) in _by_width(q_raws).items():
        if width not in offered:
            continue
        at, c_all = offered[width]
        itself = np.full(len(rows), -1)
        if exclude_self:
            place = pc.index_in(q_ids.take(pa.array(rows)), value_set=c_ids.take(pa.array(at[::-1])))
            itself = len(at) - 1 - place.fill_null(len(at)).to_numpy().astype(np.int64)
        for c_from in range(0, len(at), BLOCK_ROWS):
            c32, c_at = c_all[c_from:c_from + BLOCK_ROWS], at[c_from:c_from + BLOCK_ROWS]
            c_len = np.linalg.norm(c32.astype(np.float64), axis=1)
            c_unit = (c32 / c_len[:, None].astype(np.float32)).T
            for q_from in range(0, len(rows), QUERY_BLOCK):
                q32, q_at = q_all[q_from:q_from + QUERY_BLOCK], rows[q_from:q_from + QUERY_BLOCK]
                own = itself[q_from:q_from + QUERY_BLOCK] - c_from
                q_len = np.linalg.norm(q32.astype(np.float64), axis=1)
                rough = (q32 / q_len[:, None].astype(np.float32)) @ c_unit
                here = np.flatnonzero((own >= 0) & (own < len(c_at)))
                rough[here, own[here]] = -np.inf
                floor = np.full(len(q_at), -np.inf)
                if floors is not None:
                    floor = np.maximum(floor, floors[q_at])
                if min_score is not None:
                    floor = np.maximum(floor, min_score)
                if best is not None:
                    floor = np.maximum(floor, best[q_at, 0])
                for r, c in _candidates(rough, floor, k):
                    score = _exact(q32, q_len, c32, c_len, r, c)
                    enough = score >= floor[r]
                    if shared is not None:
                        enough &= shared(q_at[r], c_at[c])
                    if enough.any():
                        yield _offer(q_ids, c_ids, q_at[r[enough]], c_at[c[enough]], score[enough], best, k, ties)


def _offer(q_ids, c_ids, q, c, score, best, k, ties) -> pa.RecordBatch:
    """Scored pairs (places ``q`` and ``c``, sorted by ``q``) that may be among the best, after ``best`` is brought up to date."""
    cids = c_ids.take(pa.array(c))
    bound = np.full(len(q), -1.0)
    if k is not None:
        order = np.lexsort((pc.rank(cids, tiebreaker="dense").to_numpy(), -score, q))
        q, score, cids = q[order], score[order], cids.take(pa.array(order))
        first_of = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        nth = np.arange(len(q)) - np.repeat(first_of, np.diff(np.r_[first_of, len(q)]))
        first, touched = nth < k, q[first_of]
        offered = np.full((len(touched), k), -np.inf)
        offered[np.searchsorted(touched, q[first]), nth[first]] = score[first]
        best[touched] = np.sort(np.concatenate([best[touched], offered], axis=1), axis=1)[:, k:]
        reached = best[q, 0]
        kept = (score >= reached) & (first if ties == "first" else True)
        bound = np.where(np.isfinite(reached), reached, -1.0)[kept]
        q, score, cids = q[kept], score[kept], cids.filter(pa.array(kept))
    return pa.RecordBatch.from_arrays([q_ids.take(pa.array(q)), cids, pa.array(score), pa.array(bound)], schema=_FOUND_ARROW)


def _meet(queries: DataFrame, corpus: DataFrame, large: DataFrame, k, min_score, ties, exclude_self) -> DataFrame:
    """Query blocks scored against every corpus block of their group and cell."""
    floors = [c for c in ("floors",) if c in queries.columns]
    one_group = "groups" in queries.columns
    counted = _with_blocks(queries, large, "block").withColumn(
        "target", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    )
    asked = counted.select(
        "grp", "cell", "target", F.struct("grp", "cell", "block").cast("string").alias("block_name"),
        F.col("ids").alias("qids"), F.col("raws").alias("qraws"), *floors, *[F.col("groups").alias("qgroups")] * one_group,
    )
    offered = corpus.select(
        "grp", "cell", F.col("block").alias("target"), F.col("ids").alias("cids"), F.col("raws").alias("craws"),
        *[F.col("groups").alias("cgroups")] * one_group,
    )
    met = asked.join(offered, ["grp", "cell", "target"]).drop(*[] if one_group else ["grp"], "cell", "target")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                best, asked = None, (row["qids"].values, row["qraws"].values, row["floors"].values if floors else None)
                if k is not None:
                    if len(bests) > BLOCKS_REMEMBERED:
                        bests.clear()
                    best = bests.setdefault(row["block_name"].as_py(), np.full((len(asked[0]), k), -np.inf))
                offered = row["cids"].values, row["craws"].values
                if k is not None and ties == "first":
                    offered = _lowest(*offered, k + exclude_self)
                shared = _first_shared(row["grp"].as_py(), row["qgroups"].values, row["cgroups"].values) if one_group else None
                yield from _score_block(asked, offered, best, k, min_score, ties, exclude_self, shared)

    return met.mapInArrow(score, _FOUND)


def _visits(rows: DataFrame, home: DataFrame | None, pivots: np.ndarray, radii: np.ndarray, min_score) -> DataFrame:
    """Query rows sent to each further cell that may hold a partner good enough."""
    if home is None:
        bounded = rows.withColumn("floor", F.lit(float(min_score)))
    else:
        # A block-local k-th score of any group is a lower bound for the query as a whole.
        floors = home.groupBy("qid").agg(F.max("bound").alias("floor"))
        bounded = rows.join(floors, rows["id"] == floors["qid"], "left").drop("qid")
        bounded = bounded.withColumn("floor", F.coalesce(F.col("floor"), F.lit(-1.0)))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def reachable(raws: pd.Series, cells: pd.Series, floors: pd.Series) -> pd.Series:
        out = []
        for raw, cell, floor in zip(raws, cells, floors):
            v = np.frombuffer(raw, dtype=np.float32).astype(np.float64)
            away = _angle(pivots @ v / np.linalg.norm(v))
            best = np.cos(np.maximum(0.0, away - radii))
            cells_in_reach = np.nonzero(best >= floor - SLACK)[0]
            out.append(cells_in_reach[cells_in_reach != cell].astype(np.int32))
        return pd.Series(out)

    return bounded.withColumn("cell", F.explode(reachable("raw", "cell", "floor")))


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    query_id: str,
    corpus_id: str,
    query_vector: str,
    corpus_vector: str,
    query_group: str | None = None,
    corpus_group: str | None = None,
    k: int | None = None,
    min_score: float | None = None,
    ties: str = "rank",
    exclude_self: bool = False,
    dim: int | None = None,
    block_rows: int | None = None,
    max_pivots: int = MAX_PIVOTS,
    prune_from: int = PRUNE_FROM,
) -> DataFrame:
    """``query_id, corpus_id, score, place`` of each query's most similar corpus rows.

    Give ``k`` (best partners), ``min_score`` (all partners at or above it) or both. With
    groups, only rows of equal group meet; an id may stand in several groups, and a pair
    that meets in more than one counts once. ``ties="rank"`` keeps all partners tied on the
    k-th score; ``ties="first"`` keeps exactly k, ties by corpus id. Scores are rounded to
    six decimals before ranking. Vectors that are null, all zero or of another width than
    ``dim`` take no part, nor do pairs of unequal width.
    """
    if k is None and min_score is None:
        raise ValueError("give k, min_score or both")
    if ties not in ("rank", "first"):
        raise ValueError("ties must be 'rank' or 'first'")
    bound_batches(queries.sparkSession)
    asked = _vectors(queries, query_id, query_vector, query_group, dim)
    offered = _vectors(corpus, corpus_id, corpus_vector, corpus_group, dim)
    block_rows = block_rows or _block_rows(dim)
    same = queries is corpus and query_group == corpus_group and query_id == corpus_id and query_vector == corpus_vector
    n_offered, copied = _counted(offered)
    n_asked, asked_copied = (n_offered, copied) if same else _counted(asked)
    if copied and k is not None and ties == "first":
        offered = cut_lineage(_first_copies(offered, k + exclude_self))
        n_offered = offered.count()
    members = None
    if asked_copied and k is not None and query_group is None and not exclude_self:
        vectors = asked.groupBy("grp", "vec").agg(F.count(F.lit(1)).alias("n")).drop("n")
        vectors = cut_lineage(vectors.withColumn("class", F.monotonically_increasing_id().cast("string")))
        # Equal questions may be a third of all: a hot key of this lookup.
        members = cut_lineage(lookup(asked, vectors, ["grp", "vec"], F.col("id"), how="inner").select("id", F.col("class").alias("qid")))
        asked, n_asked = vectors.withColumnRenamed("class", "id"), vectors.count()
    one_group = False
    if k is None and query_group is not None:
        with_groups = _with_groups(offered)
        asked_groups = with_groups if same else _with_groups(asked)
        one_group = with_groups is not None and asked_groups is not None
        if one_group:
            asked, offered = asked_groups, with_groups
    pivots = None
    # Pivots need vectors of one width.
    if dim is not None and n_offered * n_asked >= prune_from and _pairs(asked, offered) >= prune_from:
        pivots = _pivots(offered, block_rows, max_pivots)

    c_rows, q_rows = _placed(offered, pivots), _placed(asked, pivots)
    if pivots is not None:
        c_rows, q_rows = cut_lineage(c_rows), cut_lineage(q_rows)
    query_rows = _query_rows(block_rows)
    c_large, q_large = _large_cells(c_rows, block_rows), _large_cells(q_rows, query_rows)
    extra = ["groups"] if one_group else []
    c_blocks, q_blocks = _packed(c_rows, c_large, extra), _packed(q_rows, q_large, extra)
    found = _meet(q_blocks, c_blocks, c_large, k, min_score, ties, exclude_self)

    if pivots is not None:
        radii = np.full(len(pivots), -np.inf)
        for row in c_rows.groupBy("cell").agg(F.max("theta").alias("radius")).collect():
            radii[row["cell"]] = row["radius"]
        home = None
        if k is not None:
            found = home = cut_lineage(found)
        visits = _visits(q_rows, home, pivots, radii, min_score)
        v_blocks = _packed(visits, _large_cells(visits, query_rows), extra=["floor", *extra])
        found = found.unionByName(_meet(v_blocks, c_blocks, c_large, k, min_score, ties, exclude_self))

    pairs = found.select("qid", "cid", "score")
    if query_group is not None and not one_group:
        pairs = pairs.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    best_first = F.col("score").desc()
    order = [best_first] if ties == "rank" else [best_first, F.col("cid")]
    place = F.rank() if ties == "rank" else F.row_number()

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("place", place.over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("place") <= k)

    if k is not None:
        pairs = ranked(pairs)
    if members is not None:
        lists = pairs.groupBy("qid").agg(F.collect_list(F.struct("cid", "score")).alias("found"))
        each = lookup(members, cut_lineage(lists), ["qid"], F.col("id"), how="inner")
        # An id may come with several vectors; its best of all count.
        pairs = ranked(each.select(F.col("id").alias("qid"), F.explode("found").alias("f")).select("qid", "f.cid", "f.score"))
    names = {"query_id": "qid", "corpus_id": "cid", "score": "score", "place": "place"}
    return pairs.select(*[F.col(c).alias(n) for n, c in names.items() if c in pairs.columns])


def nearest_marked(
    queries: DataFrame, corpus: DataFrame, *, query_id: str, corpus_id: str, query_vector: str, corpus_vector: str,
    query_marks: str, corpus_marks: str, k: int, dim: int | None = None, block_rows: int | None = None,
) -> DataFrame:
    """``query_id, corpus_id, score, place``: the ``k`` best corpus rows that bear one of a query's marks, ties by id.

    Marks are arrays of strings; a query without marks finds nothing. Every corpus vector is packed into just one block.
    Only marks are exploded: each lists the blocks it occurs in, and a block of queries with the same marks visits
    just those, where rows without any of the marks are passed over.
    """
    def sorted_marks(name: str) -> Column:
        none = F.array().cast("array<string>")
        return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.col(name)))), none).alias("mark")

    bound_batches(corpus.sparkSession)
    offered = _placed(_vectors(corpus, corpus_id, corpus_vector, None, dim, sorted_marks(corpus_marks)), None)
    asked = _placed(_vectors(queries, query_id, query_vector, None, dim, sorted_marks(query_marks)), None)
    # Queries with the same marks form a group.
    asked = asked.filter(F.size("mark") > 0).withColumn("grp", F.to_json("mark")).drop("mark")
    block_rows = block_rows or _block_rows(dim)
    query_rows = _query_rows(block_rows)
    c_blocks = cut_lineage(_packed(offered, _large_cells(offered, block_rows), extra=["mark"]))
    q_blocks = cut_lineage(
        _packed(asked, _large_cells(asked, query_rows)).withColumn("wanted", F.from_json("grp", "array<string>")))
    holds = c_blocks.select(F.col("block").alias("c_block"), F.explode(F.array_distinct(F.flatten("marks"))).alias("mark"))
    wants = q_blocks.select("grp", "block", F.explode("wanted").alias("mark"))
    visits = wants.join(holds, "mark").select("grp", "block", "c_block").distinct()
    met = visits.join(q_blocks, ["grp", "block"]).select(
        "c_block", "wanted", F.struct("grp", "block").cast("string").alias("block_name"),
        F.col("ids").alias("qids"), F.col("raws").alias("qraws"),
    ).join(c_blocks.select(F.col("block").alias("c_block"), F.col("ids").alias("cids"), F.col("raws").alias("craws"), "marks"), "c_block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                marks = row["marks"].values
                bears = np.r_[0, np.cumsum(pc.is_in(marks.flatten(), value_set=row["wanted"].values).to_numpy(zero_copy_only=False))]
                ends = np.r_[0, np.cumsum(pc.list_value_length(marks).to_numpy())]
                at = pa.array(np.flatnonzero(bears[ends[1:]] > bears[ends[:-1]]))
                if len(bests) > BLOCKS_REMEMBERED:
                    bests.clear()
                asked = row["qids"].values, row["qraws"].values, None
                best = bests.setdefault(row["block_name"].as_py(), np.full((len(asked[0]), k), -np.inf))
                offered = _lowest(row["cids"].values.take(at), row["craws"].values.take(at), k)
                yield from _score_block(asked, offered, best, k, None, "first", False)

    pairs = met.mapInArrow(score, _FOUND).select("qid", "cid", "score")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("cid"))
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(
        F.col("qid").alias("query_id"), F.col("cid").alias("corpus_id"), "score", "place")
