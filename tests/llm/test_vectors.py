"""Near-duplicate vectors against brute force, with many lists, dense groups, copies and odd rows."""

import numpy as np
import pytest

import __spark_entry__ as contract
from check_oracle import compare, connect
from questline.llm import product_quantiser as pq

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, grp string"


def brute(rows, cut=pq.MIN_COSINE):
    able = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None
            for _, v, label in rows]
    unit = [np.asarray(v, dtype=float) / np.linalg.norm(np.asarray(v, dtype=float)) if ok else None
            for (_, v, _), ok in zip(rows, able, strict=True)]
    links = [{j for j in range(len(rows)) if j != i and able[i] and able[j] and rows[i][2] == rows[j][2]
              and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cut} for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def made(seed, n, width):
    """Clusters of different tightness, exact copies, and a dense group across labels."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        c = rng.integers(12)
        v = centres[c] + rng.normal(size=width) * (0.02, 0.25, 0.35, 1.0)[i % 4]
        rows.append((i, np.float32(v).tolist(), int(c % 3)))
    rows += [(n + i, rows[i % 7][1], rows[i % 7][2]) for i in range(60)]
    return rows


@pytest.mark.parametrize("seed, width, list_rows, block_rows", [(1, 24, 20, 16), (2, 10, 4096, 7), (3, 64, 50, 2048)])
def test_all_links(spark, seed, width, list_rows, block_rows):
    rows = made(seed, 400, width)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = pq.near_vectors(frame, list_rows=list_rows, block_rows=block_rows)
    want = brute(rows)
    assert sum(w[1] for w in want) > 1000
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_recall_on_small_tables(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert sorted(map(tuple, pq.near_vectors(table, list_rows=8).collect()), key=repr) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1),
            (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [2.0, 0.0], None), (None, [3.0, 0.1], 1),
            (None, None, None), (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1e-30, 0.0], 1), (None, [0.0, -1.0], 1)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert sorted(map(tuple, pq.near_vectors(frame).collect()), key=repr) == brute(rows)
    assert pq.near_vectors(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pq.near_vectors(frame, min_cosine=0.0)


def test_query_matches_sql(spark, sf):
    key = "op13_product_quantiser"
    assert compare(spark, connect(sf), contract.queries()[key], contract.oracle_sql()[key], sf) is None
