"""The vector-approximation file against brute force, and how much of it is scored exactly."""

import numpy as np
import pytest

from questline.operators import nearest as nb
from questline.operators import vector_file as vf

SCHEMA = "id string, v array<float>"


def made(seed, n, width, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return [(f"v{i:05d}", np.float32(centres[i % clusters] + rng.normal(size=width)).tolist()) for i in range(n)]


def brute(queries, corpus, k, exclude_self=False):
    want = {}
    for name, v in queries:
        v = np.float32(v).astype(float)
        scored = sorted((-round(float(v @ (w := np.float32(x).astype(float)) / np.linalg.norm(v) / np.linalg.norm(w)), 6), i)
                        for i, x in corpus if any(x) and len(x) == len(v) and not (exclude_self and i == name))
        want |= {(name, place): (i, -s) for place, (s, i) in enumerate(scored[:k], 1)}
    return want


@pytest.mark.parametrize("width, clusters, block_rows", [(64, 20, 64), (1024, 20, 4096), (5, 1, 16)])
def test_equals_brute_force_and_scores_few(spark, width, clusters, block_rows):
    corpus = made(1, 600, width, clusters)
    queries = [(f"q{i}", v) for i, (_, v) in enumerate(made(2, 30, width, clusters))]
    q, c = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(corpus, SCHEMA)
    names = dict(query_id="id", corpus_id="id", query_vector="v", corpus_vector="v")
    got = vf.nearest_coded(q, c, **names, k=4, dim=width, block_rows=block_rows)
    found = {(r["query_id"], r["place"]): (r["corpus_id"], round(r["score"], 6)) for r in got.collect()}
    want = brute(queries, corpus, 4)
    assert {p: i for p, (i, _) in found.items()} == {p: i for p, (i, _) in want.items()}
    assert all(abs(found[p][1] - want[p][1]) < 2e-6 for p in want)
    if width >= 64:
        rows = [nb._placed(nb._vectors(x, "id", "v", None, width), None) for x in (q, c)]
        share = vf.coded_candidates(*rows, 4, block_rows=block_rows).count() / (len(queries) * len(corpus))
        assert share < 0.05


def test_copies_ties_and_odd_vectors(spark):
    corpus = [(f"c{i:02d}", [1.0, 0.0, 0.0]) for i in range(30)] + [
        ("zero", [0.0] * 3), ("short", [1.0, 0.0]), ("twice", [2.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])]
    queries = [("c05", [1.0, 0.0, 0.0]), ("far", [-1.0, 0.0, 0.0])]
    q, c = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame([*corpus, ("none", None)], SCHEMA)
    names = dict(query_id="id", corpus_id="id", query_vector="v", corpus_vector="v")
    for own in (False, True):
        got = vf.nearest_coded(q, c, **names, k=3, dim=3, exclude_self=own, block_rows=8)
        found = {(r["query_id"], r["place"]): (r["corpus_id"], r["score"]) for r in got.collect()}
        assert found == brute(queries, corpus, 3, own)
    assert vf.nearest_coded(q.limit(0), c, **names, k=3, dim=3).count() == 0
    assert vf.nearest_coded(q, c.limit(0), **names, k=3, dim=3).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = (rng.normal(size=(50, 40)).astype(np.float32) for _ in range(2))
    codes, scale, left = vf.code([v.tobytes() for v in x])
    unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x.astype(float), y.astype(float))]
    off = np.abs(unit[1] @ unit[0].T - unit[1] @ (codes * scale[:, None]).T)
    assert (off <= left + 1e-6).all()
