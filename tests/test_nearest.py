"""The neighbour join against brute force, with cells, blocks, groups, copies and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plan_text import plan_of
from questline import queries
from questline.functions.vectors import cosine
from questline.operators import nearest as nb
from questline.operators import training
from questline.operators.lookup import lookup

SCHEMA = "id string, grp string, v array<float>"


def rows(n, dim, seed, groups=1, clusters=6, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 2
    vectors = (centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 0.3).astype(np.float32)
    vectors[:copies] = vectors[0]
    return [(f"{seed}-{i:04d}", f"g{i % groups}", [float(x) for x in v]) for i, v in enumerate(vectors)]


def brute(queries, corpus, k=None, min_score=None, ties="rank", exclude_self=False, grouped=True):
    c = np.array([r[2] for r in corpus], dtype=np.float32).astype(float)
    c_len = np.linalg.norm(c, axis=1)
    out = {}
    by_query = {}
    for qid, grp, v in queries:
        v = np.array(v, dtype=np.float32).astype(float)
        scores = nb._round(c @ v / (c_len * np.linalg.norm(v)))
        for (cid, cgrp, _), s in zip(corpus, scores):
            if (not grouped or cgrp == grp) and not (exclude_self and cid == qid) and (min_score is None or s >= min_score):
                by_query.setdefault(qid, {})[cid] = float(s)
    for qid, found in by_query.items():
        ordered = sorted(found.items(), key=lambda x: (-x[1], x[0]))
        if k is not None:
            if ties == "first" or len(ordered) <= k:
                ordered = ordered[:k]
            else:
                ordered = [x for x in ordered if x[1] >= ordered[k - 1][1]]
        out[qid] = dict(ordered)
    return out


def run(spark, queries, corpus, grouped=True, **args):
    q, c = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(corpus, SCHEMA)
    group = "grp" if grouped else None
    found = nb.nearest(q, c, query_id="id", corpus_id="id", query_vector="v", corpus_vector="v",
                       query_group=group, corpus_group=group, **args)
    out = {}
    for r in found.collect():
        out.setdefault(r["query_id"], {})[r["corpus_id"]] = r["score"]
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert got[q].keys() == want[q].keys(), q
        assert all(abs(got[q][c] - want[q][c]) < 2e-6 for c in want[q])


CELLS = dict(dim=8, block_rows=16, max_pivots=12, prune_from=0)
PLAIN = dict(dim=8, block_rows=16)


@pytest.mark.parametrize("layout", [PLAIN, CELLS], ids=["blocks", "cells"])
@pytest.mark.parametrize("args", [
    dict(k=3), dict(k=3, ties="first"), dict(min_score=0.95), dict(k=2, min_score=0.9),
], ids=["top", "top-first", "threshold", "both"])
def test_separate_sides(spark, layout, args):
    queries, corpus = rows(70, 8, 1, groups=2), rows(1200, 8, 2, groups=2)
    close(run(spark, queries, corpus, **args, **layout), brute(queries, corpus, **args))


@pytest.mark.parametrize("layout", [PLAIN, CELLS], ids=["blocks", "cells"])
@pytest.mark.parametrize("ties", ["rank", "first"])
def test_self_join_with_copies(spark, layout, ties):
    data = rows(900, 8, 3, copies=40)
    args = dict(k=3, ties=ties, exclude_self=True)
    close(run(spark, data, data, **args, **layout), brute(data, data, **args))


def test_ungrouped(spark):
    queries, corpus = rows(30, 8, 4, groups=3), rows(600, 8, 5, groups=3)
    close(run(spark, queries, corpus, grouped=False, k=4, ties="first", **CELLS),
          brute(queries, corpus, k=4, ties="first", grouped=False))


def test_cells_leave_work_out(spark):
    queries, corpus = rows(50, 8, 6), rows(2000, 8, 7)
    c = spark.createDataFrame(corpus, SCHEMA).select("id", "grp", F.col("v").alias("vec"))
    pivots = nb._pivots(c, 16, 12)
    q = nb._placed(spark.createDataFrame(queries, SCHEMA).select("id", "grp", F.col("v").alias("vec")), pivots)
    placed = nb._placed(c, pivots)
    radii = np.full(len(pivots), -np.inf)
    for r in placed.groupBy("cell").agg(F.max("theta").alias("t")).collect():
        radii[r["cell"]] = r["t"]
    visits = nb._visits(q, None, pivots, radii, min_score=0.99).count()
    assert 2 <= len(pivots) <= 12 and visits < len(queries) * (len(pivots) - 1) / 2


def test_a_pair_in_two_groups_counts_once(spark):
    data = [(i, g, v) for i, _, v in rows(20, 8, 8) for g in ("a", "b")]
    got = run(spark, data, data, k=3, exclude_self=True, dim=8)
    want = brute([(i, "a", v) for i, g, v in data if g == "a"], [(i, "a", v) for i, g, v in data if g == "a"],
                 k=3, exclude_self=True)
    close(got, want)


def test_unusable_vectors_take_no_part(spark):
    data = [("a", "g", [1.0, 0.0]), ("b", "g", [1.0, 0.1]), ("zero", "g", [0.0, 0.0]), ("null", "g", None), ("wide", "g", [1.0, 0.0, 0.0])]
    assert run(spark, data, data, k=5, exclude_self=True, dim=2).keys() == {"a", "b"}
    loose = run(spark, data, data, k=5)
    assert loose["wide"].keys() == {"wide"} and loose["a"].keys() == {"a", "b"}


def test_arguments(spark):
    with pytest.raises(ValueError):
        run(spark, [], [], dim=2)
    with pytest.raises(ValueError):
        run(spark, [], [], k=1, ties="some", dim=2)


def statements(spark, data):
    return spark.createDataFrame(
        data, "statement_id string, table_list array<string>, question_embeddings array<float>, generated_question string, statement_text string")


def test_matches_need_a_shared_table(spark):
    data = [("a", ["t", "u"], [1.0, 0.0], "qa", "sa"), ("b", ["u"], [1.0, 0.1], "qb", "sb"), ("c", ["v"], [1.0, 0.0], "qc", "sc"),
            ("d", [], [1.0, 0.0], "qd", "sd"), ("e", None, [1.0, 0.0], "qe", "se"), ("f", ["t"], [1.0], "qf", "sf")]
    frame = statements(spark, data)
    got = {(r["statement_id"], r["top_compared_questions"]["compared_statement_id"]) for r in training.top_matches(frame, dim=2).collect()}
    assert got == {("a", "b"), ("b", "a")}
    pairs = {(r[0], r[1]) for r in training.similar_pairs(frame, -1.0, dim=2).collect()}
    assert pairs == got and pairs == {(b, a) for a, b in pairs}


def test_ranks_start_at_one_and_keep_ties(spark):
    data = [("q", ["t"], [1.0, 0.0], "", "")] + [(f"n{i}", ["t"], [1.0, 0.5], "", "") for i in range(5)]
    got = [r for r in training.top_matches(statements(spark, data), k=3, dim=2, ties="rank").collect() if r["statement_id"] == "q"]
    assert [r["question_similarity_rank"] for r in got] == [1] * 5
    first = training.top_matches(statements(spark, data), k=3, dim=2, ties="first").collect()
    assert [r["top_compared_questions"]["compared_statement_id"] for r in first if r["statement_id"] == "q"] == ["n0", "n1", "n2"]


def test_no_row_level_pairing_in_the_plan(spark):
    frame = statements(spark, [("a", ["t"], [1.0, 0.0], "", "")])
    plan = plan_of(training.top_matches(frame, dim=2))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_training_rows(spark):
    frame = statements(spark, [("a", ["c.s.t"], [1.0, 0.0], "qa", "sa"), ("b", ["c.s.t", "c.s.u"], [1.0, 0.1], "qb", "sb"),
                               ("x", ["c.s.lost"], [1.0, 0.0], "qx", "sx"), ("y", ["c.s.lost"], [1.0, 0.0], "qy", "sy")])
    tables = spark.createDataFrame([("c.s.t", None, "  i INT"), ("c.s.u", None, "  j INT")],
                                   "full_table string, comment string, column_description_list string")
    rows_ = training.training_rows(training.top_matches(frame, dim=2), frame, tables)
    got = {r["statement_id"]: r for r in rows_.collect()}
    assert got.keys() == {"a", "b"}
    assert "CREATE TABLE c.s.t" in got["a"]["full_prompt"] and "CREATE TABLE c.s.u" in got["a"]["full_prompt"]
    assert "CREATE TABLE c.s.u" not in got["b"]["full_prompt"]
    assert "/*\nqb\n*/\nsb" in got["a"]["full_prompt"] and "/*\nqa\n*/" in got["a"]["full_prompt"]
    assert got["a"]["response"] == "sa"
    assert {r[0] for r in training.without_prompt(frame, rows_).select("statement_id").collect()} == {"x", "y"}


@pytest.mark.parametrize("prune_from", [0, 10**10])
def test_vectors_with_odd_elements_take_no_part(spark, prune_from):
    rng = np.random.default_rng(3)
    good = [(f"g{i:03}", rng.normal(size=8).tolist()) for i in range(300)]
    odd = [("nan", [float("nan")] + [1.0] * 7), ("inf", [float("inf")] + [1.0] * 7), ("null", [None] + [1.0] * 7)]
    schema = "id string, vec array<double>"
    rows, clean = spark.createDataFrame(good + odd, schema), spark.createDataFrame(good, schema)

    def found(corpus):
        hits = nb.nearest(corpus, corpus, query_id="id", query_vector="vec", corpus_id="id", corpus_vector="vec",
                          k=3, ties="first", dim=8, block_rows=64, prune_from=prune_from)
        return sorted(tuple(r) for r in hits.collect())

    assert found(rows) == found(clean) and len(found(clean)) >= 900


def test_cosine_of_odd_elements_is_null(spark):
    rows = spark.createDataFrame(
        [([1.0, float("nan")],), ([1.0, float("inf")],), ([1.0, None],), ([0.0, 0.0],)], "v array<double>")
    one = F.array(F.lit(1.0), F.lit(2.0))
    assert [r[0] for r in rows.select(cosine(F.col("v"), one)).collect()] == [None] * 4


def test_train_set_takes_three_samples_of_equal_questions(spark, monkeypatch):
    """Among equal questions the lowest ids are samples, as row_number() in the SQL of train_set takes them."""
    vector = [1.0] + [0.0] * (queries.DIM - 1)
    frame = statements(spark, [(f"n{i}", ["c.s.t"], vector, f"question {i}", f"sql {i}") for i in range(8)])
    tables = spark.createDataFrame([("c.s.t", None, "  i INT")], "full_table string, comment string, column_description_list string")
    monkeypatch.setattr(queries.fx, "statements", lambda *_: frame)
    monkeypatch.setattr(queries, "_table_rows", lambda *_: tables)
    prompts = {r["statement_id"]: r["full_prompt"] for r in queries.train_set(spark, "unused").collect()}
    for i in range(8):
        samples = {j for j in range(8) if f"\nsql {j}" in prompts[f"n{i}"]}
        assert samples == set([j for j in range(8) if j != i][:3])


def test_classes_of_equal_questions_are_linear(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i:05d}", [1.0, 0.0, 0.5, 0.25], ["a.b.t"]) for i in range(5000)]
    rows += [(f"o{i:03d}", [float(x) for x in rng.normal(size=4)], ["a.b.t"]) for i in range(30)]
    rows += [("twin", [2.0, 0.0, 1.0, 0.5], ["a.b.t", "a.b.u"]), ("none", [1.0, 0.0, 0.5, 0.25], [])]
    frame = spark.createDataFrame(rows, "statement_id string, question_embeddings array<float>, table_list array<string>")
    classes, members = training.match_classes(frame, 4)
    found = training.class_matches(classes, dim=4)
    assert members.count() == 5031 and classes.count() == 32
    ranked = {(r["class_id"], r["compared_class_id"]): (r["n_compared"], r["question_similarity_rank"]) for r in found.collect()}
    assert len(ranked) < 150
    assert ranked["s00000", "s00000"] == (4999, 1) and ranked["s00000", "twin"] == (1, 1)
    assert not [other for one, other in ranked if one == "s00000" and other.startswith("o")]
    assert ranked["twin", "s00000"] == (5000, 1) and len([1 for one, _ in ranked if one == "twin"]) == 1


def test_ties_by_rank_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = [[float(x) for x in rng.normal(size=3)] for _ in range(6)]
    rows = [(f"s{i:02d}", base[i % 6], [["t"], ["t", "u"], ["u"]][i % 3]) for i in range(40)]
    frame = spark.createDataFrame(rows, "statement_id string, question_embeddings array<float>, table_list array<string>")
    got = {(r["statement_id"], r["c"], r["question_similarity_rank"]) for r in training.top_matches(frame, dim=3, ties="rank").select(
        "statement_id", F.col("top_compared_questions.compared_statement_id").alias("c"), "question_similarity_rank").collect()}
    want = set()
    for i, v, t in rows:
        v32 = np.float32(v).astype(float)
        scores = {j: round(float(v32 @ (w := np.float32(x).astype(float)) / np.linalg.norm(v32) / np.linalg.norm(w)), 6)
                  for j, x, u in rows if j != i and set(t) & set(u)}
        for j, score in scores.items():
            rank = 1 + sum(other > score for other in scores.values())
            if rank <= 3:
                want.add((i, j, rank))
    assert got == want


def test_marked_search_equals_brute_force_and_keeps_vectors_once(spark):
    rng = np.random.default_rng(7)
    marks = ["a", "b", "c", "rare"]
    corpus = [(f"c{i:03d}", [float(x) for x in rng.normal(size=8)], [m for m in marks[:3] if rng.random() < 0.4] + (["rare"] if i == 77 else []))
              for i in range(300)] + [("copy", [0.0] * 8, ["a"]), ("null", [1.0] * 8, None)]
    corpus += [(f"d{i:03d}", corpus[0][1], ["a"]) for i in range(20)]
    queries = [(f"q{i:02d}", [float(x) for x in rng.normal(size=8)], [["a"], ["b", "c"], ["rare"], ["absent"], []][i % 5]) for i in range(50)]
    schema = "id string, v array<float>, m array<string>"
    q, c = spark.createDataFrame(queries, schema), spark.createDataFrame(corpus, schema)
    found = nb.nearest_marked(q, c, query_id="id", corpus_id="id", query_vector="v", corpus_vector="v",
                              query_marks="m", corpus_marks="m", k=3, dim=8, block_rows=16)
    plan = plan_of(found)
    got = {(r["query_id"], r["place"]): r["corpus_id"] for r in found.collect()}
    want = {}
    for name, v, wanted in queries:
        v = np.float32(v).astype(float)
        scored = sorted((-round(float(v @ (w := np.float32(x).astype(float)) / np.linalg.norm(v) / np.linalg.norm(w)), 6), i)
                        for i, x, m in corpus if m and set(m) & set(wanted) and any(x))
        want |= {(name, place): i for place, (_, i) in enumerate(scored[:3], 1)}
    assert got == want
    assert plan.count("Generate explode") == 2  # of names only; vectors are read from the written blocks
    assert all("raw" not in line and "vec" not in line for line in plan.splitlines() if "Generate explode" in line)


def test_hot_key_is_never_in_one_task_without_broadcasts(spark):
    left = spark.range(10_000).select(F.when(F.col("id") % 5 < 2, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.range(10_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([("hot", -1)], "k string, v long"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    try:
        joined = lookup(left, right, ["k"], F.col("id"), hot_rows=100)
        plan = plan_of(joined)
        sizes = [r["n"] for r in joined.filter("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("v").alias("n")).collect()]
        assert joined.filter("v is null").count() == 0
    finally:
        for key, value in keep.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 4000 and max(sizes) <= 600
    assert "hashpartitioning(k" in plan and plan.index("_salt") < plan.index("Exchange hashpartitioning")


def test_copies_are_left_out_before_blocks_meet(spark, monkeypatch):
    """Most vectors are copies: only the lowest ids of each are packed, equal questions are asked once, the answer is the same."""
    base = rows(12, 8, 11)
    corpus = [(f"c{i:04d}", "g", base[i % 12][2]) for i in range(600)]
    asked = [(f"q{i:03d}", "g", base[i % 3][2]) for i in range(90)]
    packed = []
    pack = nb._packed
    monkeypatch.setattr(nb, "_packed", lambda rows, *args, **more: packed.append(rows.count()) or pack(rows, *args, **more))
    args = dict(k=4, ties="first")
    close(run(spark, asked, corpus, grouped=False, dim=8, block_rows=16, **args), brute(asked, corpus, grouped=False, **args))
    assert packed == [12 * 4, 3]


def test_repeated_questions_keep_their_rows(spark):
    """Rows of an id that comes twice, with one vector or with two, are all answered, as without copies."""
    base = rows(6, 8, 12)
    corpus = [(f"c{i:02d}", "g", v) for i, (_, _, v) in enumerate(base)]
    asked = [(f"q{i:02d}", "g", base[i % 2][2]) for i in range(20)] + [("q00", "g", base[0][2]), ("q01", "g", base[0][2])]
    args = dict(query_id="id", corpus_id="id", query_vector="v", corpus_vector="v", k=2, ties="first", dim=8)
    q, c = spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(corpus, SCHEMA)
    got = sorted((r["query_id"], r["place"], r["corpus_id"]) for r in nb.nearest(q, c, **args).collect())
    alone = [(r["query_id"], r["place"], r["corpus_id"]) for name in ("q02", "q03")
             for r in nb.nearest(q.filter(F.col("id") == name), c, **args).collect()]
    best = {name: [c for n, _, c in sorted(alone) if n == name] for name in ("q02", "q03")}
    assert [c for n, _, c in got if n == "q02"] == best["q02"] and [c for n, _, c in got if n == "q05"] == best["q03"]
    assert [c for n, _, c in got if n == "q00"] == [best["q02"][0]] * 2
    assert [c for n, _, c in got if n == "q01"] == sorted([best["q02"][0], best["q03"][0]])


def test_pairs_of_a_threshold_are_handed_on_by_one_group_without_a_shuffle(spark):
    data = [(i, g, v) for i, _, v in rows(60, 8, 13) for g in ("a", "b", "c")[int(i[-1]) % 2:]]
    frame = spark.createDataFrame(data, SCHEMA)
    found = nb.nearest(frame, frame, query_id="id", corpus_id="id", query_vector="v", corpus_vector="v", query_group="grp",
                       corpus_group="grp", min_score=0.5, exclude_self=True, dim=8, block_rows=16)
    plan = plan_of(found)
    assert plan.index("MapInArrow") < plan.index("Exchange")  # pairs aren't shuffled any more
    got = [(r["query_id"], r["corpus_id"]) for r in found.collect()]
    want = brute([r for r in data if r[1] == "b"], [r for r in data if r[1] == "b"], min_score=0.5, exclude_self=True)
    assert len(got) == len(set(got)) and set(got) == {(q, c) for q in want for c in want[q]}
    twice = spark.createDataFrame(data + data[:3], SCHEMA)  # an id stands in a group twice
    again = nb.nearest(twice, twice, query_id="id", corpus_id="id", query_vector="v", corpus_vector="v", query_group="grp",
                       corpus_group="grp", min_score=0.5, exclude_self=True, dim=8, block_rows=16)
    assert {(r[0], r[1]) for r in again.collect()} >= set(got)


@pytest.mark.parametrize("width", [3, 64, 200, 4096])
@pytest.mark.parametrize("k", [None, 1, 4])
def test_candidates_hold_all_that_may_win_and_little_else(width, k):
    """Also with ties, NaN, rows without any score and high floors; crowded blocks are cut by the maxima of column groups."""
    pick = np.random.default_rng(width)
    rough = np.round(pick.uniform(-1, 1, (50, width)), 3).astype(np.float32)
    rough[3, :] = -np.inf
    rough[4, ::2] = np.nan
    rough[5, :] = 0.5
    rough[6, -1] = 1
    floor = np.where(np.arange(50) % 2, 0.9, -np.inf)
    slices = list(nb._candidates(rough, floor, k))
    got = {(int(i), int(j)) for r, c in slices for i, j in zip(r, c)}
    assert all(np.all(np.diff(r) >= 0) for r, _ in slices) and len(got) == sum(len(r) for r, _ in slices)
    known = np.where(np.isnan(rough), -np.inf, rough).astype(float)
    for i, row in enumerate(known):
        kth = np.sort(row)[-k] if k is not None and k <= width else -np.inf
        assert {(i, int(j)) for j in np.flatnonzero((row > -2) & (row >= max(kth, floor[i])))} <= got
    assert all(known[i, j] >= max(floor[i], -2) - 1e-4 for i, j in got)


def test_batches_of_blocks_are_small(spark):
    """A row that meets another is two blocks of vectors: batches of them are bounded by bytes, so a worker holds few."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    some = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.5])], "id string, vec array<float>")
    nb.nearest(some, some, query_id="id", corpus_id="id", query_vector="vec", corpus_vector="vec", k=1)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
