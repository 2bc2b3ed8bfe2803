import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from questline import fixtures as fx
from questline.operators import answering, enrich
from questline.plans import answer, ingest, train
from questline.plans import store as names
from questline.plans.store import Store
from questline.sources.tables import preview_json_lines, save
from questline.sources.published import current
from questline.streaming.refresh import drop_merged, read_index, refresh, runs


def test_one_bad_row_fails_alone(spark):
    def failing_provider():
        def client(model, prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no answer")
            return [f"{model}:{p}" for p in prompts]
        return client

    frame = spark.createDataFrame([("good", "m1"), ("bad", "m1"), (None, "m1"), ("fine", "m2")], "p string, m string").coalesce(1)
    got = frame.select("p", enrich.generate(F.col("p"), F.col("m"), failing_provider).alias("r")).collect()
    assert [(r["p"], r["r"]["text"], r["r"]["error"]) for r in got] == [
        ("good", "m1:good", None), ("bad", None, "RuntimeError: no answer"), (None, None, None), ("fine", "m2:fine", None)]


def test_calls_are_bounded(spark):
    def provider():
        def client(model, prompts):
            assert len(prompts) <= 4
            return [str(len(prompts))] * len(prompts)
        return client

    frame = spark.range(10).coalesce(1).select(F.col("id").cast("string").alias("p"))
    got = frame.select(enrich.generate(F.col("p"), F.lit("m"), provider, rows_per_call=4).alias("r")).collect()
    assert sorted(r["r"]["text"] for r in got) == ["2"] * 2 + ["4"] * 8


def test_generated_text_depends_on_every_word(spark):
    words = " ".join(f"w{i}" for i in range(200))
    frame = spark.createDataFrame([("a", words, "m"), ("b", words + "0", "m")],
                                  "statement_id string, statement_text string, extraction_model string")
    one, two = enrich.with_generated_text(frame, enrich.whole_text_provider).orderBy("statement_id").collect()
    assert one["manual_summarization"].startswith('"21') and '"' not in one["generated_question"]
    assert one["manual_summarization"] != two["manual_summarization"]
    assert one["generated_question"] != two["generated_question"]


def test_system_text_is_an_argument_of_its_own(spark):
    def provider():
        return lambda model, prompts, system=None: [f"{model}/{system}/{p}" for p in prompts]

    frame = spark.createDataFrame([("p", "s"), ("q", None), (None, "s")], "full_prompt string, system_prompt string")
    assert [r["sql"] for r in answering.answers(frame.coalesce(1), provider, "m").collect()] == ["m/s/p", "m/None/q", None]
    assert [r["sql"] for r in answering.answers(frame.drop("system_prompt").coalesce(1), provider, "m").collect()] == [
        "m/None/p", "m/None/q", None]


def test_hashed_words(spark):
    client = enrich.hashed_words_provider(16)()
    vectors = client(["Select a", "a  SELECT", "", "other"])
    assert np.allclose(vectors[0], vectors[1]) and not vectors[2].any()
    assert np.linalg.norm(vectors[3]) == pytest.approx(1.0)
    frame = spark.createDataFrame([("x",), (None,)], "t string").coalesce(1)
    got = [r[0] for r in frame.select(enrich.embed(F.col("t"), enrich.hashed_words_provider(16))["vector"]).collect()]
    assert len(got[0]) == 16 and got[1] is None


def test_filters(spark):
    frame = spark.createDataFrame([(1, ["s"], ["t"]), (2, None, ["t", "t", "u"]), (3, [], None)],
                                  "question_id int, schema_filter array<string>, table_filter array<string>")
    got = {r["question_id"]: (r["schema_filter"], r["table_filter"]) for r in answering.with_filters(frame).collect()}
    assert got == {1: (["s"], []), 2: ([], ["t", "u"]), 3: ([], [])}
    scalar = spark.createDataFrame([(1, "t"), (2, None)], "question_id int, table_filter string")
    assert [r["table_filter"] for r in answering.with_filters(scalar).orderBy("question_id").collect()] == [["t"], []]


@pytest.fixture(scope="module")
def past(spark):
    return spark.createDataFrame(
        [("a", "qa", "sa", "ma", ["c.s"], ["c.s.t"], [1.0, 0.0]), ("b", "qb", "sb", "mb", ["c.r"], ["c.r.u", "c.s.t"], [1.0, 0.2]),
         ("n", "qn", "sn", "mn", None, None, [1.0, 0.1])],
        "statement_id string, generated_question string, statement_text string, manual_summarization string,"
        " schema_list array<string>, table_list array<string>, question_embeddings array<float>")


def test_retrieval_filters_and_mining(spark, past):
    questions = answering.with_filters(spark.createDataFrame(
        [("all", "p", [1.0, 0.0], None, None), ("schema", "p", [1.0, 0.0], ["c.r"], ["c.s.t"]),
         ("table", "p", [1.0, 0.0], None, ["c.s.t"]), ("lost", "p", [1.0, 0.0], ["x.y"], None)],
        "question_id string, prompt string, question_embeddings array<float>, schema_filter array<string>, table_filter array<string>"))
    hits = answering.retrieve(questions, past, k=2, dim=2)
    found = {}
    for r in hits.orderBy("place").collect():
        found.setdefault(r["question_id"], []).append(r["statement_id"])
    assert found == {"all": ["a", "n"], "schema": ["b"], "table": ["a", "b"]}
    mined = {r["question_id"]: r for r in answering.mine(questions, hits).collect()}
    assert mined["all"]["tables"] == ["c.s.t"] and mined["schema"]["tables"] == ["c.r.u", "c.s.t"]
    assert mined["table"]["tables"] == ["c.s.t"]
    assert mined["lost"]["tables"] == [] and mined["lost"]["sample_queries"] == []
    assert [s["sql"] for s in mined["table"]["sample_queries"]] == ["sa", "sb"]


def test_completion_answers(spark):
    def provider():
        return lambda model, prompts: ['{"candidates":[{"text":"select 1;"}]}' for _ in prompts]
    frame = spark.createDataFrame([("q", "full")], "question_id string, full_prompt string")
    row = answering.answers(frame, provider, "m", completion=True).first()
    assert row["sql"] == "select 1;" and row["answer_error"] is None


def test_jobs_end_to_end(spark, sf, tmp_path):
    store = Store(spark, root=str(tmp_path / "store"))
    log = fx.history(spark, sf)
    embed = enrich.hashed_words_provider(32)
    ingest.ingest_catalog(store, fx.tables(spark, sf), fx.columns(spark, sf))
    statements = ingest.ingest_history(store, log, enrich.whole_text_provider, embed)
    assert statements.count() == store.read(names.SUMMARIES).count() > 0
    assert set(log.columns) < set(store.read(names.DISTINCT_RUNS).columns)
    rows = train.build_training_set(store, dim=32, ties="first", json_folder=str(tmp_path / "pairs"))
    assert preview_json_lines(spark, str(tmp_path / "pairs")).count() == min(5, rows.count())
    questions = spark.createDataFrame([("1", "count orders", None), ("2", "list items", "sales.main.orders_1")],
                                      "question_id string, prompt string, table_filter string")
    got = answer.answer_questions(store, questions, enrich.whole_text_provider, embed, "m", dim=32).collect()
    assert {r["question_id"] for r in got} == {"1", "2"} and all(r["sql"] for r in got)
    plain = answer.answer_questions(store, questions.drop("table_filter"), enrich.whole_text_provider, embed, "m",
                                    dim=32, filtered=False, system=None)
    assert plain.count() == 2 and "system_prompt" not in plain.columns


def test_model_extraction(spark, sf, tmp_path):
    store = Store(spark, root=str(tmp_path / "store"))
    ingest.ingest_catalog(store, fx.tables(spark, sf), fx.columns(spark, sf))

    def provider():
        return lambda model, prompts: ['{"tables": ["Orders\\_3"]}' if "orders_3" in p.lower() else "?" for p in prompts]
    ingest.ingest_history(store, fx.history(spark, sf), provider, enrich.hashed_words_provider(8), model_extraction=True)
    lists = {tuple(r["table_list"]) for r in store.read(names.RESOLVED).collect()}
    assert lists == {("sales.main.orders_3",)}


def test_catalog_keys_are_checked(spark, sf, tmp_path):
    store = Store(spark, root=str(tmp_path / "store"))
    twice = fx.tables(spark, sf)
    twice = twice.unionByName(twice.withColumn("comment", F.lit("again")))
    with pytest.raises(ValueError, match="full_table"):
        ingest.ingest_catalog(store, twice, fx.columns(spark, sf))


def test_save_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.range(3)
    assert save(frame, path, "errorifexists").count() == 3
    assert save(frame, path, "append").count() == 6
    assert save(frame, path).count() == 3
    with pytest.raises(Exception):
        save(frame, path, "errorifexists")


def test_refresh_is_incremental_and_replay_safe(spark, tmp_path):
    landing, index, progress = (str(tmp_path / n) for n in ("landing", "index", "progress"))
    embed = enrich.hashed_words_provider(8)

    def land(*rows):
        spark.createDataFrame(rows, "k string, t string, v int").coalesce(1).write.mode("append").parquet(landing)

    def go(where=progress):
        refresh(spark, landing, "k string, t string, v int", index, where, "k", "t", "v", embed)
        return {r["k"]: (r["t"], r["v"], len(r["embedding"])) for r in read_index(spark, index, "k", "v").collect()}

    land(("a", "one", 0), ("b", "two", 0), ("a", "newer", 1))
    assert go() == {"a": ("newer", 1, 8), "b": ("two", 0, 8)}
    land(("b", "three", 2), ("a", "late old", 0))
    want = {"a": ("newer", 1, 8), "b": ("three", 2, 8)}
    assert go() == want and runs(spark, index) == [(0, 1)]
    assert go() == want
    written = sorted(os.listdir(index))
    # The last batch fails after its write: its commit is missing, so it runs again.
    for name in ("1", ".1.crc"):
        os.remove(f"{progress}/commits/{name}")
    before = current(spark, f"{index}/run-0-1")
    assert go() == want and sorted(os.listdir(index)) == written and current(spark, f"{index}/run-0-1") == before
    with pytest.raises(ValueError):
        go(str(tmp_path / "other"))


def test_index_stays_in_levels_and_forgets_deleted_keys(spark, tmp_path):
    landing, index, progress = (str(tmp_path / n) for n in ("landing", "index", "progress"))
    calls = enrich.hashed_words_provider(8)
    shape, want = "k int, t string, v int, gone boolean", {}
    rows = []
    for v in range(13):
        for k in {v, v // 2, 3}:
            gone = (k + v) % 5 == 0
            rows.append((k, f"text {k} {v}", v, gone))
            want[k] = None if gone else (f"text {k} {v}", v)
    for v in range(13):
        spark.createDataFrame([r for r in rows if r[2] == v], shape).coalesce(1).write.mode("append").parquet(landing)
    refresh(spark, landing, shape, index, progress, "k", "t", "v", calls, files_per_batch=1, deleted="gone")
    live = runs(spark, index)
    assert live == [(0, 7), (8, 11), (12, 12)]
    got = read_index(spark, index, "k", "v", "gone")
    assert got.columns == ["k", "v", "t", "embedding", "embedding_error"]
    expected = {k: x for k, x in want.items() if x}
    assert len(expected) < len(want)
    vectors = {k: calls()([x[0]])[0] for k, x in expected.items()}
    found = {r["k"]: ((r["t"], r["v"]), r["embedding"]) for r in got.collect()}
    assert {k: x[0] for k, x in found.items()} == expected
    assert all(np.allclose(found[k][1], vectors[k]) for k in vectors)
    assert drop_merged(spark, index) > 0 and runs(spark, index) == live
    assert read_index(spark, index, "k", "v", "gone").count() == len(expected)
    # A late row of an older version does not bring a deleted key back.
    dead = next(k for k, x in want.items() if x is None)
    spark.createDataFrame([(dead, "late", -1, False)], shape).write.mode("append").parquet(landing)
    refresh(spark, landing, shape, index, progress, "k", "t", "v", calls, deleted="gone")
    assert {r["k"] for r in read_index(spark, index, "k", "v", "gone").collect()} == set(expected)
