"""Model calls by content: equal requests are asked once, and not again by a later run."""

import json

import pytest
from pyspark.sql import functions as F

from questline.operators import answered, enrich
from questline.operators.answered import asked_once, request_key
from questline.operators.lookup import hot_keys


def counting(folder, fail=None):
    """A provider whose clients write down what they are asked."""
    def provider():
        def client(model, prompts, system=None):
            if fail and any(fail in p for p in prompts):
                raise RuntimeError("no answer")
            with open(f"{folder}/asked", "a") as log:
                log.writelines(json.dumps([model, p]) + "\n" for p in prompts)
            return [f"{model} says {p}" for p in prompts]
        return client
    return provider


def asked(folder):
    try:
        with open(f"{folder}/asked") as log:
            return sorted(tuple(json.loads(line)) for line in log)
    except FileNotFoundError:
        return []


@pytest.fixture()
def rows(spark):
    data = [(1, "m", "a"), (2, "m", "a"), (3, "n", "a"), (4, "m", None), (5, None, "b"), (5, None, "b"), (6, "m", "")]
    return spark.createDataFrame(data, "id int, model string, prompt string").repartition(4)


def reply(provider):
    return lambda m, p: enrich.generate(p, m, provider)


def test_equal_requests_are_asked_once(rows, tmp_path):
    got = asked_once(rows, [[F.col("model"), F.col("prompt")]], reply(counting(tmp_path)), ["r"])
    assert sorted((x["id"], x["r"] and x["r"]["text"], x["r"] and x["r"]["error"]) for x in got.collect()) == [
        (1, "m says a", None), (2, "m says a", None), (3, "n says a", None), (4, None, None),
        (5, None, "no model given"), (5, None, "no model given"), (6, "m says ", None)]
    assert asked(tmp_path) == [("m", ""), ("m", "a"), ("n", "a")]
    assert got.columns == [*rows.columns, "r"]


def test_second_run_asks_only_what_is_new_or_failed(spark, rows, tmp_path):
    folder, request = str(tmp_path / "replies"), [[F.col("model"), F.col("prompt")]]
    flaky = asked_once(rows, request, reply(counting(tmp_path, fail="a")), ["r"], folder)
    assert {x["r"]["error"] for x in flaky.filter("prompt = 'a'").collect()} == {"RuntimeError: no answer"}
    assert asked(tmp_path) == [("m", "")]
    asked_once(rows, request, reply(counting(tmp_path)), ["r"], folder).collect()
    assert asked(tmp_path) == [("m", ""), ("m", "a"), ("n", "a")]
    more = rows.unionByName(spark.createDataFrame([(7, "m", "new")], rows.schema))
    got = asked_once(more, request, reply(counting(tmp_path)), ["r"], folder)
    assert {x["r"]["text"] for x in got.filter("model = 'm' and prompt != ''").collect()} == {"m says a", "m says new"}
    assert asked(tmp_path) == [("m", ""), ("m", "a"), ("m", "new"), ("n", "a")]
    assert asked_once(rows.limit(0), request, reply(counting(tmp_path)), ["r"], folder).count() == 0


def test_keys_tell_null_and_empty_apart(spark):
    frame = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", None), (None, "a")], "x string, y string")
    keys = [r[0] for r in frame.select(request_key([F.col("x"), F.col("y")])).collect()]
    assert len(set(keys)) == 4


def test_texts_and_vectors_of_a_job(spark, tmp_path):
    statements = spark.createDataFrame([(str(i), f"select {i % 2}", "m") for i in range(10)],
                                       "statement_id string, statement_text string, extraction_model string")
    got = enrich.with_generated_text(statements, counting(tmp_path), folder=str(tmp_path / "t"))
    assert got.count() == 10 and len(asked(tmp_path)) == 4
    first = enrich.with_embeddings(got, enrich.hashed_words_provider(8), "hash", str(tmp_path / "v"))
    assert first.filter("size(question_embeddings) = 8 and size(statement_embeddings) = 8").count() == 10

    def broken():
        raise AssertionError("asked again")

    again = enrich.with_embeddings(got, broken, "hash", str(tmp_path / "v"))
    assert again.exceptAll(first).count() == 0


def test_hot_requests_are_found_before_any_join(spark, rows, monkeypatch, tmp_path):
    """The second request's hot keys are looked for in the rows, not in their join with the first one's replies."""
    plans, found = [], hot_keys

    def watched(left, on, *more):
        plans.append(left._jdf.queryExecution().optimizedPlan().toString())
        return found(left, on, *more)

    monkeypatch.setattr(answered, "hot_keys", watched)
    got = asked_once(rows, [[F.col("model"), F.col("prompt")], [F.lit("x"), F.col("prompt")]], reply(counting(tmp_path)), ["a", "b"]).collect()
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    assert sorted((r.id, r.a and r.a.text, r.b and r.b.text) for r in got if r.id < 4) == [
        (1, "m says a", "x says a"), (2, "m says a", "x says a"), (3, "n says a", "x says a")]
