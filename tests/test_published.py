"""Tables published as versions, and landed lines that are no pages."""

import json

import pytest
from pyspark.sql import functions as F

from questline.plans import ingest
from questline.plans import store as names
from questline.plans.store import Store
from questline.sources import history_pages as pages
from questline.sources.published import current, drop_old, publish, read_published


def test_reader_sees_the_old_table_during_a_failed_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    publish(spark.range(5), path)
    pinned = read_published(spark, path)
    with pytest.raises(Exception):
        publish(spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id")), path)
    assert read_published(spark, path).count() == pinned.count() == 5
    publish(spark.range(7), path)
    assert read_published(spark, path).count() == 7 and pinned.count() == 5
    assert drop_old(spark, path) == 2 and read_published(spark, path).count() == 7


def test_a_job_may_replace_what_it_reads(spark, tmp_path):
    store = Store(spark, root=str(tmp_path))
    store.save(spark.range(4), "t")
    assert store.save(store.read("t").filter("id > 1"), "t").count() == 2
    assert store.save(spark.range(1), "t", "append").count() == 3
    with pytest.raises(ValueError):
        store.save(spark.range(1), "t", "errorifexists")
    assert store.read("t").count() == 3 and store.save(spark.range(2), "new", "errorifexists").count() == 2
    with pytest.raises(FileNotFoundError):
        store.read("absent")
    assert current(spark, str(tmp_path / "absent")) is None


def page(number):
    return json.dumps({"page_no": number, "res": [{"query_id": f"q{number}", "query_text": "select 1"}], "has_next_page": True})


def test_broken_pages_are_set_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [page(i) for i in range(9)] + ['{"page_no": 9, "res": [{"query_id": ']
    (tmp_path / "in" / "a.json").write_text("\n".join(lines[:5]) + "\n")
    (tmp_path / "in" / "b.json").write_text("\n".join(lines[5:]) + "\n")
    assert pages.read_pages(spark, str(tmp_path / "in")).count() == 9
    store = Store(spark, root=str(tmp_path / "store"))
    assert ingest.land_history(store, str(tmp_path / "in"), max_broken=0.2).count() == 9
    (lost,) = store.read(names.BROKEN_PAGES).collect()
    assert lost["line"] == lines[9] and lost["file"].endswith("b.json")
    (tmp_path / "in" / "c.json").write_text("not json\nnor this\n")
    with pytest.raises(ValueError, match="3 of 12"):
        ingest.land_history(store, str(tmp_path / "in"))
    assert store.read(names.HISTORY).count() == 9


def test_a_table_without_its_key_is_not_published(spark, tmp_path):
    store = Store(spark, root=str(tmp_path))
    store.save(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), "t", key=["k"])
    for rows in ([("a", 1), ("a", 2)], [("a", 1), (None, 2)]):
        with pytest.raises(ValueError, match="k is not a key"):
            store.save(spark.createDataFrame(rows, "k string, n int"), "t", key=["k"])
        assert {tuple(r) for r in store.read("t").collect()} == {("a", 1), ("b", 2)}
