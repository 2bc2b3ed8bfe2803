import datetime as dt
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plan_text import plan_of
from questline import fixtures as fx
from questline.operators import history
from questline.sources import history_pages as pages

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    """rows: id, user, text, start minute, end minute"""
    data = [(i, u, "wh", t, "FINISHED", "SELECT",
             None if a is None else T0 + dt.timedelta(minutes=a), None if b is None else T0 + dt.timedelta(minutes=b))
            for i, u, t, a, b in rows]
    return spark.createDataFrame(
        data, "statement_id string, executed_by string, warehouse_id string, statement_text string,"
              " execution_status string, statement_type string, start_time timestamp, end_time timestamp")


def test_latest_per_shape_takes_last_end_then_highest_id(spark):
    rows = log(spark, [("a", "u", "x = 'one'", 0, 1), ("b", "u", "x = 'two'", 0, 2), ("c", "u", "x = 'six'", 0, 2),
                       ("d", "u", "y", 0, None), ("e", "u", "y", 0, 0)])
    got = {r["masked_text"]: r["statement_id"] for r in history.latest_per_shape(rows).collect()}
    assert got == {"x = '{value}'": "c", "y": "e"}


def test_failed_and_other_statements_are_left_out(spark):
    rows = log(spark, [("a", "u", "x", 0, 1)])
    assert history.latest_per_shape(rows.withColumn("execution_status", F.lit("FAILED"))).count() == 0
    assert history.latest_per_shape(rows.withColumn("statement_type", F.lit("INSERT"))).count() == 0


def test_dedupe_combines_before_its_only_shuffle(spark, sf):
    plan = plan_of(history.latest_per_shape(fx.history(spark, sf)))
    assert "partial_max" in plan and plan.count("Exchange") == 1


def test_next_run_equals_one_window_per_user(spark, sf):
    rows = fx.history(spark, sf).withColumn("executed_by", F.when(F.col("executed_by_user_id") % 3 == 0, F.col("executed_by")))
    rows = rows.withColumn("end_time", F.when(F.col("executed_by_user_id") % 7 != 0, F.col("end_time")))
    w = Window.partitionBy("warehouse_id", "executed_by").orderBy("end_time", "statement_id")
    plain = rows.select("statement_id", F.lead("statement_id").over(w).alias("next_statement_id"),
                        F.lead("end_time").over(w).alias("next_end_time"))
    cut = history.with_next_run(rows).select(plain.columns)
    assert plain.exceptAll(cut).count() == 0 and cut.exceptAll(plain).count() == 0
    by_day = history.with_next_run(rows, bucket="DAY").select(plain.columns)
    assert plain.exceptAll(by_day).count() == 0
    cut_up = history.with_next_run(rows, bucket="YEAR", hot_rows=10).select(plain.columns)
    assert plain.exceptAll(cut_up).count() == 0 and cut_up.exceptAll(plain).count() == 0


def test_gaps(spark):
    rows = log(spark, [("a", "u", "x", 0, 10), ("b", "u", "y", 5, 12), ("c", "u", "z", 102, 103), ("d", "v", "z", 0, 1)])
    got = {r["statement_id"]: (r["gap_minutes"], r["gap_hours"]) for r in history.with_next_run(rows).collect()}
    assert got == {"a": (-5, -5 / 60), "b": (90, 1.5), "c": (None, None), "d": (None, None)}


def test_drop_reruns_is_strict_and_keeps_last_runs(spark):
    rows = log(spark, [("a", "u", "a b", 0, 1), ("b", "u", "a b c d", 2, 3), ("c", "u", "a b c d", 4, 5)])
    runs = history.with_next_run(rows)
    assert {r[0] for r in history.drop_reruns(runs, 0.5).select("statement_id").collect()} == {"c"}
    assert {r[0] for r in history.drop_reruns(runs, 0.51).select("statement_id").collect()} == {"a", "c"}
    same = history.drop_reruns(runs, 0.5, similarity=lambda a, b: F.lit(1.0))
    assert [r[0] for r in same.select("statement_id").collect()] == ["c"]


def test_newest(spark):
    rows = log(spark, [("a", "u", "x", 0, 10), ("b", "u", "y", 5, 12), ("c", "u", "z", 5, None)])
    assert [r[0] for r in history.newest(rows, 2).select("statement_id").collect()] == ["b", "a"]


@pytest.fixture
def landed(spark, tmp_path):
    def page(no, n, more=True):
        entries = [{"query_id": f"q{no}-{i}", "query_start_time_ms": 1500 + i, "user_id": 7} for i in range(n)]
        if n:
            entries[0]["channel_used"] = {"name": "web"}
        return {"page_no": no, "res": entries, "has_next_page": more}

    def land(*sizes, last=None):
        folder = tmp_path / "pages"
        folder.mkdir()
        for no, n in enumerate(sizes):
            (folder / f"{no}.json").write_text(json.dumps(page(no, n, more=no != last)))
        return pages.read_pages(spark, str(folder))
    return land


def test_pages_to_history(spark, landed):
    rows = pages.pages_to_history(landed(2, 0), "w").orderBy("statement_id").collect()
    assert [r["statement_id"] for r in rows] == ["q0-0", "q0-1"]
    assert [r["warehouse_channel"] for r in rows] == ["web", None]
    assert rows[0]["workspace_id"] == "w" and rows[0]["account_id"] is None and rows[0]["end_time"] is None
    assert rows[0]["start_time"] == dt.datetime(1970, 1, 1, 0, 0, 1, 500000)
    types = [(f.name, f.dataType) for f in pages.pages_to_history(spark.createDataFrame([], pages.PAGE_DDL)).schema]
    assert types == [(f.name, f.dataType) for f in pages.empty_history(spark).schema]


def kept(frame, cap):
    return sorted(r["page_no"] for r in pages.capped_pages(frame, cap).collect())


def test_page_cap_keeps_the_page_that_reaches_it(landed):
    frame = landed(3, 3, 0, 3, 3)
    assert kept(frame, 6) == [0, 1]
    assert kept(frame, 7) == [0, 1, 2, 3]
    assert kept(frame, 100) == [0, 1, 2, 3, 4]


def test_pages_end_with_the_last_page(landed):
    assert kept(landed(1, 1, 1, last=1), 100) == [0, 1]


def test_prefix_sum_over_ranges(spark):
    frame = spark.range(100).withColumnRenamed("id", "page_no")
    got = pages._prefix_sum(frame, "page_no", F.col("page_no"), "before", width=7).collect()
    assert all(r["before"] == r["page_no"] * (r["page_no"] - 1) // 2 for r in got) and len(got) == 100
