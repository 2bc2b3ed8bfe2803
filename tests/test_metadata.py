"""Metadata scans, and reruns by meaning."""

import datetime as dt

import numpy as np
import pytest

from questline import fixtures as fx
from questline.operators import catalog, enrich, history
from questline.plans.ingest import ingest_catalog, ingest_history, scan_catalog
from questline.plans.store import COLUMN_ROWS, DISTINCT_RUNS, STATEMENTS, TABLE_ROWS, UNIQUE_TABLE, Store
from questline.queries import QUERIES
from questline.sources import metadata


@pytest.fixture
def schema(spark, tmp_path):
    spark.sql(f"CREATE SCHEMA meta LOCATION '{tmp_path}/meta.db'")
    spark.sql("CREATE TABLE meta.orders (id BIGINT COMMENT 'it''s the key', at ARRAY<STRUCT<x: DECIMAL(10,2), y: STRING>>) USING parquet COMMENT 'all orders'")
    spark.sql("CREATE TABLE meta.odd_name (`a b` INT) USING parquet")
    spark.sql("CREATE VIEW meta.small AS SELECT id FROM meta.orders")
    yield "meta"
    spark.sql("DROP SCHEMA meta CASCADE")


def test_session_catalog(spark, schema):
    tables, columns = metadata.session_catalog(spark, [schema])
    assert sorted(tuple(r) for r in tables.select("table_schema", "table_name", "table_type").collect()) == [
        ("meta", "odd_name", "MANAGED"), ("meta", "orders", "MANAGED"), ("meta", "small", "VIEW")]
    assert [r["comment"] for r in tables.filter("table_name = 'orders'").collect()] == ["all orders"]
    got = sorted((r["table_name"], r["ordinal_position"], r["column_name"], r["full_data_type"], r["comment"]) for r in columns.collect())
    assert got[0][1:4] == (1, "a b", "int")
    assert got[1:3] == [("orders", 1, "id", "bigint", "it's the key"), ("orders", 2, "at", "array<struct<x:decimal(10,2),y:string>>", None)]
    nothing = metadata.session_catalog(spark, [])
    assert [f.count() for f in nothing] == [0, 0] and nothing[0].schema == tables.schema


def test_scanned_catalog_is_ingested(spark, schema, tmp_path):
    store = Store(spark, root=f"{tmp_path}/store")
    scan_catalog(store, [schema])
    assert store.read(UNIQUE_TABLE).filter("unique_level = 'TABLE'").count() == 3
    assert store.read(TABLE_ROWS).count() == 3 and store.read(COLUMN_ROWS).count() == 4


def test_information_schema(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = [("c", "s", "t", "MANAGED", None, 1), ("c", "information_schema", "tables", "VIEW", None, 2), ("d", "s", "t", "VIEW", "x", 3),
            ("c", None, "loose", "VIEW", None, 4), ("c", "s", None, None, None, 5)]
    path = str(tmp_path / "tables")
    spark.createDataFrame(rows, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string, COMMENT string, extra int").write.parquet(path)
    views = spark.createDataFrame([("c", "s", "t", "a", "int"), ("d", "s", "t", "a", "int")],
                                  "table_catalog string, table_schema string, table_name string, column_name string, full_data_type string")
    tables, columns = metadata.information_schema(spark.read.parquet(path), views)
    assert sorted((r["table_catalog"], r["table_name"]) for r in tables.collect()) == [("c", "loose"), ("c", "t"), ("d", "t")]
    assert columns.filter("ordinal_position is null and comment is null").count() == 2
    one, its_columns = metadata.information_schema(spark.read.parquet(path), views, catalogs=["d"], schemas=["s"])
    assert one.count() == its_columns.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: ")[1]
    assert "TABLE_CATALOG" in pushed and "TABLE_SCHEMA" in pushed.split("ReadSchema")[0]
    assert "extra" not in plan
    store = Store(spark, root=f"{tmp_path}/store")
    ingest_catalog(store, one, its_columns)
    assert catalog.names_per_level(store.read(UNIQUE_TABLE)).first()["unique_level"] == "TABLE"


VECTORS = {"a": [1.0, 0.0], "b": [0.9, 0.1], "c": [0.0, 1.0], "none": [0.0, 0.0]}


def test_reruns_by_meaning(spark, tmp_path):
    asked = tmp_path / "asked"

    def provider():
        def client(texts):
            with asked.open("a") as told:
                told.write("".join(f"{t}\n" for t in texts))
            if "broken" in texts:
                raise ValueError("no vector")
            return np.array([VECTORS[t] for t in texts])
        return client

    def runs_of(texts):
        start = dt.datetime(2024, 1, 1)
        return history.with_next_run(spark.createDataFrame(
            [("w", "u", f"s{i}", t, start + dt.timedelta(minutes=2 * i), start + dt.timedelta(minutes=2 * i + 1)) for i, t in enumerate(texts)],
            "warehouse_id string, executed_by string, statement_id string, statement_text string, start_time timestamp, end_time timestamp"))

    def kept(runs, **more):
        return {r["statement_id"]: r["next_similarity_score"] for r in enrich.drop_reruns_by_meaning(runs, provider, 0.9, **more).collect()}

    # s0 and s1 are nearly said again by s1 and s2; without a vector on either side a run stays.
    folder = str(tmp_path / "replies")
    runs = runs_of(["a", "b", "a", "c", "none", "c", None, "c"])
    want = {"s2": 0.0} | {f"s{i}": None for i in range(3, 8)}
    assert kept(runs, folder=folder) == want
    assert sorted(asked.read_text().split()) == sorted(VECTORS)
    assert kept(runs, folder=folder) == want
    assert sorted(asked.read_text().split()) == sorted(VECTORS), "a second run asks nothing"
    assert kept(runs_of(["a", "broken", "a", "a"])) == {"s0": None, "s1": None, "s3": None}
    assert kept(runs.limit(0)) == {}


def test_job_drops_reruns_by_meaning(spark, sf, tmp_path):
    store = Store(spark, root=str(tmp_path / "store"))
    ingest_catalog(store, fx.tables(spark, sf), fx.columns(spark, sf))
    embed = enrich.hashed_words_provider(fx.DIM)
    ingest_history(store, fx.history(spark, sf), enrich.whole_text_provider, embed, reruns_by_meaning=True)
    got = {r["statement_id"] for r in store.read(DISTINCT_RUNS).select("statement_id").collect()}
    assert got == {r["statement_id"] for r in QUERIES["hist_session_meaning"](spark, sf).collect()}
    assert {r["statement_id"] for r in store.read(STATEMENTS).select("statement_id").collect()} <= got
