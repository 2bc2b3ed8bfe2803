import pytest
from pyspark.sql import functions as F

from questline.operators import catalog, references
from questline.operators.lookup import lookup

TABLES = [("c1", "s1", "only"), ("c1", "s1", "two"), ("c1", "s2", "two"), ("c1", "r", "three"), ("c2", "r", "three")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame([(*t, "MANAGED", None) for t in TABLES],
                                 "table_catalog string, table_schema string, table_name string, table_type string, comment string")


@pytest.fixture(scope="module")
def unique(tables):
    return catalog.unique_names(tables)


def test_unique_names(unique):
    got = {r["full_table_name"]: (r["unique_level"], r["unique_level_nbr"], r["unique_table_name"]) for r in unique.collect()}
    assert got == {
        "c1.s1.only": ("TABLE", 1, "only"), "c1.s1.two": ("SCHEMA", 2, "s1.two"), "c1.s2.two": ("SCHEMA", 2, "s2.two"),
        "c1.r.three": ("CATALOG", 3, "c1.r.three"), "c2.r.three": ("CATALOG", 3, "c2.r.three"),
    }
    assert {r["unique_level"]: r["table_cnt"] for r in catalog.names_per_level(unique).collect()} == {
        "TABLE": 1, "SCHEMA": 2, "CATALOG": 2}


def test_table_and_column_rows(spark):
    tables = spark.createDataFrame([("c", "s", "t", "VIEW", "it's"), ("c", "s", "empty", "VIEW", None)],
                                   "table_catalog string, table_schema string, table_name string, table_type string, comment string")
    columns = spark.createDataFrame(
        [("c", "s", "t", "b", "int", "YES", "the 'b'", 2), ("c", "s", "t", "a", "string", "NO", None, 1)],
        "table_catalog string, table_schema string, table_name string, column_name string, full_data_type string,"
        " is_nullable string, comment string, ordinal_position int")
    rows = {r["table_name"]: r for r in catalog.table_rows(tables, columns).collect()}
    assert rows["t"]["column_list"] == "a, b"
    assert rows["t"]["column_description_list"] == "  a STRING,\n  b INT COMMENT 'the ''b'''"
    assert rows["t"]["table_search"] == '{"table":"c.s.t","comment":"it\'s"}'
    assert rows["empty"]["column_list"] == "" and rows["empty"]["table_search"] == '{"table":"c.s.empty"}'
    found = {r["id"]: r["column_search"] for r in catalog.column_rows(columns).collect()}
    assert found == {"c.s.t.a": '{"table":"c.s.t","column_name":"a"}',
                     "c.s.t.b": '{"table":"c.s.t","column_name":"b","comment":"the \'b\'"}'}


def test_definitions_for_keeps_every_request(spark):
    rows = spark.createDataFrame([("c.s.b", None, "  i INT"), ("c.s.a", "x", "")],
                                 "full_table string, comment string, column_description_list string")
    asked = spark.createDataFrame([(1, ["c.s.b", "c.s.a", "c.s.b", "zz"]), (2, []), (3, None), (4, ["zz"])],
                                  "k int, tables array<string>")
    got = {r["k"]: r["table_definitions"] for r in catalog.definitions_for(asked, "k", "tables", rows).collect()}
    assert got == {1: ["CREATE TABLE c.s.a (\n)\nCOMMENT 'x';", "CREATE TABLE c.s.b (\n  i INT);"], 2: [], 3: [], 4: []}


def test_key_violations(spark):
    frame = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    assert {(r["k"], r["n_rows"]) for r in catalog.key_violations(frame, ["k"]).collect()} == {("b", 2), (None, 1)}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_with_hot_keys_equals_a_join(spark, how):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(40)]], "k string, v int")
    got = lookup(left, right, ["k"], F.col("id"), how=how, hot_rows=100)
    want = left.join(right, "k", how)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_key_is_dealt_out(spark):
    left = spark.range(1000).select(F.lit("hot").alias("k"), "id")
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup(left, right, ["k"], F.col("id"), hot_rows=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 1000 and max(sizes) < 1000


def refs(spark, rows, strict=False):
    frame = spark.createDataFrame(rows, "statement_id string, statement_text string, parsed_table_list array<string>")
    return references.split_references(frame.withColumn("extraction_model", F.lit("m")), strict)


def test_split_checks_parts_in_the_text(spark):
    got = {r["full_table"]: (r["valid_catalog_name"], r["valid_schema_name"], r["valid_table_name"]) for r in refs(
        spark, [("q", "from c1.s1.only", ["c1.s1.only", "c9.s1.only", "only", "zz.ww.only"])]).collect()}
    assert got == {"c1.s1.only": ("c1", "s1", "only"), "c9.s1.only": (None, "s1", "only"),
                   "only": (None, None, "only"), "zz.ww.only": (None, None, "only")}


def resolve(spark, unique, rows, strict=False):
    frame = spark.createDataFrame(rows, "statement_id string, statement_text string, parsed_table_list array<string>")
    found = references.resolve_references(frame.withColumn("extraction_model", F.lit("m")), unique, strict)
    return {r["statement_id"]: (r["table_list"], r["matched_ind"], r["fixed_ind"]) for r in found.collect()}


CASES = [
    ("full", "from c1.s1.only", ["c1.s1.only"]),
    ("bare", "from only", ["only"]),
    ("schema", "from s1.two", ["s1.two"]),
    ("ambiguous", "from two", ["two"]),
    ("needs_catalog", "from r.three", ["r.three"]),
    ("unknown_full", "from x.y.z", ["x.y.z"]),
    ("unknown_bare", "from nope", ["nope"]),
    ("upper", "FROM C1.S1.ONLY", ["c1.s1.only"]),
    ("none", "select 1", []),
]


def test_resolve(spark, unique):
    assert resolve(spark, unique, CASES) == {
        "full": (["c1.s1.only"], True, False), "bare": (["c1.s1.only"], True, True),
        "schema": (["c1.s1.two"], True, True), "unknown_full": (["x.y.z"], False, False),
        "upper": (["c1.s1.only"], True, False),
    }


def test_empty_parts_find_nothing(spark, unique):
    rows = [("empty", "from c1..only", ["c1..only"]), ("start", "from .s1.only", [".s1.only"]), ("end", "from c1.s1.", ["c1.s1."])]
    for strict in (False, True):
        assert not any(matched for _, matched, _ in resolve(spark, unique, rows, strict).values())


def test_resolve_strict_needs_a_catalog_with_a_schema_and_equal_case(spark, unique):
    assert resolve(spark, unique, CASES, strict=True) == {
        "full": (["c1.s1.only"], True, False), "bare": (["c1.s1.only"], True, True),
        "unknown_full": (["x.y.z"], False, False),
    }


def test_routing_and_append(spark):
    frame = spark.createDataFrame([("a", "xx"), ("b", "xxx"), ("c", "xxxx")], "statement_id string, t string")
    models = [r[0] for r in frame.select(references.route_model(F.col("t"), 3)).collect()]
    assert models == ["short-context", "long-context", "long-context"]
    done = spark.createDataFrame([("b", "long"), (None, "long")], "statement_id string, extraction_model string")
    both = references.append_missing(done, frame.select("statement_id"), "short", "statement_id").collect()
    assert {(r[0], r[1]) for r in both} == {("b", "long"), (None, "long"), ("a", "short"), ("c", "short")}
