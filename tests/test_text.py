import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plan_text import plan_of
from questline.functions import text
from questline.functions.sql_functions import register_definition_lookup, register_functions
from questline.functions.table_names import extract_tables
from questline.functions.vectors import cosine

ERROR = "PARSING ERROR"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given_text, masked, safe", [
    ("where a = 'x' and b = \"y\"", "where a = '{value}' and b = \"{value}\"", "where a = '{value}' and b = \"{value}\""),
    ("a = 'it''s'", "a = '{value}''{value}'", "a = '{value}'"),
    ("a = '' and b = 'x'", "a = ''{value}'x'", "a = '{value}' and b = '{value}'"),
    ("limit 10", "limit 10", "limit 10"),
])
def test_mask(spark, given_text, masked, safe):
    assert one(spark, text.mask_literals(F.col("t")), t=given_text) == masked
    assert one(spark, text.mask_literals(F.col("t"), safe=True), t=given_text) == safe


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abc =1", min_size=1, max_size=8), min_size=1, max_size=4))
def test_mask_is_idempotent(spark, literals):
    statement = "select 1 where " + " and ".join(f"a = '{x}'" for x in literals)
    once = one(spark, text.mask_literals(F.col("t")), t=statement)
    assert one(spark, text.mask_literals(F.col("t")), t=once) == once


OUTPUTS = [
    ('```json\n{"tables": ["A.b", "c"]}\n```', ["a.b", "c"]),
    ('{"tables": []}', []),
    ("nothing", [ERROR, ""]),
    ("] [", [ERROR, ""]),
    ('["a"', [ERROR, ""]),
    ('["A" "b"]', [ERROR, '["a" "b"]']),
    ("['a']", [ERROR, "['a']"]),
    ('["my\\_table", "`X`.y"]', ["my_table", "x.y"]),
    ("[1, \"b\"]", ["1", "b"]),
    (None, [ERROR, ""]),
]


@pytest.mark.parametrize("output, tables", OUTPUTS)
def test_parse_table_list(spark, output, tables):
    frame = spark.createDataFrame([(output,)], "o string")
    assert frame.select(text.parse_table_list(F.col("o"))).first()[0] == tables
    register_functions(spark)
    assert frame.selectExpr("pull_tables_from_json(o)").first()[0] == tables


def test_word_overlap(spark):
    overlap = text.word_overlap(F.col("a"), F.col("b"))
    assert one(spark, overlap, a="select  A b", b="a c") == pytest.approx(1 / 4)
    assert one(spark, overlap, a="", b="x") == 0.0
    assert one(spark, overlap, a="", b=" ") == 1.0


@pytest.mark.parametrize("comment, clause", [(None, ""), ("", ""), ("it's", "\nCOMMENT 'it''s'")])
def test_table_definition(spark, comment, clause):
    frame = spark.createDataFrame([("a.b.c", comment, "  id INT")], "t string, c string, l string")
    want = f"CREATE TABLE a.b.c (\n  id INT){clause};"
    assert frame.select(text.table_definition(F.col("t"), F.col("c"), F.col("l"))).first()[0] == want
    register_functions(spark)
    assert frame.selectExpr("format_table_definitions(t, c, l)").first()[0] == want
    raw = text.table_definition(F.col("t"), F.col("c"), F.col("l"), escape=False)
    assert frame.select(raw).first()[0] == want.replace("''s", "'s")


def test_build_prompt_sections_and_sql_name(spark):
    frame = spark.sql(
        "select 'how many?' as q, array('D1', 'D2') as d,"
        " array(named_struct('question', 'q1', 'sql', 's1'), named_struct('question', 'q2', 'sql', 's2')) as s"
    )
    prompt = frame.select(text.build_prompt(F.col("q"), F.col("d"), F.col("s"))).first()[0]
    marks = ["--Instructions", "--Tables\nD1\n\nD2", "--Sample Prompt and SQL Response\n/*\nq1\n*/\ns1\n\n/*\nq2\n*/\ns2",
             "--User Prompt\n/*\nhow many?\n*/", "--Your SQL Response\n"]
    places = [prompt.index(m) for m in marks]
    assert places == sorted(places) and prompt.endswith(marks[-1])
    register_functions(spark)
    assert frame.selectExpr("build_prompt(q, d, s)").first()[0] == prompt


def test_get_table_definitions(spark):
    spark.createDataFrame([("a.b.c", None, "  i INT"), ("a.b.d", "x", "")],
                          "full_table string, comment string, column_description_list string"
                          ).createOrReplaceTempView("some_rows")
    register_definition_lookup(spark, "some_rows")
    got = spark.sql("select get_table_definitions(array('a.b.d', 'nope'))").first()[0]
    assert got == ["CREATE TABLE a.b.d (\n)\nCOMMENT 'x';"]


@pytest.mark.parametrize("response, said", [
    ('{"candidates":[{"text":"select 1"},{"text":"b"}]}', "select 1"),
    ('{"candidates":[]}', None), ("broken", None), (None, None),
])
def test_completion_text(spark, response, said):
    assert spark.createDataFrame([(response,)], "r string").select(text.completion_text(F.col("r"))).first()[0] == said


def test_cosine(spark):
    frame = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])],
        "a array<float>, b array<float>")
    got = [r[0] for r in frame.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2 ** -0.5) and got[1:] == [None, None, None]
    register_functions(spark)
    named = [r[0] for r in frame.selectExpr("embedding_similarity_score(a, b)").collect()]
    assert named[0] == pytest.approx(2 ** -0.5, abs=1e-6) and named[1:] == [None, None, None]


def test_text_functions_stay_in_the_jvm(spark):
    frame = spark.createDataFrame([("x", ["y"])], "t string, d array<string>")
    nothing = F.array().cast("array<struct<question: string, sql: string>>")
    plan = plan_of(frame.select(
        text.parse_table_list(F.col("t")), extract_tables(F.col("t")), text.mask_literals(F.col("t")),
        text.table_definition(F.col("t"), F.col("t"), F.col("t")), text.build_prompt(F.col("t"), F.col("d"), nothing)))
    assert "Python" not in plan
