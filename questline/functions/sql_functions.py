"""The text functions under SQL names, for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from questline.config import PARSING_ERROR
from questline.functions.text import INSTRUCTIONS


_DEFINITION = (
    "'CREATE TABLE ' || full_table || ' (\\n' || column_description_list || ')' || "
    "CASE WHEN coalesce(comment, '') <> '' "
    "THEN '\\nCOMMENT \\'' || replace(comment, '\\'', '\\'\\'') || '\\'' ELSE '' END || ';'"
)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions: ``pull_tables_from_json``, ``format_table_definitions``,
    ``build_prompt`` and ``embedding_similarity_score``; all plain expressions."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION listed_tables_text(json_str STRING) RETURNS STRING
        RETURN lower(replace(replace(
            CASE WHEN instr(json_str, '[') > 0 AND instr(json_str, ']') > instr(json_str, '[')
                 THEN substring(json_str, instr(json_str, '['),
                                instr(json_str, ']') - instr(json_str, '[') + 1)
                 ELSE '' END, '\\\\_', '_'), '`', ''))""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION pull_tables_from_json(json_str STRING) RETURNS ARRAY<STRING>
        RETURN coalesce(
            from_json(listed_tables_text(json_str), 'array<string>', map('allowSingleQuotes', 'false')),
            array('{PARSING_ERROR}', listed_tables_text(json_str)))""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION format_table_definitions(
            full_table STRING, comment STRING, column_description_list STRING) RETURNS STRING
        RETURN {_DEFINITION}""")
    head = _text(f"--Instructions\n/*\n{INSTRUCTIONS}\n*/\n\n--Tables\n")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION build_prompt(
            question STRING, table_definitions ARRAY<STRING>,
            sample_queries ARRAY<STRUCT<question: STRING, sql: STRING>>) RETURNS STRING
        RETURN {head} || coalesce(array_join(table_definitions, '\\n\\n'), '')
            || {_text(chr(10) * 2 + '--Sample Prompt and SQL Response' + chr(10))}
            || coalesce(array_join(transform(sample_queries, s ->
                   '/*\\n' || coalesce(s.question, '') || '\\n*/\\n' || coalesce(s.sql, '')), '\\n\\n'), '')
            || {_text(chr(10) * 2 + '--User Prompt' + chr(10) + '/*' + chr(10))} || question
            || {_text(chr(10) + '*/' + chr(10) * 2 + '--Your SQL Response' + chr(10))}""")
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (t, x) -> t + x)"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION embedding_similarity_score(
            vec1 ARRAY<FLOAT>, vec2 ARRAY<FLOAT>) RETURNS FLOAT
        RETURN CASE WHEN size(vec1) = size(vec2) AND {dot.format('vec1', 'vec1')} > 0
                     AND {dot.format('vec2', 'vec2')} > 0
                     AND {dot.format('vec1', 'vec1')} < double('inf')
                     AND {dot.format('vec2', 'vec2')} < double('inf')
               THEN CAST({dot.format('vec1', 'vec2')} / (sqrt({dot.format('vec1', 'vec1')})
                    * sqrt({dot.format('vec2', 'vec2')})) AS FLOAT) END""")


def register_definition_lookup(spark: SparkSession, table_search: str) -> None:
    """``get_table_definitions(tables)`` over the table rows in view ``table_search``.

    Made for single calls. For a request column use
    :func:`questline.operators.catalog.definitions_for`, which is an equi-join.
    """
    register_functions(spark)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION get_table_definitions(tables ARRAY<STRING>) RETURNS ARRAY<STRING>
        RETURN (SELECT array_sort(collect_list({_DEFINITION}))
                FROM {table_search} WHERE array_contains(tables, full_table))""")
