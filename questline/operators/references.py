"""Which catalog tables a statement uses: routing, parsing, checking and resolving names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questline.config import LONG_MODEL, LONG_STATEMENT_CHARS, PARSING_ERROR, SHORT_MODEL
from questline.functions.text import parse_table_list
from questline.operators.lookup import lookup


def route_model(
    text: Column,
    long_chars: int = LONG_STATEMENT_CHARS,
    long_model: str = LONG_MODEL,
    short_model: str = SHORT_MODEL,
) -> Column:
    """Model for a statement by its length in characters."""
    return F.when(F.length(text) >= long_chars, long_model).otherwise(short_model)


def append_missing(done: DataFrame, statements: DataFrame, model: str, key: str) -> DataFrame:
    """``done`` plus the statements it does not hold yet, tagged with ``model``.

    An anti join, so a null key in ``done`` does not make the rest vanish as NOT IN would.
    """
    rest = statements.join(done.select(key), key, "left_anti")
    return done.unionByName(rest.withColumn("extraction_model", F.lit(model)))


def parse_outputs(extracted: DataFrame, output: str = "manual_table_list") -> DataFrame:
    return extracted.withColumn("parsed_table_list", parse_table_list(F.col(output)))


def parsing_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.array_contains("parsed_table_list", PARSING_ERROR))


def split_references(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """One row per named table with those of its name parts that occur in the statement.

    Parts count from the right: table, schema, catalog. The test is a substring test, so
    ``order`` is found in ``orders``. Names come lower-cased; ``strict`` compares them with
    the statement as written, which drops upper-case references.
    """
    text = F.col("statement_text") if strict else F.lower("statement_text")
    parts = F.split("full_table", r"\.")

    def valid(position: int) -> Column:
        part = F.try_element_at(parts, F.lit(position))
        return F.when(F.contains(text, part), part)

    kept = [c for c in parsed.columns if c != "parsed_table_list"]
    return (
        parsed.select(*kept, F.explode("parsed_table_list").alias("full_table"))
        .select(
            *kept,
            "full_table",
            valid(-1).alias("valid_table_name"),
            valid(-2).alias("valid_schema_name"),
            valid(-3).alias("valid_catalog_name"),
        )
    )


_ASKED = ["ask_catalog", "ask_schema", "ask_table"]


def _name_index(unique_table: DataFrame, strict: bool) -> DataFrame:
    """Every form in which a table may be named, each form at most once.

    A blank stands for a part that may be left out: a name unique in the whole catalog needs
    no schema, one unique with its schema needs no catalog.
    """
    catalog, schema, level = F.col("table_catalog"), F.col("table_schema"), F.col("unique_level_nbr")
    blank = F.lit("")
    forms = [F.struct(catalog.alias("c"), schema.alias("s")),
             F.when(level == 1, F.struct(blank.alias("c"), blank.alias("s")))]
    if not strict:
        forms.append(F.when(level == 1, F.struct(catalog.alias("c"), blank.alias("s"))))
        forms.append(F.when(level < 3, F.struct(blank.alias("c"), schema.alias("s"))))
    return (
        unique_table.withColumn("form", F.explode(F.array_compact(F.array(*forms))))
        .select(
            F.col("form.c").alias("ask_catalog"), F.col("form.s").alias("ask_schema"),
            F.col("table_name").alias("ask_table"), "table_catalog", "table_schema",
            F.lit(True).alias("known"),
        )
    )


def match_references(split: DataFrame, unique_table: DataFrame, strict: bool = False) -> DataFrame:
    """Named tables with missing catalog and schema filled in from the catalog.

    The rule "name equal, schema equal or left out, catalog equal or left out" becomes one
    equi-join on the name form, so a table name that occurs in many schemas does not
    multiply rows. ``strict`` keeps the older rule in which a name with a schema but no
    catalog never matches, and a name without a schema matches whatever its catalog.
    """
    catalog, schema = F.col("valid_catalog_name"), F.col("valid_schema_name")

    def asked_part(part: Column) -> Column:
        # The blank form stands for a part that is left out; an empty part, as in c..t, finds nothing.
        return F.when(part.isNull(), "").when(part != "", part)

    ask_catalog = asked_part(catalog)
    if strict:
        # Not the blank form: a schema without a catalog must find nothing.
        ask_catalog = F.when(schema.isNull(), "").otherwise(F.when(catalog != "", catalog))
    asked = (
        split.filter(F.col("valid_table_name").isNotNull())
        .withColumn("ask_catalog", ask_catalog)
        .withColumn("ask_schema", asked_part(schema))
        .withColumn("ask_table", F.col("valid_table_name"))
    )
    joined = lookup(asked, _name_index(unique_table, strict), _ASKED, F.col("statement_id"))
    fixed = (F.coalesce(catalog, F.lit("")) != F.col("table_catalog")) | (
        F.coalesce(schema, F.lit("")) != F.col("table_schema")
    )
    return joined.select(
        *[c for c in split.columns if c not in ("valid_catalog_name", "valid_schema_name")],
        F.coalesce(catalog, F.col("table_catalog")).alias("valid_catalog_name"),
        F.coalesce(schema, F.col("table_schema")).alias("valid_schema_name"),
        F.coalesce(F.col("known"), F.lit(False)).alias("matched_ind"),
        F.coalesce(fixed, F.lit(False)).alias("fixed_ind"),
    )


def resolve_references(
    parsed: DataFrame, unique_table: DataFrame, strict: bool = False
) -> DataFrame:
    """Per statement: its tables as structs, and distinct catalog, schema and table lists.

    Names that lack a part after matching are left out; fully named tables unknown to the
    catalog stay, unmatched. The statement text does not travel with the names: it is
    only read to check them, and joined back once by id.
    """
    slim = parsed.select("statement_id", "statement_text", "parsed_table_list")
    split = split_references(slim, strict).drop("statement_text")
    matched = match_references(split, unique_table, strict)
    catalog, schema, table = (
        F.col("valid_catalog_name"), F.col("valid_schema_name"), F.col("valid_table_name")
    )
    dot = F.lit(".")
    lists = (
        matched.filter(catalog.isNotNull() & schema.isNotNull())
        .groupBy("statement_id")
        .agg(
            F.array_sort(F.collect_list(F.struct(
                catalog.alias("catalog_name"), schema.alias("schema_name"), table.alias("table_name")
            ))).alias("table_struct_list"),
            F.array_sort(F.collect_set(catalog)).alias("catalog_list"),
            F.array_sort(F.collect_set(F.concat(catalog, dot, schema))).alias("schema_list"),
            F.array_sort(F.collect_set(F.concat(catalog, dot, schema, dot, table))).alias("table_list"),
            F.coalesce(F.max("matched_ind"), F.lit(False)).alias("matched_ind"),
            F.coalesce(F.max("fixed_ind"), F.lit(False)).alias("fixed_ind"),
        )
    )
    kept = [c for c in ("statement_text", "extraction_model") if c in parsed.columns]
    return lists.join(parsed.select("statement_id", *kept), "statement_id")
