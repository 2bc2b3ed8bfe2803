"""Catalog metadata: shortest unique names, table rows, column rows, table definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questline.functions.text import quote_text, table_definition
from questline.operators.lookup import lookup

TABLE_KEY = ["table_catalog", "table_schema", "table_name"]


def unique_names(tables: DataFrame) -> DataFrame:
    """Shortest name that identifies each table, and the level it needs.

    ``unique_level`` is TABLE, SCHEMA or CATALOG. How often a name occurs is counted with a
    combine before the shuffle and looked up with the hot names spread out, since one
    table name can make up a large share of a catalog.
    """
    schema_table = F.concat("table_schema", F.lit("."), "table_name")
    full = F.concat("table_catalog", F.lit("."), "table_schema", F.lit("."), "table_name")
    named = tables.select(
        *TABLE_KEY, full.alias("full_table_name"), schema_table.alias("schema_table_name")
    )
    pairs = named.groupBy("table_name", "schema_table_name").agg(F.count(F.lit(1)).alias("pair_count"))
    names = pairs.groupBy("table_name").agg(F.sum("pair_count").alias("name_count"))
    counts = lookup(pairs, names, ["table_name"], F.col("schema_table_name"))
    counted = lookup(
        named, counts.drop("table_name"), ["schema_table_name"], F.col("table_catalog")
    )
    by_name, by_pair = F.col("name_count") == 1, F.col("pair_count") == 1
    return counted.select(
        "full_table_name",
        *TABLE_KEY,
        F.when(by_name, "TABLE").when(by_pair, "SCHEMA").otherwise("CATALOG").alias("unique_level"),
        F.when(by_name, 1).when(by_pair, 2).otherwise(3).alias("unique_level_nbr"),
        F.when(by_name, F.col("table_name"))
        .when(by_pair, F.col("schema_table_name"))
        .otherwise(F.col("full_table_name"))
        .alias("unique_table_name"),
    )


def names_per_level(unique_table: DataFrame) -> DataFrame:
    return unique_table.groupBy("unique_level").agg(F.count(F.lit(1)).alias("table_cnt"))


def dotted(*parts: str) -> Column:
    """Name parts joined with dots, nulls skipped."""
    return F.array_join(F.array(*[F.col(p) for p in parts]), ".")


def column_description(escape: bool = True) -> Column:
    """One column's line in a table definition."""
    said = quote_text(F.col("comment")) if escape else F.col("comment")
    clause = F.when(
        F.col("comment").isNotNull(), F.concat(F.lit(" COMMENT '"), said, F.lit("'"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("  "), F.col("column_name"), F.lit(" "), F.upper("full_data_type"), clause
    )


def table_rows(
    tables: DataFrame, columns: DataFrame, order: str = "ordinal_position", escape: bool = True
) -> DataFrame:
    """One row per table with its column list, column descriptions and search text.

    Columns are gathered per table before the join, so that it meets one row per table on
    either side and reuses the aggregation's partitioning. Tables without columns get empty
    lists.
    """
    gathered = (
        columns.select(*TABLE_KEY, F.struct(
            F.col(order).alias("place"), F.col("column_name").alias("name"),
            column_description(escape).alias("line"),
        ).alias("item"))
        .groupBy(*TABLE_KEY)
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    # Partitioned by the join key first, so that distinct and join need no other shuffle.
    known = tables.select(*TABLE_KEY, "table_type", "comment").repartition(*TABLE_KEY).distinct()
    full_table = dotted(*TABLE_KEY)
    return known.join(gathered, TABLE_KEY, "left").select(
        *TABLE_KEY,
        full_table.alias("full_table"),
        "table_type",
        "comment",
        F.coalesce(F.array_join("items.name", ", "), F.lit("")).alias("column_list"),
        F.coalesce(F.array_join("items.line", ",\n"), F.lit("")).alias("column_description_list"),
        F.to_json(F.struct(full_table.alias("table"), F.col("comment"))).alias("table_search"),
    )


def column_rows(columns: DataFrame) -> DataFrame:
    """One row per column with its id and search text."""
    full_table = dotted(*TABLE_KEY)
    return columns.select(
        dotted(*TABLE_KEY, "column_name").alias("id"),
        full_table.alias("full_table"),
        "column_name",
        "is_nullable",
        F.col("full_data_type").alias("data_type"),
        "comment",
        F.to_json(F.struct(full_table.alias("table"), "column_name", "comment")).alias("column_search"),
    )


def definitions(table_search: DataFrame, escape: bool = True) -> DataFrame:
    """``full_table, table_definition`` for every table row."""
    return table_search.select(
        "full_table",
        table_definition(
            F.col("full_table"), F.col("comment"), F.col("column_description_list"), escape
        ).alias("table_definition"),
    )


def definitions_for(
    requests: DataFrame, key: str, tables: str, table_search: DataFrame, escape: bool = True
) -> DataFrame:
    """``key, table_definitions``: definitions of each request's tables, ordered by name.

    Names unknown to the catalog, null lists and empty lists give no definition, but every
    request keeps its row. ``key`` is unique in ``requests``.
    """
    asked = requests.select(key, F.explode_outer(F.array_distinct(tables)).alias("full_table"))
    found = lookup(asked, definitions(table_search, escape), ["full_table"], F.col(key))
    named = F.when(
        F.col("table_definition").isNotNull(), F.struct("full_table", "table_definition")
    )
    return found.groupBy(key).agg(
        F.array_sort(F.collect_list(named))["table_definition"].alias("table_definitions")
    )


def lookup_rows(requests: DataFrame, request_id: str, rows: DataFrame, on: str) -> DataFrame:
    """Each request with its table or column row; keys that are not there keep nulls."""
    return lookup(requests, rows, [on], F.col(request_id))


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are null or not unique, with their row count; empty when the key holds."""
    missing = F.lit(False)
    for name in key:
        missing = missing | F.col(name).isNull()
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter((F.col("n_rows") > 1) | missing)


def check_key(df: DataFrame, key: list[str]) -> None:
    """Raise if the key is null or repeated somewhere.

    Rows are counted by a hash of the key, which is summed before the shuffle and 8 bytes wide; the keys themselves are
    looked at only where a hash comes more than once.
    """
    missing = F.lit(False)
    for name in key:
        missing = missing | F.col(name).isNull()
    hashed = df.select(F.xxhash64(*key).alias("h"), missing.cast("int").alias("missing"))
    suspects = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("missing").alias("missing")).filter("n > 1 or missing = 1")
    if suspects.isEmpty():
        return
    asked = df.select(*key, F.xxhash64(*key).alias("h")).join(suspects.select("h"), "h", "left_semi")
    broken = key_violations(asked, key).select(*key).head(5)
    if broken:
        raise ValueError(f"{', '.join(key)} is not a key, for example {[tuple(row) for row in broken]}")
