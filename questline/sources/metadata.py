"""Table and column metadata as DataFrames: from an information schema, or from the session's own catalog."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questline.session import cut_lineage
from questline.sources.tables import COLUMNS_SCHEMA, TABLES_SCHEMA, with_ordinals

# Fixed value: the schema in which an information schema lists itself.
INFORMATION_SCHEMA = "information_schema"

_DESCRIBED = """
    table_catalog STRING, table_schema STRING, table_name STRING, table_type STRING, comment STRING,
    columns ARRAY<STRUCT<column_name: STRING, full_data_type: STRING, is_nullable: STRING, comment: STRING>>
"""


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _shaped(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its types; those that ``rows`` lacks are null, others are left out."""
    has = {c.lower(): c for c in rows.columns}
    return rows.select(*[
        (F.col(has[f.name]) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def information_schema(
    tables: DataFrame, columns: DataFrame, catalogs: list[str] | None = None, schemas: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Tables and columns metadata from the two views of an information schema.

    ``catalogs`` and ``schemas`` keep those only and are pushed to the scan; the information schema itself is never listed, and
    rows without a table name are dropped. Names of the views' columns may be in any case.
    """
    def kept(rows: DataFrame) -> DataFrame:
        wanted: Column = F.col("table_name").isNotNull() & ~F.coalesce(F.lower("table_schema") == INFORMATION_SCHEMA, F.lit(False))
        for name, values in (("table_catalog", catalogs), ("table_schema", schemas)):
            if values is not None:
                wanted = wanted & F.col(name).isin(values)
        return rows.filter(wanted)

    return kept(_shaped(tables, TABLES_SCHEMA)), kept(_shaped(with_ordinals(columns), COLUMNS_SCHEMA))


def _described(spark: SparkSession, schema: str) -> DataFrame:
    """One row a table or view of ``schema``, written; the driver holds the descriptions of one schema at a time."""
    rows = []
    for listed in spark.sql(f"SHOW TABLES IN {quoted(schema)}").collect():
        if listed["isTemporary"]:
            continue
        name = f"{quoted(schema)}.{quoted(listed['tableName'])}"
        told = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").first()[0])
        columns = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", f.metadata.get("comment"))
                   for f in spark.table(name).schema.fields]
        rows.append((told.get("catalog_name"), schema, listed["tableName"], told.get("type"), told.get("comment"), columns))
    return cut_lineage(spark.createDataFrame(rows, _DESCRIBED))


def session_catalog(spark: SparkSession, schemas: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables and columns metadata of the session's current catalog: of ``schemas``, or of all it has.

    A catalog answers for one table at a time, so this suits some thousands of tables; more should come from an
    information schema. Temporary views are not listed. A schema without tables adds no rows.
    """
    if schemas is None:
        schemas = [r[0] for r in spark.sql("SHOW SCHEMAS").collect()]
    parts = [_described(spark, name) for name in schemas]
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _DESCRIBED)
    place = ["table_catalog", "table_schema", "table_name"]
    columns = rows.select(*place, F.posexplode("columns").alias("at", "c")).select(
        *place, "c.*", (F.col("at") + 1).alias("ordinal_position"))
    return _shaped(rows, TABLES_SCHEMA), _shaped(columns, COLUMNS_SCHEMA)
