"""Reading and writing the tables that stand between the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("table_catalog", "table_schema", "table_name", "table_type", "comment")]
)
COLUMNS_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("table_catalog", "table_schema", "table_name", "column_name",
                                                 "full_data_type", "is_nullable", "comment")],
    T.StructField("ordinal_position", T.IntegerType()),
])


def save(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` (overwrite, append or errorifexists) and return the written table."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
    df.write.mode(mode).saveAsTable(name)
    return df.sparkSession.table(name)


def save_json_lines(pairs: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Training pairs as JSON lines, written by the executors, one file per partition."""
    pairs.write.mode(mode).json(folder)


def preview_json_lines(spark: SparkSession, folder: str, n: int = 5) -> DataFrame:
    return spark.read.schema("prompt string, response string").json(folder).limit(n)


def with_ordinals(columns: DataFrame) -> DataFrame:
    """Columns metadata that lacks an ordinal gets none; lists are then ordered by name."""
    if "ordinal_position" in columns.columns:
        return columns
    return columns.withColumn("ordinal_position", F.lit(None).cast("int"))
