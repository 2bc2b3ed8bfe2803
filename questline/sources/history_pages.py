"""Landed pages of the history API as history rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questline.config import PAGE_ROW_CAP

HISTORY_SCHEMA = T.StructType([
    T.StructField("account_id", T.StringType()),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("statement_id", T.StringType()),
    T.StructField("executed_by", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("execution_status", T.StringType()),
    T.StructField("warehouse_id", T.StringType()),
    T.StructField("executed_by_user_id", T.LongType()),
    T.StructField("statement_text", T.StringType()),
    T.StructField("statement_type", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("warehouse_channel", T.StringType()),
    T.StructField("client_application", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("end_time", T.TimestampType()),
])

# Field names of the history API's page format.
PAGE_DDL = """
    page_no BIGINT,
    res ARRAY<STRUCT<
        query_id: STRING, user_name: STRING, status: STRING, warehouse_id: STRING, user_id: BIGINT,
        query_text: STRING, statement_type: STRING, error_message: STRING,
        channel_used: STRUCT<name: STRING>,
        query_start_time_ms: BIGINT, execution_end_time_ms: BIGINT>>,
    has_next_page BOOLEAN,
    next_page_token STRING
"""


def empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HISTORY_SCHEMA)


_BROKEN = "_broken"
MAX_BROKEN = 0.01  # share of unreadable lines from which landing fails


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    # The filter holds for every line. It keeps all fields in the scan, so that what counts as broken doesn't depend on
    # the columns a reader asks for.
    whole = F.hash("page_no", "res", "has_next_page", "next_page_token") >= -(2**31)
    return spark.read.schema(f"{PAGE_DDL}, {_BROKEN} STRING").option("columnNameOfCorruptRecord", _BROKEN).json(folder).filter(whole)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed page files, one JSON object per line, in parallel and without inference.

    Lines that can't be read as a page are left to :func:`broken_pages`.
    """
    return _lines(spark, folder).filter(F.col(_BROKEN).isNull()).drop(_BROKEN)


def broken_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``file, line``: the lines that are no pages, as they stand, with the file they come from."""
    return _lines(spark, folder).filter(F.col(_BROKEN).isNotNull()).select(
        F.col("_metadata.file_path").alias("file"), F.col(_BROKEN).alias("line")
    )


def check_pages(pages: DataFrame, broken: DataFrame, max_broken: float = MAX_BROKEN) -> None:
    """Raise if more than ``max_broken`` of all lines are broken."""
    lost, good = broken.count(), pages.count()
    if lost > max_broken * (lost + good):
        raise ValueError(f"{lost} of {lost + good} landed lines are no pages")


def _prefix_sum(rows: DataFrame, order: str, value: Column, name: str, width: int = 10000) -> DataFrame:
    """Sum of ``value`` over all rows of lower ``order``, by ranges of ``width`` orders.

    Only one row per range goes through the window over everything.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width)).withColumn("_value", value)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("_range").agg(F.sum("_value").alias("_in_range"))
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_range", F.coalesce(F.sum("_in_range").over(everything), F.lit(0)).alias("_start"))
    inside = before.partitionBy("_range").orderBy(order)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(starts, "_range")
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_range", "_value", "_start", "_inside")
    )


def capped_pages(pages: DataFrame, row_cap: int = PAGE_ROW_CAP) -> DataFrame:
    """Pages up to the first that reaches ``row_cap`` rows (kept whole) or says it is the last.

    Which pages those are is settled on page numbers and sizes alone.
    """
    is_last = F.when(F.coalesce("has_next_page", F.lit(False)), 0).otherwise(1)
    sizes = pages.select("page_no", F.greatest(F.size("res"), F.lit(0)).alias("n"), is_last.alias("last"))
    # Both running totals in one: a last page uses up the whole cap.
    used = _prefix_sum(sizes, "page_no", F.col("n") + F.col("last") * F.lit(row_cap), "used")
    kept = used.filter(F.col("used") < row_cap).select("page_no")
    return pages.join(kept, "page_no", "left_semi")


def pages_to_history(pages: DataFrame, workspace_id: str | None = None) -> DataFrame:
    """One history row per entry of ``res``; missing fields are null, times are timestamps."""
    entry = F.col("entry")
    nothing = F.lit(None).cast("string")
    return pages.select(F.explode("res").alias("entry")).select(
        nothing.alias("account_id"),
        F.lit(workspace_id).cast("string").alias("workspace_id"),
        entry["query_id"].alias("statement_id"),
        entry["user_name"].alias("executed_by"),
        nothing.alias("session_id"),
        entry["status"].alias("execution_status"),
        entry["warehouse_id"].alias("warehouse_id"),
        entry["user_id"].alias("executed_by_user_id"),
        entry["query_text"].alias("statement_text"),
        entry["statement_type"].alias("statement_type"),
        entry["error_message"].alias("error_message"),
        entry["channel_used"]["name"].alias("warehouse_channel"),
        nothing.alias("client_application"),
        F.timestamp_millis(entry["query_start_time_ms"]).alias("start_time"),
        F.timestamp_millis(entry["execution_end_time_ms"]).alias("end_time"),
    )
