"""The tables the jobs write, in one configured place."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from questline.operators.catalog import check_key
from questline.session import cut_lineage
from questline.sources.published import publish, read_published
from questline.sources.tables import save_table

# Names under which the tables are known to their readers.
UNIQUE_TABLE = "unique_table"
HISTORY = "query_history_api"
BROKEN_PAGES = "query_history_api_broken"
UNIQUE_HISTORY = "query_history_unique"
DISTINCT_RUNS = "query_history_similarity_filter"
EXTRACTED = "table_extract"
PARSED = "table_extract_parse"
RESOLVED = "table_extract_final"
SUMMARIES = "summary_processed"
EMBEDDINGS = "query_history_embeddings"
STATEMENTS = "query_history_pre_index"
TABLE_ROWS = "table_search_pre_index"
COLUMN_ROWS = "column_search_pre_index"
TOP_MATCHES = "query_top_matches"
TRAINING = "fine_tuning_set"


@dataclass(frozen=True)
class Store:
    """Tables below a folder all executors reach, or in a metastore schema.

    Give ``root`` for parquet folders or ``schema`` for ``saveAsTable``. Below ``root`` tables are published as
    versions: readers never see half a table, and a job may replace what it reads.
    """

    spark: SparkSession
    root: str | None = None
    schema: str | None = None

    def save(self, df: DataFrame, name: str, mode: str = "overwrite", key: list[str] | None = None) -> DataFrame:
        """Write and return a table; with ``key``, rows for which it is no key are an error.

        Below ``root`` the written version is checked before it is published, from its key columns alone. In a schema the
        rows are checked before they are written.
        """
        if self.root is not None:
            audit = None if key is None else lambda rows: check_key(rows, key)
            return publish(df, os.path.join(self.root, name), mode, audit)
        if key is not None:
            df = cut_lineage(df)
            check_key(df, key)
        return save_table(df, f"{self.schema}.{name}", mode)

    def read(self, name: str) -> DataFrame:
        if self.root is not None:
            return read_published(self.spark, os.path.join(self.root, name))
        return self.spark.table(f"{self.schema}.{name}")
