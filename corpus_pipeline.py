"""Corpus pipeline: stages that turn ``documents`` into sharded training documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to
the shared folder and reread as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from questline.llm import decontaminate, mixing, quality_classifier, sharding, simhash
from questline.llm.common import bound_batches
from questline.session import cut_lineage

QUALITY_CUT = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; so do those without words."""
    bound_batches(spark)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    columns = docs.columns
    return quality_classifier.score(docs, model).filter(f"score >= {QUALITY_CUT}").select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one with the smallest id."""
    bound_batches(spark)
    return simhash.one_per_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    bound_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in global random order."""
    return mixing.mix(docs).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard along the Hilbert curve and their slot in it."""
    return sharding.shard(docs)


STAGES = [
    ("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mixed),
    ("shard", sharded),
]

# No SQL: a trained classifier, fingerprints and a curve order can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
