"""Session settings the jobs rely on, and the shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 16 * 1024 * 1024  # of an Arrow batch on its way to a Python worker

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "questline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``_`` for ``.``"""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Cut Arrow batches by bytes as well as by rows: one row may be a block of vectors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it in spark.checkpoint.dir.

    Only a session without that setting (tests, local runs) gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="questline-")
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    Later readers survive lost executors without repeating what came before, and being
    parquet, the written table gives each of them only the columns it needs.
    """
    path = new_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
