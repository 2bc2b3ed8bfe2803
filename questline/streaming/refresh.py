"""Triggered refresh of an embedded search copy from landed changes, kept in levels.

Each batch adds a run of rows with unique keys. Runs are merged like the digits of a binary counter: after n
batches there is at most one run for each binary digit of n, so a read meets a key once a level and a row is
rewritten once a level. Runs are published whole; those that went into a larger one stay for their readers until
:func:`drop_merged` is called.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questline.operators.enrich import EmbeddingClient, embed
from questline.sources.published import current, exists, folders, publish, read_published, remove


def latest_rows(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest ``version`` per key, combined before the shuffle."""
    others = [c for c in rows.columns if c not in (key, version)]
    return (
        rows.groupBy(key)
        .agg(F.max(F.struct(version, *others)).alias("row"))
        .select(key, *[F.col(f"row.{c}").alias(c) for c in [version, *others]])
    )


_RUN = re.compile(r"run-(\d+)-(\d+)")


def _path(index: str, run: tuple[int, int]) -> str:
    return f"{index}/run-{run[0]}-{run[1]}"


def _covers(one: tuple[int, int], other: tuple[int, int]) -> bool:
    return one[0] <= other[0] and other[1] <= one[1]


def _published_runs(spark: SparkSession, index: str) -> list[tuple[int, int]]:
    found = [(int(m[1]), int(m[2])) for m in map(_RUN.fullmatch, folders(spark, index)) if m]
    return [run for run in found if current(spark, _path(index, run)) is not None]


def runs(spark: SparkSession, index: str) -> list[tuple[int, int]]:
    """(first batch, last batch) of each run that readers need, oldest first."""
    found = _published_runs(spark, index)
    return sorted(run for run in found if not any(_covers(other, run) for other in found if other != run))


def drop_merged(spark: SparkSession, index: str) -> int:
    """Remove runs that went into larger ones, once no reader needs them; returns how many."""
    needed = runs(spark, index)
    merged = [run for run in _published_runs(spark, index) if run not in needed]
    for run in merged:
        remove(spark, _path(index, run))
    return len(merged)


def _newest(spark: SparkSession, index: str, of: list[tuple[int, int]], key: str, version: str) -> DataFrame:
    """The latest row per key over the given runs, with its batch; keys are unique in each run."""
    rows = reduce(DataFrame.unionByName, [read_published(spark, _path(index, run)) for run in of])
    if len(of) == 1:
        return rows
    columns = rows.columns
    stamped = rows.withColumn("_newest", F.struct(version, "batch_id")).drop("batch_id", version)
    return latest_rows(stamped, key, "_newest").select("*", "_newest.*").select(*columns)


def refresh(
    spark: SparkSession,
    landing: str,
    schema: T.StructType | str,
    index: str,
    progress: str,
    key: str,
    text: str,
    version: str,
    provider: Callable[[], EmbeddingClient],
    file_format: str = "parquet",
    files_per_batch: int | None = None,
    deleted: str | None = None,
) -> None:
    """Embed everything landed since the last call and add it to ``index``, then stop.

    Each micro-batch keeps the latest row per key by ``version`` (a column that grows with
    every change, such as a commit time), embeds ``text`` and publishes it as a run of the index. A batch replayed after
    a failure does only what is missing, so nothing doubles. ``progress`` holds the stream's checkpoint. Both must
    lie on storage all executors share, and belong together: an index whose progress is gone is an error.

    ``deleted`` names a boolean column that marks deletes. Such a row isn't embedded and hides its key from readers until a
    higher version lands; it is kept, as an older row of the key may still land late.
    """
    if _published_runs(spark, index) and not exists(spark, f"{progress}/metadata"):
        raise ValueError(f"{index} has runs, but no stream in {progress} wrote them")
    stream = spark.readStream.format(file_format).schema(schema)
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        session, own = batch.sparkSession, (batch_id, batch_id)
        if not any(_covers(run, own) for run in _published_runs(session, index)) and not batch.isEmpty():
            changed = latest_rows(batch, key, version)
            said = F.col(text) if deleted is None else F.when(~F.coalesce(F.col(deleted), F.lit(False)), F.col(text))
            publish(changed.withColumn("_e", embed(said, provider)).select(
                *changed.columns, F.col("_e.vector").alias("embedding"), F.col("_e.error").alias("embedding_error"),
                F.lit(batch_id).cast("long").alias("batch_id"),
            ), _path(index, own))
        # The carry of the counter: the lowest set bit says how many batches the new run spans.
        span = (batch_id + 1) & -(batch_id + 1)
        target = (batch_id + 1 - span, batch_id)
        parts = [run for run in runs(session, index) if _covers(target, run)]
        if len(parts) > 1:
            publish(_newest(session, index, parts, key, version), _path(index, target))

    query = (
        stream.load(landing).writeStream.foreachBatch(write)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_index(spark: SparkSession, index: str, key: str, version: str, deleted: str | None = None) -> DataFrame:
    """The search copy as it stands: the latest row per key over all runs, without the deleted ones."""
    live = runs(spark, index)
    if not live:
        raise FileNotFoundError(f"no run has been published in {index}")
    rows = _newest(spark, index, live, key, version).drop("batch_id")
    return rows if deleted is None else rows.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
