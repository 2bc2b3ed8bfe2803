"""From the raw statement log to one row per statement shape without near-reruns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questline.config import HOT_ROWS, RERUN_THRESHOLD
from questline.functions.text import mask_literals, word_overlap
from questline.session import cut_lineage

USER = ["warehouse_id", "executed_by"]


def finished_selects(history: DataFrame) -> DataFrame:
    """Statements worth learning from: finished SELECTs."""
    return history.filter(
        (F.col("execution_status") == "FINISHED") & (F.col("statement_type") == "SELECT")
    )


def latest_per_shape(history: DataFrame, keep: list[str] | None = None, safe_mask: bool = False) -> DataFrame:
    """The latest run of each distinct masked statement (latest end, then highest id).

    Returns ``statement_id, masked_text`` and the columns named in ``keep``. One shuffle:
    rows are combined before it, so a shape that makes up much of the log is small when it
    is sent, and the SHA-256 of the masked text is the key instead of the text. The winner
    brings its own columns along, which saves the join back to the log.
    """
    names = list(dict.fromkeys(["end_time", "statement_id", *(keep or []), "statement_text"]))
    shape = F.sha2(mask_literals(F.col("statement_text"), safe_mask), 256)
    latest = (
        finished_selects(history)
        .groupBy(shape.alias("shape"))
        .agg(F.max(F.struct(*names)).alias("run"))
    )
    return latest.select(
        F.col("run.statement_id").alias("statement_id"),
        mask_literals(F.col("run.statement_text"), safe_mask).alias("masked_text"),
        *[F.col(f"run.{c}").alias(c) for c in keep or [] if c != "statement_id"],
    )


def with_next_run(history: DataFrame, bucket: str = "HOUR", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each run with the user's next run on the same warehouse.

    Adds ``next_end_time, next_start_time, next_statement_text, next_statement_id,
    gap_minutes`` (whole minutes from this end to the next start, negative when runs
    overlap) and ``gap_hours`` (``gap_minutes / 60``).

    A user may own much of the log, so the window is cut into time buckets: within a bucket
    it is a plain ``lead``; the last run of a bucket takes the first run of the user's next
    non-empty bucket, found over one row per bucket. The result is that of one window per
    user, ordered by end time and id. Should a bucket hold more than ``hot_rows`` runs, which
    a count over the keys tells beforehand, the runs are range-partitioned by the window's
    order and each bucket is cut at the partition borders as well.

    ``history`` is read more than once and should be a written table.
    """
    following = ["end_time", "start_time", "statement_text", "statement_id"]
    owner = [f"_{c}" for c in USER]
    slot = [*owner, "_slot", "_piece"]
    # Nulls get a value of their own, so that windows and join share one plain partitioning.
    runs = history.withColumns({
        **{f"_{c}": F.coalesce(F.col(c), F.lit("\u0000")) for c in USER},
        "_slot": F.coalesce(F.date_trunc(bucket, F.col("end_time")), F.lit("0001-01-01").cast("timestamp")),
    })
    hot = runs.groupBy(*owner, "_slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows)
    if hot.isEmpty():
        runs = runs.withColumn("_piece", F.lit(0))
    else:
        ranged = runs.repartitionByRange(*owner, "end_time", "statement_id")
        # Written, so that a run keeps its partition number for good.
        runs = cut_lineage(ranged.withColumn("_piece", F.spark_partition_id()))
    in_slot = Window.partitionBy(*slot).orderBy("end_time", "statement_id")
    led = runs.withColumn("_next", F.lead(F.struct(*following)).over(in_slot))

    # One row per user and bucket: the first run, ordered like the window above.
    first = F.min(F.struct("end_time", "statement_id", "start_time", "statement_text"))
    by_user = Window.partitionBy(*owner).orderBy("_slot", "_piece")
    heads = (
        runs.groupBy(*slot).agg(first.alias("_first"))
        .withColumn("_head", F.lead(F.struct(*[F.col(f"_first.{c}") for c in following])).over(by_user))
        .select(*slot, "_head")
    )
    both = led.join(heads, slot, "left").withColumn("_next", F.coalesce("_next", "_head"))
    return both.select(
        *history.columns,
        *[F.col(f"_next.{c}").alias(f"next_{c}") for c in following],
        F.timestamp_diff("MINUTE", F.col("end_time"), F.col("_next.start_time")).alias("gap_minutes"),
    ).withColumn("gap_hours", F.col("gap_minutes") / 60)


def drop_reruns(
    runs: DataFrame,
    threshold: float = RERUN_THRESHOLD,
    similarity: Callable[[Column, Column], Column] = word_overlap,
) -> DataFrame:
    """Runs whose user's next statement differs enough (score below ``threshold``).

    A run without a next one always stays. ``similarity`` is any column function.
    """
    score = similarity(F.coalesce(F.col("next_statement_text"), F.lit("")), F.col("statement_text"))
    last = F.col("next_statement_id").isNull()
    # A filter on the score would make Spark compute it twice; exploding the kept one does not.
    kept = F.filter(F.array(score), lambda s: last | (s < threshold))
    return runs.withColumn("next_similarity_score", F.explode(kept))


def newest(runs: DataFrame, k: int) -> DataFrame:
    """The ``k`` runs that ended last (a top-k report; no job takes part of the log)."""
    return runs.orderBy(F.col("end_time").desc_nulls_last(), F.col("statement_id").desc()).limit(k)


def distinct_history(
    history: DataFrame,
    threshold: float = RERUN_THRESHOLD,
    similarity: Callable[[Column, Column], Column] = word_overlap,
) -> DataFrame:
    """One run per statement shape, near-reruns removed, with all history columns.

    The kept run of each shape is written in between, as the next step reads it repeatedly.
    """
    unique = cut_lineage(latest_per_shape(history, keep=history.columns).select(*history.columns))
    runs = with_next_run(unique)
    return drop_reruns(runs, threshold, similarity)


def runs_of(history: DataFrame, statement_ids: DataFrame) -> DataFrame:
    """History rows of the given distinct ids (``statement_id`` is unique on the right)."""
    ids = statement_ids.select("statement_id").distinct()
    return history.join(ids, "statement_id", "left_semi")
