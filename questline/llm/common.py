"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questline.session import cut_lineage

BATCH_BYTES = 32 * 1024 * 1024  # of an Arrow batch on its way to a Python worker

FEW_ROWS = 4096   # of a looked-up table, up to which it is broadcast
SALTS = 64        # parts a key's rows are dealt to where it is larger

HELD_OUT_FOLD = 1
FOLDS = 3


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes as well as by rows, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def per_text(schema: str, make: Callable[[], Callable[[str | None], tuple]]) -> Callable[[Column], Column]:
    """A column function from one text to the fields of ``schema``.

    ``make`` is called once per task and returns the function for one text.
    """
    names = [field.strip().split(" ")[0] for field in schema.split(",")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = make()
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=names)

    return run


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from learning; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def learnable_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y``: the 0/1 labels that may be learned from, one row an id.

    Ids that are held out, null labels and ids whose labels disagree teach nothing. A label
    table with repeated rows counts each id once.
    """
    return (
        labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_most"))
        .filter(F.col("y") == F.col("_most")).select("doc_id", F.col("y").cast("int").alias("y"))
    )


def learnable(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, text, y``: texts with a label that may be learned from.

    Labels grow with the corpus, so they are never broadcast, and the plan is the same at every size.
    """
    return docs.select("doc_id", "text").join(learnable_labels(labels, label).hint("merge"), "doc_id")


def arrays(rows: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a table of bounded size, brought to the driver as Arrow batches instead of rows."""
    table = rows.toArrow()
    return {name: table[name].to_numpy() for name in table.column_names}


def smallest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The documented, bounded sample for a fit: the ``n`` rows with the lowest hash of ``key``."""
    return rows.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(n)


def look_up(left: DataFrame, right: DataFrame, on: str, spread: str) -> DataFrame:
    """``left`` joined to ``right``, which has one row for each value of ``on``.

    One key may hold a third of ``left``. A right side of up to FEW_ROWS rows is broadcast after
    they have been counted; a longer one is repeated SALTS times, and the rows of every key
    dealt out by a hash of ``spread``. The result is the same.
    """
    right = cut_lineage(right)
    if right.count() <= FEW_ROWS:
        return left.join(F.broadcast(right), on)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [on, "_salt"]).drop("_salt")
