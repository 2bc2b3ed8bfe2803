"""Tables replaced as a whole: every version in a folder of its own, and a manifest that names the current one.

A version is written first, then the manifest is swapped by one rename. Readers resolve the manifest once and keep
reading that version, so a failed or unfinished overwrite is never seen, and a job may replace a table it
reads. Old versions stay until :func:`drop_old` is called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_VERSIONS, _MANIFEST = "_versions", "_current"


def _files(spark: SparkSession, path: str):
    """The file context of a path, and a maker of paths below it."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(base.getFileSystem(conf).getUri(), conf)
    return context, lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    folder, name = path.rsplit("/", 1)
    context, at = _files(spark, folder)
    return context.util().exists(at(name))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    if not exists(spark, path):
        return []
    context, _ = _files(spark, path)
    return [status.getPath().getName() for status in context.util().listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))]


def remove(spark: SparkSession, path: str) -> None:
    context, _ = _files(spark, path)
    context.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the table's current version; None if nothing has been published."""
    context, at = _files(spark, path)
    if not context.util().exists(at(_MANIFEST)):
        return None
    stream = context.open(at(_MANIFEST))
    try:
        return f"{path}/{_VERSIONS}/{stream.readUTF()}"
    finally:
        stream.close()


def publish(df: DataFrame, path: str, mode: str = "overwrite",
            audit: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Write ``df`` as the new version of the table and return it.

    ``append`` adds the rows to the current version as a new one; ``errorifexists`` fails if there is one.
    ``audit`` gets the written version before readers do; if it raises, they keep the one before.
    """
    spark = df.sparkSession
    now = current(spark, path)
    if mode == "errorifexists" and now is not None:
        raise ValueError(f"{path} exists already")
    if mode not in ("overwrite", "append", "errorifexists"):
        raise ValueError("mode must be overwrite, append or errorifexists")
    version = uuid.uuid4().hex
    rows = spark.read.parquet(now).unionByName(df) if mode == "append" and now is not None else df
    rows.write.parquet(f"{path}/{_VERSIONS}/{version}")
    if audit is not None:
        audit(spark.read.parquet(f"{path}/{_VERSIONS}/{version}"))
    context, at = _files(spark, path)
    jvm = spark._jvm
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    stream = context.create(at(f"{_MANIFEST}.{version}"), flags, none)
    stream.writeUTF(version)
    stream.close()
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(at(f"{_MANIFEST}.{version}"), at(_MANIFEST), renames)
    return read_published(spark, path)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The current version, to which this DataFrame is pinned."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no table has been published in {path}")
    return spark.read.parquet(folder)


def drop_old(spark: SparkSession, path: str) -> int:
    """Remove all versions but the current one, once no reader is pinned to them; returns how many."""
    now, (context, at) = current(spark, path), _files(spark, path)
    removed = 0
    if now is not None:
        for status in context.util().listStatus(at(_VERSIONS)):
            if status.getPath().getName() != now.rsplit("/", 1)[1]:
                context.delete(status.getPath(), True)
                removed += 1
    return removed
