"""Query op8: all documents in eight shards along the Hilbert curve."""

from pyspark.sql import functions as F

from questline.llm.common import read
from questline.llm.sharding import shard


def op8_hilbert(spark, d):
    rows = read(spark, d, "documents").select(
        "doc_id", "source", "lang", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard(rows, tie=("doc_id", "text_crc32"), size=F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


QUERIES = {"op8_hilbert": op8_hilbert}
ORACLE: dict[str, str] = {}
