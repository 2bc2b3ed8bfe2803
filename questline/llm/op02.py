"""Query op2: all documents replicated to the target weights of their sources."""

from pyspark.sql import functions as F

from questline.llm import mixing
from questline.llm.common import read


def op2_poisson_mix(spark, d):
    mixed = mixing.mix(read(spark, d, "documents"))
    return mixed.select(
        "doc_id", "source", F.round("rate", 9).alias("rate"), "copies", "copy_no", F.round("place", 12).alias("place"),
        F.octet_length("text").alias("n_bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


QUERIES = {"op2_poisson_mix": op2_poisson_mix}
ORACLE: dict[str, str] = {}
