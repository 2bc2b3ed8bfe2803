"""Query op4: toxicity of all documents by maximum-scoring segments."""

from pyspark.sql import functions as F

from questline.llm import toxicity
from questline.llm.common import held_out, read

CUT = 0.7


def op4_toxic_segments(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return toxicity.train_and_score(docs, read(spark, d, "labels")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


QUERIES = {"op4_toxic_segments": op4_toxic_segments}
ORACLE: dict[str, str] = {}
