"""Query op7: quality of all documents by naive Bayes support vectors."""

from pyspark.sql import functions as F

from questline.llm import quality_classifier
from questline.llm.common import held_out, read

CUT = 0.5


def op7_nbsvm_quality(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, read(spark, d, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


QUERIES = {"op7_nbsvm_quality": op7_nbsvm_quality}
ORACLE: dict[str, str] = {}
