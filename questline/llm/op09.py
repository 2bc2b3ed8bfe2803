"""Query op9: all documents scored by cross-entropy difference; the target is text labelled good."""

from pyspark.sql import functions as F

from questline.llm import lm_scoring
from questline.llm.common import read


def op9_xent_difference(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    good = read(spark, d, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring.score(docs, targets=good).select("doc_id", "n_words", "target_loss", "background_loss", "difference")


QUERIES = {"op9_xent_difference": op9_xent_difference}
ORACLE: dict[str, str] = {}
