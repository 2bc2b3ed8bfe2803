"""Query op5: fingerprint classes of all documents."""

from pyspark.sql import functions as F

from questline.llm.common import read
from questline.llm.simhash import fingerprint_components


def op5_simhash(spark, d):
    found = fingerprint_components(read(spark, d, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE: dict[str, str] = {}
