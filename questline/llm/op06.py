"""Query op6: all documents with pseudonyms for personal numbers and dates."""

from questline.llm.common import read
from questline.llm.pseudonyms import with_pseudonyms


def op6_feistel_pseudonyms(spark, d):
    return with_pseudonyms(read(spark, d, "documents").select("doc_id", "text"))


QUERIES = {"op6_feistel_pseudonyms": op6_feistel_pseudonyms}
ORACLE: dict[str, str] = {}
