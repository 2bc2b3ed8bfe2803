"""Query op12: two tokenizers aligned over all documents."""

from questline.llm.common import read
from questline.llm.tokenizer_alignment import token_links


def op12_tokenizer_alignment(spark, d):
    return token_links(read(spark, d, "documents"))


QUERIES = {"op12_tokenizer_alignment": op12_tokenizer_alignment}
ORACLE: dict[str, str] = {}  # SQL has no tokenizers
