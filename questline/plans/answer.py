"""Answering job: a batch of questions to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from questline.config import EMBEDDING_DIM, RETRIEVAL_K
from questline.functions.text import SYSTEM_INSTRUCTION
from questline.operators import answering
from questline.operators.enrich import EmbeddingClient, TextClient
from questline.plans import store as names
from questline.plans.store import Store
from questline.session import cut_lineage


def answer_questions(
    store: Store,
    questions: DataFrame,
    text_provider: Callable[[], TextClient],
    embedding_provider: Callable[[], EmbeddingClient],
    model: str,
    *,
    k: int = RETRIEVAL_K,
    dim: int = EMBEDDING_DIM,
    filtered: bool = True,
    system: str | None = SYSTEM_INSTRUCTION,
    completion: bool = False,
) -> DataFrame:
    """One row per question with ``full_prompt``, ``sql`` and ``answer_error``.

    ``questions`` has a unique ``question_id``, ``prompt`` and, optionally,
    ``schema_filter`` and ``table_filter``. The plain chain is ``filtered=False``; a
    fine-tuned completion model takes ``system=None, completion=True``.
    """
    asked = answering.with_filters(questions) if filtered else questions
    asked = cut_lineage(answering.with_vectors(asked, "prompt", embedding_provider, "question_embeddings"))
    hits = answering.retrieve(asked, store.read(names.STATEMENTS), k, dim, filtered)
    mined = answering.mine(asked, hits)
    prompted = answering.answer_prompts(mined, store.read(names.TABLE_ROWS), system)
    return answering.answers(prompted, text_provider, model, completion).drop("question_embeddings")
