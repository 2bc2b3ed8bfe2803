"""Training job: searchable tables to prompt/response pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from questline.config import EMBEDDING_DIM, NEIGHBOURS
from questline.operators import training
from questline.plans import store as names
from questline.plans.store import Store
from questline.sources.tables import save_json_lines


def build_training_set(
    store: Store,
    k: int = NEIGHBOURS,
    dim: int = EMBEDDING_DIM,
    ties: str = "first",
    json_folder: str | None = None,
) -> DataFrame:
    """Writes the matches and the training rows, and the JSON lines when a folder is given.

    ``ties="rank"`` keeps all matches tied on the last rank, a square number of rows where many
    questions are equal; the default keeps exactly ``k``.
    """
    statements = store.read(names.STATEMENTS)
    matches = store.save(training.top_matches(statements, k, dim, ties), names.TOP_MATCHES)
    rows = training.training_rows(matches, statements, store.read(names.TABLE_ROWS))
    rows = store.save(rows, names.TRAINING)
    if json_folder is not None:
        save_json_lines(training.training_pairs(rows), json_folder)
    return rows
