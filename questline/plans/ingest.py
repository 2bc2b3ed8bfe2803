"""Ingest job: statement log and catalog metadata to searchable tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questline.config import LONG_MODEL, LONG_STATEMENT_CHARS, RERUN_THRESHOLD, SHORT_MODEL
from questline.functions.table_names import extract_tables
from questline.functions.text import word_overlap
from questline.operators import catalog, enrich, history, references
from questline.plans import store as names
from questline.plans.store import Store
from questline.session import cut_lineage
from questline.sources import history_pages, metadata
from questline.sources.tables import with_ordinals


def land_history(
    store: Store, folder: str, workspace_id: str | None = None, row_cap: int | None = None,
    max_broken: float = history_pages.MAX_BROKEN,
) -> DataFrame:
    """Landed API pages as the history table: every page, or those up to ``row_cap`` if it is given.

    Lines that are no pages go to a table of their own, with their file; more than ``max_broken`` of all
    lines end the job before the history table is replaced.
    """
    pages = history_pages.read_pages(store.spark, folder)
    broken = store.save(history_pages.broken_pages(store.spark, folder), names.BROKEN_PAGES)
    history_pages.check_pages(pages, broken, max_broken)
    if row_cap is not None:
        pages = history_pages.capped_pages(pages, row_cap)
    return store.save(history_pages.pages_to_history(pages, workspace_id), names.HISTORY)


def ingest_catalog(store: Store, tables: DataFrame, columns: DataFrame) -> None:
    """Unique names, table rows and column rows; their keys are checked before any is replaced."""
    columns = with_ordinals(columns)
    rows = cut_lineage(catalog.table_rows(tables, columns))
    column_rows = cut_lineage(catalog.column_rows(columns))
    for df, key in ((rows, "full_table"), (column_rows, "id")):
        broken = catalog.key_violations(df, [key]).select(key).head(5)
        if broken:
            raise ValueError(f"{key} is not a key, for example {[row[0] for row in broken]}")
    # Only checked rows replace the tables in use.
    store.save(catalog.unique_names(tables), names.UNIQUE_TABLE)
    store.save(rows, names.TABLE_ROWS)
    store.save(column_rows, names.COLUMN_ROWS)


def scan_catalog(store: Store, schemas: list[str] | None = None) -> None:
    """The catalog job over the session's own catalog (:func:`questline.sources.metadata.session_catalog`)."""
    ingest_catalog(store, *metadata.session_catalog(store.spark, schemas))


def ingest_history(
    store: Store,
    log: DataFrame,
    text_provider: Callable[[], enrich.TextClient],
    embedding_provider: Callable[[], enrich.EmbeddingClient],
    *,
    model_extraction: bool = False,
    similarity: Callable[[Column, Column], Column] = word_overlap,
    threshold: float = RERUN_THRESHOLD,
    long_chars: int = LONG_STATEMENT_CHARS,
    long_model: str = LONG_MODEL,
    short_model: str = SHORT_MODEL,
    strict: bool = False,
    replies: str | None = None,
    embedding_model: str = "",
    reruns_by_meaning: bool = False,
) -> DataFrame:
    """All history tables up to the unified one, which is returned.

    Each table is written before the next reads it, so the dedupe runs once and no model
    call is repeated when executors are lost later. A ``statement_id`` that is null or repeated after the dedupe ends the job
    before its table is replaced. ``model_extraction`` asks the text
    provider for table names instead of reading them out of the statement. ``reruns_by_meaning`` compares successive statements by
    their embeddings instead of by ``similarity``. ``replies`` is a folder in which replies
    are kept by request, so that a later run asks only what is new.
    """
    # The kept run of each shape with its history columns; the masked text is a view on it.
    unique = store.save(history.latest_per_shape(log, keep=log.columns), names.UNIQUE_HISTORY, key=["statement_id"])
    runs = history.with_next_run(unique.select(*log.columns))
    texts, embedded = (None, None) if replies is None else (f"{replies}/texts", f"{replies}/vectors")
    if reruns_by_meaning:
        runs = enrich.drop_reruns_by_meaning(cut_lineage(runs), embedding_provider, threshold, embedding_model, embedded)
    else:
        runs = history.drop_reruns(runs, threshold, similarity)
    runs = store.save(runs, names.DISTINCT_RUNS)

    text = F.col("statement_text")
    routed = runs.select("statement_id", "statement_text").withColumn(
        "extraction_model", references.route_model(text, long_chars, long_model, short_model)
    )
    if model_extraction:
        reply = enrich.generate(enrich.tables_prompt(text), F.col("extraction_model"), text_provider)
        asked = routed.withColumn("_reply", reply).select(
            *routed.columns, F.col("_reply.text").alias("manual_table_list"),
            F.col("_reply.error").alias("extraction_error"),
        )
        parsed = references.parse_outputs(store.save(asked, names.EXTRACTED))
    else:
        parsed = routed.withColumn("parsed_table_list", extract_tables(text))
    parsed = store.save(parsed, names.PARSED)
    resolved = store.save(
        references.resolve_references(parsed, store.read(names.UNIQUE_TABLE), strict), names.RESOLVED
    )
    matched = enrich.matched_statements(runs, resolved)
    summaries = store.save(
        enrich.with_generated_text(cut_lineage(matched), text_provider, folder=texts), names.SUMMARIES)
    vectors = store.save(
        enrich.with_embeddings(summaries, embedding_provider, embedding_model, embedded), names.EMBEDDINGS)
    return store.save(enrich.unified_statements(summaries, vectors, resolved), names.STATEMENTS)
