"""From a batch of questions to prompts and SQL: retrieve, mine, look up, assemble, generate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questline.config import EMBEDDING_DIM, RETRIEVAL_K
from questline.functions.text import SYSTEM_INSTRUCTION, build_prompt, completion_text
from questline.operators.catalog import definitions_for
from questline.operators.enrich import EmbeddingClient, TextClient, embed, generate
from questline.operators.lookup import lookup
from questline.operators.nearest import nearest, nearest_marked
from questline.operators.vector_file import nearest_coded
from questline.session import cut_lineage


def _no_names() -> Column:
    return F.array().cast("array<string>")


def with_filters(questions: DataFrame) -> DataFrame:
    """Questions with both filters as distinct arrays; absent ones become empty.

    A single table name is wrapped into a list. Where both are given, the schema filter
    wins and the table filter is emptied.
    """

    def names(column: str) -> Column:
        if column not in questions.columns:
            return _no_names()
        given = F.col(column)
        if isinstance(questions.schema[column].dataType, T.StringType):
            given = F.when(given != "", F.array(given))
        return F.coalesce(F.array_distinct(F.array_compact(given)), _no_names())

    kept = [c for c in questions.columns if c not in ("schema_filter", "table_filter")]
    both = questions.select(
        *kept, names("schema_filter").alias("schema_filter"), names("table_filter").alias("table_filter")
    )
    return both.withColumn(
        "table_filter", F.when(F.size("schema_filter") > 0, _no_names()).otherwise(F.col("table_filter"))
    )


def _marked(mark: str, names: str) -> Column:
    given = F.coalesce(F.array_distinct(F.array_compact(F.col(names))), _no_names())
    return F.transform(given, lambda x: F.concat(F.lit(mark), x))


def retrieve(
    questions: DataFrame,
    statements: DataFrame,
    k: int = RETRIEVAL_K,
    dim: int = EMBEDDING_DIM,
    filtered: bool = True,
    **search,
) -> DataFrame:
    """The ``k`` past statements most similar to each question, ties by statement id.

    ``questions`` has ``question_id, question_embeddings`` and, when ``filtered``, the
    arrays of :func:`with_filters`. A filter lets a statement in when any of its schemas
    (or tables) is named; the statement may use others too. Each vector lies in the index
    once, with its names beside it; questions with a filter visit the blocks that hold one of theirs.
    """
    names = dict(query_id="question_id", corpus_id="statement_id",
                 query_vector="question_embeddings", corpus_vector="question_embeddings")
    if filtered:
        wanted = F.concat(_marked("schema ", "schema_filter"), _marked("table ", "table_filter"))
        wanted = F.when(F.size("schema_filter") > 0, _marked("schema ", "schema_filter")).otherwise(wanted)
        asked = cut_lineage(questions.select("question_id", "question_embeddings", wanted.alias("wanted")))
        carried = F.concat(_marked("schema ", "schema_list"), _marked("table ", "table_list"))
        offered = statements.select("statement_id", "question_embeddings", carried.alias("carried"))
        found = nearest(asked.filter(F.size("wanted") == 0), statements, **names, k=k, ties="first", dim=dim, **search)
        found = found.unionByName(nearest_marked(
            asked.filter(F.size("wanted") > 0), offered, **names, query_marks="wanted", corpus_marks="carried", k=k,
            dim=dim, **{name: v for name, v in search.items() if name == "block_rows"}))
    else:
        found = nearest(questions, statements, **names, k=k, ties="first", dim=dim, **search)
    hits = cut_lineage(found.select(
        F.col("query_id").alias("question_id"), F.col("corpus_id").alias("statement_id"), "score", "place"
    ))
    details = statements.select(
        "statement_id", "generated_question", "statement_text", "manual_summarization", "table_list"
    )
    # A statement may be a hit of very many questions: a hot key of this lookup.
    return lookup(hits, details, ["statement_id"], F.col("question_id"), how="inner")


def mine(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Each question with its sample queries (best first) and the tables to describe.

    Tables are those of the hits, by name; a table filter replaces them. Questions without
    hits keep their row.
    """
    sample = F.struct("place", "statement_id", F.col("generated_question").alias("question"),
                      F.col("statement_text").alias("sql"))
    mined = hits.groupBy("question_id").agg(
        F.array_sort(F.collect_list(sample)).alias("found"),
        F.flatten(F.collect_list(F.coalesce(F.array_compact("table_list"), _no_names()))).alias("hit_tables"),
    )
    samples = F.transform(
        F.col("found"), lambda s: F.struct(s["question"].alias("question"), s["sql"].alias("sql"))
    )
    tables = F.coalesce(F.array_sort(F.array_distinct("hit_tables")), _no_names())
    if "table_filter" in questions.columns:
        tables = F.when(F.size("table_filter") > 0, F.array_sort("table_filter")).otherwise(tables)
    joined = questions.join(mined, "question_id", "left")
    nothing = F.array().cast("array<struct<question: string, sql: string>>")
    return joined.select(
        *questions.columns, F.coalesce(samples, nothing).alias("sample_queries"), tables.alias("tables")
    )


def answer_prompts(
    mined: DataFrame, table_search: DataFrame, system: str | None = SYSTEM_INSTRUCTION, escape: bool = True
) -> DataFrame:
    """Adds ``table_definitions``, ``full_prompt`` and, for chat models, ``system_prompt``.

    ``mined`` is written once, as its texts and its table names go separate ways.
    """
    mined = cut_lineage(mined)
    described = definitions_for(mined.select("question_id", "tables"), "question_id", "tables", table_search, escape)
    prompted = mined.join(described, "question_id").withColumn(
        "full_prompt", build_prompt(F.col("prompt"), F.col("table_definitions"), F.col("sample_queries"))
    )
    return prompted if system is None else prompted.withColumn("system_prompt", F.lit(system))


def answers(
    prompted: DataFrame, provider: Callable[[], TextClient], model: str, completion: bool = False
) -> DataFrame:
    """Adds ``sql`` and ``answer_error``.

    With a system prompt, the client gets it as an argument of its own.
    ``completion=True`` reads the text out of a completion endpoint's JSON response.
    """
    system = F.col("system_prompt") if "system_prompt" in prompted.columns else None
    asked = prompted.withColumn("_reply", generate(F.col("full_prompt"), F.lit(model), provider, system=system))
    text = F.col("_reply.text")
    return asked.select(
        *prompted.columns,
        (completion_text(text) if completion else text).alias("sql"),
        F.col("_reply.error").alias("answer_error"),
    )


def with_vectors(rows: DataFrame, text: str, provider: Callable[[], EmbeddingClient], vector: str) -> DataFrame:
    """Rows with the embedding of their ``text`` column; write them to a table before searching."""
    return rows.withColumn(vector, embed(F.col(text), provider)["vector"])


def search_rows(
    questions: DataFrame, rows: DataFrame, key: str, vector: str, k: int = RETRIEVAL_K,
    dim: int = EMBEDDING_DIM, coded: bool = False, **search,
) -> DataFrame:
    """The ``k`` rows most similar to each question, ties by ``key``; both sides embedded.

    ``coded`` searches a vector-approximation file, which moves a quarter of the bytes and suits wide vectors.
    For table rows (``full_table``), column rows (``id``) and past questions
    (``statement_id``).
    """
    names = dict(query_id="question_id", corpus_id=key, query_vector="question_embeddings", corpus_vector=vector)
    if coded:
        found = nearest_coded(questions, rows, **names, k=k, dim=dim, **search)
    else:
        found = nearest(questions, rows, **names, k=k, ties="first", dim=dim, **search)
    return found.select(
        F.col("query_id").alias("question_id"), F.col("corpus_id").alias(key), "score", "place"
    )
