"""Similar statements that share a table, and the prompt/response rows made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from questline.config import EMBEDDING_DIM, NEIGHBOURS
from questline.functions.text import build_prompt
from questline.operators.catalog import definitions_for
from questline.operators.lookup import lookup
from questline.operators.nearest import nearest
from questline.session import cut_lineage


def _table_postings(statements: DataFrame, dim: int) -> DataFrame:
    """One row per statement and table, for statements with tables and a full embedding."""
    fit = (F.array_size("table_list") > 0) & (F.array_size("question_embeddings") == dim)
    return statements.filter(fit).select(
        "statement_id", "question_embeddings",
        F.explode(F.array_distinct(F.array_compact("table_list"))).alias("shared_table"),
    )


def _table_sharing(statements: DataFrame, dim: int, **search) -> DataFrame:
    postings = _table_postings(statements, dim)
    return nearest(
        postings, postings,
        query_id="statement_id", corpus_id="statement_id",
        query_vector="question_embeddings", corpus_vector="question_embeddings",
        query_group="shared_table", corpus_group="shared_table",
        exclude_self=True, dim=dim, **search,
    )


def similar_pairs(statements: DataFrame, min_score: float, dim: int = EMBEDDING_DIM, **search) -> DataFrame:
    """Ordered pairs of different statements that share a table and score ``min_score`` or more.

    ``min_score=-1`` is the complete pair set, which grows with the square of the statements
    of a table; the training set never needs it.
    """
    return _table_sharing(statements, dim, min_score=min_score, **search).select(
        F.col("query_id").alias("first_statement_id"),
        F.col("corpus_id").alias("second_statement_id"),
        F.col("score").alias("question_similarity_score"),
    )


def match_classes(statements: DataFrame, dim: int = EMBEDDING_DIM) -> tuple[DataFrame, DataFrame]:
    """Statements of equal embedding and equal tables as classes: ``classes`` and ``members``, both written.

    ``classes``: class_id (the lowest statement_id), n, question_embeddings, table_list. ``members``: statement_id and
    class_id. Statements without tables or a full embedding have neither. Copies are combined before the shuffle.
    """
    fit = (F.array_size("table_list") > 0) & (F.array_size("question_embeddings") == dim)
    tables = F.array_sort(F.array_distinct(F.array_compact("table_list")))
    able = cut_lineage(statements.filter(fit).select("statement_id", "question_embeddings", tables.alias("table_list")))
    key = ["question_embeddings", "table_list"]
    classes = cut_lineage(able.groupBy(*key).agg(F.min("statement_id").alias("class_id"), F.count(F.lit(1)).alias("n")))
    # One class may hold a third of all statements: a hot key of this lookup.
    members = lookup(able, classes.select(*key, "class_id"), key, F.col("statement_id"), how="inner")
    return classes, cut_lineage(members.select("statement_id", "class_id"))


def class_matches(classes: DataFrame, k: int = NEIGHBOURS, dim: int = EMBEDDING_DIM, **search) -> DataFrame:
    """``class_id, compared_class_id, n_compared, question_similarity_score, question_similarity_rank``.

    The classes in which a member of a class finds its best ``k`` statements, ties on the last rank included. Ranks are those of the
    statements: they follow from the sizes of the classes above. A class of several members is its own first
    match, with one statement less. n equal statements give one row here instead of n * (n - 1).
    """
    reps = classes.withColumnRenamed("class_id", "statement_id")
    found = _table_sharing(reps, dim, k=k, ties="rank", **search).select(
        F.col("query_id").alias("class_id"), F.col("corpus_id").alias("compared_class_id"), "score"
    )
    # A class may be a match of very many others.
    sized = lookup(cut_lineage(found), classes.select(F.col("class_id").alias("compared_class_id"), "n"),
                   ["compared_class_id"], F.col("class_id"), how="inner")
    own = classes.filter("n > 1").select("class_id", F.col("class_id").alias("compared_class_id"),
                                         F.lit(1.0).alias("score"), (F.col("n") - 1).alias("n"))
    both = sized.select("class_id", "compared_class_id", "score", "n").unionByName(own)
    of_class = Window.partitionBy("class_id")
    upto = F.sum("n").over(of_class.orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tied = F.sum("n").over(Window.partitionBy("class_id", "score"))
    return both.select(
        "class_id", "compared_class_id", F.col("n").alias("n_compared"), F.col("score").alias("question_similarity_score"),
        (upto - tied + 1).cast("int").alias("question_similarity_rank"),
    ).filter(F.col("question_similarity_rank") <= k)


def top_matches(
    statements: DataFrame, k: int = NEIGHBOURS, dim: int = EMBEDDING_DIM, ties: str = "first", **search
) -> DataFrame:
    """Best ``k`` table-sharing statements of each statement, with their rank.

    ``ties="first"`` keeps exactly ``k``, the lowest ids first. ``ties="rank"`` keeps every partner tied on the last
    rank; it is found by :func:`class_matches` and expanded at the end, so only this last join grows with
    the square of the number of equal statements. Those who can do with classes take them instead.
    """
    if ties == "rank":
        classes, members = match_classes(statements, dim)
        matches = cut_lineage(class_matches(classes, k, dim, **search))
        partners = members.select(F.col("statement_id").alias("corpus_id"), F.col("class_id").alias("compared_class_id"))
        found = matches.join(members, "class_id").join(partners, "compared_class_id").filter(
            "statement_id != corpus_id").select(
            F.col("statement_id").alias("query_id"), "corpus_id", F.col("question_similarity_score").alias("score"),
            F.col("question_similarity_rank").alias("place"))
    else:
        found = _table_sharing(statements, dim, k=k, ties=ties, **search)
    return found.select(
        F.col("query_id").alias("statement_id"),
        F.struct(
            F.col("corpus_id").alias("compared_statement_id"),
            F.col("score").alias("question_similarity_score"),
        ).alias("top_compared_questions"),
        F.col("place").alias("question_similarity_rank"),
    )


def training_rows(
    matches: DataFrame, statements: DataFrame, table_search: DataFrame, escape: bool = True
) -> DataFrame:
    """``statement_id, full_prompt, response``: the prompt holds the neighbours' questions and
    SQL (by rank, then id) and the definitions of the neighbours' tables (by name); the
    response is the statement itself.

    ``matches`` should be a written table, as it is read more than once.

    Statements without a neighbour, or whose neighbours' tables are all unknown to the
    catalog, have no row; :func:`without_prompt` lists them.
    """
    partners = matches.select(
        "statement_id",
        F.col("top_compared_questions.compared_statement_id").alias("partner_id"),
        F.col("question_similarity_rank").alias("place"),
    )
    known = statements.select(
        F.col("statement_id").alias("partner_id"), F.col("generated_question").alias("question"),
        F.col("statement_text").alias("sql"), "table_list",
    )
    # One statement may be the neighbour of very many: a hot key of this lookup.
    described = lookup(partners, known, ["partner_id"], F.col("statement_id"), how="inner")
    gathered = cut_lineage(described.groupBy("statement_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "partner_id", "question", "sql"))).alias("found"),
        F.array_compact(F.array_distinct(F.flatten(F.collect_list("table_list")))).alias("sample_tables"),
    ))
    # Written once above; the tables go their own way by id, without the texts.
    tables = definitions_for(
        gathered.select("statement_id", "sample_tables"), "statement_id", "sample_tables", table_search, escape
    ).filter(F.size("table_definitions") > 0)
    targets = statements.select("statement_id", "generated_question", "statement_text")
    joined = gathered.select("statement_id", "found").join(tables, "statement_id").join(targets, "statement_id")
    samples = F.transform("found", lambda s: F.struct(s["question"].alias("question"), s["sql"].alias("sql")))
    return joined.select(
        "statement_id",
        build_prompt(F.col("generated_question"), F.col("table_definitions"), samples).alias("full_prompt"),
        F.col("statement_text").alias("response"),
    )


def without_prompt(statements: DataFrame, training: DataFrame) -> DataFrame:
    """Statements that gave no training row."""
    return statements.join(training.select("statement_id"), "statement_id", "left_anti")


def training_pairs(training: DataFrame) -> DataFrame:
    return training.select(F.col("full_prompt").alias("prompt"), "response")
