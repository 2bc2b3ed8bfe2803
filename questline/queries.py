"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questline import fixtures as fx
from questline.functions.sql_functions import register_definition_lookup
from questline.functions.table_names import extract_tables
from questline.functions.text import build_prompt, completion_text, mask_literals
from questline.functions.vectors import cosine
from questline.operators import answering, catalog, enrich, history, references, training
from questline.session import cut_lineage, new_path
from questline.sources import history_pages as pages
from questline.sources import tables as store
from questline.streaming.refresh import read_index, refresh

DIM = fx.DIM
PAGE_CAP = 3500
TEXT_PROVIDER = enrich.whole_text_provider
EMBED_PROVIDER = enrich.hashed_words_provider(DIM)

Query = Callable[[SparkSession, str], DataFrame]


# --- history ---------------------------------------------------------------------------------

def _landed(spark, d):
    folder = new_path(spark, "history-pages")
    fx.history_pages(spark, d).write.json(folder)
    return pages.read_pages(spark, folder)


def _millis(df):
    return df.withColumn("start_time", F.unix_millis("start_time")).withColumn(
        "end_time", F.unix_millis("end_time")
    )


def hist_pages(spark, d):
    rows = pages.pages_to_history(_landed(spark, d), workspace_id="w1")
    return _millis(pages.empty_history(spark).unionByName(rows))


def hist_page_cap(spark, d):
    kept = pages.capped_pages(_landed(spark, d), PAGE_CAP)
    return kept.select("page_no", F.size("res").cast("bigint").alias("n_rows"))


def hist_mask(spark, d):
    text = F.col("statement_text")
    return fx.history(spark, d).select(
        "statement_id", mask_literals(text).alias("masked_text"), mask_literals(text, safe=True).alias("safe_text")
    )


def hist_dedupe(spark, d):
    return history.latest_per_shape(fx.history(spark, d))


def hist_gap(spark, d):
    return history.with_next_run(fx.history(spark, d)).select(
        "statement_id", "next_statement_id", "next_end_time", "gap_minutes", F.round("gap_hours", 6).alias("gap_hours")
    )


def hist_session(spark, d):
    return history.distinct_history(fx.history(spark, d)).select(
        "statement_id", "executed_by", "warehouse_id", "statement_text", "start_time", "end_time",
        "next_statement_id", "next_statement_text", "next_end_time", "gap_minutes",
        F.round("gap_hours", 6).alias("gap_hours"),
        F.round("next_similarity_score", 6).alias("next_similarity_score"),
    )


def hist_session_meaning(spark, d):
    log = fx.history(spark, d)
    unique = cut_lineage(history.latest_per_shape(log, keep=log.columns).select(*log.columns))
    runs = cut_lineage(history.with_next_run(unique))
    return enrich.drop_reruns_by_meaning(runs, EMBED_PROVIDER).select("statement_id", "next_statement_id", "next_similarity_score")


def hist_latest(spark, d):
    return history.newest(history.with_next_run(fx.history(spark, d)), 10).select(
        "statement_id", "end_time", "next_statement_id"
    )


def hist_runs_of(spark, d):
    log = fx.history(spark, d)
    return history.runs_of(log, history.latest_per_shape(log)).select("statement_id", "statement_text", "end_time")


# --- references ------------------------------------------------------------------------------

def extract_route(spark, d):
    return fx.read(spark, d, "documents").select(
        "doc_id", references.route_model(F.col("text")).alias("extraction_model")
    )


def extract_route_anti(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    long = docs.filter(F.col("n") >= 20000).select("doc_id", F.lit("long-context").alias("extraction_model"))
    return references.append_missing(long, docs.select("doc_id"), "short-context", "doc_id")


def extract_tables_query(spark, d):
    return fx.history(spark, d).select("statement_id", extract_tables(F.col("statement_text")).alias("tables"))


def _parsed(spark, d):
    return references.parse_outputs(fx.model_outputs(spark, d))


def extract_parse(spark, d):
    return _parsed(spark, d).select("statement_id", "parsed_table_list")


def extract_errors(spark, d):
    return references.parsing_errors(_parsed(spark, d)).select("statement_id", "parsed_table_list")


def refs_split(spark, d):
    return references.split_references(_parsed(spark, d)).select(
        "statement_id", "full_table", "valid_table_name", "valid_schema_name", "valid_catalog_name"
    )


def _resolved(spark, d, strict):
    names = catalog.unique_names(fx.tables(spark, d))
    return references.resolve_references(cut_lineage(_parsed(spark, d)), names, strict).select(
        "statement_id",
        F.transform(
            "table_struct_list",
            lambda t: F.concat_ws("/", t["catalog_name"], t["schema_name"], t["table_name"]),
        ).alias("table_structs"),
        "catalog_list", "schema_list", "table_list", "matched_ind", "fixed_ind",
    )


def refs_resolve(spark, d):
    return _resolved(spark, d, strict=False)


def refs_resolve_strict(spark, d):
    return _resolved(spark, d, strict=True)


# --- catalog ---------------------------------------------------------------------------------

def _table_rows(spark, d):
    return catalog.table_rows(fx.tables(spark, d), fx.columns(spark, d))


def cat_unique(spark, d):
    return catalog.unique_names(fx.tables(spark, d))


def cat_levels(spark, d):
    return catalog.names_per_level(cat_unique(spark, d))


def cat_tables(spark, d):
    return _table_rows(spark, d)


def cat_columns(spark, d):
    return catalog.column_rows(fx.columns(spark, d))


def ddl_format(spark, d):
    return catalog.definitions(_table_rows(spark, d))


def ddl_fn(spark, d):
    _table_rows(spark, d).createOrReplaceTempView("questline_table_rows")
    register_definition_lookup(spark, "questline_table_rows")
    asked = ", ".join(f"'{n}'" for n in ("sales.main.orders_1", "lake.raw.events_0", "sales.main.nowhere"))
    return spark.sql(f"select get_table_definitions(array({asked})) as table_definitions")


def ddl_lookup(spark, d):
    asked = fx.statements(spark, d).select("statement_id", "table_list")
    return catalog.definitions_for(asked, "statement_id", "table_list", _table_rows(spark, d))


def col_lookup(spark, d):
    wanted = fx.read(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("request_id"),
        F.concat(F.expr(fx.path_of("l_orderkey")), F.lit(".c"), F.col("l_linenumber"), F.lit("_"),
                 F.lower("l_returnflag")).alias("id"),
    )
    rows = catalog.column_rows(fx.columns(spark, d))
    return catalog.lookup_rows(wanted, "request_id", rows, "id").select(
        "request_id", "id", "column_name", "data_type", "is_nullable", "comment"
    )


def table_lookup(spark, d):
    wanted = fx.read(spark, d, "events").select(
        "event_id", F.expr(fx.path_of("user_id * 7 + event_id % 5")).alias("full_table")
    )
    rows = _table_rows(spark, d).select("full_table", "table_type", "comment", "column_list")
    return catalog.lookup_rows(wanted, "event_id", rows, "full_table")


def dq_keys(spark, d):
    lines = catalog.key_violations(fx.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select(
        F.lit("lineitem").alias("source"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"), "n_rows"
    )
    names = catalog.key_violations(_table_rows(spark, d), ["full_table"]).select(
        F.lit("tables").alias("source"), F.col("full_table").alias("key"), "n_rows"
    )
    return lines.unionByName(names)


# --- similarity and training -----------------------------------------------------------------

def cosine_pairs(spark, d):
    first = fx.read(spark, d, "embeddings").select("vec_id", "embedding")
    second = first.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return first.join(second, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def sim_pairs(spark, d):
    return training.similar_pairs(fx.statements(spark, d), min_score=0.3, dim=DIM)


def _top3(spark, d, ties):
    return training.top_matches(fx.statements(spark, d), dim=DIM, ties=ties).select(
        "statement_id", "top_compared_questions.compared_statement_id",
        "top_compared_questions.question_similarity_score", "question_similarity_rank",
    )


def sim_top3(spark, d):
    return _top3(spark, d, "rank")


def sim_top3_first(spark, d):
    return _top3(spark, d, "first")


def sim_top3_classes(spark, d):
    classes, _ = training.match_classes(fx.statements(spark, d), DIM)
    return training.class_matches(classes, dim=DIM)


def prompt_build(spark, d):
    rows = fx.statements(spark, d)
    sample = F.struct(F.col("generated_question").alias("question"), F.col("statement_text").alias("sql"))
    return rows.select(
        "statement_id",
        build_prompt(F.col("generated_question"), F.col("table_list"), F.array(sample, sample)).alias("prompt"),
    )


def _training(spark, d):
    rows = fx.statements(spark, d)
    matches = cut_lineage(training.top_matches(rows, dim=DIM))
    return training.training_rows(matches, rows, _table_rows(spark, d))


def train_set(spark, d):
    return _training(spark, d)


def train_jsonl(spark, d):
    folder = new_path(spark, "training-pairs")
    store.save_json_lines(training.training_pairs(_training(spark, d)), folder)
    return spark.read.schema("prompt string, response string").json(folder)


# --- answering -------------------------------------------------------------------------------

def _hits(hits):
    return hits.select("question_id", "statement_id", "score", "place", "generated_question", "manual_summarization")


def retrieve_topk(spark, d):
    asked = fx.questions(spark, d).select("question_id", "question_embeddings")
    return _hits(answering.retrieve(asked, fx.statements(spark, d), dim=DIM, filtered=False))


def _filtered(spark, d):
    asked = answering.with_filters(fx.questions(spark, d))
    return asked, answering.retrieve(asked, fx.statements(spark, d), dim=DIM)


def retrieve_filter(spark, d):
    return _hits(_filtered(spark, d)[1])


def mine_tables(spark, d):
    asked, hits = _filtered(spark, d)
    return answering.mine(asked, hits).select(
        "question_id", "tables", F.col("sample_queries.sql").alias("sample_sql")
    )


def _prompts(spark, d):
    asked, hits = _filtered(spark, d)
    return answering.answer_prompts(answering.mine(asked, hits), _table_rows(spark, d))


def answer_prompts(spark, d):
    return _prompts(spark, d).select("question_id", "system_prompt", "full_prompt")


def answer_batch(spark, d):
    return answering.answers(_prompts(spark, d), TEXT_PROVIDER, "offline").select("question_id", "sql", "answer_error")


def response_text(spark, d):
    reply = F.when(
        F.col("role") == "user",
        F.to_json(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("candidates"))),
    ).otherwise(F.lit('{"candidates":[]}'))
    return fx.read(spark, d, "conversations").select(
        "conv_id", "turn", completion_text(reply).alias("response_text")
    )


# --- enrichment ------------------------------------------------------------------------------

def gen_questions(spark, d):
    rows = fx.history(spark, d).select("statement_id", "statement_text").withColumn(
        "extraction_model", references.route_model(F.col("statement_text"))
    )
    return enrich.with_generated_text(rows, TEXT_PROVIDER).drop("statement_text", "extraction_model")


def embed_text(spark, d):
    vector = enrich.embed(F.col("text"), EMBED_PROVIDER)["vector"]
    rows = fx.read(spark, d, "conversations").select("conv_id", "turn", vector.alias("vector"))
    return rows.select("conv_id", "turn", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


def _ingested(spark, d):
    """Runs, resolved references and summaries, each written once as in the ingest job."""
    runs = cut_lineage(history.distinct_history(fx.history(spark, d)))
    extracted = cut_lineage(runs.select(
        "statement_id", "statement_text", references.route_model(F.col("statement_text")).alias("extraction_model"),
        extract_tables(F.col("statement_text")).alias("parsed_table_list"),
    ))
    found = cut_lineage(references.resolve_references(extracted, catalog.unique_names(fx.tables(spark, d))))
    return found, enrich.with_generated_text(cut_lineage(enrich.matched_statements(runs, found)), TEXT_PROVIDER)


def summary_join(spark, d):
    _, summaries = _ingested(spark, d)
    return summaries.withColumn("next_similarity_score", F.round("next_similarity_score", 6))


def pre_index(spark, d):
    found, summaries = _ingested(spark, d)
    summaries = cut_lineage(summaries)
    vectors = cut_lineage(enrich.with_embeddings(summaries, EMBED_PROVIDER))

    def rounded(name):
        return F.transform(name, lambda x: F.round(x.cast("double"), 5)).alias(name)

    return enrich.unified_statements(summaries, vectors, found).select(
        "statement_id", "executed_by", "generated_question", "catalog_list", "schema_list", "table_list",
        rounded("question_embeddings"), rounded("statement_embeddings"),
    )


def _search(spark, d, rows, key, text):
    asked = answering.with_vectors(fx.search_questions(spark, d), "prompt", EMBED_PROVIDER, "question_embeddings")
    offered = answering.with_vectors(rows.select(key, text), text, EMBED_PROVIDER, "vector")
    return answering.search_rows(cut_lineage(asked), cut_lineage(offered), key, "vector", dim=DIM)


def search_tables(spark, d):
    return _search(spark, d, _table_rows(spark, d), "full_table", "table_search")


def search_columns(spark, d):
    return _search(spark, d, catalog.column_rows(fx.columns(spark, d)), "id", "column_search")


def search_questions(spark, d):
    return _search(spark, d, fx.statements(spark, d), "statement_id", "generated_question")


def search_coded(spark, d):
    """The same answer as retrieve_topk, from the vector-approximation file."""
    asked = fx.questions(spark, d).select("question_id", "question_embeddings")
    rows = fx.statements(spark, d).select("statement_id", F.col("question_embeddings").alias("vector"))
    return answering.search_rows(asked, rows, "statement_id", "vector", dim=DIM, coded=True)


def index_refresh(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id", "text")
    revised = docs.join(fx.read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").withColumn(
        "text", F.concat("text", F.lit(" (revised)"))
    )
    folder = new_path(spark, "index-refresh")
    landing, index, progress = f"{folder}/landing", f"{folder}/index", f"{folder}/progress"
    for version, landed in enumerate((docs, revised)):
        landed.withColumn("version", F.lit(version)).write.mode("append").parquet(landing)
        refresh(spark, landing, "doc_id bigint, text string, version int", index, progress,
                "doc_id", "text", "version", EMBED_PROVIDER)
    return read_index(spark, index, "doc_id", "version").select(
        "doc_id", "version", F.md5("text").alias("text_md5"), F.size("embedding").alias("width")
    )


QUERIES: dict[str, Query] = {
    q.__name__.removesuffix("_query"): q
    for q in (
        hist_pages, hist_page_cap, hist_mask, hist_dedupe, hist_gap, hist_session, hist_session_meaning, hist_latest, hist_runs_of,
        extract_route, extract_route_anti, extract_tables_query, extract_parse, extract_errors,
        refs_split, refs_resolve, refs_resolve_strict,
        cat_unique, cat_levels, cat_tables, cat_columns, ddl_format, ddl_fn, ddl_lookup, col_lookup, table_lookup, dq_keys,
        cosine_pairs, sim_pairs, sim_top3, sim_top3_first, sim_top3_classes, prompt_build, train_set, train_jsonl,
        retrieve_topk, retrieve_filter, mine_tables, answer_prompts, answer_batch, response_text,
        gen_questions, embed_text, summary_join, pre_index, search_tables, search_columns, search_questions, search_coded,
        index_refresh,
    )
}
