"""Query-log and catalog inputs derived row by row from the test tables.

The expressions below are plain SQL that Spark and the checking engine read alike, so both
derive the same rows. Every input grows with its table: the log with ``events``, the
catalog's tables with ``orders`` and its columns with ``lineitem``, statements and questions
with ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 64


def text(expr: str) -> str:
    return f"cast({expr} as string)"


def _quarter(k: str) -> str:
    return f"cast(floor(({k}) / 4) as bigint)"


# A catalog name for every whole number k, so that names unique alone (orders_*), unique with
# their schema (items_*) and unique only with their catalog (events_*) all occur.
def catalog_of(k: str) -> str:
    return f"(case when ({k}) % 4 <> 3 then 'sales' when {_quarter(k)} % 2 = 0 then 'lake' else 'lab' end)"


def schema_of(k: str) -> str:
    return f"(case ({k}) % 4 when 3 then 'raw' when 2 then 'curated' else 'main' end)"


def name_of(k: str) -> str:
    half = f"cast(floor({_quarter(k)} / 2) as bigint)"
    return (f"(case ({k}) % 4 when 0 then 'orders_' || {text(_quarter(k))} "
            f"when 3 then 'events_' || {text(half)} else 'items_' || {text(_quarter(k))} end)")


def schema_path_of(k: str) -> str:
    return f"({catalog_of(k)} || '.' || {schema_of(k)})"


def path_of(k: str) -> str:
    return f"({schema_path_of(k)} || '.' || {name_of(k)})"


_QUOTE = "chr(39)"
_NUMBER = text("event_id % 997")
_USER = text("user_id")
_MANY_COLUMNS = ", ".join(f"a.c{i:02d}" for i in range(1, 41))

STATEMENT = f"""(case event_id % 6
    when 0 then 'select count(*) from ' || {path_of('user_id')} || ' where event_type = '
        || {_QUOTE} || event_type || {_QUOTE}
    when 1 then 'select a.id, {_MANY_COLUMNS}, b.total from ' || {path_of('user_id')} || ' a join '
        || {path_of('user_id + 1')} || ' b on a.id = b.id where b.qty > ' || {_NUMBER}
    when 2 then 'with recent as (select * from orders_' || {_USER} || ' where qty < ' || {_NUMBER}
        || ') select r.id, t.total from recent r join ' || {path_of('user_id')} || ' t on r.id = t.id'
    when 3 then 'select * from ' || {path_of('4 * user_id + 3')} || ' where kind = "' || event_type || '"'
    when 4 then 'SELECT O_ID FROM MAIN.ORDERS_' || {_USER} || ' WHERE STATUS = '
        || {_QUOTE} || event_type || {_QUOTE}
    else case when event_id % 12 = 5 then 'select ' || {_NUMBER}
        else 'select i.id from curated.items_' || {_USER} || ' i, main.items_' || {_USER}
            || ' j where i.id = j.id and i.qty > ' || {_NUMBER} end
    end)"""

HISTORY = {
    "account_id": "cast(null as string)",
    "workspace_id": "cast(null as string)",
    "statement_id": f"'q' || {text('event_id')}",
    "executed_by": f"'user' || {_USER}",
    "session_id": "cast(null as string)",
    "execution_status": "case when event_type = 'error' then 'FAILED' else 'FINISHED' end",
    "warehouse_id": f"'wh' || {text('user_id % 4')}",
    "executed_by_user_id": "user_id",
    "statement_text": STATEMENT,
    "statement_type": "case when event_type = 'signup' then 'INSERT' else 'SELECT' end",
    "error_message": "cast(null as string)",
    "warehouse_channel": "cast(null as string)",
    "client_application": "cast(null as string)",
    "start_time": "ts",
}

# What a model would answer when asked for a statement's tables; eight forms are broken.
_DOUBLE = "chr(34)"


def _listed(*names: str) -> str:
    items = f" || {_DOUBLE} || ', ' || {_DOUBLE} || ".join(names)
    return f"('```json' || chr(10) || '{{' || {_DOUBLE} || 'tables' || {_DOUBLE} || ': [' || {_DOUBLE} || {items} || {_DOUBLE} || ']}}' || chr(10) || '```')"


MODEL_OUTPUT = f"""(case event_id % 48
    when 40 then 'no tables here'
    when 41 then '{{' || {_DOUBLE} || 'tables' || {_DOUBLE} || ': []}}'
    when 42 then '] ['
    when 43 then '{{' || {_DOUBLE} || 'tables' || {_DOUBLE} || ': [' || {_DOUBLE} || 'a' || {_DOUBLE}
    when 44 then '[' || {_DOUBLE} || 'A' || {_DOUBLE} || ' ' || {_DOUBLE} || 'b' || {_DOUBLE} || ']'
    when 45 then '[' || {_QUOTE} || 'a' || {_QUOTE} || ']'
    when 46 then '[' || {_DOUBLE} || 'my' || chr(92) || '_table' || {_DOUBLE} || ', ' || {_DOUBLE} || '`X`.y' || {_DOUBLE} || ']'
    when 47 then cast(null as string)
    else case event_id % 6
        when 0 then {_listed(path_of('user_id'))}
        when 1 then {_listed(path_of('user_id'), path_of('user_id + 1'))}
        when 2 then {_listed(f"'orders_' || {_USER}", path_of('user_id'))}
        when 3 then {_listed(path_of('4 * user_id + 3'))}
        when 4 then {_listed(f"'MAIN.ORDERS_' || {_USER}")}
        else {_listed(f"'curated.items_' || {_USER}", f"'main.items_' || {_USER}")}
        end
    end)"""

TABLES = {
    "table_catalog": catalog_of("o_orderkey"),
    "table_schema": schema_of("o_orderkey"),
    "table_name": name_of("o_orderkey"),
    "table_type": "case when o_orderkey % 5 = 0 then 'VIEW' else 'MANAGED' end",
    "comment": f"""case when o_orderkey % 7 = 0 then '' when o_orderkey % 3 = 0 then cast(null as string)
        when o_orderkey % 3 = 1 then 'orders of customer ' || {text('o_custkey')}
        else 'customer' || {_QUOTE} || 's priority ' || o_orderpriority end""",
}

# One row per order and line number; repeated line numbers are folded.
COLUMNS = {
    "table_catalog": catalog_of("l_orderkey"),
    "table_schema": schema_of("l_orderkey"),
    "table_name": name_of("l_orderkey"),
    "column_name": f"'c' || {text('l_linenumber')} || '_' || lower(max(l_returnflag))",
    "full_data_type": "case when max(l_linestatus) = 'O' then 'bigint' else 'decimal(12,2)' end",
    "is_nullable": "case when max(l_quantity) > 25 then 'YES' else 'NO' end",
    "comment": f"""case l_linenumber % 3 when 0 then cast(null as string)
        when 1 then 'part ' || {text('max(l_partkey)')}
        else 'supplier' || {_QUOTE} || 's no. ' || {text('max(l_suppkey)')} end""",
    "ordinal_position": "l_linenumber",
}

_VEC = text("vec_id")
STATEMENTS = {
    "statement_id": f"'s' || {_VEC}",
    "generated_question": f"'question ' || {_VEC} || ' about topic ' || {text('label')}",
    "statement_text": f"'select c' || {_VEC} || ' from ' || {path_of('label')}",
    "manual_summarization": f"'summary of statement ' || {_VEC}",
    "question_embeddings": "embedding",
}
# Tables of a statement (none for some) and the names a question filters on.
STATEMENT_TABLES = ("vec_id % 25 <> 7", [path_of("label"), path_of("((label + 1) % 10)")])
STATEMENT_SCHEMAS = ("vec_id % 25 <> 7", [schema_path_of("label"), schema_path_of("((label + 1) % 10)")])
QUESTIONS = {
    "question_id": f"'n' || {_VEC}",
    "prompt": f"'show item ' || {_VEC} || ' of topic ' || {text('label')}",
    "question_embeddings": "embedding",
}
SCHEMA_FILTER = ("vec_id % 3 = 1", [schema_path_of("((label + 3) % 10)"), schema_path_of("((label + 5) % 10)")])
TABLE_FILTER = ("vec_id % 3 = 2 or vec_id % 30 = 1", [path_of("((label + 2) % 10)"), path_of("((label + 2) % 10)")])

SEARCH_QUESTION = f"'find ' || {catalog_of('s_suppkey')} || ' ' || {schema_of('s_suppkey')} || ' ' || {name_of('s_suppkey')} || ' of customer ' || {text('s_nationkey')}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} as {name}" for name, expr in columns.items()])


def history(spark: SparkSession, sf_dir: str, extra: dict[str, str] | None = None) -> DataFrame:
    end = {"end_time": "timestampadd(SECOND, event_id % 300, ts)"}
    return _select(read(spark, sf_dir, "events"), {**HISTORY, **end, **(extra or {})})


def history_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as the history API would page it, 1,000 rows to a page."""
    rows = history(spark, sf_dir, {"event_id": "event_id", "ts": "ts"})
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    entry = F.struct(
        F.col("event_id").alias("place"),
        F.col("statement_id").alias("query_id"), F.col("executed_by").alias("user_name"),
        F.col("execution_status").alias("status"), "warehouse_id",
        F.col("executed_by_user_id").alias("user_id"), F.col("statement_text").alias("query_text"),
        "statement_type", "error_message",
        F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("web").alias("name"))).alias("channel_used"),
        millis.alias("query_start_time_ms"),
        (millis + (F.col("event_id") % 300) * 1000).alias("execution_end_time_ms"),
    )
    paged = rows.groupBy(F.floor(F.col("event_id") / 1000).alias("page_no")).agg(
        F.array_sort(F.collect_list(entry)).alias("res")
    )
    return paged.select(
        "page_no",
        F.transform("res", lambda e: e.dropFields("place")).alias("res"),
        F.lit(True).alias("has_next_page"),
        F.concat(F.lit("page"), F.col("page_no") + 1).alias("next_page_token"),
    )


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "statement_id": HISTORY["statement_id"], "statement_text": STATEMENT,
        "manual_table_list": MODEL_OUTPUT,
    }
    return _select(read(spark, sf_dir, "events"), columns)


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read(spark, sf_dir, "orders"), TABLES)


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return grouped.agg(*[F.expr(e).alias(n) for n, e in COLUMNS.items()]).select(*COLUMNS)


def _names(rule: tuple[str, list[str]], absent: str) -> Column:
    condition, names = rule
    listed = F.array(*[F.expr(n) for n in names])
    return F.when(F.expr(condition), listed).otherwise(F.expr(absent))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = "cast(array() as array<string>)"
    return read(spark, sf_dir, "embeddings").select(
        *[F.expr(e).alias(n) for n, e in STATEMENTS.items()],
        F.array_distinct(_names(STATEMENT_SCHEMAS, empty)).alias("schema_list"),
        F.array_distinct(_names(STATEMENT_TABLES, empty)).alias("table_list"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    absent = "cast(null as array<string>)"
    return read(spark, sf_dir, "embeddings").select(
        *[F.expr(e).alias(n) for n, e in QUESTIONS.items()],
        _names(SCHEMA_FILTER, absent).alias("schema_filter"),
        _names(TABLE_FILTER, absent).alias("table_filter"),
    )


def search_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(
        f"'f' || {text('s_suppkey')} as question_id", f"{SEARCH_QUESTION} as prompt"
    )
