"""The registered queries as plain SQL for the checking engine, written independently.

Inputs are derived by the expressions of :mod:`questline.fixtures`; everything after that is
the direct, quadratic where need be, formulation of what each query must return.
"""

from __future__ import annotations

from questline import fixtures as fx
from questline.config import (
    LONG_STATEMENT_CHARS, PARSING_ERROR, QUESTION_WORDS, RERUN_THRESHOLD, SUMMARY_WORDS,
)
from questline.functions.text import (
    DOUBLE_QUOTED, DOUBLE_QUOTED_SAFE, INSTRUCTIONS, SINGLE_QUOTED, SINGLE_QUOTED_SAFE, SYSTEM_INSTRUCTION,
)


def q(value: str) -> str:
    """A string literal; newlines become chr(10)."""
    quoted = "'" + value.replace("'", "''") + "'"
    return "(" + quoted.replace("\n", "' || chr(10) || '") + ")"


def _select(columns: dict[str, str], source: str) -> str:
    return "select " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + f" from {source}"


def _listed(rule, absent: str) -> str:
    condition, names = rule
    return f"case when {condition} then [{', '.join(names)}] else {absent} end"


_END = {"end_time": "ts + to_seconds(event_id % 300)"}
HISTORY = f"history as ({_select({**fx.HISTORY, **_END}, 'events')})"
OUTPUTS = "outputs as (" + _select(
    {"statement_id": fx.HISTORY["statement_id"], "statement_text": fx.STATEMENT,
     "manual_table_list": fx.MODEL_OUTPUT}, "events") + ")"
TABLES = f"tables as ({_select(fx.TABLES, 'orders')})"
COLUMNS = f"columns as ({_select(fx.COLUMNS, 'lineitem')} group by l_orderkey, l_linenumber)"
_NONE = "cast([] as varchar[])"
STATEMENTS = "statements as (" + _select({
    **fx.STATEMENTS,
    "schema_list": f"list_sort(list_distinct({_listed(fx.STATEMENT_SCHEMAS, _NONE)}))",
    "table_list": f"list_sort(list_distinct({_listed(fx.STATEMENT_TABLES, _NONE)}))",
}, "embeddings") + ")"
QUESTIONS = "questions as (" + _select({
    **fx.QUESTIONS,
    "schema_filter": _listed(fx.SCHEMA_FILTER, "cast(null as varchar[])"),
    "table_filter": _listed(fx.TABLE_FILTER, "cast(null as varchar[])"),
}, "embeddings") + ")"


def _with(*parts: str, body: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + body


# --- history ---------------------------------------------------------------------------------

def _mask(single: str, double: str) -> str:
    return (f"regexp_replace(regexp_replace(statement_text, {q(single)}, '''{{value}}''', 'g'), "
            f"{q(double)}, '\"{{value}}\"', 'g')")


MASK = _mask(SINGLE_QUOTED, DOUBLE_QUOTED)
SHAPES = f"""shapes as (
    select *, {MASK} as masked_text from history
    where execution_status = 'FINISHED' and statement_type = 'SELECT'),
unique_runs as (
    select * from (
        select *, row_number() over (partition by masked_text order by end_time desc nulls last, statement_id desc) as n
        from shapes) where n = 1)"""


def _next(source: str, name: str) -> str:
    order = "over (partition by warehouse_id, executed_by order by end_time, statement_id)"
    return f"""{name} as (
        select *, lead(end_time) {order} as next_end_time, lead(start_time) {order} as next_start_time,
            lead(statement_text) {order} as next_statement_text, lead(statement_id) {order} as next_statement_id
        from {source})"""


GAP = "date_sub('minute', end_time, next_start_time)"


def _words(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> ''))"


_NEXT_WORDS = _words("coalesce(next_statement_text, '')")
_WORDS = _words("statement_text")
SESSION = _next("unique_runs", "led") + f""",
scored as (
    select *, {GAP} as gap_minutes, round({GAP} / 60.0, 6) as gap_hours,
        case when len(list_distinct(list_concat({_NEXT_WORDS}, {_WORDS}))) = 0 then 1.0
             else cast(len(list_intersect({_NEXT_WORDS}, {_WORDS})) as double)
                  / len(list_distinct(list_concat({_NEXT_WORDS}, {_WORDS}))) end as next_similarity_score
    from led),
session as (
    select * exclude (n) from scored
    where next_statement_id is null or next_similarity_score < {RERUN_THRESHOLD})"""

_PAGE = "cast(floor(event_id / 1000) as bigint)"

# --- references ------------------------------------------------------------------------------

# Patterns that find the names in the statements derived here; the library folds tokens instead.
_NAME = r"[`\w]+(?:\.[`\w]+)*(?:\s*\()?"
_ALIASED = rf"{_NAME}(?:\s+(?:as\s+)?\w+)?"
FROM_LIST = rf"(?i)\b(?:from|join)\s+({_ALIASED}(?:\s*,\s*{_ALIASED})*)"
CTE_NAME = r"(?i)(?:\bwith(?:\s+recursive)?|[,)])\s*([`\w]+)\s*(?:\([^()]*\)\s*)?as\s*\("
COMMENTS = r"(?s)--[^\n]*|/\*.*?\*/"
LITERALS = r"""'[^']*'|"[^"]*\""""

_PLAIN = (f"regexp_replace(regexp_replace(statement_text, {q(COMMENTS)}, ' ', 'g'), {q(LITERALS)}, '''''', 'g')")


def _clean(x: str) -> str:
    return f"lower(replace(trim({x}), '`', ''))"


EXTRACT = f"""list_sort(list_filter(list_distinct(list_filter(
    list_transform(
        list_filter(
            list_transform(
                flatten(list_transform(
                    regexp_extract_all({_PLAIN}, {q(FROM_LIST)}, 1), lambda x: string_split_regex(x, '\\s*,\\s*'))),
                lambda x: regexp_extract(x, {q('^(' + _NAME + ')')}, 1)),
            lambda x: not ends_with(x, '(')),
        lambda x: {_clean('x')}),
    lambda x: not list_contains(list_transform(regexp_extract_all({_PLAIN}, {q(CTE_NAME)}, 1), lambda y: {_clean('y')}), x))),
    lambda x: x <> ''))"""

_SLICE = """case when instr(manual_table_list, '[') > 0
        and instr(manual_table_list, ']') > instr(manual_table_list, '[')
    then substr(manual_table_list, instr(manual_table_list, '['),
                instr(manual_table_list, ']') - instr(manual_table_list, '[') + 1) else '' end"""
_CLEANED = f"lower(replace(replace({_SLICE}, chr(92) || '_', '_'), '`', ''))"
PARSED = f"""parsed as (
    select *, case when json_valid(cleaned) then cast(cast(cleaned as json) as varchar[])
        else ['{PARSING_ERROR}', coalesce(cleaned, '')] end as parsed_table_list
    from (select *, {_CLEANED} as cleaned from outputs))"""

UNIQUE = """unique_table as (
    select full_table_name, table_catalog, table_schema, table_name,
        case when by_name = 1 then 'TABLE' when by_pair = 1 then 'SCHEMA' else 'CATALOG' end as unique_level,
        case when by_name = 1 then 1 when by_pair = 1 then 2 else 3 end as unique_level_nbr,
        case when by_name = 1 then table_name when by_pair = 1 then table_schema || '.' || table_name
             else full_table_name end as unique_table_name
    from (
        select *, table_catalog || '.' || table_schema || '.' || table_name as full_table_name,
            count(*) over (partition by table_name) as by_name,
            count(*) over (partition by table_schema || '.' || table_name) as by_pair
        from tables))"""


def _refs(strict: bool) -> str:
    text = "statement_text" if strict else "lower(statement_text)"

    def part(n: int) -> str:
        return f"string_split(full_table, '.')[{n}]"

    def valid(n: int) -> str:
        return f"case when contains({text}, {part(n)}) then {part(n)} end"

    return f"""split as (
        select * exclude (full_table), full_table, {valid(-1)} as valid_table_name,
            {valid(-2)} as valid_schema_name, {valid(-3)} as valid_catalog_name
        from (select * exclude (parsed_table_list), unnest(parsed_table_list) as full_table from parsed))"""


def _resolve(strict: bool) -> str:
    left_out = "c.valid_schema_name" if strict else "c.valid_catalog_name"
    return f"""matched as (
        select c.statement_id, c.valid_table_name as t, c.statement_text,
            coalesce(c.valid_catalog_name, u.table_catalog) as c, coalesce(c.valid_schema_name, u.table_schema) as s,
            u.table_name is not null as matched,
            coalesce(coalesce(c.valid_catalog_name, '') <> u.table_catalog
                  or coalesce(c.valid_schema_name, '') <> u.table_schema, false) as fixed
        from split c left join unique_table u on c.valid_table_name = u.table_name
            and (c.valid_schema_name = u.table_schema or (u.unique_level_nbr = 1 and c.valid_schema_name is null))
            and (c.valid_catalog_name = u.table_catalog or (u.unique_level_nbr < 3 and {left_out} is null))),
    resolved as (
        select statement_id, list_sort(list(c || '/' || s || '/' || t)) as table_structs,
            list_sort(list_distinct(list(c))) as catalog_list,
            list_sort(list_distinct(list(c || '.' || s))) as schema_list,
            list_sort(list_distinct(list(c || '.' || s || '.' || t))) as table_list,
            bool_or(matched) as matched_ind, bool_or(fixed) as fixed_ind
        from matched where t is not null and c is not null and s is not null group by statement_id)"""


# --- catalog ---------------------------------------------------------------------------------

def _json_text(x: str) -> str:
    return f"to_json(cast({x} as varchar))"


_FULL = "table_catalog || '.' || table_schema || '.' || table_name"
_TABLE_JSON = (f"'{{\"table\":' || {_json_text(_FULL)} || case when comment is null then '' else "
               f"',\"comment\":' || {_json_text('comment')} end || '}}'")
TABLE_ROWS = f"""lines as (
    select table_catalog, table_schema, table_name,
        string_agg(column_name, ', ' order by ordinal_position, column_name) as column_list,
        string_agg('  ' || column_name || ' ' || upper(full_data_type)
            || case when comment is null then '' else ' COMMENT ''' || replace(comment, '''', '''''') || '''' end,
            ',' || chr(10) order by ordinal_position, column_name) as column_description_list
    from columns group by table_catalog, table_schema, table_name),
table_rows as (
    select t.table_catalog, t.table_schema, t.table_name,
        t.table_catalog || '.' || t.table_schema || '.' || t.table_name as full_table, t.table_type, t.comment,
        coalesce(l.column_list, '') as column_list, coalesce(l.column_description_list, '') as column_description_list,
        {_TABLE_JSON.replace('table_catalog', 't.table_catalog').replace('table_schema', 't.table_schema').replace('table_name', 't.table_name').replace('comment is', 't.comment is').replace('(comment', '(t.comment').replace('cast(comment', 'cast(t.comment')} as table_search
    from tables t left join lines l on t.table_catalog = l.table_catalog and t.table_schema = l.table_schema
        and t.table_name = l.table_name)"""
COLUMN_ROWS = f"""column_rows as (
    select {_FULL} || '.' || column_name as id, {_FULL} as full_table, column_name, is_nullable,
        full_data_type as data_type, comment,
        '{{"table":' || {_json_text(_FULL)} || ',"column_name":' || {_json_text('column_name')}
            || case when comment is null then '' else ',"comment":' || {_json_text('comment')} end || '}}' as column_search
    from columns)"""
DEFINITIONS = """definitions as (
    select full_table, 'CREATE TABLE ' || full_table || ' (' || chr(10) || column_description_list || ')'
        || case when coalesce(comment, '') = '' then '' else chr(10) || 'COMMENT ''' || replace(comment, '''', '''''') || '''' end
        || ';' as table_definition from table_rows)"""

# --- similarity, training, answering ---------------------------------------------------------

def _cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity(cast({a} as double[]), cast({b} as double[])), 6)"


FIT = f"fit as (select * from statements where len(table_list) > 0 and len(question_embeddings) = {fx.DIM})"
PAIRS = f"""pairs as (
    select a.statement_id as first_statement_id, b.statement_id as second_statement_id,
        {_cosine('a.question_embeddings', 'b.question_embeddings')} as question_similarity_score
    from fit a, fit b where a.statement_id <> b.statement_id and len(list_intersect(a.table_list, b.table_list)) > 0),
top3 as (
    select * from (
        select first_statement_id as statement_id, second_statement_id as compared_statement_id, question_similarity_score,
            cast(rank() over (partition by first_statement_id order by question_similarity_score desc) as integer)
                as question_similarity_rank
        from pairs) where question_similarity_rank <= 3)"""
FIRST3 = """first3 as (
    select first_statement_id as statement_id, second_statement_id as compared_statement_id, question_similarity_score,
        cast(n as integer) as question_similarity_rank
    from (select *, row_number() over (partition by first_statement_id
            order by question_similarity_score desc, second_statement_id) as n from pairs) where n <= 3)"""


def _prompt(question: str, definitions: str, samples: str) -> str:
    """``definitions`` and ``samples`` are lists of texts."""
    return (
        q(f"--Instructions\n/*\n{INSTRUCTIONS}\n*/\n\n--Tables\n")
        + f" || coalesce(array_to_string({definitions}, chr(10) || chr(10)), '') || "
        + q("\n\n--Sample Prompt and SQL Response\n")
        + f" || coalesce(array_to_string({samples}, chr(10) || chr(10)), '') || "
        + q("\n\n--User Prompt\n/*\n") + f" || {question} || " + q("\n*/\n\n--Your SQL Response\n")
    )


def _sample(question: str, sql: str) -> str:
    return f"{q('/*' + chr(10))} || {question} || {q(chr(10) + '*/' + chr(10))} || {sql}"


TRAINING = f"""sampled as (
    select m.statement_id, list({_sample('p.generated_question', 'p.statement_text')}
        order by m.question_similarity_rank, p.statement_id) as samples
    from first3 m join statements p on m.compared_statement_id = p.statement_id group by m.statement_id),
sample_tables as (
    select distinct m.statement_id, unnest(p.table_list) as full_table
    from first3 m join statements p on m.compared_statement_id = p.statement_id),
described as (
    select s.statement_id, list(d.table_definition order by d.full_table) as table_definitions
    from sample_tables s join definitions d on s.full_table = d.full_table group by s.statement_id),
training as (
    select t.statement_id, {_prompt('t.generated_question', 'd.table_definitions', 's.samples')} as full_prompt,
        t.statement_text as response
    from sampled s join described d on s.statement_id = d.statement_id
        join statements t on s.statement_id = t.statement_id)"""
_TRAIN = (STATEMENTS, FIT, PAIRS, FIRST3, TABLES, COLUMNS, TABLE_ROWS, DEFINITIONS, TRAINING)


def _hits(condition: str) -> str:
    return f"""hits as (
        select * from (
            select *, cast(row_number() over (partition by question_id order by score desc, statement_id) as integer) as place
            from (
                select q.question_id, s.statement_id, {_cosine('q.question_embeddings', 's.question_embeddings')} as score,
                    s.generated_question, s.statement_text, s.manual_summarization, s.table_list
                from asked q, statements s where {condition})) where place <= 4)"""


ASKED = """asked as (
    select question_id, prompt, question_embeddings, coalesce(schema_filter, []) as schema_filter,
        case when len(coalesce(schema_filter, [])) > 0 then [] else coalesce(list_distinct(table_filter), []) end as table_filter
    from questions)"""
FILTERED = _hits("""case when len(q.schema_filter) > 0 then list_has_any(s.schema_list, q.schema_filter)
                    when len(q.table_filter) > 0 then list_has_any(s.table_list, q.table_filter) else true end""")
MINED = f"""hit_lists as (
    select question_id, list(statement_text order by place) as sample_sql,
        list({_sample('generated_question', 'statement_text')} order by place) as samples,
        list_sort(list_distinct(flatten(list(table_list)))) as hit_tables
    from hits group by question_id),
mined as (
    select a.question_id, a.prompt, coalesce(h.sample_sql, []) as sample_sql, coalesce(h.samples, []) as samples,
        case when len(a.table_filter) > 0 then list_sort(a.table_filter) else coalesce(h.hit_tables, []) end as tables
    from asked a left join hit_lists h on a.question_id = h.question_id)"""
PROMPTS = f"""answer_tables as (
    select m.question_id, list(d.table_definition order by d.full_table) as table_definitions
    from (select question_id, unnest(tables) as full_table from mined) m
        join definitions d on m.full_table = d.full_table group by m.question_id),
prompts as (
    select m.question_id, {q(SYSTEM_INSTRUCTION)} as system_prompt,
        {_prompt('m.prompt', 't.table_definitions', 'm.samples')} as full_prompt
    from mined m left join answer_tables t on m.question_id = t.question_id)"""
_ANSWER = (STATEMENTS, QUESTIONS, ASKED, FILTERED, MINED, TABLES, COLUMNS, TABLE_ROWS, DEFINITIONS, PROMPTS)

# --- enrichment ------------------------------------------------------------------------------

def _answer(prompt: str) -> str:
    """What the stand-in for a text model says to a prompt."""
    return (f"""'"' || len(regexp_extract_all({prompt}, '[^ \\t\\n\\f\\r]+')) || ' words, digest ' """
            f"""|| md5({prompt}) || '"'""")


def _asked(request: str, count: int, text: str) -> str:
    return _answer(f"({q(request.format(count))} || {text})")


_SUMMARY = "Say in plain English, in at most {} words, what this SQL does:\n"
_QUESTION = "Write the user request, in at most {} words, that this SQL answers:\n"


SUMMARIES = f"""extracted as (select *, {EXTRACT} as parsed_table_list from session),
parsed as (select * from extracted),
{_refs(False)},
{_resolve(False)},
summaries as (
    select r.statement_id, r.executed_by, round(r.next_similarity_score, 6) as next_similarity_score, r.statement_text,
        case when length(r.statement_text) >= {LONG_STATEMENT_CHARS} then 'long-context' else 'short-context' end as extraction_model,
        {_asked(_SUMMARY, SUMMARY_WORDS, 'r.statement_text')} as manual_summarization,
        trim({_asked(_QUESTION, QUESTION_WORDS, 'r.statement_text')}, '"') as generated_question,
        cast(null as varchar) as generation_error
    from session r join resolved t on r.statement_id = t.statement_id and t.matched_ind)"""
_INGEST = (HISTORY, SHAPES, SESSION, TABLES, UNIQUE, SUMMARIES)


def _hashed(name: str, source: str, keys: str, text: str) -> str:
    """``name``: keys and ``vector``, the hashed-words embedding as single-precision values."""
    on = " and ".join(f"s.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    s_keys = ", ".join("s." + k.strip() for k in keys.split(","))
    return f"""{name}_words as (
        select {keys}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) as word from {source}),
    {name}_counts as (
        select {keys}, cast('0x' || substr(md5(word), 1, 8) as bigint) % {fx.DIM} as place,
            sum(1 - 2 * (cast('0x' || substr(md5(word), 9, 1) as bigint) % 2)) as v
        from {name}_words group by all),
    {name}_lengths as (select {keys}, sqrt(sum(v * v)) as size from {name}_counts group by all),
    {name}_places as (select {s_keys}, p.place, l.size from {source} s
        left join {name}_lengths l on {on.replace('c.', 'l.')}, (select unnest(range({fx.DIM})) as place) p),
    {name} as (
        select {s_keys}, list(cast(coalesce(c.v, 0) / case when coalesce(s.size, 0) = 0 then 1.0 else s.size end as float)
            order by s.place) as vector
        from {name}_places s left join {name}_counts c on {on} and s.place = c.place group by {s_keys})"""


def _rounded(vector: str) -> str:
    return f"list_transform({vector}, lambda x: round(cast(x as double), 5))"


SEARCH_QUESTIONS = (
    f"search_questions as (select 'f' || {fx.text('s_suppkey')} as question_id, {fx.SEARCH_QUESTION} as prompt from supplier)"
)


def _search(rows: str, key: str, text: str, *parts: str) -> str:
    return _with(
        *parts, SEARCH_QUESTIONS, _hashed("qv", "search_questions", "question_id", "prompt"),
        _hashed("rv", rows, key, text),
        body=f"""select question_id, {key}, score, place from (
            select *, cast(row_number() over (partition by question_id order by score desc, {key}) as integer) as place from (
                select q.question_id, r.{key}, {_cosine('q.vector', 'r.vector')} as score from qv q, rv r))
            where place <= 4""",
    )


_SESSION_COLUMNS = """statement_id, executed_by, warehouse_id, statement_text, start_time, end_time,
    next_statement_id, next_statement_text, next_end_time, gap_minutes, gap_hours"""
_PAGED = f"""select cast(null as varchar) as account_id, 'w1' as workspace_id, statement_id, executed_by,
    cast(null as varchar) as session_id, execution_status, warehouse_id, executed_by_user_id, statement_text,
    statement_type, error_message,
    case when cast(substr(statement_id, 2) as bigint) % 2 = 0 then 'web' end as warehouse_channel,
    cast(null as varchar) as client_application, epoch_us(start_time) // 1000 as start_time, epoch_us(end_time) // 1000 as end_time
    from history"""
ORACLE: dict[str, str] = {
    "hist_pages": _with(HISTORY, body=_PAGED),
    "hist_page_cap": f"""select page_no, n_rows from (
        select page_no, n_rows, coalesce(sum(n_rows) over (order by page_no rows between unbounded preceding and 1 preceding), 0) as before
        from (select {_PAGE} as page_no, count(*) as n_rows from events group by 1)) where before < 3500""",
    "hist_mask": _with(HISTORY, body=f"""select statement_id, {MASK} as masked_text,
        {_mask(SINGLE_QUOTED_SAFE, DOUBLE_QUOTED_SAFE)} as safe_text from history"""),
    "hist_dedupe": _with(HISTORY, SHAPES, body="select statement_id, masked_text from unique_runs"),
    "hist_gap": _with(HISTORY, _next("history", "led"), body=f"""select statement_id, next_statement_id, next_end_time,
        {GAP} as gap_minutes, round({GAP} / 60.0, 6) as gap_hours from led"""),
    "hist_session": _with(HISTORY, SHAPES, SESSION, body=f"""select {_SESSION_COLUMNS},
        round(next_similarity_score, 6) as next_similarity_score from session"""),
    "hist_session_meaning": _with(HISTORY, SHAPES, _next("unique_runs", "led"),
        "texts as (select distinct statement_text as text from unique_runs)", _hashed("v", "texts", "text", "text"),
        f"""compared as (select l.statement_id, l.next_statement_id, {_cosine('a.vector', 'b.vector')} as score from led l
            left join v a on l.statement_text = a.text left join v b on l.next_statement_text = b.text),
        meant as (select * replace (case when not isnan(score) then score end as score) from compared)""",
        body=f"""select statement_id, next_statement_id, score as next_similarity_score from meant
        where score is null or score < {RERUN_THRESHOLD}"""),
    "hist_latest": _with(HISTORY, _next("history", "led"), body="""select statement_id, end_time, next_statement_id
        from led order by end_time desc nulls last, statement_id desc limit 10"""),
    "hist_runs_of": _with(HISTORY, SHAPES, body="select statement_id, statement_text, end_time from unique_runs"),
    "extract_route": f"""select doc_id, case when length(text) >= {LONG_STATEMENT_CHARS} then 'long-context'
        else 'short-context' end as extraction_model from documents""",
    "extract_route_anti": f"""select doc_id, case when length(text) >= {LONG_STATEMENT_CHARS} then 'long-context'
        else 'short-context' end as extraction_model from documents""",
    "extract_tables": _with(HISTORY, body=f"select statement_id, {EXTRACT} as tables from history"),
    "extract_parse": _with(OUTPUTS, PARSED, body="select statement_id, parsed_table_list from parsed"),
    "extract_errors": _with(OUTPUTS, PARSED, body=f"""select statement_id, parsed_table_list from parsed
        where list_contains(parsed_table_list, '{PARSING_ERROR}')"""),
    "refs_split": _with(OUTPUTS, PARSED, _refs(False), body="""select statement_id, full_table, valid_table_name,
        valid_schema_name, valid_catalog_name from split"""),
    "refs_resolve": _with(OUTPUTS, PARSED, TABLES, UNIQUE, _refs(False), _resolve(False), body="select * from resolved"),
    "refs_resolve_strict": _with(OUTPUTS, PARSED, TABLES, UNIQUE, _refs(True), _resolve(True), body="select * from resolved"),
    "cat_unique": _with(TABLES, UNIQUE, body="select * from unique_table"),
    "cat_levels": _with(TABLES, UNIQUE, body="select unique_level, count(*) as table_cnt from unique_table group by 1"),
    "cat_tables": _with(TABLES, COLUMNS, TABLE_ROWS, body="select * from table_rows"),
    "cat_columns": _with(COLUMNS, COLUMN_ROWS, body="select * from column_rows"),
    "ddl_format": _with(TABLES, COLUMNS, TABLE_ROWS, DEFINITIONS, body="select * from definitions"),
    "ddl_fn": _with(TABLES, COLUMNS, TABLE_ROWS, DEFINITIONS, body="""select list_sort(list(table_definition)) as table_definitions
        from definitions where full_table in ('sales.main.orders_1', 'lake.raw.events_0', 'sales.main.nowhere')"""),
    "ddl_lookup": _with(STATEMENTS, TABLES, COLUMNS, TABLE_ROWS, DEFINITIONS, body="""
        select s.statement_id, coalesce(list(d.table_definition order by d.full_table) filter (where d.full_table is not null), []) as table_definitions
        from statements s left join (select statement_id, unnest(table_list) as full_table from statements) n
            on s.statement_id = n.statement_id left join definitions d on n.full_table = d.full_table
        group by s.statement_id"""),
    "col_lookup": _with(COLUMNS, COLUMN_ROWS, f"""wanted as (
        select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_shipdate as request_id,
            {fx.path_of('l_orderkey')} || '.c' || l_linenumber || '_' || lower(l_returnflag) as id from lineitem)""",
        body="""select w.request_id, w.id, c.column_name, c.data_type, c.is_nullable, c.comment
        from wanted w left join column_rows c on w.id = c.id"""),
    "table_lookup": _with(TABLES, COLUMNS, TABLE_ROWS, f"""wanted as (
        select event_id, {fx.path_of('user_id * 7 + event_id % 5')} as full_table from events)""",
        body="""select w.event_id, w.full_table, t.table_type, t.comment, t.column_list
        from wanted w left join table_rows t on w.full_table = t.full_table"""),
    "dq_keys": """select 'lineitem' as source, l_orderkey || '/' || l_linenumber as key, count(*) as n_rows
        from lineitem group by l_orderkey, l_linenumber having count(*) > 1""",
    "cosine_pairs": f"""select a.vec_id, {_cosine('a.embedding', 'b.embedding')} as score
        from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    "sim_pairs": _with(STATEMENTS, FIT, PAIRS, body="select * from pairs where question_similarity_score >= 0.3"),
    "sim_top3": _with(STATEMENTS, FIT, PAIRS, body="select * from top3"),
    "sim_top3_first": _with(STATEMENTS, FIT, PAIRS, FIRST3, body="select * from first3"),
    "sim_top3_classes": _with(STATEMENTS, FIT, PAIRS, """placed as (
        select statement_id, min(statement_id) over (partition by question_embeddings, list_sort(table_list)) as class_id
        from fit)""", body="""
        select q.class_id, p.class_id as compared_class_id, count(*) as n_compared,
            any_value(question_similarity_score) as question_similarity_score,
            any_value(question_similarity_rank) as question_similarity_rank
        from top3 t join placed q on t.statement_id = q.statement_id and q.statement_id = q.class_id
            join placed p on t.compared_statement_id = p.statement_id group by all"""),
    "prompt_build": _with(STATEMENTS, body=f"""select statement_id, {_prompt('generated_question', 'table_list',
        f"[{_sample('generated_question', 'statement_text')}, {_sample('generated_question', 'statement_text')}]")} as prompt
        from (select * replace ({_listed(fx.STATEMENT_TABLES, _NONE).replace('vec_id', 'cast(substr(statement_id, 2) as bigint)').replace('label', "cast(regexp_extract(generated_question, '[0-9]+$') as bigint)")} as table_list) from statements)"""),
    "train_set": _with(*_TRAIN, body="select * from training"),
    "train_jsonl": _with(*_TRAIN, body="select full_prompt as prompt, response from training"),
    "retrieve_topk": _with(STATEMENTS, QUESTIONS, ASKED, _hits("true"), body="""select question_id, statement_id, score, place,
        generated_question, manual_summarization from hits"""),
    "retrieve_filter": _with(STATEMENTS, QUESTIONS, ASKED, FILTERED, body="""select question_id, statement_id, score, place,
        generated_question, manual_summarization from hits"""),
    "mine_tables": _with(STATEMENTS, QUESTIONS, ASKED, FILTERED, MINED, body="select question_id, tables, sample_sql from mined"),
    "answer_prompts": _with(*_ANSWER, body="select * from prompts"),
    "answer_batch": _with(*_ANSWER, body=f"""select question_id, {_answer('p')} as sql,
        cast(null as varchar) as answer_error
        from (select question_id, system_prompt || chr(10) || chr(10) || full_prompt as p from prompts)"""),
    "response_text": "select conv_id, turn, case when role = 'user' then text end as response_text from conversations",
    "gen_questions": _with(HISTORY, body=f"""select statement_id,
        {_asked(_SUMMARY, SUMMARY_WORDS, 'statement_text')} as manual_summarization,
        trim({_asked(_QUESTION, QUESTION_WORDS, 'statement_text')}, '"') as generated_question,
        cast(null as varchar) as generation_error from history"""),
    "embed_text": _with(_hashed("v", "conversations", "conv_id, turn", "text"),
        body=f"select conv_id, turn, {_rounded('vector')} as vector from v"),
    "summary_join": _with(*_INGEST, body="select * from summaries"),
    "pre_index": _with(*_INGEST, _hashed("qv", "summaries", "statement_id", "generated_question"),
        _hashed("sv", "summaries", "statement_id", "statement_text"), body=f"""
        select p.statement_id, p.executed_by, p.generated_question, r.catalog_list, r.schema_list, r.table_list,
            {_rounded('qv.vector')} as question_embeddings, {_rounded('sv.vector')} as statement_embeddings
        from summaries p join qv on p.statement_id = qv.statement_id join sv on p.statement_id = sv.statement_id
            left join resolved r on p.statement_id = r.statement_id"""),
    "search_tables": _search("table_rows", "full_table", "table_search", TABLES, COLUMNS, TABLE_ROWS),
    "search_columns": _search("column_rows", "id", "column_search", COLUMNS, COLUMN_ROWS),
    "search_questions": _search("statements", "statement_id", "generated_question", STATEMENTS),
    "search_coded": _with(STATEMENTS, QUESTIONS, ASKED, _hits("true"), body="select question_id, statement_id, score, place from hits"),
    "index_refresh": f"""select doc_id, cast(case when revised then 1 else 0 end as integer) as version,
        md5(text || case when revised then ' (revised)' else '' end) as text_md5, {fx.DIM} as width
        from (select doc_id, text, doc_id in (select doc_id from labels) as revised from documents)""",
}
