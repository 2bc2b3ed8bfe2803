"""Table names in SQL text: a token stream folded by ``aggregate``, all JVM-side.

The statement is lower-cased, string literals and comments are taken out, and what is left becomes
tokens: names (with all their dotted parts, and the parenthesis that makes one a call), parentheses, commas and
semicolons. The fold carries a small state from token to token: what a name would mean here (``mode``), one
entry for each open parenthesis, the CTE names in sight, and the tables found.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r"`[^`]*`|\"[^\"]*\""
# Quoted names are kept; literals and comments go.
NO_NAMES = rf"({_QUOTED})|'[^']*'|--[^\n]*|(?s:/\*.*?\*/)"
_PART = rf"(?:{_QUOTED}|[\p{{L}}\p{{N}}_$#@-]+)"
TOKENS = rf"{_PART}(?:\s*\.{{1,2}}\s*{_PART}){{0,7}}(?:\s*\()?|[(),;]"

# Modes: what a name means.
OTHER, TABLE, LISTED, CALL, CTE, IN_CTE, RECURSIVE_CTE, IN_RECURSIVE_CTE = range(8)
# Kinds of tokens.
NAME, SELECT, FROM, JOIN, WITH, ENDS, RECURSIVE, BEFORE_TABLE, COMMA, OPENS, CLOSES, SEMICOLON, DISTINCT = range(13)
_KINDS = {
    SELECT: ["select"], FROM: ["from"], JOIN: ["join"], WITH: ["with"], RECURSIVE: ["recursive"],
    BEFORE_TABLE: ["lateral", "only"], COMMA: [","], OPENS: ["("], CLOSES: [")"], SEMICOLON: [";"], DISTINCT: ["distinct"],
    ENDS: ["where", "group", "order", "having", "limit", "qualify", "window", "union", "intersect", "except", "minus",
           "cluster", "distribute", "sort", "set", "values", "when"],
}


def _token(text: Column) -> Column:
    call = (F.length(text) > 1) & text.endswith("(")
    word = F.when(call, F.rtrim(F.substring(text, F.lit(1), F.length(text) - 1))).otherwise(text)

    kinds = F.create_map(*[F.lit(x) for number, words in _KINDS.items() for w in words for x in (w, number)])

    def known(pair: Column) -> Column:
        kind = F.coalesce(F.try_element_at(kinds, pair["word"]), F.lit(NAME))
        return F.struct(pair["word"].alias("word"), pair["call"].alias("call"), kind.alias("kind"))

    return F.transform(F.array(F.struct(word.alias("word"), call.alias("call"))), known)[0]


def _chosen(value: Column, cases: dict[int, Column], other: Column) -> Column:
    out = other
    for case, result in cases.items():
        out = F.when(value == case, result).otherwise(out)
    return out


def _step(state: Column, token: Column) -> Column:
    """State after one token: first what its word means, then what its parenthesis opens."""
    mode, kind, word, call = state["mode"], token["kind"], token["word"], token["call"]
    ctes, stack = state["ctes"], state["stack"]
    named = kind.isin(NAME, DISTINCT) | ((kind == RECURSIVE) & (mode != CTE))
    clause = mode != CALL
    after_name = _chosen(mode, {TABLE: F.lit(LISTED), CTE: F.lit(IN_CTE), RECURSIVE_CTE: F.lit(IN_RECURSIVE_CTE)}, mode)
    after_comma = _chosen(mode, {LISTED: F.lit(TABLE), IN_CTE: F.lit(CTE), IN_RECURSIVE_CTE: F.lit(RECURSIVE_CTE)}, mode)
    then = F.when(named, after_name).otherwise(_chosen(kind, {
        SELECT: F.lit(OTHER), SEMICOLON: F.lit(OTHER), COMMA: after_comma,
        FROM: F.when(clause & ~state["distinct"], F.lit(TABLE)).otherwise(mode),
        JOIN: F.when(clause, F.lit(TABLE)).otherwise(mode),
        WITH: F.when(mode == LISTED, mode).otherwise(F.lit(CTE)),
        RECURSIVE: F.lit(RECURSIVE_CTE),
        BEFORE_TABLE: F.when(mode == LISTED, F.lit(OTHER)).otherwise(mode),  # LATERAL VIEW ends the list
        ENDS: F.when(mode.isin(TABLE, LISTED), F.lit(OTHER)).otherwise(mode),
    }, mode))
    table = named & (mode == TABLE) & ~call & ~F.array_contains(ctes, word)
    # A CTE is in sight after its body, a recursive one at once.
    done = (mode == IN_CTE) & kind.isin(SELECT, FROM, COMMA)
    seen = F.when(done, F.array_append(ctes, state["cte"])).when(
        named & (mode == RECURSIVE_CTE), F.array_append(ctes, word)).otherwise(ctes)

    def opened(now: Column) -> Column:
        opens = call | (kind == OPENS)
        closes = kind == CLOSES
        outer = F.try_element_at(stack, F.lit(-1))
        return F.struct(
            F.when(opens, F.when(now["mode"] == TABLE, TABLE).otherwise(CALL))
            .when(closes, F.coalesce(outer["mode"], F.lit(OTHER))).otherwise(now["mode"]).alias("mode"),
            F.when(opens, F.array_append(stack, F.struct(
                F.when(now["mode"] == TABLE, LISTED).otherwise(now["mode"]).alias("mode"), F.size(now["ctes"]).alias("ctes"))))
            .when(closes & (F.size(stack) > 0), F.slice(stack, F.lit(1), F.size(stack) - 1))
            .when(kind == SEMICOLON, F.slice(stack, 1, 0)).otherwise(stack).alias("stack"),
            F.when(closes & (F.size(stack) > 0), F.slice(now["ctes"], F.lit(1), outer["ctes"]))
            .otherwise(now["ctes"]).alias("ctes"),
            F.when(named & (mode == CTE), word).otherwise(state["cte"]).alias("cte"),
            F.when(table, F.array_append(state["tables"], word)).otherwise(state["tables"]).alias("tables"),
            (kind == DISTINCT).alias("distinct"),
        )

    # Most tokens say nothing: names where no table can stand, and commas between them.
    idle = ~call & ~state["distinct"] & (
        ((kind == NAME) & ~mode.isin(TABLE, CTE, RECURSIVE_CTE)) | ((kind == COMMA) & mode.isin(OTHER, CALL)))
    return F.when(idle, state).otherwise(F.transform(F.array(F.struct(then.alias("mode"), seen.alias("ctes"))), opened)[0])


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\s*\.\s*", "."), "[`\"]", "")


def extract_tables(statement: Column) -> Column:
    """Names of the tables that a statement reads: sorted, distinct, lower-cased, without quotes.

    Counted are the names after FROM and JOIN and after the commas of a FROM list, in subqueries and parenthesised joins
    too. Not counted: table functions, the FROM in a call such as ``extract(x from y)`` or in ``is distinct from``, and
    CTE names where they are in sight: after their body (from their name on if recursive), up to the end of
    the parentheses they stand in. Names may be quoted by backticks or double quotes and may hold
    hyphens. A null statement gives null; text that isn't SQL gives whatever follows such words.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(
        F.lit(OTHER).alias("mode"), F.array().cast("array<struct<mode: int, ctes: int>>").alias("stack"),
        empty.alias("ctes"), F.lit("").alias("cte"), empty.alias("tables"), F.lit(False).alias("distinct"),
    )
    words = F.regexp_extract_all(F.regexp_replace(F.lower(statement), NO_NAMES, "$1 "), F.lit(TOKENS), F.lit(0))
    tokens = F.transform(words, _token)
    found = F.aggregate(tokens, start, _step, lambda s: F.array_distinct(F.transform(s["tables"], _plain)))
    return F.array_sort(F.filter(found, lambda x: x != ""))
