"""Column functions on statement text, model output and prompt text (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from questline.config import PARSING_ERROR

# What a literal is replaced with, and the literal patterns.
SINGLE_QUOTED = r"'([^']+)'"
DOUBLE_QUOTED = r'"([^"]+)"'
SINGLE_QUOTED_SAFE = r"'([^']|'')*'"
DOUBLE_QUOTED_SAFE = r'"([^"]|"")*"'
MASKED_SINGLE = "'{value}'"
MASKED_DOUBLE = '"{value}"'


def mask_literals(text: Column, safe: bool = False) -> Column:
    """Replace quoted literals by ``{value}`` so that runs of one statement shape become equal.

    The default pattern needs at least one character between the quotes, so an empty
    literal shifts the pairing of the quotes after it. ``safe=True`` also takes empty
    literals and doubled quotes. Numbers are never masked.
    """
    single, double = (
        (SINGLE_QUOTED_SAFE, DOUBLE_QUOTED_SAFE) if safe else (SINGLE_QUOTED, DOUBLE_QUOTED)
    )
    masked = F.regexp_replace(text, single, MASKED_SINGLE)
    return F.regexp_replace(masked, double, MASKED_DOUBLE)


def words(text: Column) -> Column:
    """Distinct lower-cased words of ``text``."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def word_overlap(left: Column, right: Column) -> Column:
    """Share of distinct words two texts have in common (1.0 when neither has any)."""

    def share(pair: Column) -> Column:
        shared = F.size(F.array_intersect(pair["a"], pair["b"]))
        union = F.size(pair["a"]) + F.size(pair["b"]) - shared
        return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)

    # Bound in a lambda, so the words are taken once however often they are used.
    both = F.array(F.struct(words(left).alias("a"), words(right).alias("b")))
    return F.transform(both, share)[0]


def parse_table_list(output: Column) -> Column:
    """Table names in a model's JSON answer: the slice from the first ``[`` to the first ``]``.

    Escaped underscores and backticks are undone and names lower-cased. Text without a
    readable list gives ``[PARSING ERROR, <slice>]``.
    """
    first, last = F.instr(output, "["), F.instr(output, "]")
    listed = F.when(
        (first > 0) & (last > first), F.substring(output, first, last - first + 1)
    ).otherwise(F.lit(""))
    cleaned = F.lower(F.replace(F.replace(listed, F.lit("\\_"), F.lit("_")), F.lit("`"), F.lit("")))
    parsed = F.from_json(
        cleaned, "array<string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    )
    return F.coalesce(parsed, F.array(F.lit(PARSING_ERROR), F.coalesce(cleaned, F.lit(""))))


def quote_text(text: Column) -> Column:
    """``text`` as it must stand between single quotes."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def table_definition(
    full_table: Column, comment: Column, column_text: Column, escape: bool = True
) -> Column:
    """CREATE TABLE text; a null or empty comment leaves the COMMENT clause out."""
    said = quote_text(comment) if escape else comment
    clause = F.when(
        F.coalesce(comment, F.lit("")) != "", F.concat(F.lit("\nCOMMENT '"), said, F.lit("'"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("CREATE TABLE "), full_table, F.lit(" (\n"), column_text, F.lit(")"), clause, F.lit(";")
    )


INSTRUCTIONS = (
    "You write SQL. Below are table definitions and earlier requests with the SQL that "
    "answered them, followed by a new request in a comment. Reply to it with a single "
    "SELECT statement that ends with a semicolon."
)
SYSTEM_INSTRUCTION = (
    "Answer with SQL only and add no explanation. Do not introduce a CTE merely to rename a table."
)


def build_prompt(
    question: Column, definitions: Column, samples: Column, instructions: str = INSTRUCTIONS
) -> Column:
    """Prompt text in five marked sections; used for training rows and for answering alike.

    The section marks are fixed values. ``samples`` is an array of structs with ``question`` and ``sql``.
    """
    sample_text = F.transform(
        samples,
        lambda s: F.concat(
            F.lit("/*\n"), F.coalesce(s["question"], F.lit("")), F.lit("\n*/\n"),
            F.coalesce(s["sql"], F.lit("")),
        ),
    )
    return F.concat(
        F.lit(f"--Instructions\n/*\n{instructions}\n*/\n\n--Tables\n"),
        F.coalesce(F.array_join(definitions, "\n\n"), F.lit("")),
        F.lit("\n\n--Sample Prompt and SQL Response\n"),
        F.coalesce(F.array_join(sample_text, "\n\n"), F.lit("")),
        F.lit("\n\n--User Prompt\n/*\n"),
        question,
        F.lit("\n*/\n\n--Your SQL Response\n"),
    )


def completion_text(response: Column) -> Column:
    """Text of the first candidate in a completion endpoint's JSON response."""
    parsed = F.from_json(response, "candidates array<struct<text: string>>")
    return F.try_element_at(parsed["candidates"], F.lit(1))["text"]
