"""Text generation and embedding over rows, and the tables built from them.

A *provider* is a function that returns a client; it runs once per task, so connections
live as long as the task. A text client is ``client(model, prompts) -> texts``, where rows have a
system text ``client(model, prompts, system=text)``; an embedding client ``client(texts) -> matrix``. Only the prompt and model columns go to
Python, in Arrow batches; the rest of the row stays in the JVM.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questline.config import QUESTION_WORDS, RERUN_THRESHOLD, SUMMARY_WORDS
from questline.functions.vectors import cosine
from questline.operators.answered import asked_once

ROWS_PER_CALL = 512  # most rows handed to a client at once
WORD = r"[^ \t\n\f\r]+"

TextClient = Callable[..., list[str]]
EmbeddingClient = Callable[[list[str]], np.ndarray]


def _tried(call: Callable[[list], list], items: list, attempts: int) -> tuple[list, list]:
    """Results and errors of a batch call, retried, then item by item so one row fails alone."""
    for _ in range(attempts):
        try:
            got = list(call(items))
            if len(got) != len(items):
                raise ValueError(f"{len(got)} replies to {len(items)} rows")
            return got, [None] * len(items)
        except Exception as error:  # noqa: BLE001 - any client error is a row error
            failure = f"{type(error).__name__}: {error}"
    if len(items) == 1:
        return [None], [failure]
    results, errors = [], []
    for item in items:
        result, error = _tried(call, [item], attempts)
        results += result
        errors += error
    return results, errors


def _when_needed(provider: Callable[[], Callable]) -> Callable:
    """The provider's client, made at its first call: a task without requests needs no connection."""
    made: list[Callable] = []

    def call(*args, **more):
        if not made:
            made.append(provider())
        return made[0](*args, **more)

    return call


def generate(
    prompt: Column, model: Column, provider: Callable[[], TextClient], attempts: int = 2,
    rows_per_call: int = ROWS_PER_CALL, system: Column | None = None,
) -> Column:
    """Struct ``text, error`` from a text provider; null prompts give null text.

    ``system`` is the system text of a row, an argument of its own to the client; null and None: it gets none.
    The function is marked non-deterministic, so Spark never evaluates it twice for a row
    by copying the expression. Write the result to a table right after it: a lost
    executor then repeats only its own calls.
    """

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        client = _when_needed(provider)
        for prompts, models, systems in batches:
            out = pd.DataFrame({"text": None, "error": None}, index=prompts.index, dtype=object)
            lost = prompts.notna() & models.isna()
            out.loc[lost, "error"] = "no model given"
            asked = pd.DataFrame({"prompt": prompts, "model": models, "system": systems})[prompts.notna() & models.notna()]
            for (name, text), rows in asked.groupby(["model", "system"], dropna=False, sort=False)["prompt"]:
                more = {} if pd.isna(text) else {"system": text}
                for start in range(0, len(rows), rows_per_call):
                    part = rows.iloc[start:start + rows_per_call]
                    texts, errors = _tried(lambda p, m=name, s=more: client(m, p, **s), list(part), attempts)
                    out.loc[part.index, "text"] = texts
                    out.loc[part.index, "error"] = errors
            yield out

    return run.asNondeterministic()(prompt, model, F.lit(None).cast("string") if system is None else system)


def embed(
    text: Column, provider: Callable[[], EmbeddingClient], attempts: int = 2,
    rows_per_call: int = ROWS_PER_CALL,
) -> Column:
    """Struct ``vector, error`` from an embedding provider; null text gives a null vector."""

    @F.arrow_udf("vector array<float>, error string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = _when_needed(provider)
        for batch in batches:
            texts = batch.to_pylist()
            vectors, errors = [None] * len(texts), [None] * len(texts)
            asked = [i for i, text in enumerate(texts) if text is not None]
            for start in range(0, len(asked), rows_per_call):
                part = asked[start:start + rows_per_call]
                got, failed = _tried(lambda t: list(client(t)), [texts[i] for i in part], attempts)
                for i, vector, error in zip(part, got, failed):
                    vectors[i] = None if vector is None else np.asarray(vector, dtype=np.float32)
                    errors[i] = error
            # One flat array for all vectors instead of an object a row.
            flat = np.concatenate([np.empty(0, dtype=np.float32), *[v for v in vectors if v is not None]])
            ends = np.cumsum([0] + [0 if v is None else len(v) for v in vectors]).astype(np.int32)
            lost = pa.array([v is None for v in vectors], type=pa.bool_())
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=lost)
            yield pa.StructArray.from_arrays([listed, pa.array(errors, type=pa.string())], names=["vector", "error"])

    return run.asNondeterministic()(text)


def whole_text_provider() -> TextClient:
    """Offline stand-in for a text model: number of words and MD5 of the whole prompt, in double quotes.

    A system text counts as if it stood before the prompt, a blank line between.
    """

    def client(model: str, prompts: list[str], system: str | None = None) -> list[str]:
        whole = prompts if system is None else [f"{system}\n\n{p}" for p in prompts]
        return [f'"{len(re.findall(WORD, p))} words, digest {hashlib.md5(p.encode()).hexdigest()}"' for p in whole]

    return client


def hashed_words_provider(dim: int) -> Callable[[], EmbeddingClient]:
    """Offline stand-in for an embedding model: signed hashed word counts, unit length.

    Words are runs of ``a-z0-9`` in the lower-cased text. The first eight hex digits of a
    word's MD5 pick the place (modulo ``dim``), an even ninth digit adds one and an odd one
    takes one away.
    """

    def provider() -> EmbeddingClient:
        known: dict[str, int] = {}

        def place(word: str) -> int:
            """Place of the word, moved up by ``dim`` when it takes one away."""
            if word not in known:
                if len(known) > 1_000_000:
                    known.clear()
                digest = hashlib.md5(word.encode()).hexdigest()
                known[word] = int(digest[:8], 16) % dim + dim * (int(digest[8], 16) % 2)
            return known[word]

        def client(texts: list[str]) -> np.ndarray:
            words = [re.findall(r"[a-z0-9]+", text.lower()) for text in texts]
            places = np.fromiter((place(w) for listed in words for w in listed), dtype=np.int64)
            rows = np.repeat(np.arange(len(texts)), [len(listed) for listed in words])
            hits = np.bincount(rows * 2 * dim + places, minlength=len(texts) * 2 * dim)
            added, taken = hits.reshape(len(texts), 2, dim).astype(float).transpose(1, 0, 2)
            counts = added - taken
            length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return counts / np.where(length == 0, 1.0, length)

        return client

    return provider


def drop_reruns_by_meaning(
    runs: DataFrame, provider: Callable[[], EmbeddingClient], threshold: float = RERUN_THRESHOLD, model: str = "",
    folder: str | None = None,
) -> DataFrame:
    """Runs whose user's next statement means something else: embeddings with a cosine below ``threshold``.

    The counterpart of :func:`questline.operators.history.drop_reruns` with a model's embeddings instead of words. A run without
    a next one always stays, its score is null; so does a run whose texts have no vector or one without length, as nothing says that it is a
    rerun. Equal texts are embedded once, and a statement is usually the next one of another. ``runs`` is read several times
    and should be a written table. Scores are rounded to six digits.
    """
    texts = [F.col("statement_text"), F.col("next_statement_text")]
    scored = asked_once(runs, [[F.lit(model), t] for t in texts], lambda _, text: embed(text, provider), ["_this", "_next"], folder)
    score = F.round(cosine(F.col("_this.vector"), F.col("_next.vector")), 6)
    scored = scored.select(*runs.columns, score.alias("next_similarity_score"))
    return scored.filter(F.col("next_similarity_score").isNull() | (F.col("next_similarity_score") < threshold))


def summary_prompt(statement: Column) -> Column:
    return F.concat(
        F.lit(f"Say in plain English, in at most {SUMMARY_WORDS} words, what this SQL does:\n"), statement
    )


def question_prompt(statement: Column) -> Column:
    return F.concat(
        F.lit(f"Write the user request, in at most {QUESTION_WORDS} words, that this SQL answers:\n"),
        statement,
    )


def tables_prompt(statement: Column) -> Column:
    return F.concat(
        F.lit(
            "List the tables this SQL reads, with catalog and schema where given, leaving out "
            'aliases and CTEs. Reply only with JSON such as {"tables": ["a", "b.c.d"]}:\n'
        ),
        statement,
    )


def with_generated_text(
    statements: DataFrame, provider: Callable[[], TextClient], model: str = "extraction_model", folder: str | None = None,
) -> DataFrame:
    """Adds ``manual_summarization``, ``generated_question`` (outer double quotes trimmed)
    and ``generation_error``, each row with the model its ``model`` column names.

    Equal requests are asked once; ``folder`` keeps replies for later runs (:func:`asked_once`).
    """
    text, name = F.col("statement_text"), F.col(model)
    asked = asked_once(
        statements, [[name, summary_prompt(text)], [name, question_prompt(text)]],
        lambda m, p: generate(p, m, provider), ["_s", "_q"], folder,
    )
    return asked.select(
        *statements.columns,
        F.col("_s.text").alias("manual_summarization"),
        F.trim(F.col("_q.text"), F.lit('"')).alias("generated_question"),
        F.coalesce("_s.error", "_q.error").alias("generation_error"),
    )


def matched_statements(runs: DataFrame, references: DataFrame) -> DataFrame:
    """Runs with at least one table the catalog knows, and the model chosen for them."""
    matched = references.filter("matched_ind").select("statement_id", "extraction_model")
    return runs.join(matched, "statement_id").select(
        "statement_id", "executed_by", "next_similarity_score", "statement_text", "extraction_model"
    )


def with_embeddings(
    summaries: DataFrame, provider: Callable[[], EmbeddingClient], model: str = "", folder: str | None = None,
) -> DataFrame:
    """``statement_id`` with the embeddings of its question and its text.

    Equal texts are embedded once; ``folder`` keeps vectors for later runs, under the name of the ``model``.
    """
    rows = summaries.select("statement_id", "generated_question", "statement_text")
    embedded = asked_once(
        rows, [[F.lit(model), F.col("generated_question")], [F.lit(model), F.col("statement_text")]],
        lambda m, t: embed(t, provider), ["_q", "_s"], folder,
    )
    return embedded.select(
        "statement_id", "generated_question", "statement_text",
        F.col("_q.vector").alias("question_embeddings"),
        F.col("_s.vector").alias("statement_embeddings"),
        F.coalesce("_q.error", "_s.error").alias("embedding_error"),
    )


def unified_statements(summaries: DataFrame, embeddings: DataFrame, references: DataFrame) -> DataFrame:
    """One row per summarised statement with its embeddings and table lists."""
    vectors = embeddings.select("statement_id", "question_embeddings", "statement_embeddings")
    lists = references.select("statement_id", "catalog_list", "schema_list", "table_list")
    return summaries.join(vectors, "statement_id").join(lists, "statement_id", "left")
