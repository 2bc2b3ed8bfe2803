"""Host-level quality rules: failures by domain, shrunk with an empirical beta prior.

Every document is tested against the rules. Failures are summed by host, and a host's failure
rates are shrunk towards all hosts' rate: rate = (failed + a) / (documents + a + b), with a and
b fitted to the spread of the hosts' rates by moments. So a host of two documents isn't judged
by one bad page. The host's verdict is joined back to its documents.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questline.llm.common import look_up, per_text, words_of
from questline.session import cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"

# Rules besides the base ones: a document fails one if the ratio is above the limit.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINES = 0.5      # of lines with a word
MAX_WORD_CHARS = 25.0    # mean
MAX_HOST_RATE = 0.5      # a host fails where its shrunk rate of bad documents is above it

_WHITE = "\t\n\x0b\x0c\r "


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows, lines."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = words_of(text)
    chars = len(text) - sum(text.count(c) for c in _WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = dups = 0
    seen = set()
    for line in text.split("\n"):
        if line.strip(_WHITE):
            lines += 1
            dups += line in seen
            seen.add(line)
    repeated = 0
    if len(words) > WINDOW:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        count = Counter(windows)
        if len(count) < len(windows):
            covered_to = 0
            for i, window in enumerate(windows):
                if count[window] > 1:
                    repeated += i + WINDOW - max(i, covered_to)
                    covered_to = i + WINDOW
    return len(words), chars, symbols, dups, repeated, lines


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def count_text(text: Column) -> Column:
    return per_text(", ".join(f"{c} long" for c in _COUNTS), lambda: text_counts)(text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )


def rule_failures() -> dict[str, Column]:
    """Each rule's failure as a boolean over the counts; no rule fails a text without words."""
    return {
        "base": base_failed(),
        "symbols": F.col("n_symbols") > F.col("n_words") * MAX_SYMBOLS_PER_WORD,
        "dup_lines": F.col("n_dup_lines") > F.col("n_lines") * MAX_DUP_LINES,
        "long_words": F.col("word_chars") > F.col("n_words") * MAX_WORD_CHARS,
    }


def host_verdicts(rows: DataFrame, host: str, failed: dict[str, str], max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host``, its documents, the shrunk rate of every rule, and whether the host fails.

    ``failed``: rule name to boolean column of ``rows``. Hosts are combined before the shuffle,
    so one that holds most rows is no hot key. The prior of a rule comes from the mean and
    the variance of the hosts' rates, beyond what chance explains; where these don't spread,
    the prior is as strong as the average host is large.
    """
    counts = rows.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(c).cast("long")).alias(f"failed_{r}") for r, c in failed.items()]
    )
    moments = counts.agg(
        F.sum("n_docs").alias("_n"), F.count(F.lit(1)).alias("_hosts"), F.avg(1 / F.col("n_docs")).alias("_inverse"),
        *[F.sum(f"failed_{r}").alias(f"_sum_{r}") for r in failed],
        *[F.coalesce(F.var_samp(F.col(f"failed_{r}") / F.col("n_docs")), F.lit(0.0)).alias(f"_var_{r}") for r in failed],
    )
    rates = counts.crossJoin(F.broadcast(moments))  # one row
    for r in failed:
        mean = F.col(f"_sum_{r}") / F.col("_n")
        chance = mean * (1 - mean) * F.col("_inverse")
        spread = F.col(f"_var_{r}") - chance
        strength = F.when(spread > 0, F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0))).otherwise(
            F.col("_n") / F.col("_hosts")
        )
        rates = rates.withColumn(
            f"rate_{r}", (F.col(f"failed_{r}") + strength * mean) / (F.col("n_docs") + strength)
        )
    worst = F.greatest(*[F.col(f"rate_{r}") for r in failed]) if len(failed) > 1 else F.col(f"rate_{next(iter(failed))}")
    return rates.select(host, "n_docs", *[f"rate_{r}" for r in failed], (worst > max_rate).alias("host_failed"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE,
          key: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """``docs`` with counts, rule failures, the host's shrunk rate and the verdict ``kept``.

    A document is kept if it passes all rules and its host doesn't fail. Null hosts are one
    host; null and empty texts have no words and fail the base rule. Clashing column names
    are replaced. An empty table gives an empty one.
    """
    out = docs.withColumn("_host", F.coalesce(F.col(host), F.lit("")))
    out = out.withColumn("_c", count_text(F.col(text))).select(
        *[c for c in out.columns if c not in _COUNTS], *[F.col(f"_c.{c}") for c in _COUNTS]
    ).drop("_c")
    failures = rule_failures()
    out = out.withColumns({f"failed_{r}": c for r, c in failures.items()})
    out = out.withColumn("failed_any", F.greatest(*[f"failed_{r}" for r in failures]))
    out = cut_lineage(out if keep_text else out.drop(text))  # texts are counted once, then read twice
    verdicts = host_verdicts(out, "_host", {"any": "failed_any"}, max_rate)
    joined = look_up(out.drop("host_failed", "rate_any", "n_docs"), verdicts, "_host", key)
    return joined.withColumn("base_failed", F.col("failed_base")).withColumn(
        "kept", ~F.col("failed_any") & ~F.col("host_failed")
    ).drop("_host")

