"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's target weight and its present size give the mean number of times each of its
documents should appear. A document's own number is drawn from the Poisson distribution with
that mean by inverting it at a hash of the document and a seed, so the draw needs no state, no
order and no second pass, and a retried task draws the same. The distribution function is tabled at
some numbers only, as many as lie between two of them, and summed on from there for each document. Documents are then
exploded by their number, in chunks, and shuffled globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questline.llm.common import look_up

SEED = "mix-1"
RANGE = 12.0       # standard deviations around the mean that the distribution is tabled for
HEX_DIGITS = 13    # of MD5 for a uniform number: 52 bits
CHUNK = 1000       # copies of a document that are made in one go

# Production weights: the share of the mix in UTF-8 bytes. Other sources share the rest by size;
# what nobody is there for goes to the sources that occur, in proportion to their shares.
WEIGHTS = {"src0": 0.20, "src1": 0.06, "src2": 0.06, "src3": 0.06}


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts (null: an empty part)."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / float(16 ** HEX_DIGITS)


def log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series, whose error is below 1e-12 from 20 on; before, term by term."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(k, F.lit(20)), F.lit(1))), F.lit(0.0),
                        lambda acc, i: acc + F.log(i.cast("double")))
    x = k.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(k <= 20, small).otherwise(series)


def chance(k: Column, mean: Column) -> Column:
    """The Poisson probability of ``k``."""
    return F.exp(k * F.log(mean) - mean - log_factorial(k))


def poisson_table(mean: Column) -> Column:
    """``first`` number, ``stride``, and ``upto``: the distribution function at the end of each stride from ``first`` on.

    Below ``first`` lies less than any uniform number of 52 bits. There are as many strides as numbers in one, so
    the table has some 5 mean^(1/4) entries and takes time proportional to the root of the mean.
    """
    spread = F.ceil(RANGE * F.sqrt(mean) + 30).cast("long")
    low = F.greatest(F.floor(mean).cast("long") - spread, F.lit(0).cast("long"))
    stride = F.ceil(F.sqrt(F.floor(mean).cast("long") + spread - low + 1)).cast("long")

    def add(done: Column, number: Column) -> Column:
        start = low + number * stride
        mass = F.aggregate(F.sequence(start, start + stride - 1), F.lit(0.0), lambda sum_, k: sum_ + chance(k, mean))
        return F.concat(done, F.array(mass + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0))))

    upto = F.aggregate(F.sequence(F.lit(0).cast("long"), stride - 1), F.array().cast("array<double>"), add)
    return F.struct(low.alias("first"), stride.alias("stride"), upto.alias("upto"))


def poisson_inverse(table: Column, mean: Column, u: Column) -> Column:
    """The least number whose distribution function reaches ``u``; null where the table is null."""
    upto, stride = table["upto"], table["stride"]
    u = F.least(u, F.element_at(upto, -1))  # sums may end a rounding error below 1
    before = F.size(F.filter(upto, lambda reached: reached < u))
    start = table["first"] + before * stride
    done = F.struct(
        F.when(before > 0, F.try_element_at(upto, before)).otherwise(0.0).alias("reached"), F.lit(0).cast("long").alias("n"))

    def step(at: Column, k: Column) -> Column:
        reached = at["reached"] + chance(k, mean)
        return F.struct(reached.alias("reached"), (at["n"] + (reached < u).cast("long")).alias("n"))

    # The stride's last number is certain once the others are ruled out.
    walked = F.aggregate(F.sequence(start, start + F.greatest(stride - 2, F.lit(0))), done, step)["n"]
    return F.when(table.isNotNull(), start + F.least(walked, stride - 1))


def rates(docs: DataFrame, weights: dict[str, float], source: str, size: Column, total: float | None) -> DataFrame:
    """``_source, rate``: mean repetitions of each source's documents.

    Named sources get their weight of the total (default: the present size), the others share
    what is left in proportion to their sizes. Shares of named sources without rows, or the rest
    where all sources are named, are dealt to those that occur, in proportion to their shares; if
    their weights are all zero they get nothing. Sources are combined before the shuffle.
    """
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights are shares of the whole")
    named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast(
        "map<string,double>")
    sums = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("_source")).agg(F.sum(size).alias("_size"))
    sums = sums.withColumn("_weight", F.try_element_at(named, F.col("_source")))
    whole = sums.agg(
        F.sum("_size").cast("double").alias("_all"),
        F.coalesce(F.sum(F.when(F.col("_weight").isNull(), F.col("_size"))), F.lit(0)).cast("double").alias("_rest"),
        F.coalesce(F.sum("_weight"), F.lit(0.0)).alias("_named"),
    )
    left = max(0.0, 1 - sum(weights.values()))
    goal = F.col("_all") if total is None else F.lit(float(total))
    dealt = F.col("_named") + F.when(F.col("_rest") > 0, F.lit(left)).otherwise(0.0)
    share = F.coalesce(F.col("_weight") / F.col("_size"), F.lit(left) / F.col("_rest"))
    share = F.when(dealt > 0, share / dealt).otherwise(0.0)
    return sums.crossJoin(F.broadcast(whole)).select("_source", (goal * share).alias("rate"))  # one row


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None,
        source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` replicated to the target weights: with rate, copies, copy_no and place, sorted by place.

    Weights are shares of UTF-8 bytes (plus one a document, so that empty and null texts count).
    Null sources are one source. ``place`` is a hash of the key, the copy and the row's text, so the
    global order is random but repeatable; rows are dealt into ranges of it. Documents drawn zero
    times have no row: with a mean m that is a share exp(-m) of them. Repeated rows draw alike,
    rows of one key (or without one) and different texts each for themselves.
    Columns called rate, copies, copy_no or place are replaced. An empty table gives an empty one.
    """
    weights = WEIGHTS if weights is None else weights
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    tables = rates(docs, weights, source, size, total).withColumn(
        "_table", F.when(F.col("rate") > 0, poisson_table(F.col("rate")))
    )
    rows = docs.drop("rate", "copies", "copy_no", "place").withColumns({
        "_source": F.coalesce(F.col(source), F.lit("")),
        # Both before the join, so that they are hashed once and not for each number of the table.
        "_content": F.xxhash64(text), "_u": uniform(F.col(key), F.xxhash64(text)),
    })
    drawn = look_up(rows, tables, "_source", key).withColumn(
        "copies", F.coalesce(poisson_inverse(F.col("_table"), F.col("rate"), F.col("_u")), F.lit(0)).cast("int"),
    ).filter("copies > 0").drop("_table", "_u")
    last = F.expr(f"(copies - 1) div {CHUNK}").cast("int")
    chunks = drawn.withColumn("_chunk", F.explode(F.sequence(F.lit(0), last)))
    often = _often_repeated(tables, weights)
    if often:  # few documents with many copies each: their chunks are dealt to all tasks
        among = F.col("_source").isin(often)
        chunks = chunks.filter(~among).unionByName(chunks.filter(among).repartition("_chunk", key, "_content"))
    chunks = chunks.withColumn("_from", F.col("_chunk") * CHUNK + 1)
    copies = chunks.withColumn(
        "copy_no", F.explode(F.sequence("_from", F.least("copies", F.col("_from") + (CHUNK - 1))))
    ).drop("_source", "_chunk", "_from")
    placed = copies.withColumn("place", uniform(F.col(key), F.col("_content"), F.col("copy_no"), F.lit("place"))).drop("_content")
    return placed.repartitionByRange("place", key).sortWithinPartitions("place", key, "copy_no")


def _often_repeated(tables: DataFrame, weights: dict[str, float]) -> list[str]:
    """Named sources whose documents get more than CHUNK copies on average: at most as many as there are weights."""
    rows = tables.filter(F.col("_source").isin(list(weights)) & (F.col("rate") > CHUNK)).select("_source") if weights else None
    return [row["_source"] for row in rows.collect()] if rows is not None else []
