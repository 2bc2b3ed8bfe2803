"""Content-addressed model calls: equal requests are asked once, now and in later runs.

A request is known by the SHA-256 of its parts (model, system text, prompt). Requests that no earlier run has
answered are asked once each and their replies appended to a table; rows then look their reply up. Failed
requests are not remembered, so the next run asks them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questline.operators.lookup import hot_keys, lookup
from questline.session import cut_lineage

KEY, REPLY = "_request", "_reply"


def request_key(parts: list[Column]) -> Column:
    """Hex SHA-256 of the parts; a null part differs from an empty one."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def known_replies(like: DataFrame, folder: str) -> DataFrame:
    """Replies of earlier runs, one a request; the folder is made if it isn't there yet."""
    like.limit(0).write.mode("append").parquet(folder)
    return like.sparkSession.read.schema(like.schema).parquet(folder).dropDuplicates([KEY])


def asked_once(
    rows: DataFrame, requests: list[list[Column]], ask: Callable[..., Column], names: list[str],
    folder: str | None = None,
) -> DataFrame:
    """``rows`` with a column for each of ``requests``: the reply to it.

    A request is a list of columns of which the last must not be null; else its reply is null. ``ask`` makes the reply,
    a struct with an ``error``, from these columns. All requests of all rows together are asked once each. With a
    ``folder``, requests with a reply in it are not asked, and new replies without an error are appended to it; two runs
    at the same time may both ask, and the replies of one are then used. Rows may be repeated or ask nothing.
    ``rows`` is read several times, so a costly one should be a written table.
    """
    def request(parts: list[Column]) -> Column:
        return F.struct(request_key(parts).alias(KEY), *[p.alias(f"p{i}") for i, p in enumerate(parts)])

    width = len(requests[0])
    wanted = rows.select(F.explode(F.array(*map(request, requests))).alias("r")).select("r.*").filter(
        F.col(f"p{width - 1}").isNotNull())
    new = wanted.dropDuplicates([KEY])
    reply = ask(*[F.col(f"p{i}") for i in range(width)]).alias(REPLY)
    if folder is None:
        replies = cut_lineage(new.select(KEY, reply))
    else:
        known = known_replies(new.limit(0).select(KEY, reply), folder)
        fresh = cut_lineage(new.join(known.select(KEY), KEY, "left_anti").select(KEY, reply))
        earlier = cut_lineage(known.join(wanted.select(KEY).distinct(), KEY, "left_semi"))
        fresh.filter(F.col(REPLY)["error"].isNull()).write.mode("append").parquet(folder)
        replies = earlier.unionByName(fresh)
    def keyed(given: DataFrame, parts: list[Column]) -> DataFrame:
        return given.withColumn(KEY, F.when(parts[-1].isNotNull(), request_key(parts)))

    # Hot requests are found in the rows themselves: the joins before would all be run for it.
    hot = [hot_keys(keyed(rows, parts), [KEY]) for parts in requests]
    out = rows
    for name, parts, found in zip(names, requests, hot, strict=True):
        out = lookup(keyed(out, parts), replies.withColumnRenamed(REPLY, name), [KEY], F.xxhash64(*rows.columns), found=found).drop(KEY)
    return out
