"""Connected components as joins: large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questline.config import HOT_ROWS
from questline.operators.lookup import lookup
from questline.session import cut_lineage

MAX_ROUNDS = 60  # rounds grow with the logarithm of the longest chain; this is a guard, not a cut


def _hung(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every neighbour of ``u`` hung on the least of them: (u, v) becomes (v, least).

    The hub of a star may hold a third of all edges; with ``hubs``, rows of such ones are dealt out.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return lookup(edges, least, ["u"], F.col("v"), "inner") if hubs else edges.join(least, "u")


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hung(both, hubs).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    hung = _hung(edges, hubs)
    down = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    own = hung.select("u", F.col("m").alias("v"))
    return down.unionByName(own).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge: the smallest node it can be reached from.

    Edges of a node with itself and null ends are ignored; no edges, no rows. Each round
    keeps one row per node, is written to the shared folder and survives lost executors.
    Only counts and checksums come to the driver.
    """
    at = cut_lineage(
        edges.filter(f"{a} != {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        seen = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == before:
            break
        before = seen
        hubs = 2 * seen[0] > HOT_ROWS  # no node of fewer edges can have that many
        large = _large_star(at, hubs)
        at = cut_lineage(_small_star(cut_lineage(large) if hubs else large, hubs))
    else:
        raise RuntimeError("components did not settle")
    stars = at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
