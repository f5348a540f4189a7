"""Connected components of a link table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, stage


def _around(links: DataFrame, total: int) -> DataFrame:
    """Each link (u, v) with m, the smallest of u and its neighbours; a hub's links are spread over tasks."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_hot(links, least, "u", "n", total).select("u", "v", F.least("u", "m").alias("m"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """``links``: u, v (longs), in either direction and as often as may be. Returns u, label: each linked node but the smallest of
    its component, with that smallest node. No links give no rows. The number of rounds grows with the logarithm of the longest path.
    """
    now = stage(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    was = _state(now)
    while was[0]:
        both = stage(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        # large star: every larger neighbour is linked to the smallest
        large = _around(both, 2 * was[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        # small star: every smaller neighbour, and the node itself, is linked to the smallest
        small = _around(large, large.count())
        pairs = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        then = stage(pairs.where("u != v").distinct(), "small")
        is_now = _state(then)
        discard(both, large, now)
        now = then
        if is_now == was:
            break
        was = is_now
    return now.withColumnRenamed("v", "label")
