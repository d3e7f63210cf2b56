"""Connected components of an edge table by alternating large and small stars; nothing goes to the driver but a fingerprint per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincask.llm.common import settle


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges a, b (long) -> a, b: each node but the smallest of its component once, with that smallest node b.

    Rounds grow with the logarithm of the component size. A hub's edges are reduced by a partial minimum, and joined with one row per node.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = _print(now)
    if not seen[0]:
        return now
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large.filter("a <> b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        now = settle(joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())
        if (fresh := _print(now)) == seen:
            return now
        seen = fresh
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
