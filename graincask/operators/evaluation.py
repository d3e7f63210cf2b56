"""Evaluation reports: rates, breakdowns, comparisons and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Of the sketch that brackets a percentile: its error is 1 / ACCURACY of the rows at most.
ACCURACY = 10_000


def rate(condition: Column) -> Column:
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), 6)


def breakdown(runs: DataFrame, passed: Column, *keys: str) -> DataFrame:
    """Overall and per key: level, value, n, n_resolved, by grouping sets in one pass."""
    sets = [[F.col(k)] for k in keys] + [[]]
    grouped = runs.withColumn("p", passed.cast("int")).groupingSets(sets, *[F.col(k) for k in keys]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("p").alias("n_resolved"))
    level, value = F.lit("all"), F.lit("")
    for i, k in enumerate(keys):
        here = F.col("g") == (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
        level, value = F.when(here, k).otherwise(level), F.when(here, F.col(k)).otherwise(value)
    return grouped.select(level.alias("level"), value.alias("value"), "n", "n_resolved", F.round(F.col("n_resolved") / F.col("n"), 6).alias("resolve_rate"))


def percentiles(rows: DataFrame, key: str, value: str, points: dict[str, float]) -> DataFrame:
    """key, one column per point with its exact, linearly interpolated percentile (as SQL's percentile_cont), and mean; nulls don't count.

    A mergeable sketch brackets each point between two values; only the values within the bracket are then counted one by one, by key and value, so no task holds all values of a key.
    Of a key with few rows all values are counted.
    """
    given = rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    margin, accuracy = 3 / ACCURACY, F.lit(ACCURACY)
    ends = [c for i, p in enumerate(points.values()) for c in (F.percentile_approx("v", max(0.0, p - margin), accuracy).alias(f"lo{i}"), F.percentile_approx("v", min(1.0, p + margin), accuracy).alias(f"hi{i}"))]
    sketch = given.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), *ends)
    # the bracket reaches to the extremes where a step of the sketch is less than a row or the sketch ends, so that both neighbours of a point are in it
    few = F.col("n") <= 2 * ACCURACY
    wide = [F.when(few | F.lit(p <= margin), F.col("least")).otherwise(F.col(f"lo{i}")).alias(f"lo{i}") for i, p in enumerate(points.values())]
    wide += [F.when(few | F.lit(p >= 1 - margin), F.col("most")).otherwise(F.col(f"hi{i}")).alias(f"hi{i}") for i, p in enumerate(points.values())]
    at = sketch.select("k", "n", "mean", *wide)
    kept = given.join(at, "k").select("k", "v", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, p in enumerate(points.values())])).alias("b"))
    # values below the bracket count as one, those above it not at all
    met = kept.filter("v <= b.hi").select("k", "n", "b.i", "b.p", F.when(F.col("v") >= F.col("b.lo"), F.col("v")).alias("v")).groupBy("k", "n", "i", "p", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("k", "i").orderBy(F.asc_nulls_first("v")))
    place = F.col("p") * (F.col("n") - 1)
    ranked = met.withColumns({"upto": upto, "place": place})
    value_at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))  # noqa: E731  smallest value with more than r rows up to it
    each = ranked.groupBy("k", "i", "place").agg(value_at(F.floor("place")).alias("x"), value_at(F.ceil("place")).alias("y"))
    exact = each.select("k", "i", (F.col("x") + (F.col("y") - F.col("x")) * (F.col("place") - F.floor("place"))).alias("q"))
    found = exact.groupBy("k").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(points)])
    return found.join(at.select("k", "mean"), "k").select(F.col("k").alias(key), *points, "mean")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per instance outcome of two runs (instance_id, resolved): both, a_only, b_only, neither; an instance that one run lacks is unresolved there."""
    x, y = a.select("instance_id", F.col("resolved").alias("ra")), b.select("instance_id", F.col("resolved").alias("rb"))
    both = x.join(y, "instance_id", "full").select("instance_id", F.coalesce("ra", F.lit(False)).alias("ra"), F.coalesce("rb", F.lit(False)).alias("rb"))
    return both.withColumn("outcome", F.when(F.col("ra") & F.col("rb"), "both").when(F.col("ra"), "a_only").when(F.col("rb"), "b_only").otherwise("neither"))


def gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: instances in both runs, both rates and their difference."""
    x, y = a.select("instance_id", F.col("resolved").alias("ra")), b.select("instance_id", F.col("resolved").alias("rb"))
    return x.join(y, "instance_id").agg(F.count(F.lit(1)).alias("n"), rate(F.col("ra")).alias("rate_a"), rate(F.col("rb")).alias("rate_b"), F.round(F.avg(F.col("ra").cast("double")) - F.avg(F.col("rb").cast("double")), 6).alias("gap"))
