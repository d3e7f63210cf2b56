"""Scoring and ranking of attempts: heuristic outcome score, hybrid score, best of n."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graincask.functions import text as T

#: Added lines and turns up to which an attempt loses nothing, and the least that each term gives.
SMALL_LINES, SMALL_TURNS, LEAST_SIZE, LEAST_TURN = 40, 20, 0.3, 0.5


def added_lines(patch: Column) -> Column:
    """Lines of a patch that add, without file headers."""
    return F.size(F.filter(T.lines(F.coalesce(patch, F.lit(""))), lambda x: x.startswith("+") & ~x.startswith("+++")))


def heuristic_score(empty: Column, added: Column, n_turns: Column) -> Column:
    """In [0, 1]: 0 for an empty patch, else the mean of a size and a turn term, to 4 places."""
    size = F.when(added <= SMALL_LINES, F.lit(1.0)).otherwise(F.greatest(F.lit(LEAST_SIZE), F.lit(float(SMALL_LINES)) / added))
    turn = F.when(n_turns <= SMALL_TURNS, F.lit(1.0)).otherwise(F.greatest(F.lit(LEAST_TURN), F.lit(float(SMALL_TURNS)) / n_turns))
    return F.when(empty, F.lit(0.0)).otherwise(F.round(0.5 * size + 0.5 * turn, 4))


def hybrid(passed: Column, orm: Column, exec_weight: float = 1.0) -> Column:
    return F.lit(float(exec_weight)) * F.when(passed, 1.0).otherwise(0.0) + orm


Scorer = Callable[[DataFrame], Column]


def default_scorer(attempts: DataFrame) -> Column:
    """Over columns patch, n_turns, or added and empty_patch where they exist already."""
    empty = F.col("empty_patch") if "empty_patch" in attempts.columns else T.blank(F.col("patch"))
    added = F.col("added") if "added" in attempts.columns else added_lines(F.col("patch"))
    return heuristic_score(empty, added, F.col("n_turns"))


def score(attempts: DataFrame, scorer: Scorer = default_scorer, *, exec_weight: float = 1.0) -> DataFrame:
    """Adds exec_score, orm_score (computed once) and hybrid."""
    scored = attempts.withColumn("orm_score", scorer(attempts))
    passed = F.coalesce("tests_passed", F.lit(False))
    return scored.withColumns({"exec_score": F.when(passed, 1.0).otherwise(0.0), "hybrid": hybrid(passed, F.col("orm_score"), exec_weight)})


def rerank(attempts: DataFrame, scorer: Scorer = default_scorer, *, exec_weight: float = 1.0) -> DataFrame:
    """Adds the scores and rank within the instance; ties by attempt."""
    w = W.partitionBy("instance_id").orderBy(F.desc("hybrid"), "attempt")
    return score(attempts, scorer, exec_weight=exec_weight).withColumn("rank", F.row_number().over(w))


def select_best(attempts: DataFrame, scorer: Scorer = default_scorer) -> DataFrame:
    return rerank(attempts, scorer).filter("rank = 1").drop("rank")


def grid(attempts: DataFrame, instances: DataFrame, n: int = 8) -> DataFrame:
    """instance × attempt 1..n; a missing attempt is an empty, failed one."""
    seeds = instances.select("instance_id", F.explode(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("attempt"))
    full = seeds.join(attempts, ["instance_id", "attempt"], "left")
    return full.withColumns({"crashed": F.col("tests_passed").isNull(), "tests_passed": F.coalesce("tests_passed", F.lit(False)), "n_turns": F.coalesce("n_turns", F.lit(0))})
