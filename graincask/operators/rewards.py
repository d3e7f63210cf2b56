"""Rewards and difficulty for reinforcement learning on attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIME_CAP_S, CONTEXT_CAP, STEP_CAP = 300, 64_000, 100


def reward(passed: Column, elapsed_s: Column, n_tokens: Column, weight: Column) -> Column:
    """1 for required tests passed within the cap, less a weight per token."""
    return F.when(passed & (elapsed_s <= TIME_CAP_S), 1.0).otherwise(0.0) - weight * n_tokens


def advantages(attempts: DataFrame, value: str = "reward") -> DataFrame:
    """Adds advantage: (value - mean) / population deviation within the instance, 0 without spread."""
    w = W.partitionBy("instance_id")
    mean, dev = F.avg(value).over(w), F.stddev_pop(value).over(w)
    return attempts.withColumn("advantage", F.when(dev > 0, (F.col(value) - mean) / dev).otherwise(0.0))


def pass_rates(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("tests_passed").cast("int")).alias("n_passed")).withColumn("pass_rate", F.col("n_passed") / F.col("n"))


def learnable(rates: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Tasks that are neither never nor always solved."""
    return rates.filter((F.col("pass_rate") > low) & (F.col("pass_rate") < high))
