"""Helpers shared by the training-data operators: lineage cuts, in-row lets, native word splitting."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of a word: space and the five control characters from tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]"
NOT_SEPARATOR = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only where that is unset and all runs in one process, as in tests, a folder of this process; on a cluster it must be set."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="graincask-")
        atexit.register(shutil.rmtree, where, True)
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage in the shared folder, so that a lost executor costs no recomputation.

    Spark's context cleaner removes the files once nothing refers to them (cleanCheckpoints).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text (null: none), as the maximal runs of non-separators."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS + "+"), lambda w: w != "")


def n_tasks(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
