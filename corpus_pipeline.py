"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graincask.llm import decontam, inplace, linededup, ngramjoin, packing, quality
from graincask.llm.common import table

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", linededup.stage),
    ("ngram_join", ngramjoin.stage),
    ("decontamination", decontam.stage),
    ("packing", packing.stage),
]

#: Greedy packing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written to the shared folder and goes when the next has read it, or when a stage fails."""
    docs = table(spark, sf_dir, "documents")
    folder = inplace.new_folder(docs, "pipeline")
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                inplace.delete(f"{folder}/{k - 1}")
        return STAGES[-1][1](spark, docs, sf_dir)  # has settled the tokens
    finally:
        inplace.delete(folder)
