"""Readers: parquet tables, JSON lines of trajectories and predictions, source-file trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of source files, folders that are skipped, and the size cap in bytes.
SOURCE_SUFFIXES = ("py", "java", "kt", "rs", "cc", "cpp", "cxx", "h", "hpp", "go", "ts", "js")
SKIPPED_FOLDERS = (".git", "node_modules", "venv", ".venv", "__pycache__", "build", "dist", ".tox")
MAX_FILE_BYTES = 1_000_000

_CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,reasoning_content:string,tool_calls:array<{_CALL}>,tool_call_id:string>"
TRAJECTORY = f"instance_id string, messages array<{MESSAGE}>, resolved boolean, n_turns int, final_patch string, error string"
PREDICTION = "instance_id string, model_name_or_path string, model_patch string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a declared schema; nothing is inferred."""
    return spark.read.schema(TRAJECTORY).json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


def suffix_of(path: Column) -> Column:
    """Lower-cased text after the last dot of the last path part; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_source(path: Column, n_bytes: Column) -> Column:
    """By suffix, folders of the relative path and size."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return suffix_of(path).isin(*SOURCE_SUFFIXES) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))) & (n_bytes <= MAX_FILE_BYTES)


def source_tree(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """repo, path (relative), ext, n_bytes, text of the source files under a folder; undecodable bytes are dropped.

    Size and suffix are filtered before contents are read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root)).toString()
    path = F.regexp_replace(F.substring("path", len(base) + 1, 1 << 20), "^/+", "")
    small = raw.filter(F.col("length") <= MAX_FILE_BYTES).withColumn("rel", path).filter(is_source(F.col("rel"), F.col("length")))
    # an invalid sequence decodes to U+FFFD, which is then dropped
    return small.select(F.lit(repo).alias("repo"), F.col("rel").alias("path"), suffix_of(F.col("rel")).alias("ext"), F.col("length").alias("n_bytes"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "").alias("text"))
