"""Removal of boilerplate lines by how many distinct sites hold them.

The lines are taken apart once and settled as hashes. One HyperLogLog sketch of sites per line hash, merged by aggregation, estimates each line's spread; lines whose estimate is near the threshold get an exact
distinct count. A line on at least MIN_SITES sites goes everywhere but from the document with the smallest id that has it, so that no content is lost from the corpus.
Only hashes are moved, with partial aggregation; texts are read in place (see inplace), at every size. A line that a third of all documents hold is one row on the small side of the join with the lines, so Spark may split the other.

Defined results: a null or empty text has no lines. Lines of fewer than MIN_WORDS words always stay. A null site isn't counted. A null id is larger than all others; equal ids
keep or lose a line together. Repeated rows stay. Other columns pass through in clean(), but those named n_lines or n_removed, which its measures replace; stage() keeps those too. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graincask.llm import inplace
from graincask.llm.common import settle, table

MIN_SITES, MIN_WORDS = 10, 3
#: Logarithm of a sketch's registers (a standard error of 1.6 %), and the part of the threshold within which estimates are settled by an exact count.
LG_K, NEAR = 12, 0.2
LAST = (1 << 63) - 1
WORD = r"[^\x20\x09-\x0D]+"
LINE = ["h1", "h2"]


def _pinned(docs: DataFrame, id_col: str, text_col: str, site: Column | None, *more: Column) -> inplace.Pinned:
    site = (F.col("source") if site is None else site).cast("string")
    return inplace.pinned(docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("label"), F.xxhash64(text_col).alias("key"), F.when(site.isNotNull(), F.xxhash64(site)).alias("site"), F.col(text_col).alias("text"), *more))


def exploded(docs: inplace.Pinned) -> DataFrame:
    """part, label, key (of the text), site, place and two hashes of every line that may go. Settled."""
    rows = docs.rows.filter("text <> ''").select("part", "label", "key", "site", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return settle(rows.filter(F.regexp_count("line", F.lit(WORD)) >= MIN_WORDS).select("part", "label", "key", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The lines (rows) whose hash is on at least so many sites, with first, the smallest label that has it."""
    sketched = settle(
        lines.groupBy(LINE).agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("label").alias("first"))
        .select(*LINE, "first", F.hll_sketch_estimate("sketch").alias("estimate")).filter(F.col("estimate") >= min_sites * (1 - NEAR)))
    hits = settle(lines.join(sketched, LINE))
    sure = F.col("estimate") > min_sites * (1 + NEAR)
    exact = hits.filter(~sure).groupBy(LINE).agg(F.countDistinct("site").alias("sites")).filter(F.col("sites") >= min_sites).select(LINE)
    return hits.filter(sure).unionByName(hits.filter(~sure).join(exact, LINE, "left_semi"))


def losses(docs: inplace.Pinned, min_sites: int = MIN_SITES) -> str:
    """Where the places of the lines that texts lose are filed, by key and label."""
    gone = boilerplate(exploded(docs), min_sites).filter("label > first")
    return inplace.file_away(gone.groupBy("part", "key", "label").agg(F.collect_set("place").alias("places")))


def _cleaned(docs: inplace.Pinned, row_type: str, min_sites: int) -> DataFrame:
    """row, text (without its boilerplate lines; one that loses none stays as it is, a null too), n_lines, n_removed."""
    filed = losses(docs, min_sites)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, told = None, None
        for part, batch in inplace.by_part(batches, 1 << 12):
            if part != at:
                at, told = part, inplace.Told(filed, part, "key", "label")
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            texts, found = column("text"), told.find(column("key").to_numpy(), column("label").to_numpy())
            n = column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            removed = np.zeros(len(n), np.int64)
            some = np.flatnonzero(found >= 0)
            if len(some):
                new = texts.to_pylist()
                for i in some.tolist():
                    places = set(told.table.column("places")[int(found[i])].as_py())
                    removed[i] = len(places)
                    new[i] = "\n".join([x for k, x in enumerate(new[i].split("\n")) if k not in places])
                texts = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([column("row"), texts, pa.array(n), pa.array(removed)], names=["row", "text", "n_lines", "n_removed"])

    count = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    return docs.rows.select("part", "label", "key", "row", "text", count.cast("long").alias("n")).mapInArrow(cut, f"row {row_type}, text string, n_lines long, n_removed long")


def _whole(docs: DataFrame) -> tuple[Column, str]:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs.schema.simpleString()


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site: Column | None = None, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents' columns, with n_lines and n_removed; a text without its boilerplate lines, one that loses none as it is, a null too."""
    row, kind = _whole(docs)
    done = _cleaned(_pinned(docs, id_col, text_col, site, row), kind, min_sites)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = clean(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL_OP3 = f"""
WITH t AS (SELECT doc_id, source, CASE WHEN coalesce(text, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(text, chr(10)) END AS l FROM documents),
x AS MATERIALIZED (SELECT doc_id, source, i, l[i] AS line, len(regexp_extract_all(l[i], '[^\\x20\\x09-\\x0D]+')) >= {MIN_WORDS} AS may FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM t) y),
b AS (SELECT line, min(doc_id) AS first_id FROM x WHERE may GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT x.doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM (SELECT x.doc_id, x.line, i, may AND first_id IS NOT NULL AND x.doc_id > first_id AS gone FROM x LEFT JOIN b USING (line)) x GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without boilerplate lines; one of which no word is left goes. All columns as they were, but text and n_chars of the documents that lose lines."""
    row, kind = _whole(docs)
    done = _cleaned(_pinned(docs, "doc_id", "text", None, row), kind, MIN_SITES)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(WORD)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.filter(left).select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
