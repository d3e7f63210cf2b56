"""Secret scans: candidate spans per text, and how widely over owners each candidate's hash is spread.

A candidate's value goes no further than its SHA-256. The hashes are aggregated by distinct repositories and
owners: a value that many owners hold, or very many repositories of fewer owners, is a copied example; any other value that also looks
random is treated as its owner's and live. Spans are found within the row: a regular expression splits the text into gaps
and matches, whose lengths add up to code-point positions. Everything is DataFrame functions.

Defined results: a null or empty text has no spans. Repeated rows give repeated rows. A null owner or
repository counts as none. A value that one third of all documents hold is one row of the aggregate; its candidates
are pre-aggregated per task, and the join back has one row per hash on its small side, so that Spark may
split the other. Input columns that aren't named in the call are not read, so clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graincask.llm.common import let, settle, table

# Patterns of candidates, in the order of their kinds; (kind, pattern, group of the value, least length of the value).
# The first three are the base kinds; the others are public token formats.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("prefixed", r"(?:gh[oprsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,})", 0, 14),
    ("webtoken", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 35),
    ("keyblock", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
)
BASE = 3
#: From so many distinct owners or repositories on, a value is a copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 6
#: So many distinct characters make a value look live.
LIVE_CHARS = 6


def prefix_sums(lengths: Column) -> Column:
    """Running sums of an array, itself included, in about n * sqrt(n) additions (n is a row's matches)."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def by_block(width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / width).cast("int")), lambda b: total(F.slice(lengths, b * width + 1, width)))
        return let(blocks, lambda sums: let(
            F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))),
            lambda before: F.transform(lengths, lambda _, i: F.get(before, F.floor(i / width).cast("int")) + total(F.slice(lengths, F.floor(i / width).cast("int") * width + 1, i % width + 1))),
        ))

    return F.when(F.size(lengths) == 0, lengths).otherwise(let(F.ceil(F.sqrt(F.size(lengths))).cast("int"), by_block))


def spans_of(text: Column, rank: int) -> Column:
    """Array of (start, rank, kind, end, sha, live) of one kind; code points, end exclusive."""
    kind, pattern, group, least = KINDS[rank]

    def found(parts: Column) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

        def placed(matches: Column) -> Column:
            lengths = F.transform(matches, lambda m, i: F.length(F.get(parts, i)) + F.length(m))
            return let(prefix_sums_of(lengths), lambda ends: let(values, lambda v: F.filter(
                F.transform(matches, lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"),
                    F.sha2(F.get(v, i), 256).alias("sha"),
                    (F.size(F.array_distinct(F.split(F.get(v, i), ""))) >= LIVE_CHARS).alias("live"),
                    F.length(F.get(v, i)).alias("n"))),
                lambda s: s["n"] >= least)))

        return let(whole, placed)

    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), found))


def prefix_sums_of(lengths: Column) -> Column:
    return let(lengths, prefix_sums)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """id, owner, repo, found: all spans by start and then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = docs.select(
        F.col(id_col), (F.col("source") if owner is None else owner).cast("string").alias("owner"),
        (F.nullif(F.concat_ws("/", "source", "lang"), F.lit("")) if repo is None else repo).cast("string").alias("repo"), text.alias("__t"),
    )
    each = start.select(id_col, "owner", "repo", *[spans_of(F.col("__t"), k).alias(f"__{k}") for k in range(len(KINDS))])
    return each.select(id_col, "owner", "repo", F.array_sort(F.array_compact(F.flatten(F.array_compact(F.array(*[f"__{k}" for k in range(len(KINDS))]))))).alias("found"))


def spread(scanned: DataFrame) -> DataFrame:
    """One row per candidate hash: n_repos, n_owners, copied."""
    pairs = scanned.select("owner", "repo", F.explode("found.sha").alias("sha")).distinct()
    return pairs.groupBy("sha").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners")).withColumn("copied", (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def classify(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The scanned rows with n_copied and n_live: distinct values of the text that are copied examples, or an owner's and look live.

    Counts are joined by id and the hash of all values, so that repeated ids stay apart.
    """
    rows = settle(scanned.withColumn("__key", F.xxhash64("found.sha")))
    values = rows.filter(F.size("found") > 0).select(id_col, "__key", F.explode(F.array_distinct(F.transform("found", lambda s: F.struct(s["sha"].alias("sha"), s["live"].alias("live"))))).alias("v")).distinct()
    judged = values.select(id_col, "__key", "v.sha", "v.live").join(spread(rows), "sha")
    per_text = judged.groupBy(F.col(id_col).alias("__id"), F.col("__key").alias("__k")).agg(
        F.sum(F.col("copied").cast("long")).alias("n_copied"), F.sum((~F.col("copied") & F.col("live")).cast("long")).alias("n_live"))
    out = rows.join(per_text, rows[id_col].eqNullSafe(per_text["__id"]) & (rows["__key"] == per_text["__k"]) & (F.size("found") > 0), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_copied", "n_live")}).drop("__id", "__k", "__key")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(scan(table(spark, sf_dir, "documents")))
    count = lambda k: F.size(F.filter("found", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("found", lambda s: s["rank"] < BASE)), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"), "n_copied", "n_live",
    )


def _kind_sql(rank: int) -> str:
    kind, pattern, group, least = KINDS[rank]
    p = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, owner, repo, {rank} AS rank, '{kind}' AS kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, sha256(v) AS sha,
        len(list_distinct(string_split(v, ''))) >= {LIVE_CHARS} AS live
      FROM (SELECT doc_id, owner, repo, m[i] AS m, v[i] AS v, list_sum(list_transform(parts[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e
            FROM (SELECT doc_id, owner, repo, parts, m, v, unnest(range(1, len(m) + 1)) AS i
                  FROM (SELECT doc_id, source AS owner, repo, regexp_split_to_array(t, '{p}') AS parts, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v
                        FROM (SELECT doc_id, source, nullif(concat_ws('/', source, lang), '') AS repo, coalesce(text, '') AS t FROM documents) a WHERE regexp_matches(t, '{p}')) b) c) d
      WHERE length(v) >= {least}"""


SQL_OP6 = f"""
WITH spans AS MATERIALIZED ({" UNION ALL ".join(_kind_sql(k) for k in range(len(KINDS)))}),
spread AS (SELECT sha, count(DISTINCT owner) >= {COPIED_OWNERS} OR count(DISTINCT repo) >= {COPIED_REPOS} AS copied FROM spans GROUP BY sha),
vals AS (SELECT doc_id, sum(CAST(copied AS BIGINT)) AS n_copied, sum(CAST(NOT copied AND live AS BIGINT)) AS n_live
  FROM (SELECT DISTINCT doc_id, sha, live FROM spans) x JOIN spread USING (sha) GROUP BY doc_id),
per AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < {BASE}), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live
FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN vals USING (doc_id)"""
