"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations read bits only.

The ledger keeps one row per document with the measurements and an integer of failure bits. A policy is
a named, versioned mask over those bits, so that changing a policy or asking what one rule costs never
reads a text again. Everything is a DataFrame expression; there is no shuffle, so no key can be hot.

Defined results: a null or empty text has no words, fails the rule of few words and is not kept. Repeated rows give
repeated rows; a null doc_id stays null. Columns other than the id and the text pass through only where
asked for; of those, columns with a name of the ledger's own (measurements, fail_bits, kept) are left out. stage() keeps
all columns, whatever their names. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graincask.llm.common import NOT_SEPARATOR, let, table, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: Rule -> failure test over the measurements, in bit order. Integer arithmetic only.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 16 * n_words",
    "capitals": "100 * n_capitals > 50 * word_chars",
    "shouting": "100 * n_exclaims > 30 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base/1": ("few_words", "repeats"),
    "web/1": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside a window of so many words that is found twice or more in the text, its first place included.

    Window hashes are compared first as a set; only a text that has an equal pair sorts them.
    """

    def covered(starts: Column) -> Column:
        # starts ascending: each covers up to the next start, at most a window
        return F.aggregate(
            F.transform(starts, lambda p, i: F.coalesce(F.least(F.lit(size), F.get(starts, i + 1) - p), F.lit(size))), F.lit(0), lambda a, x: a + x
        )

    def doubled(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(pairs, lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("d"))), lambda x: x["d"]), lambda x: x["i"])))
        return let(starts, covered)

    def windows(ids: Column) -> Column:
        last = F.size(ids) - size
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(ids, i + k) for k in range(size)]))

    return F.when(F.size(words) <= size, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda ids: let(windows(ids), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(doubled(h))))
    )


def measured(docs: DataFrame, row: Column, text_col: str = "text") -> DataFrame:
    """row, measurements (long) and fail_bits (long; bit k is set where the k-th rule fails)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SEPARATOR))
    first = docs.select(row.alias("row"), text.alias("t"), words_of(text).alias("w"), lines.alias("l"))
    found = first.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0), lambda a, w: a + F.length(w)).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit("!+")).cast("long").alias("n_exclaims"),
    )
    bits = sum((F.when(F.expr(test), F.lit(BIT[name])).otherwise(F.lit(0)) for name, test in RULES.items()), F.lit(0))
    return found.withColumn("fail_bits", bits.cast("long"))


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, measurements and fail_bits."""
    own = [id_col, *(c for c in keep if c not in (*MEASURES, "fail_bits", "kept", id_col))]
    return measured(docs, F.struct(*[F.col(f"`{c}`") for c in own]), text_col).select("row.*", *MEASURES, "fail_bits")


def apply_policy(ledger_df: DataFrame, policy: str) -> DataFrame:
    """Adds kept: no bit of the policy's mask is set."""
    return ledger_df.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(ledger_df: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: n_failed, n_only (documents that leaving this rule out would keep), n_kept_without.

    A single aggregation over bits; the ledger is not read again per rule.
    """
    m = mask(policy)
    failed = F.col("fail_bits").bitwiseAND(F.lit(m))
    by_bits = ledger_df.groupBy(failed.alias("bits")).agg(F.count(F.lit(1)).alias("n"))  # at most 2^rules rows
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    spread = by_bits.select("bits", "n", rules).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("bits") == F.col("bit")
    return spread.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(only | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(table(spark, sf_dir, "documents")), "web/1")
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base/1"))) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the web policy keeps, all columns as they were.

    Measured by the text itself, so that the decision needs no join back to the documents.
    """
    return apply_policy(measured(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), "web/1").filter("kept").select("row.*")


def measures_sql(docs: str = "documents") -> str:
    """DuckDB: a row per row of docs with the measurements and fail_bits."""
    bits = " + ".join(f"CASE WHEN {t} THEN {BIT[r]} ELSE 0 END" for r, t in RULES.items())
    return f"""
    SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM (
      SELECT doc_id, rid,
        CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
        CAST(len(regexp_extract_all(t, '!+')) AS BIGINT) AS n_exclaims
      FROM (
        SELECT doc_id, rid, t,
          regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
        FROM (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {docs}) q0
      ) q1
      LEFT JOIN (
        SELECT rid, count(*) AS n FROM (
          SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM (
            SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (
              SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (
                SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM (
                  SELECT row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}) a
                WHERE len(w) >= {WINDOW}) b) c) d
          WHERE c >= 2) e
        GROUP BY rid
      ) r USING (rid)
    ) m"""


SQL_OP4 = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  fail_bits = 0 AS kept, fail_bits
FROM ({measures_sql()}) z"""
