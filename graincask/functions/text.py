"""Column functions over text: identifiers, definitions, lines, literal counts, word n-grams, stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers and of definition sites (group 1 or 2 is the name).
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]+"
DEFINITION = r"\b(?:def|class|func|fn|function)\s+([A-Za-z_][A-Za-z0-9_]*)|\b(?:public|private|protected|static|final|\s)+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
# Line ends and white space of Unicode text as the reference's language has them.
LINE_END = "\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"
SPACE = "\t\n\x0B\f\r\x1C- \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Words of n-grams for decontamination and near duplicates.
WORD = "[a-z0-9]+"


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased identifiers in order."""
    return F.transform(identifiers(text), F.lower)


def definitions(text: Column) -> Column:
    """Distinct defined names, sorted."""
    both = F.concat(F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(1)), F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(2)))
    return F.array_sort(F.array_distinct(F.filter(both, lambda x: x != "")))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end adds no line, an empty text has none."""
    parts = F.split(text, LINE_END, -1)
    return let(parts, lambda p: F.when(F.get(p, F.size(p) - 1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def literal_count(text: Column, find: Column) -> Column:
    """Non-overlapping occurrences; 0 for an empty needle."""
    return F.when(F.length(find) == 0, F.lit(0)).otherwise(F.floor((F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.length(find)).cast("int"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(ws: Column, n: int) -> Column:
    """Distinct n-grams of an array of words as strings; none where there are fewer."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return let(ws, of)


def ngram_hashes(ws: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the n-grams of an array of words, without their strings; none where there are fewer."""

    def of(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(F.slice(h, i, n)))
        return F.when(F.size(h) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of)


def md5_number(text: Column, digits: int = 7) -> Column:
    """A number from the first hexadecimal digits of the MD5; any engine can compute it."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def blank(text: Column) -> Column:
    """Whether nothing but white space is there (null: yes)."""
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE}]")


def tail(text: Column, n: Column) -> Column:
    """The last characters, 200 at least."""
    return F.right(text, F.greatest(n, F.lit(200)))
