"""Test output: failing ids, verdict and the feedback text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graincask.functions import text as T

# Patterns of failing ids, in the order in which they are looked for (group 1 is the id), and texts of the feedback. Lines end with \n alone; white space is Unicode's.
_S, _NOT = f"[{T.SPACE}]", f"[^{T.SPACE}]"
FAILURES = (rf"(?md)^(?:FAILED|ERROR){_S}+({_NOT}+)", rf"(?md)^({_NOT}+::{_NOT}+){_S}+(?:FAILED|ERROR)", rf"(?md)^(?:FAIL|ERROR):{_S}+({_NOT}+)")
TIMED_OUT = "TESTS TIMED OUT after the cap.\n"
PASSED = "ALL TESTS PASSED."
FAILED_HEAD, FAILED_END = "TESTS FAILED (", " failing):\n"
TAIL_MARK = "\n\n--- output tail ---\n"
NAMES, MAX_CHARS, TIMEOUT_TAIL = 25, 4000, 1500


def failures(output: Column) -> Column:
    """Distinct failing ids by pattern and then by place."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(output, F.lit(p), F.lit(1)) for p in FAILURES]))


def combined(stdout: Column, stderr: Column) -> Column:
    return F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))


def failed_ids(stdout: Column, stderr: Column, timed_out: Column) -> Column:
    """A timeout has none."""
    return F.when(timed_out, F.array().cast("array<string>")).otherwise(failures(combined(stdout, stderr)))


def verdict(returncode: Column, failed: Column, timed_out: Column) -> Column:
    return (returncode == 0) & (F.size(failed) == 0) & ~timed_out


def feedback(passed: Column, failed: Column, timed_out: Column, stdout: Column, stderr: Column, max_chars: int = MAX_CHARS) -> Column:
    head = F.concat(F.lit(FAILED_HEAD), F.size(failed).cast("string"), F.lit(FAILED_END))
    names = F.array_join(F.transform(F.slice(failed, 1, NAMES), lambda t: F.concat(F.lit("  - "), t)), "\n")
    rest = T.tail(combined(stdout, stderr), F.lit(max_chars) - F.length(head) - F.length(names))
    return (
        F.when(timed_out, F.concat(F.lit(TIMED_OUT), T.tail(F.coalesce(stdout, F.lit("")), F.lit(TIMEOUT_TAIL))))
        .when(passed, F.lit(PASSED)).otherwise(F.concat(head, names, F.lit(TAIL_MARK), rest))
    )
