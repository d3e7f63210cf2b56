"""Replay of agent logs: summaries, tool calls and their results, gates on traces, chat serialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Tools with their required arguments and the defaults of the optional ones.
TOOLS = {
    "search_replace": (("path", "find", "replace"), {"expected_count": 1}),
    "ast_edit": (("path", "target_symbol", "new_source"), {}),
    "localize": (("query",), {"top_k": 10}),
    "read_file": (("path",), {"start": 1, "end": 0}),
    "run_tests": ((), {}),
}
# Beginnings of tool results and the class that each shows.
RESULT_CLASSES = (
    ("EDIT OK", "edit_ok"), ("EDIT FAILED", "edit_failed"), ("TOOL ARG PARSE ERROR", "bad_arguments"), ("TOOL CRASHED", "crashed"), ("unknown tool", "unknown_tool"),
    ("no such file", "no_file"), ("ALL TESTS PASSED", "tests_passed"), ("TESTS FAILED", "tests_failed"), ("TESTS TIMED OUT", "tests_timed_out"),
)
SUCCESS = "ALL TESTS PASSED"


def arguments(raw: Column) -> Column:
    """Arguments as a map of strings; '' and null are {}, anything else that isn't a JSON object is null, blanks too."""
    text = F.coalesce(F.nullif(raw, F.lit("")), F.lit("{}"))
    return F.from_json(text, "map<string,string>")


def parses(raw: Column) -> Column:
    text = F.coalesce(F.nullif(raw, F.lit("")), F.lit("{}"))
    return F.try_parse_json(text).isNotNull()


def call_status(name: Column, raw: Column) -> Column:
    """valid, unknown_tool, bad_json or missing_argument, without running anything."""
    args = arguments(raw)
    missing = F.lit(False)
    for tool, (required, _) in TOOLS.items():
        for r in required:
            missing = missing | ((name == tool) & ~F.coalesce(F.map_contains_key(args, F.lit(r)), F.lit(False)))
    return F.when(~parses(raw), "bad_json").when(~F.coalesce(name.isin(*TOOLS), F.lit(False)), "unknown_tool").when(missing, "missing_argument").otherwise("valid")


def with_default(raw: Column, key: str, default: int) -> Column:
    return F.coalesce(F.expr("try_cast(NULL AS INT)") if raw is None else F.try_element_at(arguments(raw), F.lit(key)).try_cast("int"), F.lit(default))


def result_class(content: Column) -> Column:
    out = F.lit("other")
    for start, kind in reversed(RESULT_CLASSES):
        out = F.when(content.startswith(start), kind).otherwise(out)
    return out


def summaries(messages: DataFrame) -> DataFrame:
    """Per instance: messages by role, assistant turns, characters of content (the reference quantity called tokens), and the last role."""
    count = lambda role: F.count_if(F.col("role") == role)
    return messages.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n_messages"), count("assistant").alias("n_turns"), count("user").alias("n_user"), count("system").alias("n_system"), count("tool").alias("n_tool"),
        F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n_tokens"), F.max_by("role", "turn").alias("last_role"))


def with_tool_names(messages: DataFrame) -> DataFrame:
    """Adds tool: the name of the call that a tool message answers, by the calls of the instance's assistant messages (columns tool_calls and tool_call_id)."""
    calls = messages.select("instance_id", F.explode("tool_calls").alias("c")).select("instance_id", F.col("c.id").alias("tool_call_id"), F.col("c.function.name").alias("tool"))
    return messages.join(calls.dropDuplicates(["instance_id", "tool_call_id"]), ["instance_id", "tool_call_id"], "left")


def passed_run() -> Column:
    """Whether a message (role, tool, content) is the result of a test run that passed."""
    return F.coalesce((F.col("role") == "tool") & (F.col("tool") == "run_tests") & F.col("content").startswith(SUCCESS), F.lit(False))


def resolved(messages: DataFrame) -> DataFrame:
    """Per instance: whether a test run shows success, and the first turn that does. messages: see with_tool_names()."""
    hit = passed_run()
    return messages.groupBy("instance_id").agg(F.bool_or(hit).alias("resolved"), F.min(F.when(hit, F.col("turn"))).alias("first_success"))


def reasoning_style(messages: DataFrame) -> DataFrame:
    """Per instance: reasoned, whether an assistant message carries reasoning (reasoning_content, kept beside the content)."""
    return messages.groupBy("instance_id").agg(F.bool_or(F.coalesce((F.col("role") == "assistant") & (F.col("reasoning_content") != ""), F.lit(False))).alias("reasoned"))


def until_success(messages: DataFrame, success: Column) -> DataFrame:
    """Messages up to and with the first turn for which success holds; all where there is none."""
    first = F.min(F.when(success, F.col("turn"))).over(W.partitionBy("instance_id"))
    return messages.withColumn("__first", first).filter(F.col("__first").isNull() | (F.col("turn") <= F.col("__first"))).drop("__first")


def serialize(messages: DataFrame) -> DataFrame:
    """instance_id, text: turns in order, each as a line with the role's tag and then the content."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("content", F.lit("")).alias("content"))))
    return messages.groupBy("instance_id").agg(turns.alias("m")).select("instance_id", F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["content"])), "\n").alias("text"))


def gate(traces: DataFrame, max_tokens: int) -> DataFrame:
    """Adds reason: the first rule that rejects a trace, or 'keep'. Columns: passed, n_bad_calls, truncated, n_tokens."""
    reason = (
        F.when(~F.coalesce("passed", F.lit(False)), "tests").when(F.col("n_bad_calls") > 0, "format").when(F.col("truncated"), "truncated")
        .when(F.col("n_tokens") > max_tokens, "length").otherwise("keep")
    )
    return traces.withColumn("reason", reason)
