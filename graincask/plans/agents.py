"""Queries over edits, test logs, tool calls, trajectories and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincask.catalog import query
from graincask.functions import text as T
from graincask.operators import edits, rerank, testlog, trajectory
from graincask.plans import views as V
from graincask.sources.tables import table

# --- edits: 'the' is replaced in each text; the number expected follows from the id, every 50th file is missing


def _edit(spark, sf):
    d = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 50 == 49, F.lit(None)).otherwise(F.coalesce("text", F.lit("")))
    find = F.when(F.col("doc_id") % 25 == 7, "").otherwise(". ")
    rows = d.select(F.col("doc_id").cast("string").alias("path"), text.alias("text"), find.alias("find"), F.lit("! ").alias("replacement"), (F.col("doc_id") % 5).cast("int").alias("expected"))
    return rows.withColumn("r", edits.search_replace(F.col("path"), F.col("text"), F.col("find"), F.col("replacement"), F.col("expected")))


_EDIT = """WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 50 = 49 THEN NULL ELSE coalesce(text, '') END AS text, CASE WHEN doc_id % 25 = 7 THEN '' ELSE '. ' END AS find, doc_id % 5 AS expected FROM documents),
n AS (SELECT *, CASE WHEN find = '' THEN 0 ELSE (length(text) - length(replace(text, find, ''))) // 2 END AS n FROM e),
m AS (SELECT *, CASE WHEN text IS NULL THEN 'no such file: ' || path WHEN find = '' THEN 'empty `find` string' WHEN n = 0 THEN '`find` text not present; re-localize the anchor'
  WHEN n <> expected THEN 'ambiguous edit: `find` occurs ' || n || 'x but expected_count=' || expected || '; widen the anchor or set expected_count' ELSE 'ok' END AS message FROM n) """


@query("edit_status", _EDIT + "SELECT path, message = 'ok' AS ok, message, CAST(CASE WHEN message = 'ok' THEN n ELSE 0 END AS INTEGER) AS n_replacements FROM m")
def edit_status(spark, sf):
    return _edit(spark, sf).select("path", "r.ok", "r.message", "r.n_replacements")


@query("edit_apply", _EDIT + "SELECT path, md5(replace(text, find, '! ')) AS after_md5 FROM m WHERE message = 'ok'")
def edit_apply(spark, sf):
    return _edit(spark, sf).filter("r.ok").select("path", F.md5("r.after").alias("after_md5"))


@query("edit_diff")
def edit_diff(spark, sf):
    done = _edit(spark, sf).filter("r.ok").withColumn("diff", edits.unified_diff("path", "text", "r.after"))
    return done.select("path", "diff", edits.edit_message(F.col("r.ok"), F.col("r.message"), F.col("r.n_replacements"), F.col("diff")).alias("shown"))


def _python(spark, sf):
    i = F.col("doc_id").cast("string")
    source = F.concat(F.lit("import os\n\n\n@deco\nclass C"), i, F.lit(":\n    def one(self):\n        return 1\n\n    @deco\n    def two(self):\n        return 2\n\n\ndef top():\n    return "), i, F.lit("\n"))
    target = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("C"), i, F.lit(".two"))).when(F.col("doc_id") % 4 == 1, "top").when(F.col("doc_id") % 4 == 2, F.concat(F.lit("C"), i)).otherwise("two")
    new = F.when(F.col("doc_id") % 12 == 5, "def top(:\n    return").otherwise("def two(self):\n    return 22")
    return table(spark, sf, "documents").select(F.concat(F.lit("m"), i, F.when(F.col("doc_id") % 10 == 9, ".rs").otherwise(".py")).alias("path"), source.alias("text"), target.alias("target_symbol"), new.alias("new_source"))


@query("symbol_span")
def symbol_span(spark, sf):
    return edits.symbol_spans(_python(spark, sf)).select("path", "target_symbol", "start_line", "end_line")


@query("ast_edit")
def ast_edit(spark, sf):
    return edits.ast_edit(_python(spark, sf)).select("path", "target_symbol", "ok", "message", "n_replacements", "after", "diff")


@query("ast_edit_fallback")
def ast_edit_fallback(spark, sf):
    return edits.ast_edit(_python(spark, sf).filter("path LIKE '%.rs'")).select("path", "ok", "message")


@query("reindent")
def reindent(spark, sf):
    d = table(spark, sf, "conversations")
    return d.select("conv_id", "turn", edits.reindent(F.coalesce("text", F.lit("")), F.lit("    ")).alias("block"))


# --- test logs


def _failed(spark, sf):
    return V.logs(spark, sf).withColumn("failed", testlog.failed_ids(F.col("stdout"), F.col("stderr"), F.col("timed_out"))).withColumn("passed", testlog.verdict(F.col("returncode"), F.col("failed"), F.col("timed_out")))


_FAILED = f"WITH {V.LOGS}, {V.FAILED_IDS} "


@query("parse_failures", _FAILED + "SELECT instance_id, array_to_string(failed, ',') AS failed FROM v_failed")
def parse_failures(spark, sf):
    return _failed(spark, sf).select("instance_id", F.array_join("failed", ",").alias("failed"))


@query("test_verdict", _FAILED + "SELECT instance_id, returncode = 0 AND len(failed) = 0 AND NOT timed_out AS passed, timed_out FROM v_failed")
def test_verdict(spark, sf):
    return _failed(spark, sf).select("instance_id", "passed", "timed_out")


@query("test_feedback", _FAILED + """, h AS (SELECT *, returncode = 0 AND len(failed) = 0 AND NOT timed_out AS passed, 'TESTS FAILED (' || len(failed) || ' failing):' || chr(10) AS head, array_to_string(list_transform(failed[1:25], lambda x: '  - ' || x), chr(10)) AS names, stdout || chr(10) || stderr AS everything FROM v_failed)
SELECT instance_id, CAST(len(failed) AS INTEGER) AS n_failed, CASE WHEN timed_out THEN 'TESTS TIMED OUT after the cap.' || chr(10) || right(stdout, 1500) WHEN passed THEN 'ALL TESTS PASSED.'
  ELSE head || names || chr(10) || chr(10) || '--- output tail ---' || chr(10) || right(everything, greatest(4000 - length(head) - length(names), 200)) END AS feedback FROM h""")
def test_feedback(spark, sf):
    return _failed(spark, sf).select("instance_id", F.size("failed").alias("n_failed"), testlog.feedback(F.col("passed"), F.col("failed"), F.col("timed_out"), F.col("stdout"), F.col("stderr")).alias("feedback"))


# --- tool calls

_STATUS = """s AS (SELECT *, coalesce(nullif(arguments, ''), '{}') AS j FROM v_calls), c AS (SELECT *, CASE WHEN NOT json_valid(j) THEN 'bad_json' WHEN name IS NULL OR name NOT IN ('search_replace', 'ast_edit', 'localize', 'read_file', 'run_tests') THEN 'unknown_tool'
  WHEN name = 'search_replace' AND NOT (json_exists(j, '$.path') AND json_exists(j, '$.find') AND json_exists(j, '$.replace')) OR name = 'ast_edit' AND NOT (json_exists(j, '$.path') AND json_exists(j, '$.target_symbol') AND json_exists(j, '$.new_source')) OR name = 'localize' AND NOT json_exists(j, '$.query') OR name = 'read_file' AND NOT json_exists(j, '$.path') THEN 'missing_argument' ELSE 'valid' END AS status FROM s)"""


def _status(spark, sf):
    return V.toolcalls(spark, sf).withColumn("status", trajectory.call_status(F.col("name"), F.col("arguments")))


@query("toolcall_validity", f"WITH {V.TOOLCALLS}, {_STATUS} SELECT instance_id, count(*) AS n_calls, count(*) FILTER (WHERE status = 'valid') AS n_valid, count(*) FILTER (WHERE status = 'bad_json') AS n_bad_json, count(*) FILTER (WHERE status = 'unknown_tool') AS n_unknown, count(*) FILTER (WHERE status = 'missing_argument') AS n_missing FROM c GROUP BY instance_id")
def toolcall_validity(spark, sf):
    c = lambda s: F.count_if(F.col("status") == s)
    return _status(spark, sf).groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_calls"), c("valid").alias("n_valid"), c("bad_json").alias("n_bad_json"), c("unknown_tool").alias("n_unknown"), c("missing_argument").alias("n_missing"))


@query("tool_usage", f"WITH {V.TOOLCALLS} SELECT coalesce(name, 'none') AS name, count(*) AS n_calls, count(DISTINCT instance_id) AS n_instances FROM v_calls GROUP BY 1")
def tool_usage(spark, sf):
    return V.toolcalls(spark, sf).groupBy(F.coalesce("name", F.lit("none")).alias("name")).agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("instance_id").alias("n_instances"))


@query("tool_args_defaults", f"WITH {V.TOOLCALLS}, s AS (SELECT call_id, coalesce(nullif(arguments, ''), '{{}}') AS j FROM v_calls) SELECT call_id, coalesce(TRY_CAST(CASE WHEN json_valid(j) THEN j->>'$.top_k' END AS INTEGER), 10) AS top_k, greatest(coalesce(TRY_CAST(CASE WHEN json_valid(j) THEN j->>'$.start' END AS INTEGER), 1), 1) AS start_line, coalesce(TRY_CAST(CASE WHEN json_valid(j) THEN j->>'$.end' END AS INTEGER), 0) AS end_line FROM s")
def tool_args_defaults(spark, sf):
    a = F.col("arguments")
    return V.toolcalls(spark, sf).select("call_id", trajectory.with_default(a, "top_k", 10).alias("top_k"), F.greatest(trajectory.with_default(a, "start", 1), F.lit(1)).alias("start_line"), trajectory.with_default(a, "end", 0).alias("end_line"))


@query("toolcall_results", f"WITH {V.TOOLCALLS} SELECT c.call_id, c.name, CASE WHEN e.event_id IS NULL THEN 'no result' ELSE e.event_type END AS result FROM v_calls c LEFT JOIN (SELECT * FROM events WHERE event_id % 6 <> 5) e ON e.event_id = c.call_id")
def toolcall_results(spark, sf):
    results = table(spark, sf, "events").filter("event_id % 6 <> 5").select(F.col("event_id").alias("call_id"), "event_type")
    return V.toolcalls(spark, sf).select("call_id", "name").join(results, "call_id", "left").select("call_id", "name", F.coalesce("event_type", F.lit("no result")).alias("result"))


# --- trajectories


@query("traj_summary", f"WITH {V.MESSAGES} SELECT instance_id, count(*) AS n_messages, count(*) FILTER (WHERE role = 'assistant') AS n_turns, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'system') AS n_system, count(*) FILTER (WHERE role = 'tool') AS n_tool, CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS n_tokens, arg_max(role, turn) AS last_role FROM v_messages GROUP BY instance_id")
def traj_summary(spark, sf):
    return trajectory.summaries(V.messages(spark, sf))


@query("traj_len", f"WITH {V.MESSAGES} SELECT instance_id, CAST(sum(length(content)) AS BIGINT) AS n_tokens FROM v_messages GROUP BY instance_id")
def traj_len(spark, sf):
    return V.messages(spark, sf).groupBy("instance_id").agg(F.sum(F.length("content")).alias("n_tokens"))


@query("resolved_flag", f"WITH {V.MESSAGES} SELECT instance_id, bool_or(role = 'tool' AND tool = 'run_tests' AND starts_with(content, 'ALL TESTS PASSED')) AS resolved, min(turn) FILTER (WHERE role = 'tool' AND tool = 'run_tests' AND starts_with(content, 'ALL TESTS PASSED')) AS first_success FROM v_messages GROUP BY instance_id")
def resolved_flag(spark, sf):
    return trajectory.resolved(V.messages(spark, sf))


@query("result_classes", f"WITH {V.MESSAGES} SELECT instance_id, turn, CASE WHEN starts_with(content, 'EDIT OK') THEN 'edit_ok' WHEN starts_with(content, 'ALL TESTS PASSED') THEN 'tests_passed' WHEN starts_with(content, 'TESTS FAILED') THEN 'tests_failed' ELSE 'other' END AS class FROM v_messages WHERE role = 'tool'")
def result_classes(spark, sf):
    return V.messages(spark, sf).filter("role = 'tool'").select("instance_id", "turn", trajectory.result_class(F.col("content")).alias("class"))


@query("traj_truncate_at_success", f"WITH {V.MESSAGES}, f AS (SELECT *, min(CASE WHEN role = 'tool' AND tool = 'run_tests' AND starts_with(content, 'ALL TESTS PASSED') THEN turn END) OVER (PARTITION BY instance_id) AS first FROM v_messages) SELECT instance_id, turn, role FROM f WHERE first IS NULL OR turn <= first")
def traj_truncate_at_success(spark, sf):
    return trajectory.until_success(V.messages(spark, sf), trajectory.passed_run()).select("instance_id", "turn", "role")


@query("chat_serialize", f"WITH {V.MESSAGES} SELECT instance_id, md5(string_agg('<|' || role || '|>' || chr(10) || coalesce(content, ''), chr(10) ORDER BY turn)) AS text_md5 FROM v_messages GROUP BY instance_id")
def chat_serialize(spark, sf):
    return trajectory.serialize(V.messages(spark, sf)).select("instance_id", F.md5("text").alias("text_md5"))


@query("trace_gate", f"WITH {V.TRACES} SELECT instance_id, CASE WHEN NOT coalesce(passed, FALSE) THEN 'tests' WHEN instance_id % 17 = 3 THEN 'format' WHEN truncated THEN 'truncated' WHEN n_tokens > 4000 THEN 'length' ELSE 'keep' END AS reason FROM v_traces")
def trace_gate(spark, sf):
    bad = F.when(F.col("instance_id") % 17 == 3, 1).otherwise(0)
    return trajectory.gate(V.traces(spark, sf).withColumn("n_bad_calls", bad), 4000).select("instance_id", "reason")


# --- attempts

_ADDED = "len(list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')))"
_ORM = """CASE WHEN {empty} THEN 0.0 ELSE round(0.5 * CASE WHEN {added} <= 40 THEN 1.0::DOUBLE ELSE greatest(0.3::DOUBLE, 40.0::DOUBLE / {added}) END + 0.5 * CASE WHEN n_turns <= 20 THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, 20.0::DOUBLE / n_turns) END, 4) END"""


@query("patch_added_lines", f"WITH {V.PATCHES} SELECT doc_id, CAST({_ADDED} AS INTEGER) AS added FROM v_patches")
def patch_added_lines(spark, sf):
    return V.patches(spark, sf).select("doc_id", rerank.added_lines(F.col("patch")).alias("added"))


@query("empty_patch_rate", f"WITH {V.PATCHES} SELECT count(*) AS n, count(*) FILTER (WHERE e) AS n_empty, round(avg(CAST(e AS INTEGER)), 6) AS empty_rate FROM (SELECT regexp_replace(patch, '\\s', '', 'g') = '' AS e FROM v_patches) x")
def empty_patch_rate(spark, sf):
    e = V.patches(spark, sf).select(T.blank(F.col("patch")).alias("e"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if("e").alias("n_empty"), F.round(F.avg(F.col("e").cast("int")), 6).alias("empty_rate"))


@query("orm_score", f"WITH {V.PATCHES}, a AS (SELECT doc_id, n_turns, regexp_replace(patch, '\\s', '', 'g') = '' AS empty, {_ADDED} AS added FROM v_patches) SELECT doc_id, {_ORM.format(empty='empty', added='added')} AS orm_score FROM a")
def orm_score(spark, sf):
    p = V.patches(spark, sf)
    return p.select("doc_id", rerank.default_scorer(p).alias("orm_score"))


# attempts carry no patches: the number of added lines is the token count modulo 97, an empty patch where that is 0
_SCORED = f"WITH {V.ATTEMPTS}, a AS (SELECT *, CAST(n_tokens % 97 AS INTEGER) AS added FROM v_attempts), s AS (SELECT *, {_ORM.format(empty='added = 0', added='added')} AS orm_score FROM a), h AS (SELECT *, CASE WHEN tests_passed THEN 1.0 ELSE 0.0 END + orm_score AS hybrid FROM s)"


def _scored(spark, sf):
    return V.attempts(spark, sf).withColumn("added", (F.col("n_tokens") % 97).cast("int")).withColumn("empty_patch", F.col("added") == 0)


@query("hybrid_score", _SCORED + " SELECT instance_id, attempt, round(hybrid, 4) AS hybrid FROM h")
def hybrid_score(spark, sf):
    return rerank.score(_scored(spark, sf)).select("instance_id", "attempt", F.round("hybrid", 4).alias("hybrid"))


@query("rerank", _SCORED + " SELECT instance_id, attempt, CAST(row_number() OVER (PARTITION BY instance_id ORDER BY hybrid DESC, attempt) AS INTEGER) AS rank FROM h")
def rerank_attempts(spark, sf):
    return rerank.rerank(_scored(spark, sf)).select("instance_id", "attempt", "rank")


@query("select_best", _SCORED + " SELECT instance_id, attempt, round(hybrid, 4) AS hybrid, tests_passed FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY hybrid DESC, attempt) AS r FROM h) x WHERE r = 1")
def select_best(spark, sf):
    return rerank.select_best(_scored(spark, sf)).select("instance_id", "attempt", F.round("hybrid", 4).alias("hybrid"), "tests_passed")


@query("best_of_n_grid", f"WITH {V.ATTEMPTS} SELECT i.instance_id, g.attempt, a.attempt IS NULL AS crashed, coalesce(tests_passed, FALSE) AS tests_passed, coalesce(n_turns, 0) AS n_turns FROM (SELECT DISTINCT instance_id FROM v_attempts) i CROSS JOIN (SELECT CAST(unnest(range(1, {V.GRID} + 1)) AS INTEGER) AS attempt) g LEFT JOIN v_attempts a ON a.instance_id = i.instance_id AND a.attempt = g.attempt")
def best_of_n_grid(spark, sf):
    a = V.attempts(spark, sf)
    return rerank.grid(a.select("instance_id", "attempt", "tests_passed", "n_turns"), a.select("instance_id").distinct(), V.GRID).select("instance_id", "attempt", "crashed", "tests_passed", "n_turns")
