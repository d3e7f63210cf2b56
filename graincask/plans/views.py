"""Stand-in views of agent data over the test tables, as DataFrames and as DuckDB SQL (names are common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graincask.operators.curate import licence_of
from graincask.sources.tables import table

#: Repositories that evaluation sets use, by set.
EVAL_REPOS = {"primary": ("src0", "src1"), "verified": ("src1", "src2")}
#: Attempts that count as one grid.
GRID = 8


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("repo"), "lang", F.coalesce("text", F.lit("")).alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


FILES = "v_files AS (SELECT CAST(doc_id AS VARCHAR) AS path, source AS repo, lang, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents)"


def evals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("instance_id"), F.coalesce("text", F.lit("")).alias("problem_statement"))


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("instance_id"), F.col("source").alias("repo"), F.col("lang").alias("language"), "source", F.coalesce("text", F.lit("")).alias("problem_statement"))


TASKS = "v_tasks AS (SELECT doc_id AS instance_id, source AS repo, lang AS language, source, coalesce(text, '') AS problem_statement FROM documents)"


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, passed (null: not run), flaky of every document."""
    d, lb = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    return d.join(lb, "doc_id", "left").select("doc_id", (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("flaky"))


OUTCOMES = "v_outcomes AS (SELECT d.doc_id, quality = 1 AS passed, toxic = 1 AS flaky FROM documents d LEFT JOIN labels USING (doc_id))"


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "customer")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = li.select(
        F.col("l_orderkey").alias("instance_id"), F.row_number().over(w).alias("attempt"), (F.col("l_returnflag") == "R").alias("tests_passed"), F.floor("l_quantity").cast("int").alias("n_turns"),
        F.floor("l_extendedprice").cast("long").alias("n_tokens"), F.round(F.col("l_discount") * 5000).cast("long").alias("elapsed_s"))
    where = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("instance_id"), F.col("o_orderpriority").alias("repo"), F.col("c_mktsegment").alias("language"))
    return rows.join(where, "instance_id")


ATTEMPTS = """v_attempts AS (SELECT l_orderkey AS instance_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS attempt,
  l_returnflag = 'R' AS tests_passed, CAST(floor(l_quantity) AS INTEGER) AS n_turns, CAST(floor(l_extendedprice) AS BIGINT) AS n_tokens, CAST(round(l_discount * 5000) AS BIGINT) AS elapsed_s,
  o_orderpriority AS repo, c_mktsegment AS language FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """model (by parity of the attempt), instance_id, attempt, resolved of every attempt."""
    a = attempts(spark, sf)
    return a.select(F.when(F.col("attempt") % 2 == 1, "a").otherwise("b").alias("model"), "instance_id", "attempt", F.col("tests_passed").alias("resolved"), "n_turns", "n_tokens", "elapsed_s", "repo", "language")


RUNS = ATTEMPTS + ", v_runs AS (SELECT CASE WHEN attempt % 2 = 1 THEN 'a' ELSE 'b' END AS model, instance_id, attempt, tests_passed AS resolved, n_turns, n_tokens, elapsed_s, repo, language FROM v_attempts)"


def patches(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    return d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("+++ b/f\n+"), F.replace(text, F.lit("\n"), F.lit("\n+")))).alias("patch"), (F.col("doc_id") % 41).cast("int").alias("n_turns"))


PATCHES = "v_patches AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(10) ELSE '+++ b/f' || chr(10) || '+' || replace(coalesce(text, ''), chr(10), chr(10) || '+') END AS patch, CAST(doc_id % 41 AS INTEGER) AS n_turns FROM documents)"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations; each third assistant turn that ends one is followed by nothing, and a tool result stands for each assistant turn whose number is 3 modulo 4."""
    c = table(spark, sf, "conversations")
    tool = (F.col("role") == "assistant") & (F.col("turn") % 4 == 3)
    content = F.when(tool & (F.col("conv_id") % 3 == 0), "ALL TESTS PASSED.").when(tool & (F.col("conv_id") % 3 == 1), "TESTS FAILED (1 failing):\n  - a::b").when(tool, "EDIT OK (1 change(s)).\n").otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("instance_id"), "turn", F.when(tool, "tool").otherwise(F.col("role")).alias("role"), content.alias("content"),
        # which tool answered, and reasoning: a long assistant turn carries its first sentence as that
        F.when(tool & (F.col("conv_id") % 3 == 2), "search_replace").when(tool, F.when(F.col("conv_id") % 5 == 4, "read_file").otherwise("run_tests")).alias("tool"),
        F.when((F.col("role") == "assistant") & ~tool & (F.length("text") > 200), F.substring_index("text", ".", 1)).alias("reasoning_content"))


MESSAGES = """v_messages AS (SELECT conv_id AS instance_id, turn, CASE WHEN tool THEN 'tool' ELSE role END AS role,
  CASE WHEN tool AND conv_id % 3 = 0 THEN 'ALL TESTS PASSED.' WHEN tool AND conv_id % 3 = 1 THEN 'TESTS FAILED (1 failing):' || chr(10) || '  - a::b' WHEN tool THEN 'EDIT OK (1 change(s)).' || chr(10) ELSE text END AS content,
  CASE WHEN tool AND conv_id % 3 = 2 THEN 'search_replace' WHEN tool AND conv_id % 5 = 4 THEN 'read_file' WHEN tool THEN 'run_tests' END AS tool,
  CASE WHEN role = 'assistant' AND NOT tool AND length(text) > 200 THEN split_part(text, '.', 1) END AS reasoning_content
  FROM (SELECT *, role = 'assistant' AND turn % 4 = 3 AS tool FROM conversations) x)"""

# Which tool an event stands for, and the arguments that it carries.
_NAMES = {"view": "read_file", "click": "localize", "purchase": "search_replace", "signup": "run_tests", "error": "format_disk"}


def toolcalls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    name = F.lit(None).cast("string")
    for k, v in _NAMES.items():
        name = F.when(F.col("event_type") == k, v).otherwise(name)
    k = F.get_json_object("props", "$.k")
    args = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"path":"f'), k, F.lit('","start":'), k, F.lit("}")))
        .when(F.col("event_type") == "click", F.when(F.col("event_id") % 4 == 0, F.lit('{"top_k":3}')).otherwise(F.concat(F.lit('{"query":"q'), k, F.lit('"}'))))
        .when(F.col("event_type") == "purchase", F.lit('{"path":"a","find":"b","replace":"c"}')).when(F.col("event_type") == "signup", F.lit("")).otherwise(F.col("props"))
    )
    return e.select(F.col("event_id").alias("call_id"), F.col("user_id").alias("instance_id"), "ts", name.alias("name"), F.when((F.col("event_id") % 10 == 3) & (F.length(args) > 3), F.substring(args, F.lit(1), F.length(args) - 2)).otherwise(args).alias("arguments"))


TOOLCALLS = """v_calls0 AS (SELECT event_id AS call_id, user_id AS instance_id, ts, CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'localize' WHEN 'purchase' THEN 'search_replace' WHEN 'signup' THEN 'run_tests' WHEN 'error' THEN 'format_disk' END AS name,
  CASE event_type WHEN 'view' THEN '{"path":"f' || (props->>'$.k') || '","start":' || (props->>'$.k') || '}' WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN '{"top_k":3}' ELSE '{"query":"q' || (props->>'$.k') || '"}' END
    WHEN 'purchase' THEN '{"path":"a","find":"b","replace":"c"}' WHEN 'signup' THEN '' ELSE props END AS a FROM events),
v_calls AS (SELECT call_id, instance_id, ts, name, CASE WHEN call_id % 10 = 3 AND length(a) > 3 THEN substr(a, 1, length(a) - 2) ELSE a END AS arguments FROM v_calls0)"""


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """instance_id, returncode, stdout, stderr, timed_out: a log per user, of the events in order."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    s = i.cast("string")
    line = (
        F.when((F.col("event_type") == "error") & (i % 3 == 0), F.concat(F.lit("FAILED tests/test_"), (i % 40).cast("string"), F.lit(".py::t - x")))
        .when((F.col("event_type") == "error") & (i % 3 == 1), F.concat(F.lit("tests/test_"), (i % 40).cast("string"), F.lit(".py::t FAILED"))).when(F.col("event_type") == "error", F.concat(F.lit("ERROR: case_"), (i % 7).cast("string"), F.lit(" (m.C)")))
        .otherwise(F.concat(F.lit("ok "), s))
    )
    g = e.select("user_id", "event_id", line.alias("line"), F.col("event_type")).filter("user_id % 5 <> 0 OR event_type <> 'error'")
    out = g.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("stdout"), F.count_if(F.col("event_type") == "error").alias("n"))
    late = F.col("user_id") % 11 == 4
    return out.select(F.col("user_id").alias("instance_id"), F.when(late, 124).when(F.col("n") > 0, 1).otherwise(0).alias("returncode"), "stdout", F.lit("").alias("stderr"), late.alias("timed_out"))


LOGS = """v_lines AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'FAILED tests/test_' || (event_id % 40) || '.py::t - x' WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'tests/test_' || (event_id % 40) || '.py::t FAILED'
  WHEN event_type = 'error' THEN 'ERROR: case_' || (event_id % 7) || ' (m.C)' ELSE 'ok ' || event_id END AS line FROM events WHERE user_id % 5 <> 0 OR event_type <> 'error'),
v_logs AS (SELECT user_id AS instance_id, CASE WHEN user_id % 11 = 4 THEN 124 WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 1 ELSE 0 END AS returncode, string_agg(line, chr(10) ORDER BY event_id) AS stdout, '' AS stderr, user_id % 11 = 4 AS timed_out FROM v_lines GROUP BY user_id)"""
# failing ids: each pattern's matches in order, first occurrence kept
FAILED_IDS = """v_found AS (SELECT instance_id, p, unnest(m) AS id, generate_subscripts(m, 1) AS i FROM (
    SELECT instance_id, 1 AS p, regexp_extract_all(stdout || chr(10) || stderr, '(?m)^(?:FAILED|ERROR)\\s+(\\S+)', 1) AS m FROM v_logs WHERE NOT timed_out
    UNION ALL SELECT instance_id, 2, regexp_extract_all(stdout || chr(10) || stderr, '(?m)^(\\S+::\\S+)\\s+(?:FAILED|ERROR)', 1) FROM v_logs WHERE NOT timed_out
    UNION ALL SELECT instance_id, 3, regexp_extract_all(stdout || chr(10) || stderr, '(?m)^(?:FAIL|ERROR):\\s+(\\S+)', 1) FROM v_logs WHERE NOT timed_out) x),
v_failed AS (SELECT l.instance_id, l.returncode, l.stdout, l.stderr, l.timed_out, coalesce(f.ids, []) AS failed FROM v_logs l LEFT JOIN (
    SELECT instance_id, list(id ORDER BY p, i) AS ids FROM (SELECT instance_id, id, min(p * 1000000 + i) AS k, arg_min(p, p * 1000000 + i) AS p, arg_min(i, p * 1000000 + i) AS i FROM v_found GROUP BY instance_id, id) y GROUP BY instance_id) f USING (instance_id))"""


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """instance_id, teacher_license, passed, second_attempt, n_tokens, truncated, last_role."""
    m = messages(spark, sf).groupBy("instance_id").agg(F.sum(F.length("content")).alias("n_tokens"), F.max_by("role", "turn").alias("last_role"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("instance_id"), licence_of(F.col("text")).alias("teacher_license"))
    o = outcomes(spark, sf).select(F.col("doc_id").alias("instance_id"), "passed")
    return m.join(d, "instance_id", "left").join(o, "instance_id", "left").select(
        "instance_id", F.coalesce("teacher_license", F.lit("unknown")).alias("teacher_license"), "passed", (F.col("instance_id") % 5 == 0).alias("second_attempt"), "n_tokens", (F.col("last_role") == "user").alias("truncated"))


TRACES = MESSAGES + ", " + OUTCOMES + """, v_licence AS (SELECT doc_id AS instance_id, CASE WHEN contains(text, 'Apache License') THEN 'apache-2.0' WHEN contains(text, 'MIT License') THEN 'mit' WHEN contains(text, 'GNU General Public License') THEN 'gpl-3.0' WHEN contains(text, 'CC BY-NC') THEN 'cc-by-nc-4.0' ELSE 'unknown' END AS teacher_license FROM documents),
v_traces AS (SELECT m.instance_id, coalesce(teacher_license, 'unknown') AS teacher_license, passed, m.instance_id % 5 = 0 AS second_attempt, n_tokens, last_role = 'user' AS truncated
  FROM (SELECT instance_id, CAST(sum(length(content)) AS BIGINT) AS n_tokens, arg_max(role, turn) AS last_role FROM v_messages GROUP BY instance_id) m LEFT JOIN v_licence USING (instance_id) LEFT JOIN v_outcomes ON doc_id = m.instance_id)"""


def blocklist(spark: SparkSession) -> DataFrame:
    """Distinct repositories of all evaluation sets."""
    sets = [spark.createDataFrame([(r,) for r in rs], "repo string") for rs in EVAL_REPOS.values()]
    return sets[0].union(sets[1]).distinct()


BLOCKED = "v_blocked AS (SELECT 'src0' AS repo UNION SELECT 'src1' UNION SELECT 'src1' UNION SELECT 'src2')"

# A few datasets with licence, role and size class.
REGISTRY = (("instruct-a", "apache-2.0", "train", 80036), ("instruct-b", "cc-by-nc-4.0", "train", 34000), ("tasks-a", "mit", "train", 21000), ("eval-a", "mit", "eval", 731), ("eval-b", "apache-2.0", "eval", 300), ("tasks-old", "mit", "superseded", 2438))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "dataset string, license string, role string, n_rows int")


REGISTRY_SQL = "v_registry AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {n})" for a, b, c, n in REGISTRY) + ") t(dataset, license, role, n_rows))"
