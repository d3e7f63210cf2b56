"""Queries of rewards, difficulty and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graincask.catalog import query
from graincask.operators import evaluation, rewards, trajectory
from graincask.plans import views as V
from graincask.sources.tables import table

A = f"WITH {V.ATTEMPTS}"
R = f"WITH {V.RUNS}"
LAMBDAS = (0.0, 1e-6, 5e-6)


@query("reward", A + " SELECT instance_id, attempt, CASE WHEN tests_passed AND elapsed_s <= 300 THEN 1.0 ELSE 0.0 END AS reward FROM v_attempts")
def reward(spark, sf):
    return V.attempts(spark, sf).select("instance_id", "attempt", rewards.reward(F.col("tests_passed"), F.col("elapsed_s"), F.col("n_tokens"), F.lit(0.0)).alias("reward"))


@query("reward_sweep", A + f", s AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in LAMBDAS)}]) AS weight) SELECT weight, count(*) AS n, round(avg(CASE WHEN tests_passed AND elapsed_s <= 300 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - weight * n_tokens), 6) AS mean_reward FROM v_attempts, s GROUP BY weight")
def reward_sweep(spark, sf):
    weights = F.explode(F.array(*map(F.lit, LAMBDAS))).alias("weight")
    each = V.attempts(spark, sf).select("tests_passed", "elapsed_s", "n_tokens", weights)
    return each.groupBy("weight").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(rewards.reward(F.col("tests_passed"), F.col("elapsed_s"), F.col("n_tokens"), F.col("weight"))), 6).alias("mean_reward"))


@query("grpo_advantage", A + ", r AS (SELECT instance_id, attempt, CASE WHEN tests_passed AND elapsed_s <= 300 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM v_attempts), w AS (SELECT *, avg(r) OVER (PARTITION BY instance_id) AS m, stddev_pop(r) OVER (PARTITION BY instance_id) AS s FROM r) SELECT instance_id, attempt, round(CASE WHEN s > 0 THEN (r - m) / s ELSE 0.0 END, 6) AS advantage FROM w")
def grpo_advantage(spark, sf):
    return rewards.advantages(reward(spark, sf)).select("instance_id", "attempt", F.round("advantage", 6).alias("advantage"))


@query("difficulty_filter", A + " SELECT instance_id, n, round(p / n, 6) AS pass_rate FROM (SELECT instance_id, count(*) AS n, sum(CAST(tests_passed AS INTEGER)) AS p FROM v_attempts GROUP BY 1) x WHERE p > 0 AND p < n")
def difficulty_filter(spark, sf):
    return rewards.learnable(rewards.pass_rates(V.attempts(spark, sf))).select("instance_id", "n", F.round("pass_rate", 6).alias("pass_rate"))


@query("solve_none_rate", A + " SELECT count(*) AS n_tasks, count(*) FILTER (WHERE p = 0) AS n_none, round(avg(CAST(p = 0 AS INTEGER)), 6) AS solve_none_rate FROM (SELECT instance_id, sum(CAST(tests_passed AS INTEGER)) AS p FROM v_attempts GROUP BY 1) x")
def solve_none_rate(spark, sf):
    none = F.col("n_passed") == 0
    return rewards.pass_rates(V.attempts(spark, sf)).agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(none).alias("n_none"), evaluation.rate(none).alias("solve_none_rate"))


@query("bon_yield", A + " SELECT repo, count(*) AS n_tasks, count(*) FILTER (WHERE ok) AS n_usable, round(avg(CAST(ok AS INTEGER)), 6) AS yield FROM (SELECT repo, instance_id, bool_or(tests_passed) AS ok FROM v_attempts GROUP BY 1, 2) x GROUP BY repo")
def bon_yield(spark, sf):
    each = V.attempts(spark, sf).groupBy("repo", "instance_id").agg(F.bool_or("tests_passed").alias("ok"))
    return each.groupBy("repo").agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if("ok").alias("n_usable"), evaluation.rate(F.col("ok")).alias("yield"))


@query("new_successes", A + ", p AS (SELECT DISTINCT instance_id FROM v_attempts WHERE tests_passed) SELECT instance_id, instance_id % 2 = 0 AS known FROM p UNION SELECT instance_id, TRUE FROM (SELECT DISTINCT instance_id FROM v_attempts WHERE instance_id % 2 = 0) k")
def new_successes(spark, sf):
    """The known pool with the tasks that are newly solved."""
    a = V.attempts(spark, sf)
    known = a.filter("instance_id % 2 = 0").select("instance_id").distinct()
    fresh = a.filter("tests_passed").select("instance_id").distinct().join(known, "instance_id", "left_anti")
    return known.withColumn("known", F.lit(True)).unionByName(fresh.withColumn("known", F.lit(False)))


@query("rollout_caps", A + " SELECT instance_id, attempt, n_tokens > 64000 OR n_turns > 40 AS truncated FROM v_attempts")
def rollout_caps(spark, sf):
    return V.attempts(spark, sf).select("instance_id", "attempt", ((F.col("n_tokens") > rewards.CONTEXT_CAP) | (F.col("n_turns") > 40)).alias("truncated"))


@query("f2p_p2p_gate", A + ", t AS (SELECT instance_id, list(attempt ORDER BY attempt) FILTER (WHERE attempt <= 2) AS required, list(attempt) FILTER (WHERE tests_passed) AS passed FROM v_attempts GROUP BY 1) SELECT instance_id, CAST(len(coalesce(required, [])) AS INTEGER) AS n_required, list_has_all(coalesce(passed, []), coalesce(required, [])) AS ok FROM t")
def f2p_p2p_gate(spark, sf):
    """Required tests (attempts 1 and 2 stand for them) against those that passed."""
    t = V.attempts(spark, sf).groupBy("instance_id").agg(F.collect_set(F.when(F.col("attempt") <= 2, F.col("attempt"))).alias("required"), F.collect_set(F.when(F.col("tests_passed"), F.col("attempt"))).alias("passed"))
    return t.select("instance_id", F.size("required").alias("n_required"), (F.size(F.array_except("required", "passed")) == 0).alias("ok"))


# --- evaluation


@query("resolve_rate", A + " SELECT count(*) AS n, round(avg(CAST(first_ok AS INTEGER)), 6) AS pass_at_1, round(avg(CAST(any_ok AS INTEGER)), 6) AS best_of_n FROM (SELECT instance_id, bool_or(tests_passed) FILTER (WHERE attempt = 1) AS first_ok, bool_or(tests_passed) AS any_ok FROM v_attempts GROUP BY 1) x")
def resolve_rate(spark, sf):
    each = V.attempts(spark, sf).groupBy("instance_id").agg(F.bool_or((F.col("attempt") == 1) & F.col("tests_passed")).alias("first_ok"), F.bool_or("tests_passed").alias("any_ok"))
    return each.agg(F.count(F.lit(1)).alias("n"), evaluation.rate(F.col("first_ok")).alias("pass_at_1"), evaluation.rate(F.col("any_ok")).alias("best_of_n"))


@query("report_grouping_sets", A + ", g AS (SELECT repo, language, grouping(repo) AS gr, grouping(language) AS gl, count(*) AS n, CAST(sum(CAST(tests_passed AS INTEGER)) AS BIGINT) AS n_resolved FROM v_attempts GROUP BY GROUPING SETS ((repo), (language), ())) SELECT CASE WHEN gr = 0 THEN 'repo' WHEN gl = 0 THEN 'language' ELSE 'all' END AS level, CASE WHEN gr = 0 THEN repo WHEN gl = 0 THEN language ELSE '' END AS value, n, n_resolved, round(n_resolved / n, 6) AS resolve_rate FROM g")
def report_grouping_sets(spark, sf):
    return evaluation.breakdown(V.attempts(spark, sf), F.col("tests_passed"), "repo", "language")


@query("latency_percentiles", A + ", t AS (SELECT repo, n_tokens / greatest(elapsed_s, 1) AS v FROM v_attempts) SELECT repo, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95, round(avg(v), 4) AS mean FROM t GROUP BY repo")
def latency_percentiles(spark, sf):
    t = V.attempts(spark, sf).select("repo", (F.col("n_tokens") / F.greatest("elapsed_s", F.lit(1))).alias("v"))
    return evaluation.percentiles(t, "repo", "v", {"p50": 0.5, "p95": 0.95}).select("repo", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "mean")])


_TWO = "a AS (SELECT instance_id, resolved AS ra FROM v_runs WHERE attempt = 1), b AS (SELECT instance_id, resolved AS rb FROM v_runs WHERE attempt = 2)"


def _two(spark, sf):
    """The run that each model submits for an instance: its first attempt."""
    r = V.runs(spark, sf)
    return r.filter("attempt = 1"), r.filter("attempt = 2")


@query("baseline_compare", R + f", {_TWO} SELECT coalesce(a.instance_id, b.instance_id) AS instance_id, CASE WHEN coalesce(ra, FALSE) AND coalesce(rb, FALSE) THEN 'both' WHEN coalesce(ra, FALSE) THEN 'a_only' WHEN coalesce(rb, FALSE) THEN 'b_only' ELSE 'neither' END AS outcome FROM a FULL JOIN b ON a.instance_id = b.instance_id")
def baseline_compare(spark, sf):
    return evaluation.compare(*_two(spark, sf)).select("instance_id", "outcome")


@query("quant_gap", R + f", {_TWO} SELECT count(*) AS n, round(avg(CAST(ra AS INTEGER)), 6) AS rate_a, round(avg(CAST(rb AS INTEGER)), 6) AS rate_b, round(avg(CAST(ra AS INTEGER)) - avg(CAST(rb AS INTEGER)), 6) AS gap FROM a JOIN b USING (instance_id)")
def quant_gap(spark, sf):
    return evaluation.gap(*_two(spark, sf))


@query("budget_compliance", R + " SELECT model, count(*) AS n, round(avg(CAST(n_turns <= 40 AS INTEGER)), 6) AS within_budget, round(avg(CAST(resolved AND n_turns <= 40 AS INTEGER)), 6) AS resolve_rate FROM v_runs GROUP BY model")
def budget_compliance(spark, sf):
    """Attempts over the budget of turns count as unresolved."""
    ok = F.col("n_turns") <= 40
    return V.runs(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"), evaluation.rate(ok).alias("within_budget"), evaluation.rate(F.col("resolved") & ok).alias("resolve_rate"))


@query("eval_report", R + " SELECT model, count(*) AS n, round(avg(CAST(resolved AS INTEGER)), 6) AS resolve_rate, round(avg(CAST(n_tokens % 97 = 0 AS INTEGER)), 6) AS empty_patch_rate, round(avg(n_turns), 4) AS mean_turns, round(sum(n_tokens) / sum(greatest(elapsed_s, 1)), 4) AS tokens_per_s FROM v_runs GROUP BY model")
def eval_report(spark, sf):
    return V.runs(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), evaluation.rate(F.col("resolved")).alias("resolve_rate"), evaluation.rate(F.col("n_tokens") % 97 == 0).alias("empty_patch_rate"),
        F.round(F.avg("n_turns"), 4).alias("mean_turns"), F.round(F.sum("n_tokens") / F.sum(F.greatest("elapsed_s", F.lit(1))), 4).alias("tokens_per_s"))


@query("score_predictions", R + ", p AS (SELECT instance_id FROM v_runs WHERE attempt = 1), t AS (SELECT instance_id, resolved FROM v_runs WHERE attempt = 1 AND instance_id % 9 <> 0) SELECT p.instance_id, coalesce(resolved, FALSE) AS resolved, t.instance_id IS NULL AS missing_report FROM p LEFT JOIN t ON p.instance_id = t.instance_id")
def score_predictions(spark, sf):
    """A prediction without a report is unresolved."""
    p, _ = _two(spark, sf)
    report = p.filter("instance_id % 9 <> 0").select("instance_id", F.col("resolved").alias("r"))
    return p.select("instance_id").join(report, "instance_id", "left").select("instance_id", F.coalesce("r", F.lit(False)).alias("resolved"), F.col("r").isNull().alias("missing_report"))


@query("checkpoint_delta", A + ", c AS (SELECT attempt AS checkpoint, avg(CAST(tests_passed AS INTEGER)) AS r FROM v_attempts GROUP BY 1) SELECT checkpoint, round(r, 6) AS resolve_rate, round(r - lag(r) OVER (ORDER BY checkpoint), 6) AS delta FROM c")
def checkpoint_delta(spark, sf):
    """Attempt numbers stand for checkpoints; a row each is ordered."""
    r = V.attempts(spark, sf).groupBy(F.col("attempt").alias("checkpoint")).agg(F.avg(F.col("tests_passed").cast("int")).alias("r"))
    return r.select("checkpoint", F.round("r", 6).alias("resolve_rate"), F.round(F.col("r") - F.lag("r").over(W.orderBy("checkpoint")), 6).alias("delta"))


@query("acceptance_rate", A + " SELECT language, CAST(sum(n_turns) AS BIGINT) AS accepted, CAST(sum(n_turns + attempt) AS BIGINT) AS drafted, round(sum(n_turns) / sum(n_turns + attempt), 6) AS acceptance FROM v_attempts GROUP BY language")
def acceptance_rate(spark, sf):
    a = V.attempts(spark, sf).groupBy("language").agg(F.sum("n_turns").alias("accepted"), F.sum(F.col("n_turns") + F.col("attempt")).alias("drafted"))
    return a.withColumn("acceptance", F.round(F.try_divide("accepted", "drafted"), 6))


@query("reasoning_share", f"WITH {V.MESSAGES} SELECT count(*) AS n, round(avg(CAST(r AS INTEGER)), 6) AS share, avg(CAST(r AS INTEGER)) >= 0.75 AS ok FROM (SELECT instance_id, bool_or(role = 'assistant' AND coalesce(reasoning_content, '') <> '') AS r FROM v_messages GROUP BY 1) x")
def reasoning_share(spark, sf):
    each = trajectory.reasoning_style(V.messages(spark, sf)).withColumnRenamed("reasoned", "r")
    return each.agg(F.count(F.lit(1)).alias("n"), evaluation.rate(F.col("r")).alias("share"), (F.avg(F.col("r").cast("int")) >= 0.75).alias("ok"))


@query("decision_gate", R + f", {_TWO}, g AS (SELECT avg(CAST(ra AS INTEGER)) AS x, avg(CAST(rb AS INTEGER)) AS y FROM a JOIN b USING (instance_id)) SELECT 'lift' AS gate, round(y - x, 6) AS value, y - x > 0 AS ok FROM g UNION ALL SELECT 'gap', round(abs(x - y), 6), abs(x - y) <= 0.02 FROM g")
def decision_gate(spark, sf):
    """Lift of the second run over the first, and their gap within 2 points."""
    a, b = _two(spark, sf)
    g = a.select("instance_id", F.col("resolved").alias("ra")).join(b.select("instance_id", F.col("resolved").alias("rb")), "instance_id").agg(F.avg(F.col("ra").cast("int")).alias("x"), F.avg(F.col("rb").cast("int")).alias("y"))
    lift, gap = F.col("y") - F.col("x"), F.abs(F.col("x") - F.col("y"))
    rows = F.explode(F.array(F.struct(F.lit("lift").alias("gate"), F.round(lift, 6).alias("value"), (lift > 0).alias("ok")), F.struct(F.lit("gap").alias("gate"), F.round(gap, 6).alias("value"), (gap <= 0.02).alias("ok"))))
    return g.select(rows.alias("r")).select("r.*")


_VALID = "count(*) FILTER (WHERE json_valid(coalesce(nullif(arguments, ''), '{}')))"


@query("validity_by_checkpoint", f"WITH {V.TOOLCALLS} SELECT CAST(call_id % 3 AS INTEGER) AS checkpoint, count(*) AS n_calls, {_VALID} AS n_parsed, round({_VALID} / count(*), 6) AS parse_rate FROM v_calls GROUP BY 1")
def validity_by_checkpoint(spark, sf):
    ok = trajectory.parses(F.col("arguments"))
    return V.toolcalls(spark, sf).groupBy((F.col("call_id") % 3).cast("int").alias("checkpoint")).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(ok).alias("n_parsed"), F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("parse_rate"))


@query("template_consistency", "SELECT conv_id % 10 AS run, count(DISTINCT template) AS n_templates, count(DISTINCT template) = 1 AS ok FROM (SELECT conv_id, CASE WHEN conv_id % 30 = 7 THEN 'chatml-2' ELSE 'chatml' END AS template FROM conversations) x GROUP BY 1")
def template_consistency(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.when(F.col("conv_id") % 30 == 7, "chatml-2").otherwise("chatml").alias("template"))
    return c.groupBy((F.col("conv_id") % 10).alias("run")).agg(F.countDistinct("template").alias("n_templates"), (F.countDistinct("template") == 1).alias("ok"))
