"""Queries of data curation: decontamination, duplicates, licences, curriculum, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincask.catalog import query
from graincask.functions import text as T
from graincask.operators import curate
from graincask.plans import views as V
from graincask.sources.tables import table

SNAPSHOT = "snapshot-1"


@query("blocklist_union", f"WITH {V.BLOCKED} SELECT repo FROM v_blocked")
def blocklist_union(spark, sf):
    return V.blocklist(spark)


@query("decontam_repo", f"WITH {V.TASKS}, {V.BLOCKED} SELECT instance_id, repo FROM v_tasks WHERE repo NOT IN (SELECT repo FROM v_blocked)")
def decontam_repo(spark, sf):
    return curate.blocked_by_repo(V.tasks(spark, sf), V.blocklist(spark)).select("instance_id", "repo")


def _grams(source: str, key: str, text: str) -> str:
    return f"SELECT {key}, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM {source}) a WHERE len(w) >= 13) b"


_HITS = f"{V.TASKS}, {V.BLOCKED}, eg AS (SELECT DISTINCT g FROM ({_grams('benchmark', 'item_id', 'text')}) e), hits AS (SELECT DISTINCT instance_id FROM ({_grams('v_tasks', 'instance_id', 'problem_statement')}) t WHERE g IN (SELECT g FROM eg))"


@query("decontam_13gram", f"WITH {_HITS} SELECT instance_id FROM hits")
def decontam_13gram(spark, sf):
    return curate.gram_hits(V.tasks(spark, sf), V.evals(spark, sf))


def _judged(spark, sf):
    return curate.decontaminate(V.tasks(spark, sf), V.blocklist(spark), V.evals(spark, sf))


_JUDGED = f"WITH {_HITS}, judged AS (SELECT t.*, CASE WHEN t.repo IN (SELECT repo FROM v_blocked) THEN 'repo' WHEN t.instance_id IN (SELECT instance_id FROM hits) THEN 'ngram' ELSE 'keep' END AS reason FROM v_tasks t)"


@query("decontam_manifest", _JUDGED + f" SELECT source, count(*) AS n_in, count(*) FILTER (WHERE reason = 'repo') AS n_dropped_repo, count(*) FILTER (WHERE reason = 'ngram') AS n_dropped_ngram, count(*) FILTER (WHERE reason = 'keep') AS n_out, '{SNAPSHOT}' AS pro_verified_snapshot FROM judged GROUP BY source")
def decontam_manifest(spark, sf):
    return curate.manifest(_judged(spark, sf), SNAPSHOT)


@query("integrity_gate", f"WITH {_HITS}, kept AS (SELECT * FROM v_tasks t WHERE t.repo NOT IN (SELECT repo FROM v_blocked) AND t.instance_id NOT IN (SELECT instance_id FROM hits)) SELECT (SELECT count(*) FROM hits) AS n_overlap_before, (SELECT count(*) FROM kept JOIN hits USING (instance_id)) AS n_overlap_after, (SELECT count(*) FROM kept JOIN hits USING (instance_id)) = 0 AS ok")
def integrity_gate(spark, sf):
    """Any overlap of what is kept with the evaluation statements voids a number."""
    before = curate.gram_hits(V.tasks(spark, sf), V.evals(spark, sf)).agg(F.count(F.lit(1)).alias("n_overlap_before"))
    kept = _judged(spark, sf).filter("reason = 'keep'")
    after = curate.gram_hits(kept, V.evals(spark, sf)).agg(F.count(F.lit(1)).alias("n_overlap_after"))
    return before.crossJoin(after).withColumn("ok", F.col("n_overlap_after") == 0)  # one row each


@query("dedup_exact", "SELECT md5(coalesce(text, '')) AS digest, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1")
def dedup_exact(spark, sf):
    return curate.dedup_exact(table(spark, sf, "documents"))


_PARAMS = ", ".join(f"({k}, {a}::BIGINT, {b}::BIGINT)" for k, (a, b) in enumerate(curate.hash_parameters()))
_ROWS = curate.HASHES // curate.BANDS
_MINHASH = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5) x),
ids AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS set_id FROM s GROUP BY doc_id), reps AS MATERIALIZED (SELECT set_id, min(doc_id) AS doc_id FROM ids GROUP BY set_id),
rs AS MATERIALIZED (SELECT doc_id, g, ('0x' || substr(md5(g), 1, 7))::BIGINT AS h FROM s WHERE doc_id IN (SELECT doc_id FROM reps)), n AS (SELECT doc_id, count(*) AS n FROM rs GROUP BY doc_id),
sig AS (SELECT doc_id, k, min((a * h + b) % {curate.PRIME}) AS v FROM rs, (VALUES {_PARAMS}) p(k, a, b) GROUP BY doc_id, k),
bands AS (SELECT doc_id, k // {_ROWS} AS band, string_agg(v::VARCHAR, ',' ORDER BY k) AS value FROM sig GROUP BY 1, 2),
pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.value = y.value AND x.doc_id < y.doc_id),
o AS (SELECT a, b, count(*) AS shared FROM pairs JOIN rs x ON x.doc_id = a JOIN rs y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
links AS (SELECT a, b, round(shared / (p.n + q.n - shared), 6) AS jaccard FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= {curate.PERCENT} * (p.n + q.n - shared))"""


@query("minhash_pairs", _MINHASH + " SELECT a, b, jaccard FROM links")
def minhash_pairs(spark, sf):
    """Linked class representatives (see dedup_near for the members of classes)."""
    return curate.near_links(table(spark, sf, "documents"))


@query("dedup_near", _MINHASH + ", d AS (SELECT b, min(a) AS duplicate_of FROM links GROUP BY b) SELECT w.doc_id, coalesce(reps.doc_id, w.doc_id) AS class_id, duplicate_of FROM w LEFT JOIN ids USING (doc_id) LEFT JOIN reps USING (set_id) LEFT JOIN d ON d.b = coalesce(reps.doc_id, w.doc_id)")
def dedup_near(spark, sf):
    return curate.near_duplicates(table(spark, sf, "documents"))


@query("license_gate", f"WITH {V.TRACES} SELECT instance_id, teacher_license, teacher_license IN ('apache-2.0', 'mit') AS allowed FROM v_traces")
def license_gate(spark, sf):
    return V.traces(spark, sf).select("instance_id", "teacher_license", F.col("teacher_license").isin(*curate.PERMISSIVE).alias("allowed"))


@query("corpus_lang_quality", "SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') AND quality = 1")
def corpus_lang_quality(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf, "documents").filter(F.col("lang").isin("en", "de")).select("doc_id", "lang").join(good, "doc_id", "left_semi")


@query("eval_only_guard", f"WITH {V.REGISTRY_SQL}, n AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'instruct-a' WHEN doc_id % 6 = 1 THEN 'instruct-b' WHEN doc_id % 6 = 2 THEN 'tasks-a' WHEN doc_id % 6 = 3 THEN 'eval-a' WHEN doc_id % 6 = 4 THEN 'eval-b' ELSE 'tasks-old' END AS dataset FROM documents) SELECT doc_id, dataset FROM n WHERE dataset NOT IN (SELECT dataset FROM v_registry WHERE role = 'eval')")
def eval_only_guard(spark, sf):
    names = F.array(*[F.lit(r[0]) for r in V.REGISTRY])
    named = table(spark, sf, "documents").select("doc_id", F.get(names, F.when(F.col("doc_id") % 6 == 3, 3).when(F.col("doc_id") % 6 == 4, 4).otherwise((F.col("doc_id") % 6).cast("int"))).alias("dataset"))
    return named.join(V.registry(spark).filter("role = 'eval'"), "dataset", "left_anti").select("doc_id", "dataset")


@query("registry_filter", f"WITH {V.REGISTRY_SQL} SELECT dataset, CASE WHEN license IN ('apache-2.0', 'mit') THEN 'permissive' ELSE 'research' END AS class, n_rows FROM v_registry WHERE role = 'train'")
def registry_filter(spark, sf):
    r = V.registry(spark).filter("role = 'train'")
    return r.select("dataset", F.when(F.col("license").isin(*curate.PERMISSIVE), "permissive").otherwise("research").alias("class"), "n_rows")


@query("curriculum_bucket", "SELECT doc_id, CASE WHEN n_chars < 4096 THEN 1 WHEN n_chars <= 8192 THEN 2 WHEN n_chars <= 32768 THEN 3 ELSE 0 END AS stage FROM documents")
def curriculum_bucket(spark, sf):
    return table(spark, sf, "documents").select("doc_id", curate.curriculum(F.col("n_chars")).alias("stage"))


_H = "('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 7))::BIGINT"


@query("short_replay", f"SELECT doc_id, 3 AS stage, n_chars < 4096 AS replayed FROM documents WHERE n_chars > 8192 AND n_chars <= 32768 OR n_chars < 4096 AND {_H.format(k='doc_id')} % 100 < 10")
def short_replay(spark, sf):
    d = table(spark, sf, "documents")
    stage = curate.curriculum(F.col("n_chars"))
    replay = (stage == 1) & (T.md5_number(F.col("doc_id").cast("string")) % 100 < 10)
    return d.filter((stage == 3) | replay).select("doc_id", F.lit(3).alias("stage"), (stage == 1).alias("replayed"))


@query("aux_cap", f"WITH {V.TRACES}, r AS (SELECT instance_id, second_attempt, row_number() OVER (PARTITION BY second_attempt ORDER BY {_H.format(k='instance_id')}, instance_id) AS r FROM v_traces) SELECT instance_id, second_attempt FROM r WHERE NOT second_attempt OR r <= (SELECT floor(count(*) * 0.1) FROM v_traces WHERE NOT second_attempt)")
def aux_cap(spark, sf):
    """A tenth of the main rows at most."""
    return curate.capped(V.traces(spark, sf).select("instance_id", "second_attempt"), F.col("second_attempt"), "instance_id", 0.1)


@query("mix_sources", f"SELECT CAST(doc_id AS VARCHAR) AS id, 'primary' AS part FROM documents WHERE lang = 'en' UNION ALL SELECT CAST(doc_id AS VARCHAR), 'auxiliary' FROM documents WHERE lang <> 'en' AND {_H.format(k='doc_id')} % 4 = 0 UNION ALL SELECT 'c' || conv_id, 'replay' FROM (SELECT DISTINCT conv_id FROM conversations) c WHERE {_H.format(k='conv_id')} % 2 = 0")
def mix_sources(spark, sf):
    d = table(spark, sf, "documents")
    key = F.col("doc_id").cast("string")
    main = d.filter("lang = 'en'").select(key.alias("id"), F.lit("primary").alias("part"))
    aux = d.filter((F.col("lang") != "en") & (T.md5_number(key) % 4 == 0)).select(key.alias("id"), F.lit("auxiliary").alias("part"))
    chats = table(spark, sf, "conversations").select("conv_id").distinct().filter(T.md5_number(F.col("conv_id").cast("string")) % 2 == 0)
    return main.unionByName(aux).unionByName(chats.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.lit("replay").alias("part")))


@query("fim_split", """WITH c AS (SELECT doc_id, coalesce(text, '') AS t, ('0x' || substr(md5(doc_id || ':a'), 1, 7))::BIGINT % (length(coalesce(text, '')) + 1) AS p, ('0x' || substr(md5(doc_id || ':b'), 1, 7))::BIGINT % (length(coalesce(text, '')) + 1) AS q FROM documents)
SELECT doc_id, CAST(least(p, q) AS INTEGER) AS n_prefix, CAST(greatest(p, q) - least(p, q) AS INTEGER) AS n_middle, md5(substr(t, 1, least(p, q))) AS prefix_md5, md5(substr(t, least(p, q) + 1, greatest(p, q) - least(p, q))) AS middle_md5, md5(substr(t, greatest(p, q) + 1)) AS suffix_md5 FROM c""")
def fim_split(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", curate.fim(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("f"))
    return r.select("doc_id", F.length("f.prefix").alias("n_prefix"), F.length("f.middle").alias("n_middle"), F.md5("f.prefix").alias("prefix_md5"), F.md5("f.middle").alias("middle_md5"), F.md5("f.suffix").alias("suffix_md5"))


@query("calibration_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) x WHERE r <= 512")
def calibration_sample(spark, sf):
    """512 rows by hash: the sample's size is the feature."""
    key = F.md5(F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id").orderBy(key, "doc_id").limit(512)


@query("length_cap", "SELECT doc_id, length(substr(coalesce(text, ''), 1, 4096)) AS n_kept, length(coalesce(text, '')) > 4096 AS truncated FROM documents")
def length_cap(spark, sf):
    """Texts cut at the speculator's 4,096: the cap is the feature."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.length(F.substring(text, 1, 4096)).cast("long").alias("n_kept"), (F.length(text) > 4096).alias("truncated"))
