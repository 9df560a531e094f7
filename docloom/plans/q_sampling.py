"""Queries on quotas and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import sampling as S
from docloom.plans.registry import query

_ST = "st AS (SELECT ctype AS stratum, count(*) AS size FROM fx_files WHERE status = 'ok' GROUP BY 1)"
_PROJ = "folder || ':' || (doc_id % 25)"


def _strata(c):
    return c.files.filter("status = 'ok'").groupBy(F.col("ctype").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))


def _project():
    return F.concat("folder", F.lit(":"), (F.col("doc_id") % 25).cast("string"))


@query("proportional_quotas", f"WITH {_ST}, s AS (SELECT *, size * 101.0::DOUBLE / (SELECT sum(size) FROM st) AS share FROM st), r AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, stratum) AS k, 101 - sum(floor(share)) OVER () AS left_over FROM s) SELECT stratum, size, (floor(share) + CASE WHEN k <= left_over THEN 1 ELSE 0 END)::BIGINT AS quota FROM r")
def proportional_quotas(c):
    return S.largest_remainder(_strata(c), 101)


@query("half_quotas", f"WITH {_ST} SELECT stratum, size, ceil(size / 2)::BIGINT AS quota FROM st")
def half_quotas(c):
    return S.half_quotas(_strata(c))


@query("balanced_quotas", f"WITH {_ST}, x AS (SELECT stratum, unnest(range(1, size + 1)) AS k FROM st), t AS (SELECT stratum FROM x ORDER BY k, stratum LIMIT 700) SELECT stratum, size, count(t.stratum)::BIGINT AS quota FROM st LEFT JOIN t USING (stratum) GROUP BY ALL")
def balanced_quotas(c):
    return S.balanced_quotas(_strata(c), 700)


@query("round_robin_sample", f"WITH f AS (SELECT file_key, ctype AS stratum, {_PROJ} AS project FROM fx_files WHERE status = 'ok'), d AS (SELECT *, row_number() OVER (PARTITION BY stratum, project ORDER BY file_key) AS depth FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY depth, sha1(project), file_key) AS place FROM d) SELECT file_key, stratum, depth::INTEGER AS depth, place::INTEGER AS place FROM p WHERE place <= 20")
def round_robin_sample(c):
    quotas = _strata(c).select("stratum", F.lit(20).alias("quota"))
    return S.round_robin(c.files.filter("status = 'ok'"), F.col("ctype"), _project(), quotas, [F.col("file_key")]).select("file_key", "stratum", "depth", "place")


@query("diverse_sample", "WITH f AS (SELECT file_key, ctype, lang, coalesce(version_confidence, 'none') AS vc FROM fx_files WHERE status = 'ok'), n AS (SELECT *, row_number() OVER (PARTITION BY ctype, vc, lang ORDER BY file_key) AS n FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY ctype ORDER BY n, vc, lang, file_key) AS place FROM n), s AS (SELECT *, CASE WHEN place <= 2 THEN 0 ELSE floor((place - 3) / CASE ctype WHEN 'SPA' THEN 3 ELSE 1 END) + 1 END AS slot FROM p) SELECT file_key, ctype, slot::INTEGER AS slot, place::INTEGER AS place FROM s ORDER BY slot, ctype, place LIMIT 60")
def diverse_sample(c):
    rows = c.files.filter("status = 'ok'").select("file_key", "ctype", "lang", F.coalesce("version_confidence", F.lit("none")).alias("vc"))
    return S.diverse_round_robin(rows, "ctype", ["vc", "lang"], [F.col("file_key")], weights={"SPA": 3}, total=60).select("file_key", "ctype", "slot", "place")


@query("stratified_take", f"WITH {_ST}, b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY CASE stratum WHEN 'SHA' THEN 1 WHEN 'SPA' THEN 2 ELSE 3 END, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st) SELECT stratum, size, greatest(least(size, 500 - before), 0)::BIGINT AS take FROM b WHERE least(size, 500 - before) > 0")
def stratified_take(c):
    rank = F.when(F.col("stratum") == "SHA", 1).when(F.col("stratum") == "SPA", 2).otherwise(3)
    return S.take_until(_strata(c), 500, [rank, F.col("stratum")])


@query("project_sample", f"""WITH f AS (SELECT file_key, ctype, is_draft, {_PROJ} AS project, CASE WHEN contains(lower(filename), 'signed') THEN 1 ELSE 0 END AS score FROM fx_files WHERE status = 'ok'), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ctype, project ORDER BY score DESC, file_key) AS r FROM f) WHERE r = 1),
 t AS (SELECT *, CASE WHEN is_draft = 0 THEN 0 WHEN is_draft = 1 THEN 1 ELSE 2 END AS turn FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY ctype, turn ORDER BY score DESC, sha1(project), file_key) AS n FROM t) SELECT file_key, ctype, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY ctype ORDER BY n, turn) AS place FROM n) WHERE place <= 15""")
def project_sample(c):
    score = F.when(F.contains(F.lower("filename"), F.lit("signed")), 1).otherwise(0)
    return S.one_per_project(c.files.filter("status = 'ok'"), _project(), score, [0, 1, None], 15, "ctype").select("file_key", "ctype", "place")


@query("complement_selection", "SELECT file_key, ctype FROM fx_files WHERE status = 'ok' AND file_key NOT IN (SELECT file_key FROM fx_files ORDER BY md5('seed-1' || file_key), file_key LIMIT 300)")
def complement_selection(c):
    from docloom.operators.catalog import hash_sample

    earlier = hash_sample(c.files.select("file_key"), "file_key", 300, "seed-1")
    return c.files.filter("status = 'ok'").join(earlier, "file_key", "left_anti").select("file_key", "ctype")


@query("never_covered", "SELECT f.file_key FROM fx_files f WHERE status = 'ok' AND EXISTS (SELECT 1 FROM fx_doc_meta m WHERE m.file_key = f.file_key AND m.txt_hash = f.content_hash) AND NOT EXISTS (SELECT 1 FROM fx_document_coverage d WHERE d.file_key = f.file_key AND d.body_status = 'complete' AND d.family = 'RW')")
def never_covered(c):
    current = c.doc_meta.select("file_key", F.col("txt_hash").alias("content_hash"))
    done = c.document_coverage.filter("body_status = 'complete' and family = 'RW'")
    return c.files.filter("status = 'ok'").join(current, ["file_key", "content_hash"], "left_semi").join(done, "file_key", "left_anti").select("file_key")


@query("recent_searches", "SELECT id, kw, result_count FROM (SELECT *, row_number() OVER (PARTITION BY kw, result_count ORDER BY id DESC) AS r FROM (SELECT * FROM fx_query_log ORDER BY id DESC LIMIT 100)) WHERE r = 1 ORDER BY id DESC LIMIT 30")
def recent_searches(c):
    return S.recent_distinct(c.query_log, ["kw", "result_count"], 100, 30)


@query("work_manifest", "SELECT f.ctype, f.lang, coalesce(f.is_draft, -1) AS draft, coalesce(m.confidence, 'none') AS prior, count(*)::BIGINT AS n FROM fx_files f LEFT JOIN fx_doc_meta m USING (file_key) WHERE f.status = 'ok' AND f.dup_group = f.file_key GROUP BY ALL")
def work_manifest(c):
    rows = c.files.filter("status = 'ok' and dup_group = file_key").join(c.doc_meta.select("file_key", "confidence"), "file_key", "left")
    return rows.groupBy("ctype", "lang", F.coalesce("is_draft", F.lit(-1)).alias("draft"), F.coalesce("confidence", F.lit("none")).alias("prior")).agg(F.count(F.lit(1)).alias("n"))
