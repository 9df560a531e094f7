"""Bundles that answer one user question from several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import search as S
from docloom.operators import stats as ST
from docloom.operators import structure
from docloom.plans.registry import query

_TARGET = "tgt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dup_group ORDER BY ctype, lang, file_key) AS r FROM fx_files WHERE status = 'ok' AND char_count > 0 AND ctype IN ('SPA','SHA','SSA')) WHERE r = 1)"


@query("inspect_files", "WITH e AS (SELECT file_key, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS canonicals FROM fx_paragraphs JOIN fx_term ON contains(lower(content), lower(variant)) GROUP BY 1), g AS (SELECT dup_group, count(*)::BIGINT AS members FROM fx_files GROUP BY 1) SELECT f.file_key, f.filename, f.ctype, members, coalesce(m.confidence, 'unevaluated') AS metadata, m.txt_hash = f.content_hash AS metadata_current, coalesce(canonicals, '') AS canonicals FROM fx_files f JOIN g USING (dup_group) LEFT JOIN fx_doc_meta m ON m.file_key = f.file_key LEFT JOIN e ON e.file_key = f.file_key")
def inspect_files(c):
    members = c.files.groupBy("dup_group").agg(F.count(F.lit(1)).alias("members"))
    meta = c.doc_meta.select("file_key", "confidence", "txt_hash")
    rows = c.files.join(members, "dup_group").join(meta, "file_key", "left").join(S.matched_entries(c.paragraphs, c.terms), "file_key", "left")
    return rows.select("file_key", "filename", "ctype", "members", F.coalesce("confidence", F.lit("unevaluated")).alias("metadata"), (F.col("txt_hash") == F.col("content_hash")).alias("metadata_current"), F.coalesce("canonicals", F.lit("")).alias("canonicals"))


@query("statistics_bundle", "SELECT 'status' AS section, status AS name, count(*)::BIGINT AS n FROM fx_files GROUP BY status UNION ALL SELECT 'type', ctype, count(*) FROM fx_files WHERE status = 'ok' GROUP BY ctype UNION ALL SELECT 'groups', CASE WHEN n > 1 THEN 'repeated' ELSE 'single' END, count(*) FROM (SELECT count(*) AS n FROM fx_files GROUP BY dup_group) GROUP BY 2")
def statistics_bundle(c):
    f, n = c.files, F.count(F.lit(1)).alias("n")
    groups = f.groupBy("dup_group").agg(n).groupBy(F.when(F.col("n") > 1, "repeated").otherwise("single").alias("name")).agg(n)
    parts = [f.groupBy(F.col("status").alias("name")).agg(n).withColumn("section", F.lit("status")), f.filter("status = 'ok'").groupBy(F.col("ctype").alias("name")).agg(n).withColumn("section", F.lit("type")), groups.withColumn("section", F.lit("groups"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("progress_bundle", f"WITH {_TARGET}, e AS (SELECT DISTINCT file_key, family FROM fx_document_coverage WHERE body_status = 'complete') SELECT ctype, family, count(*)::BIGINT AS targets, count(e.file_key)::BIGINT AS complete FROM tgt CROSS JOIN fx_family g LEFT JOIN e USING (file_key, family) GROUP BY ALL")
def progress_bundle(c):
    targets = ST.target_population(c.files, ["SPA", "SHA", "SSA"]).select("file_key", "ctype")
    done = c.document_coverage.filter("body_status = 'complete'").select("file_key", "family").distinct().withColumn("_d", F.lit(1))
    rows = targets.crossJoin(F.broadcast(c.families.select("family"))).join(done, ["file_key", "family"], "left")
    return rows.groupBy("ctype", "family").agg(F.count(F.lit(1)).alias("targets"), F.count("_d").alias("complete"))


@query("verification_cards", "WITH pool AS (SELECT DISTINCT file_key FROM fx_clause_item WHERE family = 'RW' UNION SELECT DISTINCT file_key FROM fx_paragraphs WHERE contains(lower(content), 'there')), k AS (SELECT file_key, min(para) AS para, min_by(content, para) AS content FROM fx_paragraphs WHERE contains(lower(content), 'there') GROUP BY 1) SELECT p.file_key, k.para, CASE WHEN k.file_key IS NULL THEN 'unclear' WHEN regexp_matches(k.content, '\\.{3,}') THEN 'unclear' ELSE 'likely_correct' END AS auto_verdict FROM pool p LEFT JOIN k USING (file_key) WHERE p.file_key NOT IN (SELECT file_key FROM fx_verdict)")
def verification_cards(c):
    """Unjudged results of two arms with the first evidence and a careful automatic verdict."""
    hit = c.paragraphs.filter(F.contains(F.lower("content"), F.lit("there")))
    pool = c.items.filter("family = 'RW'").select("file_key").union(hit.select("file_key")).distinct().join(c.verdicts, "file_key", "left_anti")
    first = hit.groupBy("file_key").agg(F.min("para").alias("para"), F.min_by("content", "para").alias("content"))
    verdict = F.when(F.col("para").isNull() | F.col("content").rlike(r"\.{3,}"), "unclear").otherwise("likely_correct")
    return pool.join(first, "file_key", "left").select("file_key", "para", verdict.alias("auto_verdict"))


@query("margins_and_body", "SELECT file_key, count(*) FILTER (regexp_matches(content, '^\\[(header|footer)\\]'))::BIGINT AS margins, count(*)::BIGINT AS paragraphs FROM fx_paragraphs GROUP BY 1")
def margins_and_body(c):
    return structure.split_body(c.paragraphs).groupBy("file_key").agg(F.count_if(F.col("part") == "margin").alias("margins"), F.count(F.lit(1)).alias("paragraphs"))


@query("contents_titles", "WITH t AS (SELECT file_key, trim(regexp_replace(lower(content), '[.\\s]*[0-9]*$', '')) AS title FROM (SELECT file_key, substr(content, 1, 12) || ' ....' || para AS content FROM fx_paragraphs)), k AS (SELECT file_key, list_sort(list(DISTINCT title)) AS titles FROM t WHERE title IN (SELECT substr(lower(content), 1, 12) FROM fx_paragraphs GROUP BY 1 HAVING count(*) > 3) GROUP BY 1) SELECT file_key, array_to_string(titles, '|') AS titles FROM k WHERE len(titles) >= 2")
def contents_titles(c):
    rows = c.paragraphs.select("file_key", F.concat(F.substring("content", 1, 12), F.lit(" ...."), F.col("para").cast("string")).alias("content"))
    heads = c.paragraphs.groupBy(F.substring(F.lower("content"), 1, 12).alias("title")).agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
    return structure.toc_titles(rows, heads.select("title")).select("file_key", F.array_join("titles", "|").alias("titles"))
