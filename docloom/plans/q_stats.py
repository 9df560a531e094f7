"""Queries of corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import stats as S
from docloom.plans.registry import query


@query("status_counts", "SELECT status, count(f.file_key)::BIGINT AS n FROM (VALUES ('ok'),('empty'),('error'),('unsupported'),('excluded'),('missing')) s(status) LEFT JOIN fx_files f USING (status) GROUP BY status")
def status_counts(c):
    return S.counts_over_domain(c.files, "status", S.STATUSES)


@query("type_language_counts", "SELECT ctype, lang, count(*) FILTER (status = 'ok')::BIGINT AS ok_files, count(*) FILTER (status <> 'missing')::BIGINT AS all_files FROM fx_files GROUP BY ctype, lang")
def type_language_counts(c):
    return S.grouped_counts(c.files, ["ctype", "lang"])


@query("error_reasons", "SELECT coalesce(error_reason, '') AS error_reason, coalesce(batch_label, '') AS batch_label, count(*)::BIGINT AS n FROM fx_files GROUP BY ALL")
def error_reasons(c):
    return c.files.groupBy(F.coalesce("error_reason", F.lit("")).alias("error_reason"), F.coalesce("batch_label", F.lit("")).alias("batch_label")).agg(F.count(F.lit(1)).alias("n"))


@query("duplicate_summary", "SELECT sum(n)::BIGINT AS files, count(*)::BIGINT AS groups, count(*) FILTER (n > 1)::BIGINT AS repeated, coalesce(sum(ok) FILTER (n > 1), 0)::BIGINT AS ok_repeated FROM (SELECT count(*) AS n, count(*) FILTER (status = 'ok') AS ok FROM fx_files WHERE status <> 'missing' GROUP BY dup_group)")
def duplicate_summary(c):
    return S.duplicate_summary(c.files)


@query(
    "index_summary",
    """SELECT 'status' AS section, status AS name, count(*)::BIGINT AS n FROM fx_files GROUP BY status UNION ALL SELECT 'batch', batch_label, count(*) FROM fx_files GROUP BY batch_label
    UNION ALL SELECT 'error', error_reason, count(*) FROM fx_files WHERE error_reason IS NOT NULL GROUP BY error_reason UNION ALL SELECT 'unclassified', folder, count(*) FROM fx_files WHERE ctype = 'unclassified' GROUP BY folder
    UNION ALL SELECT 'stale_metadata', 'stale', count(*) FROM fx_doc_meta m JOIN fx_files f USING (file_key) WHERE m.txt_hash <> f.content_hash""",
)
def index_summary(c):
    f, n = c.files, F.count(F.lit(1)).alias("n")
    parts = [("status", f, "status"), ("batch", f, "batch_label"), ("error", f.filter("error_reason is not null"), "error_reason"), ("unclassified", f.filter("ctype = 'unclassified'"), "folder")]
    stale = c.doc_meta.join(f.select("file_key", "content_hash"), "file_key").filter("txt_hash <> content_hash").agg(n)
    out = stale.select(F.lit("stale_metadata").alias("section"), F.lit("stale").alias("name"), "n")
    for section, rows, column in parts:
        out = out.unionByName(rows.groupBy(F.col(column).alias("name")).agg(n).withColumn("section", F.lit(section)))
    return out


@query("facets", "SELECT facet, value, count(*)::BIGINT AS n FROM (SELECT unnest(['ctype','lang','version_role','is_draft']) AS facet, unnest([ctype, lang, version_role, is_draft::VARCHAR]) AS value FROM fx_files) WHERE value IS NOT NULL GROUP BY ALL")
def facets(c):
    return S.facets(c.files, ["ctype", "lang", "version_role", "is_draft"])


@query("top_values", "SELECT facet, value, n, place FROM (SELECT *, (row_number() OVER (PARTITION BY facet ORDER BY n DESC, value))::INTEGER AS place FROM (SELECT facet, value, count(*)::BIGINT AS n FROM (SELECT unnest(['ctype','folder','lang']) AS facet, unnest([ctype, folder, lang]) AS value FROM fx_files) GROUP BY ALL)) WHERE place <= 3")
def top_values(c):
    return S.top_values(S.facets(c.files, ["ctype", "folder", "lang"]), "facet", 3)


@query("corpus_status", "SELECT count(*)::BIGINT AS files, max(doc_id) AS newest, count(*) FILTER (status IN ('empty','error'))::BIGINT AS unsearchable, count(*) FILTER (status = 'ok')::BIGINT AS searchable, bool_and(starts_with(batch_label, 'pilot')) AS pilot_only FROM fx_files")
def corpus_status(c):
    return c.files.agg(F.count(F.lit(1)).alias("files"), F.max("doc_id").alias("newest"), F.count_if(F.col("status").isin("empty", "error")).alias("unsearchable"), F.count_if(F.col("status") == "ok").alias("searchable"), F.bool_and(F.startswith("batch_label", F.lit("pilot"))).alias("pilot_only"))


@query("recent_failures", "SELECT file_key, path, status, error_reason FROM fx_files WHERE status IN ('error','empty') ORDER BY path LIMIT 50")
def recent_failures(c):
    return c.files.filter(F.col("status").isin("error", "empty")).orderBy("path").limit(50).select("file_key", "path", "status", "error_reason")


@query("unclassified_folders", "SELECT folder, count(*)::BIGINT AS n FROM fx_files WHERE ctype = 'unclassified' GROUP BY folder ORDER BY n DESC, folder LIMIT 30")
def unclassified_folders(c):
    return c.files.filter("ctype = 'unclassified'").groupBy("folder").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "folder").limit(30)


@query("verdict_counts", "SELECT verdict, count(*)::BIGINT AS n FROM fx_verdict GROUP BY verdict")
def verdict_counts(c):
    return c.verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("node_overview", """SELECT n.taxonomy_id, n.family, NOT EXISTS (SELECT 1 FROM fx_node k WHERE k.parent_id = n.taxonomy_id) AS is_leaf, count(i.item_ref)::BIGINT AS items, count(i.item_ref) FILTER (review_status = 'pending')::BIGINT AS pending FROM fx_node n LEFT JOIN fx_clause_item i USING (taxonomy_id) GROUP BY n.taxonomy_id, n.family""")
def node_overview(c):
    inner = c.nodes.filter("parent_id is not null").select(F.col("parent_id").alias("taxonomy_id")).distinct().withColumn("_inner", F.lit(True))
    counts = c.items.groupBy("taxonomy_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("review_status") == "pending").alias("pending"))
    out = c.nodes.join(inner, "taxonomy_id", "left").join(counts, "taxonomy_id", "left")
    return out.select("taxonomy_id", "family", F.col("_inner").isNull().alias("is_leaf"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("pending", F.lit(0)).alias("pending"))


_TARGET = "tgt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dup_group ORDER BY ctype, lang, file_key) AS r FROM fx_files WHERE status = 'ok' AND char_count > 0 AND ctype IN ('SPA','SHA','SSA')) WHERE r = 1)"


@query("target_population", f"WITH {_TARGET} SELECT file_key, ctype, lang FROM tgt")
def target_population(c):
    return S.target_population(c.files, ["SPA", "SHA", "SSA"]).select("file_key", "ctype", "lang")


@query("progress_by_type", f"WITH {_TARGET}, e AS (SELECT DISTINCT file_key FROM fx_document_coverage WHERE body_status = 'complete' AND family = 'RW') SELECT ctype, count(e.file_key)::BIGINT AS evaluated, count(*)::BIGINT AS total, round_even(100.0::DOUBLE * count(e.file_key) / count(*), 1) AS percent FROM tgt LEFT JOIN e USING (file_key) GROUP BY ROLLUP (ctype)")
def progress_by_type(c):
    done = c.document_coverage.filter("body_status = 'complete' and family = 'RW'")
    return S.progress(S.target_population(c.files, ["SPA", "SHA", "SSA"]), done)


@query("coverage_histogram", f"WITH {_TARGET}, p AS (SELECT t.file_key, g.family, coalesce(d.body_status, 'not_evaluated') AS b, coalesce(d.annex_status, 'not_evaluated') AS a FROM tgt t CROSS JOIN fx_family g LEFT JOIN fx_document_coverage d ON d.file_key = t.file_key AND d.family = g.family) SELECT family, 'body' AS part, b AS status, count(*)::BIGINT AS n FROM p GROUP BY ALL UNION ALL SELECT family, 'annex', a, count(*) FROM p GROUP BY ALL")
def coverage_histogram(c):
    return S.coverage_histogram(S.target_population(c.files, ["SPA", "SHA", "SSA"]), c.families, c.document_coverage)


_SIG = "regexp_replace(regexp_replace(replace(lower(proposed_ko), 'ß', 'ss'), '[0-9]+', '#', 'g'), '[^\\p{L}\\p{N}#]+', '', 'g')"


def _signed(c):
    return T.with_signature(c.candidates, "proposed_ko", "sig")


@query("candidate_clusters", f"SELECT cluster, n, documents, types, langs, evidence FROM (SELECT family || ':' || {_SIG} AS cluster, count(*)::BIGINT AS n, count(DISTINCT evidence_file_key)::BIGINT AS documents, count(DISTINCT ctype)::BIGINT AS types, count(DISTINCT lang)::BIGINT AS langs, array_to_string((list(evidence_file_key ORDER BY evidence_file_key, candidate_id))[1:5], '|') AS evidence FROM fx_candidate LEFT JOIN fx_files ON file_key = evidence_file_key GROUP BY 1) WHERE n >= 2")
def candidate_clusters(c):
    return S.clusters(_signed(c), F.concat("family", F.lit(":"), "sig"), c.files)


@query("candidate_recurrence", f"WITH k AS (SELECT candidate_id, evidence_file_key, family || ':' || {_SIG} AS recurrence_key FROM fx_candidate) SELECT candidate_id, recurrence_key, greatest(1, n)::BIGINT AS document_count FROM k JOIN (SELECT recurrence_key, count(DISTINCT evidence_file_key) AS n FROM k GROUP BY 1) USING (recurrence_key)")
def candidate_recurrence(c):
    return S.recurrence(_signed(c), F.concat("family", F.lit(":"), "sig")).select("candidate_id", "recurrence_key", "document_count")


@query("recurrence_sizes", f"SELECT size, count(*)::BIGINT AS n FROM (SELECT count(*)::BIGINT AS size FROM fx_candidate GROUP BY family || ':' || {_SIG}) GROUP BY size")
def recurrence_sizes(c):
    return S.histogram_of_sizes(_signed(c).withColumn("k", F.concat("family", F.lit(":"), "sig")), "k")


@query("candidate_backlog", f"""WITH k AS (SELECT *, family || ':' || {_SIG} AS name_key FROM fx_candidate WHERE status = 'pending'), a AS (SELECT name_key, count(DISTINCT evidence_file_key) AS docs FROM k GROUP BY 1),
 b AS (SELECT k.*, contains(recommended_parent_id, '.') AS dotted, contains(recommended_parent_id, '.') OR document_count > 1 OR docs > 1 AS blocks FROM k JOIN a USING (name_key))
 SELECT family, CASE WHEN dotted THEN 'specific_parent' WHEN blocks THEN 'recurs' ELSE 'one_off' END AS reason, count(*)::BIGINT AS n, count(DISTINCT name_key)::BIGINT AS names, count(DISTINCT evidence_file_key)::BIGINT AS documents FROM b GROUP BY ALL""")
def candidate_backlog(c):
    rows = S.blocked_candidates(_signed(c), F.concat("family", F.lit(":"), "sig"))
    return rows.groupBy("family", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name_key").alias("names"), F.count_distinct("evidence_file_key").alias("documents"))


@query("repeated_items", """SELECT file_key, item_ref, family, group_size, CASE WHEN tuple_size = 1 THEN 'distinct' WHEN r = 1 THEN 'keep' ELSE 'surplus' END AS kind FROM (SELECT *, count(*) OVER (PARTITION BY file_key, verbatim)::BIGINT AS group_size, count(*) OVER t AS tuple_size, row_number() OVER (t ORDER BY item_ref) AS r FROM fx_clause_item WINDOW t AS (PARTITION BY file_key, verbatim, taxonomy_id, loc_start, loc_end, statement_polarity)) WHERE group_size > 1""")
def repeated_items(c):
    return S.repeated_items(c.items)


@query("dense_paragraphs", "SELECT file_key, family, loc_start, count(*)::BIGINT AS n FROM fx_clause_item GROUP BY ALL HAVING count(*) >= 2")
def dense_paragraphs(c):
    return S.dense_paragraphs(c.items, 2)


@query("extraction_progress", """SELECT ctype, count(DISTINCT i.file_key)::BIGINT AS stored, count(DISTINCT f.file_key)::BIGINT AS total, count(DISTINCT f.file_key) FILTER (i.file_key IS NULL)::BIGINT AS remaining FROM fx_files f LEFT JOIN (SELECT DISTINCT file_key FROM fx_clause_item WHERE family = 'RW') i ON i.file_key = f.file_key WHERE status = 'ok' GROUP BY ctype""")
def extraction_progress(c):
    stored = c.items.filter("family = 'RW'").select("file_key").distinct().withColumn("_s", F.lit(1))
    rows = c.files.filter("status = 'ok'").select("file_key", "ctype").join(stored, "file_key", "left")
    return rows.groupBy("ctype").agg(F.count("_s").alias("stored"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("_s").isNull()).alias("remaining"))
