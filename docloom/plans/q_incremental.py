"""Queries of batched upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import lifecycle as L
from docloom.operators.extraction import multi_label
from docloom.operators.structure import heading_ranges
from docloom.plans.q_extraction import RULES
from docloom.plans.registry import query

_SIG = "regexp_replace(regexp_replace(replace(lower(proposed_ko), 'ß', 'ss'), '[0-9]+', '#', 'g'), '[^\\p{L}\\p{N}#]+', '', 'g')"
_SUB = "array_to_string(string_split(taxonomy_id, '.')[1:2], '.')"
_NEW = "new AS (SELECT file_key, family, item_ref || CASE WHEN loc_start % 2 = 0 THEN '' ELSE '-n' END AS item_ref, taxonomy_id FROM fx_clause_item WHERE doc_id % 3 = 0 AND loc_start <> 2)"


def _new(c):
    rows = c.items.filter("doc_id % 3 = 0 and loc_start <> 2")
    return rows.select("file_key", "family", F.concat("item_ref", F.when(F.col("loc_start") % 2 == 0, "").otherwise("-n")).alias("item_ref"), "taxonomy_id")


@query("replaced_results", f"WITH {_NEW}, old AS (SELECT file_key, family, item_ref, taxonomy_id FROM fx_clause_item), g AS (SELECT DISTINCT file_key, family FROM new), p AS (SELECT item_ref FROM fx_clause_item WHERE review_status = 'pending') SELECT * FROM old ANTI JOIN g USING (file_key, family) UNION ALL SELECT o.* FROM old o SEMI JOIN g USING (file_key, family) WHERE item_ref IN (SELECT item_ref FROM p) AND NOT EXISTS (SELECT 1 FROM new n WHERE n.file_key = o.file_key AND n.family = o.family AND n.item_ref = o.item_ref) UNION ALL SELECT * FROM new")
def replaced_results(c):
    old = c.items.select("file_key", "family", "item_ref", "taxonomy_id")
    return L.replace_results(old, _new(c), ["file_key", "family"], c.items.filter("review_status = 'pending'").select("item_ref"))


@query("candidate_admission", f"WITH k AS (SELECT *, family || ':' || {_SIG} AS rk FROM fx_candidate), d AS (SELECT rk, count(DISTINCT evidence_file_key)::BIGINT AS documents FROM k GROUP BY 1) SELECT candidate_id, documents, CASE WHEN contains(recommended_parent_id, '.') OR documents >= 2 THEN 'admitted' ELSE 'absorbed' END AS decision, CASE WHEN NOT (contains(recommended_parent_id, '.') OR documents >= 2) THEN family || '.OTHER' END AS target FROM k JOIN d USING (rk)")
def candidate_admission(c):
    return L.admit(c.candidates, F.concat("family", F.lit(":"), T.signature(F.col("proposed_ko")))).select("candidate_id", "documents", "decision", "target")


@query("absorbed_items", f"WITH k AS (SELECT *, family || ':' || {_SIG} AS rk FROM fx_candidate), d AS (SELECT rk, count(DISTINCT evidence_file_key) AS n FROM k GROUP BY 1) SELECT evidence_file_key AS file_key, 'c-' || candidate_id AS item_ref, family || '.OTHER' AS taxonomy_id, family, verbatim, loc_start FROM k JOIN d USING (rk) WHERE NOT contains(recommended_parent_id, '.') AND n < 2")
def absorbed_items(c):
    return L.absorbed_items(L.admit(c.candidates, F.concat("family", F.lit(":"), T.signature(F.col("proposed_ko")))))


_PLAN = "plan AS (SELECT candidate_id + CASE WHEN candidate_id % 50 = 7 THEN 1000000000000 ELSE 0 END AS candidate_id, CASE candidate_id % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'promote' ELSE 'reject' END AS action, CASE candidate_id % 4 WHEN 0 THEN family || '.A' WHEN 1 THEN 'RW' WHEN 2 THEN family || '.NEW' ELSE 'CP.A' END AS target FROM fx_candidate UNION ALL SELECT candidate_id, 'reject', 'RW' FROM fx_candidate WHERE candidate_id % 30 = 0)"
_OUT = f"""{_PLAN}, tw AS (SELECT candidate_id, count(DISTINCT action) AS n FROM plan GROUP BY 1), outc AS (SELECT p.candidate_id, action, target, CASE WHEN k.family IS NULL THEN 'unknown_candidate' WHEN k.status <> 'pending' THEN 'decided' WHEN tw.n > 1 THEN 'two_actions' WHEN action = 'merge' AND nd.family IS NULL THEN 'unknown_target' WHEN action = 'merge' AND nd.family <> k.family THEN 'foreign_target' WHEN action = 'promote' AND nd.family IS NOT NULL THEN 'target_exists' ELSE 'applied' END AS outcome
 FROM plan p LEFT JOIN fx_candidate k USING (candidate_id) LEFT JOIN fx_node nd ON nd.taxonomy_id = target JOIN tw ON tw.candidate_id = p.candidate_id)"""


def _plan(c):
    k = F.col("candidate_id")
    action = F.when(k % 3 == 0, "merge").when(k % 3 == 1, "promote").otherwise("reject")
    target = F.when(k % 4 == 0, F.concat("family", F.lit(".A"))).when(k % 4 == 1, "RW").when(k % 4 == 2, F.concat("family", F.lit(".NEW"))).otherwise("CP.A")
    first = c.candidates.select((k + F.when(k % 50 == 7, 1000000000000).otherwise(0)).alias("candidate_id"), action.alias("action"), target.alias("target"))
    return first.union(c.candidates.filter("candidate_id % 30 = 0").select("candidate_id", F.lit("reject"), F.lit("RW")))


@query("resolved_candidates", f"WITH {_OUT} SELECT * FROM outc")
def resolved_candidates(c):
    return L.resolve_batch(c.candidates, _plan(c), c.nodes)


@query("merged_items", f"WITH {_OUT} SELECT evidence_file_key AS file_key, 'm-' || candidate_id || '-' || target AS item_ref, target AS taxonomy_id, verbatim, loc_start FROM outc JOIN fx_candidate USING (candidate_id) WHERE outcome = 'applied' AND action <> 'reject'")
def merged_items(c):
    return L.merged_items(c.candidates, L.resolve_batch(c.candidates, _plan(c), c.nodes))


@query("regression_guard", f"WITH {_NEW}, a AS (SELECT file_key, list_sort(list(DISTINCT {_SUB})) AS after FROM new GROUP BY 1), b AS (SELECT file_key, list_sort(list(DISTINCT {_SUB})) AS before FROM fx_clause_item GROUP BY 1), r AS (SELECT file_key, coalesce(before, []) AS before, after, list_filter(coalesce(before, []), lambda x: NOT list_contains(after, x)) AS lost FROM a LEFT JOIN b USING (file_key)) SELECT file_key, array_to_string(before, '|') AS before, array_to_string(after, '|') AS after, array_to_string(lost, '|') AS lost, CASE WHEN len(lost) > 0 THEN 'refused' ELSE 'stored' END AS decision FROM r")
def regression_guard(c):
    return L.regression_guard(c.items, _new(c))


@query("downgraded_coverage", "WITH f AS (SELECT DISTINCT file_key, family FROM fx_clause_item WHERE review_status = 'pending') SELECT d.file_key, d.family, d.body_status AS before, CASE WHEN f.file_key IS NOT NULL AND body_status = 'complete' THEN 'partial' ELSE body_status END AS body_status, CASE WHEN f.file_key IS NOT NULL AND body_status = 'complete' THEN 'pending_items' ELSE '' END AS reason FROM fx_document_coverage d LEFT JOIN f USING (file_key, family)")
def downgraded_coverage(c):
    return L.downgrade(c.document_coverage, c.items.filter("review_status = 'pending'"), "pending_items")


@query("guarded_corrections", "WITH p AS (SELECT CASE WHEN doc_id % 20 = 6 THEN 'gone' || doc_id ELSE file_key END AS file_key, CASE WHEN doc_id % 10 = 0 THEN 'OLD' ELSE ctype END AS old, 'SPA' AS new FROM fx_files WHERE doc_id % 2 = 0) SELECT p.*, CASE WHEN f.ctype IS NULL THEN 'gone' WHEN f.ctype <> old THEN 'changed' ELSE 'applied' END AS state FROM p LEFT JOIN fx_files f USING (file_key)")
def guarded_corrections(c):
    d = F.col("doc_id")
    plan = c.files.filter("doc_id % 2 = 0").select(F.when(d % 20 == 6, F.concat(F.lit("gone"), d.cast("string"))).otherwise(F.col("file_key")).alias("file_key"), F.when(d % 10 == 0, "OLD").otherwise(F.col("ctype")).alias("old"), F.lit("SPA").alias("new"))
    return L.guarded_apply(c.files, plan, "file_key", "ctype")


@query("scope_corrections", "WITH cov AS (SELECT file_key, CASE WHEN file_key < '4' THEN 'not_evaluated' ELSE body_status END AS body_status FROM fx_document_coverage), it AS (SELECT * FROM fx_clause_item WHERE file_key >= '2'), ca AS (SELECT * FROM fx_candidate WHERE evidence_file_key >= '1'), idle AS (SELECT file_key FROM cov GROUP BY 1 HAVING bool_and(body_status = 'not_evaluated')) SELECT f.file_key, 'idle_ancillary' AS code, 0::BIGINT AS n FROM fx_files f SEMI JOIN idle USING (file_key) WHERE regexp_matches(lower(filename), 'notes|bidding') AND file_key NOT IN (SELECT file_key FROM it) AND file_key NOT IN (SELECT evidence_file_key FROM ca) UNION ALL SELECT file_key, 'inner_node', count(*) FROM it WHERE taxonomy_id IN (SELECT parent_id FROM fx_node WHERE parent_id IS NOT NULL) GROUP BY 1")
def scope_corrections(c):
    cov = c.document_coverage.withColumn("body_status", F.when(F.col("file_key") < "4", "not_evaluated").otherwise(F.col("body_status")))
    return L.scope_corrections(c.files, c.items.filter("file_key >= '2'"), c.candidates.filter("evidence_file_key >= '1'"), cov, c.nodes)


@query("stored_after_audit", "WITH a AS (SELECT f.file_key, CASE WHEN count(*) FILTER (review_status = 'pending') > 1 THEN 'error' WHEN count(*) FILTER (review_status = 'pending') = 1 THEN 'review' ELSE 'pass' END AS audit FROM fx_files f LEFT JOIN fx_clause_item USING (file_key) GROUP BY 1) SELECT file_key, CASE WHEN audit IN ('pass','review') THEN 'stored' ELSE 'skipped' END AS outcome, CASE WHEN audit = 'error' THEN audit ELSE '' END AS reason FROM a")
def stored_after_audit(c):
    n = c.items.groupBy("file_key").agg(F.count_if(F.col("review_status") == "pending").alias("n"))
    audited = c.files.select("file_key").join(n, "file_key", "left").withColumn("audit", F.when(F.col("n") > 1, "error").when(F.col("n") == 1, "review").otherwise("pass"))
    return L.store_passed(audited, include_review=True)


@query("conversion_worklist", "WITH f AS (SELECT path, content_hash AS sha256, CASE doc_id % 3 WHEN 0 THEN 'ole2' WHEN 1 THEN 'rtf' ELSE 'zip' END AS kind, doc_id FROM fx_files) SELECT path, sha256, CASE WHEN kind = 'ole2' THEN 'convert' ELSE 'rejected_' || kind END AS state FROM f WHERE NOT (doc_id % 4 = 0 OR (doc_id % 4 = 1 AND false))")
def conversion_worklist(c):
    d = F.col("doc_id")
    files = c.files.select("path", F.col("content_hash").alias("sha256"), F.when(d % 3 == 0, "ole2").when(d % 3 == 1, "rtf").otherwise("zip").alias("kind"), "doc_id")
    done = files.filter("doc_id % 4 < 2").select("path", "sha256", F.when(d % 4 == 0, "ok").otherwise("failed").alias("status"))
    return L.conversion_worklist(files, done)


_EV = "ev AS (SELECT file_key, para, content AS text, 'item' AS source, 1 AS prio FROM fx_paragraphs WHERE para % 2 = 1 UNION ALL SELECT file_key, para, content, 'body', 2 FROM fx_paragraphs), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_key, md5(trim(text)) ORDER BY prio, para) AS r FROM ev) WHERE r = 1), lab AS (SELECT text, string_agg(label, '|' ORDER BY ord) AS labels FROM (SELECT DISTINCT text FROM one) JOIN (VALUES (1,'(?i)there',NULL,'RW'),(2,'(?i)whst','(?i)license','CP'),(3,'(?i)\\bwith\\b',NULL,'COV'),(4,'license',NULL,'REM')) r(ord,p,np,label) ON regexp_matches(text, p) AND (np IS NULL OR NOT regexp_matches(text, np)) GROUP BY 1), fin AS (SELECT file_key, para, source, coalesce(labels, '') AS labels, CASE WHEN labels IS NULL THEN 'unresolved' ELSE 'resolved' END AS state FROM one LEFT JOIN lab USING (text))"


def _final(c):
    p = c.paragraphs
    ev = p.filter("para % 2 = 1").select("file_key", "para", F.col("content").alias("text"), F.lit("item").alias("source"), F.lit(1).alias("prio")).union(p.select("file_key", "para", "content", F.lit("body"), F.lit(2)))
    labels = multi_label(ev.select("text").distinct().withColumn("t", F.col("text")), "t", c.small(RULES, "ord int, pattern string, not_pattern string, label string"), ["text"])
    return L.finalize(ev, labels)


@query("finalized_evidence", f"WITH {_EV} SELECT * FROM fin")
def finalized_evidence(c):
    return _final(c)


@query("coverage_from_evidence", f"WITH {_EV} SELECT file_key, count(*)::BIGINT AS texts, count(*) FILTER (state = 'unresolved')::BIGINT AS open, CASE WHEN count(*) FILTER (state = 'unresolved') = 0 THEN 'complete' ELSE 'partial' END AS body_status FROM fin GROUP BY file_key")
def coverage_from_evidence(c):
    return L.coverage_from_evidence(_final(c))


@query(
    "work_inputs",
    """WITH h AS (SELECT file_key, para, last, coalesce(lead(para) OVER (PARTITION BY file_key ORDER BY para) - 1, last) AS to_para FROM (SELECT *, max(para) OVER (PARTITION BY file_key) AS last FROM fx_paragraphs) WHERE contains(lower(content), 'there')),
 r AS (SELECT h.file_key, h.para AS from_para, to_para, string_agg('{"para":' || p.para || ',"content":' || to_json(content) || '}', ',' ORDER BY p.para) AS ps FROM h JOIN fx_paragraphs p ON p.file_key = h.file_key AND p.para BETWEEN h.para AND to_para GROUP BY ALL)
 SELECT file_key, '[' || string_agg('{"family":"RW","from_para":' || from_para || ',"to_para":' || to_para || ',"paragraphs":[' || ps || ']}', ',' ORDER BY from_para, to_para) || ']' AS input, count(*)::BIGINT AS ranges FROM r GROUP BY 1""",
)
def work_inputs(c):
    low = F.lower("content")
    ranges = heading_ranges(c.paragraphs, F.contains(low, F.lit("there"))).select("file_key", F.lit("RW").alias("family"), "from_para", "to_para")
    return L.work_inputs(ranges, c.paragraphs)


@query("seeded_nodes", "WITH s AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'RW.A' WHEN 1 THEN 'RW.N' || (doc_id % 12) ELSE 'CP.A' END AS taxonomy_id FROM documents) SELECT taxonomy_id, family, label FROM fx_node UNION ALL SELECT taxonomy_id, 'RW', 'seed' FROM s WHERE taxonomy_id NOT IN (SELECT taxonomy_id FROM fx_node)")
def seeded_nodes(c):
    from docloom.operators.catalog import insert_missing

    m = F.col("doc_id") % 3
    tid = F.when(m == 0, "RW.A").when(m == 1, F.concat(F.lit("RW.N"), (F.col("doc_id") % 12).cast("string"))).otherwise("CP.A")
    seed = c.documents.select(tid.alias("taxonomy_id")).distinct().select("taxonomy_id", F.lit("RW").alias("family"), F.lit("seed").alias("label"))
    return insert_missing(c.nodes.select("taxonomy_id", "family", "label"), seed, ["taxonomy_id"])
