"""Queries of quality audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import audits as A
from docloom.plans.registry import query

_BAD = """bad AS (SELECT file_key, CASE WHEN doc_id % 31 = 0 THEN 'XX.Q' ELSE taxonomy_id END AS taxonomy_id, CASE WHEN doc_id % 37 = 0 THEN 'REM' ELSE family END AS family, CASE WHEN doc_id % 41 = 0 THEN item_ref ELSE item_ref END AS item_ref, CASE WHEN doc_id % 43 = 0 THEN '  ' ELSE verbatim END AS verbatim, loc_start, CASE WHEN doc_id % 47 = 0 THEN loc_start - 1 ELSE loc_end END AS loc_end, CASE WHEN doc_id % 29 = 0 THEN 'maybe' ELSE statement_polarity END AS statement_polarity, txt_hash, CASE WHEN doc_id % 23 = 0 THEN 'odd' ELSE review_status END AS review_status FROM fx_clause_item)"""


def _bad(c):
    d = F.col("doc_id")
    i = c.items
    alter = {"taxonomy_id": (31, F.lit("XX.Q")), "family": (37, F.lit("REM")), "verbatim": (43, F.lit("  ")), "loc_end": (47, F.col("loc_start") - 1), "statement_polarity": (29, F.lit("maybe")), "review_status": (23, F.lit("odd"))}
    return i.select("file_key", "item_ref", "loc_start", "txt_hash", *[F.when(d % m == 0, v).otherwise(F.col(k)).alias(k) for k, (m, v) in alter.items()])


@query("item_issues", f"""WITH {_BAD}, k AS (SELECT b.*, n.family AS nf, f.content_hash AS h FROM bad b LEFT JOIN fx_node n USING (taxonomy_id) LEFT JOIN fx_files f USING (file_key))
 SELECT file_key, item_ref, 'unknown_node' AS code, taxonomy_id AS detail FROM k WHERE nf IS NULL UNION ALL SELECT file_key, item_ref, 'family_mismatch', family FROM k WHERE nf <> family UNION ALL SELECT file_key, item_ref, 'bad_polarity', statement_polarity FROM k WHERE statement_polarity = 'maybe' UNION ALL SELECT file_key, item_ref, 'bad_status', review_status FROM k WHERE review_status = 'odd'
 UNION ALL SELECT file_key, item_ref, 'empty_quote', '' FROM k WHERE trim(verbatim) = '' UNION ALL SELECT file_key, item_ref, 'bad_range', loc_start::VARCHAR FROM k WHERE loc_end < loc_start UNION ALL SELECT file_key, item_ref, 'stale', txt_hash FROM k WHERE txt_hash <> h""")
def item_issues(c):
    return A.item_issues(_bad(c), c.nodes, c.files)


@query("evidence_issues", f"WITH {_BAD}, t AS (SELECT b.file_key, b.item_ref, string_agg(p.content, '' ORDER BY p.para) AS t FROM bad b JOIN fx_paragraphs p ON p.file_key = b.file_key AND p.para BETWEEN b.loc_start AND b.loc_end GROUP BY ALL) SELECT b.file_key, b.item_ref, CASE WHEN t IS NULL THEN 'no_location' ELSE 'not_in_range' END AS code, loc_start::VARCHAR AS detail FROM (SELECT * REPLACE (CASE WHEN loc_start % 5 = 0 THEN verbatim || 'zz' ELSE verbatim END AS verbatim) FROM bad) b LEFT JOIN t USING (file_key, item_ref) WHERE t IS NULL OR NOT contains(regexp_replace(t, '\\s+', '', 'g'), regexp_replace(b.verbatim, '\\s+', '', 'g'))")
def evidence_issues(c):
    rows = _bad(c).withColumn("verbatim", F.when(F.col("loc_start") % 5 == 0, F.concat("verbatim", F.lit("zz"))).otherwise(F.col("verbatim")))
    return A.evidence_issues(rows, c.paragraphs)


@query("candidate_issues", "WITH k AS (SELECT * REPLACE (CASE WHEN candidate_id % 13 = 0 THEN 'node a' ELSE proposed_ko END AS proposed_ko, CASE WHEN candidate_id % 17 = 0 THEN 'RW' ELSE recommended_parent_id END AS recommended_parent_id) FROM fx_candidate), p AS (SELECT k.*, n.family AS pf FROM k LEFT JOIN fx_node n ON n.taxonomy_id = recommended_parent_id) SELECT candidate_id, 'unknown_parent' AS code, recommended_parent_id AS detail FROM p WHERE pf IS NULL UNION ALL SELECT candidate_id, 'parent_family', pf FROM p WHERE pf <> family UNION ALL SELECT candidate_id, 'name_taken', proposed_ko FROM p WHERE lower(trim(proposed_ko)) IN (SELECT label FROM fx_node) UNION ALL SELECT candidate_id, 'no_evidence', '' FROM p WHERE trim(verbatim) = ''")
def candidate_issues(c):
    k = F.col("candidate_id")
    rows = c.candidates.withColumn("proposed_ko", F.when(k % 13 == 0, "node a").otherwise(F.col("proposed_ko"))).withColumn("recommended_parent_id", F.when(k % 17 == 0, "RW").otherwise(F.col("recommended_parent_id")))
    return A.candidate_issues(rows, c.nodes, c.small([("PAY", "zz")], "taxonomy_id string, alias string"))


@query("source_issues", "WITH d AS (SELECT f.file_key, g.family, 'src-' || f.doc_id AS source_id FROM fx_files f CROSS JOIN fx_family g WHERE f.status = 'ok' AND f.doc_id % 4 <> 0), r AS (SELECT file_key, family, source_id FROM fx_source_coverage) SELECT coalesce(d.file_key, r.file_key) AS file_key, coalesce(d.family, r.family) AS family, coalesce(d.source_id, r.source_id) AS source_id, CASE WHEN r.file_key IS NULL THEN 'not_reported' ELSE 'not_declared' END AS code FROM d FULL JOIN r ON d.file_key = r.file_key AND d.family = r.family AND d.source_id = r.source_id WHERE d.file_key IS NULL OR r.file_key IS NULL")
def source_issues(c):
    declared = c.files.filter("status = 'ok' and doc_id % 4 <> 0").crossJoin(F.broadcast(c.families)).select("file_key", "family", F.concat(F.lit("src-"), F.col("doc_id").cast("string")).alias("source_id"))
    return A.source_issues(declared, c.source_coverage)


@query("coverage_issues", "WITH i AS (SELECT file_key, family, count(*) AS n FROM fx_clause_item GROUP BY ALL), s AS (SELECT file_key, family, count(*) AS n, bool_and(status = 'complete') AS done FROM fx_source_coverage GROUP BY ALL), r AS (SELECT d.*, i.n AS items, s.n AS sources, s.done FROM fx_document_coverage d LEFT JOIN i USING (file_key, family) LEFT JOIN s USING (file_key, family)) SELECT file_key, family, 'items_without_evaluation' AS code, items::VARCHAR AS detail FROM r WHERE body_status = 'not_evaluated' AND items > 0 UNION ALL SELECT file_key, family, 'sources_without_annex', sources::VARCHAR FROM r WHERE annex_status = 'no_annex' AND sources > 0 UNION ALL SELECT file_key, family, 'annex_not_done', sources::VARCHAR FROM r WHERE annex_status = 'complete' AND NOT coalesce(done, true)")
def coverage_issues(c):
    return A.coverage_issues(c.document_coverage, c.items, c.source_coverage)


@query("heading_omissions", "WITH h AS (SELECT file_key, para, 'RW.B' AS sub FROM fx_paragraphs WHERE contains(lower(content), 'there')) SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM fx_clause_item i WHERE i.file_key = h.file_key AND array_to_string(string_split(taxonomy_id, '.')[1:2], '.') = 'RW.B') AND file_key NOT IN (SELECT file_key FROM fx_files WHERE doc_id % 11 = 0)")
def heading_omissions(c):
    heads = c.paragraphs.filter(F.contains(F.lower("content"), F.lit("there"))).select("file_key", "para", F.lit("RW.B").alias("sub"))
    accepted = c.files.filter("doc_id % 11 = 0").select("file_key", F.lit("RW.B").alias("sub"))
    return A.heading_omissions(heads, c.items, accepted)


@query("item_surge", "WITH n AS (SELECT file_key, family, count(*)::BIGINT AS now FROM fx_clause_item GROUP BY ALL), b AS (SELECT file_key, family, count(*)::BIGINT AS before FROM fx_clause_item WHERE loc_start = 1 GROUP BY ALL) SELECT * FROM n JOIN b USING (file_key, family) WHERE before >= 1 AND now >= 3 * before")
def item_surge(c):
    return A.item_surge(c.items, c.items.filter("loc_start = 1"), 3, 1)


@query("audit_status", f"""WITH {_BAD}, e AS (SELECT b.file_key, count(*) AS errors FROM bad b LEFT JOIN fx_node n USING (taxonomy_id) WHERE n.taxonomy_id IS NULL GROUP BY 1), r AS (SELECT file_key, count(*) AS reviews FROM (SELECT d.file_key FROM fx_document_coverage d WHERE body_status = 'partial' AND family = 'RW') GROUP BY 1), p AS (SELECT file_key, count(*) AS pendings FROM bad WHERE review_status = 'pending' GROUP BY 1)
 SELECT f.file_key, coalesce(errors, 0)::BIGINT AS errors, coalesce(reviews, 0)::BIGINT AS reviews, coalesce(pendings, 0)::BIGINT AS pendings, CASE WHEN errors > 0 THEN 'error' WHEN reviews > 0 THEN 'review' WHEN pendings > 0 THEN 'pending' ELSE 'pass' END AS audit FROM fx_files f LEFT JOIN e USING (file_key) LEFT JOIN r USING (file_key) LEFT JOIN p USING (file_key)""")
def audit_status(c):
    bad = _bad(c)
    return A.audit_status(c.files, bad.join(F.broadcast(c.nodes), "taxonomy_id", "left_anti"), c.document_coverage.filter("body_status = 'partial' and family = 'RW'"), bad.filter("review_status = 'pending'"))


@query("dictionary_issues", """WITH t AS (SELECT canonical, variant, strength FROM fx_term UNION SELECT 'q' || (doc_id % 7), 'v' || (doc_id % 5), CASE WHEN doc_id % 3 = 0 THEN 'odd' ELSE 'normal' END FROM documents), m AS (SELECT DISTINCT 'q' || (doc_id % 9) AS canonical, CASE WHEN doc_id % 4 = 0 THEN 'RW.A' ELSE 'ZZ.' || (doc_id % 4) END AS taxonomy_id FROM documents),
 s AS (SELECT lower(variant) AS subject, count(DISTINCT canonical) AS n, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS cs FROM t GROUP BY 1)
 SELECT canonical || ':' || variant AS subject, 'bad_strength' AS code, strength AS detail FROM t WHERE strength = 'odd' UNION ALL SELECT subject, 'shared_variant', cs FROM s WHERE n > 1 UNION ALL SELECT 'alpha:the', 'avoids_itself', '' UNION ALL SELECT canonical, 'unknown_entry', taxonomy_id FROM m WHERE canonical NOT IN (SELECT canonical FROM t) UNION ALL SELECT canonical, 'unknown_node', taxonomy_id FROM m WHERE taxonomy_id NOT IN (SELECT taxonomy_id FROM fx_node)""")
def dictionary_issues(c):
    d = F.col("doc_id")
    name = lambda p, m: F.concat(F.lit(p), (d % m).cast("string"))
    made = c.documents.select(name("q", 7).alias("canonical"), name("v", 5).alias("variant"), F.when(d % 3 == 0, "odd").otherwise("normal").alias("strength"))
    terms = c.terms.select("canonical", "variant", "strength").union(made).distinct()
    mapping = c.documents.select(name("q", 9).alias("canonical"), F.when(d % 4 == 0, "RW.A").otherwise(name("ZZ.", 4)).alias("taxonomy_id")).distinct()
    return A.dictionary_issues(terms, mapping, c.nodes, c.small([("alpha", "the"), ("alpha", "none")], "canonical string, variant string"))
