"""Queries on clause items: present, absent, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import subdomain
from docloom.operators import clauses as C
from docloom.plans.registry import query

_SIG = "regexp_replace(regexp_replace(replace(lower(proposed_ko), 'ß', 'ss'), '[0-9]+', '#', 'g'), '[^\\p{L}\\p{N}#]+', '', 'g')"
COVERAGE_SQL = f"""pend AS (SELECT evidence_file_key AS file_key, family, count(*) AS n_pending FROM (SELECT *, {_SIG} AS nk FROM fx_candidate WHERE status = 'pending') k JOIN (SELECT {_SIG} AS nk, count(DISTINCT evidence_file_key) AS docs FROM fx_candidate WHERE status = 'pending' GROUP BY 1) a USING (nk) WHERE contains(recommended_parent_id, '.') OR document_count > 1 OR docs > 1 GROUP BY ALL),
srcs AS (SELECT s.*, coalesce(s.txt_hash, '') <> CASE WHEN s.storage_file_key IS NULL THEN o.content_hash ELSE coalesce(CASE WHEN st.status = 'missing' THEN '' ELSE st.content_hash END, '') END AS stale FROM fx_source_coverage s JOIN fx_files o ON o.file_key = s.file_key LEFT JOIN fx_files st ON st.file_key = s.storage_file_key),
kinds AS (SELECT file_key, family, string_agg(r, '|' ORDER BY r) AS kinds FROM (SELECT file_key, family, source_kind || '_' || status || ':' || count(*) AS r FROM srcs WHERE status <> 'complete' GROUP BY file_key, family, source_kind, status) GROUP BY ALL),
stl AS (SELECT file_key, family, count(*) AS n_stale FROM srcs WHERE stale GROUP BY ALL),
covstate AS (SELECT *, CASE WHEN reasons = '' THEN 'complete' ELSE 'needs_review' END AS state FROM (
 SELECT f.file_key, g.family, concat_ws('|', CASE WHEN d.body_status IS NULL THEN 'not_evaluated' END, CASE WHEN d.body_status <> 'complete' THEN 'body_' || d.body_status END, CASE WHEN d.annex_status NOT IN ('complete','no_annex') THEN 'annex_' || d.annex_status END,
  CASE WHEN d.body_status IS NOT NULL AND coalesce(d.txt_hash, '') <> coalesce(f.content_hash, '') THEN 'coverage_stale' END, kinds.kinds, 'source_stale:' || n_stale, 'pending:' || n_pending) AS reasons
 FROM fx_files f CROSS JOIN fx_family g LEFT JOIN fx_document_coverage d ON d.file_key = f.file_key AND d.family = g.family LEFT JOIN kinds ON kinds.file_key = f.file_key AND kinds.family = g.family
 LEFT JOIN stl ON stl.file_key = f.file_key AND stl.family = g.family LEFT JOIN pend ON pend.file_key = f.file_key AND pend.family = g.family))"""


def coverage(c):
    return C.coverage_states(c.files, c.families, c.document_coverage, c.source_coverage, c.candidates)


def _sub(root):
    return f"(taxonomy_id = '{root}' OR starts_with(taxonomy_id, '{root}.'))"


@query("coverage_states", f"WITH {COVERAGE_SQL} SELECT file_key, family, state, reasons FROM covstate")
def coverage_states(c):
    return coverage(c)


@query("node_subtree", "WITH RECURSIVE t AS (SELECT taxonomy_id, 0 AS depth FROM fx_node WHERE taxonomy_id = 'RW' UNION ALL SELECT n.taxonomy_id, t.depth + 1 FROM fx_node n JOIN t ON n.parent_id = t.taxonomy_id) SELECT t.taxonomy_id, depth, count(i.item_ref)::BIGINT AS items FROM t LEFT JOIN fx_clause_item i ON i.taxonomy_id = t.taxonomy_id GROUP BY ALL")
def node_subtree(c):
    t = C.subtree(c.nodes, "RW")
    counts = c.items.groupBy("taxonomy_id").agg(F.count(F.lit(1)).alias("items"))
    return t.join(counts, "taxonomy_id", "left").select("taxonomy_id", "depth", F.coalesce("items", F.lit(0)).alias("items"))


@query("active_subtree", """WITH RECURSIVE n AS (SELECT *, CASE WHEN taxonomy_id = 'CP.A' THEN 'retired' ELSE 'active' END AS status FROM fx_node UNION ALL SELECT 'CP.A.Z', 'CP.A', 'CP', 'below retired', 'active' UNION ALL SELECT 'CP.B', 'CP', 'CP', 'b', 'active' UNION ALL SELECT 'CP.B.C', 'CP.B', 'CP', 'c', 'active'),
 t AS (SELECT taxonomy_id, 0 AS depth FROM n WHERE taxonomy_id = 'CP' UNION ALL SELECT n.taxonomy_id, t.depth + 1 FROM n JOIN t ON n.parent_id = t.taxonomy_id WHERE n.status = 'active'),
 leaf AS (SELECT n.taxonomy_id, NOT EXISTS (SELECT 1 FROM n k WHERE k.parent_id = n.taxonomy_id AND k.status = 'active') AS is_leaf FROM n)
 SELECT t.taxonomy_id, depth, is_leaf, count(i.item_ref)::BIGINT AS items FROM t JOIN leaf USING (taxonomy_id) LEFT JOIN fx_clause_item i ON i.taxonomy_id = t.taxonomy_id GROUP BY ALL""")
def active_subtree(c):
    """Active nodes below a root, whether each is a leaf (no active child), and their items."""
    more = c.small([("CP.A.Z", "CP.A", "CP", "below retired"), ("CP.B", "CP", "CP", "b"), ("CP.B.C", "CP.B", "CP", "c")], "taxonomy_id string, parent_id string, family string, label string")
    nodes = c.nodes.union(more).withColumn("status", F.when(F.col("taxonomy_id") == "CP.A", "retired").otherwise("active"))
    inner = nodes.filter("status = 'active' and parent_id is not null").select(F.col("parent_id").alias("taxonomy_id")).distinct().withColumn("inner", F.lit(True))
    counts = c.items.groupBy("taxonomy_id").agg(F.count(F.lit(1)).alias("items"))
    rows = C.subtree(nodes, "CP").join(inner, "taxonomy_id", "left").join(counts, "taxonomy_id", "left")
    return rows.select("taxonomy_id", "depth", F.col("inner").isNull().alias("is_leaf"), F.coalesce("items", F.lit(0)).alias("items"))


@query("resolve_nodes", "WITH w AS (SELECT DISTINCT CASE doc_id % 5 WHEN 0 THEN 'RW.A' WHEN 1 THEN 'node a' WHEN 2 THEN 'Leaf  AX' WHEN 3 THEN 'nope' ELSE 'odd name' END AS value FROM documents), n AS (SELECT taxonomy_id, lower(taxonomy_id) AS name FROM fx_node UNION SELECT taxonomy_id, lower(label) FROM fx_node UNION SELECT 'PAY', 'odd name') SELECT value, CASE WHEN count(taxonomy_id) = 1 THEN min(taxonomy_id) END AS taxonomy_id, CASE count(taxonomy_id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS state, coalesce(string_agg(taxonomy_id, '|' ORDER BY taxonomy_id), '') AS choices FROM w LEFT JOIN n ON name = regexp_replace(lower(value), ' +', ' ', 'g') GROUP BY value")
def resolve_nodes(c):
    m = F.col("doc_id") % 5
    wanted = c.documents.select(F.when(m == 0, "RW.A").when(m == 1, "node a").when(m == 2, "Leaf  AX").when(m == 3, "nope").otherwise("odd name").alias("value"))
    return C.resolve_node(c.nodes, c.small([("PAY", "Odd Name")], "taxonomy_id string, alias string"), wanted)


_FOUND = f"""WITH {COVERAGE_SQL}, rows AS (SELECT i.file_key, i.family, i.taxonomy_id, n.label, i.item_ref, i.verbatim, i.loc_start, f.ctype, f.dup_group, CASE WHEN coalesce(i.txt_hash,'') = coalesce(f.content_hash,'') THEN 'current' ELSE 'stale' END AS freshness, coalesce(s.state, 'needs_review') AS coverage
 FROM fx_clause_item i JOIN fx_node n USING (taxonomy_id) JOIN fx_files f ON f.file_key = i.file_key AND f.status = 'ok' LEFT JOIN covstate s ON s.file_key = i.file_key AND s.family = i.family WHERE """


@query("clause_items", _FOUND + _sub("RW") + " AND statement_polarity = 'affirmative'), o AS (SELECT file_key, item_ref, label, freshness, coverage FROM rows ORDER BY file_key, loc_start, item_ref LIMIT 50 OFFSET 20), t AS (SELECT count(*)::BIGINT AS total_items, count(DISTINCT file_key)::BIGINT AS total_documents, count(*) FILTER (freshness = 'stale')::BIGINT AS total_stale FROM rows) SELECT o.*, t.*, total_items > 70 AS has_more, total_items > 200 AS low_signal FROM o, t")
def clause_items(c):
    rows = C.search_items(c.items, c.nodes, c.files, coverage(c), "RW", polarity="affirmative")
    order = [F.col("file_key"), F.col("loc_start"), F.col("item_ref")]
    return C.page(rows, order, 50, 20).select("file_key", "item_ref", "label", "freshness", "coverage", "total_items", "total_documents", "total_stale", "has_more", "low_signal")


@query("clause_items_by_text", _FOUND + _sub("RW") + """ AND contains(lower(verbatim), 'there') AND contains(lower(verbatim), 'and')), o AS (SELECT file_key, item_ref, freshness FROM rows ORDER BY contains(lower(verbatim), 'there and') DESC, least(CASE WHEN instr(lower(verbatim), 'there') > 0 THEN instr(lower(verbatim), 'there') ELSE 2147483647 END, CASE WHEN instr(lower(verbatim), 'and') > 0 THEN instr(lower(verbatim), 'and') ELSE 2147483647 END), length(verbatim), file_key, loc_start, item_ref LIMIT 30) SELECT o.*, (SELECT count(*) FROM rows)::BIGINT AS total_items FROM o""")
def clause_items_by_text(c):
    rows = C.search_items(c.items, c.nodes, c.files, coverage(c), "RW", tokens=["there", "and"])
    return C.page(rows, C.text_order(["there", "and"]), 30).select("file_key", "item_ref", "freshness", "total_items")


@query("clause_items_deduped", _FOUND + _sub("CP") + "), r AS (SELECT *, first_value(file_key) OVER (PARTITION BY dup_group ORDER BY length(verbatim), file_key, loc_start, item_ref) AS rep FROM rows) SELECT file_key, item_ref, dup_group FROM r WHERE rep = file_key")
def clause_items_deduped(c):
    rows = C.search_items(c.items, c.nodes, c.files, coverage(c), "CP")
    return C.dedup_items(rows, [F.length("verbatim"), F.col("file_key"), F.col("loc_start"), F.col("item_ref")]).select("file_key", "item_ref", "dup_group")


def _absence(root, gated):
    return f"""WITH {COVERAGE_SQL}, docs AS (SELECT min(file_key) AS file_key FROM fx_files WHERE status = 'ok' GROUP BY dup_group), found AS (SELECT file_key, count(*) AS items FROM fx_clause_item WHERE {_sub(root)} GROUP BY 1),
 r AS (SELECT d.file_key, coalesce(items, 0)::BIGINT AS items, CASE WHEN items > 0 THEN 'present_excluded' WHEN state = 'complete' AND NOT {gated} THEN 'confirmed_absent' ELSE 'needs_review' END AS answer, concat_ws('|', nullif(coalesce(reasons, 'not_evaluated'), ''), CASE WHEN {gated} THEN 'family_gated' END) AS w FROM docs d LEFT JOIN found USING (file_key) LEFT JOIN covstate s ON s.file_key = d.file_key AND s.family = '{root.split(".")[0]}')
 SELECT file_key, items, answer, CASE WHEN answer = 'needs_review' THEN w ELSE '' END AS why FROM r"""


@query("absent_clauses", _absence("CP", "false"))
def absent_clauses(c):
    return C.absence(c.files, c.items, c.nodes, coverage(c), "CP", gated=("RW",))


@query("absent_gated_clauses", _absence("RW.B", "true"))
def absent_gated_clauses(c):
    return C.absence(c.files, c.items, c.nodes, coverage(c), "RW.B", gated=("RW",), admitted=("RW.A",))


@query("absent_summary", f"SELECT answer, count(*)::BIGINT AS n FROM ({_absence('CP', 'false')}) GROUP BY answer")
def absent_summary(c):
    return absent_clauses(c).groupBy("answer").agg(F.count(F.lit(1)).alias("n"))


@query("compared_clauses", f"""WITH {COVERAGE_SQL}, k AS (SELECT file_key, content_hash FROM fx_files WHERE doc_id % 100 = 0), i AS (SELECT k.file_key, bool_or(coalesce(txt_hash,'') = coalesce(content_hash,'')) AS cur, count(*) AS items FROM fx_clause_item i JOIN k USING (file_key) WHERE {_sub('RW')} GROUP BY 1)
 SELECT k.file_key, coalesce(items, 0)::BIGINT AS items, CASE WHEN cur THEN 'confirmed_present' WHEN items > 0 THEN 'needs_review' WHEN state = 'complete' THEN 'confirmed_absent' ELSE 'needs_review' END AS answer FROM k LEFT JOIN i USING (file_key) LEFT JOIN covstate s ON s.file_key = k.file_key AND s.family = 'RW'""")
def compared_clauses(c):
    return C.compare(c.files, c.items, c.nodes, coverage(c), "RW", c.files.filter("doc_id % 100 = 0").select("file_key"))


@query("comparison_picks", f"SELECT answer, min(file_key) AS file_key FROM ({_absence('CP', 'false')}) GROUP BY answer")
def comparison_picks(c):
    return absent_clauses(c).groupBy("answer").agg(F.min("file_key").alias("file_key"))


@query("provable_absence", "SELECT family, count(*) FILTER (body_status = 'complete' AND annex_status IN ('complete','no_annex'))::BIGINT AS provable, count(*)::BIGINT AS n FROM fx_document_coverage GROUP BY family")
def provable_absence(c):
    return C.provable_absence(c.document_coverage).groupBy("family").agg(F.count_if("provable").alias("provable"), F.count(F.lit(1)).alias("n"))


@query("absence_eligibility", f"WITH {COVERAGE_SQL} SELECT family, reason, count(*)::BIGINT AS n FROM (SELECT family, unnest(CASE WHEN reasons = '' THEN ['eligible'] ELSE string_split(reasons, '|') END) AS r, regexp_replace(r, ':[0-9]+$', '') AS reason FROM covstate) GROUP BY ALL")
def absence_eligibility(c):
    rows = coverage(c).withColumn("r", F.explode(F.when(F.col("reasons") == "", F.array(F.lit("eligible"))).otherwise(F.split("reasons", r"\|"))))
    return rows.groupBy("family", F.regexp_replace("r", ":[0-9]+$", "").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("complete_without_items", f"SELECT file_key FROM fx_document_coverage WHERE family = 'RW' AND body_status = 'complete' AND file_key NOT IN (SELECT file_key FROM fx_clause_item WHERE {_sub('RW.A')})")
def complete_without_items(c):
    return C.never_in_subtree(c.document_coverage, c.items, "RW", "RW.A")


@query("item_subdomains", "SELECT array_to_string(string_split(taxonomy_id, '.')[1:2], '.') AS sub, count(*)::BIGINT AS n, count(DISTINCT file_key)::BIGINT AS documents FROM fx_clause_item GROUP BY ALL")
def item_subdomains(c):
    return c.items.groupBy(subdomain(F.col("taxonomy_id")).alias("sub")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_key").alias("documents"))


@query("nearest_ancestors", "WITH i AS (SELECT item_ref, taxonomy_id || '.Z' || (loc_start % 2) AS tid FROM fx_clause_item), p AS (SELECT item_ref, tid, array_to_string(string_split(tid, '.')[1:d], '.') AS pre, d FROM i, range(1, 6) r(d) WHERE d <= len(string_split(tid, '.'))) SELECT item_ref, tid, max_by(taxonomy_id, d) AS known FROM p LEFT JOIN fx_node ON taxonomy_id = pre GROUP BY ALL")
def nearest_ancestors(c):
    rows = c.items.select("item_ref", F.concat("taxonomy_id", F.lit(".Z"), (F.col("loc_start") % 2).cast("string")).alias("tid"))
    return C.nearest_ancestor(rows, "tid", c.nodes).select("item_ref", "tid", "known")


_CORE = ["RW.A", "RW.B", "CP.A", "COV.A", "DEF.T"]


@query("core_coverage", f"WITH s AS (SELECT DISTINCT i.file_key, array_to_string(string_split(taxonomy_id, '.')[1:2], '.') AS sub FROM fx_clause_item i JOIN fx_files f USING (file_key) WHERE f.status = 'ok') SELECT d.sub, count(s.file_key)::BIGINT AS documents, round_even(100.0::DOUBLE * count(s.file_key) / (SELECT count(*) FROM fx_files WHERE status = 'ok'), 1) AS percent FROM (SELECT unnest({_CORE}) AS sub) d LEFT JOIN s USING (sub) GROUP BY d.sub")
def core_coverage(c):
    return C.core_coverage(c.items, c.files, _CORE)


@query("reextraction_plan", f"WITH s AS (SELECT file_key, list(DISTINCT array_to_string(string_split(taxonomy_id, '.')[1:2], '.')) AS subs FROM fx_clause_item GROUP BY 1), r AS (SELECT f.file_key, ctype, list_sort(list_filter({_CORE}, lambda x: list_contains(coalesce(subs, []), x))) AS p, list_sort(list_filter({_CORE}, lambda x: NOT list_contains(coalesce(subs, []), x))) AS m FROM fx_files f LEFT JOIN s USING (file_key) WHERE status = 'ok') SELECT file_key, ctype, array_to_string(p, '|') AS present, array_to_string(m, '|') AS missing FROM r WHERE len(p) < 2")
def reextraction_plan(c):
    return C.reextraction_plan(c.items, c.files, _CORE, 2)


@query("item_freshness", "SELECT family, CASE WHEN i.txt_hash = f.content_hash THEN 'current' ELSE 'stale' END AS freshness, count(*)::BIGINT AS n FROM fx_clause_item i JOIN fx_files f USING (file_key) GROUP BY ALL")
def item_freshness(c):
    rows = c.items.join(c.files.select("file_key", "content_hash"), "file_key")
    return rows.groupBy("family", C.freshness(F.col("txt_hash"), F.col("content_hash")).alias("freshness")).agg(F.count(F.lit(1)).alias("n"))
