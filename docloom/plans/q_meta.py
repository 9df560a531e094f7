"""Queries on document metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import metadata as M
from docloom.plans.registry import query

BANDS = [("small", 0, 5e8), ("middle", 5e8, 2e9), ("large", 2e9, 1e15)]
_P = "(clause_map_json::JSON->'{t}'->>'present')::BOOLEAN"


@query("metadata_left_join", "SELECT f.file_key, coalesce(m.confidence, 'unevaluated') AS confidence, m.meta_schema_version FROM fx_files f LEFT JOIN fx_doc_meta m USING (file_key)")
def metadata_left_join(c):
    return c.files.join(c.doc_meta, "file_key", "left").select("file_key", F.coalesce("confidence", F.lit("unevaluated")).alias("confidence"), "meta_schema_version")


@query("clause_rows", "SELECT file_key, tag, (clause_map_json::JSON->tag->>'present')::BOOLEAN AS present, (clause_map_json::JSON->tag->>'loc_start')::INTEGER AS loc_start, (clause_map_json::JSON->tag->>'loc_end')::INTEGER AS loc_end FROM (SELECT *, unnest(json_keys(clause_map_json::JSON)) AS tag FROM fx_doc_meta)")
def clause_rows(c):
    return M.clause_rows(c.doc_meta).select("file_key", "tag", "present", "loc_start", "loc_end")


def _clause(tag, present):
    p = _P.replace("{t}", tag)
    answer = f"CASE WHEN {p} IS NULL THEN 'needs_review' WHEN {p} THEN 'match' ELSE 'no_match' END" if present else f"CASE WHEN {p} IS NULL THEN 'needs_review' WHEN {p} THEN 'no_match' WHEN coalesce(confidence, 'low') <> 'low' THEN 'match' ELSE 'needs_review' END"
    return f"SELECT f.file_key, {answer} AS answer, CASE WHEN ({answer}) = 'needs_review' THEN CASE WHEN {p} IS NULL THEN 'not_evaluated' ELSE 'low_confidence' END END AS reason FROM fx_files f LEFT JOIN fx_doc_meta m USING (file_key) WHERE f.status = 'ok'"


@query("clause_present", _clause("law", True))
def clause_present(c):
    return M.clause_filter(c.files, c.doc_meta, "law", True)


@query("clause_absent", _clause("indemnity", False))
def clause_absent(c):
    return M.clause_filter(c.files, c.doc_meta, "indemnity", False)


_STATE = f"st AS (SELECT f.file_key, CASE WHEN {_P.format(t='law')} IS NULL THEN 'unevaluated' WHEN NOT {_P.format(t='law')} THEN 'absent' ELSE 'ok' END AS state, m.txt_hash <> f.content_hash AS stale, (clause_map_json::JSON->'law'->>'loc_start')::INTEGER AS loc_start, (clause_map_json::JSON->'law'->>'loc_end')::INTEGER AS loc_end FROM fx_files f LEFT JOIN fx_doc_meta m USING (file_key) WHERE f.status = 'ok')"


@query("clause_status", f"WITH {_STATE} SELECT * FROM st")
def clause_status(c):
    return M.clause_status(c.files, c.doc_meta, "law")


@query("clause_windows", f"WITH {_STATE} SELECT p.file_key, p.para, p.content, p.para BETWEEN loc_start AND loc_end AS inside FROM fx_paragraphs p JOIN st USING (file_key) WHERE state = 'ok' AND p.para BETWEEN loc_start - 1 AND loc_end + 1")
def clause_windows(c):
    return M.clause_window(M.clause_status(c.files, c.doc_meta, "law"), c.paragraphs, 1)


_TRI = """tri AS (SELECT f.file_key, CASE WHEN (parties_json::JSON->>'evaluated')::BOOLEAN THEN contains(lower(parties_json::JSON->'items'->0->>'name'), 'src1') END AS c1, CASE WHEN (parties_json::JSON->>'evaluated')::BOOLEAN THEN (parties_json::JSON->'items'->0->>'role') = 'buyer' END AS c2,
 CASE WHEN (consideration_json::JSON->>'evaluated')::BOOLEAN THEN CASE WHEN json_exists(consideration_json::JSON, '$.payment_methods') THEN true END END AS c3, (consideration_json::JSON->>'amount_value')::DOUBLE >= 1e9 AS c4 FROM fx_files f LEFT JOIN fx_doc_meta m USING (file_key) WHERE f.status = 'ok'),
 ans AS (SELECT file_key, CASE WHEN c1 IS NULL THEN 'needs_review' WHEN NOT c1 THEN 'no_match' WHEN c2 IS NULL THEN 'needs_review' WHEN NOT c2 THEN 'no_match' WHEN c3 IS NULL THEN 'needs_review' WHEN NOT c3 THEN 'no_match' WHEN c4 IS NULL THEN 'needs_review' WHEN NOT c4 THEN 'no_match' ELSE 'match' END AS answer,
 CASE WHEN c1 IS NULL OR NOT c1 THEN 'party' WHEN c2 IS NULL OR NOT c2 THEN 'role' WHEN c3 IS NULL OR NOT c3 THEN 'method' WHEN c4 IS NULL OR NOT c4 THEN 'least' END AS decided_by FROM tri)"""


def _structured(c):
    return M.structured_filter(c.files, c.doc_meta, party="src1", role="buyer", method="cash", least=1e9)


@query("structured_filter", f"WITH {_TRI} SELECT * FROM ans")
def structured_filter(c):
    return _structured(c)


_FACT_JSON = """'{"indemnity":{"present":' || CASE WHEN d % 4 = 2 THEN 'false' ELSE 'true' END || CASE WHEN d % 7 = 0 THEN '}' ELSE ',"normalized":{"cap_pct_of_price":' || (d % 31) || CASE WHEN d % 5 = 1 THEN ',"survival_months":' || (d % 37) ELSE '' END || '}}' END
 || CASE WHEN d % 3 = 1 THEN ',"warranty":{"normalized":{"survival_months":' || (d % 25) || '}}' ELSE '' END || CASE WHEN d % 6 = 5 THEN '' ELSE ',"law":{"normalized":{"law":"' || CASE WHEN d % 2 = 0 THEN 'Laws of  Korea' ELSE 'English law' END || '"}}' END
 || ',"forum":{"normalized":{' || CASE d % 4 WHEN 0 THEN '"forum":"court"' WHEN 1 THEN '"institution_or_court":"Seoul Court"' WHEN 2 THEN '"forum":"arbitration"' ELSE '' END || '}}}'"""
_FACTS = f"""m AS (SELECT f.file_key, d, meta_schema_version AS v, parties_json::JSON AS p, consideration_json::JSON AS c, ({_FACT_JSON})::JSON AS j FROM (SELECT *, doc_id AS d FROM fx_files WHERE status = 'ok') f LEFT JOIN fx_doc_meta m USING (file_key)),
 k AS (SELECT file_key, CASE WHEN coalesce(v, 0) >= 3 THEN true END AS k0, CASE WHEN (p->>'evaluated')::BOOLEAN THEN contains(lower(p->'items'->0->>'name'), 'src') AND contains(lower(p->'items'->0->>'role'), 'buy') END AS k1,
  CASE WHEN (c->>'evaluated')::BOOLEAN AND json_exists(c, '$.payment_methods') THEN true END AS k2, CASE WHEN (c->>'evaluated')::BOOLEAN THEN (c->>'amount_value')::DOUBLE BETWEEN 5e7 AND 1e12 END AS k3,
  CASE WHEN (j->'indemnity'->>'present')::BOOLEAN THEN (j->'indemnity'->'normalized'->>'cap_pct_of_price')::DOUBLE <= 28 END AS k4,
  coalesce((j->'warranty'->'normalized'->>'survival_months')::DOUBLE, (j->'indemnity'->'normalized'->>'survival_months')::DOUBLE) BETWEEN 2 AND 30 AS k5,
  contains(lower(regexp_replace(j->'law'->'normalized'->>'law', ' +', ' ', 'g')), 'of korea') AS k6,
  CASE WHEN coalesce(j->'forum'->'normalized'->>'forum', j->'forum'->'normalized'->>'institution_or_court') IS NOT NULL THEN contains(lower(coalesce(j->'forum'->'normalized'->>'forum', '') || '|' || coalesce(j->'forum'->'normalized'->>'institution_or_court', '')), 'court') END AS k7 FROM m)"""
#: One buyer, and an amount up to 1e10.
_FACT_FILTER = """fk AS (SELECT file_key, CASE WHEN coalesce(meta_schema_version, 0) >= 3 THEN true END AS k0, CASE WHEN (parties_json::JSON->>'evaluated')::BOOLEAN THEN contains(lower(parties_json::JSON->'items'->0->>'role'), 'buyer') END AS k1,
  CASE WHEN (consideration_json::JSON->>'evaluated')::BOOLEAN THEN (consideration_json::JSON->>'amount_value')::DOUBLE BETWEEN 0 AND 1e10 END AS k2 FROM fx_files f LEFT JOIN fx_doc_meta m USING (file_key) WHERE f.status = 'ok'),
 facts AS (SELECT file_key, CASE WHEN k0 IS NULL OR k1 IS NULL THEN 'needs_review' WHEN NOT k1 THEN 'no_match' WHEN k2 IS NULL THEN 'needs_review' WHEN NOT k2 THEN 'no_match' ELSE 'match' END AS answer FROM fk)"""
_FACT_NAMES = ["version", "party", "method", "amount", "cap_pct", "survival_months", "law", "forum"]


@query("facts_filter", f"WITH {_FACTS} SELECT file_key, CASE {' '.join(f"WHEN k{i} IS NULL THEN 'needs_review' WHEN NOT k{i} THEN 'no_match'" for i in range(8))} ELSE 'match' END AS answer, CASE {' '.join(f"WHEN k{i} IS NULL OR NOT k{i} THEN '{n}'" for i, n in enumerate(_FACT_NAMES))} END AS decided_by FROM k")
def facts_filter(c):
    """All ten structured filters at once."""
    meta = c.doc_meta.join(c.files.select("file_key", F.col("doc_id").alias("d")), "file_key").withColumn("clause_map_json", F.expr(_FACT_JSON))
    return M.facts_filter(c.files, meta, party="SRC", role="Buy", method="Cash", amount=(5e7, 1e12), cap_pct=(None, 28), survival_months=(2, 30), law="OF  korea", forum="court")


@query("structured_review", f"WITH {_TRI}, t AS (SELECT count(*) FILTER (answer = 'match')::BIGINT AS matches, count(*) FILTER (answer = 'needs_review')::BIGINT AS reviews FROM ans) SELECT a.*, t.*, reviews > 100 AS truncated FROM (SELECT * FROM ans WHERE answer = 'needs_review' ORDER BY file_key LIMIT 100) a, t")
def structured_review(c):
    return M.review_sample(_structured(c))


@query("to_extract", "SELECT f.file_key, CASE ctype WHEN 'SHA' THEN 1 WHEN 'SPA' THEN 2 ELSE 3 END AS rank, ctype, path FROM fx_files f WHERE status = 'ok' AND NOT EXISTS (SELECT 1 FROM fx_doc_meta m WHERE m.file_key = f.file_key AND m.txt_hash = f.content_hash AND meta_schema_version >= 3)")
def to_extract(c):
    return M.to_extract(c.files, c.doc_meta, 3, ["SHA", "SPA"])


_MISS = "miss AS (SELECT f.file_key, r.tag FROM fx_files f JOIN fx_doc_meta m USING (file_key) JOIN (VALUES ('SPA','indemnity'),('SPA','law'),('SPA','consideration'),('SHA','indemnity'),('SHA','law'),('SHA','transfer'),('SSA','indemnity'),('SSA','law'),('MOU','indemnity'),('MOU','law')) r(ctype, tag) USING (ctype) WHERE NOT json_exists(clause_map_json::JSON, '$.' || r.tag))"


@query("metadata_issues", f"WITH {_MISS} SELECT file_key, 'missing_tag' AS code, tag AS detail FROM miss UNION ALL SELECT file_key, 'old_schema', meta_schema_version::VARCHAR FROM fx_doc_meta WHERE meta_schema_version < 3 UNION ALL SELECT file_key, 'no_amount', '' FROM fx_doc_meta WHERE (consideration_json::JSON->>'amount_value') IS NULL")
def metadata_issues(c):
    return M.schema_issues(c.files, c.doc_meta)


_SIZE = """sz AS (SELECT f.file_key, f.lang, f.ctype, CASE WHEN coalesce(meta_schema_version, 0) < 3 THEN 'schema' WHEN consideration_json IS NULL THEN 'not_evaluated' WHEN (consideration_json::JSON->>'amount_value') IS NULL THEN 'no_amount' WHEN ctype = 'MOU' THEN 'non_binding' WHEN coalesce(is_draft, 0) = 1 THEN 'draft' END AS why, (consideration_json::JSON->>'amount_value')::DOUBLE AS amt FROM fx_files f LEFT JOIN fx_doc_meta m USING (file_key) WHERE f.status = 'ok'),
 size AS (SELECT *, CASE WHEN why IS NULL THEN CASE WHEN amt < 5e8 THEN 'small' WHEN amt < 2e9 THEN 'middle' WHEN amt < 1e15 THEN 'large' END ELSE 'unknown' END AS value FROM sz)"""


@query("deal_size", f"WITH {_SIZE} SELECT file_key, value, CASE WHEN why IS NULL THEN 'high' ELSE 'low' END AS confidence, coalesce(why, 'amount') AS basis FROM size")
def deal_size(c):
    return M.deal_size(c.files, c.doc_meta, BANDS)


@query("deal_axis_summary", f"WITH {_SIZE}, p AS (SELECT unnest(['value','lang','ctype']) AS axis, unnest([value, lang, ctype]) AS value FROM size), k AS (SELECT axis, value, count(*)::BIGINT AS n FROM p GROUP BY ALL) SELECT * FROM (SELECT axis, value, n, sum(n) OVER (PARTITION BY axis)::BIGINT AS documents, round_even(100.0::DOUBLE * sum(CASE WHEN value <> 'unknown' THEN n ELSE 0 END) OVER (PARTITION BY axis) / sum(n) OVER (PARTITION BY axis), 1) AS populated, (row_number() OVER (PARTITION BY axis ORDER BY n DESC, value))::INTEGER AS place FROM k) WHERE place <= 12")
def deal_axis_summary(c):
    rows = M.deal_size(c.files, c.doc_meta, BANDS).join(c.files.select("file_key", "lang", "ctype"), "file_key")
    return M.axis_summary(rows, ["value", "lang", "ctype"])


@query("clause_evidence", f"WITH {_STATE} SELECT f.file_key, CASE st.state WHEN 'ok' THEN 'present' WHEN 'absent' THEN 'absent' ELSE 'unknown' END AS clause, f.dup_group FROM (SELECT * FROM fx_files WHERE status = 'ok' ORDER BY file_key LIMIT 40) f JOIN st USING (file_key)")
def clause_evidence(c):
    """Clause state for the files of a page."""
    page = c.files.filter("status = 'ok'").orderBy("file_key").limit(40).select("file_key", "dup_group")
    state = M.clause_status(c.files, c.doc_meta, "law").join(F.broadcast(page), "file_key")
    return state.select("file_key", F.when(F.col("state") == "ok", "present").when(F.col("state") == "absent", "absent").otherwise("unknown").alias("clause"), "dup_group")
