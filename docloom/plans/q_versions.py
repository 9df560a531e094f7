"""Queries on version roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import versions as V
from docloom.plans.registry import query

# File names of every kind: each rule, both parties, ordinals alone, weak tokens, none.
_STEMS = ["SPA_signed_", "SPA_signing draft ", "SHA_final_", "SHA_final_redline_", "bid_BIDDING_", "SPA_buyer_", "SPA_Seller_v1_", "SPA_buyer seller draft_", "SPA_buyer vs seller_", "SHA_1st_", "SHA_2nd draft_", "SPA_buyer 3rd_", "SSA_mark-up_", "SSA_draft_", "MOU_v1_", "MOU_clean_", "notes_", "SPA_매수인 초안_", "SHA_체결_", "ATA_제출본_"]


def _named(c):
    stem = F.element_at(F.array(*[F.lit(x) for x in _STEMS]), (F.col("doc_id") % len(_STEMS) + 1).cast("int"))
    return c.files.select("file_key", F.concat(stem, F.col("doc_id").cast("string"), F.lit(".docx")).alias("filename"))


def _hits(**kinds):
    return ", ".join(f"list_filter({tokens}, lambda t: contains(n, t)) AS {k}" for k, tokens in kinds.items())


_KINDS = _hits(
    xs=["체결", "execution", "signed", "signing", "exec_", "_exec", "최종본", "definitive"],
    xw=["final", "fnl"],
    bs=["bidding"],
    bw=["제출본"],
    ms=["markup", "mark-up", "mark up", "redline", "수정", "코멘트", "comment"],
    mw=["1st", "2nd", "3rd"],
    ds=["draft", "초안"],
    dw=["_v1", "내부", "안)"],
    pb=["buyer", "매수인"],
    ps=["seller", "매도인"],
)
_CLASS = f"""h AS (SELECT file_key, {_KINDS} FROM (SELECT file_key, lower({_STEMS}[doc_id % {len(_STEMS)} + 1] || doc_id || '.docx') AS n FROM fx_files)),
s AS (SELECT *, len(ms || mw || ds || dw) > 0 AS staged, CASE WHEN len(pb) > 0 THEN 'buyer' WHEN len(ps) > 0 THEN 'seller' END AS party, len(pb) > 0 AND len(ps) > 0 AS two,
  CASE WHEN len(ms || mw) > 0 THEN 'markup' WHEN len(ds || dw) > 0 THEN 'draft' END AS stage, CASE WHEN len(ms || mw) > 0 THEN len(ms) > 0 ELSE len(ds) > 0 END AS explicit, CASE WHEN len(ms || mw) > 0 THEN ms || mw ELSE ds || dw END AS said FROM h),
cls AS (SELECT file_key,
  CASE WHEN len(xs || xw) > 0 THEN 'execution' WHEN len(bs || bw) > 0 THEN 'bidding' WHEN party IS NOT NULL AND stage IS NOT NULL THEN party || '_' || stage WHEN party IS NOT NULL THEN party || '_ver' WHEN stage IS NOT NULL THEN stage || '_unknown' ELSE 'unknown' END AS role,
  CASE WHEN len(xs) > 0 THEN CASE WHEN staged THEN 'med' ELSE 'high' END WHEN len(xw) > 0 THEN CASE WHEN staged THEN 'low' ELSE 'med' END
    WHEN len(bs) > 0 THEN 'high' WHEN len(bw) > 0 THEN 'med'
    WHEN party IS NOT NULL AND stage IS NOT NULL THEN CASE WHEN explicit AND NOT two THEN 'high' WHEN explicit OR NOT two THEN 'med' ELSE 'low' END
    WHEN party IS NOT NULL THEN CASE WHEN two THEN 'low' ELSE 'med' END WHEN stage IS NOT NULL AND explicit THEN 'med' ELSE 'low' END AS confidence,
  array_to_string(CASE WHEN len(xs || xw) > 0 THEN xs || xw WHEN len(bs || bw) > 0 THEN bs || bw WHEN party IS NOT NULL AND stage IS NOT NULL THEN pb || ps || said WHEN party IS NOT NULL THEN pb || ps ELSE said END, '|') AS basis FROM s)"""


def _project(c):
    """Files under projects of several types, without the seller's drafts, so that one author is left."""
    return c.files.filter("doc_id % 8 <> 2").withColumn("project", F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string"))).withColumn("ctype", F.lit("any"))


_PROJ = "SELECT * REPLACE ('any' AS ctype), 'p' || (doc_id % 5) AS project FROM fx_files WHERE doc_id % 8 <> 2"


@query("version_roles", f"WITH {_CLASS} SELECT file_key, role, confidence, basis FROM cls")
def version_roles(c):
    return _named(c).select("file_key", V.classify(F.col("filename")).alias("v")).select("file_key", "v.*")


@query("version_distribution", f"WITH {_CLASS} SELECT 'role' AS kind, role AS value, count(*)::BIGINT AS n FROM cls GROUP BY ALL UNION ALL SELECT 'confidence', coalesce(confidence, 'unrated'), count(*) FROM cls GROUP BY ALL")
def version_distribution(c):
    rows = _named(c).select(V.classify(F.col("filename")).alias("v")).select("v.*")
    pairs = F.explode(F.array(F.struct(F.lit("role").alias("kind"), F.col("role").alias("value")), F.struct(F.lit("confidence").alias("kind"), F.coalesce("confidence", F.lit("unrated")).alias("value"))))
    return rows.select(pairs.alias("p")).groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))


@query("markup_rounds", "SELECT file_key, nullif(regexp_extract(lower(filename), '([0-9]+)\\s*(?:st|nd|rd|th)\\b', 1), '')::INTEGER AS round FROM fx_files")
def markup_rounds(c):
    return c.files.select("file_key", V.markup_round(F.col("filename")).alias("round"))


_PARTIES = f"""WITH p AS ({_PROJ}), m AS (SELECT *, nullif(regexp_extract(lower(filename), '([0-9]+)(?:st|nd|rd|th)', 1), '')::INTEGER AS rnd, list(DISTINCT CASE WHEN version_role IN ('buyer_draft','seller_draft') THEN split_part(version_role, '_', 1) END) FILTER (version_role IN ('buyer_draft','seller_draft')) OVER (PARTITION BY ctype, lang, project) AS authors FROM p)
 SELECT file_key, version_role, CASE WHEN one THEN CASE WHEN rnd % 2 = 1 THEN CASE WHEN authors[1] = 'buyer' THEN 'seller' ELSE 'buyer' END ELSE authors[1] END || '_markup' ELSE version_role END AS resolved_role, CASE WHEN one THEN 'low' ELSE version_confidence END AS resolved_confidence FROM (SELECT *, version_role = 'markup_unknown' AND coalesce(len(authors), 0) = 1 AND rnd IS NOT NULL AS one FROM m)"""


@query("markup_parties", f"SELECT * EXCLUDE (version_role) FROM ({_PARTIES})")
def markup_parties(c):
    return V.resolve_parties(_project(c)).select("file_key", "resolved_role", "resolved_confidence")


_LABELS = "(VALUES " + ",".join(f"('{k}','{v}')" for k, v in V.LABELS.items()) + ") l(role, label)"


@query("version_labels", f"SELECT file_key, label, confidence, review_required, label || ' · ' || confidence || CASE WHEN review_required THEN ' · review' ELSE '' END AS summary FROM (SELECT file_key, label, coalesce(version_confidence, 'unrated') AS confidence, version_role = 'unknown' OR coalesce(version_confidence, 'unrated') IN ('low','unrated') AS review_required FROM fx_files JOIN {_LABELS} ON role = version_role)")
def version_labels(c):
    return V.annotate(c.files).select("file_key", "label", "confidence", "review_required", "summary")


_WHY = "CASE WHEN version_role IN ('execution','buyer_markup') THEN NULL WHEN version_role = 'unknown' THEN 'version_unknown' WHEN version_role IN ('markup_unknown', 'buyer_ver') THEN 'partial_version' WHEN coalesce(version_confidence, 'unrated') IN ('low','unrated') THEN 'low_confidence' END"


@query("version_notice", f"""SELECT count(*) FILTER (m)::BIGINT AS matched, count(*) FILTER (m AND lvl = 'low')::BIGINT AS matched_low, count(*) FILTER (NOT m)::BIGINT AS excluded, count(*) FILTER (why = 'version_unknown')::BIGINT AS excluded_unknown, count(*) FILTER (why = 'partial_version')::BIGINT AS excluded_partial, count(*) FILTER (why = 'low_confidence')::BIGINT AS excluded_low, count(*) FILTER (NOT m AND lvl = 'unrated')::BIGINT AS excluded_unrated
 FROM (SELECT version_role IN ('execution','buyer_markup') AS m, coalesce(version_confidence, 'unrated') AS lvl, {_WHY} AS why FROM fx_files)""")
def version_notice(c):
    return V.filter_notice(c.files, V.resolve_filter("Execution version, buyermarkup"))


@query("version_review_sample", f"SELECT file_key, why, total, place FROM (SELECT file_key, why, count(*) OVER (PARTITION BY why)::BIGINT AS total, (row_number() OVER (PARTITION BY why ORDER BY file_key))::INTEGER AS place FROM (SELECT file_key, {_WHY} AS why FROM fx_files) WHERE why IS NOT NULL) WHERE place <= 20")
def version_review_sample(c):
    rows = c.files.select("file_key", V.exclusion_reason(V.resolve_filter(["execution", "buyer_markup"])).alias("why")).filter("why is not null")
    return V.capped_per(rows, "why", ["file_key"], 20)


@query("effective_type", "SELECT file_key, CASE WHEN starts_with(path, 'src1/') THEN 'SPA' WHEN starts_with(path, 'src2/') THEN 'SHA' WHEN regexp_matches(lower(filename), '(^|_)mou(_|$)') THEN 'MOU' ELSE ctype END AS effective, NOT regexp_matches(lower(filename), 'notes|bidding') AS is_primary FROM fx_files")
def effective_type(c):
    rules = c.small([(1, "src1/", "SPA"), (2, "src2/", "SHA")], "ord int, prefix string, value string")
    hit = c.files.join(F.broadcast(rules), F.expr("startswith(path, prefix)")).groupBy("file_key").agg(F.min_by("value", "ord").alias("by_path"))
    name = F.when(F.lower("filename").rlike("(^|_)mou(_|$)"), "MOU")
    return c.files.join(hit, "file_key", "left").select("file_key", F.coalesce("by_path", name, "ctype").alias("effective"), (~F.lower("filename").rlike("notes|bidding")).alias("is_primary"))


@query("project_keys", """WITH w AS (SELECT file_key, path, list_filter(string_split(regexp_replace(regexp_replace(lower(filename), '\\.[a-z0-9]+$', ''), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ('draft','markup','signed','final','st','nd')) AS ws FROM fx_files),
 a AS (SELECT *, list_position(list_transform(ws, lambda x: x IN ('spa','sha','mou')), true) AS pos FROM w)
 SELECT file_key, CASE WHEN len(ws) = 0 THEN substr(sha1(path), 1, 12) WHEN pos > 0 THEN array_to_string(ws[1:pos], ' ') ELSE array_to_string(ws[1:3], ' ') END AS project FROM a""")
def project_keys(c):
    return c.files.select("file_key", V.project_key(F.col("path"), ["draft", "markup", "signed", "final", "st", "nd"], ["spa", "sha", "mou"]).alias("project"))


_TIER = "CASE WHEN version_role = 'execution' THEN 0 WHEN version_role IN ('seller_draft', 'buyer_draft', 'draft_unknown') THEN 2 WHEN version_role IN ('seller_markup', 'buyer_markup', 'markup_unknown', 'bidding') THEN 3 WHEN version_role IN ('buyer_ver', 'seller_ver') THEN 4 WHEN version_role = 'unknown' THEN 5 ELSE 9 END"


@query("priority_tiers", f"SELECT file_key, project, CASE WHEN row_number() OVER (PARTITION BY ctype, lang, project ORDER BY {_TIER}, file_key) = 1 THEN 1 ELSE 2 END AS tier FROM ({_PROJ})")
def priority_tiers(c):
    return V.tiers(_project(c)).select("file_key", "project", "tier")


@query("version_backfill", f"SELECT file_key, version_role AS old_role, resolved_role AS new_role FROM ({_PARTIES}) WHERE version_role <> resolved_role")
def version_backfill(c):
    """Dry run of the backfill: rows whose role changes once parties are inferred."""
    rows = V.resolve_parties(_project(c))
    return rows.filter("version_role <> resolved_role").select("file_key", F.col("version_role").alias("old_role"), F.col("resolved_role").alias("new_role"))
