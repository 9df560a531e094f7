"""Queries on ranked clause search, reviewers' reports and deal facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import clauses as C
from docloom.operators import deal_facts as D
from docloom.operators import review as R
from docloom.plans.q_clauses import _FOUND, _sub, coverage
from docloom.plans.registry import query

_APPROVED = " AND review_status = 'approved'"
_FIRST = "SELECT *, first_value(file_key) OVER (PARTITION BY dup_group ORDER BY {order}) AS rep FROM ranked"
_PAGE = " SELECT file_key, item_ref, freshness, coverage FROM r WHERE rep = file_key ORDER BY {order} LIMIT {limit} OFFSET {offset}"
_HAS = "contains(lower(verbatim), '{t}')"


def _bm25(word: str, hits: str) -> str:
    tf = f"((length(verbatim) - length(replace(lower(verbatim), '{word}', ''))) / {len(word)})"
    return f"-(greatest(ln((n - {hits} + 0.5) / ({hits} + 0.5)), 1e-6) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * greatest(length(verbatim) - 2, 0) / avglen)))"


def _items(c):
    """Clause items with the subject and time that the search filters by."""
    d = F.col("doc_id")
    return c.items.withColumns({"subject_role": F.when(d % 2 == 0, "Seller").otherwise("buyer"), "effective_time": F.when(d % 3 == 0, "Closing")})


def _search(c, root, **filters):
    return C.clause_search(_items(c), c.nodes, c.files, coverage(c), root, **filters)


_RANKED = (
    _FOUND
    + _sub("RW")
    + _APPROVED
    + f""" AND i.doc_id % 2 = 0 AND {_HAS.format(t="there")} AND {_HAS.format(t="and")} AND {_HAS.format(t="of")}),
 st AS (SELECT count(*)::DOUBLE AS n, avg(greatest(length(verbatim) - 2, 0)) AS avglen, count(*) FILTER ({_HAS.format(t="there")}) AS h0, count(*) FILTER ({_HAS.format(t="and")}) AS h1 FROM fx_clause_item),
 ranked AS (SELECT rows.*, CASE WHEN {_HAS.format(t="there and of")} THEN 0 ELSE 1 END AS apart, round({_bm25("there", "h0")} + {_bm25("and", "h1")}, 12) AS score FROM rows, st)"""
)
_BY_SCORE = "apart, score, length(verbatim), file_key, loc_start, item_ref"


@query("clause_search_ranked", f"{_RANKED}, r AS ({_FIRST.format(order=_BY_SCORE)})" + _PAGE.format(order=_BY_SCORE, limit=30, offset=5))
def clause_search_ranked(c):
    rows = _search(c, "RW", subject="seller", text="there and of")
    return C.search_page(rows, 30, 5).select("file_key", "item_ref", "freshness", "coverage")


_BY_PLACE = "-(CASE WHEN contains(lower(verbatim), 'is') THEN 1 ELSE 0 END + CASE WHEN contains(lower(verbatim), 'of') THEN 1 ELSE 0 END), CASE WHEN contains(lower(verbatim), 'is of') THEN 0 ELSE 1 END, instr(lower(verbatim), 'is'), length(verbatim), file_key, loc_start, item_ref"


@query("clause_search_short", _FOUND + _sub("CP") + _APPROVED + f" AND i.doc_id % 3 = 0 AND contains(lower(verbatim), 'is') AND contains(lower(verbatim), 'of')), ranked AS (SELECT * FROM rows), r AS ({_FIRST.format(order=_BY_PLACE)})" + _PAGE.format(order=_BY_PLACE, limit=25, offset=0))
def clause_search_short(c):
    rows = _search(c, "CP", effective_time="closing", text="is of")
    return C.search_page(rows, 25).select("file_key", "item_ref", "freshness", "coverage")


@query(
    "clause_search_summary",
    _FOUND
    + _sub("RW")
    + _APPROVED
    + f"""), r AS (SELECT *, first_value(file_key) OVER (PARTITION BY dup_group ORDER BY file_key, loc_start, item_ref) AS rep FROM rows), k AS (SELECT * FROM r WHERE rep = file_key),
 t AS (SELECT 'bare' AS search, count(*) AS n, count(DISTINCT file_key) AS d, count(*) FILTER (freshness = 'stale') AS s FROM k UNION ALL SELECT 'absent', count(*), count(DISTINCT file_key), count(*) FILTER (freshness = 'stale') FROM rows WHERE {_HAS.format(t="there")} AND {_HAS.format(t="qzxqzx")})
 SELECT search, n::BIGINT AS total_items, d::BIGINT AS total_documents, s::BIGINT AS total_stale, least(n, 50)::BIGINT AS returned_items, n > 50 AS has_more, CASE WHEN n > 50 THEN 50::BIGINT END AS next_offset, n > 200 AND search = 'bare' AS low_signal, n = 0 AND search = 'absent' AS zero_result FROM t""",
)
def clause_search_summary(c):
    bare = C.search_summary(_search(c, "RW"), 50).withColumn("search", F.lit("bare"))
    absent = C.search_summary(_search(c, "RW", text="there qzxqzx"), 50, text=True).withColumn("search", F.lit("absent"))
    return bare.unionByName(absent)


_POOL = """WITH p AS (SELECT file_key, coalesce(dup_group, file_key) AS dup_group FROM fx_files f WHERE status = 'ok' AND coalesce(char_count, 0) > 0 AND file_key IN (SELECT file_key FROM fx_document_coverage WHERE family = 'RW' AND body_status = 'complete') AND file_key NOT IN (SELECT file_key FROM fx_clause_item WHERE taxonomy_id = 'RW.B' OR starts_with(taxonomy_id, 'RW.B.'))),
 h AS (SELECT file_key, list_sort(list(DISTINCT word)) AS found FROM fx_paragraphs JOIN (VALUES ('with'),('License'),('whst')) w(word) ON contains(lower(content), lower(word)) WHERE file_key IN (SELECT file_key FROM p) GROUP BY 1),
 pool AS (SELECT p.file_key, dup_group, CASE WHEN p.file_key NOT IN (SELECT file_key FROM fx_paragraphs) THEN 'no_txt' WHEN found IS NOT NULL THEN 'suspect' ELSE 'clean_absent' END AS cls, coalesce(array_to_string(found[1:5], '|'), '') AS matched_terms, p.file_key = min(p.file_key) OVER (PARTITION BY dup_group) AS representative FROM p LEFT JOIN h ON h.file_key = p.file_key)"""


def _pool(c):
    return R.absence_pool(c.files, c.document_coverage, c.items, c.paragraphs, "RW.B", c.small([("with",), ("License",), ("whst",)], "word string"))


@query("absence_pool", f"{_POOL} SELECT * FROM pool")
def absence_pool(c):
    return _pool(c)


@query("absence_pool_report", f"{_POOL}, t AS (SELECT count(*)::BIGINT AS pool_raw, count(*) FILTER (representative)::BIGINT AS pool_deduped, count(*) FILTER (representative AND cls = 'clean_absent')::BIGINT AS clean_absent, count(*) FILTER (representative AND cls = 'suspect')::BIGINT AS suspect, count(*) FILTER (representative AND cls = 'no_txt')::BIGINT AS no_txt FROM pool) SELECT *, round_even(suspect / nullif(pool_deduped, 0)::DOUBLE, 4) AS suspect_rate FROM t")
def absence_pool_report(c):
    return R.pool_report(_pool(c))


LEAVES = [("RW.A.N1", "(?i)there.{0,60}license|license.{0,60}there"), ("RW.B.N2", "(?i)whst"), ("CP.A.N3", "(?i)\\bwith\\b"), ("CP.A.N4", "zzzqqq")]
_LEAF = "WITH leaf AS (SELECT * FROM (VALUES ('RW.A.N1','(?i)there.{0,60}license|license.{0,60}there'),('RW.B.N2','(?i)whst'),('CP.A.N3','(?i)\\bwith\\b'),('CP.A.N4','zzzqqq')) v(taxonomy_id, pattern)), hits AS (SELECT taxonomy_id, file_key, min(para) AS para FROM fx_paragraphs JOIN leaf ON regexp_matches(content, pattern) GROUP BY ALL)"


@query("leaf_gaps", f"{_LEAF}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY taxonomy_id ORDER BY file_key)::INTEGER AS nth, count(*) OVER (PARTITION BY taxonomy_id) AS k FROM hits) WHERE nth <= 5) SELECT leaf.taxonomy_id, coalesce(k, 0)::BIGINT AS documents, nth, top.file_key, top.para, substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 320) AS evidence FROM leaf LEFT JOIN top ON top.taxonomy_id = leaf.taxonomy_id LEFT JOIN fx_paragraphs p ON p.file_key = top.file_key AND p.para = top.para")
def leaf_gaps(c):
    return R.leaf_gaps(c.paragraphs, c.small(LEAVES, "taxonomy_id string, pattern string"))


@query("leaf_ranking", f"{_LEAF} SELECT file_key, count(*)::BIGINT AS hit_count FROM hits GROUP BY 1")
def leaf_ranking(c):
    return R.leaf_ranking(c.paragraphs, c.small(LEAVES, "taxonomy_id string, pattern string"))


RULES = [(1, "(?i)there", None, "RW.A"), (2, "(?i)whst", "(?i)license", "CP.A"), (3, "(?i)\\bwith\\b", None, "RW.B"), (4, "(?i)license", None, "REM.Q")]
_REVIEW = """WITH k AS (SELECT candidate_id, family, verbatim, CASE WHEN (candidate_id // 1000000) % 3 = 0 THEN 'annex' ELSE 'body' END AS source_kind FROM fx_candidate WHERE status = 'pending'),
 l AS (SELECT candidate_id, list(label ORDER BY ord) AS ls FROM k JOIN (VALUES (1,'(?i)there',NULL,'RW.A'),(2,'(?i)whst','(?i)license','CP.A'),(3,'(?i)\\bwith\\b',NULL,'RW.B'),(4,'(?i)license',NULL,'REM.Q')) r(ord,p,np,label) ON regexp_matches(verbatim, p) AND (np IS NULL OR NOT regexp_matches(verbatim, np)) GROUP BY 1),
 n AS (SELECT candidate_id, string_agg(u, '|' ORDER BY u) FILTER (f IS NULL) AS unknown, count(DISTINCT f) AS fams, min(f) AS fam FROM (SELECT candidate_id, u, n.family AS f FROM (SELECT candidate_id, unnest(ls) AS u FROM l) LEFT JOIN fx_node n ON n.taxonomy_id = u) GROUP BY 1),
 v AS (SELECT k.candidate_id, family, coalesce(array_to_string(ls, '|'), '') AS labels, coalesce(unknown, '') AS unknown, fam, CASE WHEN ls IS NULL THEN CASE WHEN length(verbatim) < 60 THEN 'reject' ELSE 'unresolved' END WHEN unknown IS NOT NULL OR fams <> 1 OR (fam <> family AND source_kind <> 'body') THEN 'unresolved' ELSE 'merge' END AS verdict FROM k LEFT JOIN l ON l.candidate_id = k.candidate_id LEFT JOIN n ON n.candidate_id = k.candidate_id),
 rv AS (SELECT candidate_id, family, verdict, labels, CASE WHEN verdict = 'merge' THEN fam END AS target_family, unknown FROM v)"""


def _reviewed(c):
    kind = F.when(F.expr("(candidate_id div 1000000) % 3 = 0"), "annex").otherwise("body")
    return R.candidate_review(c.candidates.withColumn("source_kind", kind), c.small(RULES, "ord int, pattern string, not_pattern string, label string"), c.nodes, F.length("verbatim") < 60)


@query("candidate_review", f"{_REVIEW} SELECT * FROM rv")
def candidate_review(c):
    return _reviewed(c)


@query("candidate_review_groups", f"{_REVIEW}, g AS (SELECT verdict, family, target_family, CASE WHEN verdict = 'merge' THEN labels ELSE '' END AS labels, count(*)::BIGINT AS candidates FROM rv GROUP BY ALL) SELECT *, CASE WHEN verdict = 'merge' THEN candidates * len(string_split(labels, '|')) ELSE 0 END AS items, coalesce(target_family <> family, false) AS reassigned FROM g")
def candidate_review_groups(c):
    return R.review_groups(_reviewed(c))


@query("candidate_review_targets", f"{_REVIEW} SELECT kind, taxonomy_id, count(*)::BIGINT AS n FROM (SELECT 'target' AS kind, unnest(string_split(labels, '|')) AS taxonomy_id FROM rv WHERE verdict = 'merge' UNION ALL SELECT 'unknown', unnest(string_split(unknown, '|')) FROM rv WHERE unknown <> '') GROUP BY ALL")
def candidate_review_targets(c):
    return R.review_targets(_reviewed(c))


_TOC = "(regexp_matches(content, '\\.{3,}') OR (regexp_matches(content, '\\s[0-9]{1,3}$') AND length(content) < 80))"
_BLANK = "regexp_matches({}, '(\\[[^\\]]{{0,40}}\\]|_{{3,}}|\\{{[^}}]{{0,40}}\\}})')"
_BODY = "body AS (SELECT *, coalesce(string_agg(content, ' ') OVER (PARTITION BY file_key ORDER BY para ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before, string_agg(content, ' ') OVER (PARTITION BY file_key ORDER BY para ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS clause FROM fx_paragraphs WHERE NOT regexp_matches(content, '^\\[(header|footer)\\]'))"


def _clause(name: str, anchor: str, operative: list[str], skip: str = "false") -> str:
    op = "(" + " OR ".join(f"contains(lower(clause), '{w}')" for w in operative) + ")"
    return f"{name} AS (SELECT file_key, arg_min(clause, row(toc, NOT op, para)) AS clause, arg_min(NOT toc AND op, row(toc, NOT op, para)) AS settled FROM (SELECT *, {_TOC} AS toc, {op} AS op FROM body WHERE contains(lower(content), '{anchor}') AND NOT {skip}) GROUP BY 1)"


def _names(text: str, vocabulary: dict[str, list[str]]) -> str:
    each = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{name}' END" for name, words in sorted(vocabulary.items()))
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


_JURISDICTIONS = {"Xland": ["whst", "hat"], "Yland": ["hand"], "Zland": ["nter"]}


@query(
    "governing_law",
    f"""WITH {_BODY}, {_clause("cl", "there", ["with"], "contains(lower(before), 'license')")},
 d AS (SELECT f.file_key, clause, settled, list_filter(list_transform(string_split(regexp_replace(clause, '([.。])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: trim(s)), lambda s: s <> '' AND contains(lower(s), 'with')) AS ops FROM (SELECT DISTINCT file_key FROM fx_paragraphs) f LEFT JOIN cl ON cl.file_key = f.file_key),
 e AS (SELECT *, CASE WHEN len(ops) > 0 THEN array_to_string(ops, chr(31)) ELSE clause END AS scope FROM d), n AS (SELECT *, {_names("scope", _JURISDICTIONS)} AS hits, {_names("clause", _JURISDICTIONS)} AS every FROM e),
 r AS (SELECT *, CASE WHEN clause IS NULL THEN 'no_governing_law_clause_found' WHEN NOT settled THEN 'clause_not_localized' WHEN {_BLANK.format("clause")} THEN 'placeholder_in_clause' WHEN len(hits) = 0 THEN 'jurisdiction_not_named' WHEN len(hits) > 1 THEN 'multiple_jurisdictions_in_operative_sentence' ELSE 'governing_law_clause' END AS rule FROM n)
 SELECT file_key, CASE WHEN rule = 'governing_law_clause' THEN hits[1] END AS value, CASE WHEN rule = 'governing_law_clause' THEN CASE WHEN len(ops) > 0 THEN 'med' ELSE 'low' END END AS confidence, rule, CASE WHEN starts_with(rule, 'multiple') THEN array_to_string(hits, '|') ELSE '' END AS candidates,
 CASE WHEN rule IN ('governing_law_clause', 'jurisdiction_not_named') THEN array_to_string(list_filter(every, lambda x: NOT list_contains(hits, x)), '|') ELSE '' END AS conflicts FROM r""",
)
def governing_law(c):
    return D.governing_law(c.paragraphs, ["there"], ["with"], _JURISDICTIONS, skip=["license"])


_INSTITUTIONS = {"A": ["that"], "B": ["this"]}


@query(
    "forum",
    f"""WITH {_BODY}, {_clause("co", "and", ["there"])}, {_clause("ar", "whst", ["hand", "with"])},
 r AS (SELECT f.file_key, co.clause AS c, co.settled AS ok, ar.clause AS a, list_sort(list_distinct(regexp_extract_all(co.clause, '\\b(wh[a-z]{{2}})\\b', 1))) AS courts, nullif(regexp_extract(co.clause, '\\b(of [a-z]+)', 1), '') AS loose, coalesce(contains(lower(ar.clause), 'hand') OR contains(lower(ar.clause), 'with'), false) AS agreed, {_names("ar.clause", _INSTITUTIONS)} AS insts FROM (SELECT DISTINCT file_key FROM fx_paragraphs) f LEFT JOIN co ON co.file_key = f.file_key LEFT JOIN ar ON ar.file_key = f.file_key),
 q AS (SELECT *, CASE WHEN c IS NULL THEN 'no_forum_clause_found' WHEN NOT ok THEN 'clause_not_localized' WHEN len(courts) = 0 AND {_BLANK.format("c")} THEN 'placeholder_in_clause' WHEN len(courts) = 1 THEN 'forum_clause_named_court' WHEN len(courts) > 1 THEN 'multiple_courts_named' WHEN loose IS NOT NULL THEN 'forum_clause_loose_court' ELSE 'forum_clause_no_court_named' END AS court_rule FROM r),
 s AS (SELECT *, CASE court_rule WHEN 'forum_clause_named_court' THEN courts[1] WHEN 'forum_clause_loose_court' THEN loose END AS forum_court FROM q)
 SELECT file_key, CASE WHEN forum_court IS NOT NULL AND agreed THEN NULL WHEN agreed THEN 'arbitration' WHEN forum_court IS NOT NULL THEN 'court' END AS forum_type, CASE WHEN forum_court IS NOT NULL AND agreed THEN 'court_and_arbitration_both_present' WHEN agreed THEN 'arbitration_only' WHEN forum_court IS NOT NULL THEN 'court_forum_only' ELSE 'forum_not_determined' END AS type_rule, forum_court, court_rule, agreed AS arbitration,
 CASE WHEN a IS NULL THEN 'no_arbitration_anchor' WHEN agreed THEN 'arbitration_agreement' ELSE 'arbitration_mentioned_without_agreement' END AS arbitration_rule, CASE WHEN agreed AND len(insts) = 1 THEN insts[1] END AS institution,
 CASE WHEN a IS NULL THEN 'no_arbitration_clause' WHEN NOT agreed THEN 'no_arbitration_agreement' WHEN len(insts) = 1 THEN 'arbitration_institution_named' WHEN len(insts) > 1 THEN 'multiple_institutions_named' ELSE 'institution_not_named' END AS institution_rule, CASE WHEN agreed THEN nullif(regexp_extract(a, '(?:with|hand) ([a-z]+)', 1), '') END AS seat FROM s""",
)
def forum(c):
    return D.forum(c.paragraphs, ["and"], ["there"], r"\b(wh[a-z]{2})\b", ["whst"], ["hand", "with"], _INSTITUTIONS, "(?:with|hand) ([a-z]+)", r"\b(of [a-z]+)")


_TRAPS = ["license", "there", "whst", "und", "la", "with"]


@query("industry_traps", "SELECT file_key, NULL::VARCHAR AS value, 'not_locally_derivable' AS rule, array_to_string(list_filter([" + ", ".join(f"CASE WHEN bool_or(contains(content, '{t}')) THEN '{t}' END" for t in _TRAPS) + "], lambda x: x IS NOT NULL)[1:4], '|') AS traps FROM (SELECT file_key, CASE WHEN NOT regexp_matches(content, '^\\[(header|footer)\\]') THEN content END AS content FROM fx_paragraphs) GROUP BY 1")
def industry_traps(c):
    return D.industry(c.paragraphs, _TRAPS)
