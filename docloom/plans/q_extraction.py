"""Queries that read paragraphs by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import extraction as X
from docloom.plans.registry import query

RULES = [(1, "(?i)there", None, "RW"), (2, "(?i)whst", "(?i)license", "CP"), (3, "(?i)\\bwith\\b", None, "COV"), (4, "license", None, "REM")]


@query("rule_labels", "WITH r AS (SELECT file_key, para, content, ord, label FROM fx_paragraphs JOIN (VALUES (1,'(?i)there',NULL,'RW'),(2,'(?i)whst','(?i)license','CP'),(3,'(?i)\\bwith\\b',NULL,'COV'),(4,'license',NULL,'REM')) r(ord,p,np,label) ON regexp_matches(content, p) AND (np IS NULL OR NOT regexp_matches(content, np))) SELECT p.file_key, p.para, coalesce(l, '') AS labels FROM fx_paragraphs p LEFT JOIN (SELECT file_key, para, string_agg(label, '|' ORDER BY ord) AS l FROM r GROUP BY ALL) USING (file_key, para)")
def rule_labels(c):
    return X.multi_label(c.paragraphs, "content", c.small(RULES, "ord int, pattern string, not_pattern string, label string"), ["file_key", "para"])


@query(
    "paragraph_reading",
    """SELECT file_key, para, CASE WHEN regexp_matches(lower(content), '(^|[^\\p{L}\\p{N}_])(the|la|der)($|[^\\p{L}\\p{N}_])') THEN 'none_exist' WHEN regexp_matches(lower(content), '(^|[^\\p{L}\\p{N}_])(of|de|und)($|[^\\p{L}\\p{N}_])') THEN 'negative' ELSE 'affirmative' END AS polarity,
    length(content) >= 40 AND regexp_matches(content, '[.;]') AND len(regexp_extract_all(content, '\\S+')) >= 6 AS substantive,
    CASE WHEN length(content) >= 200 THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'there') THEN 3 ELSE 0 END + CASE WHEN contains(lower(content), 'with') THEN 2 ELSE 0 END - CASE WHEN contains(content, '|') THEN 2 ELSE 0 END AS score,
    CASE WHEN contains(lower(content), 'there') THEN 'RW' WHEN contains(lower(content), 'whst') THEN 'CP' WHEN para % 2 = 0 THEN 'CP' ELSE 'DEF' END AS family,
    CASE WHEN regexp_matches(lower(content), 'there') THEN 'keep' WHEN contains(content, '|') THEN 'noise' WHEN regexp_matches(lower(content), 'whst') THEN 'reclassify' ELSE 'review' END AS bucket FROM fx_paragraphs""",
)
def paragraph_reading(c):
    t = F.col("content")
    piped = F.contains(t, F.lit("|"))
    linked = F.when(F.col("para") % 2 == 0, F.array(F.lit("CP"))).otherwise(F.array().cast("array<string>"))
    return c.paragraphs.select(
        "file_key",
        "para",
        X.polarity(t, ["the", "la", "der"], ["of", "de", "und"]).alias("polarity"),
        X.substantive(t).alias("substantive"),
        X.evidence_score(t, [("there", 3), ("with", 2)], (200, 1), [(piped, 2)]).alias("score"),
        X.first_family(t, [("RW", ["there"]), ("CP", ["whst"])], linked, "DEF").alias("family"),
        X.tag_bucket(t, "there", piped, "whst").alias("bucket"),
    )


@query("grounding", """WITH g AS (SELECT item_id, text AS q, unnest(range(1, length(text) - 11 + 1, 6)) AS i FROM benchmark WHERE length(text) >= 12), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1),
h AS (SELECT item_id, f.file_key, count(*) AS hits FROM g JOIN documents d ON contains(d.text, substr(q, i, 12)) JOIN fx_files f USING (doc_id) WHERE f.status = 'ok' GROUP BY ALL)
SELECT item_id, file_key, round(hits / n, 6) AS coverage, hits / n < 0.7 AS ungrounded FROM h JOIN n USING (item_id)""")
def grounding(c):
    rows = X.shingle_coverage(c.table("benchmark").select("item_id", F.col("text").alias("quote")), c.texts)
    return rows.select("item_id", "file_key", F.round("coverage", 6).alias("coverage"), (F.col("coverage") < 0.7).alias("ungrounded"))


_PAIR = "fx_clause_item i JOIN fx_clause_item j ON i.file_key = j.file_key AND i.family = j.family AND i.item_ref < j.item_ref"


@query("duplicate_quotes", f"SELECT i.file_key, i.item_ref AS a_ref, j.item_ref AS b_ref, CASE WHEN i.verbatim = j.verbatim THEN 'duplicate' ELSE 'contained' END AS code FROM {_PAIR} AND i.loc_start <= j.loc_end AND j.loc_start <= i.loc_end WHERE (i.verbatim = j.verbatim AND i.taxonomy_id = j.taxonomy_id) OR (i.verbatim <> j.verbatim AND length(i.verbatim) >= 8 AND length(j.verbatim) >= 8 AND (contains(i.verbatim, j.verbatim) OR contains(j.verbatim, i.verbatim)))")
def duplicate_quotes(c):
    return X.duplicate_quotes(c.items)


@query("range_jaccard", f"SELECT file_key, a_ref, b_ref, round_even(b / e, 4) AS jaccard FROM (SELECT i.file_key, i.item_ref AS a_ref, j.item_ref AS b_ref, (least(i.loc_end, j.loc_end) - greatest(i.loc_start, j.loc_start) + 1)::DOUBLE AS b, (greatest(i.loc_end, j.loc_end) - least(i.loc_start, j.loc_start) + 1)::DOUBLE AS e FROM {_PAIR} WHERE i.verbatim <> j.verbatim) WHERE b > 0 AND b / e >= 0.5")
def range_jaccard(c):
    return X.range_jaccard(c.items)


@query("overlapping_ranges", "SELECT i.file_key, i.item_ref AS a_ref, j.item_ref AS b_ref FROM fx_clause_item i JOIN fx_clause_item j ON i.file_key = j.file_key AND i.loc_start <= j.loc_end AND j.loc_start <= i.loc_end WHERE i.family = 'RW' AND j.family = 'CP'")
def overlapping_ranges(c):
    side = lambda f, p: c.items.filter(F.col("family") == f).select("file_key", F.col("item_ref").alias(f"{p}_ref"), F.col("loc_start").alias(f"{p}_lo"), F.col("loc_end").alias(f"{p}_hi"))
    return X.overlapping(side("RW", "a"), side("CP", "b")).select("file_key", "a_ref", "b_ref")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


@query("nearest_nodes", f"WITH w AS (SELECT candidate_id, n.taxonomy_id, {_WORDS.format(c='k.verbatim || case when candidate_id % 2 = 0 then chr(32) || chr(110) || chr(111) || chr(100) || chr(101) else chr(32) end')} AS w, {_WORDS.format(c='n.label')} AS l FROM fx_candidate k JOIN fx_node n USING (family)), s AS (SELECT candidate_id, taxonomy_id, len(list_intersect(l, w))::DOUBLE / greatest(len(list_distinct(list_concat(l, w))), 1) AS score FROM w) SELECT candidate_id, taxonomy_id, round_even(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, taxonomy_id DESC) AS r FROM s) WHERE r = 1")
def nearest_nodes(c):
    rows = c.candidates.withColumn("t", F.concat("verbatim", F.when(F.col("candidate_id") % 2 == 0, " node").otherwise(" ")))
    return X.nearest_node(rows, "t", ["candidate_id"], c.nodes)


_AL = "(VALUES ('RW.A','there'),('RW.B','the'),('CP.A','with the'),('COV.A','hand'),('DEF.T','in'),('PAY','thereha'),('REM','license')) a(taxonomy_id, alias)"


@query("alias_matches", f"WITH h AS (SELECT file_key, para, taxonomy_id, alias, length(replace(alias, ' ', '')) AS score FROM fx_paragraphs JOIN {_AL} ON contains(lower(content), alias)), k AS (SELECT *, greatest(4, least(max(score) OVER (PARTITION BY file_key, para), 8)) AS l FROM h) SELECT file_key, para, taxonomy_id, alias, score::INTEGER AS score, place FROM (SELECT *, (row_number() OVER (PARTITION BY file_key, para ORDER BY score DESC, taxonomy_id, alias))::INTEGER AS place FROM k WHERE score >= l) WHERE place <= 6")
def alias_matches(c):
    return X.alias_matches(c.paragraphs, c.small([("RW.A", "there"), ("RW.B", "the"), ("CP.A", "with the"), ("COV.A", "hand"), ("DEF.T", "in"), ("PAY", "thereha"), ("REM", "license")], "taxonomy_id string, alias string"))


@query("number_support", "SELECT file_key, para, para * 12 AS value, contains(regexp_replace(content, '[,\\s\\[\\]()]', '', 'g'), (para * 12)::VARCHAR) OR contains(regexp_replace(content, '[,\\s\\[\\]()]', '', 'g'), para || 'year') OR (para * 12 % 10000 = 0 AND contains(content, '만')) AS supported FROM fx_paragraphs")
def number_support(c):
    v = F.col("para") * 12
    return c.paragraphs.select("file_key", "para", v.alias("value"), X.number_supported(v, F.col("content")).alias("supported"))


@query("folded_documents", "SELECT file_key, md5(lower(string_agg(content, ' ' ORDER BY para))) AS folded_key FROM fx_paragraphs GROUP BY file_key")
def folded_documents(c):
    return X.whole_documents(c.paragraphs).select("file_key", F.md5("folded").alias("folded_key"))


_CON = [("alpha", "RW.A"), ("beta", "CP.A"), ("omega", "PAY"), ("delta", "COV.A")]
_MORE = [("PAY", "of thing"), ("COV.A", "é"), ("CP", "Haus-und"), ("DEF.T", "ung")]
_VOC = f"""words AS (SELECT array_to_string(string_split(taxonomy_id, '.')[1:2], '.') AS sub, lower(term) AS term FROM (SELECT taxonomy_id, variant AS term FROM (VALUES {', '.join(map(str, _CON))}) k(canonical, taxonomy_id) JOIN fx_term USING (canonical) UNION ALL SELECT taxonomy_id, label FROM fx_node UNION ALL SELECT * FROM (VALUES {', '.join(map(str, _MORE))}) m(taxonomy_id, term))),
 voc AS (SELECT DISTINCT sub, needle, true AS bounded FROM (SELECT sub, unnest(regexp_extract_all(term, '[a-z]+')) AS needle FROM words WHERE regexp_matches(term, '[a-z]')) WHERE length(needle) >= 4 AND needle NOT IN ('node','root')
  UNION SELECT sub, term, false FROM words WHERE NOT regexp_matches(term, '[a-z]'))"""
_SUS = "sus AS (SELECT * FROM (SELECT file_key, sub, count(DISTINCT needle)::BIGINT AS n_words, min(para) AS first_para FROM fx_paragraphs JOIN voc ON contains(lower(content), needle) AND (NOT bounded OR regexp_matches(lower(content), '(^|[^\\p{L}\\p{N}_])' || needle || '($|[^\\p{L}\\p{N}_])')) GROUP BY ALL) s WHERE NOT EXISTS (SELECT 1 FROM fx_clause_item i WHERE i.file_key = s.file_key AND array_to_string(string_split(taxonomy_id, '.')[1:2], '.') = s.sub))"


def _voc(c):
    return X.vocabulary(c.small(_CON, "canonical string, taxonomy_id string"), c.terms, c.nodes, ["node", "root"], supplements=c.small(_MORE, "taxonomy_id string, term string"))


@query("absence_suspects", f"WITH {_VOC}, {_SUS} SELECT * FROM sus")
def absence_suspects(c):
    return X.absence_suspects(c.paragraphs, c.items, _voc(c))


@query("absence_sweep", f"""WITH {_VOC}, {_SUS}, cov AS (SELECT sub, count(*) AS covered FROM (SELECT DISTINCT file_key, array_to_string(string_split(taxonomy_id, '.')[1:2], '.') AS sub FROM fx_clause_item) GROUP BY 1), n AS (SELECT count(*) AS docs FROM fx_files WHERE status = 'ok'),
 r AS (SELECT v.sub, docs - coalesce(covered, 0) AS pool, (SELECT count(*) FROM sus WHERE sus.sub = v.sub) AS suspects, coalesce((SELECT string_agg(file_key, '|' ORDER BY file_key) FROM (SELECT file_key FROM sus WHERE sus.sub = v.sub ORDER BY file_key LIMIT 50)), '') AS first FROM (SELECT DISTINCT sub FROM voc) v LEFT JOIN cov ON cov.sub = v.sub, n)
 SELECT sub, pool::BIGINT AS pool, suspects::BIGINT AS suspects, CASE WHEN pool > 0 THEN round_even(suspects::DOUBLE / pool, 4) END AS rate, coalesce(suspects::DOUBLE / pool >= 0.85, false) AS too_broad, first FROM r""")
def absence_sweep(c):
    words = _voc(c)
    return X.absence_sweep(X.absence_suspects(c.paragraphs, c.items, words), c.items, c.files, words)


@query("concept_evidence", "WITH h AS (SELECT concept, file_key, min(para) AS para FROM fx_paragraphs JOIN (VALUES ('exist','there','\\bthere\\b'),('state','whst','whst[a-z]*')) k(concept, literal, pattern) ON contains(lower(content), literal) AND regexp_matches(lower(content), pattern) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY file_key) AS k FROM h) SELECT concept, count(*)::BIGINT AS documents, string_agg(file_key || '#' || para, '|' ORDER BY file_key) FILTER (k <= 5) AS examples FROM r GROUP BY concept")
def concept_evidence(c):
    return X.concept_evidence(c.paragraphs, c.small([("exist", "there", r"\bthere\b"), ("state", "whst", "whst[a-z]*")], "concept string, literal string, pattern string"))
