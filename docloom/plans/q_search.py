"""Queries of keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import search as S
from docloom.plans import q_meta as M_SQL
from docloom.plans.registry import query
from docloom.sources import writers

_EXP = """fx_exp AS (SELECT kw, kw AS term, 'exact' AS source FROM (VALUES ('the'),('that')) k(kw)
  UNION ALL SELECT k.kw, lower(v.variant), 'expanded' FROM (VALUES ('the'),('that')) k(kw) JOIN fx_term e ON lower(e.variant) = k.kw JOIN fx_term v ON v.canonical = e.canonical AND v.strength <> 'broad' AND lower(v.variant) <> k.kw GROUP BY ALL)"""
_SCORES = """fx_len AS (SELECT count(*)::DOUBLE AS n, avg(greatest(length(content) - 2, 0)) AS avglen FROM fx_paragraphs),
hit AS (SELECT t.term, file_key, para, content, greatest(length(content) - 2, 0) AS len,
  (SELECT count(*) FROM range(1, greatest(length(content) - length(t.term) + 2, 1)) g(i) WHERE substr(lower(content), i, length(t.term)) = t.term) AS tf
  FROM fx_paragraphs JOIN (SELECT DISTINCT term FROM fx_exp) t ON contains(lower(content), t.term)),
df AS (SELECT term, count(*)::DOUBLE AS n_hits FROM hit GROUP BY term),
scored AS (SELECT term, file_key, para, content, CASE WHEN length(term) >= 3 THEN round(-(greatest(ln((n - n_hits + 0.5) / (n_hits + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))), 9) ELSE 0 END AS score FROM hit JOIN df USING (term), fx_len)"""
_RANKS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score, file_key, para) AS rank FROM scored),
best AS (SELECT kw, source, file_key, min(rank) AS rank FROM ranked JOIN fx_exp USING (term) GROUP BY ALL)"""
_REP = "CASE WHEN is_draft = 1 THEN 1 ELSE 0 END, CASE WHEN regexp_matches(lower(coalesce(version_hint, '') || ' ' || path), 'final|signed|clean|체결|서명') THEN 0 ELSE 1 END, length(path), filename, file_key"


def keywords(c):
    return c.small([("the",), ("that",)], "kw string")


@query("expand_keywords", """WITH k AS (SELECT DISTINCT kw FROM fx_query_log WHERE kw <> ''), f AS (SELECT canonical, lower(variant) AS form FROM fx_term UNION SELECT canonical, lower(canonical) FROM fx_term)
SELECT kw, kw AS term, 'exact' AS source FROM k
UNION ALL SELECT DISTINCT k.kw, lower(v.variant), 'expanded' FROM k JOIN f ON f.form = k.kw JOIN fx_term v ON v.canonical = f.canonical AND v.strength <> 'broad' AND lower(v.variant) <> k.kw""")
def expand_keywords(c):
    return S.expand(c.query_log.filter("kw <> ''").select("kw").distinct(), c.terms).select("kw", "term", "source")


@query("resolve_tags", "SELECT kw, coalesce(min(t.canonical), kw) AS tag FROM (SELECT DISTINCT kw FROM fx_query_log WHERE kw <> '') LEFT JOIN fx_term t ON lower(t.variant) = kw GROUP BY kw")
def resolve_tags(c):
    return S.resolve_tag(c.query_log.filter("kw <> ''").select("kw"), c.terms)


@query("paragraph_ranks", f"WITH {_EXP}, {_SCORES}, {_RANKS} SELECT term, file_key, para, rank::BIGINT AS rank, round(score, 6) + 0 AS score FROM ranked")
def paragraph_ranks(c):
    from docloom.functions.ranking import rank_within

    scores = S.paragraph_scores(c.paragraphs, S.expand(keywords(c), c.terms))
    return rank_within(scores, "term", "score", ["file_key", "para"]).select("term", "file_key", "para", "rank", (F.round("score", 6) + 0.0).alias("score"))


@query("fused_scores", f"WITH {_EXP}, {_SCORES}, {_RANKS} SELECT file_key, round(sum(CASE WHEN source = 'exact' THEN 2.0 ELSE 1.0 END / (60 + rank)), 9) AS score FROM best GROUP BY file_key HAVING count(DISTINCT kw) = 2")
def fused_scores(c):
    expanded = S.expand(keywords(c), c.terms)
    return S.fused(S.best_ranks(S.paragraph_scores(c.paragraphs, expanded), expanded), 2).select("file_key", F.round("score", 9).alias("score"))


_SEARCH = f"""WITH {_EXP}, {_SCORES}, {_RANKS},
fused AS (SELECT file_key, sum(CASE WHEN source = 'exact' THEN 2.0 ELSE 1.0 END / (60 + rank)) AS score FROM best GROUP BY file_key HAVING count(DISTINCT kw) = 2),
hits AS (SELECT * FROM fused JOIN fx_files USING (file_key) WHERE status = 'ok' AND (is_draft IS NULL OR is_draft <> 1)),
shown AS (SELECT *, count(*) OVER (PARTITION BY dup_group) AS duplicates FROM hits),
rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dup_group ORDER BY score DESC, {_REP}) AS r FROM shown) WHERE r = 1),
top AS (SELECT * FROM rep ORDER BY score DESC, file_key LIMIT 20),
first AS (SELECT file_key, min(para) AS hit FROM scored SEMI JOIN top USING (file_key) GROUP BY file_key),
near AS (SELECT p.file_key, p.para, p.content, coalesce(sum(length(content)) OVER (PARTITION BY file_key ORDER BY abs(para - hit), para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM fx_paragraphs p JOIN first USING (file_key) WHERE abs(para - hit) <= 5),
snip AS (SELECT file_key, string_agg(substr(content, 1, (240 - before)::BIGINT), ' / ' ORDER BY para) AS snippet FROM near WHERE before < 240 GROUP BY file_key),
matched AS (SELECT file_key, string_agg(DISTINCT term, '|' ORDER BY term) AS matched_terms FROM scored GROUP BY file_key)
SELECT file_key, filename, round(score, 9) AS score, duplicates::BIGINT AS duplicates, matched_terms, snippet, (SELECT count(*) FROM hits)::BIGINT AS total_files, (SELECT count(DISTINCT dup_group) FROM hits)::BIGINT AS total
FROM top JOIN matched USING (file_key) JOIN snip USING (file_key)"""


@query("keyword_search", _SEARCH)
def keyword_search(c):
    return S.keyword_search(c.paragraphs, c.files, keywords(c), c.terms, exclude_drafts=True)


_FITS = f"""law AS ({M_SQL._clause('law', True)}), {M_SQL._FACT_FILTER},
 ver AS (SELECT file_key, CASE WHEN version_role IN ('execution', 'buyer_draft', 'seller_draft', 'bidding') THEN 'match' WHEN coalesce(version_role, 'unknown') = 'unknown' THEN 'needs_review' ELSE 'no_match' END AS answer FROM fx_files WHERE status = 'ok'),
 fits AS (SELECT file_key FROM fx_files WHERE status = 'ok' AND file_key IN (SELECT file_key FROM ver WHERE answer = 'match') AND file_key IN (SELECT file_key FROM law WHERE answer = 'match') AND file_key IN (SELECT file_key FROM facts WHERE answer = 'match'))"""


def _fits(c):
    from docloom.operators import metadata as M

    filters = {"clause": M.clause_filter(c.files, c.doc_meta, "law", True), "facts": M.facts_filter(c.files, c.doc_meta, role="buyer", amount=(0, 1e10))}
    return S.fitting(c.files, filters, ["execution", "buyer_draft", "seller_draft", "bidding"])


@query("keyword_search_filtered", _SEARCH.replace("fused AS (", _FITS + ",\nfused AS (", 1).replace("AND (is_draft IS NULL OR is_draft <> 1)", "AND file_key IN (SELECT file_key FROM fits)"))
def keyword_search_filtered(c):
    """Keywords with version, clause and fact filters together."""
    return S.keyword_search(c.paragraphs, c.files, keywords(c), c.terms, only=_fits(c)[0])


@query("search_notices", f"WITH {_FITS} SELECT 'version' AS filter, answer, count(*) AS files FROM ver GROUP BY answer UNION ALL SELECT 'clause', answer, count(*) FROM law GROUP BY answer UNION ALL SELECT 'facts', answer, count(*) FROM facts GROUP BY answer")
def search_notices(c):
    return _fits(c)[1]


def _index(c):
    """Postings of the corpus in two batches, as documents arrive."""
    from docloom.operators import postings
    from docloom.sources.scratch import new_path

    path = new_path(c.spark, "postings")
    for batch in (0, 1):
        postings.add_to_index(c.placed.filter(F.col("doc_id") % 2 == batch), path, batch)
    return path


def _terms(c):
    return [r["term"] for r in S.expand(keywords(c), c.terms).select("term").distinct().collect()]


@query("postings_search", _SEARCH)
def postings_search(c):
    from docloom.operators import postings

    scores = postings.indexed_scores(c.spark, _index(c), _terms(c))
    return S.keyword_search(c.paragraphs, c.files, keywords(c), c.terms, exclude_drafts=True, scores=scores)


@query("postings_scores", f"WITH {_EXP}, {_SCORES} SELECT term, file_key, para, round(score, 6) + 0 AS score FROM scored WHERE length(term) >= 3")
def postings_scores(c):
    from docloom.operators import postings

    return postings.indexed_scores(c.spark, _index(c), _terms(c)).select("term", "file_key", "para", (F.round("score", 6) + 0.0).alias("score"))


@query("postings_top", f"WITH fx_exp AS (SELECT 'whst' AS term), {_SCORES} SELECT term, file_key, para, round(score, 6) + 0 AS score FROM scored ORDER BY scored.score, file_key, para LIMIT 30")
def postings_top(c):
    """Top-k report for one term, opening only blocks that can hold a result."""
    from docloom.operators import postings

    path = _index(c)
    n = postings.indexed_scores(c.spark, path, ["whst"]).count()
    return postings.top_paragraphs(c.spark, path, "whst", 30, n)[0].select("term", "file_key", "para", (F.round("score", 6) + 0.0).alias("score"))


@query("all_keywords", "SELECT file_key FROM fx_paragraphs JOIN (VALUES ('there'),('with'),('that')) k(kw) ON contains(lower(content), kw) GROUP BY file_key HAVING count(DISTINCT kw) = 3")
def all_keywords(c):
    words = c.small([("there",), ("with",), ("that",)], "needle string")
    hit = S.containing(c.paragraphs, words)
    return hit.groupBy("file_key").agg(F.count_distinct("needle").alias("n")).filter("n = 3").select("file_key")


@query("short_terms", "SELECT term, file_key, para FROM fx_paragraphs JOIN (VALUES ('é'),('of'),('%')) t(term) ON contains(lower(content), term)")
def short_terms(c):
    return S.short_term_hits(c.paragraphs, c.small([("é",), ("of",), ("%",), ("there",)], "term string"))


@query("keyword_in_context", """WITH f AS (SELECT file_key, term, min(para) AS para, min_by(content, para) AS content FROM fx_paragraphs JOIN (VALUES ('there'),('license')) t(term) ON contains(lower(content), term) GROUP BY ALL),
 a AS (SELECT *, instr(lower(content), term) AS pos FROM f), b AS (SELECT *, greatest(pos - 60, 1) AS lo, least(pos + length(term) - 1 + 60, length(content)) AS hi FROM a)
 SELECT file_key, term, para, CASE WHEN lo > 1 THEN '...' ELSE '' END || substr(content, lo, hi - lo + 1) || CASE WHEN hi < length(content) THEN '...' ELSE '' END AS kwic FROM b""")
def keyword_in_context(c):
    return S.keyword_in_context(c.paragraphs, c.small([("there",), ("license",)], "term string"))


@query("zero_hit_terms", "SELECT canonical, variant FROM fx_term WHERE NOT EXISTS (SELECT 1 FROM fx_paragraphs WHERE contains(lower(content), lower(variant)))")
def zero_hit_terms(c):
    return S.zero_hit_terms(c.paragraphs, c.terms).select("canonical", "variant")


@query("needle_frequency", "SELECT variant, count(DISTINCT file_key)::BIGINT AS n, round_even(count(DISTINCT file_key) / (SELECT count(DISTINCT file_key) FROM fx_paragraphs), 4) AS df FROM fx_term LEFT JOIN fx_paragraphs ON contains(lower(content), lower(variant)) GROUP BY variant")
def needle_frequency(c):
    return S.needle_document_frequency(c.paragraphs, c.terms)


@query("entries_in_document", "SELECT file_key, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS canonicals FROM fx_paragraphs JOIN fx_term ON contains(lower(content), lower(variant)) GROUP BY file_key")
def entries_in_document(c):
    return S.matched_entries(c.paragraphs, c.terms)


@query("suggested_terms", """WITH s AS (SELECT kw, count(*)::BIGINT AS seen, count(*) FILTER (result_count = 0)::BIGINT AS zero FROM fx_query_log WHERE kw <> '' AND kw NOT IN (SELECT lower(variant) FROM fx_term UNION SELECT canonical FROM fx_term) GROUP BY kw HAVING count(*) >= 3)
 SELECT kw, seen, zero, coalesce((SELECT array_to_string((list_sort(list(DISTINCT canonical)))[1:3], '|') FROM fx_term WHERE contains(kw, variant) OR contains(variant, kw)), '') AS related FROM s""")
def suggested_terms(c):
    return S.suggestions(c.query_log, c.terms)


@query("known_without_result", "SELECT kw, count(*)::BIGINT AS zero FROM fx_query_log WHERE result_count = 0 AND kw IN (SELECT variant FROM fx_term) GROUP BY kw ORDER BY zero DESC, kw LIMIT 20")
def known_without_result(c):
    return S.known_without_result(c.query_log, c.terms)


@query("passages_in_documents", "SELECT gt_id, file_key, verbatim FROM fx_answer_key")
def passages_in_documents(c):
    return c.answer_key


@query("markdown_export", "SELECT file_key, '## ' || file_key || chr(10) || string_agg('> [¶' || para || '] ' || content, chr(10) ORDER BY para) AS block FROM fx_paragraphs WHERE contains(lower(content), 'license') GROUP BY file_key")
def markdown_export(c):
    hits = c.paragraphs.filter(F.contains(F.lower("content"), F.lit("license")))
    return writers.markdown_blocks(hits, F.col("file_key"), "file_key", "para", "content")


@query("paragraph_cache_lines", "SELECT file_key, para, '[¶' || para || ']' || chr(9) || content AS value FROM fx_paragraphs")
def paragraph_cache_lines(c):
    return writers.cache_lines(c.paragraphs)
