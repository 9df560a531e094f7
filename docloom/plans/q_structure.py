"""Queries on paragraph structure and deal facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import structure as S
from docloom.plans.registry import query

_TOC = "(regexp_matches(content, '\\.{3,}') OR (regexp_matches(content, '\\s[0-9]{1,3}$') AND length(content) < 80))"
_HEAD = "(trim(content) <> '' AND ((length(content) < 60 AND len(regexp_split_to_array(trim(content), '\\s+')) <= 6 AND NOT regexp_matches(content, '[.;:,]$')) OR regexp_matches(content, '^(Article|Section|[0-9]+\\.)\\s')))"
_FAM = "CASE WHEN contains(lower(content), 'license') THEN 'REM' WHEN contains(lower(content), 'there') THEN 'RW' WHEN contains(lower(content), 'whst') THEN 'CP' END"


def _fam():
    low = F.lower("content")
    return F.when(F.contains(low, F.lit("license")), "REM").when(F.contains(low, F.lit("there")), "RW").when(F.contains(low, F.lit("whst")), "CP")


@query("heading_flags", f"SELECT file_key, para, {_TOC} AS toc, {_HEAD} AS heading, nullif(regexp_extract(content, '(\\[[^\\]]{{0,40}}\\]|_{{3,}}|\\{{[^}}]{{0,40}}\\}})', 1), '') AS placeholder FROM fx_paragraphs")
def heading_flags(c):
    t = F.col("content")
    return c.paragraphs.select("file_key", "para", S.is_toc_line(t).alias("toc"), S.is_heading(t).alias("heading"), S.placeholder(t).alias("placeholder"))


@query("heading_ranges", f"SELECT file_key, para AS from_para, coalesce(lead(para) OVER (PARTITION BY file_key ORDER BY para) - 1, last)::INTEGER AS to_para FROM (SELECT *, max(para) OVER (PARTITION BY file_key) AS last FROM fx_paragraphs) WHERE {_HEAD}")
def heading_ranges(c):
    return S.heading_ranges(c.paragraphs, S.is_heading(F.col("content"))).select("file_key", "from_para", "to_para")


@query("family_ranges", f"""WITH h AS (SELECT file_key, para, {_FAM} AS family, last FROM (SELECT *, max(para) OVER (PARTITION BY file_key) AS last FROM fx_paragraphs)), k AS (SELECT *, coalesce(lead(para) OVER (PARTITION BY file_key ORDER BY para) - 1, last) AS to_para FROM h WHERE family IS NOT NULL),
 n AS (SELECT *, CASE WHEN para <= lag(to_para) OVER (PARTITION BY file_key, family ORDER BY para) + 1 THEN 0 ELSE 1 END AS fresh FROM k), i AS (SELECT *, sum(fresh) OVER (PARTITION BY file_key, family ORDER BY para) AS island FROM n)
 SELECT file_key, family, min(para)::INTEGER AS from_para, max(to_para)::INTEGER AS to_para FROM i GROUP BY file_key, family, island""")
def family_ranges(c):
    return S.family_ranges(c.paragraphs, _fam())


@query("capped_ranges", "SELECT p.file_key, para AS from_para, least(coalesce(lead(para) OVER (PARTITION BY p.file_key ORDER BY para) - 1, last), para + 2, last)::INTEGER AS to_para FROM fx_paragraphs p JOIN (SELECT file_key, max(para) AS last FROM fx_paragraphs GROUP BY 1) USING (file_key) WHERE contains(lower(content), 'there')")
def capped_ranges(c):
    return S.capped_ranges(c.paragraphs.filter(F.contains(F.lower("content"), F.lit("there"))).select("file_key", "para"), c.paragraphs, 3)


@query("context_windows", "WITH f AS (SELECT file_key, min(para) AS hit FROM fx_paragraphs WHERE contains(lower(content), 'whst') GROUP BY 1) SELECT file_key, hit, string_agg(content, ' / ' ORDER BY para) AS context FROM fx_paragraphs JOIN f USING (file_key) WHERE para BETWEEN hit - 1 AND hit + 2 GROUP BY ALL")
def context_windows(c):
    return S.context_window(c.paragraphs, F.contains(F.lower("content"), F.lit("whst")), 1, 2)


@query("best_clause_window", f"""WITH w AS (SELECT *, string_agg(content, ' ') OVER (PARTITION BY file_key ORDER BY para ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, string_agg(content, ' ') OVER (PARTITION BY file_key ORDER BY para ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS a FROM fx_paragraphs),
 r AS (SELECT *, CASE WHEN NOT {_TOC} AND contains(lower(a), 'with') THEN 1 WHEN NOT {_TOC} THEN 2 WHEN contains(lower(a), 'with') THEN 3 ELSE 4 END AS level FROM w WHERE contains(lower(content), 'there'))
 SELECT file_key, para, level, md5(coalesce(b, '') || ' | ' || a) AS window_key FROM (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY level, para) AS k FROM r) WHERE k = 1""")
def best_clause_window(c):
    return S.find_clause(c.paragraphs, F.contains(F.lower("content"), F.lit("there")), "with")


@query("annex_references", """WITH h AS (SELECT p.file_key, para AS from_para, trim(lower(content)) AS name FROM fx_paragraphs p WHERE contains(lower(content), 'license') OR contains(lower(content), 'whst')), r AS (SELECT DISTINCT file_key, unnest(regexp_extract_all(lower(content), '\\b(th[a-z]{4})\\b', 1)) AS ref FROM fx_paragraphs),
 m AS (SELECT r.file_key, r.ref, min(from_para) AS pos FROM r JOIN h ON h.file_key = r.file_key AND contains(name, ref) GROUP BY ALL), o AS (SELECT file_key, min(from_para) AS one FROM h GROUP BY 1 HAVING count(*) = 1)
 SELECT r.file_key, r.ref, coalesce(pos, one) AS at, CASE WHEN pos IS NOT NULL THEN 'matched' WHEN one IS NOT NULL THEN 'folded' ELSE 'missing' END AS state FROM r LEFT JOIN m ON m.file_key = r.file_key AND m.ref = r.ref LEFT JOIN o ON o.file_key = r.file_key""")
def annex_references(c):
    low = F.lower("content")
    heads = S.annex_headers(c.paragraphs, F.contains(low, F.lit("license")) | F.contains(low, F.lit("whst")))
    return S.annex_references(c.paragraphs, heads, r"\b(th[a-z]{4})\b")


@query("source_kinds", "SELECT kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN contains(lower(content), 'disclosure') THEN 'disclosure' WHEN contains(lower(content), 'schedule') THEN 'schedule' WHEN contains(lower(content), 'annex') OR contains(lower(content), 'exhibit') THEN 'annex' ELSE 'other' END AS kind FROM fx_paragraphs) GROUP BY kind")
def source_kinds(c):
    return c.paragraphs.groupBy(S.source_kind(F.col("content")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("deal_years", """WITH p AS (SELECT *, max(para) OVER (PARTITION BY file_key) AS last, nullif(regexp_extract(content, '\\b((?:19|20)[0-9]{2})\\b', 1), '') AS y, list_max(regexp_extract_all(content, '\\b((?:19|20)[0-9]{2})\\b', 1)) AS ym, NOT regexp_matches(content, '^\\[(header|footer)\\]') AS body FROM (SELECT file_key, para, CASE WHEN para % 5 = 0 THEN '[footer] 20' || (10 + para) || ' ' || content ELSE content END AS content FROM fx_paragraphs)),
 t AS (SELECT file_key, min_by(y, para) FILTER (body AND para > last - 12 AND regexp_matches(content, '(?i)signed|executed')) AS signature, min_by(y, para) FILTER (body AND para <= 40 AND regexp_matches(content, '(?i)dated|entered into')) AS execution, min_by(y, para) FILTER (body AND para <= 3) AS preamble, max(ym) FILTER (NOT body) AS margin FROM p WHERE y IS NOT NULL GROUP BY 1),
 r AS (SELECT f.file_key, t.*, nullif(regexp_extract(filename, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:0[1-9]|1[0-2])(?:[0-2][0-9]|3[01])(?:[^0-9]|$)', 1), '') AS l, nullif(regexp_extract(filename, '(?:^|[^0-9])([0-9]{2})(?:0[1-9]|1[0-2])(?:[0-2][0-9]|3[01])(?:[^0-9]|$)', 1), '') AS s FROM fx_files f LEFT JOIN t ON t.file_key = f.file_key)
 SELECT file_key, coalesce(signature, execution, preamble, l, margin, '20' || s, 'unknown') AS value, CASE WHEN signature IS NOT NULL OR execution IS NOT NULL THEN 'high' WHEN preamble IS NOT NULL OR l IS NOT NULL THEN 'med' ELSE 'low' END AS confidence,
 CASE WHEN signature IS NOT NULL THEN 'signature' WHEN execution IS NOT NULL THEN 'execution' WHEN preamble IS NOT NULL THEN 'preamble' WHEN l IS NOT NULL THEN 'long' WHEN margin IS NOT NULL THEN 'margin' WHEN s IS NOT NULL THEN 'short' ELSE 'none' END AS basis FROM r""")
def deal_years(c):
    # every fifth paragraph stands for a footer with a date
    footer = F.concat(F.lit("[footer] 20"), (F.col("para") + 10).cast("string"), F.lit(" "), "content")
    return S.deal_year(c.files, c.paragraphs.withColumn("content", F.when(F.col("para") % 5 == 0, footer).otherwise(F.col("content"))))


@query("governing_value", """WITH s AS (SELECT DISTINCT file_key, v.value FROM fx_paragraphs JOIN (VALUES ('whst','X'),('hand','Y'),('nter','Z')) v(word, value) ON contains(lower(content), word) WHERE contains(lower(content), 'there')),
 a AS (SELECT file_key, list_sort(list(value)) AS vs FROM s GROUP BY 1)
 SELECT d.file_key, CASE WHEN len(vs) = 1 THEN vs[1] ELSE 'unknown' END AS value, CASE WHEN len(vs) = 1 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN len(vs) > 1 THEN array_to_string(vs, '|') ELSE '' END AS conflicts FROM (SELECT DISTINCT file_key FROM fx_paragraphs) d LEFT JOIN a USING (file_key)""")
def governing_value(c):
    words = c.small([("whst", "X"), ("hand", "Y"), ("nter", "Z")], "word string, value string")
    return S.single_value(c.paragraphs, F.contains(F.lower("content"), F.lit("there")), words)
