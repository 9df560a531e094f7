"""Queries on file records: listing, classification, overrides and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import catalog as cat
from docloom.plans.registry import query

TYPE_RULES = [(1, "spa", "SPA"), (2, "sha", "SHA"), (3, "ssa", "SSA"), (4, "mou", "MOU"), (5, "ata", "ATA/BTA")]
MISC_RULES = ["notes_", "src7/"]
OVERRIDES = [(1, "src1/*", "ctype", "SPA"), (2, "src1/notes*", "ctype", "SHA"), (3, "*markup*", "lang", "xx"), (4, "src2/S?A*", "is_draft", "0"), (5, "*", "filename", "ignored")]
_OVERRIDES_SQL = "(VALUES (1,'^src1/.*$','ctype','SPA'),(2,'^src1/notes.*$','ctype','SHA'),(3,'^.*markup.*$','lang','xx'),(4,'^src2/S.A.*$','is_draft','0')) o(ord, re, field, value)"


@query("files_by_list", "SELECT path, CASE WHEN f.path IS NULL OR p.path LIKE '%..%' THEN 'bad' ELSE 'ok' END AS state, f.file_key FROM (SELECT path FROM fx_files WHERE doc_id % 3 = 0 UNION ALL SELECT '../' || path FROM fx_files WHERE doc_id % 97 = 0 UNION ALL SELECT path || '.gone' FROM fx_files WHERE doc_id % 89 = 0) p LEFT JOIN fx_files f USING (path)")
def files_by_list(c):
    """Bounded scan: listed paths that exist, and the report of those that escape or do not."""
    from docloom.sources.readers import listed_files

    f = c.files
    wanted = f.filter("doc_id % 3 = 0").select("path").union(f.filter("doc_id % 97 = 0").select(F.concat(F.lit("../"), "path"))).union(f.filter("doc_id % 89 = 0").select(F.concat("path", F.lit(".gone"))))
    return listed_files(wanted, f)


@query("exclude_misc_paths", "SELECT file_key, path FROM fx_files WHERE NOT (contains(lower(path),'notes_') OR contains(lower(path),'src7/'))")
def exclude_misc_paths(c):
    rules = c.small([(x,) for x in MISC_RULES], "pattern string")
    return c.files.join(F.broadcast(rules), T.matches(F.col("path"), F.col("pattern")), "left_anti").select("file_key", "path")


@query("hash_sample", "SELECT file_key, doc_id FROM fx_files ORDER BY md5('seed-1' || file_key), file_key LIMIT 50")
def hash_sample(c):
    return cat.hash_sample(c.files.select("file_key", "doc_id"), "file_key", 50, "seed-1")


_NORM = "trim(regexp_replace(x, '[\\x00-\\x20\\x7F]+', ' ', 'g'))"


@query("normalised_paragraphs", f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS para, y AS content FROM (SELECT doc_id, i, {_NORM} AS y FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE y <> ''")
def normalised_paragraphs(c):
    parts = c.documents.select("doc_id", F.posexplode(T.paragraphs_of(F.col("text"))).alias("para", "content"))
    return parts.select("doc_id", (F.col("para") + 1).alias("para"), "content")


@query("content_keys", "SELECT doc_id, substr(sha256('doc' || doc_id), 1, 16) AS file_key, substr(sha256(text), 1, 16) AS content_hash, substr(sha1(text), 1, 12) AS cluster_key FROM documents")
def content_keys(c):
    return c.documents.select("doc_id", T.short_hash(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("file_key"), T.short_hash(F.col("text")).alias("content_hash"), F.substring(F.sha1("text"), 1, 12).alias("cluster_key"))


@query("classify_type", "SELECT file_key, coalesce(min_by(v, ord), 'unclassified') AS value, min_by(p, ord) AS rule FROM fx_files LEFT JOIN (VALUES (1,'spa','SPA'),(2,'sha','SHA'),(3,'ssa','SSA'),(4,'mou','MOU'),(5,'ata','ATA/BTA')) r(ord,p,v) ON contains(lower(path), p) GROUP BY file_key")
def classify_type(c):
    rules = c.small(TYPE_RULES, "ord int, pattern string, value string")
    return cat.first_rule(c.files, "file_key", F.col("path"), rules, "unclassified")


@query(
    "script_language",
    """SELECT doc_id, CASE WHEN a / greatest(a + b, 1) > 0.30 THEN 'accented' WHEN a / greatest(a + b, 1) < 0.05 AND b > 0 THEN 'plain' ELSE 'mixed' END AS language
    FROM (SELECT doc_id, length(regexp_replace(text, '[^éèêçàôüöäßñÉÈÊÇ]', '', 'g'))::DOUBLE AS a, length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))::DOUBLE AS b FROM documents)""",
)
def script_language(c):
    return c.documents.select("doc_id", cat.script_language(F.col("text"), "[éèêçàôüöäßñÉÈÊÇ]", "[a-zA-Z]", "accented", "plain").alias("language"))


@query(
    "draft_and_version",
    """SELECT file_key, CASE WHEN contains(lower(filename),'draft') OR contains(lower(filename),'markup') THEN 1 WHEN contains(lower(filename),'signed') OR contains(lower(filename),'executed') THEN 0 END AS draft,
    coalesce(nullif(regexp_extract(filename,'_(20[0-9]{6})_',1),''), nullif(regexp_extract(filename,'_([a-z]+) draft',1),''), nullif(regexp_extract(filename,'([0-9])(st|nd|rd|th)',1),'')) AS version_hint FROM fx_files""",
)
def draft_and_version(c):
    hint = cat.first_capture(F.col("filename"), ["_(20[0-9]{6})_", "[", "_([a-z]+) draft", "([0-9])(st|nd|rd|th)"])
    return c.files.select("file_key", cat.draft_state(F.col("filename"), ["draft", "markup"], ["signed", "executed"]).alias("draft"), hint.alias("version_hint"))


@query(
    "manual_overrides",
    f"""WITH hits AS (SELECT file_key, field, max_by(value, ord) AS value, 1 AS prio, 'path' AS src FROM fx_files JOIN {_OVERRIDES_SQL} ON regexp_matches(path, re) GROUP BY file_key, field
      UNION ALL SELECT file_key, 'lang', 'de', 2, 'file' FROM fx_files WHERE doc_id % 5 = 0),
    best AS (SELECT file_key, field, max_by(value, prio) AS value FROM hits GROUP BY ALL),
    trail AS (SELECT file_key, string_agg(DISTINCT src || ':' || field, '|' ORDER BY src || ':' || field) AS t FROM hits GROUP BY file_key)
    SELECT f.file_key, coalesce(a.value, f.ctype) AS ctype, coalesce(b.value, f.lang) AS lang, coalesce(d.value::INTEGER, f.is_draft) AS is_draft, coalesce(t, '') AS override_trail
    FROM fx_files f LEFT JOIN best a ON a.file_key = f.file_key AND a.field = 'ctype' LEFT JOIN best b ON b.file_key = f.file_key AND b.field = 'lang'
    LEFT JOIN best d ON d.file_key = f.file_key AND d.field = 'is_draft' LEFT JOIN trail ON trail.file_key = f.file_key""",
)
def manual_overrides(c):
    by_path = c.small(OVERRIDES, "ord int, glob string, field string, value string")
    by_key = c.files.filter("doc_id % 5 = 0").select("file_key", F.lit("lang").alias("field"), F.lit("de").alias("value"))
    return cat.apply_overrides(c.files, by_path, by_key, ["ctype", "lang", "is_draft", "version_hint"]).select("file_key", "ctype", "lang", "is_draft", "override_trail")


@query("catalog_filter", "SELECT file_key, ctype, is_draft FROM fx_files WHERE status = 'ok' AND ctype = 'SPA' AND lang = 'en' AND (is_draft IS NULL OR is_draft <> 1)")
def catalog_filter(c):
    return cat.searchable(c.files, "SPA", "en", True).select("file_key", "ctype", "is_draft")


@query("unsearchable_by_type", "SELECT ctype, count(*) FILTER (status IN ('empty','error'))::BIGINT AS unsearchable, count(*)::BIGINT AS files FROM fx_files GROUP BY ctype")
def unsearchable_by_type(c):
    return c.files.groupBy("ctype").agg(F.count_if(F.col("status").isin("empty", "error")).alias("unsearchable"), F.count(F.lit(1)).alias("files"))


@query("duplicate_groups", "SELECT file_key, dup_group FROM fx_files")
def duplicate_groups(c):
    return c.files.select("file_key", "dup_group")


_REP = "CASE WHEN is_draft = 1 THEN 1 ELSE 0 END, CASE WHEN regexp_matches(lower(coalesce(version_hint, '') || ' ' || path), 'final|signed|clean') THEN 0 ELSE 1 END, length(path), filename, file_key"


@query("representatives_by_status", f"SELECT file_key, status, dup_group FROM (SELECT *, row_number() OVER (PARTITION BY dup_group, status ORDER BY {_REP}) AS r FROM fx_files) WHERE r = 1")
def representatives_by_status(c):
    return cat.representatives(c.files, also=["status"], final_words=cat.STATISTICS_FINAL_WORDS).select("file_key", "status", "dup_group")


@query("duplicate_members", "SELECT a.file_key, count(*)::BIGINT AS members, string_agg(b.file_key, '|' ORDER BY b.file_key) AS others FROM fx_files a JOIN fx_files b ON a.dup_group = b.dup_group AND a.file_key <> b.file_key GROUP BY a.file_key")
def duplicate_members(c):
    f = c.files.select("file_key", "dup_group")
    # files without a twin leave first, so the self-join holds duplicate groups only
    twins = f.join(f.groupBy("dup_group").count().filter("count > 1"), "dup_group", "left_semi")
    other = twins.withColumnRenamed("file_key", "other")
    pairs = twins.join(other, "dup_group").filter("file_key <> other")
    return pairs.groupBy("file_key").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_list("other")), "|").alias("others"))


@query("upsert_metadata", "SELECT file_key, meta_schema_version, confidence FROM fx_doc_meta WHERE file_key NOT IN (SELECT file_key FROM fx_files WHERE doc_id % 6 = 1) UNION ALL SELECT file_key, 3, 'high' FROM fx_files WHERE doc_id % 6 = 1")
def upsert_metadata(c):
    new = c.files.filter("doc_id % 6 = 1").select("file_key", F.lit(3).alias("meta_schema_version"), F.lit("high").alias("confidence"))
    return cat.upsert(c.doc_meta.select("file_key", "meta_schema_version", "confidence"), new, ["file_key"])


@query("override_suggestions", "SELECT path, 'file_key: ' || file_key || ' # ' || CASE WHEN status IN ('error','empty') THEN status WHEN ctype = 'unclassified' THEN 'unclassified' ELSE 'language' END AS line FROM fx_files WHERE ctype = 'unclassified' OR lang NOT IN ('en','de','fr') OR status IN ('error','empty') ORDER BY path LIMIT 200")
def override_suggestions(c):
    why = F.when(F.col("status").isin("error", "empty"), F.col("status")).when(F.col("ctype") == "unclassified", "unclassified").otherwise("language")
    odd = c.files.filter((F.col("ctype") == "unclassified") | ~F.col("lang").isin("en", "de", "fr") | F.col("status").isin("error", "empty"))
    return odd.orderBy("path").limit(200).select("path", F.concat(F.lit("file_key: "), "file_key", F.lit(" # "), why).alias("line"))


@query("paragraph_map", "SELECT file_key, para, max_by(t, prio) AS text FROM (SELECT file_key, para, 'top:' || content AS t, 1 AS prio FROM fx_paragraphs WHERE para <= 4 UNION ALL SELECT file_key, para, 'family:' || content, 2 FROM fx_paragraphs WHERE para BETWEEN 3 AND 5 UNION ALL SELECT file_key, para, 'annex:' || content, 3 FROM fx_paragraphs WHERE para = 5) GROUP BY ALL")
def paragraph_map(c):
    """Paragraphs of several sections united; a later section wins."""
    p = c.paragraphs
    parts = [(1, "top:", "para <= 4"), (2, "family:", "para between 3 and 5"), (3, "annex:", "para = 5")]
    rows = None
    for prio, tag, where in parts:
        one = p.filter(where).select("file_key", "para", F.concat(F.lit(tag), "content").alias("t"), F.lit(prio).alias("prio"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("file_key", "para").agg(F.max_by("t", "prio").alias("text"))


@query("signatures", "SELECT doc_id, regexp_replace(regexp_replace(replace(lower(left(text, 200)), 'ß', 'ss'), '[0-9]+', '#', 'g'), '[^\\p{L}\\p{N}#]+', '', 'g') AS signature FROM documents")
def signatures(c):
    return c.documents.select("doc_id", T.signature(F.substring("text", 1, 200)).alias("signature"))


@query(
    "scan_changes",
    """WITH cat AS (SELECT file_key, path, char_count AS size, doc_id AS mtime, CASE WHEN doc_id % 11 = 3 THEN 'missing' ELSE 'ok' END AS status FROM fx_files WHERE doc_id % 7 <> 6),
    scan AS (SELECT CASE WHEN doc_id % 9 = 4 THEN substr(sha256('new' || doc_id), 1, 16) ELSE file_key END AS file_key, CASE WHEN doc_id % 10 = 7 THEN 'moved/' || path ELSE path END AS path,
      char_count + CASE WHEN doc_id % 9 = 4 THEN 1 ELSE 0 END AS size, doc_id AS mtime, CASE doc_id % 23 WHEN 5 THEN 'unsupported' WHEN 6 THEN 'excluded' WHEN 7 THEN 'error' ELSE 'ok' END AS kind FROM fx_files WHERE doc_id % 13 <> 1),
    j AS (SELECT s.*, c.file_key AS ck, c.size AS cs, c.mtime AS cm, c.status AS cst, k.path AS kp, k.status AS kst, o.path AS op FROM scan s LEFT JOIN cat c ON c.path = s.path LEFT JOIN cat k ON k.file_key = s.file_key LEFT JOIN scan o ON o.path = k.path),
    r AS (SELECT path, file_key, CASE WHEN kind <> 'ok' THEN kind WHEN cs = size AND cm = mtime AND cst <> 'missing' THEN 'skipped' WHEN cst = 'missing' OR (kst = 'missing' AND ck IS NULL) THEN 'restored'
      WHEN ck IS NOT NULL AND ck <> file_key THEN 'content_changed' WHEN ck IS NULL AND kp IS NOT NULL THEN 'moved' WHEN ck IS NOT NULL THEN 'touched' ELSE 'new' END AS change, op FROM j)
    SELECT path, file_key, change, change = 'moved' AND op IS NOT NULL AS was_copied FROM r
    UNION ALL SELECT path, file_key, 'missing', false FROM cat WHERE status <> 'missing' AND path NOT IN (SELECT path FROM scan) AND file_key NOT IN (SELECT file_key FROM scan)""",
)
def scan_changes(c):
    d = F.col("doc_id")
    old = c.files.filter("doc_id % 7 <> 6").select("file_key", "path", F.col("char_count").alias("size"), d.alias("mtime"), F.when(d % 11 == 3, "missing").otherwise("ok").alias("status"))
    kind = F.when(d % 23 == 5, "unsupported").when(d % 23 == 6, "excluded").when(d % 23 == 7, "error").otherwise("ok")
    scan = c.files.filter("doc_id % 13 <> 1").select(
        F.when(d % 9 == 4, T.short_hash(F.concat(F.lit("new"), d.cast("string")))).otherwise(F.col("file_key")).alias("file_key"),
        F.when(d % 10 == 7, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"),
        (F.col("char_count") + F.when(d % 9 == 4, 1).otherwise(0)).alias("size"),
        d.alias("mtime"),
        kind.alias("kind"),
    )
    return cat.scan_changes(old, scan)
