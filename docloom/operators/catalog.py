"""File records: rules on paths, overrides, duplicate groups, representatives and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import matches

# Words in version hint or path that speak for a final version, in search results
# and (fewer) in statistics.
FINAL_WORDS = ("final", "signed", "clean", "체결", "서명")
STATISTICS_FINAL_WORDS = ("final", "signed", "clean")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Adds dup_group: the least file_key of the ok files with the same content, else the own key."""
    ok = F.col("status") == "ok"
    low = files.filter(ok).groupBy("content_hash").agg(F.min("file_key").alias("_low"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    joined = files.drop("dup_group").join(low, "content_hash", "left")
    return joined.withColumn("dup_group", F.when(ok, F.coalesce("_low", "file_key")).otherwise(F.col("file_key"))).drop("_low")


def first_rule(rows: DataFrame, key: str, subject: Column, rules: DataFrame, default) -> DataFrame:
    """First rule (least ord) whose pattern stands in the subject: key, value, rule.

    ``rules``: ord, pattern, value - a parameter table, small by nature.
    """
    hit = rows.select(F.col(key), subject.alias("_s")).join(F.broadcast(rules), matches(F.col("_s"), F.col("pattern")))
    best = hit.groupBy(key).agg(F.min_by(F.struct("value", "pattern"), "ord").alias("r"))
    return rows.select(key).join(best, key, "left").select(key, F.coalesce("r.value", F.lit(default)).alias("value"), F.col("r.pattern").alias("rule"))


def script_language(text: Column, first: str, second: str, first_name: str, second_name: str) -> Column:
    """Language by the share of letters in two scripts: over 0.30 of the first names the first;
    under 0.05 with letters of the second names the second; else mixed."""
    a, b = F.regexp_count(text, F.lit(first)), F.regexp_count(text, F.lit(second))
    share = a / F.greatest(a + b, F.lit(1))
    return F.when(share > 0.30, first_name).when((share < 0.05) & (b > 0), second_name).otherwise("mixed")


def any_word(subject: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(subject), F.lit(w.lower()))
    return out


def draft_state(name: Column, draft_words, final_words) -> Column:
    """1 draft, 0 executed, null unknown; a draft word wins."""
    return F.when(any_word(name, draft_words), 1).when(any_word(name, final_words), 0)


def first_capture(subject: Column, patterns) -> Column:
    """First non-empty first group of the patterns, in order; patterns that are not regular
    expressions are skipped."""
    import re

    found = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        found.append(F.nullif(F.regexp_extract(subject, p, 1), F.lit("")))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def glob_regex(glob: Column) -> Column:
    """A path glob as an anchored regular expression; * also crosses '/'."""
    quoted = F.regexp_replace(glob, r"([\\.^$|()\[\]{}+])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def apply_overrides(files: DataFrame, by_path: DataFrame, by_key: DataFrame, fields: list[str]) -> DataFrame:
    """Overrides by path glob (ord, glob, field, value; a later one wins per field), then by
    file_key (file_key, field, value).  Adds override_trail, the applied 'source:field' names."""
    rules = by_path.withColumn("_re", glob_regex(F.col("glob"))).filter(F.col("field").isin(fields))
    hits = files.select("file_key", "path").join(F.broadcast(rules), F.expr("path rlike _re"))
    path_wins = hits.groupBy("file_key", "field").agg(F.max_by("value", "ord").alias("value")).withColumn("source", F.lit("path"))
    key_wins = by_key.filter(F.col("field").isin(fields)).select("file_key", "field", "value", F.lit("file").alias("source"))
    every = path_wins.unionByName(key_wins)
    picked = every.groupBy("file_key").agg(
        *[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.when(F.col("source") == "file", 2).otherwise(1))).alias(f"_{f}") for f in fields],
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "source", "field"))), "|").alias("override_trail"),
    )
    out = files.join(picked, "file_key", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_{f}").cast(files.schema[f].dataType), F.col(f))).drop(f"_{f}")
    return out.withColumn("override_trail", F.coalesce("override_trail", F.lit("")))


def searchable(files: DataFrame, ctype: str | None = None, lang: str | None = None, exclude_drafts: bool = False) -> DataFrame:
    """ok files; dropping drafts keeps those whose draft state is unknown."""
    out = files.filter("status = 'ok'")
    if ctype:
        out = out.filter(F.col("ctype") == ctype)
    if lang:
        out = out.filter(F.col("lang") == lang)
    return out.filter("is_draft is null or is_draft <> 1") if exclude_drafts else out


def representative_order(final_words=FINAL_WORDS) -> list[Column]:
    """Drafts last, then final-looking version hints or paths, short paths, name, key."""
    said = F.concat_ws(" ", F.coalesce("version_hint", F.lit("")), F.coalesce("path", F.lit("")))
    draft = F.coalesce(F.col("is_draft") == 1, F.lit(False))
    return [draft.asc(), any_word(said, final_words).desc(), F.length(F.coalesce("path", F.lit(""))).asc(), F.coalesce("filename", F.lit("")).asc(), F.col("file_key").asc()]


def representatives(files: DataFrame, leading: list[Column] | None = None, also: list[str] | None = None, final_words=FINAL_WORDS) -> DataFrame:
    """One file per duplicate group (and further columns ``also``)."""
    w = W.partitionBy(F.coalesce("dup_group", "file_key"), *(also or [])).orderBy(*(leading or []), *representative_order(final_words))
    return files.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``seed`` whose keys ``old`` lacks are added."""
    return old.unionByName(seed.join(old, keys, "left_anti"))


def scan_changes(catalog: DataFrame, scan: DataFrame, full: bool = True) -> DataFrame:
    """Change class of every file of a scan against the catalog.

    catalog: file_key, path, size, mtime, status; scan: file_key, path, size, mtime, kind
    ('ok', 'unsupported', 'excluded' or 'error').  Classes: unsupported, excluded, error,
    skipped, restored, content_changed, moved, new; and missing for catalog rows that a full
    scan saw neither by path nor by key.  was_copied: a moved file whose old path still stands.
    """
    c = catalog.select(F.col("path").alias("path"), F.col("file_key").alias("c_key"), F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"), F.col("status").alias("c_status"))
    k = catalog.select("file_key", F.col("path").alias("k_path"), F.col("status").alias("k_status"))
    here = scan.join(c, "path", "left").join(k, "file_key", "left")
    old_there = scan.select(F.col("path").alias("k_path"), F.lit(True).alias("_there"))
    here = here.join(old_there, "k_path", "left")
    missing_now = (F.col("c_status") == "missing") | ((F.col("k_status") == "missing") & F.col("c_key").isNull())
    change = (
        F.when(F.col("kind") != "ok", F.col("kind"))
        .when((F.col("c_size") == F.col("size")) & (F.col("c_mtime") == F.col("mtime")) & (F.col("c_status") != "missing"), "skipped")
        .when(missing_now, "restored")
        .when(F.col("c_key").isNotNull() & (F.col("c_key") != F.col("file_key")), "content_changed")
        .when(F.col("c_key").isNull() & F.col("k_path").isNotNull(), "moved")
        .when(F.col("c_key").isNotNull(), "touched")
        .otherwise("new")
    )
    seen = here.withColumn("change", change).select("path", "file_key", "change", F.coalesce((F.col("change") == "moved") & F.col("_there"), F.lit(False)).alias("was_copied"))
    if not full:
        return seen
    gone = catalog.filter("status <> 'missing'").join(scan, "path", "left_anti").join(scan.select("file_key"), "file_key", "left_anti")
    return seen.unionByName(gone.select("path", "file_key", F.lit("missing").alias("change"), F.lit(False).alias("was_copied")))


def hash_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in the order of a seeded hash of their key: a stable draw."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)
