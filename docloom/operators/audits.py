"""Quality audits: tables of violations (key, code, detail); an empty table means clean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POLARITIES = ["affirmative", "negative", "none_exist", "not_applicable"]
REVIEW = ["pending", "approved", "needs_review", "rejected"]


def issue(rows: DataFrame, cond: Column | str, code: str, detail: Column, key: list[str]) -> DataFrame:
    return rows.filter(cond).select(*key, F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def item_issues(items: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Schema of stored items: unknown node, family not the node's, bad enums, empty quote, ranges
    upside down or beyond the document's hash, references used twice."""
    key = ["file_key", "item_ref"]
    known = items.join(F.broadcast(nodes.select("taxonomy_id", F.col("family").alias("_nf"))), "taxonomy_id", "left").join(files.select("file_key", F.col("content_hash").alias("_h")), "file_key", "left")
    twice = known.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("item_ref")))
    return union([
        issue(known, "_nf is null", "unknown_node", F.col("taxonomy_id"), key),
        issue(known, "_nf is not null and _nf <> family", "family_mismatch", F.col("family"), key),
        issue(known, ~F.col("statement_polarity").isin(POLARITIES), "bad_polarity", F.col("statement_polarity"), key),
        issue(known, ~F.col("review_status").isin(REVIEW), "bad_status", F.col("review_status"), key),
        issue(known, "trim(verbatim) = ''", "empty_quote", F.lit(""), key),
        issue(known, "loc_end < loc_start", "bad_range", F.col("loc_start"), key),
        issue(known, "_h is null", "no_document", F.lit(""), key),
        issue(known, "_h is not null and txt_hash <> _h", "stale", F.col("txt_hash"), key),
        issue(twice, "_n > 1", "repeated_ref", F.col("_n"), key),
    ])


def evidence_issues(items: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Quotes whose range has no paragraph, and quotes that do not stand in their range (blanks
    aside)."""
    inside = items.join(paragraphs, "file_key").filter("para between loc_start and loc_end")
    parts = F.array_sort(F.collect_list(F.struct("para", "content")))
    texts = inside.groupBy("file_key", "item_ref").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "").alias("_t"))
    rows = items.select("file_key", "item_ref", "verbatim", "loc_start").join(texts, ["file_key", "item_ref"], "left")
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    key = ["file_key", "item_ref"]
    return union([issue(rows, "_t is null", "no_location", F.col("loc_start"), key), issue(rows, F.col("_t").isNotNull() & ~F.contains(squeeze(F.col("_t")), squeeze(F.col("verbatim"))), "not_in_range", F.col("loc_start"), key)])


def candidate_issues(candidates: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Candidates with an unknown parent, a parent of another family, a name that already is an
    alias or label, or without evidence."""
    key = ["candidate_id"]
    parents = nodes.select(F.col("taxonomy_id").alias("recommended_parent_id"), F.col("family").alias("_pf"))
    rows = candidates.join(F.broadcast(parents), "recommended_parent_id", "left")
    names = F.broadcast(aliases.select(F.lower("alias").alias("_n")).union(nodes.select(F.lower("label"))).distinct())
    taken = rows.join(names, F.lower(F.trim("proposed_ko")) == F.col("_n"), "left_semi")
    return union([
        issue(rows, "_pf is null", "unknown_parent", F.col("recommended_parent_id"), key),
        issue(rows, "_pf is not null and _pf <> family", "parent_family", F.col("_pf"), key),
        issue(taken, F.lit(True), "name_taken", F.col("proposed_ko"), key),
        issue(rows, "trim(coalesce(verbatim, '')) = ''", "no_evidence", F.lit(""), key),
    ])


def source_issues(declared: DataFrame, reported: DataFrame) -> DataFrame:
    """Sources declared without a report and reports of undeclared sources (file_key, family,
    source_id on both sides)."""
    key = ["file_key", "family", "source_id"]
    both = declared.select(*key).withColumn("_d", F.lit(True)).join(reported.select(*key).withColumn("_r", F.lit(True)), key, "full")
    return both.filter("_d is null or _r is null").select(*key, F.when(F.col("_r").isNull(), "not_reported").otherwise("not_declared").alias("code"))


def coverage_issues(coverage: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Coverage that cannot be right: not evaluated although items exist, no annex although sources
    exist, complete although a source is not."""
    key = ["file_key", "family"]
    n_items = items.groupBy(*key).agg(F.count(F.lit(1)).alias("_items"))
    src = sources.groupBy(*key).agg(F.count(F.lit(1)).alias("_sources"), F.bool_and(F.col("status") == "complete").alias("_done"))
    rows = coverage.join(n_items, key, "left").join(src, key, "left")
    return union([
        issue(rows, "body_status = 'not_evaluated' and _items > 0", "items_without_evaluation", F.col("_items"), key),
        issue(rows, "annex_status = 'no_annex' and _sources > 0", "sources_without_annex", F.col("_sources"), key),
        issue(rows, "annex_status = 'complete' and not coalesce(_done, true)", "annex_not_done", F.col("_sources"), key),
    ])


def dictionary_issues(terms: DataFrame, mapping: DataFrame, nodes: DataFrame, avoid: DataFrame) -> DataFrame:
    """Dictionary: bad strength, variants of several entries, entries that avoid themselves,
    mappings to unknown entries or nodes."""
    key = ["subject"]
    strong = terms.select(F.concat_ws(":", "canonical", "variant").alias("subject"), "strength")
    shared = terms.groupBy(F.lower("variant").alias("subject")).agg(F.array_join(F.array_sort(F.collect_set("canonical")), "|").alias("_c"), F.count_distinct("canonical").alias("_n"))
    own = avoid.join(terms, ["canonical", "variant"], "left_semi").select(F.concat_ws(":", "canonical", "variant").alias("subject"))
    no_entry = mapping.join(terms, "canonical", "left_anti").select(F.col("canonical").alias("subject"), "taxonomy_id")
    no_node = mapping.join(nodes, "taxonomy_id", "left_anti").select(F.col("canonical").alias("subject"), "taxonomy_id")
    return union([
        issue(strong, ~F.col("strength").isin("strict", "normal", "broad"), "bad_strength", F.col("strength"), key),
        issue(shared, "_n > 1", "shared_variant", F.col("_c"), key),
        issue(own, F.lit(True), "avoids_itself", F.lit(""), key),
        issue(no_entry, F.lit(True), "unknown_entry", F.col("taxonomy_id"), key),
        issue(no_node, F.lit(True), "unknown_node", F.col("taxonomy_id"), key),
    ])


def heading_omissions(headings: DataFrame, items: DataFrame, accepted: DataFrame) -> DataFrame:
    """Headings (file_key, para, sub) whose sub-domain has no item in the document and which
    nobody has accepted as empty (file_key, sub)."""
    from docloom.functions.text import subdomain

    have = items.select("file_key", subdomain(F.col("taxonomy_id")).alias("sub")).distinct()
    return headings.join(have, ["file_key", "sub"], "left_anti").join(accepted, ["file_key", "sub"], "left_anti")


def item_surge(items: DataFrame, previous: DataFrame, factor: int = 3, least: int = 3) -> DataFrame:
    """Documents and families whose items grew ``factor`` times or more over ``least`` or more."""
    key = ["file_key", "family"]
    now = items.groupBy(*key).agg(F.count(F.lit(1)).alias("now"))
    before = previous.groupBy(*key).agg(F.count(F.lit(1)).alias("before"))
    return now.join(before, key).filter((F.col("before") >= least) & (F.col("now") >= factor * F.col("before")))


def audit_status(files: DataFrame, errors: DataFrame, reviews: DataFrame, pending: DataFrame) -> DataFrame:
    """error before review before pending before pass, with the counts of findings."""
    count = lambda df, name: df.groupBy("file_key").agg(F.count(F.lit(1)).alias(name))
    rows = files.select("file_key")
    for df, name in ((errors, "errors"), (reviews, "reviews"), (pending, "pendings")):
        rows = rows.join(count(df, name), "file_key", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    state = F.when(F.col("errors") > 0, "error").when(F.col("reviews") > 0, "review").when(F.col("pendings") > 0, "pending").otherwise("pass")
    return rows.withColumn("audit", state)
