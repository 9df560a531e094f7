"""Reports that prepare a reviewer's decisions: absence pools, missing leaves, candidate plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators.extraction import fitting_rules, multi_label
from docloom.operators.patterns import pattern_hits


def absence_pool(files: DataFrame, coverage: DataFrame, items: DataFrame, paragraphs: DataFrame, sub: str, words: DataFrame, shown: int = 5) -> DataFrame:
    """Documents whose family is complete but which have no item at or below ``sub``.

    cls is 'suspect' if a word (words: word) stands in the text, 'no_txt' without paragraphs,
    else 'clean_absent'; matched_terms has the first ``shown`` words; representative marks the
    first document of each duplicate group.  Words are a parameter table.
    """
    done = coverage.filter((F.col("family") == sub.split(".")[0]) & (F.col("body_status") == "complete")).select("file_key")
    below = (F.col("taxonomy_id") == sub) | F.startswith("taxonomy_id", F.lit(sub + "."))
    pool = files.filter("status = 'ok' and coalesce(char_count, 0) > 0").join(done, "file_key", "left_semi").join(items.filter(below), "file_key", "left_anti")
    pool = pool.select("file_key", F.coalesce("dup_group", "file_key").alias("dup_group"))
    read = paragraphs.join(pool, "file_key", "left_semi")
    found = pattern_hits(read.select("file_key", "content"), words.select(F.col("word").alias("needle"), F.lit(False).alias("bounded")))
    hits = found.join(words.withColumn("needle", F.lower("word")), "needle").groupBy("file_key").agg(F.array_sort(F.collect_set("word")).alias("found"))
    texts = read.select("file_key").distinct().withColumn("text", F.lit(True))
    first = pool.groupBy("dup_group").agg(F.min("file_key").alias("first"))
    rows = pool.join(texts, "file_key", "left").join(hits, "file_key", "left").join(first, "dup_group")
    cls = F.when(F.col("text").isNull(), "no_txt").when(F.col("found").isNotNull(), "suspect").otherwise("clean_absent")
    terms = F.coalesce(F.array_join(F.slice("found", 1, shown), "|"), F.lit(""))
    return rows.select("file_key", "dup_group", cls.alias("cls"), terms.alias("matched_terms"), (F.col("file_key") == F.col("first")).alias("representative"))


def pool_report(pool: DataFrame) -> DataFrame:
    """One row: size of the pool, of its representatives, their classes and share of suspects."""
    one = lambda cls: F.count_if(F.col("representative") & (F.col("cls") == cls)).alias(cls)
    t = pool.agg(F.count(F.lit(1)).alias("pool_raw"), F.count_if("representative").alias("pool_deduped"), one("clean_absent"), one("suspect"), one("no_txt"))
    return t.withColumn("suspect_rate", F.bround(F.try_divide("suspect", "pool_deduped"), 4))


def leaf_hits(paragraphs: DataFrame, leaves: DataFrame) -> DataFrame:
    """First paragraph of each document that fits a proposed leaf (leaves: taxonomy_id, pattern,
    a parameter table): taxonomy_id, file_key, para."""
    table = [(F.col("content").rlike(r["pattern"]), F.lit(r["taxonomy_id"])) for r in leaves.collect()]
    hit = paragraphs.select("file_key", "para", F.explode(fitting_rules(F.col("content"), table)).alias("taxonomy_id"))
    return hit.groupBy("taxonomy_id", "file_key").agg(F.min("para").alias("para"))


def leaf_gaps(paragraphs: DataFrame, leaves: DataFrame, shown: int = 5) -> DataFrame:
    """Per proposed leaf: its documents and the first ``shown`` pieces of evidence (the feature's
    own limit), one row each; a leaf without a hit has one row without evidence."""
    hits = leaf_hits(paragraphs, leaves)
    counts = hits.groupBy("taxonomy_id").agg(F.count(F.lit(1)).alias("documents"))
    w = W.partitionBy("taxonomy_id").orderBy("file_key")
    # row_number against a constant: each task passes on at most ``shown`` rows of a leaf
    top = hits.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= shown)
    flat = F.trim(F.regexp_replace("content", r"\s+", " "))
    evidence = paragraphs.join(F.broadcast(top), ["file_key", "para"]).select("taxonomy_id", "nth", "file_key", "para", F.substring(flat, 1, 320).alias("evidence"))
    rows = leaves.select("taxonomy_id").join(counts, "taxonomy_id", "left").join(evidence, "taxonomy_id", "left")
    return rows.withColumn("documents", F.coalesce("documents", F.lit(0).cast("long")))


def leaf_ranking(paragraphs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Documents by the number of proposed leaves that they bear out."""
    return leaf_hits(paragraphs, leaves).groupBy("file_key").agg(F.count(F.lit(1)).alias("hit_count"))


def candidate_review(candidates: DataFrame, rules: DataFrame, nodes: DataFrame, non_atomic: Column) -> DataFrame:
    """A verdict on each pending candidate: merge, reject or unresolved.

    Its text is read by the rules (each different text once).  Without a label it is rejected if
    ``non_atomic`` holds.  With labels it is merged if all are known nodes of one family, which
    may be another than its own only for evidence from the body.
    """
    pending = candidates.filter("status = 'pending'").withColumn("_no", F.coalesce(non_atomic, F.lit(False)))
    read = multi_label(pending, "verbatim", rules, ["candidate_id", "family", "source_kind", "_no"])
    sets = read.filter("labels <> ''").select("labels").distinct()
    each = sets.select("labels", F.explode(F.split("labels", r"\|")).alias("taxonomy_id"))
    known = each.join(F.broadcast(nodes.select("taxonomy_id", F.col("family").alias("_f"))), "taxonomy_id", "left")
    known = known.groupBy("labels").agg(F.array_sort(F.collect_set("_f")).alias("_fs"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_f").isNull(), F.col("taxonomy_id")))), "|").alias("unknown"))
    rows = read.join(known, "labels", "left")
    target = F.when(F.size("_fs") == 1, F.col("_fs")[0])
    moved = (target != F.col("family")) & (F.coalesce("source_kind", F.lit("body")) != "body")
    verdict = F.when((F.col("labels") == "") & F.col("_no"), "reject").when((F.col("labels") == "") | (F.col("unknown") != "") | target.isNull() | moved, "unresolved").otherwise("merge")
    rows = rows.withColumn("verdict", verdict).withColumn("target_family", F.when(F.col("verdict") == "merge", target))
    return rows.select("candidate_id", "family", "verdict", "labels", "target_family", F.coalesce("unknown", F.lit("")).alias("unknown"))


def review_groups(reviewed: DataFrame) -> DataFrame:
    """Groups of the plan with their candidates and the items that a merge makes."""
    merged = F.col("verdict") == "merge"
    rows = reviewed.withColumn("labels", F.when(merged, F.col("labels")).otherwise(""))
    groups = rows.groupBy("verdict", "family", "target_family", "labels").agg(F.count(F.lit(1)).alias("candidates"))
    return groups.withColumn("items", F.when(merged, F.col("candidates") * F.size(F.split("labels", r"\|"))).otherwise(0)).withColumn("reassigned", F.coalesce(F.col("target_family") != F.col("family"), F.lit(False)))


def review_targets(reviewed: DataFrame) -> DataFrame:
    """How often each node is a target of merges, and each unknown one was named."""
    merges = reviewed.filter("verdict = 'merge'").select(F.lit("target").alias("kind"), F.explode(F.split("labels", r"\|")).alias("taxonomy_id"))
    others = reviewed.filter("unknown <> ''").select(F.lit("unknown").alias("kind"), F.explode(F.split("unknown", r"\|")).alias("taxonomy_id"))
    return merges.union(others).groupBy("kind", "taxonomy_id").agg(F.count(F.lit(1)).alias("n"))
