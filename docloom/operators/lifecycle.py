"""Batched upkeep of items, coverage and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import subdomain


def replace_results(old: DataFrame, new: DataFrame, keys: list[str], preserved: DataFrame | None = None) -> DataFrame:
    """New rows replace all old rows of their documents (and families); preserved old rows
    (by item_ref) stay, unless the new ones hold the same reference."""
    gone = new.select(*keys).distinct()
    kept = old.join(gone, keys, "left_anti")
    if preserved is not None:
        held = old.join(gone, keys, "left_semi").join(preserved, "item_ref", "left_semi").join(new, [*keys, "item_ref"], "left_anti")
        kept = kept.unionByName(held)
    return kept.unionByName(new)


def admit(candidates: DataFrame, key: Column) -> DataFrame:
    """Candidates with decision: admitted (parent below a root, or the key is seen in two documents
    or more) or absorbed (then target is the family's catch-all node)."""
    keyed = candidates.withColumn("recurrence_key", key)
    docs = keyed.groupBy("recurrence_key").agg(F.count_distinct("evidence_file_key").alias("documents"))
    rows = keyed.join(docs, "recurrence_key")
    ok = F.contains("recommended_parent_id", F.lit(".")) | (F.col("documents") >= 2)
    return rows.withColumn("decision", F.when(ok, "admitted").otherwise("absorbed")).withColumn("target", F.when(~ok, F.concat("family", F.lit(".OTHER"))))


def absorbed_items(admitted: DataFrame) -> DataFrame:
    """Items that absorbed candidates become."""
    rows = admitted.filter("decision = 'absorbed'")
    return rows.select(F.col("evidence_file_key").alias("file_key"), F.concat(F.lit("c-"), F.col("candidate_id").cast("string")).alias("item_ref"), F.col("target").alias("taxonomy_id"), "family", "verbatim", "loc_start")


def resolve_batch(candidates: DataFrame, plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outcome of a plan (candidate_id, action, target): merge, promote and reject, or why not.

    Refused: unknown or decided candidates, merges into unknown or foreign nodes, promotions to
    an id that exists, two actions for one candidate.
    """
    twice = plan.groupBy("candidate_id").agg(F.count_distinct("action").alias("_n"))
    rows = plan.join(candidates.select("candidate_id", "family", "status"), "candidate_id", "left").join(F.broadcast(nodes.select(F.col("taxonomy_id").alias("target"), F.col("family").alias("_tf"))), "target", "left").join(twice, "candidate_id")
    why = (
        F.when(F.col("family").isNull(), "unknown_candidate")
        .when(F.col("status") != "pending", "decided")
        .when(F.col("_n") > 1, "two_actions")
        .when((F.col("action") == "merge") & F.col("_tf").isNull(), "unknown_target")
        .when((F.col("action") == "merge") & (F.col("_tf") != F.col("family")), "foreign_target")
        .when((F.col("action") == "promote") & F.col("_tf").isNotNull(), "target_exists")
    )
    return rows.select("candidate_id", "action", "target", F.coalesce(why, F.lit("applied")).alias("outcome"))


def merged_items(candidates: DataFrame, outcome: DataFrame) -> DataFrame:
    """One item per candidate and target of the applied merges and promotions."""
    good = outcome.filter("outcome = 'applied' and action <> 'reject'")
    return candidates.join(good, "candidate_id").select(F.col("evidence_file_key").alias("file_key"), F.concat_ws("-", F.lit("m"), F.col("candidate_id").cast("string"), "target").alias("item_ref"), F.col("target").alias("taxonomy_id"), "verbatim", "loc_start")


def regression_guard(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document: sub-domains before and after, what was lost, and whether to store."""
    subs = lambda df, name: df.groupBy("file_key").agg(F.array_sort(F.collect_set(subdomain(F.col("taxonomy_id")))).alias(name))
    rows = subs(new, "after").join(subs(old, "before"), "file_key", "left").withColumn("before", F.coalesce("before", F.array().cast("array<string>")))
    lost = F.array_except("before", "after")
    return rows.select("file_key", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"), F.array_join(lost, "|").alias("lost"), F.when(F.size(lost) > 0, "refused").otherwise("stored").alias("decision"))


def downgrade(coverage: DataFrame, flagged: DataFrame, reason: str) -> DataFrame:
    """Coverage after an audit with the status before it: flagged complete rows become partial."""
    rows = coverage.join(flagged.select("file_key", "family").distinct().withColumn("_f", F.lit(True)), ["file_key", "family"], "left")
    hit = F.col("_f") & (F.col("body_status") == "complete")
    return rows.select("file_key", "family", F.col("body_status").alias("before"), F.when(hit, "partial").otherwise(F.col("body_status")).alias("body_status"), F.when(hit, reason).otherwise("").alias("reason"))


def guarded_apply(current: DataFrame, planned: DataFrame, key: str, column: str) -> DataFrame:
    """Planned changes (key, old, new) on the current rows: applied, or refused if the row is gone
    or no longer has the old value."""
    now = current.select(key, F.col(column).alias("_now"))
    rows = planned.join(now, key, "left")
    state = F.when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("old"), "changed").otherwise("applied")
    return rows.select(key, "old", "new", state.alias("state"))


def scope_corrections(files: DataFrame, items: DataFrame, candidates: DataFrame, coverage: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings of the scope check: ancillary documents that nothing was read from (every family
    not evaluated, no items, no candidates), and items on nodes that have children."""
    idle = coverage.groupBy("file_key").agg(F.bool_and(F.col("body_status") == "not_evaluated").alias("_idle")).filter("_idle")
    ancillary = files.filter(F.lower("filename").rlike("notes|bidding"))
    empty = ancillary.join(idle, "file_key", "left_semi").join(items, "file_key", "left_anti").join(candidates.select(F.col("evidence_file_key").alias("file_key")), "file_key", "left_anti")
    inner = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("taxonomy_id")).distinct()
    held = items.join(F.broadcast(inner), "taxonomy_id", "left_semi").groupBy("file_key").agg(F.count(F.lit(1)).alias("n"))
    return empty.select("file_key", F.lit("idle_ancillary").alias("code"), F.lit(0).cast("long").alias("n")).unionByName(held.select("file_key", F.lit("inner_node").alias("code"), "n"))


def store_passed(audited: DataFrame, include_review: bool = False) -> DataFrame:
    """Which documents of an audit are stored; the others get the reason."""
    ok = F.col("audit").isin("pass", "review") if include_review else F.col("audit") == "pass"
    return audited.select("file_key", F.when(ok, "stored").otherwise("skipped").alias("outcome"), F.when(~ok, F.col("audit")).otherwise("").alias("reason"))


def conversion_worklist(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files still to convert: not done with the same path and hash; rejected kinds are told."""
    known = done.filter("status = 'ok'").select("path", "sha256")
    rows = files.join(known, ["path", "sha256"], "left_anti")
    return rows.select("path", "sha256", F.when(F.col("kind") == "ole2", "convert").otherwise(F.concat(F.lit("rejected_"), "kind")).alias("state"))


def finalize(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """Each evidence text of a document once, by source priority (file_key, text, source, prio),
    with its labels (text, labels); texts without a label stay unresolved."""
    w = W.partitionBy("file_key", F.md5(F.trim("text"))).orderBy("prio", "para")
    one = evidence.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    rows = one.join(labels, "text", "left")
    return rows.select("file_key", "para", "source", F.coalesce("labels", F.lit("")).alias("labels"), F.when(F.coalesce("labels", F.lit("")) == "", "unresolved").otherwise("resolved").alias("state"))


def coverage_from_evidence(final: DataFrame) -> DataFrame:
    """Body status of each document after finalising: complete if nothing is unresolved."""
    return final.groupBy("file_key").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("state") == "unresolved").alias("open")).withColumn("body_status", F.when(F.col("open") == 0, "complete").otherwise("partial"))


def work_inputs(ranges: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One JSON row per document: its ranges with their paragraphs."""
    inside = ranges.join(paragraphs, "file_key").filter("para between from_para and to_para")
    parts = inside.groupBy("file_key", "family", "from_para", "to_para").agg(F.array_sort(F.collect_list(F.struct("para", "content"))).alias("paragraphs"))
    return parts.groupBy("file_key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("family", "from_para", "to_para", "paragraphs")))).alias("input"), F.count(F.lit(1)).alias("ranges"))
