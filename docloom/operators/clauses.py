"""Taxonomy, coverage and the three questions on clause items: present, absent, compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import alias_key, occurrences, signature, subdomain
from docloom.operators.search import bm25
from docloom.operators.stats import blocked_candidates


def subtree(nodes: DataFrame, root: str, include_root: bool = True) -> DataFrame:
    """Nodes at and below ``root`` by parent links, with their depth; a recursive query.

    Where nodes have a status only active ones count, and what hangs below a retired node does
    not.  Parents that form a cycle end where a path meets itself; paths may be of any length.
    """
    live = nodes.filter("status = 'active'") if "status" in nodes.columns else nodes
    out = nodes.sparkSession.sql(
        "WITH RECURSIVE t(taxonomy_id, depth, path) MAX RECURSION LEVEL 100000 AS (SELECT taxonomy_id, 0, array(taxonomy_id) FROM {live} WHERE taxonomy_id = :root"
        " UNION ALL SELECT n.taxonomy_id, t.depth + 1, array_append(t.path, n.taxonomy_id) FROM {live} n JOIN t ON n.parent_id = t.taxonomy_id WHERE NOT array_contains(t.path, n.taxonomy_id)) SELECT taxonomy_id, depth FROM t",
        {"root": root},
        live=live.select("taxonomy_id", "parent_id"),
    )
    return out if include_root else out.filter("depth > 0")


def resolve_node(nodes: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: value.  taxonomy_id of each value by id, label or alias, with state 'ok',
    'not_found' or 'ambiguous' (then choices lists the ids)."""
    names = nodes.select("taxonomy_id", F.lower("taxonomy_id").alias("name")).union(nodes.select("taxonomy_id", alias_key(F.col("label")))).union(aliases.select("taxonomy_id", alias_key(F.col("alias")))).distinct()
    hit = wanted.distinct().withColumn("name", alias_key(F.col("value"))).join(F.broadcast(names), "name", "left").groupBy("value").agg(F.array_sort(F.collect_set("taxonomy_id")).alias("ids"))
    state = F.when(F.size("ids") == 0, "not_found").when(F.size("ids") == 1, "ok").otherwise("ambiguous")
    return hit.select("value", F.when(F.size("ids") == 1, F.col("ids")[0]).alias("taxonomy_id"), state.alias("state"), F.array_join("ids", "|").alias("choices"))


def freshness(item_hash: Column, content_hash: Column) -> Column:
    return F.when(F.coalesce(item_hash, F.lit("")) == F.coalesce(content_hash, F.lit("")), "current").otherwise("stale")


def coverage_states(files: DataFrame, families: DataFrame, coverage: DataFrame, sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """State of every (file, family): complete, or needs_review with its reasons.

    Reasons: not_evaluated, body_*, annex_*, coverage_stale, <kind>_<status>:n, source_stale:n
    and pending:n.  A source kept in another file is stale against that file, and always stale
    if the file is gone.
    """
    pairs = files.select("file_key", "content_hash").crossJoin(F.broadcast(families.select("family")))
    cov = coverage.select("file_key", "family", "body_status", "annex_status", F.col("txt_hash").alias("cov_hash"))
    storage = files.select(F.col("file_key").alias("storage_file_key"), F.when(F.col("status") == "missing", "").otherwise(F.col("content_hash")).alias("_storage_hash"))
    owner = files.select("file_key", F.col("content_hash").alias("_own_hash"))
    src = sources.join(owner, "file_key").join(storage, "storage_file_key", "left")
    expected = F.when(F.col("storage_file_key").isNull(), F.col("_own_hash")).otherwise(F.coalesce("_storage_hash", F.lit("")))
    src = src.withColumn("_stale", F.coalesce("txt_hash", F.lit("")) != expected)
    by_status = src.filter("status <> 'complete'").groupBy("file_key", "family", "source_kind", "status").agg(F.count(F.lit(1)).alias("n"))
    by_status = by_status.groupBy("file_key", "family").agg(F.array_sort(F.collect_list(F.concat("source_kind", F.lit("_"), "status", F.lit(":"), F.col("n").cast("string")))).alias("_kinds"))
    stale = src.filter("_stale").groupBy("file_key", "family").agg(F.count(F.lit(1)).alias("_n_stale"))
    pending = blocked_candidates(candidates, signature(F.col("proposed_ko"))).filter("blocks").groupBy(F.col("evidence_file_key").alias("file_key"), "family").agg(F.count(F.lit(1)).alias("_n_pending"))
    rows = pairs
    for other in (cov, by_status, stale, pending):
        rows = rows.join(other, ["file_key", "family"], "left")
    has = F.col("body_status").isNotNull()
    reasons = F.array_compact(
        F.concat(
            F.array(
                F.when(~has, "not_evaluated"),
                F.when(has & (F.col("body_status") != "complete"), F.concat(F.lit("body_"), "body_status")),
                F.when(has & ~F.col("annex_status").isin("complete", "no_annex"), F.concat(F.lit("annex_"), "annex_status")),
                F.when(has & (F.coalesce("cov_hash", F.lit("")) != F.coalesce("content_hash", F.lit(""))), "coverage_stale"),
            ),
            F.coalesce("_kinds", F.array().cast("array<string>")),
            F.array(F.when(F.col("_n_stale") > 0, F.concat(F.lit("source_stale:"), F.col("_n_stale").cast("string"))), F.when(F.col("_n_pending") > 0, F.concat(F.lit("pending:"), F.col("_n_pending").cast("string")))),
        )
    )
    return rows.select("file_key", "family", F.when(F.size(reasons) == 0, "complete").otherwise("needs_review").alias("state"), F.array_join(reasons, "|").alias("reasons"))


def first_of_group(files: DataFrame) -> DataFrame:
    """The file with the least key of each duplicate group."""
    low = files.groupBy("dup_group").agg(F.min("file_key").alias("file_key"))
    return files.join(low, ["dup_group", "file_key"], "left_semi")


def search_items(items: DataFrame, nodes: DataFrame, files: DataFrame, coverage: DataFrame, root: str, polarity: str | None = None, tokens: list[str] | None = None) -> DataFrame:
    """Items of a subtree with node label, file fields, freshness and coverage state.  Tokens must
    all stand in the text."""
    ids = F.broadcast(subtree(nodes, root).select("taxonomy_id"))
    rows = items.join(ids, "taxonomy_id", "left_semi")
    if polarity:
        rows = rows.filter(F.col("statement_polarity") == polarity)
    for t in tokens or []:
        rows = rows.filter(F.contains(F.lower("verbatim"), F.lit(t.lower())))
    rows = rows.join(F.broadcast(nodes.select("taxonomy_id", "label")), "taxonomy_id")
    rows = rows.join(files.filter("status = 'ok'").select("file_key", "content_hash", "ctype", "dup_group"), "file_key")
    rows = rows.withColumn("freshness", freshness(F.col("txt_hash"), F.col("content_hash")))
    return rows.join(coverage.select("file_key", "family", F.col("state").alias("coverage")), ["file_key", "family"], "left").withColumn("coverage", F.coalesce("coverage", F.lit("needs_review")))


def text_order(tokens: list[str]) -> list[Column]:
    """Contiguous phrase first, then how many tokens stand there, their place, length, keys."""
    text, far = F.lower("verbatim"), 2147483647
    phrase = F.contains(text, F.lit(" ".join(tokens).lower()))
    place = F.least(*[F.when(F.instr(text, t.lower()) > 0, F.instr(text, t.lower())).otherwise(far) for t in tokens], F.lit(far))
    return [phrase.desc(), place.asc(), F.length("verbatim").asc(), F.col("file_key").asc(), F.col("loc_start").asc(), F.col("item_ref").asc()]


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of the ordered rows with totals of all rows: items, documents, stale items,
    has_more, and two hints (a broad result without text; nothing found for several tokens)."""
    totals = rows.agg(F.count(F.lit(1)).alias("total_items"), F.count_distinct("file_key").alias("total_documents"), F.count_if(F.col("freshness") == "stale").alias("total_stale"))
    shown = rows.orderBy(*order).offset(offset).limit(limit)
    return shown.crossJoin(F.broadcast(totals)).withColumn("has_more", F.col("total_items") > offset + limit).withColumn("low_signal", F.col("total_items") > 200)


def search_rank(rows: DataFrame, items: DataFrame, text: str | None) -> DataFrame:
    """The rows with ``order_key``, smallest first.

    Text with a token of three characters or more: the whole text in a row first, then bm25 of
    those tokens (frequencies over all ``items``), then the length.  Shorter tokens only: how
    many stand there, the whole text, the first token's place, the length.  No text: the place.
    """
    tokens = (text or "").lower().split()
    long, low = [t for t in tokens if len(t) >= 3], F.lower("verbatim")
    has = lambda t: F.coalesce(F.contains(low, F.lit(t)), F.lit(False))
    tail = [F.length(F.coalesce("verbatim", F.lit(""))), F.col("file_key"), F.col("loc_start"), F.col("item_ref")]
    apart = (~has((text or "").strip().lower())).cast("int")
    if long:
        size = F.greatest(F.length("verbatim") - 2, F.lit(0))
        # one row, whatever the corpus
        total = items.agg(F.count(F.lit(1)).alias("_n"), F.avg(size).alias("_avg"), *[F.count_if(has(t)).alias(f"_h{i}") for i, t in enumerate(long)])
        rows = rows.crossJoin(F.broadcast(total))
        score = sum((bm25(occurrences(F.col("verbatim"), F.lit(t)), size, F.col("_avg"), F.col("_n"), F.col(f"_h{i}")) for i, t in enumerate(long)), F.lit(0.0))
        keys = [apart, F.round(score, 12), *tail]
    elif tokens:
        place = F.when(has(tokens[0]), F.instr(low, tokens[0])).otherwise(2147483647)
        keys = [-sum((has(t).cast("int") for t in tokens), F.lit(0)), apart, place, *tail]
    else:
        keys = tail[1:]
    ranked = rows.withColumn("order_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    return ranked.drop("_n", "_avg", *[f"_h{i}" for i in range(len(long))])


def clause_search(items: DataFrame, nodes: DataFrame, files: DataFrame, coverage: DataFrame, root: str, polarity: str | None = None, subject: str | None = None, effective_time: str | None = None, text: str | None = None, dedup: bool = True) -> DataFrame:
    """Approved items of a subtree that fit all filters, with ``order_key``.

    Subject and time are compared without case; every token of the text must stand in the item.
    With ``dedup`` only the file of a duplicate group's first item stays, with all its items.
    """
    rows = items.filter("review_status = 'approved'")
    for column, value in (("subject_role", subject), ("effective_time", effective_time)):
        if value:
            rows = rows.filter(F.lower(F.coalesce(column, F.lit(""))) == value.strip().lower())
    rows = search_rank(search_items(rows, nodes, files, coverage, root, polarity, (text or "").lower().split()), items, text)
    if dedup:
        first = rows.groupBy("dup_group").agg(F.min_by("file_key", "order_key").alias("file_key"))
        rows = rows.join(first, ["dup_group", "file_key"], "left_semi")
    return rows


def search_page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy("order_key").offset(offset).limit(limit).drop("order_key")


def search_summary(rows: DataFrame, limit: int, offset: int = 0, signal: bool = False, text: bool = False, population: int = 200) -> DataFrame:
    """One row: totals, returned items, has_more, next_offset (null at the end) and two hints:
    many items without anything that ranks them; nothing found although every token had to fit."""
    t = rows.agg(F.count(F.lit(1)).alias("total_items"), F.count_distinct("file_key").alias("total_documents"), F.count_if(F.col("freshness") == "stale").alias("total_stale"))
    n = F.col("total_items")
    t = t.withColumn("returned_items", F.greatest(F.least(n - offset, F.lit(limit).cast("long")), F.lit(0).cast("long")))
    end = F.col("returned_items") + offset
    return t.withColumns({"has_more": end < n, "next_offset": F.when(end < n, end), "low_signal": (n > population) & F.lit(not signal and not text), "zero_result": (n == 0) & F.lit(text)})


def dedup_items(rows: DataFrame, order: list[Column]) -> DataFrame:
    """All items of one file per duplicate group: the file of the group's first-ranked item."""
    w = W.partitionBy("dup_group").orderBy(*order)
    return rows.withColumn("_rep", F.first("file_key").over(w)).filter("_rep = file_key").drop("_rep")


def absence(files: DataFrame, items: DataFrame, nodes: DataFrame, coverage: DataFrame, root: str, gated: tuple = (), admitted: tuple = ()) -> DataFrame:
    """State of each document for a node: present_excluded, confirmed_absent or needs_review.

    Absence is only confirmed where the family's coverage is complete, and never for a gated
    family unless the node's sub-domain is admitted.
    """
    family = root.split(".")[0]
    docs = first_of_group(files.filter("status = 'ok'")).select("file_key", "dup_group")
    ids = F.broadcast(subtree(nodes, root).select("taxonomy_id"))
    found = items.join(ids, "taxonomy_id", "left_semi").groupBy("file_key").agg(F.count(F.lit(1)).alias("items"))
    cov = coverage.filter(F.col("family") == family).select("file_key", "state", "reasons")
    is_gated = family in gated and ".".join(root.split(".")[:2]) not in admitted
    rows = docs.join(found, "file_key", "left").join(cov, "file_key", "left")
    reasons = F.concat_ws("|", F.nullif(F.coalesce("reasons", F.lit("not_evaluated")), F.lit("")), F.lit("family_gated") if is_gated else F.lit(None).cast("string"))
    state = F.when(F.col("items") > 0, "present_excluded").when((F.col("state") == "complete") & F.lit(not is_gated), "confirmed_absent").otherwise("needs_review")
    return rows.select("file_key", F.coalesce("items", F.lit(0)).alias("items"), state.alias("answer"), F.when(state == "needs_review", reasons).otherwise("").alias("why"))


def compare(files: DataFrame, items: DataFrame, nodes: DataFrame, coverage: DataFrame, root: str, keys: DataFrame) -> DataFrame:
    """Answer for each of the chosen documents (keys: file_key).  The family gate of ``absence``
    is not applied here."""
    family = root.split(".")[0]
    ids = F.broadcast(subtree(nodes, root).select("taxonomy_id"))
    chosen = files.join(F.broadcast(keys), "file_key", "left_semi").select("file_key", "content_hash")
    fresh = items.join(ids, "taxonomy_id", "left_semi").join(chosen, "file_key").groupBy("file_key").agg(F.bool_or(freshness(F.col("txt_hash"), F.col("content_hash")) == "current").alias("current"), F.count(F.lit(1)).alias("items"))
    cov = coverage.filter(F.col("family") == family).select("file_key", "state", "reasons")
    rows = chosen.join(fresh, "file_key", "left").join(cov, "file_key", "left")
    answer = F.when(F.col("current"), "confirmed_present").when(F.col("items") > 0, "needs_review").when(F.col("state") == "complete", "confirmed_absent").otherwise("needs_review")
    return rows.select("file_key", F.coalesce("items", F.lit(0)).alias("items"), answer.alias("answer"))


def provable_absence(coverage: DataFrame) -> DataFrame:
    return coverage.withColumn("provable", (F.col("body_status") == "complete") & F.col("annex_status").isin("complete", "no_annex"))


def never_in_subtree(coverage: DataFrame, items: DataFrame, family: str, prefix: str) -> DataFrame:
    """Documents complete for a family without an item at or below ``prefix``."""
    below = (F.col("taxonomy_id") == prefix) | F.startswith("taxonomy_id", F.lit(prefix + "."))
    done = coverage.filter((F.col("family") == family) & (F.col("body_status") == "complete")).select("file_key")
    return done.join(items.filter(below), "file_key", "left_anti")


def nearest_ancestor(rows: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """Longest known prefix of each dotted id (null if none): column, known."""
    parts = F.split(column, r"\.")
    ids = rows.select(column).distinct().withColumn("_d", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("_p", F.array_join(F.slice(parts, 1, F.col("_d")), "."))
    known = ids.join(F.broadcast(nodes.select(F.col("taxonomy_id").alias("_p"))), "_p").groupBy(column).agg(F.max_by("_p", "_d").alias("known"))
    return rows.join(known, column, "left")


def core_coverage(items: DataFrame, files: DataFrame, core: list[str]) -> DataFrame:
    """Documents, share and missing core sub-domains: sub, documents, percent."""
    docs = files.filter("status = 'ok'").select("file_key")
    subs = items.select("file_key", subdomain(F.col("taxonomy_id")).alias("sub")).distinct().join(docs, "file_key", "left_semi")
    domain = items.sparkSession.createDataFrame([(s,) for s in core], "sub string")
    total = docs.agg(F.count(F.lit(1)).alias("docs"))
    counts = domain.join(subs.groupBy("sub").agg(F.count(F.lit(1)).alias("n")), "sub", "left").crossJoin(F.broadcast(total))
    return counts.select("sub", F.coalesce("n", F.lit(0)).alias("documents"), F.bround(100.0 * F.coalesce("n", F.lit(0)) / F.col("docs"), 1).alias("percent"))


def reextraction_plan(items: DataFrame, files: DataFrame, core: list[str], least: int) -> DataFrame:
    """Documents with fewer than ``least`` core sub-domains: present and missing ones."""
    have = items.groupBy("file_key").agg(F.collect_set(subdomain(F.col("taxonomy_id"))).alias("subs"))
    rows = files.filter("status = 'ok'").select("file_key", "ctype").join(have, "file_key", "left").withColumn("subs", F.coalesce("subs", F.array().cast("array<string>")))
    wanted = F.array(*[F.lit(s) for s in core])
    rows = rows.withColumn("present", F.array_sort(F.array_intersect(wanted, "subs"))).withColumn("missing", F.array_sort(F.array_except(wanted, F.col("subs"))))
    return rows.filter(F.size("present") < least).select("file_key", "ctype", F.array_join("present", "|").alias("present"), F.array_join("missing", "|").alias("missing"))
