"""Change sets: what follows from replaced results and from resolved candidates.

Counts of documents per key are kept up by differences, resolved items are carried over to
fresh results one to one, and resolutions become one table of changes from which all next
tables follow together, or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import alias_key

#: Form of a node's id, candidates of a batch and targets of a merge at most.
NODE_ID = r"^[A-Z][A-Z0-9_]*(\.[A-Z0-9_]+)+$"
MOST_CANDIDATES, MOST_TARGETS = 500, 20


def padded(number: Column, width: int) -> Column:
    """``number`` with zeros before it; longer ones stay as they are."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def recurrence_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change of each key's number of documents.  old, new: recurrence_key, file_key of the
    replaced documents before and after; keys that stay as they are have no row."""
    before = old.select("recurrence_key", "file_key", F.lit(-1).alias("step"))
    after = new.select("recurrence_key", "file_key", F.lit(1).alias("step"))
    each = before.distinct().unionByName(after.distinct()).filter("recurrence_key is not null")
    pair = each.groupBy("recurrence_key", "file_key").agg(F.sum("step").alias("step")).filter("step <> 0")
    return pair.groupBy("recurrence_key").agg(F.sum("step").alias("delta")).filter("delta <> 0")


def counts_after(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """The next counts (recurrence_key, documents); a key without documents goes.

    Reads the counts and the differences alone, not the candidates.
    """
    both = counts.select("recurrence_key", F.col("documents").cast("long").alias("documents")).unionByName(deltas.select("recurrence_key", F.col("delta").cast("long").alias("documents")))
    return both.groupBy("recurrence_key").agg(F.sum("documents").alias("documents")).filter("documents > 0")


def refreshed_counts(candidates: DataFrame, counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Candidates whose key's count changed, with document_count, which is one at least."""
    touched = counts.join(deltas.select("recurrence_key"), "recurrence_key", "left_semi")
    return candidates.drop("document_count").join(touched, "recurrence_key").withColumn("document_count", F.greatest(F.lit(1).cast("long"), "documents")).drop("documents")


SAME_ITEM = ["file_key", "taxonomy_id", "verbatim", "loc_start", "loc_end", "source_kind", "source_id"]


def carried_over(resolved: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved items of documents whose results are replaced.

    resolved, fresh: SAME_ITEM, family, item_id, item_ref.  The k-th resolved item (by item_id)
    of a place, node and quote becomes the k-th equal fresh one; no fresh item stands for two.
    The others are restored; one whose reference is taken gets <family>-TC<item_id>, with the
    first free suffix -2, -3, ... behind it if need be.

    Returns the next items of these documents (with origin: fresh or restored) and the mapping
    item_id -> new_ref.
    """
    same = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"s{i}") for i, c in enumerate(SAME_ITEM)]
    names = [f"s{i}" for i in range(len(SAME_ITEM))]
    nth = F.row_number().over(W.partitionBy(*names).orderBy("item_id"))  # equal items of one place
    old = resolved.select(*resolved.columns, *same).withColumn("k", nth)
    new = fresh.select("item_id", "item_ref", *same).withColumn("k", nth).select(*names, "k", F.col("item_ref").alias("new_ref"))
    met = old.join(new, [*names, "k"], "left").drop(*names, "k")
    lost = met.filter("new_ref is null").drop("new_ref")
    taken = fresh.select("file_key", "item_ref").distinct().withColumn("taken", F.lit(True))
    base = F.concat(F.col("family"), F.lit("-TC"), padded(F.col("item_id"), 6))
    lost = lost.join(taken, ["file_key", "item_ref"], "left").withColumn("base", base)
    used = fresh.select("file_key", F.regexp_extract("item_ref", r"^(.*-TC\d{6,})(?:-(\d+))?$", 1).alias("base"), F.coalesce(F.regexp_extract("item_ref", r"^(.*-TC\d{6,})(?:-(\d+))?$", 2).try_cast("int"), F.lit(1)).alias("k"))
    used = used.filter("base <> ''").groupBy("file_key", "base").agg(F.collect_set("k").alias("ks"))
    ks = F.coalesce("ks", F.array().cast("array<int>"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(ks) + 1), ks))
    named = F.when(F.col("taken").isNull(), F.col("item_ref")).when(free == 1, F.col("base")).otherwise(F.concat_ws("-", "base", free.cast("string")))
    restored = lost.join(used, ["file_key", "base"], "left").withColumn("item_ref", named)
    back = restored.select(*fresh.columns).withColumn("origin", F.lit("restored"))
    mapping = met.filter("new_ref is not null").select("file_key", "item_id", "new_ref").unionByName(restored.select("file_key", "item_id", F.col("item_ref").alias("new_ref")))
    return fresh.withColumn("origin", F.lit("fresh")).unionByName(back), mapping


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Batches that use a key which an earlier batch (or themselves) used, per batch."""
    first = rows.groupBy(key).agg(F.min("batch_id").alias("first"))
    return rows.join(first, key).filter("batch_id > first").select("batch_id").distinct()


def check_batches(requests: DataFrame, candidates: DataFrame, nodes: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """batch_id, outcome: 'applied', or the first rule that a batch breaks.

    requests: batch_id, action (merge, promote or reject), candidate_ids, targets (nodes of a
    merge; the new node of a promotion), parent_id, label, aliases, reason.  candidates:
    candidate_id, evidence_file_key, family, status, txt_hash.  nodes: taxonomy_id, family,
    status.  aliases: normalized_alias.  files: file_key, content_hash.
    """
    distinct = F.array_distinct(F.filter(F.transform("targets", lambda t: F.trim(t)), lambda t: t != ""))
    ask = requests.withColumns({"targets": F.coalesce(distinct, F.array().cast("array<string>")), "candidate_ids": F.coalesce(F.array_distinct("candidate_ids"), F.array().cast("array<bigint>")), "reason": F.trim(F.coalesce("reason", F.lit("")))})
    own = ask.select("batch_id", F.explode("candidate_ids").alias("candidate_id"))
    hashes = files.select(F.col("file_key").alias("evidence_file_key"), F.coalesce("content_hash", F.lit("")).alias("now"))
    held = own.join(candidates.select("candidate_id", "evidence_file_key", "family", "status", F.coalesce("txt_hash", F.lit("")).alias("read")), "candidate_id", "left").join(hashes, "evidence_file_key", "left")
    stale = (F.col("read") != "") & (F.coalesce("now", F.lit("")) != "") & (F.col("read") != F.col("now"))
    facts = held.groupBy("batch_id").agg(F.count_if(F.col("family").isNull()).alias("unknown"), F.count_if(F.col("status") != "pending").alias("decided"), F.count_distinct("family").alias("families"), F.min("family").alias("family"), F.count_if(stale).alias("stale"))
    live = nodes.filter("status = 'active'").select(F.col("taxonomy_id").alias("target"), F.col("family").alias("tf"))
    aims = ask.filter("action = 'merge'").select("batch_id", F.explode("targets").alias("target")).join(live, "target", "left")
    aims = aims.groupBy("batch_id").agg(F.count_if(F.col("tf").isNull()).alias("lost"), F.count_distinct("tf").alias("t_families"), F.min("tf").alias("t_family"))
    promoted = ask.filter("action = 'promote'").select("batch_id", F.upper(F.element_at("targets", 1)).alias("target"), "parent_id", "label", "aliases")
    exists = nodes.select(F.col("taxonomy_id").alias("target"), F.lit(True).alias("exists"))
    parent = live.select(F.col("target").alias("parent_id"), F.col("tf").alias("parent_family"))
    named = promoted.select("batch_id", F.explode(F.array_distinct(F.transform(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))), alias_key))).alias("normalized_alias"))
    known = named.join(aliases.select("normalized_alias").distinct(), "normalized_alias", "left_semi").select("batch_id").union(_repeated(named, "normalized_alias")).distinct().withColumn("collides", F.lit(True))
    twice_node = _repeated(promoted.select("batch_id", "target"), "target").withColumn("again", F.lit(True))
    new = promoted.join(exists, "target", "left").join(parent, "parent_id", "left").join(known, "batch_id", "left").join(twice_node, "batch_id", "left")
    new = new.select("batch_id", F.col("target").alias("new_id"), "label", F.coalesce("exists", "again", F.lit(False)).alias("exists"), "parent_family", F.coalesce("collides", F.lit(False)).alias("collides"))
    twice = _repeated(own, "candidate_id").withColumn("twice", F.lit(True))
    rows = ask.drop("label").join(facts, "batch_id", "left").join(aims, "batch_id", "left").join(new, "batch_id", "left").join(twice, "batch_id", "left")
    merge, promote = F.col("action") == "merge", F.col("action") == "promote"
    size, aimed = F.size("candidate_ids"), F.size("targets")
    broken = (
        F.when(~F.coalesce(F.col("action").isin("merge", "promote", "reject"), F.lit(False)), "unknown_action")
        .when(size == 0, "no_candidates")
        .when(size > MOST_CANDIDATES, "batch_too_large")
        .when((F.col("action") == "reject") & (F.col("reason") == ""), "reason_required")
        .when(F.col("unknown") > 0, "candidate_not_found")
        .when((F.col("decided") > 0) | F.coalesce("twice", F.lit(False)), "already_resolved")
        .when(F.col("families") != 1, "several_families")
        .when(merge & ((aimed < 1) | (aimed > MOST_TARGETS)), "target_count")
        .when(merge & (F.col("lost") > 0), "target_not_found")
        .when(merge & ((F.col("t_families") != 1) | (F.col("t_family") != F.col("family"))), "family_mismatch")
        .when(promote & ~F.coalesce(F.col("new_id").rlike(NODE_ID), F.lit(False)), "invalid_id")
        .when(promote & ((F.coalesce("label", F.lit("")) == "") | (F.coalesce("parent_id", F.lit("")) == "")), "label_required")
        .when(promote & F.col("exists"), "node_exists")
        .when(promote & F.col("parent_family").isNull(), "parent_not_found")
        .when(promote & (~F.startswith("new_id", F.concat("parent_family", F.lit("."))) | (F.col("parent_family") != F.col("family"))), "family_mismatch")
        .when(promote & F.col("collides"), "alias_collision")
        .when((F.col("action") != "reject") & (F.col("stale") > 0), "stale_candidate")
    )
    return rows.select("batch_id", F.coalesce(broken, F.lit("applied")).alias("outcome"))


def change_table(requests: DataFrame, outcomes: DataFrame, candidates: DataFrame, nodes: DataFrame, version: int, polarity) -> DataFrame:
    """Every change of a set: tbl, key, op (insert or update), batch_id, row (the new row as
    JSON).  Empty if any batch is refused: a set is applied as a whole.

    ``polarity``: a function from a quote's column to its polarity.  The tables are node, alias,
    item, candidate, log and meta.
    """
    fine = outcomes.agg(F.coalesce(F.bool_and(F.col("outcome") == "applied"), F.lit(False)).alias("fine"))  # one row
    good = requests.withColumn("targets", F.array_distinct(F.filter(F.transform("targets", lambda t: F.trim(t)), lambda t: t != ""))).crossJoin(F.broadcast(fine)).filter("fine").drop("fine")
    aimed = F.col("action") != "reject"
    own = good.select("batch_id", "action", "targets", "reason", F.explode(F.array_distinct("candidate_ids")).alias("candidate_id")).join(candidates, "candidate_id")
    status = F.when(F.col("action") == "merge", "merged").when(F.col("action") == "promote", "approved").otherwise("rejected")

    def rows(df: DataFrame, tbl: str, name: Column, op: str, **fields: Column | str) -> DataFrame:
        body = F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]))
        return df.select(F.lit(tbl).alias("tbl"), name.cast("string").alias("key"), F.lit(op).alias("op"), "batch_id", body.alias("row"))

    made = own.filter(aimed).select("*", F.posexplode("targets").alias("place", "target"))
    number = F.concat("family", F.lit("-TC"), padded(F.col("candidate_id"), 6))
    ref = F.when(F.size("targets") > 1, F.concat_ws("-", number, padded(F.col("place") + 1, 2))).otherwise(number)
    items = rows(made, "item", F.concat_ws("/", "evidence_file_key", ref), "insert", file_key="evidence_file_key", family="family", item_ref=ref, taxonomy_id="target", verbatim="verbatim", loc_start="loc_start", statement_polarity=polarity(F.col("verbatim")), txt_hash="txt_hash", review_status=F.lit("approved"))
    done = rows(own, "candidate", F.col("candidate_id"), "update", candidate_id="candidate_id", evidence_file_key="evidence_file_key", family="family", verbatim="verbatim", loc_start="loc_start", status=status, txt_hash="txt_hash")
    new = good.filter("action = 'promote'").withColumn("target", F.upper(F.element_at("targets", 1)))
    up = nodes.select(F.col("taxonomy_id").alias("parent_id"), F.col("family"))
    node = rows(new.join(up, "parent_id"), "node", F.col("target"), "insert", taxonomy_id="target", parent_id="parent_id", family="family", label="label", status=F.lit("active"), version=F.lit(version + 1))
    names = new.select("batch_id", "target", F.explode(F.array_distinct(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias"))
    alias = rows(names, "alias", F.concat_ws("/", "target", "alias"), "insert", taxonomy_id="target", alias="alias", normalized_alias=alias_key(F.col("alias")))
    log = rows(good, "log", F.col("batch_id"), "insert", batch_id="batch_id", action="action", target=F.when(aimed, F.element_at("targets", 1)), candidates=F.size(F.array_distinct("candidate_ids")), reason="reason")
    step = new.groupBy().agg(F.min("batch_id").alias("batch_id")).filter("batch_id is not null")  # one row
    meta = rows(step, "meta", F.lit("version"), "update", key=F.lit("version"), value=F.lit(version + 1))
    out = items
    for more in (done, node, alias, log, meta):
        out = out.unionByName(more)
    return out


def next_table(table: DataFrame, changes: DataFrame, name: str, key: Column) -> DataFrame:
    """``table`` after the changes to table ``name``; ``key`` gives a row's key."""
    mine = changes.filter(F.col("tbl") == name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    fresh = mine.select(F.from_json("row", fields).alias("r")).select("r.*")
    gone = mine.filter("op = 'update'").select(F.col("key").alias("_key"))
    return table.withColumn("_key", key.cast("string")).join(gone, "_key", "left_anti").drop("_key").unionByName(fresh)
