"""Queries of change sets: recurrence by differences, items carried over, resolutions applied."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import changes as C
from docloom.operators import extraction as X
from docloom.plans.registry import query

_KEY = "family || ':' || regexp_replace(regexp_replace(replace(lower(proposed_ko), 'ß', 'ss'), '[0-9]+', '#', 'g'), '[^\\p{L}\\p{N}#]+', '', 'g')"


def _keyed(rows):
    key = F.concat("family", F.lit(":"), T.signature(F.col("proposed_ko")))
    return rows.select("candidate_id", F.col("evidence_file_key").alias("file_key"), "loc_start", key.alias("recurrence_key"), "document_count")


def _replaced(c):
    """Candidates before; those of the replaced documents (a third) before and after."""
    rows = _keyed(c.candidates).join(c.files.select("file_key", "doc_id"), "file_key")
    old = rows.filter("doc_id % 3 = 0")
    new = old.filter("loc_start <> 2").withColumn("recurrence_key", F.when(F.col("loc_start") % 5 == 1, F.concat("recurrence_key", F.lit("x"))).otherwise(F.col("recurrence_key")))
    return rows, old, new


def _counts(rows):
    return rows.groupBy("recurrence_key").agg(F.count_distinct("file_key").alias("documents"))


_AFTER = f"""r AS (SELECT k.candidate_id, k.evidence_file_key AS file_key, k.loc_start, {_KEY} AS recurrence_key, f.doc_id FROM fx_candidate k JOIN fx_files f ON f.file_key = k.evidence_file_key),
 now AS (SELECT candidate_id, file_key, CASE WHEN doc_id % 3 = 0 AND loc_start % 5 = 1 THEN recurrence_key || 'x' ELSE recurrence_key END AS recurrence_key FROM r WHERE doc_id % 3 <> 0 OR loc_start <> 2),
 counts AS (SELECT recurrence_key, count(DISTINCT file_key)::BIGINT AS documents FROM now GROUP BY 1)"""


@query("recurrence_after_replace", f"WITH {_AFTER} SELECT * FROM counts")
def recurrence_after_replace(c):
    rows, old, new = _replaced(c)
    return C.counts_after(_counts(rows), C.recurrence_deltas(old, new))


@query("recurrence_refreshed", f"WITH {_AFTER}, was AS (SELECT recurrence_key, count(DISTINCT file_key)::BIGINT AS documents FROM r GROUP BY 1) SELECT n.candidate_id, recurrence_key, greatest(1, c.documents)::BIGINT AS document_count FROM now n JOIN counts c USING (recurrence_key) LEFT JOIN was w USING (recurrence_key) WHERE w.documents IS DISTINCT FROM c.documents")
def recurrence_refreshed(c):
    rows, old, new = _replaced(c)
    deltas = C.recurrence_deltas(old, new)
    now = rows.filter("doc_id % 3 <> 0").unionByName(new)
    return C.refreshed_counts(now, C.counts_after(_counts(rows), deltas), deltas).select("candidate_id", "recurrence_key", "document_count")


_CARRY = """base AS (SELECT file_key, taxonomy_id, verbatim, loc_start, loc_end, CASE WHEN doc_id % 2 = 0 THEN 'body' ELSE 'annex' END AS source_kind, CASE WHEN doc_id % 2 = 1 THEN 'src' END AS source_id, family, doc_id * 1000000 + loc_start * 100 + CAST(split_part(item_ref, '-', 3) AS BIGINT) AS item_id, item_ref, doc_id FROM fx_clause_item),
 res AS (SELECT * EXCLUDE doc_id FROM base WHERE doc_id % 4 = 0 AND loc_start % 2 = 1 UNION ALL SELECT * EXCLUDE (doc_id, item_id, item_ref), item_id + 50, item_ref || 'b' FROM base WHERE doc_id % 8 = 0 AND loc_start = 3),
 fresh AS (SELECT file_key, taxonomy_id, verbatim, loc_start, CASE WHEN loc_start % 3 = 0 THEN loc_end + 1 ELSE loc_end END AS loc_end, source_kind, source_id, family, item_id + 7000000000 AS item_id, CASE WHEN loc_start % 7 = 0 THEN family || '-TC' || lpad(item_id::VARCHAR, greatest(6, length(item_id::VARCHAR))::INTEGER, '0') WHEN loc_start % 6 = 3 THEN item_ref ELSE item_ref || '-n' END AS item_ref FROM base WHERE doc_id % 4 = 0)"""
_SAME = "file_key, taxonomy_id, verbatim, loc_start, loc_end, source_kind, coalesce(source_id, '')"
_MET = f"""{_CARRY}, o AS (SELECT *, row_number() OVER (PARTITION BY {_SAME} ORDER BY item_id) AS k FROM res), n AS (SELECT *, row_number() OVER (PARTITION BY {_SAME} ORDER BY item_id) AS k FROM fresh),
 met AS (SELECT o.*, n.item_ref AS new_ref FROM o LEFT JOIN n ON n.file_key = o.file_key AND n.taxonomy_id = o.taxonomy_id AND n.verbatim = o.verbatim AND n.loc_start = o.loc_start AND n.loc_end = o.loc_end AND n.source_kind = o.source_kind AND coalesce(n.source_id, '') = coalesce(o.source_id, '') AND n.k = o.k),
 named AS (SELECT m.*, CASE WHEN new_ref IS NOT NULL THEN new_ref WHEN NOT EXISTS (SELECT 1 FROM fresh f WHERE f.file_key = m.file_key AND f.item_ref = m.item_ref) THEN m.item_ref
   WHEN NOT EXISTS (SELECT 1 FROM fresh f WHERE f.file_key = m.file_key AND f.item_ref = m.family || '-TC' || lpad(m.item_id::VARCHAR, greatest(6, length(m.item_id::VARCHAR))::INTEGER, '0')) THEN m.family || '-TC' || lpad(m.item_id::VARCHAR, greatest(6, length(m.item_id::VARCHAR))::INTEGER, '0') ELSE m.family || '-TC' || lpad(m.item_id::VARCHAR, greatest(6, length(m.item_id::VARCHAR))::INTEGER, '0') || '-2' END AS ref FROM met m)"""


def _carry(c):
    d, p = F.col("doc_id"), F.col("loc_start")
    base = c.items.withColumn("item_id", d * 1000000 + p * 100 + F.split("item_ref", "-")[2].cast("long")).select(
        "file_key", "taxonomy_id", "verbatim", "loc_start", "loc_end", F.when(d % 2 == 0, "body").otherwise("annex").alias("source_kind"), F.when(d % 2 == 1, "src").alias("source_id"), "family", "item_id", "item_ref", "doc_id"
    )
    more = base.filter("doc_id % 8 = 0 and loc_start = 3").withColumns({"item_id": F.col("item_id") + 50, "item_ref": F.concat("item_ref", F.lit("b"))})
    resolved = base.filter("doc_id % 4 = 0 and loc_start % 2 = 1").unionByName(more).drop("doc_id")
    ref = F.when(p % 7 == 0, F.concat("family", F.lit("-TC"), C.padded(F.col("item_id"), 6))).when(p % 6 == 3, F.col("item_ref")).otherwise(F.concat("item_ref", F.lit("-n")))
    fresh = base.filter("doc_id % 4 = 0").withColumn("item_ref", ref).withColumns({"loc_end": F.when(p % 3 == 0, F.col("loc_end") + 1).otherwise(F.col("loc_end")), "item_id": F.col("item_id") + 7000000000}).drop("doc_id")
    return C.carried_over(resolved, fresh)


@query("carried_items", f"WITH {_MET} SELECT file_key, item_id, item_ref, taxonomy_id, loc_start, 'fresh' AS origin FROM fresh UNION ALL SELECT file_key, item_id, ref, taxonomy_id, loc_start, 'restored' FROM named WHERE new_ref IS NULL")
def carried_items(c):
    return _carry(c)[0].select("file_key", "item_id", "item_ref", "taxonomy_id", "loc_start", "origin")


@query("carried_mapping", f"WITH {_MET} SELECT file_key, item_id, ref AS new_ref FROM named")
def carried_mapping(c):
    return _carry(c)[1]


_NONE, _NOT = ["license"], ["la", "the"]
#: Faults that a set of requests may have, by document.
_FAULTS = {1: "action", 5: "target", 9: "reason", 13: "exists", 17: "unknown", 21: "twice", 25: "family", 29: "many", 33: "alias", 37: "id"}
_REQ = """cand AS (SELECT k.*, f.doc_id, f.content_hash AS txt_hash FROM fx_candidate k JOIN fx_files f ON f.file_key = k.evidence_file_key),
 asked AS (SELECT doc_id * 1000 + loc_start // 500 AS batch_id, doc_id, CASE doc_id % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'promote' ELSE 'reject' END AS action, min(family) AS family, list(candidate_id) AS ids FROM cand WHERE doc_id % 4 = 1 GROUP BY ALL),
 fam AS (SELECT family, list(taxonomy_id ORDER BY taxonomy_id) AS ids FROM fx_node GROUP BY family)"""


def _requests(c, faulty=False):
    """One batch for each document and 500 paragraphs; a tenth of the faulty ones break a rule."""
    rows = c.candidates.join(c.files.select(F.col("file_key").alias("evidence_file_key"), "doc_id", F.col("content_hash").alias("txt_hash")), "evidence_file_key")
    d = F.col("doc_id")
    action = F.when(d % 3 == 0, "merge").when(d % 3 == 1, "promote").otherwise("reject")
    own = rows.filter("doc_id % 4 = 1").groupBy((d * 1000 + F.expr("loc_start div 500")).alias("batch_id"), d, action.alias("action")).agg(F.min("family").alias("family"), F.collect_list("candidate_id").alias("candidate_ids"))
    nodes = c.nodes.groupBy("family").agg(F.array_sort(F.collect_list("taxonomy_id")).alias("of_family"))
    name = F.concat(F.lit("N"), F.col("batch_id").cast("string"))
    ask = own.join(F.broadcast(nodes), "family").select(
        "batch_id", "doc_id", "action", "candidate_ids", F.when(F.col("action") == "merge", F.col("of_family")).when(F.col("action") == "promote", F.array(F.concat_ws(".", "family", name))).otherwise(F.array().cast("array<string>")).alias("targets"),
        F.col("family").alias("parent_id"), F.concat(F.lit("new "), name).alias("label"), F.array(F.concat(F.lit("Alias  "), name), F.concat(F.lit("alias "), name)).alias("aliases"), F.when(F.col("action") == "reject", "noise").otherwise("").alias("reason"),
    )
    if faulty:
        m = d % 40
        ask = ask.withColumns({
            "action": F.when(m == 1, "split").otherwise(F.col("action")),
            "targets": F.when(m == 5, F.array(F.lit("XX.Y"))).when(m == 13, F.array(F.lit("RW.A"))).when(m == 25, F.array(F.lit("RW.B"), F.lit("CP.A"))).when(m == 29, F.transform(F.sequence(F.lit(1), F.lit(21)), lambda i: F.concat(F.lit("RW.T"), i.cast("string")))).when(m == 37, F.array(F.lit("bad id"))).otherwise(F.col("targets")),
            "reason": F.when(m == 9, " ").otherwise(F.col("reason")),
            "candidate_ids": F.when(m == 17, F.array_append("candidate_ids", F.lit(-1).cast("long"))).when(m == 21, F.array_append("candidate_ids", F.lit(1000001).cast("long"))).otherwise(F.col("candidate_ids")),
            "label": F.when(m == 33, "taken name").otherwise(F.col("label")),
        })
    candidates = rows.select("candidate_id", "evidence_file_key", "family", "verbatim", "loc_start", "status", "txt_hash")
    nodes = c.nodes.withColumns({"status": F.lit("active"), "version": F.lit(7)})
    aliases = c.small([("RW.A", "Taken  Name", "taken name")], "taxonomy_id string, alias string, normalized_alias string")
    return ask.drop("doc_id"), candidates, nodes, aliases


_TARGETS = "CASE WHEN doc_id % 40 = 5 THEN ['XX.Y'] WHEN doc_id % 40 = 13 THEN ['RW.A'] WHEN doc_id % 40 = 25 THEN ['RW.B', 'CP.A'] WHEN doc_id % 40 = 29 THEN list_transform(range(1, 22), lambda i: 'RW.T' || i) WHEN doc_id % 40 = 37 THEN ['bad id'] WHEN a.action = 'merge' THEN fam.ids WHEN a.action = 'promote' THEN [a.family || '.N' || batch_id] ELSE [] END"


@query("change_outcomes", f"""WITH {_REQ}, q AS (SELECT a.*, {_TARGETS} AS targets, doc_id % 40 AS m FROM asked a JOIN fam USING (family)),
 use AS (SELECT batch_id, unnest(CASE WHEN m = 21 THEN list_append(ids, 1000001) ELSE ids END) AS candidate_id FROM q), first AS (SELECT candidate_id, min(batch_id) AS b FROM use GROUP BY 1), tw AS (SELECT DISTINCT batch_id FROM use JOIN first USING (candidate_id) WHERE batch_id > b),
 fams AS (SELECT batch_id, count(DISTINCT family) AS n FROM use JOIN cand USING (candidate_id) GROUP BY 1), missing AS (SELECT batch_id FROM use ANTI JOIN cand USING (candidate_id)),
 aim AS (SELECT batch_id, count(*) FILTER (n.family IS NULL) AS lost, count(DISTINCT n.family) AS k, min(n.family) AS f FROM (SELECT batch_id, unnest(targets) AS t FROM q) x LEFT JOIN fx_node n ON n.taxonomy_id = t GROUP BY 1),
 firstid AS (SELECT targets[1] AS t, min(batch_id) AS b FROM q WHERE action = 'promote' AND m <> 1 GROUP BY 1), firstal AS (SELECT min(batch_id) AS b FROM q WHERE m = 33)
 SELECT batch_id, CASE WHEN m = 1 THEN 'unknown_action' WHEN m = 9 AND action = 'reject' THEN 'reason_required' WHEN m = 17 OR batch_id IN (SELECT * FROM missing) THEN 'candidate_not_found' WHEN batch_id IN (SELECT * FROM tw) THEN 'already_resolved' WHEN fams.n <> 1 THEN 'several_families'
  WHEN action = 'merge' AND (len(targets) < 1 OR len(targets) > 20) THEN 'target_count' WHEN action = 'merge' AND aim.lost > 0 THEN 'target_not_found' WHEN action = 'merge' AND (aim.k <> 1 OR aim.f <> q.family) THEN 'family_mismatch'
  WHEN action = 'promote' AND upper(targets[1]) = 'BAD ID' THEN 'invalid_id' WHEN action = 'promote' AND (targets[1] IN (SELECT taxonomy_id FROM fx_node) OR batch_id > firstid.b) THEN 'node_exists' WHEN action = 'promote' AND NOT starts_with(upper(targets[1]), q.family || '.') THEN 'family_mismatch'
  WHEN action = 'promote' AND m = 33 THEN 'alias_collision' ELSE 'applied' END AS outcome
 FROM q LEFT JOIN fams USING (batch_id) LEFT JOIN aim USING (batch_id) LEFT JOIN firstid ON firstid.t = targets[1]""")
def change_outcomes(c):
    ask, candidates, nodes, aliases = _requests(c, faulty=True)
    return C.check_batches(ask, candidates, nodes, aliases, c.files)


def _changes(c):
    ask, candidates, nodes, aliases = _requests(c)
    outcomes = C.check_batches(ask, candidates, nodes, aliases, c.files)
    return C.change_table(ask, outcomes, candidates, nodes, 7, lambda t: X.polarity(t, _NONE, _NOT)), candidates, nodes, aliases


_GOOD = f"{_REQ}, q AS (SELECT a.*, CASE WHEN action = 'merge' THEN fam.ids WHEN action = 'promote' THEN [a.family || '.N' || batch_id] ELSE [] END AS targets FROM asked a JOIN fam USING (family))"
_POL = "CASE WHEN regexp_matches(lower(verbatim), '(^|[^\\p{L}\\p{N}_])license($|[^\\p{L}\\p{N}_])') THEN 'none_exist' WHEN regexp_matches(lower(verbatim), '(^|[^\\p{L}\\p{N}_])(la|the)($|[^\\p{L}\\p{N}_])') THEN 'negative' ELSE 'affirmative' END"


@query("nodes_after_changes", f"WITH {_GOOD} SELECT *, 'active' AS status, 7 AS version FROM fx_node UNION ALL SELECT targets[1], family, family, 'new N' || batch_id, 'active', 8 FROM q WHERE action = 'promote'")
def nodes_after_changes(c):
    changes, _, nodes, _ = _changes(c)
    return C.next_table(nodes, changes, "node", F.col("taxonomy_id"))


@query("aliases_after_changes", f"WITH {_GOOD} SELECT 'RW.A' AS taxonomy_id, 'Taken  Name' AS alias, 'taken name' AS normalized_alias UNION ALL SELECT targets[1], unnest(['new N' || batch_id, 'Alias  N' || batch_id, 'alias N' || batch_id]), unnest(['new n' || batch_id, 'alias n' || batch_id, 'alias n' || batch_id]) FROM q WHERE action = 'promote'")
def aliases_after_changes(c):
    changes, _, _, aliases = _changes(c)
    return C.next_table(aliases, changes, "alias", F.concat_ws("/", "taxonomy_id", "alias"))


@query("items_after_changes", f"WITH {_GOOD}, m AS (SELECT candidate_id, q.action, targets, unnest(targets) AS target, generate_subscripts(targets, 1) AS place FROM (SELECT batch_id, action, targets, unnest(ids) AS candidate_id FROM q) q WHERE len(targets) > 0) SELECT file_key, family, item_ref, taxonomy_id, verbatim, loc_start, statement_polarity, txt_hash, review_status FROM fx_clause_item UNION ALL SELECT evidence_file_key, family, family || '-TC' || lpad(candidate_id::VARCHAR, greatest(6, length(candidate_id::VARCHAR))::INTEGER, '0') || CASE WHEN len(targets) > 1 THEN '-' || lpad(place::VARCHAR, 2, '0') ELSE '' END, target, verbatim, loc_start, {_POL}, txt_hash, 'approved' FROM m JOIN cand USING (candidate_id)")
def items_after_changes(c):
    changes, _, _, _ = _changes(c)
    items = c.items.select("file_key", "family", "item_ref", "taxonomy_id", "verbatim", "loc_start", "statement_polarity", "txt_hash", "review_status")
    return C.next_table(items, changes, "item", F.concat_ws("/", "file_key", "item_ref"))


@query("candidates_after_changes", f"WITH {_GOOD}, d AS (SELECT unnest(ids) AS candidate_id, action FROM q) SELECT candidate_id, evidence_file_key, family, verbatim, loc_start, CASE action WHEN 'merge' THEN 'merged' WHEN 'promote' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE status END AS status, txt_hash FROM cand LEFT JOIN d USING (candidate_id)")
def candidates_after_changes(c):
    changes, candidates, _, _ = _changes(c)
    return C.next_table(candidates, changes, "candidate", F.col("candidate_id"))


@query("change_log", f"WITH {_GOOD} SELECT batch_id, action, targets[1] AS target, len(ids)::INTEGER AS candidates, CASE WHEN action = 'reject' THEN 'noise' ELSE '' END AS reason FROM q")
def change_log(c):
    empty = c.small([], "batch_id long, action string, target string, candidates int, reason string")
    return C.next_table(empty, _changes(c)[0], "log", F.col("batch_id"))
