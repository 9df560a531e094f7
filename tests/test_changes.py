"""Change sets on small cases."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import changes as C

ASK = "batch_id long, action string, candidate_ids array<long>, targets array<string>, parent_id string, label string, aliases array<string>, reason string"
CAND = "candidate_id long, evidence_file_key string, family string, verbatim string, loc_start int, status string, txt_hash string"


@pytest.fixture
def tables(spark):
    candidates = [(1, "f", "RW", "a", 1, "pending", "h"), (2, "f", "RW", "b", 2, "pending", None), (3, "g", "RW", "c", 3, "merged", "h"), (4, "g", "CP", "d", 4, "pending", "old"), (5, "g", "CP", "e", 5, "pending", "")]
    nodes = [("RW.A", "RW", "RW", "a", "active", 1), ("RW", None, "RW", "r", "active", 1), ("RW.OLD", "RW", "RW", "o", "retired", 1), ("CP", None, "CP", "c", "active", 1)]
    return (
        spark.createDataFrame(candidates, CAND),
        spark.createDataFrame(nodes, "taxonomy_id string, parent_id string, family string, label string, status string, version int"),
        spark.createDataFrame([("RW.A", "x y", "x y")], "taxonomy_id string, alias string, normalized_alias string"),
        spark.createDataFrame([("f", "h"), ("g", "h")], "file_key string, content_hash string"),
    )


def ask(action="merge", ids=(1,), targets=("RW.A",), parent="RW", label="new", aliases=(), reason="", batch=1):
    return (batch, action, list(ids) if ids is not None else None, list(targets) if targets is not None else None, parent, label, list(aliases), reason)


CASES = [
    (ask("split"), "unknown_action"), (ask(None), "unknown_action"), (ask(ids=()), "no_candidates"), (ask(ids=None), "no_candidates"), (ask(ids=range(10, 600)), "batch_too_large"), (ask("reject"), "reason_required"),
    (ask(ids=(1, 99)), "candidate_not_found"), (ask(ids=(1, 3)), "already_resolved"), (ask(ids=(1, 5)), "several_families"), (ask(targets=(" ", "")), "target_count"), (ask(targets=None), "target_count"),
    (ask(targets=[f"RW.{i}" for i in range(21)]), "target_count"), (ask(targets=("RW.A", "RW.OLD")), "target_not_found"), (ask(targets=("RW.A", "CP")), "family_mismatch"), (ask(targets=("CP",)), "family_mismatch"),
    (ask("promote", targets=("bad id",)), "invalid_id"), (ask("promote", targets=("RW.N",), label=""), "label_required"), (ask("promote", targets=("RW.OLD",)), "node_exists"), (ask("promote", targets=("RW.N",), parent="RW.OLD"), "parent_not_found"),
    (ask("promote", targets=("CP.N",)), "family_mismatch"), (ask("promote", targets=("RW.N",), label="X  Y"), "alias_collision"), (ask(ids=(4,), targets=("CP",)), "stale_candidate"), (ask(ids=(5, 5), targets=("CP", "CP ")), "applied"),
    (ask("promote", targets=("rw.n",), aliases=("N", "n")), "applied"), (ask("reject", reason="noise", ids=(4,)), "applied"),
]


def test_outcomes(spark, tables):
    """Each case has candidates, new ids and names of its own, so that no case meets another."""
    candidates, nodes, aliases, files = tables
    every = candidates.crossJoin(spark.range(len(CASES)).toDF("k")).withColumn("candidate_id", F.col("candidate_id") + F.col("k") * 1000).drop("k")
    rows = []
    for k, ((_, action, ids, targets, parent, label, names, reason), _) in enumerate(CASES):
        own = [f"{t}{k}" if t.upper() in ("RW.N", "CP.N") else t for t in targets] if targets else targets
        rows.append((k, action, [i + k * 1000 for i in ids] if ids else ids, own, parent, f"{label} {k}" if label == "new" else label, [f"{n}{k}" for n in names], reason))
    got = {r["batch_id"]: r["outcome"] for r in C.check_batches(spark.createDataFrame(rows, ASK), every, nodes, aliases, files).collect()}
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


def test_batches_of_one_set(spark, tables):
    candidates, nodes, aliases, files = tables
    rows = [ask(batch=1, ids=(1,)), ask(batch=2, ids=(1, 2)), ask("promote", batch=3, ids=(2,), targets=("RW.N",)), ask("promote", batch=4, ids=(5,), targets=("RW.N",))]
    got = {r["batch_id"]: r["outcome"] for r in C.check_batches(spark.createDataFrame(rows, ASK), candidates, nodes, aliases, files).collect()}
    assert got == {1: "applied", 2: "already_resolved", 3: "already_resolved", 4: "node_exists"}


def test_set_is_applied_whole_or_not_at_all(spark, tables):
    candidates, nodes, aliases, files = tables
    good = [ask(batch=1, ids=(1, 2), targets=("RW.A", "RW")), ask("promote", batch=2, ids=(5,), targets=("CP.N",), parent="CP", aliases=("other",))]
    made = {}
    for name, rows in (("good", good), ("bad", [*good, ask(batch=3, ids=(3,))]), ("none", [])):
        requests = spark.createDataFrame(rows, ASK)
        table = C.change_table(requests, C.check_batches(requests, candidates, nodes, aliases, files), candidates, nodes, 1, lambda t: F.lit("affirmative"))
        made[name] = table.groupBy("tbl").count().collect()
        if name == "good":
            nexts = C.next_table(nodes, table, "node", F.col("taxonomy_id"))
            done = C.next_table(candidates, table, "candidate", F.col("candidate_id"))
            refs = sorted(r["key"] for r in table.filter("tbl = 'item'").collect())
            assert refs == ["f/RW-TC000001-01", "f/RW-TC000001-02", "f/RW-TC000002-01", "f/RW-TC000002-02", "g/CP-TC000005"]
            assert [tuple(r) for r in nexts.filter("version = 2").collect()] == [("CP.N", "CP", "CP", "new", "active", 2)]
            assert {r["candidate_id"]: r["status"] for r in done.collect()} == {1: "merged", 2: "merged", 3: "merged", 4: "pending", 5: "approved"}
    assert {r[0]: r[1] for r in made["good"]} == {"item": 5, "candidate": 3, "node": 1, "alias": 2, "log": 2, "meta": 1}
    assert made["bad"] == [] and made["none"] == []


ITEM = "file_key string, taxonomy_id string, verbatim string, loc_start int, loc_end int, source_kind string, source_id string, family string, item_id long, item_ref string"


def item(i, ref, text="t", at=1, source=None, key="f"):
    return (key, "RW.A", text, at, at, "body", source, "RW", i, ref)


def test_carried_over_one_to_one(spark):
    resolved = spark.createDataFrame([item(1, "RW-TC000001"), item(2, "b"), item(3, "c"), item(4, "d", "gone"), item(5, "n2", "gone too"), item(6, "x", source="s")], ITEM)
    fresh = spark.createDataFrame([item(11, "n1"), item(12, "n2"), item(13, "RW-TC000005", "else"), item(14, "RW-TC000005-2", "else")], ITEM)
    items, mapping = C.carried_over(resolved, fresh)
    assert {r["item_id"]: r["new_ref"] for r in mapping.collect()} == {1: "n1", 2: "n2", 3: "c", 4: "d", 5: "RW-TC000005-3", 6: "x"}
    got = items.collect()
    assert len(got) == 8 and sum(r["origin"] == "restored" for r in got) == 4
    assert len({(r["file_key"], r["item_ref"]) for r in got}) == 8
    assert C.carried_over(resolved, fresh.limit(0))[0].count() == 6 and C.carried_over(resolved.limit(0), fresh)[1].count() == 0


def test_counts_follow_differences(spark):
    pair = "recurrence_key string, file_key string"
    old = spark.createDataFrame([("a", "f"), ("a", "f"), ("b", "f"), ("c", "g"), (None, "g")], pair)
    new = spark.createDataFrame([("a", "f"), ("d", "f"), ("d", "g")], pair)
    deltas = C.recurrence_deltas(old, new)
    assert {tuple(r) for r in deltas.collect()} == {("b", -1), ("c", -1), ("d", 2)}
    counts = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "recurrence_key string, documents long")
    assert {tuple(r) for r in C.counts_after(counts, deltas).collect()} == {("a", 3), ("c", 1), ("d", 2)}
    plan = C.counts_after(counts, deltas)._jdf.queryExecution().toString()
    assert "candidate" not in plan
