"""Columns with the names that operators use inside; weights that sum to nothing."""

from pyspark.sql import functions as F

from docloom.llm import decontaminate, lines, mixing, quality, sharding


def test_names_of_the_inside(spark):
    body = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{body}\n{body.upper()}", "a"), (2, "other", "b")], "doc_id long, text string, source string")
    names = ["_docloom_doc", "_docloom_gone", "doc", "gone", "_doc", "_body", "_spans", "_items", "_words", "_s", "_i", "_n", "_text_", "_source", "_u", "_id", "_hot", "in_0", "in_1", "Kept_", "key", "norm"]
    own = docs.withColumns({n: F.lit(f"own {n}") for n in names})
    items = spark.createDataFrame([(7, body)], "item_id long, text string")
    results = {
        "lines": lines.dedup_lines(own),
        "decontaminate": decontaminate.decontaminate(own, items),
        "quality": quality.quality_rules(own, keep=own.columns),
        "mixing": mixing.mix_sources(own, {"a": 1.0}),
    }
    for name, out in results.items():
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert [r[n] for n in names] == [f"own {n}" for n in names], name
    assert {r["doc_id"]: r["contaminated"] for r in results["decontaminate"].collect()} == {1: True, 2: False}
    assert {r["doc_id"]: r["n_removed"] for r in results["lines"].collect()} == {1: 1, 2: 0}


def test_weights_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    assert mixing.mix_sources(docs, {"a": 0.0}).count() == 0 and mixing.mix_sources(docs, {}).count() == 0


def test_more_blocks_for_more_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCKS", 2)
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 10)
    docs = spark.createDataFrame([(i, f"text {i % 90} " * (i % 7)) for i in range(300)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, shards=3).collect()
    load = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(3)]
    assert len(rows) == 300 and max(load) < 1.1 * min(load)


def test_lines_counted_by_occurrence(spark):
    """Lines that are too frequent for the 32-bit counters give the same result."""
    docs = spark.createDataFrame([(i, f"a common line of words\nanother one {i % 4} here with more words\nx y x") for i in range(12)], "doc_id long, text string")
    few = sorted(map(tuple, lines.dedup_lines(docs).collect()))
    assert few == sorted(map(tuple, lines.dedup_lines(docs, lane=20).collect())) and few
