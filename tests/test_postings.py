"""Postings against plain phrase counting; which parts are read; batches."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import postings as P
from docloom.sources.scratch import new_path

SCHEMA = "file_key string, para int, content string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: rng.choice(["aaa", "aaaa", "ab", "abab", "Straße", "x", "the", "there", "ather"])
    out = [(f"f{i % 37:02d}", i, " ".join(word() for _ in range(rng.randint(0, 25)))) for i in range(300)]
    return [*out, ("f00", 900, None), ("f00", 901, ""), ("f99", 902, "ab")]


def plain(rows, term):
    out = {}
    for key, para, text in rows:
        low = (text or "").lower()
        n = sum(low.startswith(term, i) for i in range(len(low)))
        if n:
            out[key, para] = (n, max(len(low) - 2, 0))
    return out


def build(spark, rows, batches=1):
    path = new_path(spark, "test-postings")
    for b in range(batches):
        P.add_to_index(spark.createDataFrame([r for i, r in enumerate(rows) if i % batches == b], SCHEMA), path, b)
    return path


def phrases(spark, path, terms):
    wanted = P._wanted(spark, terms)
    return {(r["term"], r["file_key"], r["para"]): (r["tf"], r["len"]) for r in P._phrases(P._lists(spark, path, wanted), wanted).collect()}


@pytest.mark.parametrize("batches", [1, 3])
def test_counts(spark, rows, batches):
    terms = ["aaa", "aaaa", "abab", "the", "straße x", "none at all", "There"]
    got = phrases(spark, build(spark, rows, batches), terms)
    want = {(t.lower(), *k): v for t in terms for k, v in plain(rows, t.lower()).items()}
    assert got == want


def test_batch_again_replaces_itself(spark, rows):
    path = build(spark, rows, 2)
    P.add_to_index(spark.createDataFrame([r for i, r in enumerate(rows) if i % 2 == 1], SCHEMA), path, 1)
    assert P.corpus_stats(spark, path)[0] == len(rows)
    assert phrases(spark, path, ["there"]) == {("there", *k): v for k, v in plain(rows, "there").items()}


def test_reads_only_the_query_s_partitions(spark, rows):
    path = build(spark, rows)
    lists = P._lists(spark, path, P._wanted(spark, ["abab"]))
    read = {r[0].split("bucket=")[1].split("/")[0] for r in lists.select(F.input_file_name()).distinct().collect()}
    assert "PartitionFilters: [bucket" in lists._jdf.queryExecution().explainString(lists._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    wanted = {str(r[0]) for r in spark.createDataFrame([("aba",), ("bab",)], "g string").select(P.bucket_of(F.col("g"))).collect()}
    assert read == wanted and len(spark.read.parquet(f"{path}/postings").inputFiles()) > len(read)


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_top_opens_what_it_needs(spark, rows, k, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 10)
    path = build(spark, rows, 2)
    every = [tuple(r) for r in P.indexed_scores(spark, path, ["there"]).orderBy("score", "file_key", "para").limit(k).collect()]
    got, opened, blocks = P.top_paragraphs(spark, path, "there", k, len(plain(rows, "there")), first_blocks=3)
    assert [tuple(r) for r in got.collect()] == every
    assert opened <= blocks and (k > 1 or opened < blocks)


def test_empty(spark):
    path = build(spark, [])
    assert phrases(spark, path, ["abc"]) == {} and P.corpus_stats(spark, path) == (0, 0.0)
