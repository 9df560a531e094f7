"""Survivors of the pipeline's stages, as exact sets."""

import random

import corpus_pipeline


def test_one_survivor_of_each_group(spark):
    """Texts without an id, and an id on two unrelated texts, are groups of their own."""
    rng = random.Random(3)
    body = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(7)]
    rows = [(None, body[0]), (None, body[0]), (None, body[1]), (None, body[2]), (5, body[3]), (5, body[4]), (6, body[3]), (None, body[4]), (7, body[5]), (7, body[5]), (8, body[6])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], body.index(r["text"])) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, 0), (None, 1), (None, 2), (5, 3), (5, 4), (7, 5), (8, 6)], key=str)
