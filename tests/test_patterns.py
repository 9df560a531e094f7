"""The pattern automaton against plain loops."""

import random
import re

from docloom.operators import patterns as P


def plain(texts, needles):
    out = set()
    for i, t in texts:
        low = (t or "").lower()
        for n, bounded in needles:
            n = n.lower()
            if n and (re.search(rf"\b{re.escape(n)}\b", low) if bounded else n in low):
                out.add((i, n, bounded))
    return out


TEXTS = [(1, "The Lacuna, la Plata; là-bas"), (2, "LA"), (3, "plaza_la la_"), (4, None), (5, ""), (6, "상법 제10조 la상"), (7, "a.b (c) \\E x\\Ey"), (8, "éla la2 2la")]


def found(spark, texts, needles, **options):
    rows = spark.createDataFrame(texts, "i int, content string").repartition(3)
    table = spark.createDataFrame(needles, "needle string, bounded boolean")
    got = [(r["i"], r["needle"], r["bounded"]) for r in P.pattern_hits(rows, table, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_bounds_and_scripts(spark):
    needles = [("la", True), ("la", False), ("La", False), ("상", False), ("상", True), ("", False), ("\\E x", False), ("b", True), ("(c)", True), ("é", False)]
    for options in ({}, {"block": 3}, {"sent": 2}):
        assert found(spark, TEXTS, needles, **options) == plain(TEXTS, needles)
    assert found(spark, [], needles) == set() and found(spark, TEXTS, []) == set()


def test_ten_and_ten_thousand_patterns(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 9)))
    texts = [(i, " ".join(word() for _ in range(30))) for i in range(60)]
    for n in (10, 10_000):
        needles = [(word(), rng.random() < 0.5) for _ in range(n)]
        assert found(spark, texts, needles, block=4096) == plain(texts, needles)


def test_no_nested_loop(spark):
    rows = spark.createDataFrame(TEXTS, "i int, content string")
    plan = P.pattern_hits(rows, spark.createDataFrame([("la", True)], "needle string, bounded boolean"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_vocabulary_by_script(spark):
    words = spark.createDataFrame([("S", "No asset encumbrance"), ("S", "상법상 Act"), ("S", "담보"), ("S", "the"), ("S", "")], "sub string, term string")
    got = {(r["needle"], r["bounded"]) for r in P.script_needles(words, ["asset"]).collect()}
    assert got == {("encumbrance", True), ("상법상 act", False), ("담보", False)}


def test_signatures_of_plain_texts_need_no_python(spark):
    from pyspark.sql import functions as F

    from docloom.functions import text as T

    every = [chr(c) for c in [*range(1, 0x250), *range(0xAC00, 0xD7A4, 97), 0x300, 0x11A8, 0xFF21, 0x130, 0x1E9E, 0x2160]]
    texts = [a + b for a in every for b in ("", "1S", "́", "ß", "각")] + ["", None, "é", "ＡＢ12", "ﬁn"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(map(tuple, T.with_signature(rows, "t", "s").select("i", "s").collect()))
    assert got == dict(map(tuple, rows.select("i", T.signature(F.col("t"))).collect()))
    plain = T.with_signature(rows.filter(F.col("t").rlike(T.PLAIN)), "t", "s")
    plain.collect()
    assert "ArrowEvalPython" not in plain._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
