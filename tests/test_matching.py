"""Matching by keys and quotas by depths against the plain rules."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from docloom.operators import evaluation as E
from docloom.operators import sampling as S


def test_matches_equal_the_product(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["aa", "abc", "The", "the", "deed ", "x"]) for _ in range(rng.randint(0, 7)))
    row = lambda i: (f"i{i}", f"f{rng.randrange(3)}", rng.choice([text(), text(), None]), lo := rng.randrange(8), lo + rng.randrange(-1, 4), rng.choice(["A.B", "A.B.C", "A.D"]))
    gold, rows = [row(i) for i in range(70)], [row(i) for i in range(90)]
    gold.append(gold[0])
    fold = lambda t: " ".join(t.lower().split()) if t is not None else None
    want = {}
    for g in gold:
        for r in rows:
            if g[1] != r[1]:
                continue
            a, b = fold(g[2]), fold(r[2])
            rule = None
            if a is not None and b is not None:
                rule = "text" if a == b else "contained" if min(len(a), len(b)) >= 8 and (a in b or b in a) else None
            if rule is None and g[3] <= r[4] and r[3] <= g[4] and g[3] <= g[4] and r[3] <= r[4] and g[5][:3] == r[5][:3]:
                rule = "range"
            if rule:
                want[g[0], g[1], r[0]] = rule
    tail = "file_key string, verbatim string, loc_start int, loc_end int, taxonomy_id string"
    out = E.match_answers(spark.createDataFrame(gold, f"gt_id string, {tail}"), spark.createDataFrame(rows, f"ref string, {tail}"))
    got = [((r["gt_id"], r["file_key"], r["ref"]), r["rule"]) for r in out.collect()]
    assert dict(got) == want and len(got) == len(want)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rounds_stop_at_the_quota(spark):
    rng = random.Random(8)
    rows = [(f"k{i:03d}", rng.choice("ab"), f"p{rng.randrange(6)}") for i in range(120)] + [("z", "c", "p0")]
    quotas = {"a": 7, "b": 200, "c": 0}
    depth, want = defaultdict(int), defaultdict(list)
    import hashlib

    for k, s, p in sorted(rows):
        depth[s, p] += 1
        want[s].append((depth[s, p], hashlib.sha1(p.encode()).hexdigest(), k))
    want = {(s, k): n for s, xs in want.items() for n, (_, _, k) in enumerate(sorted(xs), 1) if n <= quotas[s]}
    df = spark.createDataFrame(rows, "file_key string, s string, p string")
    got = S.round_robin(df, F.col("s"), F.col("p"), spark.createDataFrame(list(quotas.items()), "stratum string, quota int"), [F.col("file_key")])
    assert {(r["s"], r["file_key"]): r["place"] for r in got.collect()} == want


def test_filters_and_notices(spark):
    from docloom.operators import search

    files = spark.createDataFrame([("a", "ok", "execution"), ("b", "ok", None), ("c", "ok", "execution"), ("d", "error", "execution"), ("e", "ok", "bidding")], "file_key string, status string, version_role string")
    answers = spark.createDataFrame([("a", "match"), ("b", "match"), ("c", "needs_review"), ("d", "match")], "file_key string, answer string")
    left, notices = search.fitting(files, {"x": answers}, ["execution"])
    assert [r[0] for r in left.collect()] == ["a"]
    assert {tuple(r) for r in notices.collect()} == {("version", "match", 2), ("version", "needs_review", 1), ("version", "no_match", 1), ("x", "match", 2), ("x", "needs_review", 1)}
    left, notices = search.fitting(files, {})
    assert left.count() == 4 and notices.count() == 0


def test_nearest_node_equals_all_pairs(spark):
    from docloom.operators.extraction import nearest_node

    rng = random.Random(9)
    phrase = lambda n: " ".join(rng.choice(["seller", "Buyer", "tax", "law", "the", "of", "é"]) for _ in range(rng.randint(0, n)))
    nodes = [(f"{f}.{i:02d}", f, phrase(4)) for f in ("A", "B") for i in range(25)] + [("C.1", "C", None)]
    rows = [(i, rng.choice("ABCD"), rng.choice([phrase(6), None])) for i in range(150)]
    cut = lambda t: {w for w in (t or "").lower().split() if w}
    want = {}
    for i, family, text in rows:
        scores = [(len(cut(text) & cut(label)) / max(len(cut(text) | cut(label)), 1), node) for node, f, label in nodes if f == family]
        if scores:
            best = max(scores)
            want[i] = (best[1], round(best[0], 4))
    out = nearest_node(spark.createDataFrame(rows, "i int, family string, t string"), "t", ["i"], spark.createDataFrame(nodes, "taxonomy_id string, family string, label string"))
    assert {r["i"]: (r["taxonomy_id"], r["score"]) for r in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_paraphrase_tokens_of_odd_words(spark):
    """Tokens equal the rule's plain form, and a paragraph's are worked out once, not per item."""
    import re

    from docloom.operators import evaluation as E
    from docloom.plans import q_evaluation as Q
    from docloom.sources.fixtures import Corpus
    from tests.oracle import SF

    texts = ["its pass passes ss sss ssss as is", "été ßss Öls 12abc34s x_abcs", "", None, "a bc", "ab1cd e\U0001F600fgh's", "bus-bus busses BUS"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(E.paraphrase_tokens(F.col("t"))).collect()]

    def plain(t):
        words = {w[:-1] if w.endswith("s") else w for w in re.findall(r"[^\W\d_]{3,}", t.lower())}
        return sorted(words, key=lambda w: (-len(w), w))[:4]

    assert got == [None if t is None else plain(t) for t in texts]
    plan = Q.paraphrase_probe(Corpus(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Join" not in plan
