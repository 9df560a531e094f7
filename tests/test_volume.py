"""What is shuffled: no text travels beside its words, grams or places."""

import random
import re

from pyspark.sql import functions as F

from docloom.operators import extraction as X
from docloom.sources.fixtures import Corpus

SF = "/root/testdata/sf0.001"


def exchanged(df):
    """The columns that each exchange of the plan deals out."""
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [m.group(1) for m in re.finditer(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", text)]


def test_nearest_node_shuffles_no_words(spark):
    c = Corpus(spark, SF)
    rows = c.candidates.withColumn("t", F.concat("verbatim", F.lit(" node")))
    dealt = exchanged(X.nearest_node(rows, "t", ["candidate_id"], c.nodes))
    assert dealt and not any("_w#" in d or "verbatim#" in d or "content#" in d for d in dealt)


def test_nearest_node_of_repeated_rows(spark):
    nodes = spark.createDataFrame([("A", "F", "one two"), ("B", "F", "three"), ("C", "F", "four five six")], "taxonomy_id string, family string, label string")
    rows = spark.createDataFrame([(1, "F", "One two, three"), (1, "F", "One two, three"), (1, "F", "three"), (2, "F", None), (3, "G", "one"), (4, "F", "one two")], "id int, family string, t string")
    got = {tuple(r) for r in X.nearest_node(rows, "t", ["id"], nodes).collect()}
    assert got == {(1, "B", 1.0), (2, "C", 0.0), (4, "A", 1.0)}


def test_postings_are_written_without_a_shuffle(spark, tmp_path):
    from docloom.operators import postings as P

    rows = Corpus(spark, SF).paragraphs.localCheckpoint()
    chars = rows.agg(F.sum(F.length("content"))).first()[0]
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = written()
    P.add_to_index(rows, str(tmp_path), 0)
    files = list(tmp_path.rglob("postings/*/*/*.parquet"))
    assert files and written() - before < chars / 100  # sums only
    assert sum(f.stat().st_size for f in files if "bucket=-1" not in str(f)) < 12 * chars


def test_postings_do_not_run_across_paragraphs(spark, tmp_path):
    from docloom.operators import postings as P

    rows = [("f", 1, "xxab"), ("f", 2, "cdxx"), ("f", 3, "abcd" * 40), ("f", 4, "\U0001F600abcd"), ("g", 1, "İabcd")]
    P.add_to_index(spark.createDataFrame(rows, "file_key string, para int, content string").coalesce(1), str(tmp_path), 0)
    got = {tuple(r)[1:] for r in P._phrases(P._lists(spark, str(tmp_path), P._wanted(spark, ["abcd"])), P._wanted(spark, ["abcd"])).collect()}
    assert got == {("f", 3, 158, 40), ("f", 4, 3, 1), ("g", 1, 3, 1)}


def test_many_needles_are_not_met_by_trigrams(spark):
    from docloom.operators import search as S

    rng = random.Random(2)
    word = lambda: rng.choice(["there", "Straße", "ab", "the", "whst", "İx", "\U0001F600"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(200, None), (201, "")]
    needles = sorted({t[a : a + rng.choice([3, 5, 6, 11, 12, 23, 24, 40])] for _, t in rows if t for a in (0, 4, 9)} | {"not there at all, no"})
    table = spark.createDataFrame([(n,) for n in needles if len(n) >= 3], "needle string")
    texts = spark.createDataFrame(rows, "id int, content string")
    got = S.containing(texts, table, limit=10)
    lower = dict(texts.select("id", F.lower("content")).collect())
    low = dict(table.select("needle", F.lower("needle")).collect())
    assert sorted((r["id"], r["needle"]) for r in got.collect()) == sorted((i, n) for i, t in lower.items() for n in low if t and low[n] in t)
    assert not any("_g#" in d or "_p#" in d for d in exchanged(got))


def test_answers_in_longer_texts(spark):
    from docloom.operators import evaluation as E

    rng = random.Random(5)
    body = lambda n: "".join(rng.choice("abcdé ") for _ in range(n)).strip()
    gold, rows = [], []
    for d in range(12):
        texts = [body(rng.choice([9, 20, 60, 200])) for _ in range(6)]
        for k, t in enumerate(texts):
            a = rng.randint(0, 4)
            gold.append((f"g{d}-{k}", f"f{d}", t if k % 2 else t[a : a + rng.choice([7, 8, 15, 16, 17, 39, 40, 41, 90])], k * 9, k * 9, "A.B"))
            rows.append((f"r{d}-{k}", f"f{d}", t, k * 9 + 400, k * 9 + 400, "A.B"))
            rows.append((f"q{d}-{k}", f"f{d}", t[a : a + rng.choice([7, 8, 9, 15, 16, 39, 40, 90])], k * 9 + 800, k * 9 + 800, "A.B"))
    more = "file_key string, verbatim string, loc_start int, loc_end int, taxonomy_id string"
    fold = lambda t: " ".join(t.split(" ")) if "  " not in t else " ".join(x for x in t.split(" ") if x)
    want = set()
    for g, gf, gt, *_ in gold:
        for r, rf, rt, *_ in rows:
            a, b = fold(gt.strip()), fold(rt.strip())
            if gf == rf and a == b:
                want.add((g, r, "text"))
            elif gf == rf and min(len(a), len(b)) >= 8 and (a in b or b in a):
                want.add((g, r, "contained"))
    got = E.match_answers(spark.createDataFrame(gold, f"gt_id string, {more}"), spark.createDataFrame(rows, f"ref string, {more}"))
    assert {(x["gt_id"], x["ref"], x["rule"]) for x in got.collect()} == want
    assert not any("text#" in d or "gram#" in d for d in exchanged(got))


def test_words_end_at_letters_of_any_script(spark):
    import duckdb

    from docloom.operators import passes as P
    from docloom.plans import q_passes as Q

    texts = ["öund sounds not alone.", "hier und dort", "und", "ñundé", "_und", "(und)", "this", "thisé", "éis"]
    ours = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.col("t").rlike(Q._ABSENCE)).collect()]
    theirs = [duckdb.execute(f"SELECT regexp_matches(?, '{Q._ABSENCE}')", [t]).fetchone()[0] for t in texts]
    assert ours == theirs == [False, True, True, False, False, True, False, False, False]
    said = spark.createDataFrame([("some ümay words here",), ("some may words here",)], "t string").select("t", P.substantive(F.col("t"))).collect()
    assert dict(map(tuple, said)) == {"some ümay words here": False, "some may words here": True}


def test_proposed_candidates_deal_no_body_twice(spark):
    from docloom.plans import q_passes as Q

    dealt = exchanged(Q.proposed_candidates(Corpus(spark, SF)))
    assert dealt and not any("content#" in d for d in dealt)


def test_grounding_deals_only_grams_of_quotes(spark):
    from docloom.operators import extraction as X

    rng = random.Random(7)
    body = lambda n: "".join(rng.choice("abé \U0001F600") for _ in range(n))
    docs = [(f"f{i}", body(n)) for i, n in enumerate([0, 5, 11, 12, 13, 400, 3000])] + [("g", None), ("h", "abcdef"), ("i", "ghijkl")]
    quotes = [(k, docs[6][1][a : a + n]) for k, (a, n) in enumerate([(0, 12), (7, 60), (2900, 100)])] + [(8, "abcdefghijkl"), (9, "short")]  # 8 stands only across two documents
    quotes, docs_ = spark.createDataFrame(quotes, "item_id int, quote string"), spark.createDataFrame(docs, "file_key string, text string")
    out = X.shingle_coverage(quotes, docs_)
    want = set()
    for q in quotes.collect():
        grams = [q.quote[i : i + 12] for i in range(0, len(q.quote) - 11, 6)]
        want |= {(q.item_id, k, n / len(grams)) for k, t in docs if (n := sum(g in (t or "") for g in grams))}
    assert {tuple(r) for r in out.collect()} == want
    # before, all strings of all texts were dealt out
    text = out._jdf.queryExecution().toString()
    assert "MapInArrow" in text and "piece" not in text
    every = X.sought_grams(docs_, 12, quotes.selectExpr("substring(quote, 1, 12) AS gram"), limit=0)
    assert every.columns == ["file_key", "gram"] and every.count() > 3000
