"""Rules whose values are fixed: version roles, priorities, representatives; and pairs against plain loops."""

import random

from pyspark.sql import functions as F

from docloom.operators import catalog, extraction, search, versions


def test_version_rules(spark):
    want = {
        "SPA_executed_signed.docx": ("execution", "high", "signed|_exec"),
        "SPA_signed draft.docx": ("execution", "med", "signed"),
        "final.docx": ("execution", "med", "final"),
        "final_redline.docx": ("execution", "low", "final"),
        "Bidding_SPA.docx": ("bidding", "high", "bidding"),
        "SPA_buyer.docx": ("buyer_ver", "med", "buyer"),
        "buyer vs seller.docx": ("buyer_ver", "low", "buyer|seller"),
        "seller buyer draft.docx": ("buyer_draft", "med", "buyer|seller|draft"),
        "seller_1st.docx": ("seller_markup", "med", "seller|1st"),
        "2nd draft.docx": ("markup_unknown", "low", "2nd"),
        "mark-up.docx": ("markup_unknown", "med", "mark-up"),
        "a_v1.docx": ("draft_unknown", "low", "_v1"),
        "매도인 초안.docx": ("seller_draft", "high", "매도인|초안"),
        "notes.docx": ("unknown", "low", ""),
    }
    rows = spark.createDataFrame([(k,) for k in want], "name string")
    got = {r["name"]: (r["role"], r["confidence"], r["basis"]) for r in rows.select("name", versions.classify(F.col("name")).alias("v")).select("name", "v.*").collect()}
    assert got == want
    assert spark.range(1).select(versions.classify(F.lit(None).cast("string")).alias("v")).select("v.role").first()[0] == "unknown"


def test_partial_versions_and_tiers(spark):
    rows = spark.createDataFrame([("a", "buyer_ver"), ("b", "draft_unknown"), ("c", "buyer_draft"), ("d", "bidding"), ("e", "unknown")], "file_key string, version_role string").withColumn("version_confidence", F.lit("high"))
    why = {r[0]: r[1] for r in rows.select("file_key", versions.exclusion_reason(["buyer_draft"])).collect()}
    assert why == {"a": "partial_version", "b": "partial_version", "c": None, "d": None, "e": "version_unknown"}
    why = {r[0]: r[1] for r in rows.select("file_key", versions.exclusion_reason(["buyer_ver"])).collect()}
    assert why["b"] == "partial_version" and why["c"] is None
    files = spark.createDataFrame([("1", "seller_markup"), ("2", "buyer_draft"), ("3", "unknown")], "file_key string, version_role string").withColumns({"ctype": F.lit("x"), "lang": F.lit("en"), "project": F.lit("p")})
    assert {r["file_key"]: r["tier"] for r in versions.tiers(files).collect()} == {"1": 2, "2": 1, "3": 2}


def test_representatives_look_at_hint_and_path(spark):
    rows = [("a", "g", None, "", "x/long_name_clean.docx", "z"), ("b", "g", None, "", "x/a.docx", "a"), ("c", "h", None, "signed", "x/q.docx", "q"), ("d", "h", 0, "", "x/b.docx", "b"), ("e", "i", 1, "final", "a", "a"), ("f", "i", None, None, "x/체결.docx", "w"), ("g", "i", None, None, "x/b.docx", "b")]
    files = spark.createDataFrame(rows, "file_key string, dup_group string, is_draft int, version_hint string, path string, filename string")
    assert {r["file_key"] for r in catalog.representatives(files).collect()} == {"a", "c", "f"}
    assert {r["file_key"] for r in catalog.representatives(files, final_words=catalog.STATISTICS_FINAL_WORDS).collect()} == {"a", "c", "g"}


def test_overlapping_items_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(f"f{rng.randrange(3)}", rng.choice("AB"), f"r{i:03}", "t", f"v{i % 5}", s, s + rng.randrange(-1, 5)) for i in range(120) for s in [rng.randrange(1, 15)]]
    items = spark.createDataFrame(rows, "file_key string, family string, item_ref string, taxonomy_id string, verbatim string, loc_start int, loc_end int")
    got = sorted((r["i"]["item_ref"], r["j"]["item_ref"]) for r in extraction.overlapping_items(items).collect())
    want = sorted((a[2], b[2]) for a in rows for b in rows if a[:2] == b[:2] and a[2] < b[2] and a[5] <= a[6] and b[5] <= b[6] and a[5] <= b[6] and b[5] <= a[6])
    assert got == want


def test_many_needles_find_what_few_find(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    rows = spark.createDataFrame([(i, text(rng.randrange(0, 60))) for i in range(40)] + [(99, None)], "i int, content string")
    needles = spark.createDataFrame([(x,) for x in {text(rng.randrange(0, 5)) for _ in range(60)}], "needle string")
    few, many = (sorted(map(tuple, search.containing(rows, needles, limit=n).select("i", "needle").collect())) for n in (1000, 3))
    assert few == many and few


def test_shingles_across_pieces(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    docs = spark.createDataFrame([("a", long), ("b", "short"), ("c", None)], "file_key string, text string")
    quotes = spark.createDataFrame([(1, long[240:300]), (2, long[480:520] + "zzzzzzzzzzzzzzzzzzzz"), (3, "tiny")], "item_id int, quote string")
    got = {(r["item_id"], r["file_key"]): r["coverage"] for r in extraction.shingle_coverage(quotes, docs).collect()}
    assert set(got) == {(1, "a"), (2, "a")} and got[1, "a"] == 1.0 and abs(got[2, "a"] - 5 / 9) < 1e-9
