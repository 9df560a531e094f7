"""Ranked clause search, reviewers' reports and deal facts on small fixtures."""

from pyspark.sql import functions as F

from docloom.operators import clauses as C
from docloom.operators import deal_facts as D
from docloom.operators import review as R
from docloom.operators import structure as S


def texts(spark, docs):
    return spark.createDataFrame([(k, i, t) for k, ts in docs.items() for i, t in enumerate(ts, 1)], "file_key string, para int, content string")


def by_key(df, *columns):
    return {r["file_key"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


LAW = {"Delaware": ["delaware"], "Korea": ["republic of korea", "korean law"]}


def test_governing_law(spark):
    p = texts(
        spark,
        {
            "named": ["Governing Law", "This is governed by Korean law. Seat of a subsidiary is Delaware."],
            "two": ["governing law: governed by Delaware and Korean law."],
            "none": ["Nothing here"],
            "contents": ["Governing Law 12"],
            "heading": ["Governing Law", "to come"],
            "blank": ["Governing Law", "governed by the laws of [●]."],
            "unnamed": ["Governing Law", "governed by the laws of Utopia. Delaware is elsewhere."],
            "listed": ["Disclosure list", "governing law is governed by Delaware."],
            "later": ["Governing Law 3", "x", "x", "x", "x", "Governing law: governed by Delaware."],
        },
    )
    out = by_key(D.governing_law(p, ["governing law"], ["governed by"], LAW, skip=["disclosure list"]), "value", "confidence", "rule", "candidates", "conflicts")
    assert out == {
        "named": ("Korea", "med", "governing_law_clause", "", "Delaware"),
        "two": (None, None, "multiple_jurisdictions_in_operative_sentence", "Delaware|Korea", ""),
        "none": (None, None, "no_governing_law_clause_found", "", ""),
        "contents": (None, None, "clause_not_localized", "", ""),
        "heading": (None, None, "clause_not_localized", "", ""),
        "blank": (None, None, "placeholder_in_clause", "", ""),
        "unnamed": (None, None, "jurisdiction_not_named", "", "Delaware"),
        "listed": (None, None, "no_governing_law_clause_found", "", ""),
        "later": ("Delaware", "med", "governing_law_clause", "", ""),
    }


def test_forum(spark):
    p = texts(
        spark,
        {
            "court": ["exclusive jurisdiction of the Seoul District Court applies"],
            "mention": ["costs of any arbitration are shared"],
            "agreement": ["finally settled by arbitration under ICC rules; seat of arbitration Paris"],
            "both": ["exclusive jurisdiction: Seoul District Court", "settled by arbitration under ICC or KCAB rules"],
            "loose": ["exclusive jurisdiction: courts of Utopia"],
        },
    )
    f = D.forum(p, ["jurisdiction"], ["exclusive jurisdiction"], r"\b([A-Z][a-z]+ District Court)\b", ["arbitration"], ["settled by arbitration"], {"ICC": ["icc"], "KCAB": ["kcab"]}, r"seat of arbitration ([A-Z][a-z]+)", r"courts of ([A-Z][a-z]+)")
    out = by_key(f, "forum_type", "type_rule", "forum_court", "arbitration", "institution", "institution_rule", "seat")
    assert out == {
        "court": ("court", "court_forum_only", "Seoul District Court", False, None, "no_arbitration_clause", None),
        "mention": (None, "forum_not_determined", None, False, None, "no_arbitration_agreement", None),
        "agreement": ("arbitration", "arbitration_only", None, True, "ICC", "arbitration_institution_named", "Paris"),
        "both": (None, "court_and_arbitration_both_present", "Seoul District Court", True, None, "multiple_institutions_named", None),
        "loose": ("court", "court_forum_only", "Utopia", False, None, "no_arbitration_clause", None),
    }


def test_industry_reports_traps_only(spark):
    p = texts(spark, {"a": ["product liability and software licence", "[header] patents"], "b": ["nothing"]})
    assert by_key(D.industry(p, ["software licence", "patents", "product liability"]), "value", "traps") == {"a": (None, "software licence|product liability"), "b": (None, "")}


def test_deal_year_from_a_footer(spark):
    p = texts(spark, {"a": ["x", "x", "x", "[footer] 2011 and 2013", "[header] 2012"], "b": ["x", "[footer] 2011"], "c": ["x"]})
    files = spark.createDataFrame([("a", "spa_210904.docx"), ("b", "spa_20200102.docx"), ("c", "spa_210904.docx")], "file_key string, filename string")
    assert by_key(S.deal_year(files, p), "value", "basis") == {"a": ("2013", "margin"), "b": ("2020", "long"), "c": ("2021", "short")}


def test_clause_found_outside_the_contents_first(spark):
    p = texts(spark, {"a": ["anchor with 12", "x", "x", "x", "anchor alone"]})
    assert by_key(S.find_clause(p, F.contains("content", F.lit("anchor")), "with"), "para", "level") == {"a": (5, 2)}


def items(spark, rows):
    schema = "file_key string, item_ref string, taxonomy_id string, family string, verbatim string, loc_start int, statement_polarity string, subject_role string, effective_time string, txt_hash string, review_status string"
    return spark.createDataFrame([(k, ref, "RW.A", "RW", v, i, "affirmative", s, t, "h", st) for i, (k, ref, v, s, t, st) in enumerate(rows)], schema)


def test_clause_search_order_filters_and_hints(spark):
    rows = [
        ("f1", "far", "the seller pays damages and then more tax", "Seller", "Closing", "approved"),
        ("f1", "phrase", "a long text in which pays tax is found after all", "seller", "closing", "approved"),
        ("f2", "copy", "pays tax", "Seller", "Closing", "approved"),
        ("f3", "often", "tax pays tax and pays no more tax but it pays", "SELLER", "Closing", "approved"),
        ("f3", "buyer", "pays tax", "Buyer", "Closing", "approved"),
        ("f3", "open", "pays tax", "Seller", "Closing", "pending"),
        ("f3", "late", "pays tax", "Seller", None, "approved"),
        ("f3", "else", "pays nothing", "Seller", "Closing", "approved"),
    ]
    it = items(spark, rows)
    nodes = spark.createDataFrame([("RW", None, "root"), ("RW.A", "RW", "a")], "taxonomy_id string, parent_id string, label string")
    files = spark.createDataFrame([(k, "h", "SPA", g, "ok") for k, g in (("f1", "g1"), ("f2", "g1"), ("f3", "g3"))], "file_key string, content_hash string, ctype string, dup_group string, status string")
    cov = spark.createDataFrame([("f1", "RW", "complete")], "file_key string, family string, state string")

    def found(**kw):
        return C.clause_search(it, nodes, files, cov, "RW", subject="seller ", effective_time="closing", **kw)

    def refs(df):
        return [r["item_ref"] for r in C.search_page(df, 10).collect()]

    assert refs(found(text="pays tax", dedup=False)) == ["copy", "often", "phrase", "far"]
    # f2 has the first item of g1, so f1's items go
    assert refs(found(text="pays tax")) == ["copy", "often"]
    s = C.search_summary(found(text="pays tax", dedup=False), 3, text=True).collect()[0]
    assert (s["total_items"], s["total_documents"], s["returned_items"], s["has_more"], s["next_offset"], s["zero_result"]) == (4, 3, 3, True, 3, False)
    s = C.search_summary(found(text="pays tax", dedup=False), 3, 3, text=True).collect()[0]
    assert (s["returned_items"], s["has_more"], s["next_offset"]) == (1, False, None)
    assert C.search_summary(found(text="qq zz"), 3, text=True).collect()[0]["zero_result"]


def test_absence_pool(spark):
    files = spark.createDataFrame([(k, g, "ok", n) for k, g, n in (("a", "g", 5), ("b", "g", 5), ("c", None, 5), ("d", None, 0), ("e", None, 5), ("f", None, 5))], "file_key string, dup_group string, status string, char_count int")
    cov = spark.createDataFrame([(k, "RW", "partial" if k == "f" else "complete") for k in "abcdef"], "file_key string, family string, body_status string")
    it = spark.createDataFrame([("e", "RW.B.X"), ("a", "RW.BB")], "file_key string, taxonomy_id string")
    p = texts(spark, {"a": ["Tax is due"], "b": ["none"], "e": ["tax"], "f": ["tax"]})
    pool = R.absence_pool(files, cov, it, p, "RW.B", spark.createDataFrame([("tax",), ("due",)], "word string"))
    assert by_key(pool, "cls", "matched_terms", "representative") == {"a": ("suspect", "due|tax", True), "b": ("clean_absent", "", False), "c": ("no_txt", "", True)}
    assert tuple(R.pool_report(pool).collect()[0]) == (3, 2, 0, 1, 1, 0.5)
    assert R.pool_report(pool.limit(0)).collect()[0]["suspect_rate"] is None


def test_leaf_gaps(spark):
    p = texts(spark, {f"d{i}": ["x", "no  key   dispute", "no dispute"] for i in range(7)})
    leaves = spark.createDataFrame([("L1", "(?i)no.{0,9}dispute"), ("L2", "never")], "taxonomy_id string, pattern string")
    rows = [tuple(r) for r in R.leaf_gaps(p, leaves).orderBy("taxonomy_id", "nth").select("taxonomy_id", "documents", "nth", "file_key", "para", "evidence").collect()]
    assert rows == [("L1", 7, i + 1, f"d{i}", 2, "no key dispute") for i in range(5)] + [("L2", 0, None, None, None, None)]
    assert by_key(R.leaf_ranking(p, leaves), "hit_count") == {f"d{i}": 1 for i in range(7)}


def test_candidate_review(spark):
    cand = spark.createDataFrame(
        [(1, "RW", "body", "tax"), (2, "CP", "body", "tax"), (3, "CP", "annex", "tax"), (4, "RW", "body", "tax and ghost"), (5, "RW", "body", "tax and cond"), (6, "RW", "body", "title"), (7, "RW", "body", "a long text without a label"), (8, "RW", None, None)],
        "candidate_id int, family string, source_kind string, verbatim string",
    ).withColumn("status", F.lit("pending"))
    rules = spark.createDataFrame([(1, "tax", None, "RW.T"), (2, "ghost", None, "XX"), (3, "cond", None, "CP.C")], "ord int, pattern string, not_pattern string, label string")
    nodes = spark.createDataFrame([("RW.T", "RW"), ("CP.C", "CP")], "taxonomy_id string, family string")
    done = R.candidate_review(cand, rules, nodes, F.length("verbatim") < 10)
    assert {r["candidate_id"]: (r["verdict"], r["target_family"], r["unknown"]) for r in done.collect()} == {
        1: ("merge", "RW", ""),
        2: ("merge", "RW", ""),
        3: ("unresolved", None, ""),
        4: ("unresolved", None, "XX"),
        5: ("unresolved", None, ""),
        6: ("reject", None, ""),
        7: ("unresolved", None, ""),
        8: ("unresolved", None, ""),
    }
    assert {tuple(r) for r in R.review_targets(done).collect()} == {("target", "RW.T", 2), ("unknown", "XX", 1)}
    groups = {(r["verdict"], r["family"]): (r["candidates"], r["items"], r["reassigned"]) for r in R.review_groups(done).collect()}
    assert groups[("merge", "CP")] == (1, 1, True) and groups[("merge", "RW")] == (1, 1, False)
