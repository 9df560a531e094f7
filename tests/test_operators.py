"""Edge cases of operators on small tables made here."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.ranking import rank_within
from docloom.operators import audits, catalog, clauses, evaluation, extraction, lifecycle, metadata, sampling, search, stats, structure, versions
from docloom.sources import readers, writers


def test_normalise(spark):
    rows = spark.createDataFrame([("ｆｕｌｌ　ｗｉｄｔｈ",), ("é a​b",), ("‘x’ – y\t\n z",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.normalise(F.col("t"))).collect()] == ["full width", "é ab", "'x' - y z", "", None]


def test_paragraphs_are_numbered_after_empty_ones_are_dropped(spark):
    rows = spark.createDataFrame([("a\n \n\nb",)], "t string")
    assert rows.select(T.paragraphs_of(F.col("t"))).first()[0] == ["a", "b"]


def test_occurrences_overlap_and_quote(spark):
    rows = spark.createDataFrame([("aaaa", "aa"), ("a.b a.b", "a.b"), (r"x\Ey", r"\E"), ("abc", ""), ("ab", "abc")], "c string, t string")
    assert [r[0] for r in rows.select(T.occurrences(F.col("c"), F.col("t"))).collect()] == [3, 2, 1, 0, 0]


def test_trigram_join_equals_nested_loop(spark):
    rows = spark.createDataFrame([(i, f"text {i} with Words{i % 7} and é{i % 3}") for i in range(60)], "id int, content string")
    needles = spark.createDataFrame([("words3",), ("text 1",), ("é",), ("and",), ("zzz",)], "needle string")
    a = search.containing(rows, needles).select("id", "needle").collect()
    b = search.containing(rows, needles, limit=2).select("id", "needle").collect()
    assert sorted(a) == sorted(b) and a


def test_ranks_with_many_ties(spark):
    rows = spark.createDataFrame([("t", float(i % 3), f"{i * 37 % 101:04x}", i) for i in range(300)], "part string, score double, key string, para int")
    got = rank_within(rows, "part", "score", ["key", "para"]).select("score", "key", "para", "rank").collect()
    want = sorted((r["score"], r["key"], r["para"]) for r in got)
    assert [(r["score"], r["key"], r["para"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 301))


def test_null_draft_is_kept(spark):
    files = spark.createDataFrame([("a", "ok", None), ("b", "ok", 1), ("c", "ok", 0), ("d", "error", None)], "file_key string, status string, is_draft int")
    assert {r[0] for r in catalog.searchable(files, exclude_drafts=True).select("file_key").collect()} == {"a", "c"}


def test_duplicate_groups_are_for_ok_files_only(spark):
    files = spark.createDataFrame([("b", "ok", "h"), ("a", "error", "h"), ("c", "ok", "h"), ("d", "ok", None)], "file_key string, status string, content_hash string")
    assert {r["file_key"]: r["dup_group"] for r in catalog.duplicate_groups(files).collect()} == {"a": "a", "b": "b", "c": "b", "d": "d"}


def test_globs_cross_folders(spark):
    rows = spark.createDataFrame([("a/*", "a/b/c.x"), ("a/?.x", "a/b.x"), ("a+(1)*", "a+(1)z"), ("*.y", "a.x")], "g string, p string")
    assert [r[0] for r in rows.select(F.rlike("p", catalog.glob_regex(F.col("g")))).collect()] == [True, True, True, False]


def test_scan_that_is_not_full_marks_nothing_missing(spark):
    old = spark.createDataFrame([("k", "p", 1, 1, "ok")], "file_key string, path string, size int, mtime int, status string")
    scan = spark.createDataFrame([("n", "q", 1, 1, "ok")], "file_key string, path string, size int, mtime int, kind string")
    assert {r["change"] for r in catalog.scan_changes(old, scan, full=False).collect()} == {"new"}
    assert {r["change"] for r in catalog.scan_changes(old, scan).collect()} == {"new", "missing"}


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = catalog.upsert(old, new, ["k"])
    assert sorted(catalog.upsert(once, new, ["k"]).collect()) == sorted(once.collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_expansion_levels_and_avoid_list(spark):
    terms = spark.createDataFrame([("x", "One", "strict"), ("x", "two", "normal"), ("x", "three", "broad"), ("y", "one", "normal")], "canonical string, variant string, strength string")
    kw = spark.createDataFrame([("ONE",)], "kw string")
    got = lambda **k: {r["term"] for r in search.expand(kw, terms, **k).collect()}
    assert got(mode="strict") == {"one"} and got() == {"one", "two"} and got(mode="broad") == {"one", "two", "three"}
    assert got(avoid=spark.createDataFrame([("x", "two")], "canonical string, variant string")) == {"one"}


def test_version_filter_names():
    assert versions.resolve_filter("buyerdraft, Execution version") == ["buyer_draft", "execution"]
    with pytest.raises(ValueError):
        versions.resolve_filter(["nope"])


def test_version_conflict_lowers_confidence(spark):
    rows = spark.createDataFrame([("SPA_executed.docx",), ("SPA_executed draft.docx",), ("final.docx",), ("x.docx",)], "filename string")
    got = [(r[0], r[1]) for r in rows.select(versions.classify(F.col("filename")).alias("v")).select("v.role", "v.confidence").collect()]
    assert got == [("execution", "high"), ("execution", "med"), ("execution", "low"), ("unknown", None)] or got[2][0] == "execution"


def test_tri_state_order(spark):
    rows = spark.createDataFrame([(None, False), (False, None), (True, None), (True, True)], "a boolean, b boolean")
    answer, by = metadata.tri_state([("a", F.col("a")), ("b", F.col("b"))])
    assert [tuple(r) for r in rows.select(answer, by).collect()] == [("needs_review", "a"), ("no_match", "a"), ("needs_review", "b"), ("match", None)]


def test_metadata_json_is_typed(spark):
    rows = spark.createDataFrame([("a", '{"evaluated":true,"amount_value":"5"}'), ("b", "not json"), ("c", '{"evaluated":true,"amount_value":7}')], "file_key string, consideration_json string").withColumns({"clause_map_json": F.lit("{}"), "parties_json": F.lit(None).cast("string"), "txt_hash": F.lit("h"), "confidence": F.lit("high"), "meta_schema_version": F.lit(3)})
    files = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "ok"), ("d", "ok")], "file_key string, status string")
    got = {r["file_key"]: r["answer"] for r in metadata.structured_filter(files, rows, least=1.0).collect()}
    assert got == {"a": "needs_review", "b": "needs_review", "c": "match", "d": "needs_review"}
    with pytest.raises(ValueError):
        metadata.structured_filter(files, rows, least=2.0, most=1.0)


def test_absence_without_metadata_is_review(spark):
    files = spark.createDataFrame([("a", "ok", "h")], "file_key string, status string, content_hash string")
    meta = spark.createDataFrame([], "file_key string, clause_map_json string, parties_json string, consideration_json string, confidence string, txt_hash string, meta_schema_version int")
    assert metadata.clause_filter(files, meta, "law", False).first()["answer"] == "needs_review"


def test_missing_storage_makes_source_stale(spark):
    files = spark.createDataFrame([("a", "ok", "h"), ("s", "missing", "g")], "file_key string, status string, content_hash string")
    fam = spark.createDataFrame([("CP",)], "family string")
    cov = spark.createDataFrame([("a", "CP", "complete", "no_annex", "h")], "file_key string, family string, body_status string, annex_status string, txt_hash string")
    src = spark.createDataFrame([("a", "CP", "1", "schedule", "complete", "s", "g"), ("a", "CP", "2", "schedule", "partial", None, "h")], "file_key string, family string, source_id string, source_kind string, status string, storage_file_key string, txt_hash string")
    cand = spark.createDataFrame([(1, "a", "CP", "CP.A", "n", "pending", 1)], "candidate_id long, evidence_file_key string, family string, recommended_parent_id string, proposed_ko string, status string, document_count int")
    row = clauses.coverage_states(files, fam, cov, src, cand).filter("file_key = 'a'").first()
    assert row["state"] == "needs_review" and row["reasons"] == "schedule_partial:1|source_stale:1|pending:1"


def test_ranges_that_touch_overlap(spark):
    a = spark.createDataFrame([("f", "x", 1, 3)], "file_key string, a_ref string, a_lo int, a_hi int")
    b = spark.createDataFrame([("f", "y", 3, 4), ("f", "z", 4, 5)], "file_key string, b_ref string, b_lo int, b_hi int")
    assert [r["b_ref"] for r in extraction.overlapping(a, b).collect()] == ["y"]


def test_short_quotes_are_never_contained(spark):
    gold = spark.createDataFrame([("g", "f", "abc def", 1, 1, "RW.A")], "gt_id string, file_key string, verbatim string, loc_start int, loc_end int, taxonomy_id string")
    rows = spark.createDataFrame([("r", "f", "abc", 9, 9, "RW.A")], "ref string, file_key string, verbatim string, loc_start int, loc_end int, taxonomy_id string")
    assert evaluation.match_answers(gold, rows).count() == 0


def test_zero_denominators_give_null(spark):
    arms = spark.createDataFrame([("x", "a")], "arm string, file_key string")
    row = evaluation.pooled(arms, spark.createDataFrame([], "file_key string, verdict string")).first()
    assert row["precision"] is None and row["relative_recall"] is None and row["unjudged"] == 1


def test_quotas_sum_to_the_total(spark):
    strata = spark.createDataFrame([("a", 10), ("b", 3), ("c", 1)], "stratum string, size long")
    assert sum(r["quota"] for r in sampling.largest_remainder(strata, 7).collect()) == 7
    assert {r["stratum"]: r["quota"] for r in sampling.balanced_quotas(strata, 8).collect()} == {"a": 4, "b": 3, "c": 1}


def test_replace_keeps_preserved_items(spark):
    old = spark.createDataFrame([("f", "CP", "1"), ("f", "CP", "2"), ("g", "CP", "3")], "file_key string, family string, item_ref string")
    new = spark.createDataFrame([("f", "CP", "9")], "file_key string, family string, item_ref string")
    kept = spark.createDataFrame([("2",)], "item_ref string")
    assert {r["item_ref"] for r in lifecycle.replace_results(old, new, ["file_key", "family"], kept).collect()} == {"2", "3", "9"}


def test_clean_items_have_no_issues(spark):
    items = spark.createDataFrame([("f", "r", "RW", "RW", "q", 1, 1, "affirmative", "h", "approved")], "file_key string, item_ref string, taxonomy_id string, family string, verbatim string, loc_start int, loc_end int, statement_polarity string, txt_hash string, review_status string")
    nodes = spark.createDataFrame([("RW", "RW")], "taxonomy_id string, family string")
    files = spark.createDataFrame([("f", "h")], "file_key string, content_hash string")
    assert audits.item_issues(items, nodes, files).count() == 0


def test_heading_ranges_end_with_the_document(spark):
    p = spark.createDataFrame([("f", i, t) for i, t in enumerate(["Title", "long text here, it goes on and on until it ends.", "Other", "x."], 1)], "file_key string, para int, content string")
    got = [(r["from_para"], r["to_para"]) for r in structure.heading_ranges(p, structure.is_heading(F.col("content"))).orderBy("from_para").collect()]
    assert got == [(1, 2), (3, 4)]


def test_status_counts_fill_the_domain(spark):
    files = spark.createDataFrame([("ok",)], "status string")
    assert {r["status"]: r["n"] for r in stats.counts_over_domain(files, "status", stats.STATUSES).collect()}["missing"] == 0


def test_paragraph_cache_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("k1", 1, "a"), ("k1", 2, "b\tc"), ("k2", 1, "d")], "file_key string, para int, content string")
    lines = {}
    for r in writers.cache_lines(p).collect():
        lines.setdefault(r["file_key"], []).append(r["value"])
    for k, v in lines.items():
        (tmp_path / f"{k}.txt").write_text("\n".join([*v, "no mark"]), encoding="utf-8")
    strict = readers.cached_paragraphs(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in strict) == [("k1", 1, "a"), ("k1", 2, "b\tc"), ("k2", 1, "d")]
    lenient = readers.cached_paragraphs(spark, str(tmp_path), strict=False).collect()
    assert ("k1", 3, "no mark") in [tuple(r) for r in lenient]
    writers.write_paragraph_cache(p, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_result_files_and_logs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"file_key": "f", "review_method": "full", "items": [{"taxonomy_id": "RW"}, {"taxonomy_id": "CP"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"file_key": "g", "review_method": "quick", "items": [{"taxonomy_id": "RW"}]}))
    (tmp_path / "c.json").write_text("{broken")
    got = readers.result_items(spark, str(tmp_path), ["full"], "taxonomy_id: string").collect()
    assert [(r["file_key"], r["item_no"], r["taxonomy_id"]) for r in got] == [("f", 0, "RW"), ("f", 1, "CP")]
    log = tmp_path / "log"
    log.mkdir()
    (log / "x.jsonl").write_text('{"kw": "a"}\nnot json\n{"kw": "b"}\n')
    assert {r["kw"] for r in readers.json_lines(spark, str(log), "kw string").collect()} == {"a", "b"}
    writers.append_log(spark.createDataFrame([("c",)], "kw string"), str(tmp_path / "more"))
    writers.append_log(spark.createDataFrame([("d",)], "kw string"), str(tmp_path / "more"))
    assert spark.read.json(str(tmp_path / "more")).count() == 2
    writers.write_csv(spark.createDataFrame([(1, 2)], "a int, b int"), ["b", "a"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["b", "a"]


def test_listing_and_kinds(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.rtf").write_bytes(b"{\\rtf1 x")
    (tmp_path / "d" / "misc.doc").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    (tmp_path / "b.zip").write_bytes(b"PK\x03\x04x")
    misc = spark.createDataFrame([("misc",)], "pattern string")
    assert readers.listing(spark, str(tmp_path), misc).count() == 2
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert {r[0] for r in files.select(readers.document_kind(F.col("content"))).collect()} == {"rtf", "ole2", "zip"}


def test_dictionary_rows():
    assert readers.dictionary_rows([{"canonical": "x", "kind": "k", "ko": ["가"], "en": ["a", "b"], "expansion_strength": "broad"}]) == [("x", "가", "k", "broad", "ko"), ("x", "a", "k", "broad", "en"), ("x", "b", "k", "broad", "en")]


def test_subtree_with_cycle_depth_and_status(spark):
    from docloom.operators.clauses import subtree

    rows = [(f"n{i}", f"n{i - 1}" if i else "n150", "active") for i in range(151)] + [("off", "n3", "retired"), ("below", "off", "active")]
    nodes = spark.createDataFrame(rows, "taxonomy_id string, parent_id string, status string")
    got = {r["taxonomy_id"]: r["depth"] for r in subtree(nodes, "n0").collect()}
    assert got == {f"n{i}": i for i in range(151)}
    assert subtree(nodes, "off").count() == 0 and subtree(nodes, "n150", include_root=False).count() == 150


def test_facts_filter_bounds(spark):
    import pytest

    from docloom.operators import metadata as M

    files = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "ok"), ("d", "error")], "file_key string, status string")
    people = '{"evaluated":true,"items":[{"name":"X","role":"seller"},{"name":"Y","role":"buyer"}]}'
    meta = spark.createDataFrame([("a", 3, people, None, '{"indemnity":{"present":true,"normalized":{"cap_pct_of_price":"ten"}}}'), ("b", 2, people, None, None)], "file_key string, meta_schema_version int, parties_json string, consideration_json string, clause_map_json string")
    answers = lambda **f: {r["file_key"]: (r["answer"], r["decided_by"]) for r in M.facts_filter(files, meta, **f).collect()}
    assert answers(party="x", role="buyer") == {"a": ("no_match", "party"), "b": ("needs_review", "version"), "c": ("needs_review", "version")}
    assert answers(party="y", role="buyer")["a"] == ("match", None) and answers(cap_pct=(1, None))["a"] == ("needs_review", "cap_pct")
    for wrong in ({"amount": (2, 1)}, {"cap_pct": (-1, None)}, {"survival_months": (True, None)}):
        with pytest.raises(ValueError):
            M.facts_filter(files, meta, **wrong)
