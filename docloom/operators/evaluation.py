"""Retrieval evaluation: matching answers, recall, pooling and probes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.grams import gram_hashes, least_in_windows
from docloom.functions.ranking import rank_within
from docloom.functions.text import subdomain
from docloom.sources.scratch import stored

#: From so many rows on, a needle's hits are ranked in parts.
OFTEN = 50_000


def fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


#: A shorter text is found by the least of its grams' hashes.  Of a longer text the least hashes
#: of all runs of so many grams are kept: the more the shorter text has, the fewer are needed.
RUNS = (1, 9, 33)


def _contained(texts: DataFrame, least: int) -> DataFrame:
    """Pairs s_key, l_key of a document's texts (file_key, key, text, is_gold, is_row), one of a gold
    item and one of a result, of which the first stands in the second (``least`` characters or more).

    The longer texts of a document are cut for those lengths only that its shorter ones have.
    """
    runs = list(RUNS)

    def keys(batches):
        for b in batches:
            at, longer, run, out = [], [], [], []
            for i, (text, wanted) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                hashes = gram_hashes(text, least)
                own = max(k for k, r in enumerate(runs) if len(hashes) >= r)
                each = [(k, least_in_windows(hashes, r)) for k, r in enumerate(runs) if wanted >> k & 1]
                for k, found, role in [(own, hashes.min(keepdims=True), False), *[(k, f, True) for k, f in each]]:
                    at.append(np.full(len(found), i))
                    longer.append(np.full(len(found), role))
                    run.append(np.full(len(found), k, np.int32))
                    out.append(found.view(np.int64))
            join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            taken = [b.column(c).take(join(at, pa.int64())) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*taken, join(longer, pa.bool_()), join(run, pa.int32()), join(out, pa.int64())], names=["file_key", "key", "is_gold", "is_row", "longer", "run", "hash"])

    size = F.length("text") - least + 1
    own = F.lit(0)
    for k, r in enumerate(runs):
        own = F.when(size >= r, 1 << k).otherwise(own)
    wanted = texts.groupBy("file_key").agg(F.bit_or(own).alias("wanted"))
    rows = texts.join(wanted, "file_key").select("file_key", "key", "is_gold", "is_row", "text", "wanted")
    found = rows.mapInArrow(keys, "file_key string, key string, is_gold boolean, is_row boolean, longer boolean, run int, hash long")
    side = lambda p, longer: found.filter(F.col("longer") == longer).select("file_key", "run", "hash", F.col("key").alias(f"{p}_key"), F.col("is_gold").alias(f"{p}_gold"), F.col("is_row").alias(f"{p}_row"))
    near = side("s", False).join(side("l", True), ["file_key", "run", "hash"]).filter("s_key <> l_key and (s_gold and l_row or s_row and l_gold)").select("file_key", "s_key", "l_key")
    body = lambda p: texts.select("file_key", F.col("key").alias(f"{p}_key"), F.col("text").alias(f"{p}_text"))
    sure = near.join(body("s"), ["file_key", "s_key"]).join(body("l"), ["file_key", "l_key"]).filter(F.contains("l_text", F.col("s_text")))
    return sure.select("file_key", "s_key", "l_key")


def match_answers(gold: DataFrame, rows: DataFrame, least: int = 8) -> DataFrame:
    """How a result answers a gold item of the same file: 'text' (equal folded text), 'contained'
    (one inside the other, ``least`` characters or more), 'range' (overlap in the same
    sub-domain); the first that holds.  gold: gt_id, file_key, verbatim, loc_start, loc_end,
    taxonomy_id; rows: the same with ref.

    Each rule has a key of its own (the text; a gram of the shorter text; the later range's
    first paragraph), so no document's items are all held against each other.
    """
    text = fold(F.col("verbatim"))
    g = gold.select("file_key", "gt_id", text.alias("text"), F.md5(text).alias("key"), "loc_start", "loc_end", subdomain(F.col("taxonomy_id")).alias("sub"))
    r = rows.select("file_key", "ref", text.alias("text"), F.md5(text).alias("key"), "loc_start", "loc_end", subdomain(F.col("taxonomy_id")).alias("sub"))
    pair = ["file_key", "gt_id", "ref"]
    gk, rk = g.select("file_key", "gt_id", "key"), r.select("file_key", "ref", "key")
    same = gk.join(rk, ["file_key", "key"]).select(*pair, F.lit(1).alias("rule"))
    long = g.select("file_key", "key", "text", F.lit(True).alias("g")).unionByName(r.select("file_key", "key", "text", F.lit(False).alias("g"))).filter(F.length("text") >= least)
    texts = long.groupBy("file_key", "key").agg(F.first("text").alias("text"), F.max("g").alias("is_gold"), F.max(~F.col("g")).alias("is_row"))
    texts = stored(texts.join(gold.select("file_key").distinct(), "file_key", "left_semi"), "answer-texts")  # equal texts of a document once
    held = stored(_contained(texts, least), "answer-pairs")
    side = lambda df, key: df.withColumnRenamed("key", key)
    inner = held.join(side(gk, "s_key"), ["file_key", "s_key"]).join(side(rk, "l_key"), ["file_key", "l_key"]).select(*pair, F.lit(2).alias("rule"))
    outer = held.join(side(rk, "s_key"), ["file_key", "s_key"]).join(side(gk, "l_key"), ["file_key", "l_key"]).select(*pair, F.lit(2).alias("rule"))
    spans = lambda df, ref, side: df.filter("loc_start <= loc_end").select("file_key", "sub", ref, F.col("loc_start").alias(f"{side}_lo"), F.col("loc_end").alias(f"{side}_hi"))
    gs, rs = spans(g, "gt_id", "g"), spans(r, "ref", "r")
    key = ["file_key", "sub", "at"]
    later_r = gs.withColumn("at", F.explode(F.sequence("g_lo", "g_hi"))).join(rs.withColumn("at", F.col("r_lo")), key)
    later_g = rs.withColumn("at", F.explode(F.sequence("r_lo", "r_hi"))).join(gs.withColumn("at", F.col("g_lo")), key)
    met = later_r.select(*pair).unionByName(later_g.select(*pair)).withColumn("rule", F.lit(3))
    every = same.unionByName(inner).unionByName(outer).unionByName(met)
    names = F.create_map(*[F.lit(x) for kv in ((1, "text"), (2, "contained"), (3, "range")) for x in kv])
    return every.groupBy(*pair).agg(F.min("rule").alias("rule")).select("gt_id", "file_key", "ref", names[F.col("rule")].alias("rule"))


def same_text_anywhere(gold: DataFrame, rows: DataFrame) -> DataFrame:
    """Results of any document with a gold item's folded text, by class of equal texts: gt_id,
    text_key (sha256 of the text), n_refs, first_ref.  With text_key on both sides a gold item
    meets all its results; they are not written out as pairs, of which there are k times m."""
    key = F.sha2(fold(F.col("verbatim")), 256).alias("text_key")
    classes = rows.select("ref", key).distinct().groupBy("text_key").agg(F.count(F.lit(1)).alias("n_refs"), F.min("ref").alias("first_ref"))
    return gold.select("gt_id", key).distinct().join(classes, "text_key").select("gt_id", "text_key", "n_refs", "first_ref")


def recall_at(ranks: DataFrame, grid: list[int], by: list[str] | None = None) -> DataFrame:
    """Share of gold items found within k for each k of the grid, and the median rank of those
    found.  ranks: one row per gold item, rank null if not found."""
    ks = F.explode(F.array(*[F.lit(k) for k in grid])).alias("k")
    rows = ranks.select(*(by or []), "rank", ks)
    return rows.groupBy(*(by or []), "k").agg(F.count(F.lit(1)).alias("items"), F.bround(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)), 4).alias("recall"), F.median("rank").alias("median_rank"))


def hybrid(paths: list[DataFrame], key: list[str]) -> DataFrame:
    """Least rank over several retrieval paths."""
    rows = paths[0]
    for p in paths[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*key).agg(F.min("rank").alias("rank"))


def pooled(arms: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per arm: judged and unjudged results, precision and recall relative to the pool's correct
    ones; null where nothing is judged.  arms: arm, file_key; verdicts: file_key, verdict."""
    pool = arms.select("arm", "file_key").distinct()
    correct = pool.select("file_key").distinct().join(verdicts.filter("verdict = 'correct'"), "file_key", "left_semi").agg(F.count(F.lit(1)).alias("_all"))
    rows = pool.join(verdicts, "file_key", "left").groupBy("arm").agg(F.count("verdict").alias("judged"), F.count_if(F.col("verdict").isNull()).alias("unjudged"), F.count_if(F.col("verdict") == "correct").alias("correct"))
    rows = rows.crossJoin(F.broadcast(correct))
    return rows.select("arm", "judged", "unjudged", F.when(F.col("judged") > 0, F.bround(F.col("correct") / F.col("judged"), 4)).alias("precision"), F.when(F.col("_all") > 0, F.bround(F.col("correct") / F.col("_all"), 4)).alias("relative_recall"))


def gate(gold: DataFrame, arms: DataFrame) -> DataFrame:
    """Per arm and query: recall of the gold files and how many files are to be read.
    gold: query, file_key; arms: arm, query, file_key."""
    need = gold.groupBy("query").agg(F.count_distinct("file_key").alias("need"))
    got = arms.distinct().join(gold.distinct().withColumn("_g", F.lit(1)), ["query", "file_key"], "left").groupBy("arm", "query").agg(F.count(F.lit(1)).alias("to_read"), F.count("_g").alias("found"))
    every = arms.select("arm").distinct().crossJoin(F.broadcast(need))
    return every.join(got, ["arm", "query"], "left").select("arm", "query", "need", F.coalesce("to_read", F.lit(0)).alias("to_read"), F.bround(F.coalesce("found", F.lit(0)) / F.col("need"), 4).alias("recall"))


def golden_status(results: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """pass, fail, unscored or skipped for each golden query, with recall of its expected files.
    expected: query, expected_count, skip; files: query, file_key of the expected files, without
    a row for a query that names none; results: query, file_key."""
    got = results.distinct()
    sizes = got.groupBy("query").agg(F.count("file_key").alias("_n"))
    found = files.join(got.withColumn("_g", F.lit(True)), ["query", "file_key"], "left")
    hits = found.groupBy("query").agg(F.count(F.lit(1)).alias("_want"), F.count_distinct(F.when(F.col("_g"), F.col("file_key"))).alias("_hit"))
    rows = expected.join(sizes, "query", "left").join(hits, "query", "left").withColumn("_n", F.coalesce("_n", F.lit(0)).cast("int"))
    count_ok = F.col("expected_count").isNull() | (F.col("_n") == F.col("expected_count"))
    files_ok = F.col("_want").isNull() | (F.col("_hit") == F.col("_want"))
    nothing = F.col("_want").isNull() & F.col("expected_count").isNull()
    status = F.when(F.col("skip"), "skipped").when(nothing, "unscored").when(count_ok & files_ok, "pass").otherwise("fail")
    return rows.select("query", F.col("_n").alias("n"), F.bround(F.col("_hit") / F.col("_want"), 4).alias("recall"), status.alias("status"))


def extraction_errors(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Defects by family: correct (overlap in the same lineage), misclassified (overlap only) and
    over-extracted items, and missed gold items; rates to three digits."""
    g = gold.select("file_key", F.col("ref").alias("g_ref"), F.col("loc_start").alias("gs"), F.col("loc_end").alias("ge"), F.col("taxonomy_id").alias("gt"))
    pairs = found.join(g, "file_key", "left").withColumn("_o", F.expr("gs <= loc_end and loc_start <= ge"))
    line = F.startswith(F.concat("gt", F.lit(".")), F.concat("taxonomy_id", F.lit("."))) | F.startswith(F.concat("taxonomy_id", F.lit(".")), F.concat("gt", F.lit(".")))
    items = pairs.groupBy("file_key", "ref", "family").agg(F.coalesce(F.bool_or(F.col("_o") & line), F.lit(False)).alias("right"), F.coalesce(F.bool_or("_o"), F.lit(False)).alias("near"))
    rates = items.groupBy("family").agg(F.count(F.lit(1)).alias("items"), F.count_if("right").alias("correct"), F.count_if(~F.col("right") & F.col("near")).alias("misclassified"), F.count_if(~F.col("near")).alias("over_extracted"))
    hit = gold.alias("g").join(found.alias("f"), F.expr("g.file_key = f.file_key and g.family = f.family and g.loc_start <= f.loc_end and f.loc_start <= g.loc_end"), "left_anti")
    missed = hit.groupBy("family").agg(F.count(F.lit(1)).alias("missed"))
    return rates.join(missed, "family", "left").select("family", "items", "correct", "misclassified", "over_extracted", F.coalesce("missed", F.lit(0)).alias("missed"), F.bround(F.col("correct") / F.col("items"), 3).alias("precision"))


def quote_needle(text: Column, size: int = 40) -> Column:
    return F.substring(F.trim(text), 1, size)


def paraphrase_tokens(text: Column, n: int = 4) -> Column:
    """The n longest different words, longest first, then by spelling; a trailing 's' is dropped."""
    # a run of three letters or more is matched whole, the group leaves its last 's' out
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?=\p{L}{3})(\p{L}+?)s?(?!\p{L})"), 1))
    keyed = F.sort_array(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))  # array_sort compares by a lambda
    return F.transform(F.slice(keyed, 1, n), lambda x: x["w"])


def token_coverage(tokens: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.contains(low, t))) / F.size(tokens))


def probe_ranks(probes: DataFrame, rows: DataFrame) -> DataFrame:
    """Rank of the wanted row of each probe among the rows that hold its needle, by length of text
    and keys.  probes: probe, file_key, para, needle; rows: paragraphs."""
    from docloom.operators.search import containing

    probes = probes.withColumn("needle", F.lower("needle"))
    # equal needles are looked for and ranked once
    hits = containing(rows, probes.select("needle").distinct(), fold=True).select("needle", "file_key", "para", F.length("content").alias("size"))
    hits = stored(hits, "probe-hits")
    often = F.broadcast(hits.groupBy("needle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN).select("needle"))  # fewer than hits / OFTEN
    w = W.partitionBy("needle").orderBy("size", "file_key", "para")
    few = hits.join(often, "needle", "left_anti").select("needle", "file_key", "para", F.row_number().over(w).alias("rank"))
    many = rank_within(hits.join(often, "needle", "left_semi"), "needle", "size", ["file_key", "para"]).select("needle", "file_key", "para", F.col("rank").cast("int").alias("rank"))
    return probes.join(few.unionByName(many), ["needle", "file_key", "para"], "left").select("probe", "file_key", "para", "rank")


def miss_reasons(missed: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """Why a gold item was not found: too_short, not_in_index, node_mismatch or ranking."""
    texts = items.select("file_key", fold(F.col("verbatim")).alias("_t"), subdomain(F.col("taxonomy_id")).alias("_d")).distinct()
    g = missed.withColumn("_t", fold(F.col("verbatim"))).withColumn("_gd", subdomain(F.col("taxonomy_id")))
    seen = g.join(texts, ["file_key", "_t"], "left").groupBy("gt_id", "file_key", "_t", "_gd").agg(F.count("_d").alias("_n"), F.coalesce(F.bool_or(F.col("_d") == F.col("_gd")), F.lit(False)).alias("_same"))
    reason = F.when(F.length("_t") < least, "too_short").when(F.col("_n") == 0, "not_in_index").when(~F.col("_same"), "node_mismatch").otherwise("ranking")
    return seen.select("gt_id", "file_key", reason.alias("reason"))


def merge_verdicts(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A new verdict replaces the old one of the same key."""
    return old.join(new, key, "left_anti").unionByName(new)
