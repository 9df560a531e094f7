"""Keyword search over paragraphs: expansion, literal matching, bm25 and rank fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions.grams import gram_hashes, grams_of_all
from docloom.functions.ranking import rank_within
from docloom.functions.text import matches, occurrences
from docloom.operators.catalog import representatives, searchable
from docloom.sources.scratch import local_rows, stored

K1, B = 1.2, 0.75
#: Rank fusion: weight / (FUSION + rank).
FUSION, EXACT_WEIGHT, EXPANDED_WEIGHT = 60, 2.0, 1.0
SNIPPET = 240
#: Up to so many needles are broadcast and tried on every row.
BROADCAST_NEEDLES = 2000
#: Lengths of the grams that stand for larger sets of needles, and up to so many keys are sent.
GRAMS, SENT_KEYS = (24, 12, 6, 3), 4_000_000
STRENGTHS = {"strict": 0, "normal": 1, "broad": 2}


def containing(rows: DataFrame, needles: DataFrame, fold: bool = True, limit: int = BROADCAST_NEEDLES) -> DataFrame:
    """Pairs of a row (column content) and a needle (column needle) that stands in it.

    A small set of needles is broadcast.  Of a larger one each needle has a key, a hash of one of
    its grams; the keys go to the tasks, and rows that have a key meet its needles and are
    verified.  Beyond ``SENT_KEYS`` needles are joined on their rarest trigram.  Needles under
    three characters are joined apart.
    """
    low = F.lower if fold else (lambda c: F.col(c) if isinstance(c, str) else c)
    n = needles.limit(limit + 1).count()
    if n <= limit:
        return rows.join(F.broadcast(needles), F.contains(low("content"), low("needle")))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, 3)))
    short, long = needles.filter("length(needle) < 3"), needles.filter("length(needle) >= 3")
    found = None if short.isEmpty() else _containing_short(rows, short, low)  # cuts every row
    also = lambda df: df if found is None else found.unionByName(df)
    keys = stored(_needle_keys(long.select(low("needle").alias("_n")).distinct()), "needle-keys")
    if keys.count() <= SENT_KEYS:
        return also(_containing_by_keys(rows, long, keys, low))
    # the text is not copied beside each of its trigrams: rows are found again by a hash of it
    keyed = rows.withColumn("_k", F.xxhash64("content"))
    tri = keyed.select("_k", F.explode(grams(low("content"))).alias("_g")).distinct()
    df = tri.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    pick = long.distinct().select("needle", F.explode(grams(low("needle"))).alias("_g")).distinct().join(df, "_g", "left")
    rare = pick.groupBy("needle").agg(F.min_by("_g", F.struct(F.coalesce("_df", F.lit(0)), F.col("_g"))).alias("_g"))
    likely = tri.join(long.join(rare, "needle"), "_g").drop("_g")
    joined = keyed.join(likely, "_k").filter(F.contains(low("content"), low("needle"))).drop("_k")
    return also(joined)


def _needle_keys(needles: DataFrame) -> DataFrame:
    """_n, size, key: the least hash of the needle's grams of the largest of GRAMS that it has."""

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            sizes = [max(g for g in GRAMS if g <= len(t)) for t in texts]
            keys = [int(gram_hashes(t, g).min().view(np.int64)) for t, g in zip(texts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())], names=["_n", "_size", "_key"])

    return needles.filter(F.length("_n") >= min(GRAMS)).mapInArrow(run, "_n string, _size int, _key long")


def _containing_by_keys(rows: DataFrame, long: DataFrame, keys: DataFrame, low) -> DataFrame:
    """Rows meet the needles whose key is among the hashes of their grams."""
    wanted: dict[int, list[int]] = {}
    for size, key in keys.select("_size", "_key").distinct().collect():  # SENT_KEYS at most
        wanted.setdefault(size, []).append(key)
    sent = rows.sparkSession.sparkContext.broadcast({g: np.sort(np.array(k, np.int64).view(np.uint64)) for g, k in wanted.items()})
    names = [*rows.columns, "_size", "_key"]
    schema = StructType([*rows.schema.fields]).add("_size", "integer").add("_key", "long")

    def run(batches):
        seen = {}
        for g, own in sent.value.items():
            seen[g] = np.zeros(1 << 22, bool)
            seen[g][(own >> np.uint64(42)).astype(np.int64)] = True
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            at, sizes, hits, lo = [], [], [], 0
            while lo < len(texts):
                hi, used = lo + 1, len(texts[lo])
                while hi < len(texts) and used < 1 << 18:
                    used += len(texts[hi])
                    hi += 1
                for g, own in sent.value.items():
                    row, hashes = grams_of_all(texts[lo:hi], g)
                    some = seen[g][(hashes >> np.uint64(42)).astype(np.int64)]
                    row, hashes = row[some], hashes[some]
                    sure = own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes
                    found = np.unique(np.stack([row[sure].astype(np.uint64), hashes[sure]], 1), axis=0)
                    at.append(found[:, 0].astype(np.int64) + lo)
                    sizes.append(np.full(len(found), g, np.int32))
                    hits.append(found[:, 1].copy().view(np.int64))
                lo = hi
            take = pa.array(np.concatenate(at) if at else [], pa.int64())
            more = [pa.array(np.concatenate(sizes) if at else [], pa.int32()), pa.array(np.concatenate(hits) if at else [], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[b.column(1 + k).take(take) for k in range(len(names) - 2)], *more], names=names)

    likely = rows.select(low("content").alias("_low"), *rows.columns).mapInArrow(run, schema)
    pairs = long.withColumn("_n", low("needle")).join(keys, "_n").drop("_n")
    return likely.join(pairs, ["_size", "_key"]).drop("_size", "_key").filter(F.contains(low("content"), low("needle")))


def _containing_short(rows: DataFrame, short: DataFrame, low) -> DataFrame:
    """Rows with needles under three characters: joined on the text's one- and two-character
    pieces; an empty needle stands in every row."""
    spot = F.col("_t")
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(spot)), lambda i: F.array(F.substring(spot, i, 1), F.substring(spot, i, 2)))))
    text = rows.filter("content is not null").withColumn("_t", low("content"))
    cut = text.withColumn("_p", F.explode(F.when(F.length("_t") > 0, F.array_union(pieces, F.array(F.lit("")))).otherwise(F.array(F.lit("")))))
    return cut.drop("_t").join(short.withColumn("_p", low("needle")), "_p").drop("_p")


def expand(keywords: DataFrame, terms: DataFrame, mode: str = "normal", avoid: DataFrame | None = None) -> DataFrame:
    """Terms to search for each keyword (kw): term, source ('exact' or 'expanded'), canonical.

    The keyword itself comes first.  Entries that hold the keyword (as canonical or variant)
    add their variants up to the strength ``mode``; pairs in ``avoid`` (canonical, variant) are
    left out; a term counts once, whatever its case.
    """
    levels = [k for k, v in STRENGTHS.items() if v <= STRENGTHS[mode]]
    forms = terms.select("canonical", F.lower("variant").alias("form")).union(terms.select("canonical", F.lower("canonical"))).distinct()
    entries = keywords.join(F.broadcast(forms), F.lower("kw") == F.col("form")).select("kw", "canonical").distinct()
    usable = terms.filter(F.col("strength").isin(levels))
    if avoid is not None:
        usable = usable.join(avoid, ["canonical", "variant"], "left_anti")
    more = entries.join(F.broadcast(usable), "canonical").filter("lower(variant) <> lower(kw)")
    more = more.groupBy("kw", F.lower("variant").alias("term")).agg(F.min("canonical").alias("canonical"))
    exact = keywords.distinct().select("kw", F.lower("kw").alias("term"), F.lit("exact").alias("source"), F.lit(None).cast("string").alias("canonical"))
    return exact.unionByName(more.select("kw", "term", F.lit("expanded").alias("source"), "canonical"))


def resolve_tag(keywords: DataFrame, terms: DataFrame) -> DataFrame:
    """Canonical name of each keyword: the first entry that has it (by name), else itself."""
    hit = keywords.join(F.broadcast(terms), F.lower("kw") == F.lower("variant")).groupBy("kw").agg(F.min("canonical").alias("canonical"))
    return keywords.distinct().join(hit, "kw", "left").select("kw", F.coalesce("canonical", F.lower(F.trim("kw"))).alias("tag"))


def bm25(tf: Column, length: Column, avg_length: Column, n_rows: Column, n_hits: Column) -> Column:
    """Score of a phrase; lower is better.  The inverse frequency is at least 1e-6."""
    idf = F.greatest(F.ln((n_rows - n_hits + 0.5) / (n_hits + 0.5)), F.lit(1e-6))
    return -(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length)))


def paragraph_scores(paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """Matching paragraphs of each term with their bm25 score (0 for terms under three
    characters, which only match).  terms: term."""
    size = F.greatest(F.length("content") - 2, F.lit(0))
    n_rows, avg_len = paragraphs.agg(F.count(F.lit(1)), F.avg(size)).first()
    hits = containing(paragraphs, terms.select(F.col("term").alias("needle")).distinct()).withColumnRenamed("needle", "term")
    hits = hits.select("term", "file_key", "para", occurrences(F.col("content"), F.col("term")).alias("tf"), size.alias("len"))
    hits = stored(hits, "hits")  # read for frequencies, quantiles, ranks, terms and snippets
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_hits"))  # a row for each term of the query
    score = bm25(F.col("tf"), F.col("len"), F.lit(avg_len), F.lit(float(n_rows)), F.col("n_hits"))
    return hits.join(F.broadcast(df), "term").select("term", "file_key", "para", F.when(F.length("term") >= 3, F.round(score, 9)).otherwise(0.0).alias("score"))


def best_ranks(scores: DataFrame, expanded: DataFrame) -> DataFrame:
    """Best rank of each file by keyword and source.  A term's paragraphs are ranked over the
    whole corpus by score, file and place; a file counts with its best paragraph."""
    ranked = rank_within(scores, "term", "score", ["file_key", "para"])
    return ranked.join(F.broadcast(expanded), "term").groupBy("kw", "source", "file_key").agg(F.min("rank").alias("rank"))


def fused(ranks: DataFrame, n_keywords: int) -> DataFrame:
    """Fused score of the files that match every keyword."""
    each = F.when(F.col("source") == "exact", EXACT_WEIGHT).otherwise(EXPANDED_WEIGHT) / (FUSION + F.col("rank"))
    both = ranks.groupBy("file_key").agg(F.sum(each).alias("score"), F.count_distinct("kw").alias("n_kw"))
    return both.filter(F.col("n_kw") == n_keywords).drop("n_kw")


def snippets(first: DataFrame, paragraphs: DataFrame, budget: int = SNIPPET, reach: int = 5) -> DataFrame:
    """Text around each file's first hit (first: file_key, hit; the files shown): the nearest
    paragraphs until ``budget`` characters, in their own order, ' / ' between them."""
    near = paragraphs.join(F.broadcast(first), "file_key").filter(F.abs(F.col("para") - F.col("hit")) <= reach)
    w = W.partitionBy("file_key").orderBy(F.abs(F.col("para") - F.col("hit")), "para")
    before = F.coalesce(F.sum(F.length("content")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = near.withColumn("before", before).filter(F.col("before") < budget).withColumn("part", F.expr(f"substring(content, 1, int({budget} - before))"))
    parts = F.array_sort(F.collect_list(F.struct("para", "part")))
    return cut.groupBy("file_key").agg(F.array_join(F.transform(parts, lambda x: x["part"]), " / ").alias("snippet"))


def keyword_search(paragraphs: DataFrame, files: DataFrame, keywords: DataFrame, terms: DataFrame, limit: int = 20, ctype: str | None = None, lang: str | None = None, exclude_drafts: bool = False, dedup: bool = True, mode: str = "normal", avoid: DataFrame | None = None, only: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Ranked files that match all keywords: file_key, filename, score, duplicates,
    matched_terms, snippet, total_files, total.

    ``only``: file_keys that other filters leave (versions, clauses, structured facts).
    ``scores``: paragraph scores from an index; by default all paragraphs are read.
    """
    n = keywords.select("kw").distinct().count()
    expanded = local_rows(expand(keywords, terms, mode, avoid))
    scores = stored(paragraph_scores(paragraphs, expanded) if scores is None else scores, "scores")
    narrow = searchable(files, ctype, lang, exclude_drafts).select("file_key", "filename", "path", "is_draft", "version_hint", "dup_group")
    if only is not None:
        narrow = narrow.join(only.select("file_key").distinct(), "file_key", "left_semi")
    hits = stored(fused(best_ranks(scores, expanded), n).join(narrow, "file_key"), "search-hits")
    size = hits.groupBy("dup_group").agg(F.count(F.lit(1)).alias("duplicates"))
    shown = representatives(hits, [F.col("score").desc()]) if dedup else hits
    total_files, total = hits.agg(F.count(F.lit(1)), F.count_distinct("dup_group")).first()
    top = local_rows(shown.join(size, "dup_group").orderBy(F.col("score").desc(), F.col("file_key")).limit(limit))
    mine = scores.join(F.broadcast(top.select("file_key")), "file_key", "left_semi")
    found = mine.groupBy("file_key").agg(F.array_join(F.slice(F.array_sort(F.collect_set("term")), 1, 20), "|").alias("matched_terms"))
    first = local_rows(mine.groupBy("file_key").agg(F.min("para").alias("hit")))  # a row for each file shown
    out = top.join(found, "file_key").join(snippets(first, paragraphs), "file_key")
    return out.select("file_key", "filename", F.round("score", 9).alias("score"), "duplicates", "matched_terms", "snippet", F.lit(total_files).cast("long").alias("total_files"), F.lit(total).cast("long").alias("total"))


def fitting(files: DataFrame, filters: dict[str, DataFrame], roles: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files that every filter leaves, and what the filters say of the searchable ones.

    ``filters``: by name, tables of file_key and answer (match, no_match or needs_review), as
    the clause and fact filters give them; ``roles``: version roles to keep.  Only a match
    stays.  The notices have a row for each filter and answer: filter, answer, files; the
    filter 'version' gives the files of other roles as no_match, those of unknown role as
    needs_review.
    """
    left = files.filter("status = 'ok'").select("file_key", "version_role")
    every = []
    if roles is not None:
        own = F.col("version_role").isin(roles)
        said = F.when(own, "match").when(F.coalesce("version_role", F.lit("unknown")) == "unknown", "needs_review").otherwise("no_match")
        filters = {"version": left.select("file_key", said.alias("answer")), **filters}
    for name, table in filters.items():
        every.append(left.join(table.select("file_key", "answer"), "file_key").groupBy("answer").agg(F.count(F.lit(1)).alias("files")).select(F.lit(name).alias("filter"), "answer", "files"))
    notices = every[0] if every else left.limit(0).select(F.lit("").alias("filter"), F.lit("").alias("answer"), F.lit(0).cast("long").alias("files"))
    for more in every[1:]:
        notices = notices.unionByName(more)
    for table in filters.values():
        left = left.join(table.filter("answer = 'match'"), "file_key", "left_semi")
    return left.select("file_key"), notices


def zero_hit_terms(paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """Variants of the dictionary that stand in no paragraph."""
    hit = containing(paragraphs.select("content"), terms.select(F.col("variant").alias("needle")).distinct()).select(F.col("needle").alias("variant")).distinct()
    return terms.join(hit, "variant", "left_anti")


def needle_document_frequency(paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """Share of the documents in which each variant stands, to four digits."""
    total = paragraphs.agg(F.count_distinct("file_key").alias("docs"))
    hits = containing(paragraphs, terms.select(F.col("variant").alias("needle")).distinct()).groupBy(F.col("needle").alias("variant")).agg(F.count_distinct("file_key").alias("n"))
    return terms.select("variant").distinct().join(hits, "variant", "left").crossJoin(F.broadcast(total)).select("variant", F.coalesce("n", F.lit(0)).alias("n"), F.bround(F.coalesce("n", F.lit(0)) / F.col("docs"), 4).alias("df"))


def matched_entries(paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """Dictionary entries found in each document: file_key, canonicals (joined by '|')."""
    hits = containing(paragraphs, terms.select(F.col("variant").alias("needle"), "canonical"))
    return hits.groupBy("file_key").agg(F.array_join(F.array_sort(F.collect_set("canonical")), "|").alias("canonicals"))


def keyword_in_context(paragraphs: DataFrame, terms: DataFrame, reach: int = 60) -> DataFrame:
    """First paragraph of each document for each term, cut to ``reach`` characters around it."""
    hits = containing(paragraphs, terms.select(F.col("term").alias("needle")).distinct())
    first = hits.groupBy("file_key", F.col("needle").alias("term")).agg(F.min("para").alias("para"), F.min_by("content", "para").alias("content"))
    at = F.instr(F.lower("content"), F.lower("term"))
    lo = F.greatest(at - reach, F.lit(1))
    hi = F.least(at + F.length("term") - 1 + reach, F.length("content"))
    cut = F.substring(F.col("content"), lo, hi - lo + 1)
    return first.select("file_key", "term", "para", F.concat(F.when(lo > 1, "...").otherwise(""), cut, F.when(hi < F.length("content"), "...").otherwise("")).alias("kwic"))


def suggestions(log: DataFrame, terms: DataFrame, min_seen: int = 3) -> DataFrame:
    """Unknown keywords of the query log seen often: kw, seen, zero, related canonicals (three)."""
    known = terms.select(F.lower("variant").alias("kw")).union(terms.select(F.lower("canonical"))).distinct()
    seen = log.filter("kw <> ''").join(F.broadcast(known), "kw", "left_anti").groupBy("kw").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("result_count") == 0).alias("zero")).filter(F.col("seen") >= min_seen)
    near = seen.select("kw").join(F.broadcast(terms.select("canonical", F.lower("variant").alias("v"))), F.contains("kw", F.col("v")) | F.contains("v", F.col("kw")))
    near = near.groupBy("kw").agg(F.array_join(F.slice(F.array_sort(F.collect_set("canonical")), 1, 3), "|").alias("related"))
    return seen.join(near, "kw", "left").select("kw", "seen", "zero", F.coalesce("related", F.lit("")).alias("related"))


def known_without_result(log: DataFrame, terms: DataFrame, n: int = 20) -> DataFrame:
    """Dictionary terms whose searches found nothing, most frequent first."""
    known = terms.select(F.lower("variant").alias("kw")).distinct()
    hits = log.filter("result_count = 0").join(F.broadcast(known), "kw", "left_semi")
    return hits.groupBy("kw").agg(F.count(F.lit(1)).alias("zero")).orderBy(F.desc("zero"), "kw").limit(n)


def short_term_hits(paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """Paragraphs with a term under three characters, which no trigram can find; literal."""
    short = terms.filter("length(term) < 3").select("term").distinct()
    return paragraphs.join(F.broadcast(short), matches(F.col("content"), F.col("term"))).select("term", "file_key", "para")
