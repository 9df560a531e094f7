"""Rule-based reading of paragraphs: labels, polarity, evidence, similarity, vocabularies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.grams import gram_hashes
from docloom.functions.text import matches

#: Up to so many nodes are broadcast with the words of their labels.
BROADCAST_NODES = 20_000
#: Hashes of up to so many grams are sent to the rows.
SENT_GRAMS = 4_000_000


def fitting_rules(text: Column, rules: list[tuple[Column, Column]]) -> Column:
    """Values of the rules (condition, value) whose condition holds, in their order.  Conditions
    are literal patterns, so each is compiled once; there is no join with the rules."""
    if not rules:
        return F.array()
    return F.array_compact(F.array(*[F.when(fits, value) for fits, value in rules]))


def multi_label(rows: DataFrame, text: str, rules: DataFrame, key: list[str]) -> DataFrame:
    """Every rule (ord, pattern, not_pattern, label) that a text fits, as labels in rule order.

    Rules are a parameter table; a null text fits none.
    """
    t = F.col(text)
    table = []
    for r in rules.orderBy("ord", "label").collect():
        fits = t.rlike(r["pattern"])
        table.append((fits & ~t.rlike(r["not_pattern"]) if r["not_pattern"] is not None else fits, F.lit(r["label"])))
    return rows.select(*key, F.array_join(F.array_distinct(fitting_rules(t, table)), "|").alias("labels"))


def defined_term(text: Column) -> Column:
    """Term of a definition: quoted before 'means', else in brackets after 'the'; no digits."""
    quoted = F.regexp_extract(text, "^[\"“]([^\"”]{1,60})[\"”]\\s+(?:means|shall mean)", 1)
    bracket = F.regexp_extract(text, "\\((?:the )?[\"“]([^\"”]{1,60})[\"”]\\)", 1)
    found = F.coalesce(F.nullif(F.trim(quoted), F.lit("")), F.nullif(F.trim(bracket), F.lit("")))
    return F.when(~found.rlike(r"\d"), found)


def polarity(text: Column, none_words: list[str], not_words: list[str]) -> Column:
    """none_exist before negative before affirmative."""
    low = F.lower(text)
    has = lambda words: low.rlike(r"(?U)\b(" + "|".join(words) + r")\b")
    return F.when(has(none_words), "none_exist").when(has(not_words), "negative").otherwise("affirmative")


def substantive(text: Column, least: int = 40) -> Column:
    """Long enough, with a sentence's end and more than a title's words."""
    return (F.length(text) >= least) & text.rlike(r"[.;]") & (F.regexp_count(text, F.lit(r"\S+")) >= 6)


def evidence_score(text: Column, anchors: list[tuple[str, int]], length_bonus: tuple[int, int], penalties: list[tuple[Column, int]]) -> Column:
    """Points of the anchors found, a bonus from a length on, less the penalties that apply."""
    score = F.when(F.length(text) >= length_bonus[0], length_bonus[1]).otherwise(0)
    for word, points in anchors:
        score = score + F.when(F.contains(F.lower(text), F.lit(word)), points).otherwise(0)
    for cond, points in penalties:
        score = score - F.when(cond, points).otherwise(0)
    return score


def first_family(text: Column, groups: list[tuple[str, list[str]]], linked: Column, default: str) -> Column:
    """First group with a word in the text, else the first group among the linked ones, else default."""
    low, by_text, by_link = F.lower(text), F.lit(None).cast("string"), F.lit(None).cast("string")
    for family, words in reversed(groups):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        by_text = F.when(hit, family).otherwise(by_text)
        by_link = F.when(F.array_contains(linked, family), family).otherwise(by_link)
    return F.coalesce(by_text, by_link, F.lit(default))


def tag_bucket(text: Column, keep: str, noise: Column, reclassify: str) -> Column:
    """keep before noise before reclassify before review."""
    low = F.lower(text)
    return F.when(low.rlike(keep), "keep").when(noise, "noise").when(low.rlike(reclassify), "reclassify").otherwise("review")


def shingle_coverage(quotes: DataFrame, docs: DataFrame, size: int = 12, step: int = 6) -> DataFrame:
    """Share of each quote's shingles that stand in a document: item_id, file_key, coverage.

    quotes: item_id, quote; docs: file_key, text.  Pairs without a common shingle, and quotes
    shorter than one, have no row.  Of a document's shingles only those of a quote leave its row.
    """
    q = F.col("quote")
    at = F.sequence(F.lit(1), F.greatest(F.length(q) - size + 1, F.lit(1)), F.lit(step))
    wanted = quotes.filter(F.length(q) >= size).select("item_id", F.size(at).alias("n"), F.posexplode(F.transform(at, lambda i: F.substring(q, i, size))).alias("i", "gram"))
    hits = sought_grams(docs, size, wanted.select("gram").distinct()).join(wanted, "gram").select("item_id", "n", "file_key", "i").distinct()
    return hits.groupBy("item_id", "file_key").agg((F.count(F.lit(1)) / F.first("n")).alias("coverage"))


def sought_grams(docs: DataFrame, size: int, grams: DataFrame, limit: int = SENT_GRAMS) -> DataFrame:
    """The strings of ``size`` characters of each document (file_key, text) whose hash is that of
    one of ``grams`` (gram): file_key, gram.  Rarely a string that only shares a hash is among
    them, so they are joined with the grams.  Beyond ``limit`` grams all strings are given.
    """
    if grams.limit(limit + 1).count() > limit:
        return text_grams(docs, size)

    def hashed(batches):
        for b in batches:
            keys = [int(gram_hashes(g, size)[0].view(np.int64)) for g in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    own = np.array([r["key"] for r in grams.select("gram").mapInArrow(hashed, "key long").distinct().collect()], np.int64).view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(own))
    top = np.uint64(42)

    def run(batches):
        wanted = sent.value
        seen = np.zeros(1 << 22, bool)
        seen[(wanted >> top).astype(np.int64)] = True
        for b in batches:
            texts, lo, row, found = [t or "" for t in b.column(1).to_pylist()], 0, [], []
            while lo < len(texts) and len(wanted):
                hi, used = lo + 1, len(texts[lo])
                while hi < len(texts) and used < 1 << 18:
                    used += len(texts[hi])
                    hi += 1
                text, ends = "".join(texts[lo:hi]), np.cumsum([len(t) for t in texts[lo:hi]])
                hashes = gram_hashes(text, size)
                at = np.flatnonzero(seen[(hashes >> top).astype(np.int64)])
                at = at[wanted[np.minimum(np.searchsorted(wanted, hashes[at]), len(wanted) - 1)] == hashes[at]]
                mine = np.searchsorted(ends, at, "right")
                inside = at + size <= ends[mine]
                for r, g in sorted({(r, text[a : a + size]) for r, a in zip(mine[inside].tolist(), at[inside].tolist(), strict=True)}):
                    row.append(lo + r)
                    found.append(g)
                lo = hi
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(found, pa.string())], names=["file_key", "gram"])

    return docs.select("file_key", "text").mapInArrow(run, "file_key string, gram string")


def text_grams(docs: DataFrame, size: int, piece: int = 256) -> DataFrame:
    """Every string of ``size`` characters of each document (file_key, text), once per piece.
    It is cut from short pieces, as finding a place in a long text takes time in proportion to
    the place."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(piece - size + 1))
    pieces = docs.select("file_key", F.explode(F.transform(starts, lambda i: F.substring(F.col("text"), i, piece))).alias("piece")).filter(F.length("piece") >= size)
    places = F.sequence(F.lit(1), F.length("piece") - size + 1)
    return pieces.select("file_key", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("piece"), i, size)))).alias("gram"))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ranges of one document that share a paragraph.  a: a_ref, a_lo, a_hi; b likewise."""
    return a.join(b, "file_key").filter("a_lo <= b_hi and b_lo <= a_hi")


def overlapping_items(items: DataFrame) -> DataFrame:
    """Pairs (structs i, j; i of the lesser item_ref) of a document's items of one family whose
    ranges share a paragraph.  Of two such ranges the later start lies in the other, so this is
    an equi-join on a paragraph and gives each pair once."""
    row = F.struct("item_ref", "taxonomy_id", "verbatim", "loc_start", "loc_end")
    x = items.select("file_key", "family", row.alias("x"), F.explode(F.sequence("loc_start", F.greatest("loc_start", "loc_end"))).alias("at"))
    y = items.select("file_key", "family", row.alias("y"), F.col("loc_start").alias("at"))
    pairs = x.join(y, ["file_key", "family", "at"]).filter("x.loc_start < at or x.item_ref < y.item_ref").filter("x.item_ref <> y.item_ref and y.loc_start <= y.loc_end and x.loc_start <= x.loc_end")
    first = F.col("x.item_ref") < F.col("y.item_ref")
    return pairs.select("file_key", "family", F.when(first, F.col("x")).otherwise(F.col("y")).alias("i"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("j"))


def duplicate_quotes(items: DataFrame, least: int = 8, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a document's items of one family: same text and node with overlapping ranges, or
    one text inside the other (``least`` characters or more) with overlapping ranges."""
    same = F.expr("i.verbatim = j.verbatim and i.taxonomy_id = j.taxonomy_id")
    inside = F.expr(f"i.verbatim <> j.verbatim and length(i.verbatim) >= {least} and length(j.verbatim) >= {least} and (contains(i.verbatim, j.verbatim) or contains(j.verbatim, i.verbatim))")
    pairs = overlapping_items(items).filter(same | inside)
    return pairs.select("file_key", *also, F.col("i.item_ref").alias("a_ref"), F.col("j.item_ref").alias("b_ref"), F.when(same, "duplicate").otherwise("contained").alias("code"))


def range_jaccard(items: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of different quotes of a document and family whose paragraph ranges have a Jaccard
    index of ``least`` (above 0) or more."""
    both = F.least(F.col("i.loc_end"), F.col("j.loc_end")) - F.greatest(F.col("i.loc_start"), F.col("j.loc_start")) + 1
    either = F.greatest(F.col("i.loc_end"), F.col("j.loc_end")) - F.least(F.col("i.loc_start"), F.col("j.loc_start")) + 1
    pairs = overlapping_items(items).filter(F.expr("i.verbatim <> j.verbatim") & (both / either >= least))
    return pairs.select("file_key", F.col("i.item_ref").alias("a_ref"), F.col("j.item_ref").alias("b_ref"), F.bround(both / either, 4).alias("jaccard"))


def nearest_node(rows: DataFrame, text: str, key: list[str], nodes: DataFrame) -> DataFrame:
    """Node of the row's family whose label shares most words (Jaccard); ties to the largest id.

    Rows meet only labels that share a word with them; a row that shares none gets its family's
    largest id with score 0, and one whose family has no nodes has no result.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    columns = list(dict.fromkeys([*key, "family"]))
    label = nodes.select("taxonomy_id", "family", words(F.col("label")).alias("_l"))
    inverted = label.select("taxonomy_id", "family", F.size("_l").alias("_size"), F.explode("_l").alias("_word"))
    if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        inverted = F.broadcast(inverted)
    found = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))
    # a row's words meet the labels where they stand; what is left carries two hashes of the text
    base = rows.select(*columns, found.alias("_w")).withColumns({"_n": F.size("_w"), "_k": F.xxhash64("_w"), "_k2": F.hash("_w")})
    met = base.select(*columns, "_n", "_k", "_k2", F.explode("_w").alias("_word")).join(inverted, ["family", "_word"])
    met = met.groupBy(*columns, "_n", "_k", "_k2", "taxonomy_id", "_size").agg(F.size(F.collect_set("_word")).alias("_both"))
    score = F.col("_both") / (F.col("_n") + F.col("_size") - F.col("_both"))
    last = rows.select(*columns).join(F.broadcast(nodes.groupBy("family").agg(F.max("taxonomy_id").alias("taxonomy_id"))), "family")
    every = met.select(*key, score.alias("score"), "taxonomy_id").unionByName(last.select(*key, F.lit(0.0).alias("score"), "taxonomy_id"))
    return every.groupBy(*key).agg(F.max(F.struct("score", "taxonomy_id")).alias("b")).select(*key, "b.taxonomy_id", F.bround("b.score", 4).alias("score"))


def alias_matches(paragraphs: DataFrame, aliases: DataFrame, top: int = 6) -> DataFrame:
    """Aliases that stand in each paragraph, scored by their length without blanks; kept from
    max(4, min(best, 8)) on, the best ``top``."""
    from docloom.operators.patterns import pattern_hits

    size = F.length(F.regexp_replace("alias", r"\s+", ""))
    found = pattern_hits(paragraphs.select("file_key", "para", "content"), aliases.select(F.col("alias").alias("needle"), F.lit(False).alias("bounded")))
    hit = found.join(aliases.withColumn("needle", F.lower("alias")), "needle").withColumn("score", size)
    w = W.partitionBy("file_key", "para")
    hit = hit.withColumn("_least", F.greatest(F.lit(4), F.least(F.max("score").over(w), F.lit(8)))).filter("score >= _least")
    ranked = hit.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "taxonomy_id", "alias")))
    return ranked.filter(F.col("place") <= top).select("file_key", "para", "taxonomy_id", "alias", "score", "place")


def number_supported(value: Column, evidence: Column) -> Column:
    """The number stands in the evidence as it is, as years of its months, or in units of 10**8
    or 10**4, once separators, blanks and brackets are gone."""
    plain = F.regexp_replace(evidence, r"[,\s\[\]()]", "")
    forms = F.array(value.cast("string"), F.when(value % 12 == 0, F.concat((value / 12).cast("long").cast("string"), F.lit("year"))), F.when(value % 100000000 == 0, F.concat((value / 100000000).cast("long").cast("string"), F.lit("억"))), F.when(value % 10000 == 0, F.concat((value / 10000).cast("long").cast("string"), F.lit("만"))))
    return F.exists(F.array_compact(forms), lambda f: F.contains(plain, f))


def whole_documents(paragraphs: DataFrame) -> DataFrame:
    """Folded text of each document: its paragraphs in order, blank between."""
    parts = F.array_sort(F.collect_list(F.struct("para", "content")))
    return paragraphs.groupBy("file_key").agg(F.lower(F.array_join(F.transform(parts, lambda x: x["content"]), " ")).alias("folded"))


def vocabulary(concepts: DataFrame, terms: DataFrame, nodes: DataFrame, stop: list[str], least: int = 4, supplements: DataFrame | None = None) -> DataFrame:
    """Words that speak for a sub-domain: sub, needle, bounded.

    They come from the variants of the concepts mapped to a node at or below it, from the node
    labels, and from ``supplements`` (taxonomy_id, term).  Latin terms are cut into words that
    count only between word bounds, other scripts count as substrings; short Latin words and
    stop words go.  concepts: canonical, taxonomy_id.
    """
    from docloom.functions.text import subdomain
    from docloom.operators.patterns import script_needles

    words = concepts.join(terms, "canonical").select("taxonomy_id", F.col("variant").alias("term")).union(nodes.select("taxonomy_id", "label"))
    if supplements is not None:
        words = words.union(supplements.select("taxonomy_id", "term"))
    return script_needles(words.select(subdomain(F.col("taxonomy_id")).alias("sub"), "term"), stop, least)


def absence_suspects(paragraphs: DataFrame, items: DataFrame, words: DataFrame) -> DataFrame:
    """Sub-domains that a document mentions without an item: file_key, sub, n_words, first_para.
    words: sub, needle, bounded."""
    from docloom.functions.text import subdomain
    from docloom.operators.patterns import pattern_hits

    hit = pattern_hits(paragraphs.select("file_key", "para", "content"), words).join(words, ["needle", "bounded"])
    seen = hit.groupBy("file_key", "sub").agg(F.count_distinct("needle").alias("n_words"), F.min("para").alias("first_para"))
    covered = items.select("file_key", subdomain(F.col("taxonomy_id")).alias("sub")).distinct()
    return seen.join(covered, ["file_key", "sub"], "left_anti")


def absence_sweep(suspects: DataFrame, items: DataFrame, files: DataFrame, words: DataFrame, broad: float = 0.85, n: int = 50) -> DataFrame:
    """Per sub-domain: documents without an item (pool), suspects among them, their share, whether
    the words are too broad, and the first suspects."""
    from docloom.functions.text import subdomain

    docs = files.filter("status = 'ok'").agg(F.count(F.lit(1)).alias("docs"))
    covered = items.select("file_key", subdomain(F.col("taxonomy_id")).alias("sub")).distinct().groupBy("sub").agg(F.count(F.lit(1)).alias("covered"))
    found = suspects.groupBy("sub").agg(F.count(F.lit(1)).alias("suspects"))
    shown = suspects.withColumn("_r", F.row_number().over(W.partitionBy("sub").orderBy("file_key"))).filter(F.col("_r") <= n).groupBy("sub").agg(F.array_join(F.array_sort(F.collect_list("file_key")), "|").alias("first"))
    out = words.select("sub").distinct().join(covered, "sub", "left").join(found, "sub", "left").join(shown, "sub", "left").crossJoin(F.broadcast(docs))
    pool = F.col("docs") - F.coalesce("covered", F.lit(0))
    k = F.coalesce("suspects", F.lit(0))
    return out.select("sub", pool.alias("pool"), k.alias("suspects"), F.when(pool > 0, F.bround(k / pool, 4)).alias("rate"), F.coalesce(k / pool >= broad, F.lit(False)).alias("too_broad"), F.coalesce("first", F.lit("")).alias("first"))


def concept_evidence(paragraphs: DataFrame, concepts: DataFrame, examples: int = 5) -> DataFrame:
    """Per concept (concept, pattern): documents with it and the first examples, each document's
    first matching paragraph; a literal in the pattern (column literal) is tried first."""
    low = F.lower("content")
    table = [(F.contains(low, F.lit(r["literal"])) & low.rlike(r["pattern"]), F.lit(r["concept"])) for r in concepts.collect()]  # a parameter table
    hit = paragraphs.select("file_key", "para", F.explode(fitting_rules(low, table)).alias("concept"))
    first = hit.groupBy("concept", "file_key").agg(F.min("para").alias("para"))
    ranked = first.withColumn("_r", F.row_number().over(W.partitionBy("concept").orderBy("file_key")))
    docs = first.groupBy("concept").agg(F.count(F.lit(1)).alias("documents"))
    shown = ranked.filter(F.col("_r") <= examples).groupBy("concept").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("#", "file_key", F.col("para").cast("string")))), "|").alias("examples"))
    return docs.join(shown, "concept")
