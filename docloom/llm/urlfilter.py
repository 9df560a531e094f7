"""URL filter: rules first, then naive Bayes over segmented host and path tokens.

Host labels are written without spaces.  A unigram model of words (counted in the pages' own
text) splits each label by Viterbi search into its most probable words.  The words of hosts
and the tokens of paths are the features of a multinomial naive Bayes classifier, trained on
the urls that the rules decide; it decides the rest.

The work is done once per different label, host and normalised path.  A label is joined only
with those words that are its own substrings, so no lexicon is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytevec import LOWER, as_bytes, byte_table, prefix_sums, runs, span_hashes, word_bounds
from .common import lookup, stored

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Longest word that a label is split into.
WORD = 24
#: Places of a label whose pieces are listed at a time.
START = 4096
ALPHA = 1.0
LETTERS = byte_table(bytes([*range(0x61), *range(0x7B, 0x100)]))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, UPPER, UPPER.lower()), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)


def ruled(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null.  The list of rules is a
    parameter, so its size is the caller's."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        this = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits = F.when(this, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def word_counts(pages: DataFrame, text: str) -> DataFrame:
    """(word, c) of runs of the letters a-z in the lower-cased text."""

    def count(batches):
        for batch in batches:
            buf, offsets = as_bytes(batch.column("t"))
            for lo, hi in runs(offsets):
                low = LOWER[buf[offsets[lo] : offsets[hi]]]
                starts, ends, _ = word_bounds(low, offsets[lo : hi + 1] - offsets[lo], LETTERS)
                short = ends - starts <= WORD
                starts, ends = starts[short], ends[short]
                _, at, n = np.unique(span_hashes(prefix_sums(low), starts, ends), return_index=True, return_counts=True)
                data = low.tobytes()
                words = [data[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "c": n.astype(np.int64)})

    return pages.select(F.col(text).alias("t")).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """Most probable split.  An unseen piece of n letters has probability 10 / (total * 10**n)."""
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - WORD), end):
            piece = label[start:end]
            c = counts.get(piece)
            p = math.log(c / total) if c else math.log(10 / max(total, 1)) - len(piece) * math.log(10)
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    out, end = [], len(label)
    while end:
        out.append(label[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(labels: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(label, words) for each different label."""

    def pieces(batches):
        for batch in batches:
            for key, label in zip(batch.column("key"), batch.column("label").to_pylist(), strict=True):
                n = len(label)
                for lo in range(0, n, START):
                    some = {label[i:j] for i in range(lo, min(lo + START, n)) for j in range(i + 1, min(i + WORD, n) + 1)}
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(some), pa.binary()), pa.array(sorted(some), pa.string())], names=["key", "word"])

    # rows of pieces carry the label's hash, as there are up to 24 for each of its letters
    labels = labels.withColumn("key", F.unhex(F.md5("label")))
    found = labels.filter("label <> ''").select("key", "label").mapInArrow(pieces, "key binary, word string").distinct().join(words, "word")
    found = found.groupBy("key").agg(F.collect_list("word").alias("ws"), F.collect_list("c").alias("cs"))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.Series:
        return pd.Series([viterbi(l, dict(zip(w, c, strict=True)) if w is not None else {}, total) for l, w, c in zip(label, ws, cs, strict=True)])

    return labels.join(found, "key", "left").select("label", F.when(F.col("label") == "", F.array().cast("array<string>")).otherwise(split("label", "ws", "cs")).alias("words"))


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url", id_col: str = "page_id", text: str = "html") -> DataFrame:
    """id_col, host, path, rule, verdict and score (log odds for block; null where a rule decides).

    Defined cases: a null url or one without '://' has empty host and path and is decided by the
    classifier's prior; score 0 and an untrained classifier (no ruled urls of both verdicts)
    mean allow; repeated rows are judged alike; an empty table gives an empty one; further
    columns are ignored.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    shape = F.regexp_replace(F.lower("path"), r"\d+", "0")  # all numbers are one token
    rows = rows.withColumn("fit", ruled(F.col("host"), F.col("path"), rules)).withColumn("shape", shape)
    # a long host or path has many tokens, so their rows carry its hash
    rows = rows.withColumns({"hid": F.unhex(F.md5("host")), "sid": F.unhex(F.md5("shape"))})
    rows = stored(rows.select("_id", "host", "path", "shape", "hid", "sid", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruling")), "url-rows")
    block, allow = F.count_if(F.col("ruling") == "block"), F.count_if(F.col("ruling") == "allow")
    hosts = stored(rows.groupBy("hid", "host").agg(F.count(F.lit(1)).alias("n"), block.alias("b"), allow.alias("a")), "url-hosts")
    shapes = stored(rows.groupBy("sid", "shape").agg(F.count(F.lit(1)).alias("n"), block.alias("b"), allow.alias("a")), "url-shapes")
    words = stored(word_counts(pages, text), "url-words")
    total = words.agg(F.sum("c")).first()[0] or 0
    parts = hosts.select("hid", "n", "b", "a", F.explode(F.split("host", r"[^a-z]+")).alias("label"))
    splits = stored(segmented(parts.select("label").distinct(), words, total), "url-splits")
    by_label = stored(parts.groupBy("label").agg(F.count(F.lit(1)).alias("k")).join(splits, "label"), "url-labels")
    of_host = lookup(parts, by_label, "label", "k").select("hid", "n", "b", "a", F.explode("words").alias("token"))
    of_shape = shapes.select("sid", "n", "b", "a", F.explode(F.filter(F.split("shape", r"[^0-9a-z\x{80}-\x{10FFFF}]+"), lambda t: t != "")).alias("token"))
    of_host, of_shape = stored(of_host.withColumn("token", F.concat(F.lit("h:"), "token")), "url-host-tokens"), stored(of_shape.withColumn("token", F.concat(F.lit("p:"), "token")), "url-path-tokens")
    counts = of_host.select("token", "b", "a").union(of_shape.select("token", "b", "a")).groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("k"))
    counts = stored(counts, "url-counts")
    v, tb, ta = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    pb, pa_ = hosts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    trained = pb > 0 and pa_ > 0
    prior = math.log(pb / pa_) if trained else 0.0
    odds = F.log((F.col("b") + ALPHA) / F.lit(tb + ALPHA * v)) - F.log((F.col("a") + ALPHA) / F.lit(ta + ALPHA * v))
    table = stored(counts.select("token", "k", (odds if trained else F.lit(0.0)).alias("odds")), "url-odds")

    def scores(tokens: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
        sums = lookup(tokens.select(key, "token"), table, "token", "k").groupBy(key).agg(F.sum("odds").alias(name))
        return stored(keys.select(key, "n").join(sums, key, "left").select(key, "n", F.coalesce(name, F.lit(0.0)).alias(name)), f"url-{name}")

    out = lookup(rows, scores(of_host, hosts, "hid", "host_score"), "hid", "n")
    out = lookup(out, scores(of_shape, shapes, "sid", "path_score"), "sid", "n")
    score = F.round(F.lit(prior) + F.col("host_score") + F.col("path_score"), 9)
    verdict = F.coalesce("ruling", F.when(score > 0, "block").otherwise("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("ruling").isNull(), score).alias("score"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
