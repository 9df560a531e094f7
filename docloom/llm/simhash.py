"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in at most RADIUS bits are linked.  Equal fingerprints are one class,
so only different ones are compared.  Cutting 64 bits into ``m`` blocks, linked fingerprints
agree in some m - RADIUS blocks whole (pigeonhole); the fingerprints that agree there form a
tile.  Inside a tile numpy compares by exclusive-or and bit count, all against all, so no link
is lost.  A tile of more than TILE fingerprints is cut into chunks by population count; pairs
of chunks are compared in tasks of their own, and a pair whose population counts differ beyond
the radius is skipped.  A tile emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytevec import BLANK_WORDS, LOWER, counts_per_doc, mix, prefix_sums, span_hashes, word_bounds
from .common import components, lookup, stored, with_text_columns

RADIUS = 4
SHINGLE = 4
SEED = 42
#: The second criterion, for whole documents: shingles of so many words, band keys of a text,
#: and least hashes of a key.
BAND_WORDS, BANDS, ROWS = 5, 20, 9
MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Fingerprints in a chunk of a tile.
TILE = 4096

#: The bits of a byte as the eight bytes of a long.
LANES = np.zeros(256, dtype=np.uint64)
for _i in range(8):
    LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_i)) & np.uint64(1)) << np.uint64(8 * _i)


def majority_bits(hashes: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Per document the bits set in over half of its hashes; docs is ascending."""
    out = np.zeros(n, np.uint64)
    if not len(hashes):
        return out
    at = np.arange(len(docs))
    new = np.append(True, docs[1:] != docs[:-1])
    first = np.maximum.accumulate(np.where(new, at, 0))
    cut = np.flatnonzero((at - first) % 255 == 0)  # sums of up to 255 ones fit a byte
    seg_doc = docs[cut]
    doc_first = np.flatnonzero(np.append(True, seg_doc[1:] != seg_doc[:-1]))
    which = seg_doc[doc_first]
    half = counts_per_doc(docs, n)[which]
    for j in range(8):
        sums = np.add.reduceat(LANES[((hashes >> np.uint64(8 * j)) & np.uint64(255)).astype(np.intp)], cut)
        lanes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), doc_first, axis=0)
        for i in range(8):
            out[which] |= (2 * lanes[:, i] > half).astype(np.uint64) << np.uint64(8 * j + i)
    return out


def fingerprints(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each text of a run: XXH64 of word shingles, majority of each bit."""
    n = len(offsets) - 1
    buf = LOWER[buf]
    starts, ends, docs = word_bounds(buf, offsets, BLANK_WORDS)
    if not len(starts):
        return np.zeros(n, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    word = np.repeat(np.arange(len(lens)), lens)
    before = np.cumsum(lens) - lens
    spaced = np.full(total + len(lens), 0x20, np.uint8)
    spaced[np.arange(total) + word] = buf[starts[word] + np.arange(total) - before[word]]
    new_start = before + np.arange(len(lens))
    new_end = new_start + lens
    n_words = counts_per_doc(docs, n)
    end_word = np.cumsum(n_words)[docs]  # one past the document's last word
    at = np.arange(len(docs))
    full = at + SHINGLE <= end_word
    short = (n_words[docs] < SHINGLE) & np.append(True, docs[1:] != docs[:-1])
    pick = np.flatnonzero(full | short)
    last = np.where(full[pick], pick + SHINGLE - 1, end_word[pick] - 1)
    data, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[s:e], SEED) for s, e in zip(new_start[pick].tolist(), new_end[last].tolist(), strict=True)), np.uint64, len(pick))
    return majority_bits(hashes, docs[pick], n)


def bands(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of each text of a run, and where each text's begin: BANDS keys, each of ROWS
    least hashes of its five-word shingles (of the whole sequence if it has fewer words), none
    for a text without words.  Texts of Jaccard index s share a key with probability
    1 - (1 - s**ROWS)**BANDS: 0.94 at 0.8, 0.99 at 0.85, 0.04 at 0.5."""
    n = len(offsets) - 1
    starts, ends, docs = word_bounds(LOWER[buf], offsets, BLANK_WORDS)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    # a shingle's hash from its words' hashes, so that blanks between words do not count
    word = span_hashes(prefix_sums(LOWER[buf]), starts, ends)
    n_words = counts_per_doc(docs, n)
    end_word = np.cumsum(n_words)[docs]
    at = np.arange(len(docs))
    short = (n_words[docs] < BAND_WORDS) & np.append(True, docs[1:] != docs[:-1])
    pick = np.flatnonzero((at + BAND_WORDS <= end_word) | short)
    size = np.minimum(BAND_WORDS, end_word[pick] - pick)
    h = np.zeros(len(pick), np.uint64)
    for i in range(BAND_WORDS):
        inside = size > i
        h[inside] = mix(h[inside] ^ (word[pick[inside] + i] + np.uint64(i + 1)))
    own = docs[pick]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    keys = np.zeros((len(first), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(first), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key ^ np.minimum.reduceat(h * MULTIPLIERS[b * ROWS + r], first))
        keys[:, b] = key
    counts = np.zeros(n, np.int64)
    counts[own[first]] = BANDS
    return keys.ravel().view(np.int64), np.concatenate([[0], np.cumsum(counts)])


def with_bands(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with fp (the SimHash) and bands (keys of the second criterion)."""

    def compute(buf, offsets):
        keys, begin = bands(buf, offsets)
        return [pa.array(fingerprints(buf, offsets).view(np.int64)), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(keys))]

    return with_text_columns(docs, text, keep, "fp long, bands array<long>", compute)


def band_links(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints that connect all rows (fp, bands) with a common
    band key: each key's rows are tied to its least fingerprint."""
    keyed = rows.select("fp", F.explode("bands").alias("key")).distinct()
    least = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = lookup(stored(keyed, "band-keys"), stored(least, "band-least"), "key", "k")
    return met.filter("a is not null and a <> fp").select("a", F.col("fp").alias("b")).distinct()


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    def compute(buf, offsets):
        return [pa.array(fingerprints(buf, offsets).view(np.int64))]

    return with_text_columns(docs, text, docs.columns if keep is None else keep, f"{name} long", compute)


def block_keys(fp: Column, n: int) -> list[Column]:
    """The pigeonhole keys; more and smaller tiles for more fingerprints, exact for any."""
    m = 5 if n <= 1 << 22 else 6 if n <= 1 << 30 else 8
    edges = [round(64 * i / m) for i in range(m + 1)]
    parts = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1) for i in range(m)]
    return [F.xxhash64(F.lit(k), *[parts[i] for i in chosen]) for k, chosen in enumerate(combinations(range(m), m - RADIUS))]


def forest(a: np.ndarray, side: np.ndarray | None, radius: int = RADIUS) -> tuple[list, list]:
    """Spanning forest of the links in a tile, as index pairs.  With ``side`` only rows of
    different sides are compared."""
    left, right = [], []
    groups = [np.arange(len(a))] if side is None else [np.flatnonzero(~side), np.flatnonzero(side)]
    if len(a) <= 64 and side is None:
        near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
        if near.sum() == len(a):
            return left, right
    queue: list[tuple[int, int]] = []
    while True:
        if not queue:
            if side is None:
                if len(groups[0]) < 2:
                    return left, right
                queue.append((int(groups[0][0]), 0))
                groups[0] = groups[0][1:]
            else:
                if not len(groups[0]) or not len(groups[1]):
                    return left, right
                queue.append((int(groups[0][0]), 0))
                groups[0] = groups[0][1:]
        node, s = queue.pop()
        other = 0 if side is None else 1 - s
        rest = groups[other]
        if not len(rest):
            continue
        near = np.bitwise_count(a[rest] ^ a[node]) <= radius
        if near.any():
            found = rest[near]
            groups[other] = rest[~near]
            left += [node] * len(found)
            right += found.tolist()
            queue += [(x, other) for x in found.tolist()]


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    fps = pdf["fp"].to_numpy().astype(np.int64).view(np.uint64)
    tile = pdf["tile"].to_numpy()
    by = np.argsort(tile, kind="stable")
    cuts = np.flatnonzero(np.append(True, tile[by][1:] != tile[by][:-1]))
    x, y = [], []
    two = pdf["side"].to_numpy()
    for rows in np.split(by, cuts[1:]):
        if len(rows) > 1:
            a = fps[rows]
            mixed = two[rows[0]] >= 0
            l, r = forest(a, two[rows] == 1 if mixed else None)
            if l:
                x.append(a[l])
                y.append(a[r])
    empty = np.zeros(0, np.uint64)
    return pd.DataFrame({"a": np.concatenate(x or [empty]).view(np.int64), "b": np.concatenate(y or [empty]).view(np.int64)})


def links(fps: DataFrame, n: int, tile: int = TILE, rows_per_task: int = 1 << 15) -> DataFrame:
    """Pairs (a, b) of different fingerprints within the radius, enough to connect all that
    are linked.  ``fps``: a stored table of ``n`` different fingerprints, column fp."""
    keyed = fps.select("fp", F.explode(F.array(*block_keys(F.col("fp"), n))).alias("key"), F.bit_count("fp").alias("ones"))
    hist = keyed.groupBy("key", "ones").agg(F.count(F.lit(1)).alias("k"))
    big = hist.groupBy("key").agg(F.sum("k").alias("size")).filter(F.col("size") > tile)
    big = stored(big, "simhash-big")
    order = W.partitionBy("key").orderBy("ones")  # at most 65 rows a key
    chunks = hist.join(big, "key").withColumn("upto", F.sum("k").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # a population count that overflows a chunk is split by hash into as many chunks as it needs
    chunks = chunks.withColumn("lo", F.floor((F.col("upto") - F.col("k")) / tile).cast("int")).withColumn("hi", F.floor((F.col("upto") - 1) / tile).cast("int"))
    chunks = stored(chunks.select("key", "ones", "lo", "hi", "size", "k"), "simhash-chunks")
    spans = chunks.select("key", "ones", F.explode(F.sequence("lo", "hi")).alias("chunk")).groupBy("key", "chunk").agg(F.min("ones").alias("least"), F.max("ones").alias("most"))
    spans = stored(spans, "simhash-spans")
    i, j = spans.alias("i"), spans.alias("j")
    near = (F.col("i.chunk") <= F.col("j.chunk")) & (F.col("j.least") - F.col("i.most") <= RADIUS) & (F.col("i.least") - F.col("j.most") <= RADIUS)
    pairs = i.join(j, F.expr("i.key = j.key") & near).select(F.col("i.key").alias("key"), F.col("i.chunk").alias("ci"), F.col("j.chunk").alias("cj"))
    meet = pairs.select("key", F.col("ci").alias("chunk"), F.struct("ci", "cj", F.when(F.col("ci") == F.col("cj"), -1).otherwise(0).alias("side")).alias("p")).union(
        pairs.filter("ci <> cj").select("key", "cj", F.struct("ci", "cj", F.lit(1).alias("side")))
    )
    meet = stored(meet.groupBy("key", "chunk").agg(F.collect_list("p").alias("pairs")), "simhash-meet")
    # fewer than 5 n / tile keys are big; their rows find their chunks by a join that can be split
    weight = chunks.groupBy("key").agg(F.max("size").alias("size"), F.collect_list(F.struct("ones", "lo", "hi")).alias("cuts"))
    known = lookup(keyed, stored(weight, "simhash-weights"), "key", "size")
    single = known.filter("cuts is null").select("fp", F.col("key").alias("tile"), F.lit(-1).alias("side"))
    cut = F.filter("cuts", lambda c: c["ones"] == F.col("ones"))[0]
    large = known.filter("cuts is not null").withColumn("cut", cut).withColumn("chunk", F.col("cut.lo") + F.pmod(F.xxhash64("fp"), F.col("cut.hi") - F.col("cut.lo") + 1).cast("int"))
    large = large.withColumn("place", F.xxhash64("key", "chunk"))
    meet = meet.select(F.xxhash64("key", "chunk").alias("place"), "pairs", F.lit(tile).alias("rows"))
    large = lookup(large, meet, "place", "rows").withColumn("p", F.explode("pairs"))
    large = large.select("fp", F.xxhash64("key", "p.ci", "p.cj").alias("tile"), F.col("p.side").alias("side"))
    spark = fps.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + 5 * n // rows_per_task)
    return single.union(large).withColumn("task", F.pmod(F.xxhash64("tile", F.lit(1)), F.lit(4 * tasks))).groupBy("task").applyInPandas(_compare, "a long, b long")


def near_duplicates(rows: DataFrame, id_col: str = "doc_id", fp: str = "fp", more: DataFrame | None = None) -> DataFrame:
    """component_id for each row of ``rows`` (id_col, fp; a stored table): the smallest id of its
    component, and root, its smallest fingerprint, which alone tells components apart.  Rows
    with a null id take part; a component without any id gets null.  ``more``: further links
    (a, b) between fingerprints."""
    fps = stored(rows.groupBy(fp).agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n")).withColumnRenamed(fp, "fp"), "simhash-fps")
    n = fps.count()
    near = links(fps, n)
    roots = components(near if more is None else near.unionByName(more), "simhash-cc")
    classes = stored(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-classes")
    lows = stored(classes.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("k")), "simhash-lows")
    named = stored(lookup(classes, lows, "root", "k").select("fp", "component_id", "root", "n"), "simhash-named")
    return lookup(rows.withColumnRenamed(fp, "fp"), named, "fp", "n").withColumnRenamed("fp", fp)


def simhash_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, fp (64-bit SimHash as a long) and component_id for every row.

    Defined cases: null and empty texts have fingerprint zero and link like any other; texts of
    fewer than four words are one shingle; repeated rows and ids are kept; an empty table gives
    an empty one; further columns are ignored.
    """
    rows = stored(with_fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")), "_t", ["_id"]), "simhash-rows")
    return near_duplicates(rows, "_id").select(F.col("_id").alias(id_col), "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
