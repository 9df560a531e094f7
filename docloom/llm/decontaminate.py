"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item (the whole item if it is shorter).  Its
tokens are its five-word shingles (the window itself below five words).  A document contains
the window only if it contains all of its tokens, so with the tokens ordered by rarity the
necessary prefix is a single token, the rarest.  The documents' shingles are matched against
these prefix tokens; position and length bounds say where the window would have to stand, and
the words there are compared one by one with the window's (as normalised text).

Rarity is counted over all documents.  The benchmark side of the join is broadcast in blocks
of at most BLOCK_WINDOWS windows, whose size is therefore bounded; all documents meet every
block, and a document's hits travel along as a column, so no document is shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytevec import ALNUM_WORDS, LOWER, as_bytes, counts_per_doc, mix, prefix_sums, runs, span_hashes, word_bounds
from .common import sheltered, stored, with_text_columns

WINDOW = 10
SHINGLE = 5
#: Windows in one broadcast block.
BLOCK_WINDOWS = 200_000
BITS = 20
FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def tokenise(buf: np.ndarray, offsets: np.ndarray):
    low = LOWER[buf]
    starts, ends, docs = word_bounds(low, offsets, ALNUM_WORDS)
    return low, starts, ends, docs, span_hashes(prefix_sums(low), starts, ends)


def shingle_hashes(words: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``size`` consecutive words of one document, and their hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(docs[:n] == docs[size - 1 :])
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
    return at, mix(h)


class Members:
    """Membership of 64-bit hashes in a sorted array, with a bitmap before the search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bitmap = np.zeros(1 << BITS, dtype=bool)
        self.bitmap[(self.values >> np.uint64(64 - BITS)).astype(np.intp)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the members among ``hashes``, and their ranks in ``values``."""
        maybe = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - BITS)).astype(np.intp)])
        if not len(maybe) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = np.minimum(np.searchsorted(self.values, hashes[maybe]), len(self.values) - 1)
        sure = self.values[rank] == hashes[maybe]
        return maybe[sure], rank[sure]


def item_windows(items: DataFrame, text: str, id_col: str, window: int) -> DataFrame:
    """One row per window and item: words (normalised, space-joined), size, tokens (hashes)."""

    def run(batches):
        for batch in batches:
            buf, offsets = as_bytes(batch.column("t"))
            low, starts, ends, docs, hashes = tokenise(buf, offsets)
            data = low.tobytes()
            ids = batch.column("id").to_pylist()
            rows = defaultdict(list)
            first = np.searchsorted(docs, np.arange(len(ids) + 1))
            for d in range(len(ids)):
                lo, hi = int(first[d]), int(first[d + 1])
                size = min(window, hi - lo)
                for i in range(lo, hi - size + 1 if size else lo):
                    rows["id"].append(ids[d])
                    rows["words"].append(b" ".join(data[starts[j] : ends[j]] for j in range(i, i + size)).decode("utf-8", "replace"))
                    rows["size"].append(size)
                    k = min(SHINGLE, size)
                    _, tokens = shingle_hashes(hashes[i : i + size], docs[i : i + size], k)
                    rows["tokens"].append(tokens.view(np.int64).tolist())
            if rows:
                yield pa.RecordBatch.from_pydict({k: pa.array(rows[k], t) for k, t in (("id", pa.string()), ("words", pa.string()), ("size", pa.int32()), ("tokens", pa.list_(pa.int64())))})

    return items.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id string, words string, size int, tokens array<long>")


def _frequencies(docs: DataFrame, text: str, tokens: list[tuple[int, int]], spark: SparkSession) -> DataFrame:
    """(token, df): in how many places the documents have each token; tokens: (hash, size)."""
    by_size = defaultdict(list)
    for token, size in tokens:
        by_size[size].append(token)
    known = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in by_size.items()})

    def run(batches):
        members = {k: Members(v) for k, v in known.value.items()}
        totals = {k: np.zeros(len(m.values), np.int64) for k, m in members.items()}
        for batch in batches:
            buf, offsets = as_bytes(batch.column("t"))
            for lo, hi in runs(offsets):
                _, _, _, docs_, words = tokenise(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for k, m in members.items():
                    _, h = shingle_hashes(words, docs_, k)
                    _, rank = m.find(h)
                    totals[k] += np.bincount(rank, minlength=len(m.values))
        for k, m in members.items():
            yield pa.RecordBatch.from_pydict({"token": m.values.view(np.int64), "df": totals[k]})

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


def _hits(buf: np.ndarray, offsets: np.ndarray, index) -> list[pa.Array]:
    """Hit spans and items of each document of a run, as lists of longs and strings."""
    n = len(offsets) - 1
    low, starts, ends, docs, words = tokenise(buf, offsets)
    first = np.searchsorted(docs, np.arange(n + 1))
    data = None
    spans: list[list[int]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    for size, (members, places) in index["prefix"].items():
        at, h = shingle_hashes(words, docs, size)
        found, rank = members.find(h)
        for pos, r in zip(at[found].tolist(), rank.tolist(), strict=True):
            d = int(docs[pos])
            for offset, length in places[r]:
                start = pos - offset
                if start < first[d] or start + length > first[d + 1]:
                    continue  # the window would not lie inside the document
                data = low.tobytes() if data is None else data
                text = b" ".join(data[starts[j] : ends[j]] for j in range(start, start + length))
                owners = index["windows"].get(text)
                if owners:
                    spans[d] += [start - int(first[d]), start - int(first[d]) + length]
                    items[d].update(owners)
    return [pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(counts_per_doc(docs, n))]


def _index(windows: list, spark: SparkSession):
    """Broadcast form of one block of windows: prefix tokens with the places of their windows,
    and the windows' words with their items."""
    owners, places = {}, defaultdict(lambda: defaultdict(set))
    for w in windows:
        owners[w["words"].encode()] = tuple(w["ids"])
        places[min(SHINGLE, w["size"])][w["token"]].add((w["place"], w["size"]))
    prefix = {}
    for size, by in places.items():
        values = np.array(sorted(by, key=lambda t: t & ((1 << 64) - 1)), dtype=np.int64).view(np.uint64)
        prefix[size] = (values, [sorted(by[int(v)]) for v in values.view(np.int64)])
    return spark.sparkContext.broadcast({"windows": owners, "prefix": prefix})


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Columns ``keep`` (all) with FIELDS for every document.

    Defined cases: null and empty texts have no words and hit nothing; items without words
    have no windows; equal windows of several items hit for each of them; a null item id
    counts as the id ''; repeated rows are judged alike; with no items nothing is
    contaminated; columns with a field's name are replaced by it.
    """
    spark = docs.sparkSession
    names = docs.columns if keep is None else keep
    every = item_windows(items, item_text, item_id, window)
    every = stored(every.groupBy("words", "size").agg(F.sort_array(F.collect_set(F.coalesce("id", F.lit("")))).alias("ids"), F.first("tokens").alias("tokens")), "windows")
    n_blocks = 1 + every.count() // block
    every = every.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(n_blocks)))
    names = [c for c in names if c.lower() not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    own, back = sheltered(docs, names)
    out = docs.select(*own, docs[text].alias("_body"), F.lit(None).cast("array<long>").alias("_spans"), F.lit(None).cast("array<string>").alias("_items"), F.lit(None).cast("long").alias("_words"))
    for b in range(n_blocks):
        part = every.filter(F.col("block") == b)
        tokens = part.select(F.explode("tokens").alias("token"), F.least("size", F.lit(SHINGLE)).alias("k")).distinct()
        df = _frequencies(docs, text, [(r["token"], r["k"]) for r in tokens.collect()], spark)  # a block is bounded
        rare = part.select("words", "size", "ids", F.posexplode("tokens").alias("place", "token")).join(df, "token", "left")
        order = F.struct(F.coalesce("df", F.lit(0)), F.col("token"), F.col("place"))
        rare = rare.groupBy("words", "size", "ids").agg(F.min_by(F.struct("token", "place"), order).alias("r")).select("words", "size", "ids", "r.token", "r.place")
        known = _index(rare.collect(), spark)

        def compute(buf, offsets, known=known):
            index = known.value
            if "ready" not in index:
                index["ready"] = True
                index["prefix"] = {k: (Members(v), places) for k, (v, places) in index["prefix"].items()}
            return _hits(buf, offsets, index)

        made = with_text_columns(out, "_body", out.columns, "_s array<long>, _i array<string>, _n long", compute)
        joined = [F.concat(F.coalesce(a, F.array().cast(t)), F.col(b)).alias(a) for a, b, t in (("_spans", "_s", "array<long>"), ("_items", "_i", "array<string>"))]
        out = made.select(*[f"in_{i}" for i in range(len(names))], "_body", *joined, F.coalesce("_n", "_words").alias("_words"))
        if n_blocks > 1:
            out = stored(out, "hits")
    size = F.size("_spans")
    hit = F.flatten(F.transform(F.sequence(F.lit(0), (size / 2).cast("int") - 1), lambda i: F.sequence(F.element_at("_spans", (2 * i + 1).cast("int")), F.element_at("_spans", (2 * i + 2).cast("int")) - 1)))
    listed = F.array_sort(F.array_distinct("_items"))
    made = out.select(
        *[f"in_{i}" for i in range(len(names))],
        F.col("_words").alias("n_words"),
        F.when(size > 0, F.size(F.array_distinct(hit))).otherwise(0).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (size > 0).alias("contaminated"),
    )
    return made.select(*back, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS words
        FROM (SELECT *, least(len(w), {WINDOW}) AS size, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS words
       FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size, -1)::BIGINT + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, item_id, i, size FROM dw JOIN win USING (size, words)),
pos AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
