"""Postings of character trigrams: exact phrase search that reads only the query's trigrams.

An index is a folder with two tables.  ``postings`` has, for each trigram and block of
paragraphs, the places where the trigram stands, the largest count and the least length in the
block; it is partitioned by a hash of the trigram.  A block's paragraphs stand once, in a row
of its own in the partition ``HEADS``.  ``stats`` has the paragraphs and characters of each
batch.  A phrase stands where its trigrams stand one after the other, so counts, scores and
ranks are those of a scan over whole paragraphs.  New documents are further batches: nothing
that stands is written again.

A block is a run of paragraphs as a task reads them, so the index is written where the texts
are read, without a shuffle.  A place is paragraph-in-block * stride + character; the places of
a trigram are kept as their differences, seven bits a byte.

Phrases under three characters have no trigram; they are found by a scan (``short_term_hits``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.search import bm25
from docloom.sources.scratch import stored

BUCKETS = 16
#: The partition of the blocks' own rows.
HEADS = -1
MADE = "gram string, block long, max_tf int, min_len int, stride long, places binary, rows array<struct<file_key: string, para: int, len: int>>"
POSTINGS = f"{MADE}, batch int, bucket int"
STATS = "n_rows long, sum_len long, batch int"
#: Paragraphs of a block, and its characters (a longer paragraph is a block of its own); a
#: block's trigram is one row.
BLOCK, BLOCK_CHARS = 256, 1 << 20
GRAM = 3


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the values (seven bits each, lowest first, the top bit: more follow) and how many
    bytes each takes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= np.uint64(1 << 7 * k)
    out = np.empty(int(size.sum()), np.uint8)
    start = np.cumsum(size) - size
    for k in range(int(size.max()) if len(size) else 0):
        mine = size > k
        more = np.where(size[mine] > k + 1, 128, 0).astype(np.uint8)
        out[start[mine] + k] = ((values[mine] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    """The places, ascending, of a trigram's packed differences."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], last[:-1] + 1])
    nth = np.arange(len(raw)) - np.repeat(start, last - start + 1)
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * nth), start))


def _blocks(sizes: np.ndarray, most: int, chars: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of up to ``most`` texts and ``chars`` characters, one text at least."""
    at = 0
    while at < len(sizes):
        end, used = at + 1, int(sizes[at])
        while end < len(sizes) and end - at < most and used + int(sizes[end]) <= chars:
            used += int(sizes[end])
            end += 1
        yield at, end
        at = end


def _posted(texts: list[str | None], sizes: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, int, pa.Array]:
    """gram, max_tf, min_len, stride and places of the trigrams of a block's folded texts.
    sizes: the texts' trigrams by their unfolded lengths, as bm25 counts them."""
    codes = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
    n = np.array([max(len(c) - GRAM + 1, 0) for c in codes])
    stride = int(max(n.max(), 1))
    body = np.concatenate([c for c, k in zip(codes, n, strict=True) if k] or [np.empty(0, np.int64)])
    row = np.repeat(np.arange(len(codes)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    spot = at + np.repeat(np.cumsum(np.where(n > 0, n + GRAM - 1, 0)) - np.where(n > 0, n + GRAM - 1, 0), n)
    gram = body[spot] | body[spot + 1] << 21 | body[spot + 2] << 42
    order = np.argsort(gram, kind="stable")
    gram, place, row = gram[order], (row * stride + at)[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, np.int64)
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    data, size = packed(step)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(size, first))]) if len(first) else np.zeros(1)
    places = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    if not len(first):
        return [], np.empty(0, np.int32), np.empty(0, np.int32), stride, places
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])])
    runs = np.flatnonzero(new)
    tf = np.diff(np.append(runs, len(gram)))
    most = np.maximum.reduceat(tf, np.searchsorted(runs, first))
    least = np.minimum.reduceat(sizes[row], first)
    g = gram[first]
    text = np.stack([g & 0x1FFFFF, g >> 21 & 0x1FFFFF, g >> 42], 1).astype(np.uint32).tobytes().decode("utf-32-le")
    return [text[i : i + GRAM] for i in range(0, len(text), GRAM)], most, least, stride, places


def add_to_index(paragraphs: DataFrame, path: str, batch: int) -> None:
    """Index ``paragraphs`` (file_key, para, content) as batch ``batch`` under ``path``.

    Writing a batch again replaces it, so a batch that failed half-way can be repeated.  Texts
    are folded to lower case; null and short texts have no trigrams but count in the lengths.
    Each task writes a file for each bucket.
    """
    most, chars = BLOCK, BLOCK_CHARS
    names = ["gram", "block", "max_tf", "min_len", "stride", "places", "rows"]
    kind = pa.struct([("file_key", pa.string()), ("para", pa.int32()), ("len", pa.int32())])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            texts, sizes = b.column(2).to_pylist(), b.column(3).to_numpy(zero_copy_only=False)
            for lo, hi in _blocks(sizes, most, chars):
                own = pa.StructArray.from_arrays([b.column(i).slice(lo, hi - lo).cast(kind.field(k).type) for k, i in enumerate((0, 1, 3))], fields=list(kind))
                grams, tf, least, stride, places = _posted(texts[lo:hi], sizes[lo:hi])
                k = len(grams)
                column = lambda head, values, t: pa.array([head, *values], t)
                held = pa.ListArray.from_arrays(pa.array([0] + [hi - lo] * (k + 1), pa.int32()), own)  # all in the first row
                yield pa.RecordBatch.from_arrays(
                    [column(None, grams, pa.string()), pa.array(np.full(k + 1, number), pa.int64()), column(None, tf, pa.int32()), column(None, least, pa.int32()), pa.array(np.full(k + 1, stride), pa.int64()), pa.concat_arrays([pa.nulls(1, pa.binary()), places]), held],
                    names=names,
                )
                number += 1

    size = F.greatest(F.coalesce(F.length("content"), F.lit(0)) - 2, F.lit(0)).cast("int")
    rows = paragraphs.select("file_key", F.col("para").cast("int").alias("para"), F.lower("content").alias("low"), size.alias("len"))
    bucket = F.when(F.col("gram").isNull(), HEADS).otherwise(bucket_of(F.col("gram")))
    out = rows.mapInArrow(run, MADE).withColumns({"batch": F.lit(batch), "bucket": bucket})
    out.sortWithinPartitions("batch", "bucket", "gram").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("batch", "bucket").parquet(f"{path}/postings")
    own = _heads(paragraphs.sparkSession, path).filter(F.col("batch") == batch)
    stats = own.select(F.inline("rows")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("len"), F.lit(0)).alias("sum_len")).withColumn("batch", F.lit(batch))
    stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/stats")


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """The blocks' own rows: batch, block, and rows (file_key, para, len) in the order of places."""
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter(F.col("bucket") == HEADS).select("batch", "block", "rows")


def query_grams(terms: list[str]) -> list[tuple[str, str, int, int]]:
    """(term, trigram, its place in the term, how many it has) of the folded terms."""
    out = []
    for term in dict.fromkeys(t.lower() for t in terms):
        n = len(term) - GRAM + 1
        out += [(term, term[i : i + GRAM], i, n) for i in range(n)]
    return out


def _lists(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Posting rows of the wanted trigrams: only their partitions of the index are read.  The
    column block knows the index's folder."""
    buckets = [r[0] for r in wanted.select(bucket_of(F.col("gram"))).distinct().collect()]
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets) & F.col("gram").isin([r[0] for r in wanted.select("gram").distinct().collect()]))
    return rows.drop("rows").withColumn("block", F.col("block").alias("block", metadata={"index": path}))


def _in_block(batches):
    """(paragraph in its block, count) of the phrases whose trigrams all follow each other."""
    for b in batches:
        found = []
        for stride, grams in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            starts = None
            for g in grams:
                own = unpacked(g["places"]) - g["nth"]
                starts = own if starts is None else np.intersect1d(starts, own, assume_unique=True)
            starts = starts[(starts >= 0) & (starts // stride == (starts + len(grams) - 1) // stride)]
            row, tf = np.unique(starts // stride, return_counts=True)
            found.append([{"row": int(r), "tf": int(k)} for r, k in zip(row, tf, strict=True)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.list_(pa.struct([("row", pa.int32()), ("tf", pa.int32())])))], names=["term", "batch", "block", "found"])


def _phrases(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, file_key, para, len, tf of the paragraphs where all trigrams of a term follow each
    other.  lists: posting rows; wanted: term, gram, nth, n.  A block is settled at a time."""
    path = lists.schema["block"].metadata["index"]
    each = lists.join(F.broadcast(wanted), "gram").groupBy("term", "n", "batch", "block", "stride").agg(F.collect_list(F.struct("nth", "places")).alias("grams")).filter(F.size("grams") == F.col("n"))
    found = each.select("term", "batch", "block", "stride", "grams").mapInArrow(_in_block, "term string, batch int, block long, found array<struct<row: int, tf: int>>").filter(F.size("found") > 0)
    placed = found.join(_heads(lists.sparkSession, path), ["batch", "block"])
    spots = placed.select("term", F.explode(F.transform("found", lambda x: F.struct(F.get("rows", x["row"]).alias("r"), x["tf"].alias("tf")))).alias("x"))
    return spots.select("term", "x.r.file_key", "x.r.para", "x.r.len", "x.tf")


def _wanted(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.createDataFrame(query_grams(terms), "term string, gram string, nth int, n int")


def corpus_stats(spark: SparkSession, path: str) -> tuple[int, float]:
    n, total = spark.read.schema(STATS).parquet(f"{path}/stats").agg(F.sum("n_rows"), F.sum("sum_len")).first()
    return n or 0, (total or 0) / n if n else 0.0


def indexed_scores(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """term, file_key, para, score of every paragraph with a term of three characters or more."""
    wanted = _wanted(spark, terms)
    hits = stored(_phrases(_lists(spark, path, wanted), wanted), "posting-hits")
    return scored(hits, *corpus_stats(spark, path))


def scored(hits: DataFrame, n_rows: int, avg_len: float) -> DataFrame:
    """bm25 of ``hits`` (term, file_key, para, len, tf), which are all of their terms'."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_hits"))  # a row for each term of the query
    score = bm25(F.col("tf"), F.col("len"), F.lit(avg_len), F.lit(float(n_rows)), F.col("n_hits"))
    return hits.join(F.broadcast(df), "term").select("term", "file_key", "para", F.round(score, 9).alias("score"))


def top_paragraphs(spark: SparkSession, path: str, term: str, k: int, n_hits: int, first_blocks: int = 64) -> tuple[DataFrame, int, int]:
    """The ``k`` best paragraphs for one term (score, then file_key and para), the blocks whose
    lists were opened and all blocks that hold the term's trigrams.

    A block's bound is the score of its largest count (the least over the trigrams) at its
    least length.  The best ``first_blocks`` by bound are opened first; then only those whose
    bound reaches the k-th score found.  ``n_hits``: paragraphs that hold the term, for bm25.
    """
    wanted = _wanted(spark, [term])
    n_rows, avg_len = corpus_stats(spark, path)
    lists = _lists(spark, path, wanted)
    grams = len({g for _, g, _, _ in query_grams([term])})
    heads = lists.groupBy("batch", "block").agg(F.count_distinct("gram").alias("g"), F.min("max_tf").alias("tf"), F.max("min_len").alias("len")).filter(F.col("g") == grams)
    # the phrase's paragraphs are in every trigram's list, so each list's least length bounds them
    bound = F.round(bm25(F.col("tf"), F.col("len"), F.lit(avg_len), F.lit(float(n_rows)), F.lit(float(n_hits))), 9)
    heads = stored(heads.select("batch", "block", bound.alias("bound")), "posting-heads")
    score = F.round(bm25(F.col("tf"), F.col("len"), F.lit(avg_len), F.lit(float(n_rows)), F.lit(float(n_hits))), 9)

    def best(blocks: DataFrame) -> DataFrame:
        found = _phrases(lists.join(blocks.select("batch", "block"), ["batch", "block"], "left_semi"), wanted)
        return found.select("term", "file_key", "para", score.alias("score")).orderBy("score", "file_key", "para").limit(k)

    first = heads.orderBy("bound", "batch", "block").limit(first_blocks)
    begun = best(first).collect()  # k rows
    if len(begun) == k:
        reach = heads.filter(F.col("bound") <= begun[-1]["score"])
    else:
        reach = heads
    opened = reach.union(first).distinct()
    return best(opened), opened.count(), heads.count()
