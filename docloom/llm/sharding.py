"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together.  Groups are sorted by size and
each goes to the least-loaded shard, which a heap yields.  One heap over all groups would be
one task, so the schedule has two levels:

1. Groups are dealt by the hash of their text to ``blocks`` blocks.  In a block a heap deals
   the groups, largest first, to as many bins as there are shards.
2. The bins (at most blocks x shards) and the heavy groups (a bounded number, see HEAVY) are
   scheduled, largest first, onto the shards with one heap on the driver.

Both levels are LPT, and a bin is itself a group of groups that stay together.  The driver
only sees bins and heavy groups: some 24 numbers for each BLOCK_GROUPS groups.

Slots are numbered per shard without a window over a whole shard: rows are numbered within
(shard, slice), and the slices' offsets are added.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lookup, stored

SHARDS = 24
#: At least so many blocks, and one for so many groups, so that a block fits one task.
BLOCKS = 256
BLOCK_GROUPS = 1 << 19
SLICES = 512
#: A group is heavy from 1/HEAVY of all bytes on, so there are at most HEAVY heavy groups.
HEAVY = 24 * 64
#: Bytes that every row counts beside its text.
ROW_BYTES = 8


def lpt(sizes: list[int], bins: int) -> list[int]:
    """Bin of each size: largest first, always to the least-loaded bin (lowest number on ties)."""
    heap = [(0, b) for b in range(bins)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, b = heap[0]
        out[i] = b
        heapq.heapreplace(heap, (load + sizes[i], b))
    return out


def _block_bins(shards: int):
    def schedule(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gkey"], ascending=[False, True], kind="mergesort")
        return pdf.assign(bin=lpt(pdf["bytes"].tolist(), shards))[["block", "gkey", "bytes", "bin", "n"]]

    return schedule


def shard_documents(docs: DataFrame, shards: int = SHARDS, blocks: int | None = None, slices: int = SLICES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Put every row into one of ``shards`` shards, equal texts together, bytes near equal.

    Returns id_col, size, text_crc32, law ('bytes'), shard, slot (0, 1, 2, ... in each shard)
    and grown_shard (null: the law is not ``key``).  Defined cases: null texts form one group
    of their own, apart from the empty text; null and repeated ids are kept, one row each;
    an empty table gives an empty result; further columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    body = F.col(text)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(body).cast("long"), F.lit(0)) + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(body, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(body)), F.lit(b"")).alias("gkey"),
    )
    rows = stored(rows, "shard-rows")  # ids and digests, no texts
    groups = stored(rows.groupBy("gkey").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    blocks = blocks or max(BLOCKS, groups.count() // BLOCK_GROUPS)
    is_heavy = F.col("bytes") * HEAVY >= total
    heavy = groups.filter(is_heavy).orderBy(F.desc("bytes"), "gkey").collect()  # at most HEAVY rows
    light = (
        groups.filter(~is_heavy)
        .withColumn("block", F.pmod(F.xxhash64("gkey"), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(_block_bins(shards), "block long, gkey binary, bytes long, bin int, n long")
    )
    light = stored(light, "shard-bins")
    bins = light.groupBy("block", "bin").agg(F.sum("bytes").alias("bytes")).orderBy("block", "bin").collect()  # at most blocks x shards
    placed = lpt([r["bytes"] for r in heavy] + [r["bytes"] for r in bins], shards)
    schema = "block long, bin int, shard int"
    of_bin = spark.createDataFrame([(r["block"], r["bin"], s) for r, s in zip(bins, placed[len(heavy) :], strict=True)], schema)
    of_heavy = spark.createDataFrame([(bytes(r["gkey"]), r["n"], s) for r, s in zip(heavy, placed, strict=False)], "gkey binary, n long, shard int")
    table = light.join(F.broadcast(of_bin), ["block", "bin"]).select("gkey", "n", "shard").unionByName(of_heavy)
    out = lookup(rows, table, "gkey", "n").withColumn("slice", F.pmod(F.xxhash64("_id", "gkey", F.lit(7)), F.lit(slices)).cast("int"))
    out = stored(out, "shard-placed")
    before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # over shards x slices counts
    starts = out.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("k")).select("shard", "slice", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "slice").orderBy("_id", "gkey")
    return (
        out.withColumn("r", F.row_number().over(within) - 1)
        .join(F.broadcast(spark.createDataFrame(starts.collect(), starts.schema)), ["shard", "slice"])
        .select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
