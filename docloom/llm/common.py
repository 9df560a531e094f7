"""What the training-data operators share: stored intermediate tables, joins that stand hot
keys, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytevec import as_bytes, runs

#: A key is hot from this share of the rows on; there are at most HOT_SHARE hot keys.
HOT_SHARE = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of its own only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("docloom.scratch", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="docloom-")
            spark.conf.set("docloom.scratch", found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives executors."""
    path = f"{shared_dir(df.sparkSession)}/docloom-{tag}-{uuid.uuid4().hex}"
    # the first level of zstd takes half the time of the usual one, for files that are read once or twice
    df.write.option("parquet.compression.codec.zstd.level", "1").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sheltered(df: DataFrame, names: list[str]) -> tuple[list[Column], list[Column]]:
    """The named columns of ``df`` as in_0, in_1, ..., which no operator uses, and the way back."""
    return [df[c].alias(f"in_{i}") for i, c in enumerate(names)], [F.col(f"in_{i}").alias(c) for i, c in enumerate(names)]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has each non-null ``key`` once.

    ``weight`` is a column of ``table`` that says how many of the rows carry the key.  Keys of
    more than 1/HOT_SHARE of the rows are few (at most HOT_SHARE), so their part of the table
    is broadcast and their rows stay where they are; all others are joined by a shuffle.
    Rows without a partner get nulls.  ``weight`` is dropped.
    """
    spark = rows.sparkSession
    total, keys = table.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count(F.lit(1))).first()
    hot = table.filter(F.col(weight) * HOT_SHARE >= max(total, 1))
    cols = [c for c in table.columns if c not in (key, weight)]
    found = hot.collect()  # at most HOT_SHARE rows
    hot = F.broadcast(spark.createDataFrame(found, table.schema).drop(weight).withColumn("_hot", F.lit(True)))
    first = rows.join(hot, key, "left")
    if len(found) == keys:
        return first.drop("_hot")
    warm = first.filter("_hot").drop("_hot")
    cold = first.filter("_hot is null").drop("_hot", *cols)
    rest = cold.join(table.filter(F.col(weight) * HOT_SHARE < max(total, 1)).drop(weight), key, "left")
    return warm.select(*rest.columns).unionByName(rest)


def with_text_columns(df: DataFrame, text: str, keep: list[str], fields: str, compute) -> DataFrame:
    """Columns ``keep`` of ``df`` and those of ``fields`` (DDL) that ``compute`` derives from the
    column ``text``, without a shuffle.  ``compute(buf, offsets)`` gets the UTF-8 bytes of a run
    of whole texts and returns one Arrow array for each field.  A kept column with the name of
    a field gives way to it."""
    added = StructType.fromDDL(fields)
    keep = [c for c in keep if c not in added.names]
    schema = StructType([df.schema[c] for c in keep] + added.fields)
    names = [f.name for f in added.fields]
    body = fresh(df.select(*[df[c] for c in keep]), "_text_")

    def run(batches):
        for batch in batches:
            buf, offsets = as_bytes(batch.column(body))
            for lo, hi in runs(offsets):
                made = compute(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in keep] + made, names=keep + names)

    return df.select(*[df[c] for c in keep], df[text].alias(body)).mapInArrow(run, schema)


def fold(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a, b: long): (node, root), root the smallest node.

    Alternating large-star and small-star rounds; each round's tables are written out, so a
    hub's rows meet only its minimum, over a join whose skewed partitions Spark can split.
    Nodes without an edge to another node do not appear.
    """
    e = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = stored(e, tag)
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), tag)
        large = stored(both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), tag)
        low = stored(large.groupBy("b").agg(F.min("a").alias("m")), tag)
        small = large.join(low, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        e = stored(small.union(low.select(F.col("m").alias("a"), "b")).distinct(), tag)
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
