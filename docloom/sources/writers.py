"""Writing: paragraph caches, logs, CSV and Markdown exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_lines(paragraphs: DataFrame) -> DataFrame:
    """file_key and value: the cache line of each paragraph."""
    return paragraphs.select("file_key", "para", F.concat(F.lit("[¶"), F.col("para").cast("string"), F.lit("]\t"), "content").alias("value"))


def write_paragraph_cache(paragraphs: DataFrame, path: str) -> None:
    """A folder per document with its lines in order.  Parquet is the form to work on; this one
    is for people and other tools."""
    lines = cache_lines(paragraphs).repartition("file_key").sortWithinPartitions("file_key", "para")
    lines.select("file_key", "value").write.mode("overwrite").partitionBy("file_key").text(path)


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def markdown_blocks(hits: DataFrame, title: Column, key: str, order: str, text: str) -> DataFrame:
    """One Markdown block per ``key``: a heading and the cited paragraphs in their order."""
    line = F.concat(F.lit("> [¶"), F.col(order).cast("string"), F.lit("] "), F.col(text))
    rows = hits.groupBy(key).agg(F.first(title).alias("_title"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("_lines"))
    return rows.select(key, F.concat(F.lit("## "), "_title", F.lit("\n"), F.array_join(F.transform("_lines", lambda x: x["l"]), "\n")).alias("block"))
