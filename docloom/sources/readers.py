"""Reading corpora: listings, paragraph caches, result files and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, exclude: DataFrame | None = None) -> DataFrame:
    """Files below ``root``: path, size, mtime; those with a pattern of ``exclude`` in their
    path are left out.  Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return out if exclude is None else out.join(F.broadcast(exclude), F.contains(F.lower("path"), F.lower("pattern")), "left_anti")


def listed_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """path, state and file_key of each listed path: 'bad' if it climbs out of the root or does
    not exist; blank lines and comments are not paths."""
    lines = wanted.select(F.trim("path").alias("path")).filter("path <> '' and not startswith(path, '#')")
    joined = lines.join(files.select("path", "file_key"), "path", "left")
    bad = F.col("file_key").isNull() | F.contains("path", F.lit(".."))
    return joined.select("path", F.when(bad, "bad").otherwise("ok").alias("state"), "file_key")


def cached_paragraphs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """file_key, para and content from text files of lines '[¶n]<tab>text'.  Strict reading drops
    other lines; lenient reading numbers them by their line, which needs a file in one piece."""
    if strict:
        lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("file_key"), F.col("value").alias("line"), F.lit(None).cast("int").alias("at"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("file_key"), "value")
        lines = whole.select("file_key", F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("at", "line"))
    number = F.regexp_extract("line", r"^\[¶(\d+)\]\t", 1)
    marked = number != ""
    rows = lines.filter(marked) if strict else lines
    return rows.select("file_key", F.when(marked, number.try_cast("int")).otherwise(F.col("at") + 1).alias("para"), F.regexp_replace("line", r"^\[¶\d+\]\t", "").alias("content"))


def result_items(spark: SparkSession, path: str, methods: list[str], schema: str) -> DataFrame:
    """Items of per-document result files (one JSON object each) whose review method is one of
    ``methods``; files that are not JSON or have no items are left out.  Adds item_no."""
    files = spark.read.schema(f"file_key string, review_method string, items array<struct<{schema}>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    kept = files.filter(F.col("review_method").isin(methods) & (F.size("items") > 0))
    return kept.select("file_key", F.posexplode("items").alias("item_no", "item")).select("file_key", "item_no", "item.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; lines that are not JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def dictionary_rows(entries: list[dict]) -> list[tuple]:
    """(canonical, variant, kind, strength, lang) rows of dictionary entries as a config file has
    them: canonical, kind, expansion_strength and lists of variants by language."""
    rows = []
    for e in entries:
        for lang in ("ko", "en"):
            rows += [(e["canonical"], v, e.get("kind"), e.get("expansion_strength", "normal"), lang) for v in e.get(lang) or []]
    return rows


def document_kind(content: Column) -> Column:
    """Kind of a file by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(F.startswith(head, F.lit("D0CF11E0A1B11AE1")), "ole2").when(F.startswith(head, F.lit("7B5C727466")), "rtf").when(F.startswith(head, F.lit("504B0304")), "zip").otherwise("unknown")
