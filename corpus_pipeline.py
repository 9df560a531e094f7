"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage works on all rows that its predecessor kept and returns the columns of documents;
the last one returns the shards' plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, mixing, quality, sharding, simhash
from docloom.llm.common import stored


def _prefixed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Columns under names that no operator uses, and the way back."""
    return docs.select(*[docs[c].alias(f"in_{c}") for c in docs.columns]), [F.col(f"in_{c}").alias(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject.

    Null and empty texts have no words and go; repeated rows are judged alike, so all stay or
    all go; columns of any name are returned as they came; an empty table gives an empty one.
    """
    own, back = _prefixed(docs)
    return quality.quality_rules(own, text="in_text").filter("kept").select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the smallest id.

    Two documents are linked if their SimHashes differ in 4 bits or fewer, or if they share a
    band key of their five-word shingles, which is meant for a similarity of 0.8 or more (see
    ``simhash.bands`` for the odds).
    Rows that repeat that id stay with it if their text is the same only once: of equal ids
    in a group the first by text is kept.  Documents without an id are kept only if no
    document of their group has one, first by text.
    """
    own, back = _prefixed(docs)
    keyed = own.withColumn("text_key", F.unhex(F.md5(F.coalesce("in_text", F.lit("")))))
    rows = stored(simhash.with_bands(keyed, "in_text", ["in_doc_id", "text_key"]), "stage-fps")
    named = stored(simhash.near_duplicates(rows.drop("bands"), "in_doc_id", more=simhash.band_links(rows)), "stage-groups")
    first = F.coalesce(F.col("in_doc_id") == F.col("component_id"), F.col("component_id").isNull())
    # neither a null id nor an id on two unrelated texts names a group; its root does
    chosen = named.filter(first).groupBy("root", "in_doc_id").agg(F.min("text_key").alias("text_key"))
    known = stored(chosen.select("in_doc_id", "text_key").withColumn("keep", F.lit(True)), "stage-kept")
    kept = keyed.dropDuplicates(["in_doc_id", "text_key"]).join(known, keyed["in_doc_id"].eqNullSafe(known["in_doc_id"]) & (keyed["text_key"] == known["text_key"]), "left_semi")
    return kept.select(*back)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows are judged alike; columns of any
    name are returned as they came; an empty table, or no benchmark items, changes nothing.
    """
    own, back = _prefixed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(own, items, text="in_text").filter("not contaminated").select(*back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that all sources weigh the same; in global random order.

    Rows without a source are one source; rows that repeat an id (null as well) draw the same
    count; texts play no part; an empty table gives an empty one.
    """
    own, back = _prefixed(docs)
    return mixing.mix_sources(own, source="in_source", id_col="in_doc_id").select(*back)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row, as sharding.shard_documents gives them.

    Equal texts stay together (null texts are a group, empty ones another); null and repeated
    ids keep a row each; further columns are left out; an empty table gives an empty one.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: XXH64 fingerprints and the shards' heap have no form in SQL; tests hold the rows against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
