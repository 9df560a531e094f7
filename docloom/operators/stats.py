"""Corpus statistics: counts, facets, progress, backlog and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ["ok", "empty", "error", "unsupported", "excluded", "missing"]


def counts_over_domain(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Count of every value of the domain, zero where there is none."""
    every = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return every.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def grouped_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """ok files and all but the missing ones, in one pass."""
    return rows.groupBy(*columns).agg(F.count_if(F.col("status") == "ok").alias("ok_files"), F.count_if(F.col("status") != "missing").alias("all_files"))


def duplicate_summary(files: DataFrame) -> DataFrame:
    """files, groups, repeated groups and the ok files in them."""
    groups = files.filter("status <> 'missing'").groupBy("dup_group").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("ok"))
    return groups.agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("ok"))), F.lit(0)).alias("ok_repeated"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values of several columns with their counts; nulls dropped."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, part: str, n: int) -> DataFrame:
    """The n most frequent values of each part; ties by value."""
    w = W.partitionBy(part).orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(100.0 * part / whole, 1))


def target_population(files: DataFrame, eligible: list[str]) -> DataFrame:
    """ok files with text of an eligible type, one per duplicate group by type, language, key."""
    w = W.partitionBy("dup_group").orderBy("ctype", "lang", "file_key")
    ok = files.filter((F.col("status") == "ok") & (F.col("char_count") > 0) & F.col("ctype").isin(eligible))
    return ok.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def progress(targets: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Evaluated and total files by type and over all (ctype null)."""
    marked = targets.select("file_key", "ctype").join(evaluated.select("file_key").distinct().withColumn("_e", F.lit(1)), "file_key", "left")
    rolled = marked.rollup("ctype").agg(F.count("_e").alias("evaluated"), F.count(F.lit(1)).alias("total"))
    return rolled.withColumn("percent", percent(F.col("evaluated"), F.col("total")))


def coverage_histogram(targets: DataFrame, families: DataFrame, coverage: DataFrame) -> DataFrame:
    """(family, part, status, n) over every target; a pair without a row is not_evaluated."""
    pairs = targets.select("file_key").crossJoin(F.broadcast(families.select("family"))).join(coverage, ["file_key", "family"], "left")
    parts = F.explode(F.array(F.struct(F.lit("body").alias("part"), F.coalesce("body_status", F.lit("not_evaluated")).alias("status")), F.struct(F.lit("annex").alias("part"), F.coalesce("annex_status", F.lit("not_evaluated")).alias("status"))))
    return pairs.select("family", parts.alias("p")).select("family", "p.*").groupBy("family", "part", "status").agg(F.count(F.lit(1)).alias("n"))


def clusters(candidates: DataFrame, key: Column, files: DataFrame, min_count: int = 2) -> DataFrame:
    """Candidates with the same key: counts, documents, ids and first evidence (5), largest first
    by rows, documents, key."""
    meta = files.select(F.col("file_key").alias("evidence_file_key"), "ctype", "lang")
    rows = candidates.withColumn("cluster", key).join(meta, "evidence_file_key", "left")
    # a rank below a constant is taken in each task before rows meet
    order = W.partitionBy("cluster").orderBy("evidence_file_key", "candidate_id")
    top = rows.select("cluster", "evidence_file_key", "candidate_id").withColumn("_r", F.row_number().over(order)).filter("_r <= 5")
    ids = F.array_sort(F.collect_list(F.struct("evidence_file_key", "candidate_id")))
    top = top.groupBy(F.col("cluster").alias("_c")).agg(F.array_join(F.transform(ids, lambda x: x["evidence_file_key"]), "|").alias("evidence"))
    out = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("evidence_file_key").alias("documents"), F.count_distinct("ctype").alias("types"), F.count_distinct("lang").alias("langs"))
    return out.filter(F.col("n") >= min_count).join(top, F.col("cluster").eqNullSafe(F.col("_c"))).select("cluster", "n", "documents", "types", "langs", "evidence")


def recurrence(candidates: DataFrame, key: Column) -> DataFrame:
    """Each candidate's document count: documents that share its key, one at least."""
    keyed = candidates.withColumn("recurrence_key", key)
    docs = keyed.groupBy("recurrence_key").agg(F.count_distinct("evidence_file_key").alias("_n"))
    return keyed.drop("document_count").join(docs, "recurrence_key").withColumn("document_count", F.greatest(F.lit(1), "_n").cast("long")).drop("_n")


def histogram_of_sizes(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def repeated_items(items: DataFrame) -> DataFrame:
    """Items whose text repeats in their document: group size, and whether the whole tuple
    repeats (then all but the least reference are surplus) or the readings differ."""
    text = W.partitionBy("file_key", "verbatim")
    whole = W.partitionBy("file_key", "verbatim", "taxonomy_id", "loc_start", "loc_end", "statement_polarity")
    marked = items.withColumn("group_size", F.count(F.lit(1)).over(text)).withColumn("tuple_size", F.count(F.lit(1)).over(whole)).withColumn("_r", F.row_number().over(whole.orderBy("item_ref")))
    kind = F.when(F.col("tuple_size") == 1, "distinct").when(F.col("_r") == 1, "keep").otherwise("surplus")
    return marked.filter("group_size > 1").select("file_key", "item_ref", "family", "group_size", kind.alias("kind"))


def dense_paragraphs(items: DataFrame, least: int) -> DataFrame:
    """Paragraphs on which one family has ``least`` items or more."""
    return items.groupBy("file_key", "family", "loc_start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def blocked_candidates(candidates: DataFrame, key: Column) -> DataFrame:
    """Pending candidates with whether they block: their parent is below a root, or they recur."""
    pending = candidates.filter("status = 'pending'").withColumn("name_key", key)
    again = pending.groupBy("name_key").agg(F.count_distinct("evidence_file_key").alias("_docs"))
    out = pending.join(again, "name_key")
    blocks = F.contains("recommended_parent_id", F.lit(".")) | (F.col("document_count") > 1) | (F.col("_docs") > 1)
    return out.withColumn("blocks", blocks).withColumn("reason", F.when(F.contains("recommended_parent_id", F.lit(".")), "specific_parent").when(blocks, "recurs").otherwise("one_off"))
