"""Quotas and stratified draws in stable orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def largest_remainder(strata: DataFrame, total: int, key: str = "stratum", size: str = "size") -> DataFrame:
    """Quota of each stratum in proportion to its size; what is left goes by remainder, then key.
    strata is a table of strata, not of rows."""
    whole = strata.agg(F.sum(size).alias("_all"))
    share = F.col(size) * total / F.col("_all")
    rows = strata.crossJoin(F.broadcast(whole)).withColumn("_base", F.floor(share)).withColumn("_rest", share - F.floor(share))
    given = rows.agg(F.sum("_base").alias("_given"))
    w = W.orderBy(F.desc("_rest"), key)  # over strata
    ranked = rows.crossJoin(F.broadcast(given)).withColumn("_r", F.row_number().over(w))
    return ranked.select(key, size, (F.col("_base") + (F.col("_r") <= total - F.col("_given")).cast("int")).cast("long").alias("quota"))


def half_quotas(strata: DataFrame, key: str = "stratum", size: str = "size") -> DataFrame:
    return strata.select(key, size, F.ceil(F.col(size) / 2).alias("quota"))


def balanced_quotas(strata: DataFrame, total: int, key: str = "stratum", size: str = "size") -> DataFrame:
    """As equal as the sizes allow: the level is filled round by round, one row a stratum."""
    slots = strata.select(key, size, F.explode(F.sequence(F.lit(1), F.col(size).cast("int"))).alias("_round")).filter(F.col("_round") <= total)
    taken = slots.orderBy("_round", key).limit(total).groupBy(key).agg(F.count(F.lit(1)).alias("quota"))
    return strata.join(taken, key, "left").select(key, size, F.coalesce("quota", F.lit(0)).alias("quota"))


def first_of_rounds(rows: DataFrame, stratum: str, depth: str, quotas: DataFrame, order: list[Column]) -> DataFrame:
    """The first ``quota`` rows of each stratum by (depth, order), with their place.

    A histogram of depths says where the quota is reached; deeper rows go before anything is
    ordered, and rows are numbered within their depth.  quotas: stratum, quota.
    """
    counts = rows.groupBy(stratum, depth).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(stratum).orderBy(depth).rowsBetween(W.unboundedPreceding, -1)  # over depths, not rows
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).join(quotas.select(F.col("stratum").alias(stratum), "quota"), stratum)
    near = rows.join(starts.filter("_start < quota").drop("_rows"), [stratum, depth])
    place = F.col("_start") + F.row_number().over(W.partitionBy(stratum, depth).orderBy(*order))
    return near.withColumn("place", place.cast("int")).filter("place <= quota").drop("_start")


def round_robin(rows: DataFrame, stratum: Column, project: Column, quotas: DataFrame, order: list[Column]) -> DataFrame:
    """The first rows of every project, then the second ones, ... up to the stratum's quota;
    projects of a round come in the order of their hash.  quotas: stratum, quota."""
    named = rows.withColumn("stratum", stratum).withColumn("project", project)
    depth = named.withColumn("depth", F.row_number().over(W.partitionBy("stratum", "project").orderBy(*order)))
    return first_of_rounds(depth, "stratum", "depth", quotas, [F.sha1(F.col("project")), *order])


def diverse_round_robin(rows: DataFrame, group: str, bucket: list[str], order: list[Column], first: int = 2, weights: dict[str, int] | None = None, total: int | None = None) -> DataFrame:
    """Rows of each group in turns over its buckets; groups take turns too: ``first`` rows each,
    then one round for every ``weight`` rows.  The whole is a total order (slot, group, place)."""
    inside = rows.withColumn("_n", F.row_number().over(W.partitionBy(group, *bucket).orderBy(*order)))
    placed = inside.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("_n", *bucket, *order)))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in (weights or {"": 1}).items() for x in kv])[F.col(group)], F.lit(1))
    slot = F.when(F.col("place") <= first, 0).otherwise(F.floor((F.col("place") - first - 1) / weight) + 1)
    out = placed.withColumn("slot", slot.cast("int")).drop("_n")
    return out if total is None else out.orderBy("slot", group, "place").limit(total)


def take_until(groups: DataFrame, target: int, order: list[Column], size: str = "size") -> DataFrame:
    """Groups in priority order until their sizes sum to the target; the last one in part.
    groups is a table of groups, not of rows."""
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    return groups.withColumn("_before", before).withColumn("take", F.greatest(F.least(F.col(size), target - F.col("_before")), F.lit(0))).filter("take > 0").drop("_before")


def one_per_project(rows: DataFrame, project: Column, score: Column, draft_order: list, quota: int, stratum: str) -> DataFrame:
    """One row per project (best score, then key), then per stratum in turns over draft states, up
    to the quota.  draft_order lists the states (0, 1, None) in their turn."""
    named = rows.withColumn("project", project).withColumn("_score", score)
    one = named.withColumn("_r", F.row_number().over(W.partitionBy(stratum, "project").orderBy(F.desc("_score"), "file_key"))).filter("_r = 1")
    turn = F.lit(len(draft_order))
    for i, d in enumerate(draft_order):
        turn = F.when(F.col("is_draft").isNull() if d is None else F.col("is_draft") == d, i).otherwise(turn)
    one = one.withColumn("_turn", turn)
    one = one.withColumn("_n", F.row_number().over(W.partitionBy(stratum, "_turn").orderBy(F.desc("_score"), F.sha1("project"), "file_key")))
    quotas = one.select(F.col(stratum).alias("stratum")).distinct().withColumn("quota", F.lit(quota))
    return first_of_rounds(one, stratum, "_n", quotas, [F.col("_turn")]).drop("quota")


def recent_distinct(log: DataFrame, key: list[str], last: int, n: int) -> DataFrame:
    """The most recent entry of each condition among the last ``last`` entries, newest first."""
    tail = log.orderBy(F.desc("id")).limit(last)
    one = tail.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("id")))).filter("_r = 1").drop("_r")
    return one.orderBy(F.desc("id")).limit(n)
