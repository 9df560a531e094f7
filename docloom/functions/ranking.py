"""Ranks over long partitions without one task per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Quantiles that cut a partition's scores.
CUTS = 32


def rank_within(rows: DataFrame, part: str, score: str, ties: list[str]) -> DataFrame:
    """Adds rank: the 1-based place within ``part`` by (score, *ties), all ascending.

    A partition may hold much of the data, so it is cut at quantiles of its scores.  Rows are
    numbered within a cut, and the cut's start, a running sum of counts, is added.  Rows whose
    score is a quantile itself form cuts of their own, divided by the first tie column's first
    two characters (or by its value's text if it is shorter), so many equal scores spread too.
    """
    share = F.array(*[F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)])
    edges = rows.groupBy(part).agg(F.array_distinct(F.percentile_approx(score, share, 1000)).alias("_edges"))
    cut = rows.join(F.broadcast(edges), part)
    cut = cut.withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col(score)))).withColumn("_eq", F.array_contains("_edges", F.col(score)).cast("int"))
    cut = cut.withColumn("_sub", F.when(F.col("_eq") == 1, F.substring(F.col(ties[0]).cast("string"), 1, 2)).otherwise("")).drop("_edges")
    starts = cut.groupBy(part, "_b", "_eq", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(part).orderBy("_b", "_eq", "_sub").rowsBetween(W.unboundedPreceding, -1)  # over cuts, not rows
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(part, "_b", "_eq", "_sub").orderBy(score, *ties)
    numbered = cut.withColumn("_r", F.row_number().over(inside))
    return numbered.join(starts, [part, "_b", "_eq", "_sub"]).withColumn("rank", (F.col("_start") + F.col("_r")).cast("long")).drop("_b", "_eq", "_sub", "_r", "_start")
