"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with ``n`` of ``N`` rows and target weight ``w`` has the mean repetition rate
``w * N / n``.  Each document draws a uniform number from the hash of its id and the seed,
and the Poisson distribution of its source's rate is inverted at it; the document is exploded
by that count and all copies are put into one global random order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, sheltered

SEED = "mix-2024"
#: 2**52: 13 hexadecimal digits make an exact uniform double.
UNIT = float(1 << 52)


#: Copies of a document that one row is exploded into at once.
CHUNK = 4096


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the columns; null counts as ''."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(UNIT)


def poisson_count(u: Column, rate: Column) -> Column:
    """The least k with u < P(X <= k) for X of Poisson law with mean ``rate``.

    Above a rate of 700, where exp(-rate) underflows, the terms begin 12 deviations below the
    mean (what is left out is below exp(-72)), the first by Stirling's series.  A rate of null
    or below 0 gives 0.
    """
    mean = F.greatest(rate, F.lit(0.0))
    high = mean > 700
    first = F.when(high, F.floor(mean - 12 * F.sqrt(mean))).otherwise(0).cast("long")
    k = first.cast("double")
    stirling = k - mean + k * F.log(mean / k) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
    least = F.exp(F.when(high, stirling).otherwise(-mean))
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("long")
    start = F.struct(least.alias("p"), least.alias("cdf"), first.alias("k"))

    def step(acc: Column, j: Column) -> Column:
        more = u >= acc["cdf"]
        p = acc["p"] * mean / j.cast("double")
        return F.when(more, F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), j.alias("k"))).otherwise(acc)

    return F.coalesce(F.aggregate(F.sequence(first + 1, F.greatest(last, F.lit(1).cast("long"))), start, step, lambda acc: acc["k"]), F.lit(0).cast("long"))


def _copies(drawn: DataFrame, most: float) -> DataFrame:
    """A row for each copy.  A row of more than CHUNK copies is first cut into chunks, which are
    dealt out, so that no task has to write all copies of one document.  ``most``: the largest
    rate; where it leaves no such rows the rows are not read twice."""
    n, chunk = F.col("n_copies"), F.lit(CHUNK).cast("long")
    zero = F.lit(0).cast("long")
    few = drawn.filter(n <= chunk).withColumn("copy", F.explode(F.sequence(zero, n - 1)))
    if most + 12 * math.sqrt(most) + 25 <= CHUNK:
        return few
    cut = drawn.filter(n > chunk).withColumn("_chunk", F.explode(F.sequence(zero, F.floor((n - 1) / chunk).cast("long"))))
    # a stated number of partitions, as chunks are small before they are exploded and would be put together
    dealt = cut.repartition(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("_id", "_chunk"))
    many = dealt.withColumn("copy", F.explode(F.sequence(F.col("_chunk") * chunk, F.least((F.col("_chunk") + 1) * chunk, n) - 1))).drop("_chunk")
    return few.unionByName(many)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED, source: str = "source", id_col: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Every document as often as its Poisson draw says, in global random order.

    ``weights`` maps a source to its target share (sources not named get nothing; shares are
    normalised; if they sum to 0 nothing is returned); without it all sources weigh the same.  Adds copy (0-based), n_copies, rate
    and shuffle_key (by which the result is range-partitioned and sorted).  Null sources are
    one source of their own, which ``weights`` names by None.  Rows that repeat an id draw
    alike.  Columns of the input with those four names are replaced.  An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("copy", "n_copies", "rate", "shuffle_key")]
    own, back = sheltered(docs, names)
    keyed = docs.select(*own, docs[id_col].alias("_id"), F.to_json(F.struct(docs[source].alias("s"))).alias("_source"))
    sizes = keyed.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        kinds, total = sizes.agg(F.count(F.lit(1)), F.sum("_n")).first()
        table = sizes.withColumn("rate", F.lit(float(total or 0)) / F.lit(float(kinds or 1)) / F.col("_n"))
    else:
        total, share = sizes.agg(F.sum("_n")).first()[0] or 0, sum(weights.values())
        wanted = spark.createDataFrame([(k, v / share if share else 0.0) for k, v in weights.items()], "s string, w double")
        wanted = wanted.select(F.to_json(F.struct("s")).alias("_source"), "w")
        table = sizes.join(F.broadcast(wanted), "_source", "left").select("_source", "_n", (F.coalesce("w", F.lit(0.0)) * total / F.col("_n")).alias("rate"))
    count = poisson_count(F.col("_u"), F.col("rate"))
    drawn = lookup(keyed, table, "_source", "_n").withColumn("_u", uniform(seed, F.col("_id"))).withColumn("n_copies", count).filter("n_copies > 0")
    copies = _copies(drawn, table.agg(F.max("rate")).first()[0] or 0.0)
    key = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("copy").cast("string"))), 1, 16)
    copies = copies.withColumn("shuffle_key", key)
    spread = copies.repartitionByRange(partitions, "shuffle_key") if partitions else copies.repartitionByRange("shuffle_key")
    return spread.sortWithinPartitions("shuffle_key", "_id").select(*back, "copy", "n_copies", "rate", "shuffle_key")


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
tot AS (SELECT sum(n)::DOUBLE AS total, count(*)::DOUBLE AS kinds FROM sizes),
rates AS (SELECT source, total / kinds / n AS rate FROM sizes, tot),
pois AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM pois WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 24)),
u AS (SELECT *, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {UNIT} AS u FROM documents),
drawn AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, r.rate,
         (SELECT count(*) FROM pois p WHERE p.source IS NOT DISTINCT FROM u.source AND u.u >= p.cdf)::BIGINT AS n_copies
  FROM u JOIN rates r ON r.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy, n_copies, rate,
       substr(md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 16) AS shuffle_key
FROM drawn, range(n_copies) t(copy)
"""
