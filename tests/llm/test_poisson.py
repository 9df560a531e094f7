"""The Poisson law at large rates."""

import math

from pyspark.sql import functions as F

from docloom.llm import mixing


def test_counts_invert_the_distribution(spark):
    want = {}
    for rate in (699.5, 701.0, 900.5, 1500.0, 40_000.25):
        for u in (1e-9, 0.02, 0.5, 0.9, 0.99999):
            k = cdf = 0
            while (cdf := cdf + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))) <= u:
                k += 1
            want[u, rate] = k
    rows = spark.createDataFrame(list(want), "u double, rate double").withColumn("k", mixing.poisson_count(F.col("u"), F.col("rate"))).collect()
    assert {(r["u"], r["rate"]): r["k"] for r in rows} == want


def test_variance_is_the_rate(spark):
    drawn = spark.range(3000).select(mixing.poisson_count(mixing.uniform("v", F.col("id")), F.lit(2000.0)).alias("k"))
    mean, variance = drawn.agg(F.mean("k"), F.variance("k")).first()
    assert abs(mean - 2000) < 5 and 1700 < variance < 2300
