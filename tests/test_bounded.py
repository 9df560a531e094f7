"""Groups of any size do not become one row."""

from docloom.operators import evaluation, stats
from docloom.plans import registry
from pyspark.sql import functions as F
from tests.oracle import SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_list_of_a_whole_query(spark):
    assert "collect_" not in plan(registry.QUERIES["golden_queries"](spark, SF))


def test_first_ids_of_a_cluster_are_limited_before_the_list(spark):
    assert "WindowGroupLimit" in plan(registry.QUERIES["candidate_clusters"](spark, SF))


def test_golden_status(spark):
    results = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("d", "9")], "query string, file_key string")
    expected = spark.createDataFrame([("a", 2, False), ("b", None, False), ("c", None, False), ("d", None, True), ("e", None, False)], "query string, expected_count int, skip boolean")
    files = spark.createDataFrame([("a", "2"), ("b", "1"), ("b", "7"), ("e", "1")], "query string, file_key string")
    got = {r["query"]: tuple(r)[1:] for r in evaluation.golden_status(results, expected, files).collect()}
    assert got == {"a": (2, 1.0, "pass"), "b": (1, 0.5, "fail"), "c": (1, None, "unscored"), "d": (1, None, "skipped"), "e": (0, 0.0, "fail")}


def test_clusters_show_the_first_five(spark):
    rows = [(i, f"f{(7 * i) % 50:02d}", "k") for i in range(50)] + [(99, "f00", "one")]
    candidates = spark.createDataFrame(rows, "candidate_id long, evidence_file_key string, kind string")
    files = spark.createDataFrame([(f"f{i:02d}", "t", "en") for i in range(50)], "file_key string, ctype string, lang string")
    got = stats.clusters(candidates, F.col("kind"), files).collect()
    assert [tuple(r) for r in got] == [("k", 50, 50, 1, 1, "f00|f01|f02|f03|f04")]
