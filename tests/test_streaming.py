"""Streams give what the same transformations give on tables."""

from pyspark.sql import functions as F

from docloom.streaming import jobs
from tests.oracle import SF


def test_ingest_equals_batch_and_repeats_safely(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest(stream(), str(tmp_path / "files"), str(tmp_path / "paras"), str(tmp_path / "cp")).awaitTermination()
    got = jobs.newest(spark.read.parquet(str(tmp_path / "files")), "file_key")
    want = jobs.document_rows(docs)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    paras = jobs.newest(spark.read.parquet(str(tmp_path / "paras")), "file_key")
    assert paras.count() == jobs.document_paragraphs(docs).count()


def test_window_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.log_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["start", "event_type", "n", "zero"]
    got = spark.table("windows").select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, jobs.log_windows(events).select(*cols).collect()))


def test_distinct_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(200)
    events.write.parquet(str(tmp_path / "in"))
    out = jobs.distinct_recent(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), ["user_id", "event_type"], "3650 days")
    q = out.writeStream.format("memory").queryName("recent").trigger(availableNow=True).start()
    q.awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "in"))
    assert spark.table("recent").count() == stored.select("user_id", "event_type").distinct().count()


def test_recurrence_promotes_on_the_second_document(spark, tmp_path):
    schema = "recurrence_key string, file_key string"
    for i, rows in enumerate([[("k", "a"), ("j", "a")], [("k", "a")], [("k", "b")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    seen = []
    jobs.promote_batches(stream, lambda df, _: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp")).awaitTermination()
    assert ("k", 2, True) in seen and ("j", 1, False) in seen and not any(k == "j" and p for k, _, p in seen)
    assert [x for x in seen if x[0] == "k"] == [("k", 1, False), ("k", 2, True)]


def test_zero_values_count(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1, "q", 0.0), ("2024-01-01 00:20:00", 1, "q", None), ("2024-01-01 00:30:00", 2, "q", 3.0)], "ts string, user_id int, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    row = jobs.log_windows(rows).first()
    assert (row["n"], row["zero"], row["users"], row["total"]) == (3, 2, 2, 3.0)


def test_a_document_twice_in_one_batch_counts_once(spark, tmp_path):
    schema = "doc_id long, text string, arrived int"
    spark.createDataFrame([(1, "old one\nsecond", 1), (1, "new", 2), (2, "x", 1), (2, "x", 1), (3, None, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    mark = lambda d: d.withColumn("kind", F.lit("note"))
    jobs.ingest(stream, str(tmp_path / "files"), str(tmp_path / "paras"), str(tmp_path / "cp"), order="arrived", enrich=mark).awaitTermination()
    paras = spark.read.parquet(str(tmp_path / "paras"))
    assert sorted(r["content"] for r in paras.collect()) == ["new", "x"]
    files = spark.read.parquet(str(tmp_path / "files"))
    assert files.count() == 3 and {(r["kind"], r["arrived"]) for r in files.collect()} == {("note", 1), ("note", 2)}


def test_state_counts_and_expires(spark, tmp_path):
    from docloom.streaming import state

    rows = spark.createDataFrame([("k", f"d{i % 50}") for i in range(400)] + [("j", "a"), (None, "a"), ("j", None)], "recurrence_key string, file_key string")
    out = state.streamed(rows, state.recurrence_counts, "test", files=5)
    last = {r["recurrence_key"]: (r["documents"], r["promoted"]) for r in out.orderBy("documents").collect()}
    assert last == {"k": (50, True), "j": (1, False)}
    at = lambda day: f"2024-01-{day:02d} 00:00:00"
    days = [[(1, "a", at(1)), (2, "a", at(1)), (2, "b", at(1))], [(1, "a", at(2)), (1, "b", at(3))], [(3, "z", at(28))], [(3, "z", at(29))], [(3, "y", at(30))]]
    schema = "doc_id long, content_hash string, at string"
    for i, d in enumerate(days):
        spark.createDataFrame(d, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withColumn("at", F.to_timestamp("at"))
    seen = []
    q = state.document_versions(stream, "10 days", "1 hour").writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend((r["doc_id"], r["version"], r["content_hash"], r["change"]) for r in df.collect()))
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(x for x in seen if x[0] == 1) == [(1, 1, "a", "new"), (1, 2, "b", "changed"), (1, 2, "b", "missing")]
    assert sorted(x for x in seen if x[0] == 2) == [(2, 1, "b", "missing"), (2, 1, "b", "new")]
    assert [x for x in seen if x[0] == 3] == [(3, 1, "z", "new"), (3, 2, "y", "changed")]


def test_counts_run_without_python_and_versions_without_row_loops(spark, tmp_path):
    """Many files in few batches; documents of one key are dealt out; versions equal the plain loop."""
    import random

    from docloom.streaming import state

    rows = spark.range(4000).selectExpr("'k' AS recurrence_key", "concat('d', id % 900) AS file_key").repartition(9)
    out = state.streamed(rows, state.recurrence_counts, "counts", files=3)
    got = {r["batch_no"]: r["documents"] for r in out.collect()}
    assert len(got) == 3 and max(got.values()) == 900
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path))
    assert "InPandas" not in state.recurrence_counts(stream)._jdf.queryExecution().analyzed().toString()
    rng = random.Random(1)
    events = [(d, rng.choice("abc"), f"2024-01-{rng.randint(1, 28):02d} 0{rng.randint(0, 3)}:00:00.{rng.randint(0, 1)}005") for d in range(6) for _ in range(rng.choice([1, 2, 80]))]
    table = spark.createDataFrame(events, "doc_id long, content_hash string, at string").withColumn("at", F.to_timestamp("at")).repartition(5)
    out = state.streamed(table, lambda s: state.document_versions(s, "36500 days", "36500 days"), "loop", files=1)
    want = set()
    for d in range(6):
        newest, held, version = {}, None, 0
        for _, h, at in sorted(e for e in events if e[0] == d):
            newest[at] = max(h, newest.get(at, ""))
        for at in sorted(newest):
            if newest[at] != held:
                version, held = version + 1, newest[at]
                want.add((d, version, held, "new" if version == 1 else "changed", f"{at}00"[:26].rstrip("0").rstrip(".")))
    got = {(r["doc_id"], r["version"], r["content_hash"], r["change"], r["t"]) for r in out.withColumn("t", F.col("at").cast("string")).collect()}
    assert got == want
