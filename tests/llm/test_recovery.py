"""Repeated attempts, hot rows and other things that only show on a cluster."""

import zlib

from pyspark.sql import functions as F

from docloom.llm import mixing, warc


def test_archives_of_a_lost_attempt_do_not_count(spark, tmp_path):
    """The writer runs twice into one folder, with other row orders and file sizes; each
    manifest gives exactly the pages."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 7}</p>" * 50) for i in range(60)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    first = warc.write_warc(pages.repartition(3), path, roll=400)
    second = warc.write_warc(pages.orderBy(F.desc("page_id")).repartition(3), path, roll=900)
    for made in (first, second):
        got = warc.read_warc(spark, path, manifest=made).filter("kind = 'record'")
        assert sorted(r[0] for r in got.select("record_id").collect()) == sorted(f"urn:page:{i}" for i in range(60))
    assert warc.read_warc(spark, path).filter("kind = 'record'").count() == 120


def test_one_document_with_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "one").otherwise("rest").alias("source"))
    got = mixing.mix_sources(docs).filter("source = 'one'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("copy").alias("d"), F.max("copy").alias("m"), F.max("n_copies").alias("k")).collect()
    assert len(got) == 1 and got[0]["n"] == got[0]["d"] == got[0]["k"] == got[0]["m"] + 1 and 29_000 < got[0]["n"] < 31_000
    dealt = mixing._copies(spark.createDataFrame([(7, 5000)], "_id long, n_copies long"), 5000.0)
    tasks = dealt.select(F.spark_partition_id().alias("p"), "copy").groupBy("p").count().collect()
    assert sum(r["count"] for r in tasks) == 5000 and len(tasks) > 1


def test_a_very_long_page(spark, tmp_path):
    body = "long é " * 700_000
    pages = spark.createDataFrame([(1, "http://h/1", body), (2, "http://h/2", None), (3, "http://h/3", body)], "page_id long, url string, html string")
    made = warc.write_warc(pages, str(tmp_path / "w"))
    got = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w"), manifest=made).filter("kind = 'record'").collect()}
    assert got["urn:page:3"]["type"] == "response" and got["urn:page:1"]["type"] == "revisit" and got["urn:page:2"]["payload_bytes"] == 0
    assert zlib.crc32(bytes(got["urn:page:3"]["payload"])) == zlib.crc32(body.encode())
