"""Incremental and streaming upkeep.  The transformations take streams and tables alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.functions.text import paragraphs_of, short_hash


def document_rows(docs: DataFrame) -> DataFrame:
    """Records of arriving documents (doc_id, text): key, content hash, size and state."""
    parts = paragraphs_of(F.col("text"))
    return docs.select("doc_id", short_hash(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("file_key"), short_hash(F.array_join(parts, "\n")).alias("content_hash"), F.coalesce(F.length("text"), F.lit(0)).alias("char_count"), F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, "ok").otherwise("empty").alias("status"))


def document_paragraphs(docs: DataFrame) -> DataFrame:
    key = short_hash(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("file_key")
    return docs.select(key, F.posexplode(paragraphs_of(F.col("text"))).alias("para", "content")).select("file_key", (F.col("para") + 1).alias("para"), "content")


def one_per_document(batch: DataFrame, order: str | None = None) -> DataFrame:
    """Of the rows of a doc_id the one with the largest ``order`` (a column), ties by text."""
    by = F.struct(*([F.col(order)] if order else []), F.coalesce("text", F.lit("")))
    row = F.struct(*[F.col(c) for c in batch.columns])
    return batch.groupBy("doc_id").agg(F.max_by(row, by).alias("r")).select("r.*")


def ingest(stream: DataFrame, files_path: str, paragraphs_path: str, checkpoint: str, order: str | None = None, enrich: Callable[[DataFrame], DataFrame] | None = None):
    """File-source stream into two tables.  Each micro-batch writes a folder of its own number, so
    a batch that is run again replaces what it wrote; readers take the newest row of a key.  A
    document that comes twice in one batch counts once: the row with the largest ``order``.

    ``enrich`` adds columns to the documents before they are recorded (type, language, version);
    they are kept beside the record's own.
    """

    def write(batch: DataFrame, number: int) -> None:
        once = one_per_document(batch, order).persist()
        records = document_rows(once)
        if enrich is not None:
            records = records.join(enrich(once).drop(*[c for c in records.columns if c != "doc_id"], "text"), "doc_id", "left")
        records.withColumn("batch_no", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{files_path}/batch={number:09d}")
        document_paragraphs(once).withColumn("batch_no", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{paragraphs_path}/batch={number:09d}")
        once.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(table: DataFrame, key: str) -> DataFrame:
    """The rows of each key's newest batch."""
    last = table.groupBy(key).agg(F.max("batch_no").alias("batch_no"))
    return table.join(last, [key, "batch_no"], "left_semi").drop("batch_no", "batch")


def log_windows(log: DataFrame, size: str = "1 hour", late: str = "2 hours", kind: str = "event_type") -> DataFrame:
    """Per time window and kind: entries, those with value zero or none, users and sum of values.
    Entries later than ``late`` are dropped from a stream."""
    return (
        log.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", size), kind)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("value", F.lit(0.0)) == 0).alias("zero"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n", "zero", "users", "total")
    )


def with_known(log: DataFrame, terms: DataFrame) -> DataFrame:
    """Entries of a query log (kw, result_count) with whether the term list (variant) has the
    keyword, whatever the case."""
    known = terms.select(F.lower("variant").alias("_kw")).distinct().withColumn("_known", F.lit(True))
    return log.join(known, F.lower("kw") == F.col("_kw"), "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_kw", "_known")


def query_log_windows(log: DataFrame, terms: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per time window of a query log (ts, kw, result_count): entries, those without a result and
    their share, entries with an unknown keyword, and known ones without a result.  An empty
    keyword is neither.  Entries later than ``late`` are dropped from a stream."""
    named = F.coalesce("kw", F.lit("")) != ""
    zero = F.coalesce(F.col("result_count") == 0, F.lit(False))
    rows = with_known(log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), terms)
    out = rows.groupBy(F.window("ts", size)).agg(F.count(F.lit(1)).alias("n"), F.count_if(zero).alias("zero"), F.count_if(named & ~F.col("known")).alias("unknown"), F.count_if(named & F.col("known") & zero).alias("known_zero"))
    return out.select(F.col("window.start").alias("start"), "n", "zero", F.round(F.col("zero") / F.col("n"), 4).alias("zero_rate"), "unknown", "known_zero")


def query_log_terms(log: DataFrame, terms: DataFrame) -> DataFrame:
    """Per keyword of a query log: whether it is known, entries, those without a result and the
    mean of the results.  A running count: a stream gives it in update or complete mode."""
    rows = with_known(log.filter("kw <> ''"), terms)
    return rows.groupBy("kw", "known").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result_count") == 0).alias("zero"), F.round(F.avg("result_count"), 4).alias("mean_results"))


def distinct_recent(log: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    """First entry of each condition; in a stream within the watermark."""
    marked = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(key) if log.isStreaming else marked.dropDuplicates(key)


def recurrence_state(rows: DataFrame, needed: int = 2) -> DataFrame:
    """Counts the different documents (file_key) of each recurrence_key as they arrive; a row comes
    out whenever a key's count grows, with promoted from ``needed`` documents on.

    The state of a key is its documents up to ``needed`` and the count of batches' new ones, so
    it stays small for a key that everyone uses.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0].split("|")) - {""} if state.exists else set()
        before = len(seen)
        for f in frames:
            for x in f["file_key"]:
                if len(seen) < needed:
                    seen.add(x)
        state.update(("|".join(sorted(seen)),))
        if len(seen) > before:
            yield pd.DataFrame({"recurrence_key": [key[0]], "documents": [len(seen)], "promoted": [len(seen) >= needed]})

    return rows.groupBy("recurrence_key").applyInPandasWithState(update, "recurrence_key string, documents long, promoted boolean", "docs string", "update", GroupStateTimeout.NoTimeout)


def promote_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``recurrence_state`` over a stream until it is exhausted."""
    return recurrence_state(stream).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
