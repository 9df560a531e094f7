"""Queries whose transformations also run on streams; tests hold stream and batch together."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.plans.registry import query
from docloom.streaming import jobs as J


@query("log_windows", "SELECT time_bucket(INTERVAL '1 hour', ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL '1 hour', ts::TIMESTAMP, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS \"end\", event_type, count(*)::BIGINT AS n, count(*) FILTER (coalesce(value, 0) = 0)::BIGINT AS zero, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def log_windows(c):
    return J.log_windows(c.table("events")).drop("users").withColumn("total", F.round("total", 4))


@query("distinct_recent", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_recent(c):
    return J.distinct_recent(c.table("events"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("ingested_documents", "WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\x00-\\x20\\x7F]+', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents) SELECT doc_id, substr(sha256('doc' || doc_id), 1, 16) AS file_key, substr(sha256(array_to_string(ps, chr(10))), 1, 16) AS content_hash, length(text)::INTEGER AS char_count, CASE WHEN len(ps) > 0 THEN 'ok' ELSE 'empty' END AS status FROM p")
def ingested_documents(c):
    return J.document_rows(c.documents)


_LOG = "l AS (SELECT lower(regexp_replace(split_part(text, ' ', 1), '[^a-zA-Z]', '', 'g')) AS kw, CAST((conv_id + turn) % 4 AS INT) AS result_count, 1700000000 + conv_id * 600 + turn * 20 AS s FROM conversations WHERE role = 'user'), k AS (SELECT l.*, kw IN (SELECT lower(variant) FROM fx_term) AS known FROM l)"


def _log(c):
    at = F.timestamp_seconds(F.lit(1700000000) + F.floor(F.col("id") / 100) * 600 + F.col("id") % 100 * 20)
    return c.query_log.withColumn("ts", at)


@query("query_log_windows", f"WITH {_LOG} SELECT make_timestamp((s // 3600) * 3600000000) AS start, count(*)::BIGINT AS n, count(*) FILTER (result_count = 0)::BIGINT AS zero, round(count(*) FILTER (result_count = 0)::DOUBLE / count(*), 4) AS zero_rate, count(*) FILTER (kw <> '' AND NOT known)::BIGINT AS unknown, count(*) FILTER (kw <> '' AND known AND result_count = 0)::BIGINT AS known_zero FROM k GROUP BY s // 3600")
def query_log_windows(c):
    return J.query_log_windows(_log(c), c.terms)


@query("query_log_terms", f"WITH {_LOG} SELECT kw, known, count(*)::BIGINT AS n, count(*) FILTER (result_count = 0)::BIGINT AS zero, round(avg(result_count), 4) AS mean_results FROM k WHERE kw <> '' GROUP BY ALL")
def query_log_terms(c):
    return J.query_log_terms(c.query_log, c.terms)


@query("streamed_recurrence", """SELECT family || ':' || recommended_parent_id AS recurrence_key, count(DISTINCT evidence_file_key)::BIGINT AS documents, count(DISTINCT evidence_file_key) >= 2 AS promoted FROM fx_candidate GROUP BY 1""")
def streamed_recurrence(c):
    """The candidates arrive as a stream; the last count of each key stays."""
    from docloom.streaming import state

    rows = c.candidates.select(F.concat_ws(":", "family", "recommended_parent_id").alias("recurrence_key"), F.col("evidence_file_key").alias("file_key"))
    out = state.streamed(rows, state.recurrence_counts, "recurrence")
    return out.groupBy("recurrence_key").agg(F.max("documents").alias("documents"), F.max_by("promoted", "documents").alias("promoted"))


@query("streamed_versions", """WITH s AS (SELECT user_id AS doc_id, substr(event_type, 1, 4) AS content_hash, ts::TIMESTAMP AS t FROM events), n AS (SELECT doc_id, t, max(content_hash) AS content_hash FROM s GROUP BY ALL),
 c AS (SELECT *, lag(content_hash) OVER (PARTITION BY doc_id ORDER BY t) AS was FROM n), d AS (SELECT * FROM c WHERE was IS NULL OR was <> content_hash)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY t) AS version, content_hash, CASE WHEN was IS NULL THEN 'new' ELSE 'changed' END AS change FROM d""")
def streamed_versions(c):
    """States of users as versions of documents, arriving in one batch."""
    from docloom.streaming import state

    rows = c.table("events").select(F.col("user_id").cast("long").alias("doc_id"), F.substring("event_type", 1, 4).alias("content_hash"), F.col("ts").cast("timestamp").alias("at"))
    out = state.streamed(rows, lambda s: state.document_versions(s, "36500 days", "36500 days"), "versions", files=1)
    return out.select("doc_id", "version", "content_hash", "change")
