"""Queries that write the given tables in a format of their own and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import extraction as X
from docloom.plans.registry import query
from docloom.sources import readers, writers
from docloom.sources.scratch import new_path


@query("log_round_trip", "SELECT id, kw, result_count FROM fx_query_log")
def log_round_trip(c):
    """The query log appended in two parts, with broken lines of every document between them."""
    path = new_path(c.spark, "log")
    for part in (0, 1):
        writers.append_log(c.query_log.filter(F.col("id") % 2 == part), path)
    broken = c.documents.select(F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "kw": "')).alias("value"))
    broken.write.mode("append").text(path)
    return readers.json_lines(c.spark, path, "id long, kw string, result_count int")


@query("csv_round_trip", "SELECT file_key, filename, ctype, lang, char_count, coalesce(error_reason, '-') AS error_reason, content_hash FROM fx_files")
def csv_round_trip(c):
    """The catalog as CSV with a fixed order of columns."""
    path = new_path(c.spark, "csv")
    columns = ["file_key", "filename", "ctype", "lang", "char_count", "error_reason", "content_hash"]
    writers.write_csv(c.files, columns, path)
    schema = "file_key string, filename string, ctype string, lang string, char_count int, error_reason string, content_hash string"
    return c.spark.read.schema(schema).option("header", True).csv(path).withColumn("error_reason", F.coalesce("error_reason", F.lit("-")))


@query("document_kinds", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ole2' WHEN 1 THEN 'rtf' WHEN 2 THEN 'zip' ELSE 'unknown' END AS kind FROM documents")
def document_kinds(c):
    """Kinds by first bytes; the fourth kind has a header cut short, the fifth none."""
    heads = ["D0CF11E0A1B11AE1", "7B5C727466", "504B0304", "D0CF11E0A1B11A", ""]
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % 5 + 1).cast("int")))
    content = F.concat(head, F.when(F.col("doc_id") % 5 == 3, F.lit(b"\x00")).otherwise(F.lit(b"")), F.coalesce("text", F.lit("")).cast("binary"))
    return c.documents.select("doc_id", readers.document_kind(content).alias("kind"))


_WORD = "regexp_replace(split_part(content, ' ', 2), '[^a-z]', '', 'g')"
_SAID = f"""CASE para % 5 WHEN 0 THEN '"' || {_WORD} || '" means ' || content WHEN 1 THEN 'Shares (the “' || {_WORD} || '”) and ' || content WHEN 2 THEN '"' || {_WORD} || '2" shall mean ' || content WHEN 3 THEN '“ ' || {_WORD} || ' ” shall mean x' ELSE content END"""


@query("defined_terms", f"""WITH s AS (SELECT file_key, para, {_SAID} AS t FROM fx_paragraphs),
 f AS (SELECT file_key, para, coalesce(nullif(trim(regexp_extract(t, '^["“]([^"”]{{1,60}})["”]\\s+(?:means|shall mean)', 1)), ''), nullif(trim(regexp_extract(t, '\\((?:the )?["“]([^"”]{{1,60}})["”]\\)', 1)), '')) AS term FROM s)
 SELECT * FROM f WHERE term IS NOT NULL AND NOT regexp_matches(term, '[0-9]')""")
def defined_terms(c):
    """Terms that paragraphs define: quoted before a meaning, or in brackets; none with digits."""
    word = F.regexp_replace(F.split_part(F.col("content"), F.lit(" "), F.lit(2)), "[^a-z]", "")
    p = F.col("para") % 5
    said = (
        F.when(p == 0, F.concat(F.lit('"'), word, F.lit('" means '), "content")).when(p == 1, F.concat(F.lit("Shares (the “"), word, F.lit("”) and "), "content"))
        .when(p == 2, F.concat(F.lit('"'), word, F.lit('2" shall mean '), "content")).when(p == 3, F.concat(F.lit("“ "), word, F.lit(" ” shall mean x"))).otherwise(F.col("content"))
    )
    return c.paragraphs.select("file_key", "para", X.defined_term(said).alias("term")).filter("term is not null")
