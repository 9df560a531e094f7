"""Catalog, clause and metadata tables derived from the given parquet tables.

They give the operators the columns they work on: file records, paragraphs, clause items,
coverage, candidates, document metadata, answer keys, verdicts and a query log.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERMS = [("alpha", "the", "normal", "en"), ("alpha", "there", "normal", "en"), ("alpha", "whst", "broad", "en"), ("beta", "that", "normal", "en"), ("beta", "this", "normal", "en"), ("gamma", "und", "normal", "de"), ("gamma", "der", "normal", "de"), ("delta", "la", "strict", "fr"), ("delta", "dans", "normal", "fr"), ("omega", "zzzqq", "normal", "en")]
NODES = [("RW", None, "RW", "root rw"), ("RW.A", "RW", "RW", "node a"), ("RW.A.X", "RW.A", "RW", "leaf ax"), ("RW.B", "RW", "RW", "node b"), ("CP", None, "CP", "root cp"), ("CP.A", "CP", "CP", "node a"), ("COV", None, "COV", "root cov"), ("COV.A", "COV", "COV", "cov a"), ("DEF", None, "DEF", "root def"), ("DEF.T", "DEF", "DEF", "term"), ("PAY", None, "PAY", "root pay"), ("REM", None, "REM", "root rem")]
ITEM_RULES = [(1, "there", "RW.A"), (2, "whst", "RW.A.X"), (3, "that", "RW.B"), (4, "this", "CP.A"), (5, "with", "COV.A"), (6, "und", "DEF.T"), (7, "la", "PAY"), (8, "license", "REM")]
FAMILIES = ["RW", "CP", "COV", "DEF", "PAY", "REM"]


def choose(value: Column, options: dict, default=None) -> Column:
    """``options[value]``, as a chain of conditions."""
    out = F.lit(default)
    for k, v in options.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def short_sha(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


class Corpus:
    """The given tables of a folder and the tables derived from them, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def small(self, rows: list, schema: str) -> DataFrame:
        """A parameter table."""
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def terms(self) -> DataFrame:
        return self.small(TERMS, "canonical string, variant string, strength string, lang string")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.small(NODES, "taxonomy_id string, parent_id string, family string, label string")

    @cached_property
    def item_rules(self) -> DataFrame:
        return self.small(ITEM_RULES, "ord int, needle string, taxonomy_id string")

    @cached_property
    def families(self) -> DataFrame:
        return self.small(list(enumerate(FAMILIES)), "k int, family string")

    @cached_property
    def _files(self) -> DataFrame:
        d = F.col("doc_id")
        m8 = d % 8
        name = choose(m8, {0: "SPA_signed_20210904_", 1: "SPA_buyer draft_", 2: "SHA_seller draft_", 3: "SSA_2nd markup_", 4: "MOU_final draft_", 5: "ATA_bidding_", 6: "SPA_Buyer 1st markup_"}, "notes_")
        return self.documents.select(
            d,
            short_sha(F.concat(F.lit("doc"), d.cast("string"))).alias("file_key"),
            F.concat(name, d.cast("string"), F.lit(".docx")).alias("filename"),
            F.col("source").alias("folder"),
            "lang",
            F.col("n_chars").cast("int").alias("char_count"),
            choose(d % 50, {49: "empty", 48: "error", 47: "missing"}, "ok").alias("status"),
            choose(d % 50, {49: "pdf_text_empty", 48: "corrupt_docx"}).alias("error_reason"),
            F.when(d % 10 < 3, "pilot_001").otherwise("full_001").alias("batch_label"),
            choose(m8, {7: "unclassified", 2: "SHA", 3: "SSA", 4: "MOU", 5: "ATA/BTA"}, "SPA").alias("ctype"),
            choose(m8, {1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 0: 0}).alias("is_draft"),
            F.when(m8 == 0, "final").alias("version_hint"),
            choose(m8, {0: "execution", 1: "buyer_draft", 2: "seller_draft", 3: "markup_unknown", 4: "execution", 5: "bidding", 6: "buyer_markup"}, "unknown").alias("version_role"),
            choose(m8, {0: "high", 1: "high", 2: "high", 3: "med", 4: "low", 5: "high", 6: "high"}).alias("version_confidence"),
            short_sha(F.col("text")).alias("content_hash"),
            "text",
        )

    @cached_property
    def files(self) -> DataFrame:
        from docloom.operators.catalog import duplicate_groups

        return duplicate_groups(self._files.drop("text").withColumn("path", F.concat_ws("/", "folder", "filename")))

    @cached_property
    def texts(self) -> DataFrame:
        """Whole texts of readable documents by the key of their file: no join is needed."""
        return self._files.filter("status = 'ok'").select("file_key", "doc_id", "text")

    @cached_property
    def placed(self) -> DataFrame:
        """Paragraphs beside columns of their file, which come with the text: no join is needed."""
        ok = self._files.filter("status = 'ok'")
        return ok.select("file_key", "doc_id", "content_hash", F.posexplode(F.split("text", "\n")).alias("para", "content")).withColumn("para", F.col("para") + 1)

    @cached_property
    def paragraphs(self) -> DataFrame:
        """Numbered by their place in the text; empty ones keep their number."""
        return self.placed.select("file_key", "para", "content")

    @cached_property
    def items(self) -> DataFrame:
        return self.items_of(self.placed)

    def items_of(self, rows: DataFrame, *more: str) -> DataFrame:
        """The items of ``rows`` (columns of placed), with the columns ``more`` beside them: what
        depends on a paragraph alone is worked out before its items are dealt out."""
        low = F.col("_low")
        rows = rows.select("*", F.explode(F.array(F.lower("content"))).alias("_low"))  # a generator's column is worked out once, not where it is used
        rule = lambda k, node: F.struct(F.lit(k).alias("ord"), F.lit(node).alias("taxonomy_id"))
        met = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(needle.lower())), rule(k, node)) for k, needle, node in ITEM_RULES]))
        hit = rows.withColumn("_met", met).withColumn("_rule", F.explode("_met")).select("*", "_rule.*")
        n = F.col("doc_id") + F.col("para")
        return hit.select(
            "file_key",
            "doc_id",
            "taxonomy_id",
            F.substring_index("taxonomy_id", ".", 1).alias("family"),
            F.concat_ws("-", "file_key", F.col("para").cast("string"), F.col("ord").cast("string")).alias("item_ref"),
            F.col("content").alias("verbatim"),
            F.col("para").alias("loc_start"),
            (F.col("para") + F.col("doc_id") % 3).cast("int").alias("loc_end"),
            choose(n % 4, {0: "affirmative", 1: "negative", 2: "none_exist"}, "not_applicable").alias("statement_polarity"),
            F.when(F.col("doc_id") % 20 == 0, "stale").otherwise(F.col("content_hash")).alias("txt_hash"),
            F.when(n % 9 == 0, "pending").when(n % 9 == 4, "needs_review").otherwise("approved").alias("review_status"),
            *more,
        )

    @cached_property
    def document_coverage(self) -> DataFrame:
        n = F.col("doc_id") + F.col("k")
        pairs = self._files.drop("text").filter("status = 'ok'").crossJoin(F.broadcast(self.families)).filter(n % 11 != 0)
        return pairs.select("file_key", "family", choose(n % 5, {0: "partial", 1: "not_evaluated"}, "complete").alias("body_status"), choose(F.col("doc_id") % 3, {0: "no_annex", 1: "complete"}, "partial").alias("annex_status"), F.when(F.col("doc_id") % 17 == 0, "stale").otherwise(F.col("content_hash")).alias("txt_hash"))

    @cached_property
    def source_coverage(self) -> DataFrame:
        d = F.col("doc_id")
        nexts = self._files.select((d - 1).alias("doc_id"), F.col("content_hash").alias("next_hash"))
        own = self._files.drop("text").filter("status = 'ok' and doc_id % 3 <> 0").join(nexts, "doc_id", "left").crossJoin(F.broadcast(self.families))
        return own.select(
            "file_key",
            "family",
            F.concat(F.lit("src-"), d.cast("string")).alias("source_id"),
            F.lit("schedule").alias("source_kind"),
            F.when(d % 3 == 1, "complete").otherwise("partial").alias("status"),
            F.when(d % 2 == 1, short_sha(F.concat(F.lit("doc"), (d + 1).cast("string")))).alias("storage_file_key"),
            F.when(d % 13 == 0, "stale").when(d % 2 == 1, F.coalesce("next_hash", F.lit(""))).otherwise(F.col("content_hash")).alias("txt_hash"),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        return self.candidates_of(self.placed)

    def candidates_of(self, rows: DataFrame, *more: str) -> DataFrame:
        """The candidates of ``rows`` (columns of placed), with the columns ``more`` beside them."""
        rows = rows.join(F.broadcast(self.families), F.col("k") == F.col("doc_id") % 6)
        parent = F.when(F.col("doc_id") % 7 == 0, F.concat("family", F.lit(".A"))).otherwise(F.col("family"))
        return rows.select((F.col("doc_id") * 1000000 + F.col("para")).alias("candidate_id"), F.col("file_key").alias("evidence_file_key"), "family", parent.alias("recommended_parent_id"), F.col("content").alias("verbatim"), F.substring("content", 1, 12).alias("proposed_ko"), F.col("para").alias("loc_start"), F.lit("pending").alias("status"), F.lit(1).alias("document_count"), *more)

    @cached_property
    def doc_meta(self) -> DataFrame:
        d = F.col("doc_id")
        law = F.when(d % 9 == 0, "").otherwise(',"law":{"present":true,"loc_start":2,"loc_end":2}')
        amount = F.concat(F.lit('{"evaluated":true,"amount_value":'), (F.col("char_count").cast("long") * 1000000).cast("string"), F.lit(',"payment_methods":["cash"],"currency":"KRW","confidence":"high"}'))
        return self.files.filter("status = 'ok' and doc_id % 4 <> 0").select(
            "file_key",
            F.when(d % 4 == 1, 2).otherwise(3).alias("meta_schema_version"),
            F.when(d % 19 == 0, "stale").otherwise(F.col("content_hash")).alias("txt_hash"),
            choose(d % 3, {0: "high", 1: "med"}, "low").alias("confidence"),
            F.when(d % 5 == 0, '{"evaluated":false}').otherwise(F.concat(F.lit('{"evaluated":true,"items":[{"name":"'), F.col("folder"), F.lit('","role":"buyer"}]}'))).alias("parties_json"),
            F.when(d % 6 == 0, '{"evaluated":true,"amount_value":null}').otherwise(amount).alias("consideration_json"),
            F.concat(F.lit('{"indemnity":{"present":'), F.when(d % 4 == 2, "true").otherwise("false"), F.lit(',"loc_start":1,"loc_end":2}'), law, F.lit("}")).alias("clause_map_json"),
        )

    @cached_property
    def answer_key(self) -> DataFrame:
        from docloom.operators.search import containing

        docs = self._files.filter("status = 'ok'").select("file_key", F.col("text").alias("content"))
        hits = containing(docs, self.table("benchmark").select(F.col("item_id").alias("gt_id"), F.col("text").alias("needle")), fold=False)
        return hits.select("gt_id", "file_key", F.col("needle").alias("verbatim"))

    @cached_property
    def verdicts(self) -> DataFrame:
        return self.table("labels").join(self.files.select("doc_id", "file_key"), "doc_id").select("file_key", F.when(F.col("quality") == 1, "correct").otherwise("incorrect").alias("verdict"))

    @cached_property
    def query_log(self) -> DataFrame:
        first = F.regexp_replace(F.substring_index("text", " ", 1), "[^a-zA-Z]", "")
        return self.table("conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.lower(first).alias("kw"), ((F.col("conv_id") + F.col("turn")) % 4).cast("int").alias("result_count"))
