"""Structure of paragraphs: headings, ranges, windows, references and deal facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def is_toc_line(text: Column) -> Column:
    """A table-of-contents line: dot leaders or a page number after a short title."""
    return text.rlike(r"\.{3,}") | (text.rlike(r"\s\d{1,3}$") & (F.length(text) < 80))


def is_heading(text: Column) -> Column:
    """A short line of few words that does not end like a sentence, or a numbered title."""
    short = (F.length(text) < 60) & (F.size(F.split(F.trim(text), r"\s+")) <= 6) & ~text.rlike(r"[.;:,]$")
    return (F.trim(text) != "") & (short | text.rlike(r"^(Article|Section|\d+\.)\s"))


def placeholder(text: Column) -> Column:
    """First unresolved bracket or blank of a form, or null."""
    return F.nullif(F.regexp_extract(text, r"(\[[^\]]{0,40}\]|_{3,}|\{[^}]{0,40}\})", 1), F.lit(""))


def split_body(paragraphs: DataFrame) -> DataFrame:
    """Flags header and footer paragraphs."""
    return paragraphs.withColumn("part", F.when(F.col("content").rlike(r"^\[(header|footer)\]"), "margin").otherwise("body"))


def heading_ranges(paragraphs: DataFrame, heading: Column) -> DataFrame:
    """Range of each heading: up to the paragraph before the next heading or the document's end."""
    w = W.partitionBy("file_key")
    marked = paragraphs.withColumn("_h", heading).withColumn("_last", F.max("para").over(w)).filter("_h")
    return marked.withColumn("to_para", F.coalesce(F.lead("para").over(w.orderBy("para")) - 1, F.col("_last"))).select("file_key", F.col("para").alias("from_para"), "to_para", "content")


def family_ranges(paragraphs: DataFrame, family: Column, gap: int = 1) -> DataFrame:
    """Paragraphs of a family and what follows up to the next boundary of another family;
    neighbouring ranges of one family are merged.

    ``family`` names the family whose heading a paragraph is, else null.
    """
    w = W.partitionBy("file_key").orderBy("para")
    heads = paragraphs.withColumn("family", family).withColumn("_last", F.max("para").over(W.partitionBy("file_key"))).filter("family is not null")
    heads = heads.withColumn("to_para", F.coalesce(F.lead("para").over(w) - 1, F.col("_last")))
    f = W.partitionBy("file_key", "family").orderBy("para")
    fresh = F.when(F.col("para") <= F.lag("to_para").over(f) + gap, 0).otherwise(1)
    islands = heads.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(f))
    return islands.groupBy("file_key", "family", "_island").agg(F.min("para").alias("from_para"), F.max("to_para").alias("to_para")).drop("_island")


def capped_ranges(starts: DataFrame, paragraphs: DataFrame, cap: int) -> DataFrame:
    """Range from each start to the next start, at most ``cap`` paragraphs and within the document."""
    last = paragraphs.groupBy("file_key").agg(F.max("para").alias("_last"))
    w = W.partitionBy("file_key").orderBy("para")
    rows = starts.join(last, "file_key").withColumn("_next", F.lead("para").over(w))
    return rows.select("file_key", F.col("para").alias("from_para"), F.least(F.coalesce(F.col("_next") - 1, F.col("_last")), F.col("para") + cap - 1, F.col("_last")).alias("to_para"))


def context_window(paragraphs: DataFrame, hit: Column, before: int, after: int) -> DataFrame:
    """First hit of each document with the paragraphs around it, in order, joined by ' / '."""
    first = paragraphs.filter(hit).groupBy("file_key").agg(F.min("para").alias("hit"))
    near = paragraphs.join(first, "file_key").filter((F.col("para") >= F.col("hit") - before) & (F.col("para") <= F.col("hit") + after))
    parts = F.array_sort(F.collect_list(F.struct("para", "content")))
    return near.groupBy("file_key", "hit").agg(F.array_join(F.transform(parts, lambda x: x["content"]), " / ").alias("context"))


def find_clause(paragraphs: DataFrame, anchor: Column, operative: str, forward: int = 3) -> DataFrame:
    """Best anchor paragraph of each document with the text around it (two before, ``forward``
    after): outside the contents before inside, then with operative text before without."""
    w = W.partitionBy("file_key").orderBy("para")
    rows = paragraphs.withColumn("_before", F.array_join(F.collect_list("content").over(w.rowsBetween(-2, -1)), " ")).withColumn("_after", F.array_join(F.collect_list("content").over(w.rowsBetween(0, forward)), " "))
    rows = rows.filter(anchor).withColumn("_op", F.contains(F.lower("_after"), F.lit(operative))).withColumn("_toc", is_toc_line(F.col("content")))
    level = F.when(~F.col("_toc") & F.col("_op"), 1).when(~F.col("_toc"), 2).when(F.col("_op"), 3).otherwise(4)
    best = rows.withColumn("level", level).groupBy("file_key").agg(F.min_by(F.struct("para", "level", "_before", "_after"), F.struct("level", "para")).alias("b"))
    return best.select("file_key", "b.para", "b.level", F.md5(F.concat_ws(" | ", "b._before", "b._after")).alias("window_key"))


def toc_titles(paragraphs: DataFrame, known: DataFrame) -> DataFrame:
    """Recognised titles (known: title) of each document's contents; two are needed to believe it."""
    rows = paragraphs.filter(is_toc_line(F.col("content"))).withColumn("title", F.trim(F.regexp_replace(F.lower("content"), r"[.\s]*\d*$", "")))
    return rows.join(known, "title", "left_semi").groupBy("file_key").agg(F.array_sort(F.collect_set("title")).alias("titles")).filter("size(titles) >= 2")


def annex_headers(paragraphs: DataFrame, header: Column, cap: int = 250) -> DataFrame:
    """Schedules of a document: header paragraph, its normalised name and its range."""
    w = W.partitionBy("file_key").orderBy("para")
    rows = paragraphs.withColumn("_last", F.max("para").over(W.partitionBy("file_key"))).filter(header)
    rows = rows.withColumn("to_para", F.least(F.coalesce(F.lead("para").over(w) - 1, F.col("_last")), F.col("para") + cap))
    return rows.select("file_key", F.col("para").alias("from_para"), "to_para", F.trim(F.lower("content")).alias("name"))


def annex_references(paragraphs: DataFrame, headers: DataFrame, pattern: str) -> DataFrame:
    """References (first group of ``pattern``) and the first header that holds their name; a
    reference without one falls to the document's only header, if there is exactly one."""
    refs = paragraphs.select("file_key", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(pattern), 1)).alias("ref")).distinct()
    found = refs.join(headers, "file_key").filter(F.contains("name", F.col("ref"))).groupBy("file_key", "ref").agg(F.min("from_para").alias("at"))
    only = headers.groupBy("file_key").agg(F.count(F.lit(1)).alias("_n"), F.min("from_para").alias("_at")).filter("_n = 1")
    out = refs.join(found, ["file_key", "ref"], "left").join(only, "file_key", "left")
    return out.select("file_key", "ref", F.coalesce("at", "_at").alias("at"), F.when(F.col("at").isNotNull(), "matched").when(F.col("_at").isNotNull(), "folded").otherwise("missing").alias("state"))


def source_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("disclosure")), "disclosure").when(F.contains(low, F.lit("schedule")), "schedule").when(F.contains(low, F.lit("annex")) | F.contains(low, F.lit("exhibit")), "annex").otherwise("other")


def deal_year(files: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """value, confidence and basis of each document's year.

    Ordered sources: a signature block (the last twelve paragraphs) with a date, an execution
    sentence among the first forty, a bare year among the first three, a YYYYMMDD in the file
    name, the latest year in a header or footer, a YYMMDD in the file name.  Without any the
    year is 'unknown'.  Headers and footers count for their own source only.
    """
    year = r"\b((?:19|20)\d{2})\b"
    last = F.max("para").over(W.partitionBy("file_key"))
    p = split_body(paragraphs.withColumn("_last", last)).withColumn("_year", F.nullif(F.regexp_extract("content", year, 1), F.lit("")))
    body = F.col("part") == "body"
    where = lambda cond: F.min_by(F.when(body & cond, F.col("_year")), F.when(body & cond & F.col("_year").isNotNull(), F.col("para")))
    by_text = p.filter("_year is not null").groupBy("file_key").agg(
        where((F.col("para") > F.col("_last") - 12) & F.col("content").rlike("(?i)signed|executed")).alias("signature"),
        where((F.col("para") <= 40) & F.col("content").rlike("(?i)dated|entered into")).alias("execution"),
        where(F.col("para") <= 3).alias("preamble"),
        F.max(F.when(~body, F.array_max(F.regexp_extract_all("content", F.lit(year), 1)))).alias("margin"),
    )
    long, short = F.regexp_extract("filename", r"(?:^|[^0-9])((?:19|20)\d{2})(?:0[1-9]|1[0-2])(?:[0-2]\d|3[01])(?:[^0-9]|$)", 1), F.regexp_extract("filename", r"(?:^|[^0-9])(\d{2})(?:0[1-9]|1[0-2])(?:[0-2]\d|3[01])(?:[^0-9]|$)", 1)
    rows = files.join(by_text, "file_key", "left").withColumn("_long", F.nullif(long, F.lit(""))).withColumn("_short", F.when(short != "", F.concat(F.lit("20"), short)))
    order = [("signature", "high"), ("execution", "high"), ("preamble", "med"), ("_long", "med"), ("margin", "low"), ("_short", "low")]
    basis, level = F.lit("none"), F.lit("low")
    for name, conf in reversed(order):
        basis = F.when(F.col(name).isNotNull(), name.strip("_")).otherwise(basis)
        level = F.when(F.col(name).isNotNull(), conf).otherwise(level)
    return rows.select("file_key", F.coalesce(*[F.col(n) for n, _ in order], F.lit("unknown")).alias("value"), level.alias("confidence"), basis.alias("basis"))


def single_value(paragraphs: DataFrame, operative: Column, vocabulary: DataFrame) -> DataFrame:
    """The one word of the vocabulary (word, value) that a document's operative sentences name:
    several make it unknown (with the conflict listed), none make it unknown too."""
    from docloom.functions.text import matches

    sentences = paragraphs.filter(operative).select("file_key", F.explode(F.split("content", r"(?<=[.!?])\s+")).alias("s"))
    hit = sentences.join(F.broadcast(vocabulary), matches(F.col("s"), F.col("word"))).groupBy("file_key").agg(F.array_sort(F.collect_set("value")).alias("vs"))
    docs = paragraphs.select("file_key").distinct().join(hit, "file_key", "left")
    n = F.coalesce(F.size("vs"), F.lit(0))
    return docs.select("file_key", F.when(n == 1, F.col("vs")[0]).otherwise("unknown").alias("value"), F.when(n == 1, "high").otherwise("low").alias("confidence"), F.when(n > 1, F.array_join("vs", "|")).otherwise("").alias("conflicts"))
