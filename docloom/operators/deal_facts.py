"""Governing law, forum and industry of a document, read from the clause that settles them.

'Unknown' is a value with a rule that says why; it is never dropped or guessed.  Vocabularies
are parameters: lists of literal words, compared without case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators.structure import is_toc_line, placeholder, split_body


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(F.lower(text), F.lit(word.lower()))
    return out


def named(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """Sorted names of the vocabulary (name to words) that stand in the text."""
    found = F.array(*[F.when(any_of(text, words), name) for name, words in sorted(vocabulary.items())])
    return F.filter(found, lambda x: x.isNotNull())


def distinct_matches(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)))


def clause_text(paragraphs: DataFrame, anchors: list[str], operative: list[str], skip: list[str] | None = None, forward: int = 3) -> DataFrame:
    """The clause of each document: file_key, para, clause (the anchor's paragraph and the next
    ``forward``), and settled (not a line of the contents, and an operative word stands there).

    Outside the contents before inside, then with an operative word before without, then the
    first.  Headers and footers are left out, and so are anchors that follow a ``skip`` word
    within two paragraphs.
    """
    w = W.partitionBy("file_key").orderBy("para")
    joined = lambda lo, hi: F.array_join(F.collect_list("content").over(w.rowsBetween(lo, hi)), " ")
    rows = split_body(paragraphs).filter("part = 'body'").withColumns({"before": joined(-2, -1), "clause": joined(0, forward)})
    rows = rows.filter(any_of(F.col("content"), anchors) & ~any_of(F.col("before"), skip or []))
    rows = rows.withColumns({"toc": is_toc_line(F.col("content")), "op": any_of(F.col("clause"), operative)})
    best = F.min_by(F.struct("para", "clause", (~F.col("toc") & F.col("op")).alias("settled")), F.struct("toc", ~F.col("op"), "para"))
    return rows.groupBy("file_key").agg(best.alias("b")).select("file_key", "b.*")


def governing_law(paragraphs: DataFrame, anchors: list[str], operative: list[str], jurisdictions: dict[str, list[str]], skip: list[str] | None = None) -> DataFrame:
    """value, confidence, rule, candidates and conflicts of each document.

    Names are read from the sentences with an operative word only; where no sentence has one,
    from the whole clause at low confidence.  Names elsewhere in the clause are conflicts.
    """
    docs = paragraphs.select("file_key").distinct()
    rows = docs.join(clause_text(paragraphs, anchors, operative, skip), "file_key", "left")
    sentences = F.filter(F.transform(F.split(F.regexp_replace("clause", r"([.。])\s+", "$1\u001f"), "\u001f"), F.trim), lambda s: s != "")
    rows = rows.withColumn("ops", F.filter(sentences, lambda s: any_of(s, operative)))
    # the unit separator keeps a word from reaching over two sentences
    scope = F.when(F.size("ops") > 0, F.array_join("ops", "\u001f")).otherwise(F.col("clause"))
    rows = rows.withColumns({"hits": named(scope, jurisdictions), "all": named(F.col("clause"), jurisdictions)})
    n = F.size("hits")
    rule = (
        F.when(F.col("clause").isNull(), "no_governing_law_clause_found")
        .when(~F.col("settled"), "clause_not_localized")
        .when(placeholder(F.col("clause")).isNotNull(), "placeholder_in_clause")
        .when(n == 0, "jurisdiction_not_named")
        .when(n > 1, "multiple_jurisdictions_in_operative_sentence")
        .otherwise("governing_law_clause")
    )
    rows = rows.withColumn("rule", rule)
    sure, read = F.col("rule") == "governing_law_clause", F.col("rule").isin("governing_law_clause", "jurisdiction_not_named")
    return rows.select(
        "file_key",
        F.when(sure, F.col("hits")[0]).alias("value"),
        F.when(sure & (F.size("ops") > 0), "med").when(sure, "low").alias("confidence"),
        "rule",
        F.when(F.col("rule").startswith("multiple"), F.array_join("hits", "|")).otherwise("").alias("candidates"),
        F.when(read, F.array_join(F.array_except("all", "hits"), "|")).otherwise("").alias("conflicts"),
    )


def forum(paragraphs: DataFrame, court_anchors: list[str], court_operative: list[str], court_pattern: str, arbitration_anchors: list[str], binding: list[str], institutions: dict[str, list[str]], seat_pattern: str, loose_pattern: str | None = None) -> DataFrame:
    """Court, arbitration agreement (a mention is none), institution and seat of each document.

    Each is a fact of its own; court and agreement together leave the type unknown.
    ``loose_pattern`` names a court at low confidence where ``court_pattern`` finds none.
    """
    court = clause_text(paragraphs, court_anchors, court_operative).select("file_key", F.col("clause").alias("c"), F.col("settled").alias("c_ok"))
    arb = clause_text(paragraphs, arbitration_anchors, binding).select("file_key", F.col("clause").alias("a"))
    rows = paragraphs.select("file_key").distinct().join(court, "file_key", "left").join(arb, "file_key", "left")
    loose = F.nullif(F.regexp_extract("c", loose_pattern, 1), F.lit("")) if loose_pattern else F.lit(None).cast("string")
    rows = rows.withColumns({"courts": distinct_matches(F.col("c"), court_pattern), "loose": loose, "agreed": F.coalesce(any_of(F.col("a"), binding), F.lit(False)), "insts": named(F.col("a"), institutions)})
    n, k = F.size("courts"), F.size("insts")
    court_rule = (
        F.when(F.col("c").isNull(), "no_forum_clause_found")
        .when(~F.col("c_ok"), "clause_not_localized")
        .when((n == 0) & placeholder(F.col("c")).isNotNull(), "placeholder_in_clause")
        .when(n == 1, "forum_clause_named_court")
        .when(n > 1, "multiple_courts_named")
        .when(F.col("loose").isNotNull(), "forum_clause_loose_court")
        .otherwise("forum_clause_no_court_named")
    )
    rows = rows.withColumn("court_rule", court_rule)
    rows = rows.withColumn("forum_court", F.when(F.col("court_rule") == "forum_clause_named_court", F.col("courts")[0]).when(F.col("court_rule") == "forum_clause_loose_court", F.col("loose")))
    no_agreement = F.when(F.col("a").isNull(), "no_arbitration_clause").when(~F.col("agreed"), "no_arbitration_agreement")
    has_court = F.col("forum_court").isNotNull()
    return rows.select(
        "file_key",
        F.when(has_court & F.col("agreed"), None).when(F.col("agreed"), "arbitration").when(has_court, "court").alias("forum_type"),
        F.when(has_court & F.col("agreed"), "court_and_arbitration_both_present").when(F.col("agreed"), "arbitration_only").when(has_court, "court_forum_only").otherwise("forum_not_determined").alias("type_rule"),
        "forum_court",
        "court_rule",
        F.col("agreed").alias("arbitration"),
        F.when(F.col("a").isNull(), "no_arbitration_anchor").when(F.col("agreed"), "arbitration_agreement").otherwise("arbitration_mentioned_without_agreement").alias("arbitration_rule"),
        F.when(F.col("agreed") & (k == 1), F.col("insts")[0]).alias("institution"),
        F.coalesce(no_agreement, F.when(k == 1, "arbitration_institution_named").when(k > 1, "multiple_institutions_named").otherwise("institution_not_named")).alias("institution_rule"),
        F.when(F.col("agreed"), F.nullif(F.regexp_extract("a", seat_pattern, 1), F.lit(""))).alias("seat"),
    )


def industry(paragraphs: DataFrame, traps: list[str], shown: int = 4) -> DataFrame:
    """Always unknown, as a contract's words do not tell it; the first ``shown`` of the standard
    phrases that would mislead (in their given order, by case) are reported."""
    flags = [F.coalesce(F.bool_or(F.contains("content", F.lit(t))), F.lit(False)).alias(f"t{i}") for i, t in enumerate(traps)]
    rows = split_body(paragraphs).withColumn("content", F.when(F.col("part") == "body", F.col("content"))).groupBy("file_key").agg(*flags)
    found = F.filter(F.array(*[F.when(F.col(f"t{i}"), t) for i, t in enumerate(traps)]), lambda x: x.isNotNull())
    return rows.select("file_key", F.lit(None).cast("string").alias("value"), F.lit("not_locally_derivable").alias("rule"), F.array_join(F.slice(found, 1, shown), "|").alias("traps"))
