"""Filters and checks on document metadata in which 'not evaluated' is an answer of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAUSES = "map<string,struct<present:boolean,loc_start:int,loc_end:int,summary:string,verbatim:string,confidence:string>>"
PARTIES = "struct<evaluated:boolean,items:array<struct<name:string,role:string>>>"
CONSIDERATION = "struct<evaluated:boolean,amount_value:double,currency:string,payment_methods:array<string>,confidence:string>"
COMMON_TAGS = ["indemnity", "law"]
TYPE_TAGS = {"SPA": ["consideration"], "SHA": ["transfer"]}
#: Review rows shown beside the count of all.
SAMPLE = 100


def parsed(meta: DataFrame) -> DataFrame:
    """Adds clauses, parties and consideration; JSON that does not parse reads as nothing, and a
    number written as text or a boolean is not a number."""
    amount = F.from_json("consideration_json", CONSIDERATION)
    return meta.withColumn("clauses", F.from_json("clause_map_json", CLAUSES)).withColumn("parties", F.from_json("parties_json", PARTIES)).withColumn("consideration", amount)


def clause_rows(meta: DataFrame) -> DataFrame:
    """One row per document and clause tag."""
    return parsed(meta).select("file_key", F.explode("clauses").alias("tag", "clause")).select("file_key", "tag", "clause.*")


def with_clause(files: DataFrame, meta: DataFrame, tag: str) -> DataFrame:
    """Every file with its clause of that tag, if it was evaluated (column clause, else null)."""
    rows = parsed(meta).select("file_key", F.element_at("clauses", tag).alias("clause"), F.col("confidence").alias("meta_confidence"), F.col("txt_hash").alias("meta_hash"))
    return files.join(rows, "file_key", "left")


def clause_filter(files: DataFrame, meta: DataFrame, tag: str, present: bool) -> DataFrame:
    """file_key and answer: match, no_match or needs_review.  Absence needs a rating above low;
    a missing tag is not evaluated."""
    rows = with_clause(files.filter("status = 'ok'"), meta, tag)
    has = F.col("clause.present")
    if present:
        answer = F.when(has.isNull(), "needs_review").when(has, "match").otherwise("no_match")
    else:
        sure = F.coalesce("clause.confidence", "meta_confidence", F.lit("low")) != "low"
        answer = F.when(has.isNull(), "needs_review").when(has, "no_match").when(sure, "match").otherwise("needs_review")
    reason = F.when(answer == "needs_review", F.when(has.isNull(), "not_evaluated").otherwise("low_confidence"))
    return rows.select("file_key", answer.alias("answer"), reason.alias("reason"))


def clause_status(files: DataFrame, meta: DataFrame, tag: str) -> DataFrame:
    """unevaluated, absent or ok, and whether the metadata is older than the text."""
    rows = with_clause(files.filter("status = 'ok'"), meta, tag)
    state = F.when(F.col("clause.present").isNull(), "unevaluated").when(~F.col("clause.present"), "absent").otherwise("ok")
    stale = F.when(F.col("meta_hash").isNotNull(), F.col("meta_hash") != F.col("content_hash"))
    return rows.select("file_key", state.alias("state"), stale.alias("stale"), F.col("clause.loc_start").alias("loc_start"), F.col("clause.loc_end").alias("loc_end"))


def clause_window(status: DataFrame, paragraphs: DataFrame, context: int) -> DataFrame:
    """Paragraphs of the clause's range and ``context`` around it."""
    found = status.filter("state = 'ok'").select("file_key", "loc_start", "loc_end")
    return paragraphs.join(found, "file_key").filter(F.col("para").between(F.col("loc_start") - context, F.col("loc_end") + context)).select("file_key", "para", "content", F.col("para").between(F.col("loc_start"), F.col("loc_end")).alias("inside"))


def tri_state(checks: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Answer and deciding check of an ordered list of three-valued checks: the first that is
    null or false decides, even if a later one would decide otherwise."""
    answer, decided = F.lit("match"), F.lit(None).cast("string")
    for name, check in reversed(checks):
        answer = F.when(check.isNull(), "needs_review").when(~check, "no_match").otherwise(answer)
        decided = F.when(check.isNull() | ~check, name).otherwise(decided)
    return answer, decided


def structured_filter(files: DataFrame, meta: DataFrame, party: str | None = None, role: str | None = None, method: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """file_key, answer and decided_by for filters on parties and consideration, in this order."""
    if least is not None and most is not None and least > most:
        raise ValueError("the least amount is above the most")
    rows = files.filter("status = 'ok'").join(parsed(meta), "file_key", "left")
    people = F.when(F.col("parties.evaluated"), F.col("parties.items"))
    amount = F.when(F.col("consideration.evaluated"), F.col("consideration.amount_value"))
    checks: list[tuple[str, Column]] = []
    if party:
        checks.append(("party", F.exists(people, lambda p: F.contains(F.lower(p["name"]), F.lit(party.lower())))))
    if role:
        checks.append(("role", F.exists(people, lambda p: F.lower(p["role"]) == role.lower())))
    if method:
        checks.append(("method", F.array_contains(F.when(F.col("consideration.evaluated"), F.col("consideration.payment_methods")), method)))
    if least is not None:
        checks.append(("least", amount >= least))
    if most is not None:
        checks.append(("most", amount <= most))
    answer, decided = tri_state(checks)
    return rows.select("file_key", answer.alias("answer"), decided.alias("decided_by"))


NORMALISED = "map<string,struct<present:boolean,normalized:struct<cap_pct_of_price:double,survival_months:double,law:string,forum:string,institution_or_court:string>>>"
#: Clause tags that the facts stand under.
FACT_TAGS = {"indemnity": "indemnity", "warranty": "warranty", "law": "law", "forum": "forum"}


def _within(value: Column, least: float | None, most: float | None) -> Column:
    """Null without a value; a missing bound does not count."""
    return F.when(value.isNotNull(), (value >= least if least is not None else F.lit(True)) & (value <= most if most is not None else F.lit(True)))


def _says(value: Column, query: str) -> Column:
    from docloom.functions.text import unified

    return F.coalesce(F.contains(F.lower(unified(value)), F.lower(unified(F.lit(query)))), F.lit(False))


def facts_filter(
    files: DataFrame, meta: DataFrame, party: str | None = None, role: str | None = None, method: str | None = None, amount: tuple = (None, None), cap_pct: tuple = (None, None),
    survival_months: tuple = (None, None), law: str | None = None, forum: str | None = None, tags: dict[str, str] = FACT_TAGS, version: int = 3,
) -> DataFrame:
    """file_key, answer and decided_by for all filters on extracted facts, in this order.

    ``amount``, ``cap_pct`` and ``survival_months`` are (least, most), either may be None.  One
    party must fit both name and role.  A fact that was not evaluated, or metadata older than
    ``version``, gives needs_review.  The cap counts only for an indemnity that is present; the
    survival is the warranty's, else the indemnity's.
    """
    for name, (least, most) in (("amount", amount), ("cap_pct", cap_pct), ("survival_months", survival_months)):
        if any(x is not None and (isinstance(x, bool) or not isinstance(x, (int, float)) or x < 0) for x in (least, most)):
            raise ValueError(f"{name} takes numbers that are not negative")
        if least is not None and most is not None and least > most:
            raise ValueError(f"the least {name} is above the most")
    rows = files.filter("status = 'ok'").join(parsed(meta).withColumn("facts", F.from_json("clause_map_json", NORMALISED)), "file_key", "left")
    deal = F.when(F.col("consideration.evaluated"), F.col("consideration"))
    fact = lambda tag: F.element_at("facts", tags[tag])
    checks: list[tuple[str, Column]] = [("version", F.when(F.coalesce("meta_schema_version", F.lit(0)) >= version, F.lit(True)))]
    if party is not None or role is not None:
        fits = lambda p: (_says(p["name"], party) if party is not None else F.lit(True)) & (_says(p["role"], role) if role is not None else F.lit(True))
        checks.append(("party", F.exists(F.when(F.col("parties.evaluated"), F.col("parties.items")), fits)))
    if method is not None:
        checks.append(("method", F.exists(deal["payment_methods"], lambda m: _says(m, method))))
    if amount != (None, None):
        checks.append(("amount", _within(deal["amount_value"], *amount)))
    if cap_pct != (None, None):
        checks.append(("cap_pct", _within(F.when(fact("indemnity")["present"], fact("indemnity")["normalized"]["cap_pct_of_price"]), *cap_pct)))
    if survival_months != (None, None):
        checks.append(("survival_months", _within(F.coalesce(*[fact(t)["normalized"]["survival_months"] for t in ("warranty", "indemnity")]), *survival_months)))
    if law is not None:
        said = fact("law")["normalized"]["law"]
        checks.append(("law", F.when(said.isNotNull(), _says(said, law))))
    if forum is not None:
        where = [fact("forum")["normalized"][c] for c in ("forum", "institution_or_court")]
        checks.append(("forum", F.when(where[0].isNotNull() | where[1].isNotNull(), _says(where[0], forum) | _says(where[1], forum))))
    answer, decided = tri_state(checks)
    return rows.select("file_key", answer.alias("answer"), decided.alias("decided_by"))


def review_sample(answers: DataFrame, n: int = SAMPLE) -> DataFrame:
    """Counts of the answers, and the first n rows to review with whether more exist."""
    totals = answers.agg(F.count_if(F.col("answer") == "match").alias("matches"), F.count_if(F.col("answer") == "needs_review").alias("reviews"))
    shown = answers.filter("answer = 'needs_review'").orderBy("file_key").limit(n)
    return shown.crossJoin(F.broadcast(totals)).withColumn("truncated", F.col("reviews") > n)


def to_extract(files: DataFrame, meta: DataFrame, version: int, types: list[str]) -> DataFrame:
    """ok files without current metadata of the version, by type priority, type, path and key."""
    done = meta.filter(F.col("meta_schema_version") >= version).select("file_key", F.col("txt_hash").alias("content_hash"))
    rank = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("ctype"))
    todo = files.filter("status = 'ok'").join(done, ["file_key", "content_hash"], "left_anti").withColumn("rank", F.when(rank == 0, len(types) + 1).otherwise(rank).cast("int"))
    return todo.select("file_key", "rank", "ctype", "path")


def missing_tags(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Clause tags that a document's type requires and its metadata lacks."""
    spark = files.sparkSession
    need = spark.createDataFrame([(t, tag) for t in ("SPA", "SHA", "SSA", "MOU") for tag in [*COMMON_TAGS, *TYPE_TAGS.get(t, [])]], "ctype string, tag string")
    wanted = files.join(meta.select("file_key"), "file_key", "left_semi").select("file_key", "ctype").join(F.broadcast(need), "ctype")
    return wanted.join(clause_rows(meta).select("file_key", "tag"), ["file_key", "tag"], "left_anti").select("file_key", "tag")


def schema_issues(files: DataFrame, meta: DataFrame) -> DataFrame:
    """(file_key, code, detail) for metadata that breaks its rules; none if it is clean."""
    rows = parsed(meta)
    clauses = clause_rows(meta)
    parts = [
        rows.filter(~F.col("confidence").isin("high", "med", "low")).select("file_key", F.lit("bad_confidence").alias("code"), F.col("confidence").alias("detail")),
        rows.filter("meta_schema_version < 3").select("file_key", F.lit("old_schema").alias("code"), F.col("meta_schema_version").cast("string").alias("detail")),
        rows.filter("parties.evaluated and coalesce(size(parties.items), 0) = 0").select("file_key", F.lit("no_parties").alias("code"), F.lit("").alias("detail")),
        rows.filter("consideration.evaluated and consideration.amount_value is null").select("file_key", F.lit("no_amount").alias("code"), F.lit("").alias("detail")),
        clauses.filter("present and (loc_start is null or loc_end < loc_start)").select("file_key", F.lit("bad_range").alias("code"), F.col("tag").alias("detail")),
        missing_tags(files, meta).select("file_key", F.lit("missing_tag").alias("code"), F.col("tag").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def size_band(amount: Column, bands: list[tuple[str, float, float]]) -> Column:
    """Name of the half-open band [low, high) of an amount."""
    out = F.lit(None).cast("string")
    for name, low, high in bands:
        out = F.when((amount >= low) & (amount < high), name).otherwise(out)
    return out


def deal_size(files: DataFrame, meta: DataFrame, bands: list[tuple[str, float, float]]) -> DataFrame:
    """struct-like columns value, confidence, basis: the size band, or 'unknown' with the first
    reason that forbids one."""
    rows = files.filter("status = 'ok'").join(parsed(meta), "file_key", "left")
    k = F.col("consideration")
    why = (
        F.when(F.coalesce("meta_schema_version", F.lit(0)) < 3, "schema")
        .when(~F.coalesce(k["evaluated"], F.lit(False)), "not_evaluated")
        .when(k["amount_value"].isNull(), "no_amount")
        .when(F.coalesce(k["currency"], F.lit("")) != "KRW", "currency")
        .when(F.col("ctype") == "MOU", "non_binding")
        .when(F.coalesce("is_draft", F.lit(0)) == 1, "draft")
        .when(k["confidence"] == "low", "low_confidence")
    )
    return rows.select("file_key", F.when(why.isNull(), size_band(k["amount_value"], bands)).otherwise("unknown").alias("value"), F.when(why.isNull(), k["confidence"]).otherwise("low").alias("confidence"), F.coalesce(why, F.lit("amount")).alias("basis"))


def axis_summary(rows: DataFrame, axes: list[str], n: int = 12) -> DataFrame:
    """Per axis: documents, share populated and the most frequent values (unknown included)."""
    from pyspark.sql import Window as W

    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias("value")) for a in axes]))
    counts = rows.select(pairs.alias("p")).groupBy("p.axis", "p.value").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("axis")
    known = F.sum(F.when(F.col("value") != "unknown", F.col("n")).otherwise(0)).over(w)
    ranked = counts.withColumn("documents", F.sum("n").over(w)).withColumn("populated", F.bround(100.0 * known / F.sum("n").over(w), 1)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "value")))
    return ranked.filter(F.col("place") <= n)
