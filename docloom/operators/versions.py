"""Version roles of documents from their file names, filters on them and what they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABELS = {"execution": "Execution version", "bidding": "Bidding form", "buyer_draft": "Buyer draft", "seller_draft": "Seller draft", "buyer_markup": "Buyer markup", "seller_markup": "Seller markup", "buyer_ver": "Buyer version", "seller_ver": "Seller version", "markup_unknown": "Markup", "draft_unknown": "Draft", "unknown": "Unknown"}

# Tokens in a lower-cased file name.  Strong (explicit) ones suffice alone.
EXECUTION_STRONG = ["체결", "execution", "signed", "signing", "exec_", "_exec", "최종본", "definitive"]
EXECUTION_WEAK = ["final", "fnl"]
BIDDING_STRONG = ["bidding"]
BIDDING_WEAK = ["제출본"]
MARKUP_STRONG = ["markup", "mark-up", "mark up", "redline", "수정", "코멘트", "comment"]
MARKUP_WEAK = ["1st", "2nd", "3rd"]
DRAFT_STRONG = ["draft", "초안"]
DRAFT_WEAK = ["_v1", "내부", "안)"]
BUYER = ["buyer", "매수인"]
SELLER = ["seller", "매도인"]
# Roles that a request for the key also touches in part.
PARTIAL = {
    "buyer_draft": ["draft_unknown", "buyer_ver"],
    "seller_draft": ["draft_unknown", "seller_ver"],
    "buyer_markup": ["markup_unknown", "buyer_ver"],
    "seller_markup": ["markup_unknown", "seller_ver"],
    "buyer_ver": ["draft_unknown", "markup_unknown"],
    "seller_ver": ["draft_unknown", "markup_unknown"],
    "draft_unknown": ["buyer_ver", "seller_ver"],
    "markup_unknown": ["buyer_ver", "seller_ver"],
}
# Reading priority of a role, the least first.
PRIORITY = {"execution": 0, "seller_draft": 2, "buyer_draft": 2, "draft_unknown": 2, "seller_markup": 3, "buyer_markup": 3, "markup_unknown": 3, "bidding": 3, "buyer_ver": 4, "seller_ver": 4, "unknown": 5}


def _found(name: Column, tokens: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(name, t))


def classify(filename: Column) -> Column:
    """struct(role, confidence, basis): execution, then bidding, then party and stage.

    A party without a stage is a version of unknown stage (``buyer_ver``), a stage without a
    party ``markup_unknown`` or ``draft_unknown``; markup goes before draft, the buyer before
    the seller.  Explicit tokens are worth more than weak ones; a stage token in an executed
    file's name and two named parties lower the confidence by one step.  basis: the tokens
    that spoke, joined by '|'; a null name is unknown.
    """
    name = F.lower(F.coalesce(filename, F.lit("")))
    found = {k: _found(name, globals()[k]) for k in ("EXECUTION_STRONG", "EXECUTION_WEAK", "BIDDING_STRONG", "BIDDING_WEAK", "MARKUP_STRONG", "MARKUP_WEAK", "DRAFT_STRONG", "DRAFT_WEAK", "BUYER", "SELLER")}
    has = {k: F.size(v) > 0 for k, v in found.items()}
    executed, bidding = has["EXECUTION_STRONG"] | has["EXECUTION_WEAK"], has["BIDDING_STRONG"] | has["BIDDING_WEAK"]
    markup, draft = has["MARKUP_STRONG"] | has["MARKUP_WEAK"], has["DRAFT_STRONG"] | has["DRAFT_WEAK"]
    party = F.when(has["BUYER"], "buyer").when(has["SELLER"], "seller")
    two = has["BUYER"] & has["SELLER"]
    stage = F.when(markup, "markup").when(draft, "draft")
    explicit = F.when(markup, has["MARKUP_STRONG"]).otherwise(has["DRAFT_STRONG"])
    names = F.concat(found["BUYER"], found["SELLER"])
    stages = F.when(markup, F.concat(found["MARKUP_STRONG"], found["MARKUP_WEAK"])).otherwise(F.concat(found["DRAFT_STRONG"], found["DRAFT_WEAK"]))
    level = lambda steps: F.element_at(F.array(F.lit("high"), F.lit("med"), F.lit("low")), F.lit(1) + steps)
    one = lambda cond: F.when(cond, 1).otherwise(0)

    def case(role: Column, confidence: Column, basis: Column) -> Column:
        return F.struct(role.alias("role"), confidence.alias("confidence"), F.array_join(basis, "|").alias("basis"))

    return (
        F.when(executed, case(F.lit("execution"), level(one(~has["EXECUTION_STRONG"]) + one(markup | draft)), F.concat(found["EXECUTION_STRONG"], found["EXECUTION_WEAK"])))
        .when(bidding, case(F.lit("bidding"), level(one(~has["BIDDING_STRONG"])), F.concat(found["BIDDING_STRONG"], found["BIDDING_WEAK"])))
        .when(party.isNotNull() & stage.isNotNull(), case(F.concat_ws("_", party, stage), level(one(~explicit) + one(two)), F.concat(names, stages)))
        .when(party.isNotNull(), case(F.concat(party, F.lit("_ver")), level(one(two) + 1), names))
        .when(stage.isNotNull(), case(F.concat(stage, F.lit("_unknown")), level(one(~explicit) + 1), stages))
        .otherwise(case(F.lit("unknown"), F.lit("low"), F.array().cast("array<string>")))
    )


def markup_round(filename: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(filename), r"(\d+)\s*(?:st|nd|rd|th)\b", 1), F.lit("")).cast("int")


def resolve_parties(rows: DataFrame) -> DataFrame:
    """Markups of unknown party in a project (ctype, lang, project) whose drafts have one single
    author: odd rounds are the other party's, even ones the author's; confidence low."""
    author = F.when(F.col("version_role").isin("buyer_draft", "seller_draft"), F.substring_index("version_role", "_", 1))
    w = W.partitionBy("ctype", "lang", "project")
    # projects are small groups by nature
    marked = rows.withColumn("_authors", F.collect_set(author).over(w)).withColumn("_round", markup_round(F.col("filename")))
    single = (F.col("version_role") == "markup_unknown") & (F.size("_authors") == 1) & F.col("_round").isNotNull()
    own = F.element_at(F.col("_authors"), 1)
    other = F.when(own == "buyer", "seller").otherwise("buyer")
    who = F.when(F.col("_round") % 2 == 1, other).otherwise(own)
    out = marked.withColumn("resolved_role", F.when(single, F.concat(who, F.lit("_markup"))).otherwise(F.col("version_role")))
    return out.withColumn("resolved_confidence", F.when(single, "low").otherwise(F.col("version_confidence"))).drop("_authors", "_round")


def resolve_filter(value: str | list[str]) -> list[str]:
    """Role keys of a filter: keys, labels or labels without blanks; a list or a comma string."""
    names = {k: k for k in LABELS} | {v.lower(): k for k, v in LABELS.items()} | {v.lower().replace(" ", ""): k for k, v in LABELS.items()}
    parts = value.split(",") if isinstance(value, str) else list(value)
    out = []
    for p in (x.strip() for x in parts):
        if p and p.lower() not in names:
            raise ValueError(f"unknown version: {p}")
        if p and names[p.lower()] not in out:
            out.append(names[p.lower()])
    return out


def annotate(rows: DataFrame) -> DataFrame:
    """Label, confidence ('unrated' if never rated), whether to review, and one line."""
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    role = F.coalesce("version_role", F.lit("unknown"))
    level = F.coalesce("version_confidence", F.lit("unrated"))
    review = (role == "unknown") | level.isin("low", "unrated")
    return rows.withColumn("label", label[role]).withColumn("confidence", level).withColumn("review_required", review).withColumn("summary", F.concat_ws(" · ", "label", "confidence", F.when(review, "review")))


def exclusion_reason(requested: list[str]) -> Column:
    """Why a row outside the filter deserves a look: version_unknown, partial_version,
    low_confidence; null if it matches or is safely something else."""
    partial = sorted({p for r in requested for p in PARTIAL.get(r, [])} - set(requested))
    role = F.coalesce(F.col("version_role"), F.lit("unknown"))
    return F.when(role.isin(requested), F.lit(None)).when(role == "unknown", "version_unknown").when(role.isin(partial) if partial else F.lit(False), "partial_version").when(F.coalesce("version_confidence", F.lit("unrated")).isin("low", "unrated"), "low_confidence")


def filter_notice(rows: DataFrame, requested: list[str]) -> DataFrame:
    """What the filter takes and leaves, in one pass before it is applied."""
    role = F.coalesce(F.col("version_role"), F.lit("unknown"))
    match, why = role.isin(requested), exclusion_reason(requested)
    low = F.coalesce("version_confidence", F.lit("unrated"))
    return rows.agg(
        F.count_if(match).alias("matched"),
        F.count_if(match & (low == "low")).alias("matched_low"),
        F.count_if(~match).alias("excluded"),
        F.count_if(why == "version_unknown").alias("excluded_unknown"),
        F.count_if(why == "partial_version").alias("excluded_partial"),
        F.count_if(why == "low_confidence").alias("excluded_low"),
        F.count_if(~match & (low == "unrated")).alias("excluded_unrated"),
    )


def capped_per(rows: DataFrame, part: str, order: list, n: int) -> DataFrame:
    """At most n rows of each part as a sample beside the full count (total)."""
    w = W.partitionBy(part)
    return rows.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(*order))).filter(F.col("place") <= n)


def project_key(path: Column, markers: list[str], agreements: list[str]) -> Column:
    """Words of a file's stem without markers, numbers and punctuation: up to the first agreement
    word if there is one, else the first three; a path without words gives its hash."""
    stem = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.[a-z0-9]+$", "")
    words = F.filter(F.split(F.regexp_replace(stem, r"[^a-z]+", " "), " "), lambda w: (w != "") & ~w.isin(markers))
    at = F.array_position(F.transform(words, lambda w: w.isin(agreements)), True)
    cut = F.when(at > 0, F.slice(words, 1, at.cast("int"))).otherwise(F.slice(words, 1, 3))
    return F.when(F.size(words) == 0, F.substring(F.sha1(path), 1, 12)).otherwise(F.array_join(cut, " "))


def tiers(rows: DataFrame) -> DataFrame:
    """Tier 1 for each project's best version, 2 for the others."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.coalesce("version_role", F.lit("unknown"))]
    w = W.partitionBy("ctype", "lang", "project").orderBy("_rank", "file_key")
    return rows.withColumn("_rank", F.coalesce(rank, F.lit(9))).withColumn("tier", F.when(F.row_number().over(w) == 1, 1).otherwise(2)).drop("_rank")
