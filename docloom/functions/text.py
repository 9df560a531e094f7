"""Column functions on text: normalising, keys, literal matching and term counting."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that count as one another when text is normalised.
HYPHENS = "‐‑‒–—―−"
SINGLE_QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„‟"
ZERO_WIDTH = "​‌‍⁠﻿"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def fold_ascii_path(text: Column, full: Column) -> Column:
    """``full`` (a UDF) for texts beyond ASCII only; ASCII texts stay in the JVM."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(full)


def composed(text: Column) -> Column:
    """Canonical composition; ASCII texts stay in the JVM."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(nfc(text))


def unified(text: Column) -> Column:
    """Width, hyphens, quotes, control characters and blanks unified."""
    one = F.translate(text, FULL_WIDTH + HYPHENS + SINGLE_QUOTES + DOUBLE_QUOTES + ZERO_WIDTH, HALF_WIDTH + "-" * len(HYPHENS) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    return F.trim(F.regexp_replace(one, r"(?U)[\s\p{Cntrl}]+", " "))


def normalise(text: Column) -> Column:
    return unified(composed(text))


def paragraphs_of(text: Column, separator: str = "\n") -> Column:
    """Array of the normalised paragraphs that are not empty."""
    return F.filter(F.transform(F.split(composed(text), separator), unified), lambda x: x != "")


def short_hash(value: Column, bits: int = 256) -> Column:
    return F.substring(F.sha2(value, bits) if bits != 1 else F.sha1(value), 1, 16)


def matches(content: Column, term: Column) -> Column:
    """The term stands literally in the content, whatever the case."""
    return F.contains(F.lower(content), F.lower(term))


#: Texts that fold by lower case and 'ss' alone: ASCII, Latin-1 letters, Hangul syllables.
PLAIN = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ가-힣]*\z"


def with_signature(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the ``signature`` of a text.  Python is given other texts than ``PLAIN`` ones only,
    each once; where there are none, it does not start."""
    plain = F.coalesce(F.col(text).rlike(PLAIN), F.lit(True))
    near = rows.filter(plain).withColumn(name, _bare(F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))))
    odd = rows.filter(~plain)
    known = odd.select(text).distinct().withColumn(name, signature(F.col(text)))
    return near.unionByName(odd.join(known, text))


def _bare(folded: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(folded, r"\d+", "#"), r"[^\p{L}\p{N}#]+", "")


def signature(text: Column) -> Column:
    """A text's key across documents: folded, runs of digits as '#', letters, digits and '#' only."""
    return _bare(fold_ascii_path(text, nfkc_casefold(text)))


def occurrences(content: Column, term: Column) -> Column:
    """How often the folded term starts in the folded content, overlaps counted."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(F.lower(term), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return F.when(F.length(term) == 0, 0).otherwise(F.regexp_count(F.lower(content), quoted))


def alias_key(text: Column) -> Column:
    """Lower case, blanks collapsed."""
    return F.lower(F.array_join(F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda x: x != ""), " "))


def compact(text: Column) -> Column:
    """Without blanks."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def subdomain(taxonomy_id: Column) -> Column:
    return F.substring_index(taxonomy_id, ".", 2)
