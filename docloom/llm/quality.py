"""Quality rules with suffix-array repetition.

The words of each text get a suffix array by prefix doubling (over a run of documents at
once; suffixes end with their document).  The common prefixes of neighbours in that order are
the LCP array; the longer one of a suffix's two is the longest repeat that starts there.
Spans of repeats of ``min_repeat`` words or more are united; a text fails if they cover more
than ``max_fraction`` of its words, or if the longest repeat has more than ``max_repeat``
words.  The words in repeated three-word windows are those that repeats of three words or
more cover, so the base rule reads the same array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytevec import BLANK_WORDS, byte_table, counts_per_doc, mix, prefix_sums, span_hashes, spans_union, word_bounds
from .common import with_text_columns

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Words of the shortest repeat that counts, the share of words that repeats may cover, and
#: the words that one repeat may have.
MIN_REPEAT, MAX_FRACTION, MAX_REPEAT = 8, 0.4, 200

SYMBOLS = ~byte_table(b"#*$%&|<>")
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, repeat_words long, longest_repeat long, kept boolean"


def repeats(ids: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a repeat of at least three words starts, and its greatest length.

    ids: word numbers from 1 on, docs: their documents, ascending.  A
    repeat is a sequence that starts at two positions of one document, overlaps included.
    """
    n = len(ids)
    none = np.zeros(0, np.int64)
    if n < 4:
        return none, none
    end = np.searchsorted(docs, docs, side="right")  # where each position's document ends
    padded = np.concatenate([ids, np.zeros(2, np.int64)])
    at = np.arange(n)
    second = np.where(at + 1 < end, padded[1 : n + 1], 0)
    third = np.where(at + 2 < end, padded[2 : n + 2], 0)
    # three words are one key if 63 bits hold them
    keys = ((ids << 42) | (second << 21) | third,) if ids.max() < 1 << 21 else (third, second, ids)
    order = np.lexsort((*keys, docs))
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for column in (*keys, docs):
        new[1:] |= column[order[1:]] != column[order[:-1]]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    group = np.cumsum(new) - 1
    rank = np.empty(n, np.int64)
    rank[order] = first[group]  # a suffix's rank: where its group begins in the order
    active = order[sizes[group] > 1]
    if not len(active):
        return none, none
    starts = active.copy()
    levels, width = [rank], 3
    while len(active):
        after = active + width
        follow = np.where(after < end[active], rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((follow, rank[active]))
        a, r, f = active[by], rank[active[by]], follow[by]
        new_group = np.empty(len(a), dtype=bool)
        new_group[0] = True
        new_group[1:] = r[1:] != r[:-1]
        cut = new_group.copy()
        cut[1:] |= f[1:] != f[:-1]
        where = np.arange(len(a))
        base = np.maximum.accumulate(np.where(new_group, where, 0))
        head = np.maximum.accumulate(np.where(cut, where, 0))
        rank = rank.copy()
        rank[a] = r + head - base
        heads = np.flatnonzero(cut)
        active = a[np.repeat(np.diff(np.append(heads, len(a))) > 1, np.diff(np.append(heads, len(a))))]
        if len(active):
            levels.append(rank)
        width *= 2
    suffixes = starts[np.argsort(rank[starts], kind="stable")]
    i, j = suffixes[:-1], suffixes[1:]
    lcp = np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = i + lcp, j + lcp
        inside = (docs[i] == docs[j]) & (x < end[i]) & (y < end[j])
        same = inside & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)])
        lcp += np.where(same, 3 << level, 0)
    for _ in range(2):  # what is left is shorter than three words
        x, y = i + lcp, j + lcp
        same = (lcp >= 3) & (x < end[i]) & (y < end[j]) & (ids[np.minimum(x, n - 1)] == ids[np.minimum(y, n - 1)])
        lcp += same
    best = np.maximum(np.append(lcp, 0), np.append(0, lcp))
    order = np.argsort(suffixes, kind="stable")
    return suffixes[order], best[order]


def covered(starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Words per document in the union of the spans."""
    lo, hi = spans_union(starts, starts + lengths)
    # spans of different documents may touch but never overlap, so a union is cut at documents
    total = np.zeros(len(docs) + 1, np.int64)
    np.add.at(total, lo, 1)
    np.add.at(total, hi, -1)
    inside = np.cumsum(total[:-1]) > 0
    return counts_per_doc(docs[inside], n_docs)


def measure(buf: np.ndarray, offsets: np.ndarray, min_repeat: int = MIN_REPEAT, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> list[pa.Array]:
    """The fields of FIELDS for each text of a run."""
    n = len(offsets) - 1
    starts, ends, docs = word_bounds(buf, offsets, BLANK_WORDS)
    n_words = counts_per_doc(docs, n)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    word_chars = counts_per_doc(docs, n, points[ends] - points[starts])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
    prefix = prefix_sums(buf)
    # lines: they begin with a document or after a line feed
    breaks = np.flatnonzero(buf == 10)
    line_doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    by = np.lexsort((line_start, line_doc))
    line_doc, line_start = line_doc[by], line_start[by]
    last = np.append(line_doc[1:] != line_doc[:-1], True)
    line_end = np.where(last, offsets[line_doc + 1], np.append(line_start[1:], 0) - 1)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_doc, line_start, line_end = line_doc[worded], line_start[worded], line_end[worded]
    line_key = mix(span_hashes(prefix, line_start, line_end) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one = np.unique(line_key, return_index=True)
    n_dup_lines = counts_per_doc(line_doc, n) - counts_per_doc(line_doc[one], n)
    _, ids = np.unique(span_hashes(prefix, starts, ends), return_inverse=True)
    at, length = repeats(ids.astype(np.int64) + 1, docs)
    three = np.minimum(length, 3)
    n_repeat_words = covered(at, three, docs, n)
    enough = length >= min_repeat
    repeat_words = covered(at[enough], length[enough], docs, n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, docs[at], length)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)
    kept = ~base_failed & (repeat_words <= max_fraction * n_words) & (longest <= max_repeat)
    return [pa.array(x) for x in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, repeat_words, longest, kept)]


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None, min_repeat: int = MIN_REPEAT, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Columns ``keep`` (all) with the measures of FIELDS; nothing is shuffled.

    repeat_words: words in repeats of min_repeat words or more; longest_repeat: words of the
    longest repeat (0 below three).  Defined cases: a null or empty text has no words, fails the
    base rule and is not kept; repeated rows are judged alike; an empty table gives an empty
    one; input columns with a measure's name are replaced by it.
    """

    def compute(buf, offsets):
        return measure(buf, offsets, min_repeat, max_fraction, max_repeat)

    return with_text_columns(docs, text, docs.columns if keep is None else keep, FIELDS, compute)


def op10_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"]).drop("longest_repeat")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM d),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines FROM
        (SELECT doc_id, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY doc_id),
p AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS c FROM p WHERE i + 2 <= n),
r3 AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j FROM g3 WHERE c > 1) GROUP BY doc_id),
gm AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(w[i:i+{MIN_REPEAT - 1}], ' '))) AS c FROM p WHERE i + {MIN_REPEAT - 1} <= n),
rm AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS repeat_words FROM (SELECT doc_id, unnest(range(i, i + {MIN_REPEAT})) AS j FROM gm WHERE c > 1) GROUP BY doc_id),
gl AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, count(*) AS c FROM p WHERE i + {MAX_REPEAT} <= n GROUP BY doc_id, md5(array_to_string(w[i:i+{MAX_REPEAT}], ' '))) WHERE c > 1),
a AS (SELECT m.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(repeat_words, 0) AS repeat_words, gl.doc_id IS NOT NULL AS long_repeat
      FROM m LEFT JOIN dup USING (doc_id) LEFT JOIN r3 USING (doc_id) LEFT JOIN rm USING (doc_id) LEFT JOIN gl USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, repeat_words, kept FROM (
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND repeat_words <= {MAX_FRACTION} * n_words AND NOT long_repeat AS kept FROM a)
"""
