"""Many literal patterns in one pass over the texts.

Patterns go into Aho-Corasick automata of a bounded size; each task runs its rows through all
of them, batch by batch, so the work follows the length of the texts and the number of hits,
not the number of patterns.  A pattern may be bounded: then it must begin and end where a word
does, as words of Latin letters stand for themselves while other scripts join them to endings.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docloom.operators.search import containing

#: Characters of the patterns of one automaton, and of all that are sent to the tasks.  Larger
#: sets are joined on their rarest trigrams.
BLOCK_CHARS, SENT_CHARS = 1 << 20, 16 << 20


def is_latin(term: Column) -> Column:
    """Has a Latin letter and no Hangul syllable."""
    return term.rlike("[a-zA-Z]") & ~term.rlike("[가-힣]")


def word_at(text: str, i: int) -> bool:
    """Whether the character at ``i`` belongs to a word; outside the text none does."""
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


def fits_bounds(text: str, start: int, end: int) -> bool:
    """A word begins or ends at both edges of text[start:end]."""
    return word_at(text, start - 1) != word_at(text, start) and word_at(text, end - 1) != word_at(text, end)


def blocks_of(patterns: list[tuple[str, bool]], size: int) -> list[list[tuple[str, bool]]]:
    out: list[list[tuple[str, bool]]] = [[]]
    used = 0
    for needle, bounded in patterns:
        if out[-1] and used + len(needle) > size:
            out.append([])
            used = 0
        out[-1].append((needle, bounded))
        used += len(needle)
    return out


def automaton(patterns: list[tuple[str, bool]]):
    """An automaton whose values are the pattern and whether it is bounded, unbounded, or both."""
    import ahocorasick

    kinds: dict[str, set[bool]] = {}
    for needle, bounded in patterns:
        kinds.setdefault(needle, set()).add(bounded)
    made = ahocorasick.Automaton()
    for needle, kind in kinds.items():
        made.add_word(needle, (needle, kind))
    made.make_automaton()
    return made


def found_in(text: str, machine) -> set[tuple[str, bool]]:
    """(needle, bounded) of every pattern that stands in ``text``."""
    out: set[tuple[str, bool]] = set()
    for last, (needle, kind) in machine.iter(text):
        if False in kind:
            out.add((needle, False))
        if True in kind and (needle, True) not in out and fits_bounds(text, last - len(needle) + 1, last + 1):
            out.add((needle, True))
    return out


def pattern_hits(rows: DataFrame, patterns: DataFrame, text: str = "content", keep: list[str] | None = None, block: int = BLOCK_CHARS, sent: int = SENT_CHARS) -> DataFrame:
    """Columns ``keep`` of each row (default: all but the text) with needle and bounded of each
    pattern that stands in its text, whatever the case.

    patterns: needle, bounded.  Each pair of a row and a pattern comes once.  An empty needle
    stands nowhere, a null text holds none.
    """
    keep = [c for c in rows.columns if c != text] if keep is None else keep
    wanted = patterns.select(F.lower("needle").alias("needle"), "bounded").filter("needle <> ''").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()[0]
    if size > sent:
        return _joined(rows, wanted, text, keep)
    blocks = blocks_of(sorted((r["needle"], r["bounded"]) for r in wanted.collect()), block)  # SENT_CHARS at most
    held = [rows.sparkSession.sparkContext.broadcast(b) for b in blocks if b]
    names = [f"k{i}" for i in range(len(keep))]
    schema = StructType([StructField(n, rows.schema[c].dataType) for n, c in zip(names, keep, strict=True)] + [StructField("needle", StringType())])
    schema = schema.add("bounded", "boolean")

    def run(batches):
        machines = [automaton(b.value) for b in held]
        for batch in batches:
            at, needles, bounded = [], [], []
            for i, one in enumerate(batch.column(0)):
                body = one.as_py()
                for machine in machines if body else []:
                    for needle, bound in found_in(body, machine):
                        at.append(i)
                        needles.append(needle)
                        bounded.append(bound)
            taken = [batch.column(1 + k).take(pa.array(at, pa.int64())) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(needles, pa.string()), pa.array(bounded, pa.bool_())], names=[*names, "needle", "bounded"])

    folded = rows.select(F.lower(F.col(text)).alias("body"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    return folded.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "needle", "bounded")


def _joined(rows: DataFrame, wanted: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The same by a join on trigrams, for patterns too many to send."""
    numbered = rows.select(F.lower(F.col(text)).alias("content"), F.struct(*keep).alias("kept"))
    hit = containing(numbered, wanted, fold=False)
    word = r"[\p{L}\p{N}_]"
    edge = F.lit(f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")
    quoted = F.concat(F.lit(r"\Q"), F.replace("needle", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    both = F.concat(edge, quoted, edge)
    return hit.filter(~F.col("bounded") | F.regexp_like("content", both)).select("kept.*", "needle", "bounded").distinct()


def script_needles(words: DataFrame, stop: list[str], least: int = 4, within: str = "sub") -> DataFrame:
    """Vocabulary by script.  words: ``within``, term.  A Latin term gives its words of ``least``
    letters or more that are no stop words, bounded; any other term is a needle as it stands."""
    term = F.lower("term")
    latin = words.filter(is_latin(F.col("term"))).select(within, F.explode(F.regexp_extract_all(term, F.lit("[a-z]+"), 0)).alias("needle"), F.lit(True).alias("bounded"))
    latin = latin.filter((F.length("needle") >= least) & ~F.col("needle").isin(stop))
    other = words.filter(~is_latin(F.col("term")) & (F.col("term") != "")).select(within, term.alias("needle"), F.lit(False).alias("bounded"))
    return latin.unionByName(other).distinct()
