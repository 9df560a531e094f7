"""Alignment of two tokenizers' tokens, with link counts over the corpus.

Byte offsets where tokens of both end cut a text into groups.  What a byte range of a text
knows is a *fragment*: the tokens up to its first cut (open prefix), the groups between cuts
(closed), the tokens behind its last cut (open suffix); without any cut all is open.  Fragments
of neighbouring ranges compose associatively: suffix and prefix close to a group.

- A text up to LONG_BYTES is one range.  Its segments (see ``segments``) begin and end at
  cuts, so their fragments are closed, and are made once for each different segment.
- A longer text becomes byte ranges that go to different tasks.  Ranges end anywhere, in the
  middle of words as well; each row carries the text out to the next places where both
  tokenizers may be started.  The open ends meet in rounds of FAN neighbours, until one
  fragment is left; the closed groups stay where they were made.

A link's count is the number of documents that hold it.  Tasks count the pairs of a *part*
(some PART_BYTES of text); the parts' counts are summed by pair, joined back to the parts'
pairs, and meet the parts' documents, which were kept as packed arrays.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import stored, union_all
from .segments import Lists, Segments, byte_bpe, byte_bpe_path, byte_lengths, byte_ranks_path, piece_bpe_path, text_runs

#: Longer texts are cut into ranges of RANGE_BYTES; FAN fragments meet in a round.
LONG_BYTES, RANGE_BYTES, FAN = 1 << 16, 1 << 15, 16
#: Bytes of text that one part counts together, that are cut together, and segments that are
#: laid out together.
PART_BYTES, RUN_BYTES, LAID_OUT = 32 << 20, 4 << 20, 1 << 18
#: A pair is id A << B_BITS | id B.
B_BITS = 15
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class Fragment(NamedTuple):
    """Open prefix and suffix (ids of A, ids of B), closed groups between, whether any cut is inside."""

    prefix: tuple[list[int], list[int]]
    closed: list[tuple[list[int], list[int]]]
    suffix: tuple[list[int], list[int]]
    cut: bool


def joined(x: tuple[list[int], list[int]], y: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    return x[0] + y[0], x[1] + y[1]


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges.  Neutral: no tokens and no cut."""
    if not x.cut and not y.cut:
        return Fragment(joined(x.prefix, y.prefix), [], ([], []), False)
    if not x.cut:
        return Fragment(joined(x.prefix, y.prefix), y.closed, y.suffix, True)
    if not y.cut:
        return Fragment(x.prefix, x.closed, joined(x.suffix, y.prefix), True)
    seam = joined(x.suffix, y.prefix)
    return Fragment(x.prefix, x.closed + [seam] * bool(seam[0] or seam[1]) + y.closed, y.suffix, True)


def fragment_of(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int], lo: int, hi: int) -> Fragment:
    """The fragment of the tokens that end in (lo, hi]."""
    mine_a = [(i, e) for i, e in zip(a, a_ends, strict=True) if lo < e <= hi]
    mine_b = [(i, e) for i, e in zip(b, b_ends, strict=True) if lo < e <= hi]
    cuts = sorted({e for _, e in mine_a} & {e for _, e in mine_b})
    if not cuts:
        return Fragment(([i for i, _ in mine_a], [i for i, _ in mine_b]), [], ([], []), False)
    groups, before = [], lo
    for cut in [*cuts, hi]:
        groups.append(([i for i, e in mine_a if before < e <= cut], [i for i, e in mine_b if before < e <= cut]))
        before = cut
    return Fragment(groups[0], groups[1:-1], groups[-1], True)


def group_text(group: tuple[list[int], list[int]]) -> bytes:
    return b"%s|%s;" % (",".join(map(str, group[0])).encode(), ",".join(map(str, group[1])).encode())


def group_pairs(group: tuple[list[int], list[int]]) -> list[int]:
    return [x << B_BITS | y for x in group[0] for y in group[1]]


def byte_level() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for
    themselves, the others are counted from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _byte_table(pieces: list[bytes]) -> Lists:
    out = Lists(np.uint8)
    out.add(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64))
    return out


class Aligner:
    """Tokens, groups and links of segments, kept in a worker from task to task."""

    def __init__(self, a_path: str, a_ranks: str | None, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.encode_a = byte_bpe(a_path, a_ranks)
        vocabulary, letters = Tokenizer.from_file(a_path).get_vocab(), byte_level()
        names = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            names[i] = token
        self.bytes_a = _byte_table([bytes(letters.get(c, 0) for c in token) for token in names])
        self.b = SentencePieceProcessor(model_file=b_path)
        size = self.b.get_piece_size()
        if size > 1 << B_BITS or len(names) > 1 << (31 - B_BITS):
            raise ValueError("the vocabularies are too large for pairs of 31 bits")
        self.bytes_b = _byte_table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(size) for p in [self.b.id_to_piece(i)]])
        self.mark = [self.b.piece_to_id("▁")]
        digits = [b"%d," % i for i in range(max(size, len(names)))]
        self.digits = _byte_table(digits)
        self.segments = Segments(self.learn, self.forget, lead=True)

    def forget(self) -> None:
        self.pairs, self.text = Lists(np.int32), Lists(np.uint8)
        self.facts = Lists(np.int64)  # n_a, n_b, n_groups, n_links, ok, bytes of each segment

    def encode_b(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments: the vocabulary's own mark stands for their first space."""
        found = [ids or self.mark for ids in self.b.encode([s[1:] for s in strings], num_threads=1)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int64, int(sizes.sum())), sizes

    def _same(self, ids: np.ndarray, sizes: np.ndarray, table: Lists, buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each segment's tokens spell its bytes."""
        got, begin = table.gather(ids)
        stop = begin[np.cumsum(sizes)]
        want = np.diff(ends, prepend=0)
        same = np.diff(stop, prepend=0) == want
        if same.all():
            wrong = np.concatenate([np.zeros(1, np.int64), np.cumsum(got != buf)])
            return wrong[ends] == wrong[ends - want]
        for i in np.flatnonzero(same):
            same[i] = np.array_equal(got[stop[i] - want[i] : stop[i]], buf[ends[i] - want[i] : ends[i]])
        return same

    def learn(self, strings: list[str]) -> None:
        a, n_a = self.encode_a(strings)
        b, n_b = self.encode_b(strings)
        size = byte_lengths(strings)
        ends = np.cumsum(size)
        buf = np.frombuffer("".join(strings).encode(), np.uint8)
        ok = self._same(a, n_a, self.bytes_a, buf, ends) & self._same(b, n_b, self.bytes_b, buf, ends)
        facts = np.zeros((len(strings), 6), np.int64)
        facts[:, 5] = size
        facts[:, 4] = ok
        facts[ok, 0], facts[ok, 1] = n_a[ok], n_b[ok]
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        ends = np.cumsum(np.where(ok, size, 0))
        a_ends, b_ends = np.cumsum(self.bytes_a.sizes(a)), np.cumsum(self.bytes_b.sizes(b))
        total = int(ends[-1])
        at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        at_a[a_ends], at_b[b_ends] = True, True
        cut = at_a & at_b
        cut_a, cut_b = cut[a_ends], cut[b_ends]  # the token closes its group
        g_a, g_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        groups = int(cut_a.sum())
        per_a, per_b = np.bincount(g_a, minlength=groups), np.bincount(g_b, minlength=groups)
        of = np.searchsorted(ends, a_ends[cut_a], side="left")  # the groups' segments
        links = per_a * per_b
        facts[:, 2] = np.bincount(of, minlength=len(strings))
        facts[:, 3] = np.bincount(of, weights=links, minlength=len(strings)).astype(np.int64)
        self.facts.add(facts.ravel(), np.full(len(strings), 6, np.int64))
        # each A token beside all B tokens of its group
        times = per_b[g_a]
        first = np.repeat((np.cumsum(per_b) - per_b)[g_a], times)
        inside = np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
        self.pairs.add(((np.repeat(a, times) << B_BITS) | b[first + inside]).astype(np.int32), facts[:, 3])
        # the groups' text: A's ids, then B's, group by group
        ids, closes = np.concatenate([a, b]), np.concatenate([np.where(cut_a, 0x7C, 0), np.where(cut_b, 0x3B, 0)])
        order = np.argsort(np.concatenate([g_a * 2, g_b * 2 + 1]), kind="stable")
        flat, begin = self.digits.gather(ids[order])
        closes, stop = closes[order], begin[1:] - 1
        flat[stop[closes > 0]] = closes[closes > 0]
        of_token = np.searchsorted(ends, np.concatenate([a_ends, b_ends])[order], side="left")
        self.text.add(flat, np.bincount(of_token, weights=np.diff(begin), minlength=len(strings)).astype(np.int64))

    def facts_of(self, codes: np.ndarray) -> np.ndarray:
        return self.facts.flat[: 6 * self.facts.n].reshape(-1, 6)[codes]

    def tokens(self, segment: str) -> tuple[list[int], list[int], list[int], list[int]]:
        """Ids and byte ends of both tokenizers in one segment."""
        a, b = self.encode_a([segment])[0], self.encode_b([segment])[0]
        return a.tolist(), np.cumsum(self.bytes_a.sizes(a)).tolist(), b.tolist(), np.cumsum(self.bytes_b.sizes(b)).tolist()


@lru_cache(maxsize=2)
def _aligner(a_path: str, a_ranks: str | None, b_path: str) -> Aligner:
    return Aligner(a_path, a_ranks, b_path)


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between the places in ``begin``."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    return total[begin[1:]] - total[begin[:-1]]


def _pack(values: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress well."""
    return np.ascontiguousarray(values.astype("<i4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _list_of(values, sizes, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _short_schema(id_field: StructField) -> StructType:
    longs = [StructField(c, ArrayType(LongType())) for c in [*COUNTS, "n_pairs"]]
    return StructType(
        [StructField("part", LongType()), StructField("ids", ArrayType(id_field.dataType)), *longs, StructField("sha", ArrayType(StringType()))]
        + [StructField("codes", BinaryType()), StructField("times", BinaryType()), StructField("pairs", ArrayType(IntegerType())), StructField("docs", ArrayType(IntegerType()))]
    )


def short_texts(docs: DataFrame, paths: tuple) -> DataFrame:
    """Rows of two kinds by part: documents with their links, packed, and the part's pairs with
    the number of its documents that hold each."""
    schema = _short_schema(docs.schema["in_id"])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, known = to_arrow_schema(schema), _aligner(*paths)
        part, held, codes_seen, docs_seen = TaskContext.get().partitionId() << 24, 0, [], []

        def pairs_row():
            code, back = np.unique(np.concatenate(codes_seen), return_inverse=True)
            count = np.bincount(back, weights=np.concatenate(docs_seen)).astype(np.int32)
            row = {f.name: pa.nulls(1, f.type) for f in arrow} | {"part": pa.array([part])}
            row |= {"pairs": _list_of(code.astype(np.int32), [len(code)], pa.int32()), "docs": _list_of(count, [len(code)], pa.int32())}
            return pa.RecordBatch.from_arrays([row[f.name] for f in arrow], schema=arrow)

        for batch in batches:
            for lo, hi in text_runs(batch.column(1), RUN_BYTES):
                texts = batch.column(1).slice(lo, hi - lo)
                codes, begin = known.segments.codes(texts)
                facts = known.facts_of(codes)
                sums = _sums(facts, begin)
                filled = np.asarray(pc.fill_null(pc.binary_length(texts), 0)) > 0
                valid = filled & (sums[:, 4] == np.diff(begin))
                sums[~valid] = 0
                sha = _digests(known, codes, begin, valid)
                pair, at = known.pairs.gather(codes)
                doc = np.repeat(np.arange(len(texts)), np.diff(at[begin]))
                keep = valid[doc]
                key, times = np.unique((doc[keep] << 31) | pair[keep], return_counts=True)
                code = (key & ((1 << 31) - 1)).astype(np.int32)
                n_pairs = np.bincount(key >> 31, minlength=len(texts))
                some, n = np.unique(code, return_counts=True)
                codes_seen.append(some)
                docs_seen.append(n)
                row = {"part": pa.array([part]), "ids": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(0).slice(lo, hi - lo)), "sha": pa.array([sha], arrow.field("sha").type)}
                row |= {c: pa.array([sums[:, i]], arrow.field(c).type) for i, c in enumerate(COUNTS)} | {"n_pairs": pa.array([n_pairs], arrow.field("n_pairs").type)}
                row |= {"codes": pa.array([_pack(np.diff(code, prepend=0))], pa.binary()), "times": pa.array([_pack(times)], pa.binary()), "pairs": pa.nulls(1, arrow.field("pairs").type), "docs": pa.nulls(1, arrow.field("docs").type)}
                yield pa.RecordBatch.from_arrays([row[f.name].cast(f.type) for f in arrow], schema=arrow)
                held += int(facts[:, 5].sum())
                if held >= PART_BYTES:
                    yield pairs_row()
                    part, held, codes_seen, docs_seen = part + 1, 0, [], []
        if codes_seen:
            yield pairs_row()

    return docs.select("in_id", "in_text").mapInArrow(run, schema)


def _digests(known: Aligner, codes: np.ndarray, begin: np.ndarray, valid: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups; '' where a text has no tokens."""
    out: list[str] = []
    lo = 0
    while lo < len(valid):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + LAID_OUT, side="right")) - 1)
        flat, at = known.text.gather(codes[begin[lo] : begin[hi]])
        places = at[begin[lo : hi + 1] - begin[lo]].tolist()
        out += [hashlib.sha256(flat[x : y - 1]).hexdigest() if ok else "" for x, y, ok in zip(places, places[1:], valid[lo:hi], strict=False)]
        lo = hi
    return out


def byte_ranges(docs: DataFrame, long_bytes: int, range_bytes: int) -> DataFrame:
    """Long texts as ranges: rid (a row's number), k, the range's place (lo, hi] in its text,
    and the text, a space before it, out to places where both tokenizers may be started."""
    schema = StructType([StructField("rid", LongType()), docs.schema["in_id"], StructField("k", LongType()), StructField("lo", LongType()), StructField("hi", LongType()), StructField("body", StringType())])

    def cut(batches):
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                data = np.frombuffer(b" " + text.as_buffer().to_pybytes(), np.uint8)
                # a cut follows a printable ASCII character here; any of the places would do
                safe = np.append(0, np.flatnonzero((data[1:] == 0x20) & (data[:-1] > 0x20) & (data[:-1] < 0x7F)) + 1)
                safe = np.append(safe, len(data))
                edges = [0]
                for edge in range(range_bytes, len(data), range_bytes):
                    right = int(np.searchsorted(safe, edge))
                    left = int(np.searchsorted(safe, edge, side="right")) - 1
                    if max(safe[right] - edge, edge - safe[left]) <= range_bytes:
                        edges.append(edge)
                edges.append(len(data))
                for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    start = int(safe[np.searchsorted(safe, lo, side="right") - 1])
                    stop = int(safe[np.searchsorted(safe, hi)])
                    body = data[start:stop].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([rid]), batch.column(0).slice(row, 1), pa.array([k]), pa.array([lo - start]), pa.array([hi - start]), pa.array([body.decode()])], names=schema.names)
                rid += 1

    long = docs.filter(F.octet_length("in_text") > long_bytes).select("in_id", "in_text")
    return long.mapInArrow(cut, schema).repartition("rid", "k")


def _range_fragment(known: Aligner, body: str, lo: int, hi: int) -> tuple[Fragment, bytes, np.ndarray, np.ndarray, bool]:
    """Fragment of the range, the text of its closed groups, their links, counts, and whether
    both tokenizers spell the text."""
    codes, _ = known.segments.codes(pa.array([body[1:]]))
    facts = known.facts_of(codes)
    ends = np.cumsum(facts[:, 5])
    starts = ends - facts[:, 5]
    touched = (ends > lo) & (starts < hi)
    if not facts[touched, 4].all():
        return Fragment(([], []), [], ([], []), False), b"", np.zeros(0, np.int32), np.zeros(4, np.int64), False
    inner = (starts >= lo) & (ends <= hi)
    raw = body.encode()

    def crossing(i: int) -> Fragment:
        at = int(starts[i])
        a, a_ends, b, b_ends = known.tokens(raw[at : int(ends[i])].decode())
        return fragment_of(a, a_ends, b, b_ends, lo - at, hi - at)

    none = Fragment(([], []), [], ([], []), False)
    cut_off = np.flatnonzero(touched & ~inner)
    if not inner.any() and len(cut_off) == 1:  # the range lies within one segment
        whole, middle = crossing(cut_off[0]), []
    else:
        left = [crossing(i) for i in cut_off if starts[i] < lo]
        right = [crossing(i) for i in cut_off if starts[i] >= lo]
        whole = compose(left[0] if left else none, Fragment(([], []), [], ([], []), True))
        middle, tail = whole.closed, right[0] if right else none
        whole = compose(Fragment(whole.prefix, [], whole.suffix, True), tail)
    counts = facts[inner, :4].sum(axis=0)
    text = b"".join(map(group_text, middle)) + known.text.gather(codes[inner])[0].tobytes() + b"".join(map(group_text, whole.closed))
    open_groups = [*middle, *whole.closed]
    links = np.concatenate([known.pairs.gather(codes[inner])[0], np.array([p for g in open_groups for p in group_pairs(g)], np.int32)])
    for g in open_groups:
        counts = counts + [len(g[0]), len(g[1]), 1, len(g[0]) * len(g[1])]
    for ends_open in (whole.prefix, whole.suffix):
        counts = counts + [len(ends_open[0]), len(ends_open[1]), 0, 0]
    return whole, text, links, counts, True


OPEN = ["prefix_a", "prefix_b", "suffix_a", "suffix_b"]


def range_fragments(ranges: DataFrame, paths: tuple) -> DataFrame:
    schema = StructType(
        [StructField("rid", LongType()), StructField("k", LongType()), StructField("ok", BooleanType()), StructField("cut", BooleanType())]
        + [StructField(c, LongType()) for c in COUNTS]
        + [StructField(c, ArrayType(IntegerType())) for c in [*OPEN, "codes", "times"]]
        + [StructField("groups", BinaryType())]
    )

    def run(batches):
        known, kinds = _aligner(*paths), [pa.list_(pa.int32())]
        for batch in batches:
            for rid, k, lo, hi, body in zip(*(batch.column(c) for c in ("rid", "k", "lo", "hi", "body")), strict=True):
                whole, text, links, counts, ok = _range_fragment(known, body.as_py(), lo.as_py(), hi.as_py())
                code, times = np.unique(links, return_counts=True)
                values = [[rid.as_py()], [k.as_py()], [ok], [whole.cut], *[[int(c)] for c in counts]]
                lists = [pa.array([x], kinds[0]) for x in (*whole.prefix, *whole.suffix, code.astype(np.int32), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, values), *lists, pa.array([text], pa.binary())], names=schema.names)

    return ranges.select("rid", "k", "lo", "hi", "body").mapInArrow(run, schema)


def _compose_round(last: bool, width: int):
    """FAN neighbouring fragments of a text as one; groups that close come out as rows, with the
    first range behind the seam.  ``width``: ranges that each of the fragments spans."""

    def run(key, table):
        rid, k = key[0].as_py(), key[1].as_py()
        rows = table.sort_by("k").to_pylist()
        tree = [(r["k"] * width, Fragment((r["prefix_a"], r["prefix_b"]), [], (r["suffix_a"], r["suffix_b"]), r["cut"])) for r in rows]
        seams: list[tuple[int, tuple]] = []
        while len(tree) > 1:
            above = []
            for i in range(0, len(tree), 2):
                if i + 1 == len(tree):
                    above.append(tree[i])
                    continue
                (_, x), (at, y) = tree[i], tree[i + 1]
                both = compose(x, y)
                seams += [(at, g) for g in both.closed]
                above.append((tree[i][0], both._replace(closed=[])))
            tree = above
        whole = tree[0][1]
        if last:  # a text begins and ends at cuts
            seams = [(0, whole.prefix)] * bool(whole.prefix[0]) + seams
        out = [{"rid": rid, "k": k, "cut": whole.cut, "prefix_a": whole.prefix[0], "prefix_b": whole.prefix[1], "suffix_a": whole.suffix[0], "suffix_b": whole.suffix[1], "at": None, "n_links": None, "codes": None, "times": None, "groups": None}]
        for at, g in seams:
            code, times = np.unique(np.array(group_pairs(g), np.int32), return_counts=True)
            out.append({c: None for c in out[0]} | {"rid": rid, "at": at, "n_links": len(g[0]) * len(g[1]), "codes": code.tolist(), "times": times.tolist(), "groups": group_text(g)})
        return pa.Table.from_pylist(out, schema=_SEAMS)

    return run


_LIST = pa.list_(pa.int32())
_SEAMS = pa.schema([("rid", pa.int64()), ("k", pa.int64()), ("cut", pa.bool_()), *[(c, _LIST) for c in OPEN], ("at", pa.int64()), ("n_links", pa.int64()), ("codes", _LIST), ("times", _LIST), ("groups", pa.binary())])
_SEAMS_DDL = "rid long, k long, cut boolean, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>, at long, n_links long, codes array<int>, times array<int>, groups binary"


def _streamed_digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each text's groups, whose pieces pass in order, one at a time."""

    def run(batches):
        rid, digest, pending = None, None, b""
        for batch in batches:
            for r, piece in zip(batch.column(0), batch.column(1), strict=True):
                if r.as_py() != rid:
                    if rid is not None:
                        digest.update(pending[:-1])
                        yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([digest.hexdigest()])], names=["rid", "groups_sha256"])
                    rid, digest, pending = r.as_py(), hashlib.sha256(), b""
                if piece.as_py():
                    digest.update(pending)
                    pending = piece.as_py()
        if rid is not None:
            digest.update(pending[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([digest.hexdigest()])], names=["rid", "groups_sha256"])

    ordered = pieces.repartition("rid").sortWithinPartitions("rid", "at", "nth")
    return ordered.select("rid", "groups").mapInArrow(run, "rid long, groups_sha256 string")


def long_texts(docs: DataFrame, paths: tuple, long_bytes: int, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Counts and digest of each long text (rid, in_id, ...), and its links (rid, code, times)."""
    ranges = stored(byte_ranges(docs, long_bytes, range_bytes), "align-ranges", "zstd")
    made = stored(range_fragments(ranges, paths), "align-fragments", "zstd")
    good = made.groupBy("rid").agg(F.min("ok").alias("ok"), *[F.sum(c).alias(c) for c in COUNTS])
    level = made.select("rid", "k", "cut", *OPEN)
    most, rounds = (made.agg(F.max("k")).first()[0] or 0) + 1, []
    while True:
        most = -(-most // FAN)
        level = level.groupBy("rid", F.expr(f"k div {FAN}").alias("up")).applyInArrow(_compose_round(most == 1, FAN ** len(rounds)), _SEAMS_DDL)
        level = stored(level, f"align-round{len(rounds)}")
        rounds.append(level.filter("at is not null").select("rid", "at", "n_links", "codes", "times", "groups"))
        if most == 1:
            break
        level = level.filter("at is null").select("rid", "k", "cut", *OPEN)
    seams = union_all(rounds)
    # groups that closed where range k begins stand before those of range k itself
    pieces = seams.select("rid", "at", F.lit(0).alias("nth"), "groups").unionByName(made.select("rid", F.col("k").alias("at"), F.lit(1).alias("nth"), "groups"))
    closed = seams.groupBy("rid").agg(F.count(F.lit(1)).alias("more_groups"), F.sum("n_links").alias("more_links"))
    links = seams.select("rid", "codes", "times").unionByName(made.select("rid", "codes", "times"))
    links = links.select("rid", F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("times").alias("times"))))
    links = links.join(good.filter("ok").select("rid"), "rid", "left_semi").groupBy("rid", "code").agg(F.sum("times").alias("times"))
    ok = F.col("ok")
    summed = {c: F.when(ok, F.col(c) + F.coalesce(F.col(m), F.lit(0)) if m else F.col(c)).otherwise(0).cast("long").alias(c) for c, m in zip(COUNTS, [None, None, "more_groups", "more_links"], strict=True)}
    counts = good.join(closed, "rid", "left").join(_streamed_digests(pieces), "rid")
    counts = counts.select("rid", *summed.values(), F.when(ok, F.col("groups_sha256")).otherwise("").alias("groups_sha256"))
    return ranges.filter("k = 0").select("rid", "in_id").join(counts, "rid"), stored(links, "align-links")


def _part_results(schema: StructType):
    def run(left, right):
        from pyspark.sql.pandas.types import to_arrow_schema

        code = np.asarray(right.column("code"), dtype=np.int64)
        order = np.argsort(code)
        code, value = code[order], np.asarray(right.column("value"), dtype=np.int64)[order]
        out = []
        for r in range(left.num_rows):
            row = {c: left.column(c)[r] for c in left.column_names}
            mine = np.cumsum(_unpack(row["codes"].as_buffer().to_pybytes()), dtype=np.int32)
            times = _unpack(row["times"].as_buffer().to_pybytes()).astype(np.int64)
            found = value[np.searchsorted(code, mine)] if len(mine) else np.zeros(0, np.int64)
            n_pairs = np.asarray(row["n_pairs"].values, dtype=np.int64)
            sums = _sums(np.stack([times * (found & 1), times * (found >> 1)], axis=1), np.concatenate([[0], np.cumsum(n_pairs)]))
            columns = [row["ids"].values, *[row[c].values for c in COUNTS], pa.array(sums[:, 0]), pa.array(sums[:, 1]), row["sha"].values]
            out.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema)))
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    return run


def align_tokenizers(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    a_path: str | None = None,
    a_ranks: str | None = None,
    b_path: str | None = None,
    long_bytes: int = LONG_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Counts, links and a digest of the groups of every text.

    ``a_path``: a byte-level BPE tokenizer file (``a_ranks``: a rank file of the same
    vocabulary, optional); ``b_path``: a piece model that marks spaces and falls back to bytes.

    Returns id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.  Defined
    cases: null and empty texts, and texts that a tokenizer does not spell (one that holds the
    other's space mark), have no tokens: zeros and an empty digest; null and repeated ids keep
    a row each, and each counts as a document; an empty table gives an empty result; further
    columns are ignored.
    """
    if a_path is None:
        a_path, a_ranks = byte_bpe_path(), byte_ranks_path()
    paths = (a_path, a_ranks, b_path or piece_bpe_path())
    own = docs.select(F.col(id_col).alias("in_id"), F.col(text).alias("in_text"))
    short = stored(short_texts(own.filter(f"in_text is null or octet_length(in_text) <= {long_bytes}"), paths), "align-short", "zstd")
    long, links = long_texts(own, paths, long_bytes, range_bytes)
    held = short.filter("pairs is not null").select("part", F.inline(F.arrays_zip(F.col("pairs").alias("code"), F.col("docs").alias("n"))))
    totals = held.select("code", "n").unionByName(links.select("code", F.lit(1).alias("n"))).groupBy("code").agg(F.sum("n").alias("total"))
    totals = stored(totals.withColumn("a", F.shiftright("code", B_BITS)), "align-totals")
    top = totals.groupBy("a").agg(F.max("total").alias("top"))
    value = (F.col("total") * 2 + (F.col("total") == F.col("top")).cast("int")).alias("value")
    values = stored(totals.join(top, "a").select("code", value), "align-values")
    schema = StructType([own.schema["in_id"], *[StructField(c, LongType()) for c in [*COUNTS, "n_best", "count_sum"]], StructField("groups_sha256", StringType())])
    looked = held.select(F.col("part").alias("of"), "code").join(values, "code").groupBy("of")
    texts = short.filter("pairs is null").select("part", "ids", *COUNTS, "n_pairs", "sha", "codes", "times")
    done = texts.groupBy("part").cogroup(looked).applyInArrow(_part_results(schema), schema)
    linked = links.join(values, "code").groupBy("rid").agg(F.sum(F.col("times") * F.expr("value % 2")).alias("n_best"), F.sum(F.col("times") * F.expr("value div 2")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    more = long.join(linked, "rid", "left").withColumns({c: F.coalesce(F.col(c), zero) for c in ("n_best", "count_sum")})
    return done.unionByName(more.select(*done.columns)).withColumnRenamed("in_id", id_col)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
