"""Duplicate passages by prefix-free parsing.

A byte is removed if a ``WIDTH``-byte string over it also starts in a document with a smaller
id.  The parse: a rolling hash runs over GRAM-byte strings; in every WIDTH-byte window the
string of least hash (the rightmost on ties) is the trigger.  The choice depends on the
window's bytes alone, so equal windows have their trigger at the same place, and every window
has one; a mere "hash is 0 modulo p" would leave windows without any.  A phrase is the run of
windows with the same trigger; it overlaps its neighbours as the phrases of a prefix-free parse
do.

The dictionary are the different phrases, each with the smallest document that has it.  Two
windows can only be equal if their phrases have the same trigger, so the order of the corpus
up to WIDTH bytes follows from the dictionary's suffixes within one trigger.  Steps, each a
shuffle of hashes (never of one row a byte):

1. blocks of documents send their different triggers; those that other blocks have too come
   back;
2. blocks send their different phrases under such triggers; back comes the phrase's smallest
   document, and whether its trigger has further phrases;
3. an occurrence of a phrase in a larger document is removed whole.  Where phrases of one
   trigger agree in the bytes before or after it, each one's first document sends the suffixes
   (windows) on that side; equal suffixes of different phrases meet in one rank and the
   smallest document comes back;
4. spans are united per document and the kept bytes are hashed.

What a block sends is de-duplicated first, so a passage that a third of all documents share
costs one entry a block; triggers in very many blocks are spread by phrase.  Phrases
are compared by 96 bits or more of two hashes, suffixes by 88.  The documents are dealt to blocks once; all steps read
that one exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytevec import RUN_BYTES, as_bytes, inverse_powers, mix, prefix_sums, runs, span_hashes, spans_union

WIDTH, GRAM = 50, 24
BLOCK_BYTES = 8 << 20
#: A trigger in more blocks than this is spread over tasks by phrase.
HOT_BLOCKS = 1024
POS_BITS = 23
NO_ID = np.iinfo(np.int64).max
_PART = "route long, block long, n long, data binary"
_U = np.uint64


def pack(*fields: tuple[np.ndarray, int]) -> bytes:
    """Arrays as byte planes (the lowest ``width`` bytes of each entry), which compress well."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(a).astype(np.int64 if a.dtype.kind == "i" else np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() for a, width in fields)


def unpack(data: list[bytes], sizes: list[int], widths: list[int]) -> list[np.ndarray]:
    """The arrays of several packs, one after the other, as uint64."""
    out = [[] for _ in widths]
    for blob, n in zip(data, sizes, strict=True):
        at = 0
        for i, width in enumerate(widths):
            cell = np.zeros((n, 8), np.uint8)
            cell[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
            out[i].append(cell.view(np.uint64).ravel())
            at += n * width
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def pieces(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """Stretches of the block's bytes: (from, to, offsets of its texts within, first text).  A
    text too long for a run comes in pieces that overlap by width - 1 bytes."""
    for lo, hi in runs(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= 2 * RUN_BYTES:
            yield a, b, offsets[lo : hi + 1] - a, lo
        else:
            for at in range(a, b - width + 1, RUN_BYTES):
                end = min(b, at + RUN_BYTES + width - 1)
                yield at, end, np.array([0, end - at]), lo


def phrases(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Phrases of a stretch: text, first and last window start, the trigger's place, trigger hash,
    phrase hash, and the prefix sums to hash further spans with."""
    prefix = prefix_sums(buf)
    n = len(buf) - width + 1
    empty = np.zeros(0, np.int64)
    nothing = empty, empty, empty, empty, empty.view(_U), empty.view(_U), prefix
    if n <= 0:
        return nothing
    at = np.arange(len(buf) - gram + 1)
    grams = (prefix[gram:] - prefix[: len(at)]) * inverse_powers(len(at))
    top = (1 << POS_BITS) - 1
    low = grams * _U(0xD6E8FEB86659FD93)
    low &= ~_U(top)
    low |= (top - at).view(_U)
    span, reach = 1, width - gram + 1
    while span < reach:  # sliding minimum by doubling
        step = min(span, reach - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    valid = np.ones(n, bool)
    late = (offsets[1:, None] - np.arange(1, width)).ravel()  # windows that would leave their text
    valid[late[(late >= 0) & (late < n)]] = False
    valid = np.flatnonzero(valid)
    if not len(valid):
        return nothing
    trigger = top - (low[valid] & _U(top)).view(np.int64)
    first = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
    lo, hi, trig = valid[first], valid[np.append(first[1:], len(valid)) - 1], trigger[first]
    whole = mix(span_hashes(prefix, lo, hi + width) + (trig - lo).astype(_U) * _U(0x9E3779B97F4A7C15))
    return np.searchsorted(offsets, lo, side="right") - 1, lo, hi, trig, span_hashes(prefix, trig, trig + gram), whole, prefix


class Block:
    """A block's texts in a fixed order, and their phrases."""

    def sides(self, pick: np.ndarray, half: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
        """16-bit codes of the ``half`` bytes before and after the triggers; 0 where the phrase
        has no window with so many bytes on that side."""
        left, right = np.zeros(len(pick), _U), np.zeros(len(pick), _U)
        for k, (a, prefix) in enumerate(self.stretches):
            here = np.flatnonzero(self.stretch[pick] == k)
            at, lo, end = self.at[pick[here]] - a, self.lo[pick[here]] - a, self.hi[pick[here]] - a + self.width
            ok = at - lo >= half
            left[here[ok]] = (span_hashes(prefix, at[ok] - half, at[ok]) & _U(0xFFFF)) | _U(1)
            ok = end - (at + gram) >= half
            right[here[ok]] = (span_hashes(prefix, at[ok] + gram, at[ok] + gram + half) & _U(0xFFFF)) | _U(1)
        return left, right

    def suffixes(self, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hashes of the windows at ``start``; owner: their phrases."""
        out = np.zeros(len(start), _U)
        for k, (a, prefix) in enumerate(self.stretches):
            here = np.flatnonzero(self.stretch[owner] == k)
            out[here] = span_hashes(prefix, start[here] - a, start[here] - a + self.width)
        return out

    def __init__(self, table: pa.Table, width: int, shift: int, parse: bool = True):
        self.width = width
        table = table.select(["_id", "t"]).sort_by([("_id", "ascending"), ("t", "ascending")])
        self.raw_ids = table.column("_id")
        self.ids = self.raw_ids.fill_null(NO_ID).to_numpy()
        self.buf, self.offsets = as_bytes(table.column("t"))
        if not parse:
            return
        parts, self.stretches = [], []
        for k, (a, b, off, first) in enumerate(pieces(self.offsets, width)):
            doc, lo, hi, at, trig, whole, prefix = phrases(self.buf[a:b], off, width)
            parts.append((doc + first, lo + a, hi + a, trig, whole, np.full(len(doc), k), at + a))
            self.stretches.append((a, prefix))
        kinds = (np.int64, np.int64, np.int64, _U, _U, np.int64, np.int64)
        self.doc, self.lo, self.hi, self.trig, self.whole, self.stretch, self.at = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kinds[i]) for i in range(7))
        self.trig >>= _U(shift)
        self.id = self.ids[self.doc]


def first_ids(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group equal keys: each entry's group, and the first entry and smallest id of each group."""
    order = np.lexsort((ids, *keys[::-1]))
    if not len(order):
        z = np.zeros(0, np.int64)
        return z, z, z
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)]
    return group, head, ids[head]


def find(keys: tuple[np.ndarray, ...], table: tuple[np.ndarray, ...]) -> np.ndarray:
    """Index of each key in ``table`` (different keys), or -1."""

    def one(k):
        h = k[0]
        for x in k[1:]:
            h = mix(h * _U(0x9E3779B97F4A7C15) + x)
        return h

    if not len(table[0]):
        return np.full(len(keys[0]), -1)
    there = one(table)
    order = np.argsort(there, kind="stable")
    at = order[np.minimum(np.searchsorted(there[order], one(keys)), len(order) - 1)]
    same = np.ones(len(at), bool)
    for k, t in zip(keys, table, strict=True):
        same &= k == t[at]
    return np.where(same, at, -1)


def phrase_key(trig: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """One hash of a trigger and its phrase, to find a reply within a block by."""
    return mix(trig * _U(0x9E3779B97F4A7C15) ^ whole)


def shared_sides(trig: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Flags of different phrases: 1 if another phrase of the trigger has the same bytes before
    it, 2 for the bytes after it.  Only then can they share a window that lies on that side."""
    out = np.zeros(len(trig), np.int64)
    for flag, code in ((1, left), (2, right)):
        key = mix(trig * _U(0x9E3779B97F4A7C15) + code)
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        out |= np.where((n[at] > 1) & (code > 0), flag, 0)
    return out


def windows_of(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, flags: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts of phrases, with the phrase of each: those with ``half`` bytes or more before
    the trigger if flag 1 is set, those with fewer or as many if flag 2 is."""
    first = np.where(flags & 1, lo, np.maximum(lo, at - half))
    last = np.where(flags & 2, hi, np.minimum(hi, at - half))
    count = np.maximum(last - first + 1, 0)
    owner = np.repeat(np.arange(len(lo)), count)
    return owner, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _rows(route: np.ndarray, block: int, widths: list[int], *fields: np.ndarray) -> pa.Table:
    """One packed row per route."""
    order = np.lexsort((fields[0], route))
    cuts = np.flatnonzero(np.append(True, route[order][1:] != route[order][:-1])) if len(order) else np.zeros(0, np.int64)
    groups = np.split(order, cuts[1:]) if len(order) else []
    return pa.table({
        "route": pa.array([int(route[g[0]]) for g in groups], pa.int64()),
        "block": pa.array([block] * len(groups), pa.int64()),
        "n": pa.array([len(g) for g in groups], pa.int64()),
        "data": pa.array([pack(*[(f[g], w) for f, w in zip(fields, widths, strict=True)]) for g in groups], pa.binary()),
    })


def _read(table: pa.Table, widths: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    sizes = table.column("n").to_pylist()
    return unpack(table.column("data").to_pylist(), sizes, widths), np.repeat(table.column("block").to_numpy(), sizes)


def _replies(blocks: np.ndarray, widths: list[int], *fields: np.ndarray) -> pa.Table:
    """Packed rows for the blocks that asked; here route is the block that gets the row."""
    return _rows(blocks, 0, widths, *fields)


def _key(table: pa.Table, name: str = "block") -> int:
    return table.column(name)[0].as_py()


def dedup_passages(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS, with_text: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and kept_sha256 for each document; with_text adds
    kept (binary), what is left of the text.

    Defined cases: a null text is empty; texts shorter than ``width`` lose nothing; documents
    with equal ids do not affect each other; a null id counts as larger than all ids, and
    documents without an id do not affect each other; an empty table gives an empty one;
    further columns are ignored.  id_col is a whole number.
    """
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()[0]
    n_blocks = 1 + size // block_bytes
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("_id", "t"), F.lit(n_blocks)))
    buckets = _U(n_blocks)
    # as many bytes of a trigger's hash as keep chance matches rare in a corpus of this size
    trig_bytes = min(8, max(4, -(-(int(size).bit_length() + 6) // 8)))
    shift = 64 - 8 * trig_bytes

    def send_triggers(table: pa.Table) -> pa.Table:
        trig = np.unique(Block(table, width, shift).trig)
        return _rows((trig % buckets).astype(np.int64), _key(table), [trig_bytes], trig)

    def meet_triggers(table: pa.Table) -> pa.Table:
        (trig,), block = _read(table, [trig_bytes])
        _, group, size = np.unique(trig, return_inverse=True, return_counts=True)
        many = size[group] > 1
        return _replies(block[many], [trig_bytes, 1], trig[many], (size[group[many]] > hot_blocks).astype(np.int64))

    half = (width - GRAM) // 2

    def send_phrases(docs_: pa.Table, replies: pa.Table) -> pa.Table:
        widths = [trig_bytes, 8, 8, 1, 2, 2]
        if not docs_.num_rows:
            return _rows(np.zeros(0, np.int64), 0, widths, *[np.zeros(0, np.int64)] * 6)
        b = Block(docs_, width, shift)
        (trig, hot), _ = _read(replies, [trig_bytes, 1])
        at = find((b.trig,), (trig,))
        shared = np.flatnonzero(at >= 0)
        _, head, low = first_ids(b.id[shared], b.trig[shared], b.whole[shared])
        pick = shared[head]
        is_hot = hot[at[pick]].astype(np.int64)
        route = np.where(is_hot == 1, mix(b.trig[pick] ^ b.whole[pick]) % buckets, b.trig[pick] % buckets).astype(np.int64)
        return _rows(route, _key(docs_), widths, b.trig[pick], b.whole[pick], low, is_hot, *b.sides(pick, half))

    def meet_phrases(table: pa.Table) -> pa.Table:
        (trig, whole, low, hot, left, right), block = _read(table, [trig_bytes, 8, 8, 1, 2, 2])
        group, head, first = first_ids(low.view(np.int64), trig, whole)
        flags = shared_sides(trig[head], left[head], right[head]) | np.where(hot[head] == 1, 3, 0)
        # a block learns nothing where it has the first document and no suffix is asked for
        news = (flags[group] > 0) | (low.view(np.int64) > first[group])
        return _replies(block[news], [8, 8, 1], phrase_key(trig, whole)[news], first[group[news]], flags[group[news]])

    def send_suffixes(docs_: pa.Table, replies: pa.Table) -> pa.Table:
        """Suffixes go to their bucket; removed spans and the phrases to be asked about, under the
        route -1 - block, to the last step."""
        if not docs_.num_rows:
            return _rows(np.zeros(0, np.int64), 0, [3, 8, 8], *[np.zeros(0, np.int64)] * 3)
        b, me = Block(docs_, width, shift), _key(docs_)
        (phrase, low, flags), _ = _read(replies, [8, 8, 1])
        group, head, first = first_ids(b.id, b.trig, b.whole)
        at = find((phrase_key(b.trig[head], b.whole[head]),), (phrase,))
        known = at >= 0
        first[known] = np.minimum(first[known], low.view(np.int64)[at[known]])
        several = np.bincount(np.unique(b.trig[head], return_inverse=True)[1], minlength=1)
        several = several[np.unique(b.trig[head], return_inverse=True)[1]] > 1
        ask_flags = np.zeros(len(head), np.int64)
        here = np.flatnonzero(several)
        ask_flags[here] = shared_sides(b.trig[head[here]], *b.sides(head[here], half))
        ask_flags[known] |= flags[at[known]].astype(np.int64)
        gone = b.id > first[group]
        base = b.offsets[b.doc]
        spans = [b.doc[gone], (b.lo - base)[gone], (b.hi + width - base)[gone]]
        ask = np.flatnonzero(~gone & (ask_flags[group] > 0))
        owner, start = windows_of(b.lo[ask], b.hi[ask], b.at[ask], ask_flags[group[ask]], half)
        owner = ask[owner]
        suffix = b.suffixes(owner, start)
        _, head, low = first_ids(b.id[owner], b.trig[owner], suffix)
        out = _rows((mix(suffix[head]) % buckets).astype(np.int64), me, [3, 8, 8], b.trig[owner[head]], suffix[head], low)
        own = pack((b.doc[ask], 4), ((b.lo - base)[ask], 5), ((b.hi - b.lo)[ask], 2), ((b.at - b.lo)[ask], 1), (ask_flags[group[ask]], 1))
        mine = pa.table({"route": [-1 - me, -1 - me], "block": [me, me], "n": [len(spans[0]), -len(ask)], "data": [pack(*[(s, 5) for s in spans]), own]}, schema=out.schema)
        return pa.concat_tables([out, mine])

    def meet_suffixes(table: pa.Table) -> pa.Table:
        if _key(table, "route") < 0:  # passes through; the sign of n tells spans from phrases
            return table.set_column(0, "route", table.column("block"))
        (trig, suffix, low), block = _read(table, [3, 8, 8])
        group, _, first = first_ids(low.view(np.int64), trig, suffix)
        many = (np.bincount(group, minlength=1)[group] > 1) & (low.view(np.int64) > first[group])
        out = _replies(block[many], [3, 8, 8], trig[many], suffix[many], first[group[many]])
        return out.set_column(1, "block", pa.array([-1] * out.num_rows, pa.int64()))

    def remove(docs_: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block(docs_, width, shift, parse=False)
        sizes, tags, blobs = (replies.column(c).to_pylist() for c in ("n", "block", "data"))
        pick = lambda test: [i for i in range(len(sizes)) if test(i)]
        read = lambda rows, widths: unpack([blobs[i] for i in rows], [abs(sizes[i]) for i in rows], widths)
        doc, lo, hi = (x.astype(np.int64) for x in read(pick(lambda i: tags[i] >= 0 and sizes[i] >= 0), [5, 5, 5]))
        at, begin, long, place, flags = (x.astype(np.int64) for x in read(pick(lambda i: tags[i] >= 0 and sizes[i] < 0), [4, 5, 2, 1, 1]))
        known_t, known_s, known_low = read(pick(lambda i: tags[i] < 0), [3, 8, 8])
        found = [(doc, lo, hi)]
        low_bits = _U((1 << 24) - 1)
        begin += b.offsets[at]
        order = np.argsort(begin, kind="stable")
        at, begin, long, place, flags = at[order], begin[order], long[order], place[order], flags[order]
        asked: list[tuple] = []
        for a, e, _, _ in pieces(b.offsets, width):
            here = np.arange(np.searchsorted(begin, a), np.searchsorted(begin + long + width, e, side="right"))
            if not len(here):
                continue
            prefix = prefix_sums(b.buf[a:e])
            x = begin[here] - a
            owner, start = windows_of(x, x + long[here], x + place[here], flags[here], half)
            trig = (span_hashes(prefix, x + place[here], x + place[here] + GRAM) >> _U(shift)) & low_bits
            asked.append((at[here[owner]], start + a, trig[owner], span_hashes(prefix, start, start + width)))
        if asked:
            at, start, trig, suffix = (np.concatenate(x) for x in zip(*asked, strict=True))
            group, head, first = first_ids(b.ids[at], trig, suffix)
            where = find((trig[head], suffix[head]), (known_t, known_s))
            known = where >= 0
            first[known] = np.minimum(first[known], known_low.view(np.int64)[where[known]])
            gone = b.ids[at] > first[group]
            found.append((at[gone], (start - b.offsets[at])[gone], (start - b.offsets[at])[gone] + width))
        doc, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((lo, doc))
        base = b.offsets[doc[order]]
        # spans of neighbouring texts may touch, so they are united a text at a time
        cuts = np.searchsorted(doc[order], np.arange(len(b.ids) + 1))
        lo, hi = lo[order] + base, hi[order] + base
        data = b.buf.tobytes()
        removed, n_spans, digests, kept = [], [], [], []
        for d in range(len(b.ids)):
            s, e = spans_union(lo[cuts[d] : cuts[d + 1]], hi[cuts[d] : cuts[d + 1]])
            edges = [int(b.offsets[d]), *np.stack([s, e], axis=1).ravel().tolist(), int(b.offsets[d + 1])]
            rest = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            removed.append(int((e - s).sum()))
            n_spans.append(len(s))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest if with_text else None)
        out = {"_id": b.raw_ids, "n_bytes": pa.array(np.diff(b.offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    texts = dealt.groupBy("block")
    triggers = texts.applyInArrow(send_triggers, _PART).groupBy("route").applyInArrow(meet_triggers, _PART)
    found = texts.cogroup(triggers.groupBy("route")).applyInArrow(send_phrases, _PART).groupBy("route").applyInArrow(meet_phrases, _PART)
    cut = texts.cogroup(found.groupBy("route")).applyInArrow(send_suffixes, _PART).groupBy("route").applyInArrow(meet_suffixes, _PART)
    fields = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    out = texts.cogroup(cut.groupBy("route")).applyInArrow(remove, fields)
    return out.withColumnRenamed("_id", id_col)


def op2_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, {2 * WIDTH})) AS k FROM (SELECT *, unnest(range(0, (length(x) // 2 - {WIDTH} + 1)::BIGINT)) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM w) WHERE low < doc_id),
s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM
      (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WIDTH} THEN 0 ELSE 1 END AS fresh FROM m)),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + {WIDTH} AS hi FROM s GROUP BY doc_id, run),
g AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS done FROM r),
t AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(hi) AS last FROM g GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(x, 2 * done + 1, 2 * (lo - done)), '' ORDER BY lo) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""
