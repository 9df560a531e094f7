"""Best-fit packing of documents into token sequences, improved by swap-based local search.

1. Each document's token ids are counted and cut into pieces of ``CAPACITY``; what is left
   over is its first piece.  A piece that fills a sequence is one.
2. The other pieces are dealt evenly into blocks of a bounded size.  In a block, best fit in
   descending order places them; then the lightest sequence is emptied into the others: a
   piece moves into a gap, or is exchanged for a smaller one, or for two that are smaller
   together, or two of its pieces for one.  Every exchange makes the lighter sequence lighter,
   so the sum of squared fills rises and the search ends.
3. Sequences that a block could not fill (a bounded number) are opened again, ``FAN`` blocks
   together, until one block is left.

A block holds lengths alone; no step sees more than BLOCK pieces or FAN * OPEN sequences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import stored
from .segments import Lists, Segments, byte_bpe, byte_bpe_path, byte_ranks_path, text_runs

CAPACITY = 2048
#: The id that ends every document.
END_ID = 0
#: Pieces of a block, unfilled sequences that it hands on, and blocks that meet then.
BLOCK, OPEN, FAN = 1 << 16, 256, 64
#: Pairs are looked for in sequences of so many pieces at most.
PAIRED = 24
#: Sizes that a search looks at for each exchange, from the best fit on, and offers of each.
TRIED = 32
#: Bytes of text that are encoded together.
RUN_BYTES = 8 << 20


class Bins:
    """Sequences of a block: which sizes each holds, and indexes of gaps and exchanges."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.gap: list[int] = []
        self.by_gap: dict[int, set[int]] = defaultdict(set)
        self.gaps = 0  # bit g: some sequence has gap g > 0

    def _gap_in(self, b: int) -> None:
        g = self.gap[b]
        if g:
            self.by_gap[g].add(b)
            self.gaps |= 1 << g

    def _gap_out(self, b: int) -> None:
        g = self.gap[b]
        if g:
            self.by_gap[g].discard(b)
            if not self.by_gap[g]:
                self.gaps &= ~(1 << g)

    def best_fit(self, sizes: list[int]) -> None:
        """``sizes`` in descending order, each into the smallest gap that takes it."""
        for s in sizes:
            fits = self.gaps >> s
            if fits:
                g = s + (fits & -fits).bit_length() - 1
                b = next(iter(self.by_gap[g]))
                self._gap_out(b)
                self.items[b].append(s)
                self.gap[b] = g - s
            else:
                b = len(self.items)
                self.items.append([s])
                self.gap.append(self.capacity - s)
            self._gap_in(b)

    def _takes(self, b: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """(largest size that fits when they leave, what leaves, its parts) of ``b``."""
        sizes, g = sorted(set(self.items[b])), self.gap[b]
        out = [(t + g, t, (t,)) for t in sizes]
        if len(self.items[b]) <= PAIRED:
            mine = sorted(self.items[b])
            out += [(x + y + g, x + y, (x, y)) for i, x in enumerate(mine) for y in mine[i + 1 :]]
        return out

    def search(self) -> None:
        """Empty the lightest sequences as far as moves and exchanges go."""
        least = -(-sum(map(sum, self.items)) // self.capacity)
        offers: dict[int, dict[tuple[int, tuple[int, ...]], int]] = defaultdict(dict)
        seen = [0]  # bit u: an offer takes sizes up to u

        def offer(b: int, add: bool) -> None:
            if not self.gap[b]:
                return
            for u, _, parts in self._takes(b):
                if add:
                    offers[u][(b, parts)] = 1
                    seen[0] |= 1 << u
                else:
                    offers[u].pop((b, parts), None)
                    if not offers[u]:
                        seen[0] &= ~(1 << u)

        for b in range(len(self.items)):
            offer(b, True)
        left = len(self.items)
        for light in sorted(range(len(self.items)), key=lambda b: -self.gap[b]):
            if left <= least:
                break
            if not self.items[light] or not self.gap[light]:
                continue
            offer(light, False)
            self._gap_out(light)
            while self.items[light]:
                done = self._exchange(light, offers, seen, offer)
                if not done:
                    break
            if self.items[light]:
                self._gap_in(light)
                offer(light, True)
            else:
                left -= 1

    def _exchange(self, light: int, offers: dict, seen: list[int], offer) -> bool:
        """One move or exchange that takes weight from ``light``; the one that fills best."""
        mine = sorted(self.items[light], reverse=True)
        fill = self.capacity - self.gap[light]
        gives = [(s, (s,)) for s in dict.fromkeys(mine)]
        if len(mine) <= PAIRED:
            gives += [(x + y, (x, y)) for i, x in enumerate(mine) for y in mine[i + 1 :] if x + y <= self.capacity]
        best = None
        for s, out in gives:
            fits = self.gaps >> s
            if fits:  # a move
                g = s + (fits & -fits).bit_length() - 1
                b = next(iter(self.by_gap[g]))
                if self.capacity - g >= fill - s:
                    found = (g - s, -s, b, out, ())
                    if best is None or found[:2] < best[:2]:
                        best = found
            fits, tries = seen[0] >> s, TRIED
            while fits and tries:
                tries -= 1
                u = s + (fits & -fits).bit_length() - 1
                if best is not None and u - s > best[0]:
                    break
                hit = next(((b, parts) for b, parts in islice(offers[u], TRIED) if sum(parts) < s and len(parts) + len(out) <= 3 and self.capacity - self.gap[b] >= fill - s + sum(parts)), None)
                if hit:
                    found = (u - s, sum(hit[1]) - s, hit[0], out, hit[1])
                    if best is None or found[:2] < best[:2]:
                        best = found
                    break
                fits &= fits - 1
            if best is not None and best[0] == 0:
                break
        if best is None:
            return False
        _, _, b, out, back = best
        offer(b, False)
        self._gap_out(b)
        for x in out:
            self.items[light].remove(x)
            self.items[b].append(x)
        for x in back:
            self.items[b].remove(x)
            self.items[light].append(x)
        moved = sum(out) - sum(back)
        self.gap[b] -= moved
        self.gap[light] += moved
        self._gap_in(b)
        offer(b, True)
        return True


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number of each length, and each sequence's fill; none is over ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    bins = Bins(capacity)
    bins.best_fit(lengths[order].tolist())
    bins.search()
    kept = [b for b in bins.items if b]
    waiting: dict[int, list[int]] = defaultdict(list)
    for i in order[::-1].tolist():
        waiting[int(lengths[i])].append(i)
    out = np.zeros(len(lengths), np.int64)
    for number, sizes in enumerate(kept):
        for s in sizes:
            out[waiting[s].pop()] = number
    return out, np.array([sum(b) for b in kept], np.int64)


class _Ids:
    """Token ids of segments, kept in a worker from task to task."""

    def __init__(self, path: str, ranks_path: str | None) -> None:
        self.encode = byte_bpe(path, ranks_path)
        self.segments = Segments(self.learn, self.forget, lead=False)

    def forget(self) -> None:
        self.ids = Lists(np.uint32)

    def learn(self, strings: list[str]) -> None:
        self.ids.add(*self.encode(strings))


@lru_cache(maxsize=2)
def _ids(path: str, ranks_path: str | None) -> _Ids:
    return _Ids(path, ranks_path)


def document_pieces(docs: DataFrame, text: str, id_col: str, capacity: int, path: str, ranks_path: str | None) -> DataFrame:
    """One row per piece: in_id, piece, start, length, ids_crc32."""
    schema = StructType([StructField("in_id", docs.schema[id_col].dataType), StructField("piece", IntegerType())] + [StructField(c, LongType()) for c in ("start", "length", "ids_crc32")])

    def cut(batches):
        known = _ids(path, ranks_path)
        for batch in batches:
            for lo, hi in text_runs(batch.column(1), RUN_BYTES):
                codes, begin = known.segments.codes(batch.column(1).slice(lo, hi - lo))
                ids, at = known.ids.gather(codes)
                ends = at[begin[1:]]
                ids = np.insert(ids, ends, END_ID).astype("<u4")
                ends = ends + np.arange(1, len(ends) + 1)
                n = np.diff(ends, prepend=0)
                first = n - (-(-n // capacity) - 1) * capacity  # 1 .. capacity
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(number == 0, 0, first[doc] + (number - 1) * capacity)
                length = np.where(number == 0, first[doc], capacity)
                where = (ends - n)[doc] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(where.tolist(), (where + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=schema.names,
                )

    return docs.select(F.col(id_col).alias("in_id"), F.col(text).alias("in_text")).mapInArrow(cut, schema)


def _packed(table: pa.Table, capacity: int, level: int, block: int, last: bool) -> pa.Table:
    """``table``'s pieces packed: sequence_id, offset, and whether the sequence is opened again."""
    bins, fill = pack(np.asarray(table.column("length"), dtype=np.int64), capacity)
    again = np.zeros(len(fill), bool)
    if not last:
        lightest = np.argsort(fill, kind="stable")[:OPEN]
        again[lightest] = fill[lightest] < capacity
    order = np.argsort(bins, kind="stable")
    length = np.asarray(table.column("length"), dtype=np.int64)[order]
    before = np.cumsum(length) - length
    own = bins[order]
    first = np.searchsorted(own, np.arange(len(fill)))
    table = table.select(["in_id", "piece", "start", "length", "ids_crc32"]).take(pa.array(order))
    for name, column in (
        ("block", pa.array(np.full(len(own), block, np.int64))),
        ("sequence_id", pa.array((level << 56) + (block << 20) + own)),
        ("offset", pa.array(before - before[first][own] if len(own) else before)),
        ("again", pa.array(again[own] if len(own) else np.zeros(0, bool))),
    ):
        table = table.append_column(name, column)
    return table


def _repacked(capacity: int, level: int, last: bool):
    def run(key, table):
        return _packed(table, capacity, level, key[0].as_py(), last)

    return run


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, text: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, ranks: str | None = None
) -> DataFrame:
    """Pieces of all documents and the sequence and place of each.

    ``tokenizer`` and ``ranks``: paths of a byte-level BPE file and of a rank file of the same
    vocabulary (both default to the public one; with a tokenizer of your own and no ranks the
    tokenizer file alone is used).

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset.  Defined cases: null
    and empty texts are one piece of one token (the end); null and repeated ids keep their
    rows; very long texts give many full pieces and one that may be shorter; equal lengths are
    interchangeable; an empty table gives an empty result; further columns are ignored.
    """
    if tokenizer is None:
        tokenizer, ranks = byte_bpe_path(), byte_ranks_path()
    pieces = stored(document_pieces(docs, text, id_col, capacity, tokenizer, ranks), "pack-pieces")
    columns = ["in_id", "piece", "start", "length", "ids_crc32"]
    schema = StructType([*[pieces.schema[c] for c in columns], StructField("block", LongType()), StructField("sequence_id", LongType()), StructField("offset", LongType()), *StructType.fromDDL("again boolean").fields])
    full = pieces.filter(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block))

    def first(batches):
        from pyspark import TaskContext

        found = [b for b in batches if b.num_rows]  # at most a block, dealt evenly
        if found:
            yield from _packed(pa.Table.from_batches(found).combine_chunks(), capacity, 1, TaskContext.get().partitionId(), blocks == 1).to_batches()

    level = 1
    now = stored(rest.select(*columns).repartition(blocks).mapInArrow(first, schema), "pack-1")
    done = [full, now.filter("not again").select(*columns, "sequence_id", "offset")]
    while blocks > 1:
        level, blocks = level + 1, -(-blocks // FAN)
        opened = now.filter("again").withColumn("block", F.expr(f"block div {FAN}"))
        now = stored(opened.groupBy("block").applyInArrow(_repacked(capacity, level, blocks == 1), schema), f"pack-{level}")
        done.append(now.filter("not again").select(*columns, "sequence_id", "offset"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("in_id", id_col)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
