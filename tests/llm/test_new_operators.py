"""Packing, tokenizer alignment and the conversation trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import alignment, packing, segments, trie
from tests.oracle import SF

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
TEXTS = [
    (1, "Plain words, don't they'll 12,345 tabs\tand\nlines \n\n end "), (2, None), (3, ""), (4, " "), (5, "  two  spaces   three "), (6, "a▁b"), (7, "é ü ß " * 40), (8, "语言模型 测试 " * 20), (9, "x　 y​ z <|endoftext|> <s> <0x0A>"),
    (10, "ab" * 4000), (None, "same"), (None, "same"), (1, "same"), (11, "\x00 \x1c nul"), (12, "  "), (13, "🙂 emoji🙂🙂 ꙮ"), (14, LONG), (15, "\n \t x᠎ y﻿ z"),
]


@lru_cache
def whole():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def ids_of(text):
    return whole()[0].encode(text or "", add_special_tokens=False).ids


# segments


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'ab.1é▁　 ​𝔞"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=6))
def test_segments_give_the_ids_of_whole_texts(texts):
    known = packing._ids(segments.byte_bpe_path(), segments.byte_ranks_path())
    codes, begin = known.segments.codes(pa.array(texts))
    ids, at = known.ids.gather(codes)
    ends = at[begin]
    assert [ids[x:y].tolist() for x, y in zip(ends, ends[1:], strict=False)] == [ids_of(t) for t in texts]


def test_no_piece_crosses_a_cut():
    b = whole()[1]
    assert not [p for p in map(b.id_to_piece, range(b.get_piece_size())) if "▁" in p.lstrip("▁")]


def test_segments_are_forgotten(monkeypatch):
    monkeypatch.setattr(segments, "KEPT_SEGMENTS", 5)
    known = packing._Ids(segments.byte_bpe_path(), segments.byte_ranks_path())
    for text in ("one two three four", "five six seven eight nine", "one two nine"):
        codes, begin = known.segments.codes(pa.array([text]))
        assert known.ids.gather(codes)[0].tolist() == ids_of(text)
    assert known.segments.n <= 10


# packing


def test_packing(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("other") for c in ("piece", "start", "length", "block", "again", "in_id")})
    for block in (1 << 16, 4):
        rows = packing.pack_documents(docs.repartition(3), block=block).collect()
        want = Counter()
        for i, t in TEXTS:
            ids = [*ids_of(t), 0]
            cuts = list(range(len(ids), 0, -2048))[::-1]
            for k, end in enumerate(cuts):
                start = cuts[k - 1] if k else 0
                want[i, k, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())] += 1
        assert Counter(tuple(r)[:5] for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) == -(-sum(r["length"] for r in rows) // 2048)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_search_empties_sequences_that_best_fit_leaves():
    """Triples that fill a sequence exactly, which best fit in descending order tears apart;
    and random sizes: no piece is lost, no sequence grows too full or their number larger."""
    for capacity, n in ((100, 40), (1000, 60), (2048, 300)):
        rng, sizes = random.Random(n), []
        for _ in range(n):
            a = rng.randint(int(0.38 * capacity), int(0.49 * capacity))
            b = rng.randint(int(0.25 * capacity), (capacity - a) // 2)
            sizes += [a, b, capacity - a - b]
        plain = packing.Bins(capacity)
        plain.best_fit(sorted(sizes, reverse=True))
        _, fill = packing.pack(np.array(sizes), capacity)
        assert len(fill) - n <= 0.2 * (len(plain.items) - n)
    for seed in range(60):
        rng = random.Random(seed)
        sizes = np.array([rng.choice([rng.randint(20, 50), rng.randint(10, 35), rng.randint(5, 15)]) for _ in range(rng.randint(5, 80))])
        plain = packing.Bins(100)
        plain.best_fit(sorted(sizes.tolist(), reverse=True))
        bins, fill = packing.pack(sizes, 100)
        assert fill.max() <= 100 and len(bins) == len(sizes) and (np.bincount(bins, weights=sizes) == fill).all()
        assert -(-sizes.sum() // 100) <= len(fill) <= len(plain.items)


@pytest.mark.parametrize(
    ("items", "emptied"),
    [
        ([[60, 30], [50, 41], [9]], True),  # a move
        ([[50, 30], [70, 15], [35]], True),  # 35 for 15, then 15 into a gap
        ([[40, 20, 20], [90], [60]], False),  # nothing fits
        ([[30, 30, 20], [80, 5], [35]], True),
    ],
)
def test_exchanges(items, emptied):
    bins = packing.Bins(100)
    for held in items:
        bins.items.append(list(held))
        bins.gap.append(100 - sum(held))
        bins._gap_in(len(bins.items) - 1)
    before = sum((100 - g) ** 2 for g in bins.gap)
    bins.search()
    left = [b for b in bins.items if b]
    assert sorted(x for b in left for x in b) == sorted(x for b in items for x in b)
    assert (len(left) < len(items)) == emptied
    assert sum(sum(b) ** 2 for b in left) >= before


# alignment


def plain_alignment(rows):
    a, b = whole()
    letters, docs, count = alignment.byte_level(), [], Counter()
    for i, text in rows:
        found = a.encode(" " + (text or ""), add_special_tokens=False)
        pieces = b.encode(text or "")
        spelt_a = [bytes(letters[c] for c in t) for t in found.tokens]
        spelt_b = [bytes([int(b.id_to_piece(p)[3:5], 16)]) if b.is_byte(p) else b.id_to_piece(p).replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(spelt_a) != (" " + text).encode() or b"".join(spelt_b) != (" " + text).encode():
            docs.append((i, None))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in spelt_a]).tolist(), np.cumsum([len(t) for t in spelt_b]).tolist()
        groups, lo = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([t for t, e in zip(found.ids, ends_a, strict=True) if lo < e <= cut], [t for t, e in zip(pieces, ends_b, strict=True) if lo < e <= cut]) if len(ends_a) < 9000 else None)
            lo = cut
        if len(ends_a) >= 9000:
            groups = fast_groups(found.ids, ends_a, pieces, ends_b)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links.keys())
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        docs.append((i, (len(ends_a), len(ends_b), len(groups), sum(links.values()), links, hashlib.sha256(text.encode()).hexdigest())))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return sorted(((i, 0, 0, 0, 0, 0, 0, "") if d is None else (i, *d[:4], sum(n for p, n in d[4].items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in d[4].items()), d[5]) for i, d in docs), key=str)


def fast_groups(a, ends_a, b, ends_b):
    groups, x, y = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        i, j = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
        groups.append((a[x:i], b[y:j]))
        x, y = i, j
    return groups


@pytest.mark.parametrize(("long_bytes", "range_bytes"), [(1 << 16, 1 << 15), (60, 23)])
def test_alignment(spark, long_bytes, range_bytes):
    rows = [r for r in TEXTS if r[0] != 14]
    if range_bytes > 1000:
        rows = TEXTS + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("other") for c in ("part", "rid", "code", "in_text", "n_a")})
    got = alignment.align_tokenizers(docs.repartition(3), long_bytes=long_bytes, range_bytes=range_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == plain_alignment(rows)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).count() == 0


TOKENS = st.lists(st.integers(1, 4), min_size=0, max_size=12)


@settings(max_examples=200, deadline=None)
@given(TOKENS, TOKENS, st.lists(st.integers(0, 30), max_size=6), st.randoms())
def test_fragments_compose_in_any_order(sizes_a, sizes_b, cuts, rng):
    total = max(sum(sizes_a), sum(sizes_b))
    sizes_a, sizes_b = [*sizes_a, total - sum(sizes_a)], [*sizes_b, total - sum(sizes_b)]
    sizes_a, sizes_b = [s for s in sizes_a if s], [s for s in sizes_b if s]
    ends_a, ends_b = np.cumsum(sizes_a).tolist(), np.cumsum(sizes_b).tolist()
    a, b = list(range(len(ends_a))), list(range(100, 100 + len(ends_b)))
    edges = sorted({0, total, *(c for c in cuts if c < total)})
    parts = [alignment.fragment_of(a, ends_a, b, ends_b, lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)]
    want = alignment.fragment_of(a, ends_a, b, ends_b, 0, total)
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [alignment.compose(parts[i], parts[i + 1])]
    if parts:
        assert parts[0] == want
        none = alignment.Fragment(([], []), [], ([], []), False)
        assert alignment.compose(none, want) == alignment.compose(want, none) == want


# trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(set)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])
        line = tuple(base[:h] + turns[h:])
        for d in range(len(line) + 1):
            members[line[:d]].add(c)
        ends[line].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items()
    )


CONV = "conv_id long, turn long, role string, text string"


def trie_rows(spark, rows):
    turns = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("other") for c in ("conv", "depth", "id", "parent", "words", "gone")})
    return sorted((tuple(r) for r in trie.conversation_trie(turns.repartition(3)).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "PIECE", 4)
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "c d e", "é\tx"])) for c in [*range(0, 45), -3, -20, 1000] for t in range(rng.choice([1, 2, 3, 7]))]
    rows += [(60, t, "user", f"turn {t} of many") for t in range(70)] + [(61, t, "user", f"turn {t} of many") for t in range(66)]
    rows += [(5, None, "user", "first"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (None, 1, "user", "no id"), (None, None, None, None)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(5)]
    want = plain_trie(rows)
    assert trie_rows(spark, rows) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_trie_of_nothing(spark):
    assert trie_rows(spark, []) == [] and trie_rows(spark, [(None, 1, "user", "x")]) == []


def test_contraction_of_random_trees(spark, monkeypatch):
    """Chains, stars and random trees with depths that do not follow each other."""
    monkeypatch.setattr(trie, "DEPTH_BITS", 4)
    rng = random.Random(1)
    nodes, parent = [], {}
    for tree in range(3):
        names = [f"{tree}-{i}".encode() for i in range(120)]
        for i, n in enumerate(names):
            up = None if i == 0 else names[i - 1] if tree == 0 else names[0] if tree == 1 else names[max(0, i - rng.randint(1, 3))]
            parent[n] = up
            nodes.append((n, up, i * 8 if tree else i, rng.randint(0, 5), rng.randint(0, 9)))
    n_children = Counter(p for p in parent.values() if p)
    totals = {n: [leaf, saved] for n, _, _, leaf, saved in nodes}
    for n, _, _, leaf, saved in nodes:
        up = parent[n]
        while up is not None:
            totals[up][0] += leaf
            totals[up][1] += saved
            up = parent[up]
    df = spark.createDataFrame([(*r, n_children[r[0]]) for r in nodes], "id binary, parent binary, depth long, leaf long, saved long, n_children long")
    rounds = trie.contract(df)
    got = {bytes(r["id"]): [r["leaf"], r["saved"]] for r in trie.expand(rounds).collect()}
    assert got == totals
    assert len(rounds) < 40  # far fewer than the 120 levels of the chain
