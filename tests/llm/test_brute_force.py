"""Operators against plain versions of what they promise."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from docloom.llm import bytevec, decontaminate, hmm, lines, mixing, parsing, quality, queries, sharding, simhash, urlfilter, warc
from tests.oracle import SF, assert_same, connection

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, connection(), queries.QUERIES[name], queries.ORACLE_SQL[name])


def plain_removed(texts, width=50):
    first = {}
    out = {}
    for d in sorted(texts):
        b = texts[d].encode()
        gone = np.zeros(len(b), bool)
        mine = set()
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if first.get(w, d) < d:
                gone[i : i + width] = True
            mine.add(w)
        for w in mine:
            first.setdefault(w, d)
        out[d] = gone
    return out


def test_passages_in_many_blocks(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab c") for _ in range(rng.randint(40, 130))) for _ in range(12)]
    texts = {i: "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("xyz é") for _ in range(30)) for _ in range(6)) for i in range(60)}
    texts[60], texts[61], texts[62] = "a" * 300, "a" * 49, "ab" * 200
    want = plain_removed(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for blocks, hot in ((1 << 23, 1024), (700, 1)):
        for r in parsing.dedup_passages(df, block_bytes=blocks, hot_blocks=hot).collect():
            gone = want[r["doc_id"]]
            kept = bytes(np.frombuffer(texts[r["doc_id"]].encode(), np.uint8)[~gone])
            runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(parsing, "RUN_BYTES", 500)
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 5000])
    starts = []
    for a, b, off, _ in parsing.pieces(offsets, 50):
        _, lo, hi, *_ = parsing.phrases(data[a:b], off)
        for x, y in zip(lo, hi, strict=True):
            starts += list(range(a + x, a + y + 1))
    assert starts == list(range(4951))


def fingerprint(text):
    w = BLANK.findall(text.translate(LOWER))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum((2 * sum((x >> b) & 1 for x in h) > len(h)) << b for b in range(64))


def bands_of(text):
    """Band keys in plain integers; a word's hash is that of the word alone."""
    full = (1 << 64) - 1

    def mix(h):
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & full
        h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & full
        return h ^ (h >> 33)

    def word(w):
        b = np.frombuffer(w.encode(), np.uint8)
        return int(bytevec.span_hashes(bytevec.prefix_sums(b), np.array([0]), np.array([len(b)]))[0])

    w = [word(x) for x in BLANK.findall(text.translate(LOWER))]
    shingles = [w[i : i + 5] for i in range(len(w) - 4)] or ([w] if w else [])
    hashes = []
    for s in shingles:
        h = 0
        for i, x in enumerate(s):
            h = mix(h ^ ((x + i + 1) & full))
        hashes.append(h)
    keys = set()
    for b in range(simhash.BANDS if hashes else 0):
        key = b + 1
        for r in range(simhash.ROWS):
            key = mix(key ^ min(h * int(simhash.MULTIPLIERS[b * simhash.ROWS + r]) & full for h in hashes))
        keys.add(key)
    return keys


def components(fps, bands=None, radius=4):
    ids = sorted(fps)
    a = np.array([fps[i] for i in ids], np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    holders = defaultdict(list)
    for i, d in enumerate(ids):
        for key in (bands or {}).get(d, ()):
            holders[key].append(i)
    for rows in holders.values():
        near[np.ix_(rows, rows)] = True
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return {d: ids[x] for d, x in zip(ids, label, strict=True)}
        label = new


def test_simhash(spark, texts):
    fps = {d: fingerprint(t) for d, t in texts.items()}
    want = components(fps)
    for r in queries.QUERIES["op7_simhash"](spark, SF).collect():
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize(("n", "tile"), [(400, 4096), (400, 16), (1 << 23, 16), (1 << 31, 4096)])
def test_tiles_lose_no_link(spark, n, tile):
    rng = random.Random(n + tile)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        f = rng.choice(fps[-40:] + fps[:3])
        for b in rng.sample(range(64), rng.randint(1, 5)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(simhash.stored(spark.createDataFrame([(f,) for f in signed], "fp long"), "t"), n, tile=tile).collect()
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        assert ((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 4
        parent[max(root(r["a"]), root(r["b"]))] = min(root(r["a"]), root(r["b"]))
    want = components(dict(enumerate(fps)))
    assert {frozenset(i for i in range(len(fps)) if root(signed[i]) == x) for x in map(root, signed)} == {frozenset(i for i in want if want[i] == x) for x in want.values()}
    assert len(found) <= 70 * len(fps)


def test_sharding_laws(spark, texts):
    rows = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    load = Counter()
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t)
        load[r["shard"]] += r["size"]
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    groups = Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 8
    heap = [0] * sharding.SHARDS
    for s in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + s)
    assert max(load.values()) <= max(heap) * 1.05 and min(load.values()) >= min(heap) * 0.95


def test_lpt_prefers_the_least_loaded():
    assert sharding.lpt([5, 9, 4, 4], 2) == [1, 0, 1, 0] and sharding.lpt([], 3) == []


def test_forward_is_exact():
    rng = np.random.default_rng(3)
    k, classes = 3, 5
    start, move, emit = rng.random(k), rng.random((k, k)), rng.random((classes, k))
    start, move, emit = start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)
    seqs = [rng.integers(0, classes, n).astype(np.uint16) for n in (7, 1, 40, 7, 3000)]
    got = np.zeros(len(seqs))
    for owner, matrix, lens in hmm._batches([s.tobytes() for s in seqs], None):
        got[owner] = hmm.forward(matrix, lens, start, move, emit)
    for s, g in zip(seqs, got, strict=True):
        a, log = start * emit[s[0]], 0.0
        for x in s[1:]:
            log += math.log(a.sum())
            a = (a / a.sum()) @ move * emit[x]
        assert abs(log + math.log(a.sum()) - g) < 1e-8
    # expected counts: as many emissions as tokens, one move less per sequence, one start each
    _, matrix, lens = next(hmm._batches([s.tobytes() for s in seqs[:4]], None))
    s, m, e, _ = hmm.expected(matrix, lens, start, move, emit)
    assert abs(s.sum() - 4) < 1e-9 and abs(m.sum() - (lens - 1).sum()) < 1e-8 and abs(e.sum() - lens.sum()) < 1e-8


def test_training_raises_the_likelihood(spark, texts):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op5_hmm"](spark, SF).collect()}
    tokens = {d: [*BLANK.findall(t.translate(LOWER)), ""] for d, t in texts.items()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 5 == 1}
    c = Counter(w for d in texts if d not in held for w in tokens[d])
    n, v = sum(c.values()), len(c)
    for d, r in rows.items():
        assert r["held_out"] == (d in held) and r["n_tokens"] == len(tokens[d]) and r["train_tokens"] == n
        assert r["n_known"] == sum(c[w] > 0 for w in tokens[d])
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[d])) < 1e-6
    gain = sum(rows[d]["score"] - rows[d]["base_score"] for d in held) / sum(rows[d]["n_tokens"] for d in held)
    assert gain > 0.05
    few = hmm.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), rounds=1).collect()
    assert sum(r["score"] for r in few if not r["held_out"]) < sum(r["score"] for r in rows.values() if not r["held_out"])


def test_viterbi_is_the_best_split():
    counts, total = {"the": 50, "there": 20, "re": 5, "in": 9, "therein": 1}, 100

    def p(x):
        return math.log(counts[x] / total) if x in counts else math.log(10 / total) - len(x) * math.log(10)

    for label in ("therein", "inthe", "zthe", "q", "therethe"):
        splits = [[label[i:j] for i, j in zip((0, *cut), (*cut, len(label)), strict=True)] for n in range(1 << (len(label) - 1)) for cut in [tuple(i + 1 for i in range(len(label) - 1) if n >> i & 1)]]
        best = max(sum(map(p, s)) for s in splits)
        assert abs(sum(map(p, urlfilter.viterbi(label, counts, total))) - best) < 1e-9


def test_salvage_recovers_later_records():
    records = [warc.record_bytes(f"urn:page:{i}", "http://a/", b"<p>%d</p>" % i * 40, None) for i in range(8)]
    members = []
    for r in records:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        members.append(z.compress(r) + z.flush())
    rng = random.Random(2)
    for parts in (members, records):
        whole = b"".join(parts)
        starts = np.cumsum([0, *map(len, parts)])
        assert [x[2]["record_id"] for x in warc.salvage(whole)] == [f"urn:page:{i}" for i in range(8)]
        for _ in range(40):
            hurt = rng.randrange(8)
            data = bytearray(whole)
            at = int(starts[hurt]) + (rng.randrange(12, len(parts[hurt]) - 4) if parts is members else records[hurt].index(b"<p>") + rng.randrange(20))
            data[at] ^= 0xFF
            got = list(warc.salvage(bytes(data)))
            assert [x[2]["record_id"] for x in got if x[2]] == [f"urn:page:{i}" for i in range(8) if i != hurt]
            assert sum(x[1] for x in got) == len(data) and any(x[2] is None and x[0] <= at < x[0] + x[1] for x in got)
        cut = whole[: int(starts[5]) + 20]
        assert [x[2]["record_id"] for x in warc.salvage(cut) if x[2]] == [f"urn:page:{i}" for i in range(5)]
        noisy = b"junk" + whole[: int(starts[3])] + b"\x1f\x8b\x08WARC/1.zz" + whole[int(starts[3]) :]
        assert len([x for x in warc.salvage(noisy) if x[2]]) == 8


def norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def line_hash(n):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in n.split(" ")]
    return sum((2 * sum((x >> b) & 1 for x in h) > len(h)) << b for b in range(64))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_lines(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 30, 40, 90]))) for _ in range(25)]
    pool = list(base)
    for b in base:
        for _ in range(3):
            w = b.split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                rng.shuffle(w)
            pool.append(" ".join(w).upper() + rng.choice(["", ".", "  !"]))
    texts = {i: "\n".join(rng.choice([*pool, "", "--"]) for _ in range(rng.randint(1, 9))) for i in range(50)}
    first, order = {}, []
    for d in sorted(texts):
        for pos, line in enumerate(texts[d].split("\n")):
            if norm(line):
                order.append((d, pos, norm(line)))
                first.setdefault(norm(line), (d, pos))
    kinds = sorted(first)
    sims = {k: line_hash(k) for k in kinds}
    parent = {k: k for k in kinds}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (sims[a] ^ sims[b]).bit_count() <= lines.RADIUS and 5 * levenshtein(a, b) <= max(len(a), len(b)):
                parent[root(a)] = root(b)
    keep = {}
    for k in kinds:
        keep[root(k)] = min(keep.get(root(k), (1 << 30, 0)), first[k])
    want = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if not norm(x) or keep[root(norm(x))] == (d, p)) for d, t in texts.items()}
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_pipeline(spark, texts, docs):
    """Each stage by hand, then the shards' rows."""
    own = {r["doc_id"]: r.asDict() for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.quality_rules(docs, keep=["doc_id"]).filter("kept").collect()}
    group = components({d: fingerprint(texts[d]) for d in kept}, {d: bands_of(texts[d]) for d in kept})
    kept = {d for d in kept if group[d] == d}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(r["text"].translate(LOWER))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    assert all(len(w) == 10 for w in windows)
    for d in list(kept):
        w = word.findall(texts[d].translate(LOWER))
        if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)):
            kept.discard(d)
    sizes = Counter(own[d]["source"] for d in kept)
    want = Counter()
    for d in kept:
        rate = len(kept) / len(sizes) / sizes[own[d]["source"]]
        u = int(hashlib.md5(f"{mixing.SEED}|{d}".encode()).hexdigest()[:13], 16) / mixing.UNIT
        p = cdf = math.exp(-rate)
        k = 0
        while u >= cdf:
            k += 1
            p = p * rate / k
            cdf += p
        if k:
            want[d] = k
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_near_copies_share_a_band():
    """Texts with random words replaced: nearly all pairs of a five-word Jaccard index of 0.8 or
    more share a band key; unrelated texts do not.  Bands equal the plain version's."""
    rng = random.Random(3)
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    close = found = 0
    texts = []
    for n in range(150):
        a = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        b = list(a)
        for _ in range(rng.choice([1, 2, 4, 8])):
            b[rng.randrange(len(b))] = f"v{n}"
        x, y = shingles(a), shingles(b)
        near = len(x & y) / len(x | y) >= 0.8
        texts += [" ".join(a), "  ".join(b).upper()]
        close += near
        found += near and bool(bands_of(texts[-1]) & bands_of(texts[-2]))
    assert close > 50 and found >= 0.95 * close
    assert not any(bands_of(texts[0]) & bands_of(t) for t in texts[2:])
    some = [*texts[:20], "", "one two", "\n", "ONE  two"]
    data = [t.encode() for t in some]
    keys, begin = simhash.bands(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in data])]))
    assert [set(keys[x:y].view(np.uint64).tolist()) for x, y in zip(begin, begin[1:], strict=False)] == [bands_of(t) for t in some]


def test_suffix_repeats_against_windows():
    rng = random.Random(4)
    for _ in range(60):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            words += words[: rng.randint(0, 40)]
        text = " ".join(words).encode()
        out = [x[0].as_py() for x in quality.measure(np.frombuffer(text, np.uint8), np.array([0, len(text)]), min_repeat=5)]
        n = len(words)
        longest = next((k for k in range(n - 1, 2, -1) if len({tuple(words[i : i + k]) for i in range(n - k + 1)}) < n - k + 1), 0)

        def cover(k):
            c = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
            return len({j for i in range(n - k + 1) if c[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})

        assert (out[0], out[4], out[6], out[7]) == (n, cover(3), cover(5), longest)


def test_decontamination_finds_what_a_scan_finds(spark, docs, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    a = decontaminate.decontaminate(docs, items, keep=["doc_id"], block=7).collect()
    b = decontaminate.decontaminate(docs, items, keep=["doc_id"]).collect()
    assert sorted(a) == sorted(b) and any(r["contaminated"] for r in a)
