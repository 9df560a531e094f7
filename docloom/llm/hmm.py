"""A hidden Markov language model.

Latent states emit word classes: each of the HEAD most frequent training words is a class of
its own, all other words fall by hash into TAIL classes, and the end of a text is a class.
Within a tail class a word has the smoothed share of its training count, so the score is a
probability of the text itself.  Baum-Welch runs over all training documents: each task turns
its documents into expected counts, which are summed by class across partitions (the sums have
a fixed size), and the driver only divides them.  The forward recursion is rescaled at each
token and its log scales are summed, which gives the exact likelihood.

Word counts grow with the corpus and are never broadcast.  Documents are dealt to blocks; a
block's different words are joined with the counts, and the block meets its part of the table
in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytevec import BLANK_WORDS, LOWER, as_bytes, counts_per_doc, prefix_sums, runs, span_hashes, word_bounds
from .common import stored

STATES, HEAD, TAIL, ROUNDS = 8, 2048, 256, 5
#: Training walks over stretches of so many tokens, each with a start of its own.
STRETCH = 256
#: Bytes of text in a block, words broadcast with their counts, sequences walked at once.
BLOCK_BYTES, COMMON, BATCH = 8 << 20, 1 << 16, 4096
CODES = "_id {id}, held_out boolean, n_tokens long, n_known long, base_score double, word_score double, codes binary"


def _words(buf, offsets):
    low = LOWER[buf]
    starts, ends, docs = word_bounds(low, offsets, BLANK_WORDS)
    return low, starts, ends, docs, span_hashes(prefix_sums(low), starts, ends)


def _texts(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as one string array."""
    lens = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    take = np.repeat(starts - offsets[:-1], lens) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(offsets.tobytes()), pa.py_buffer(low[take].tobytes()))


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c, tail): training counts; tail is the word's tail class."""

    def count(batches):
        for batch in batches:
            buf, offsets = as_bytes(batch.column("t"))
            for lo, hi in runs(offsets):
                low, starts, ends, _, h = _words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_texts(low, starts[at], ends[at]), pa.array(n.astype(np.int64)), pa.array((u % np.uint64(TAIL)).astype(np.int32))], names=["word", "c", "tail"])

    return rows.filter("not held_out").select("t").mapInArrow(count, "word string, c long, tail int").groupBy("word").agg(F.sum("c").alias("c"), F.first("tail").alias("tail"))


def _block_words(table: pa.Table) -> pa.Table:
    """The different words of a block, without the common ones."""
    out = []
    buf, offsets = as_bytes(table.column("t"))
    seen = np.zeros(0, np.uint64)
    for lo, hi in runs(offsets):
        low, starts, ends, _, h = _words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        u, at = np.unique(h, return_index=True)
        fresh = ~np.isin(u, seen)
        seen = np.concatenate([seen, u[fresh]])
        out.append(_texts(low, starts[at[fresh]], ends[at[fresh]]))
    words = pa.chunked_array(out, pa.string()) if out else pa.chunked_array([pa.array([], pa.string())])
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(len(words), block)), "word": words})


def _encode(known, params, id_type):
    """Function of a block's documents and word counts to rows of CODES."""

    def encode(docs: pa.Table, words: pa.Table) -> pa.Table:
        heads = known.value
        h_buf, h_off = as_bytes(pa.chunked_array([heads["word"], *words.column("word").chunks]) if words.num_rows else heads["word"])
        hashes = span_hashes(prefix_sums(h_buf), h_off[:-1], h_off[1:])
        counts = np.concatenate([heads["c"], words.column("c").to_numpy().astype(np.int64) if words.num_rows else np.zeros(0, np.int64)])
        ranks = np.concatenate([np.arange(len(heads["c"])), np.full(len(counts) - len(heads["c"]), HEAD)])
        order = np.argsort(hashes, kind="stable")
        hashes, counts, ranks = hashes[order], counts[order], ranks[order]
        n_all, v_all, ends_c = params["n"], params["v"], params["ends"]
        base = math.log10(n_all + 0.5 * (v_all + 1))
        tail_n, tail_v = params["tail_n"], params["tail_v"]
        buf, offsets = as_bytes(docs.column("t"))
        cols = {k: [] for k in ("n_tokens", "n_known", "base_score", "word_score")}
        codes: list[bytes] = []
        for lo, hi in runs(offsets):
            off = offsets[lo : hi + 1] - offsets[lo]
            _, starts, ends, doc, h = _words(buf[offsets[lo] : offsets[hi]], off)
            u, inverse = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(hashes, u), max(len(hashes) - 1, 0))
            hit = hashes[at] == u if len(hashes) else np.zeros(len(u), bool)
            c = np.where(hit, counts[at] if len(hashes) else 0, 0)
            rank = np.where(hit, ranks[at] if len(hashes) else HEAD, HEAD)
            tail = (u % np.uint64(TAIL)).astype(np.int64)
            code = np.where(rank < HEAD, rank, HEAD + tail).astype(np.uint16)
            share = np.where(rank < HEAD, 0.0, np.log10((c + 0.5) / (tail_n[tail] + 0.5 * (tail_v[tail] + 1))))
            n = hi - lo
            size = counts_per_doc(doc, n)
            cols["n_tokens"].append(size + 1)
            cols["n_known"].append(counts_per_doc(doc, n, (c > 0)[inverse]) + (ends_c > 0))
            sums = np.bincount(doc, weights=np.log10(c + 0.5)[inverse], minlength=n)
            cols["base_score"].append(sums + math.log10(ends_c + 0.5) - (size + 1) * base)
            cols["word_score"].append(np.bincount(doc, weights=share[inverse], minlength=n))
            seq = np.insert(code[inverse], np.cumsum(size), np.uint16(HEAD + TAIL)).tobytes()
            bound = np.concatenate([[0], np.cumsum(2 * (size + 1))]).tolist()
            codes += [seq[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
        none = {"n_tokens": np.zeros(0, np.int64), "n_known": np.zeros(0, np.int64), "base_score": np.zeros(0), "word_score": np.zeros(0)}
        made = {k: pa.array(np.concatenate(v or [none[k]])) for k, v in cols.items()}
        return pa.table({"_id": docs.column("_id"), "held_out": docs.column("held_out"), **made, "codes": pa.array(codes, pa.binary())})

    return encode


def _batches(codes: list[bytes], stretch: int | None):
    """Sequences by falling length as (index, matrix of codes, lengths), BATCH at a time."""
    seqs, owner = [], []
    for i, c in enumerate(codes):
        s = np.frombuffer(c, dtype=np.uint16)
        step = stretch or max(len(s), 1)
        for at in range(0, len(s), step):
            seqs.append(s[at : at + step])
            owner.append(i)
    lens = np.array([len(s) for s in seqs])
    order = np.argsort(-lens, kind="stable")
    lo = 0
    while lo < len(order):
        longest = int(lens[order[lo]])
        hi = min(len(order), lo + max(1, min(BATCH, (BATCH * STRETCH * 2) // max(longest, 1))))
        pick = order[lo:hi]
        matrix = np.zeros((longest, len(pick)), np.uint16)
        for j, i in enumerate(pick):
            matrix[: lens[i], j] = seqs[i]
        yield [owner[i] for i in pick], matrix, lens[pick]
        lo = hi


def forward(matrix: np.ndarray, lens: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Natural-log likelihood of each column of ``matrix``, whose lengths fall.  emit: one row
    per class.  ``keep`` collects the scaled forward vectors and scales of every step."""
    like = np.zeros(len(lens))
    alpha = np.tile(start, (len(lens), 1)).astype(emit.dtype)
    for t in range(len(matrix)):
        n = int(np.searchsorted(-lens, -t, side="left"))  # sequences longer than t
        alpha = (alpha[:n] if t == 0 else alpha[:n] @ move) * emit[matrix[t, :n]]
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        like[:n] += np.log(scale)
        if keep is not None:
            keep.append((alpha, scale))
    return like


def expected(matrix: np.ndarray, lens: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Baum-Welch counts of a batch: start (K), moves (K x K), emissions (classes x K), log likelihood."""
    kept: list = []
    like = forward(matrix, lens, start, move, emit, kept)
    k, classes = len(start), len(emit)
    moves, gammas, seen = np.zeros((k, k)), [], []
    beta = np.zeros((0, k), emit.dtype)
    for t in range(len(matrix) - 1, -1, -1):
        alpha, _ = kept[t]
        n = len(alpha)
        back = np.ones((n, k), emit.dtype)
        if len(beta):
            ahead = emit[matrix[t + 1, : len(beta)]] * beta / kept[t + 1][1][:, None]
            moves += alpha[: len(beta)].T @ ahead
            back[: len(beta)] = ahead @ move.T
        gammas.append(alpha * back)
        seen.append(matrix[t, :n])
        beta = back
    gamma, code = np.concatenate(gammas), np.concatenate(seen)
    emits = np.stack([np.bincount(code, weights=gamma[:, s], minlength=classes) for s in range(k)], axis=1)
    return gammas[-1].sum(axis=0), moves * move, emits, like.sum()


def train(codes: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, move and emission probabilities after ``rounds`` of Baum-Welch over all rows."""
    spark = codes.sparkSession
    classes = len(share)
    noise = np.random.default_rng(2024).random((classes, states))
    start = np.full(states, 1 / states)
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    emit = (0.25 + noise) * share[:, None]
    emit /= emit.sum(axis=0)
    names = [f"s{i}" for i in range(states)]
    for _ in range(rounds):
        now = spark.sparkContext.broadcast((start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)))

        def walk(batches, now=now):
            a, m, e = now.value
            total = np.zeros((classes + states + 1, states))
            for batch in batches:
                for _, matrix, lens in _batches(batch.column("codes").to_pylist(), STRETCH):
                    s, t, g, _ = expected(matrix, lens, a, m, e)
                    total[:classes] += g
                    total[classes : classes + states] += t
                    total[-1] += s
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)))] + [pa.array(np.ascontiguousarray(total[:, i])) for i in range(states)], names=["row", *names])

        sums = codes.select("codes").mapInArrow(walk, "row long, " + ", ".join(f"{x} double" for x in names))
        rows = sums.groupBy("row").agg(*[F.sum(x).alias(x) for x in names]).collect()  # classes + states + 1 rows
        total = np.zeros((classes + states + 1, states))
        for r in rows:
            total[r["row"]] = r[1:]
        emit = total[:classes] + 0.5 * share[:, None]
        emit /= emit.sum(axis=0)
        move = total[classes : classes + states] + 0.1
        move /= move.sum(axis=1, keepdims=True)
        start = total[-1] + 0.1
        start /= start.sum()
    return start, move, emit


def score_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", states: int = STATES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score every text by unigram counts and by the model, both learnt from the documents whose
    crc32(id) mod 5 is not 1.  Scores are log10 probabilities.

    Defined cases: a null or empty text is its end alone; a document with a null id is learnt
    from; with no training documents every count is 0 and the model is its prior; repeated
    rows count as often as they appear; an empty table gives an empty one; further columns are
    ignored.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), held.alias("held_out"))
    size, n_train = rows.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    blocks = 1 + size // block_bytes
    vocabulary = stored(count_words(rows), "hmm-words")
    n_words, n_types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    common = vocabulary.orderBy(F.desc("c"), "word").limit(COMMON)
    common = stored(common, "hmm-common")
    top = common.orderBy(F.desc("c"), "word").collect()  # at most COMMON rows
    known = spark.sparkContext.broadcast({"word": pa.array([r["word"] for r in top], pa.string()), "c": np.array([r["c"] for r in top], np.int64)})
    heads = spark.createDataFrame([(r["word"],) for r in top[:HEAD]], "word string")
    share = np.zeros(HEAD + TAIL + 1)
    share[: min(HEAD, len(top))] = [r["c"] for r in top[:HEAD]]
    tail_n, tail_v = np.zeros(TAIL), np.zeros(TAIL)
    for r in vocabulary.join(F.broadcast(heads), "word", "left_anti").groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # at most TAIL rows
        tail_n[r["tail"]], tail_v[r["tail"]] = r["c"], r["v"]
    share[HEAD : HEAD + TAIL] = tail_n
    share[-1] = n_train
    share = (share + 0.5) / (share + 0.5).sum()
    params = {"n": n_words + n_train, "v": n_types + (n_train > 0), "ends": n_train, "tail_n": tail_n, "tail_v": tail_v}

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("_id", "t"), F.lit(blocks)))
    rest = vocabulary.join(F.broadcast(common.select("word")), "word", "left_anti").select("word", "c")
    wanted = dealt.groupBy("block").applyInArrow(_block_words, "block long, word string").join(rest, "word").select("block", "word", "c")
    codes = dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_encode(known, params, id_type), CODES.format(id=id_type))
    codes = stored(codes, "hmm-codes")
    model = train(codes.filter("not held_out"), share, states, rounds)
    now = spark.sparkContext.broadcast(model)

    def likelihoods(batches):
        start, move, emit = now.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for owner, matrix, lens in _batches(batch.column("codes").to_pylist(), None):
                out[owner] = forward(matrix, lens, start, move, emit)
            kept = batch.select(["_id", "held_out", "n_tokens", "n_known", "base_score"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out / math.log(10) + batch.column("word_score").to_numpy())], names=[*kept.schema.names, "score"])

    scored = codes.mapInArrow(likelihoods, f"_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(params["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
