"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a different sequence of first turns.  Each turn has two 64-bit hashes of its content
and place; a prefix's key is the exclusive-or of its turns' hashes, so keys come from running
aggregates and the parent's key from the node's last turn.

Totals of subtrees: a round rakes all leaves (their sums go to their parents) and compresses
chains: a node with one child gives way to it if a bit of its depth is 1 and of the child's 0,
which no two neighbours meet at once.  A chain of consecutive depths halves in each round; once
the bits of depth are used up, hashed bits take their place.  Rounds go on until no node is
left, about log(nodes) of them.  Nodes that gave way are then re-expanded, last round first: a
node's total is what it had gathered and its child's total.

No step holds a conversation, a node's children or its members in one task: turns are numbered
by ranges, running keys go by blocks of BLOCK turns, sums are combined before they are
shuffled, and member lists are hashed in pieces that pass one after the other.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, union_all

#: A rebuilt conversation begins with up to PREFIXES - 1 turns of the conversation whose id is
#: the next smaller multiple of FAMILY.
FAMILY, PREFIXES = 20, 4
#: Turns of a conversation that one window takes, ids in one piece of a member list.
BLOCK, PIECE = 4096, 1 << 16
#: Rounds that go by bits of the depth.
DEPTH_BITS = 40
ROOT = bytes(16)
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1), content (16 bytes), words of every turn.  Turns are in order of turn
    (null first), equal ones by role and text; conversations are cut where ranges end."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").alias("turn"),
        F.unhex(F.md5(F.concat_ws(":", F.octet_length(role), role, text))).alias("content"),
        F.struct(role, F.md5(text)).alias("tie"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["turn", "tie", "row"]  # nulls come first
    cut = stored(own.repartitionByRange("conv", *order).withColumn("cut", F.spark_partition_id()), "trie-turns")
    counts = cut.groupBy("conv", "cut").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)  # over ranges, not turns
    starts = counts.select("conv", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).filter("start > 0")
    inside = F.row_number().over(W.partitionBy("conv", "cut").orderBy(*order))
    return cut.withColumn("r", inside).join(starts, ["conv", "cut"], "left").select("conv", (F.coalesce("start", F.lit(0)) + F.col("r")).alias("pos"), "content", "words")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, content, words) of the rebuilt conversations, and all conversations."""
    head = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(PREFIXES))
    base = F.col("conv") - F.col("conv") % FAMILY
    heads = numbered.filter(f"conv % {FAMILY} = 0 and pos < {PREFIXES}").select(F.col("conv").alias("base"), "pos", "content", "words")
    have = heads.groupBy("base").agg(F.count(F.lit(1)).alias("have"))
    convs = numbered.select("conv").distinct()
    shared = convs.select("conv", base.alias("base"), head.alias("head")).join(heads, "base").filter("pos <= head").select("conv", F.col("pos").alias("depth"), "content", "words")
    tail = numbered.withColumns({"base": base, "head": head}).filter("pos > head").join(have, "base", "left")
    tail = tail.select("conv", (F.least("head", F.coalesce("have", F.lit(0))) + F.col("pos") - F.col("head")).alias("depth"), "content", "words")
    return shared.unionByName(tail), convs


def _id(a: str | Column, b: str | Column) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (a, b)]))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, words, id and parent of the prefix that ends with each turn."""
    own = turns.select("conv", "depth", "words", F.xxhash64(F.lit(1), "depth", "content").alias("x"), F.xxhash64(F.lit(2), "depth", "content").alias("y"), F.expr(f"(depth - 1) div {BLOCK}").alias("block"))
    inside = W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    run = own.withColumns({"to_x": F.bit_xor("x").over(inside), "to_y": F.bit_xor("y").over(inside)})
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # over blocks, not turns
    blocks = own.groupBy("conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    blocks = blocks.select("conv", "block", F.bit_xor("x").over(before).alias("in_x"), F.bit_xor("y").over(before).alias("in_y")).filter("block > 0")
    zero = F.lit(0).cast("long")
    all_x, all_y = F.col("to_x").bitwiseXOR(F.coalesce("in_x", zero)), F.col("to_y").bitwiseXOR(F.coalesce("in_y", zero))
    return run.join(blocks, ["conv", "block"], "left").select(
        "conv", "depth", "words", _id(all_x, all_y).alias("id"), _id(all_x.bitwiseXOR(F.col("x")), all_y.bitwiseXOR(F.col("y"))).alias("parent")
    )


def contract(nodes: DataFrame) -> list[DataFrame]:
    """``nodes``: id, parent (null: a root), depth, leaf, saved (own weights), n_children.

    One table per round: nodes without children are raked in the next one; those with ``gone``
    have given way to ``child``.
    """
    none = F.lit(None)
    columns = ["id", "parent", "depth", "leaf", "saved", "n_children", "child", "gone"]
    state = stored(nodes.withColumns({"child": none.cast("binary"), "gone": F.lit(False)}).select(*columns), "trie-round0")
    rounds = [state]
    while True:
        left = state.filter("not gone")
        if len(rounds) > 1:  # children of nodes that gave way get new parents, the parents their weights
            zero = F.lit(0).cast("long")
            gone = state.filter("gone")
            news = gone.select(F.col("child").alias("id"), F.col("parent").alias("up"), zero.alias("l"), zero.alias("s"))
            news = news.unionByName(gone.select(F.col("parent").alias("id"), none.cast("binary").alias("up"), F.col("leaf").alias("l"), F.col("saved").alias("s")))
            news = news.groupBy("id").agg(F.max("up").alias("up"), F.sum("l").alias("l"), F.sum("s").alias("s"))
            left = left.join(news, "id", "left").select("id", F.coalesce("up", "parent").alias("parent"), "depth", *[(F.col(c) + F.coalesce(F.col(c[0]), zero)).alias(c) for c in ("leaf", "saved")], "n_children")
        raked = F.col("n_children") == 0
        sums = left.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.sum(F.when(raked, F.col("leaf")).otherwise(0)).alias("more_leaf"),
            F.sum(F.when(raked, F.col("saved")).otherwise(0)).alias("more_saved"),
            F.count(F.when(~raked, 1)).alias("left"),
            F.min(F.when(~raked, F.struct("depth", "id"))).alias("one"),
        )
        bit = len(rounds) - 1

        def side(depth, key, bit=bit):
            return F.shiftright(depth, bit).bitwiseAND(F.lit(1)) if bit < DEPTH_BITS else F.pmod(F.xxhash64(key, F.lit(bit)), F.lit(2))

        gives_way = (F.col("left") == 1) & F.col("parent").isNotNull() & (side(F.col("depth"), F.col("id")) == 1) & (side(F.col("one.depth"), F.col("one.id")) == 0)
        state = left.filter(~raked).join(sums, "id").select(
            "id", "parent", "depth", (F.col("leaf") + F.col("more_leaf")).alias("leaf"), (F.col("saved") + F.col("more_saved")).alias("saved"),
            F.col("left").alias("n_children"), F.col("one.id").alias("child"), gives_way.alias("gone"),
        )
        state = stored(state, f"trie-round{len(rounds)}")
        if state.isEmpty():
            return rounds
        rounds.append(state)


def expand(rounds: list[DataFrame]) -> DataFrame:
    """(id, leaf, saved): every node's subtree totals, from the rounds of ``contract``."""
    known = None
    for k in range(len(rounds) - 1, -1, -1):
        raked = rounds[k].filter("n_children = 0 and not gone").select("id", "leaf", "saved")
        known = raked if known is None else known.unionByName(raked)
        if k == 0:
            return known
        total = known.select(F.col("id").alias("child"), F.col("leaf").alias("l"), F.col("saved").alias("s"))
        back = rounds[k].filter("gone").join(total, "child").select("id", (F.col("leaf") + F.col("l")).alias("leaf"), (F.col("saved") + F.col("s")).alias("saved"))
        known = stored(known.unionByName(back), f"trie-known{k}")
    raise ValueError("no rounds")


def _pieces(batches):
    """Runs of members of one node as comma-joined pieces of at most PIECE ids."""
    node, ids = None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["id", "first", "ids"])

    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != node or len(ids) == PIECE:
                if ids:
                    yield row()
                node, ids = key, []
            ids.append(conv)
    if ids:
        yield row()


def _digests(batches):
    """SHA-256 of each node's pieces, which pass in order, one at a time."""
    node, digest, done = None, None, []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["id", "ends_sha256"])

    for batch in batches:
        for key, piece in zip(batch.column(0), batch.column(1), strict=True):
            if key.as_py() != node:
                if digest:
                    done.append((node, digest.hexdigest()))
                node, digest = key.as_py(), hashlib.sha256(piece.as_buffer().to_pybytes())
            else:
                digest.update(b"," + piece.as_buffer().to_pybytes())
        yield rows()
        done = []
    if digest:
        done.append((node, digest.hexdigest()))
    yield rows()


def conversation_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  Defined cases: rows without a conv_id are left out;
    null roles and texts are empty, a null turn comes first; equal turns of a conversation are
    ordered by role and text, repeated rows each count; a conversation without turns ends at
    the root; an empty table gives an empty result; further columns are ignored.
    """
    numbered = stored(numbered_turns(turns), "trie-numbered")
    parts, convs = rebuilt(numbered)
    convs = stored(convs, "trie-convs")
    own = stored(prefixes(parts), "trie-prefixes")
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent"))
    members = own.unionByName(root)
    nodes = members.groupBy("id", "depth", "parent").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    nodes = stored(nodes, "trie-nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    weighted = nodes.join(children, "id", "left").select(
        "id", "parent", "depth", F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("n_children", F.lit(0)).alias("n_children")
    )
    rounds = contract(weighted)
    totals = expand(rounds)
    ends = members.groupBy("conv").agg(F.max_by("id", "depth").alias("id"))
    ordered = ends.select("id", "conv").repartitionByRange("id", "conv").sortWithinPartitions("id", "conv")
    pieces = ordered.mapInArrow(_pieces, "id binary, first long, ids string").repartition("id").sortWithinPartitions("id", "first")
    digests = pieces.select("id", "ids").mapInArrow(_digests, "id binary, ends_sha256 string")
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    counts = rounds[0].select("id", "n_children")
    out = nodes.join(totals, "id").join(counts, "id").join(digests, "id", "left").join(parents, "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256")
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_SELF = "list_reduce([4294967295::ubigint] || list_transform(string_split(conv::varchar, ''), lambda ch: ascii(ch)::ubigint), lambda a, x: {step})"
_STEP = "list_reduce([xor(a, x)] || [0::ubigint, 0, 0, 0, 0, 0, 0, 0], lambda b, y: xor(b >> 1, 3988292384::ubigint * (b & 1)))"
_CRC32 = f"xor({_SELF.format(step=_STEP)}, 4294967295::ubigint)"

OP13_SQL = f"""
with turns as (
  select conv_id as conv, md5(coalesce(role, '')) || md5(coalesce(text, '')) as content,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
convs as (select conv, ({_CRC32} % {PREFIXES})::bigint as h, conv - conv % {FAMILY} as base from (select distinct conv from turns)),
have as (select c.conv, count(t.pos) as k from convs c left join turns t on t.conv = c.base and t.pos <= c.h group by c.conv),
rebuilt as (
  select c.conv, t.pos as depth, t.content, t.words from convs c join turns t on t.conv = c.base and t.pos <= c.h
  union all
  select c.conv, k.k + t.pos - c.h, t.content, t.words from convs c join have k on k.conv = c.conv join turns t on t.conv = c.conv and t.pos > c.h),
members as (
  select conv, depth, words, string_agg(content, ',') over (partition by conv order by depth rows unbounded preceding) as id from rebuilt
  union all select conv, 0, 0, '' from convs),
nodes as (select id, depth, min(conv) as conv_id, count(*) as n_convs, min(words) as words from members group by id, depth),
linked as (
  select n.*, p.id as parent from nodes n left join members p on n.depth > 0 and p.conv = n.conv_id and p.depth = n.depth - 1),
children as (select parent, count(*) as n_children from linked where depth > 0 group by parent),
weighted as (select l.*, coalesce(c.n_children, 0) as n_children from linked l left join children c on c.parent = l.id),
totals as (
  select a.id, sum(case when w.n_children = 0 then 1 else 0 end) as n_leaves, sum((w.n_convs - 1) * w.words) as saved_tokens
  from weighted w join members a on a.conv = w.conv_id and a.depth <= w.depth group by a.id),
lengths as (select conv, max(depth) as depth from members group by conv),
ends as (select m.id, string_agg(conv::varchar, ',' order by conv) as ids from members m join lengths using (conv, depth) group by m.id)
select w.conv_id, w.depth::bigint as depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, t.n_leaves::bigint as n_leaves, t.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from weighted w join totals t on t.id = w.id left join ends e on e.id = w.id left join nodes p on w.depth > 0 and p.id = w.parent
"""
