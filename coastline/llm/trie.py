"""Prefix trie of conversations by chained digests.

A turn is a digest of its role and text, taken where it is read; no text is
shuffled. A conversation's prefix of d turns is the chain of its turns' digests,
so that equal digests are equal prefixes and a node of the trie is a group by
(depth, digest). The trie's root has no turn; every conversation is one of its members.

A node belongs to its smallest member. The nodes that belong to one conversation are
the end of its path, so exploding each node to all its ancestors is a sum along a
path: every position of a conversation gets the weights of the nodes of its own
from there on, and a node's subtree is the sum over its members' positions. That is
one row for each turn, however deep the conversations are.

At scale: turns are numbered by ranges, so that a conversation that holds a third of
all rows is spread. Chains go by blocks of ``BLOCK`` turns: a block is digested, the
blocks' digests are a sequence that is chained by the same rule, and each block's
chain begins with what comes before it. No task has more than a block in memory.
Sums along a path go by chunks too. Nodes are aggregated before they are shuffled. The
ids that end in a node are hashed in their order: they are sorted by ranges and
joined to pieces of ``PIECE`` ids where they are, and one stream a node takes
the pieces up.

Rows: turns are in the order of their numbers, null first, equal numbers in the
order of their digests; a null role or text counts as empty; repeated rows are
turns of their own. Rows without a conversation id are no part of any conversation.
Conversations given by ``ids`` that have no turn are members of the root. Without
any conversation there is no node. Further columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coastline.llm.common import cut
from coastline.operators.spread import numbered, running_sums

BLOCK = 64
PIECE = 10_000
ROOT = hashlib.sha256(b"").digest()


def _sha(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def turn_digest(role: Column, text: Column) -> Column:
    """Tells all pairs of role and text apart: the role's length comes first."""
    return _sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def steps(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, digest, chars): each conversation's turns, numbered from 0."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), turn_digest(role, text).alias("digest"), F.char_length(text).cast("long").alias("chars"))
    return numbered(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("digest")], "at").drop("turn")


def prefixes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, at, digest) -> (conv, at, prefix): the chain of the digests until each one."""
    place = F.floor(F.col("at") / block).cast("long")
    blocks = rows.groupBy("conv", place.alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("steps"))
    longest = rows.agg(F.max("at")).first()[0]
    if longest is not None and longest >= block:
        blocks = cut(blocks)
        joined = F.aggregate("steps", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["digest"]))
        heads = prefixes(blocks.select("conv", F.col("block").alias("at"), _sha(joined).alias("digest")), block)
        heads = heads.select(F.col("conv").alias("c"), (F.col("at") + 1).alias("b"), F.col("prefix").alias("head"))
        blocks = blocks.join(heads, (F.col("conv") == F.col("c")) & (F.col("block") == F.col("b")), "left").drop("c", "b")
    else:
        blocks = blocks.withColumn("head", F.lit(None).cast("binary"))
    first = F.array(F.coalesce("head", F.lit(ROOT)))
    chain = F.aggregate("steps", first, lambda a, x: F.concat(a, F.array(_sha(F.concat(F.element_at(a, -1), x["digest"])))))
    chain = F.slice(chain, 2, F.size("steps"))
    return blocks.select("conv", F.explode(F.arrays_zip(F.col("steps.at").alias("at"), chain.alias("prefix"))).alias("x")).select("conv", F.col("x.at").alias("at"), F.col("x.prefix").alias("prefix"))


def ids_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(prefix, conv) -> (prefix, ends_sha256): the hash of each prefix's ids in ascending order, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["prefix", "first", "ids"])

        for batch in batches:
            for prefix, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (prefix != node or len(ids) == piece):
                    yield row()
                    ids = []
                node = prefix
                ids.append(conv)
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for prefix, ids in zip(batch.column(0), batch.column(2), strict=True):
                prefix = prefix.as_py()
                if prefix != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = prefix, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["prefix", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["prefix", "ends_sha256"])

    ranged = ends.select("prefix", "conv").repartitionByRange("prefix", "conv").sortWithinPartitions("prefix", "conv")
    joined = ranged.mapInArrow(pieces, "prefix binary, first bigint, ids string")
    return joined.repartition("prefix").sortWithinPartitions("prefix", "first").mapInArrow(hashed, "prefix binary, ends_sha256 string")


def trie(rows: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie's nodes; rows: (conv, at, digest, chars) with places from 0, ids: (conv), each conversation once.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and prefix, the node's digest.
    """
    rows = cut(rows)
    chains = prefixes(rows.select("conv", "at", "digest"), block)
    turns = rows.select(F.col("conv").alias("c"), F.col("at").alias("a"), "chars")
    chained = chains.join(turns, (F.col("conv") == F.col("c")) & (F.col("at") == F.col("a"))).select("conv", (F.col("at") + 1).alias("depth"), "prefix", "chars")
    roots = ids.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("prefix"), F.lit(0).cast("long").alias("chars"))
    path = cut(chained.unionByName(roots))
    above = path.select(F.col("conv").alias("c"), (F.col("depth") + 1).alias("d"), F.col("prefix").alias("parent"))
    linked = path.join(above, (F.col("conv") == F.col("c")) & (F.col("depth") == F.col("d")), "left").drop("c", "d")
    nodes = cut(linked.groupBy("depth", "prefix").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"), F.min("parent").alias("parent")))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("up")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, F.col("prefix") == F.col("up"), "left").drop("up").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = cut(nodes)
    own = nodes.select(F.col("conv").alias("c"), F.col("depth").alias("d"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    weighed = path.join(own, (F.col("conv") == F.col("c")) & (F.col("depth") == F.col("d")), "left").select("conv", "depth", "prefix", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved"))
    below = running_sums(weighed, "conv", "depth", {"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")}, backwards=True)
    sums = below.groupBy("prefix").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).withColumnRenamed("prefix", "s")
    last = path.groupBy("conv").agg(F.max_by("prefix", "depth").alias("prefix"))
    ends = ids_digests(cut(last)).withColumnRenamed("prefix", "e")
    parents = nodes.select(F.col("prefix").alias("p"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(sums, F.col("prefix") == F.col("s")).join(ends, F.col("prefix") == F.col("e"), "left").join(parents, F.col("parent") == F.col("p"), "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "prefix")


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of the table's conversations, with the columns of ``trie``."""
    rows = cut(steps(turns, id_col, turn_col, role_col, text_col))
    return trie(rows, rows.select("conv").distinct())


def rebuilt(rows: DataFrame, ids: DataFrame, group: int, heads: Column, most: int) -> DataFrame:
    """Conversations that begin like the first of their group; rows and result: (conv, at, digest, chars).

    Conversation c begins with the first ``heads`` turns (``most`` at most, by ``conv``) of
    conversation c - c % group, all if it has fewer, and goes on with its own turns after as many.
    """
    base = (F.col("conv") - F.col("conv") % group).alias("base")
    wanted = ids.select("conv", base, heads.cast("long").alias("h"))
    first = rows.where((F.col("at") < most) & (F.col("conv") % group == 0)).select(F.col("conv").alias("b"), "at", "digest", "chars")
    taken = wanted.join(first, (F.col("base") == F.col("b")) & (F.col("at") < F.col("h"))).select("conv", "at", "digest", "chars")
    counts = taken.groupBy("conv").agg(F.count(F.lit(1)).alias("k"))
    counts = cut(wanted.select("conv", "h").join(counts, "conv", "left").select(F.col("conv").alias("c"), "h", F.coalesce("k", F.lit(0)).alias("k")))
    own = rows.join(counts, F.col("conv") == F.col("c")).where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "digest", "chars")
    return taken.unionByName(own)
