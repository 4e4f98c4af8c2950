"""Prefix trie of conversations from chained digests of their prefixes.

Each turn becomes a SHA-256 of role and text; a conversation's prefixes are digests chained over its turns, read
as a sorted stream, and every prefix is a row. Grouped by (depth, digest) they are the nodes; a node's
smallest member is its owner. A conversation that owns a node owns all its deeper ones, so the nodes fall
into one chain per owner, and a conversation's path leads through the chains of its ancestors. For
subtree sums, each chain's total is exploded to all chains above it, at the node where the
path leaves them, and summed along the chain. That is one row per change of owner on a
path, so never more rows than turns; exploding node by node would give the square of a conversation's length.

Owners and depths are numbers, so all steps after the nodes are keyed by (owner, depth). Hot prefixes, which a third of
the conversations may share, are met by partial sums and by ``join_groups``. Ids of conversations that end
at one node are joined in blocks of BLOCK ids, and the blocks hashed as a stream, so no task holds them all.

Defined cases: null roles and texts are empty; null turns come first, turns of one number are taken by the digest of
role and text; repeated rows are turns of their own; rows without conv_id are one conversation, which takes over no turns, counts as
a member and ends at a node, but gives no id (conv_id of a node it alone is in is null); an empty table gives no node;
a very long text is hashed once and not moved; conversations of any length are streamed; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import join_groups, n_words

#: Ids of a family, and the modulus of the number of turns taken over from its first one.
FAMILY = 20
TAKEN = 4
#: Ids in a block, a power of two.
BLOCK = 4096
#: Digest of the empty prefix.
ROOT = hashlib.sha256(b"").digest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, t (digest of role and text), words (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat_ws(":", F.octet_length(role).cast("string"), role, text)
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.unhex(F.sha2(whole, 256)).alias("t"), n_words(text).alias("words"))


def _taken(conv: Column) -> Column:
    """Turns that a conversation takes over: 0 for a family's first one, whose turns stay as they are."""
    return F.when(conv % FAMILY == 0, 0).otherwise(F.crc32(F.encode(conv.cast("string"), "utf-8")) % TAKEN).cast("int")


def rebuild(turns: DataFrame) -> DataFrame:
    """conv_id, own (false: taken over), turn, t, words, h: the turns of each rebuilt conversation, and its own
    first h ones, which are still to be left out. h is null for no conversation."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "t"))
    first = turns.filter(F.col("conv_id") % FAMILY == 0).withColumn("nth", nth).filter(F.col("nth") < TAKEN)
    takers = turns.filter(F.col("conv_id") % FAMILY != 0).select("conv_id").distinct().withColumn("h", _taken(F.col("conv_id"))).filter("h > 0")
    takers = takers.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    taken = takers.join(first.withColumnRenamed("conv_id", "base"), "base").filter(F.col("nth") <= F.col("h"))
    taken = taken.select("conv_id", F.lit(False).alias("own"), F.col("nth").cast("long").alias("turn"), "t", "words", "h")
    own = turns.select("conv_id", F.lit(True).alias("own"), "turn", "t", "words", F.coalesce(_taken(F.col("conv_id")), F.lit(0)).alias("h"))
    return taken.unionByName(own)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, digest, words (of the last turn), last (the whole conversation): a row per prefix, the empty one included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()], ["conv_id", "depth", "digest", "words", "last"]
        row, left, started = None, 0, False  # the row that waits until it is known whether it is the last
        for b in batches:
            out = []
            for conv, own, t, words, h in zip(*(c.to_pylist() for c in b.columns)):
                if not started or conv != row[0]:
                    if started:
                        out.append((*row, True))
                    row, left, started = (conv, 0, ROOT, 0), h, True
                if own and left:
                    left -= 1
                    continue
                out.append((*row, False))
                row = (conv, row[1] + 1, hashlib.sha256(row[2] + t).digest(), words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*row, True), kinds)], names)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "own", F.asc_nulls_first("turn"), "t")
    return dealt.select("conv_id", "own", "t", "words", "h").mapInArrow(run, "conv_id long, depth int, digest binary, words long, last boolean")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 from one row (owner, depth, conv_id) per conversation and the node it ends at."""
    blocks = ends.groupBy("owner", "depth", F.shiftright("conv_id", BLOCK.bit_length() - 1).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.int32(), pa.string()], ["owner", "depth", "ends_sha256"]
        node, state, empty = None, None, True
        for b in batches:
            out = []
            for owner, depth, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (owner, depth) != node:
                    if state is not None:
                        out.append((*node, state.hexdigest()))
                    node, state, empty = (owner, depth), hashlib.sha256(), True
                if ids:
                    state.update(("" if empty else ",").encode() + ids.encode())
                    empty = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*node, state.hexdigest()), kinds)], names)

    dealt = blocks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", F.asc_nulls_first("block"))
    return dealt.select("owner", "depth", "ids").mapInArrow(run, "owner long, depth int, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    rows = materialize(prefixes(rebuild(turn_digests(conversations))), "trie-prefixes")
    total = rows.agg(F.count("*")).first()[0]
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"))
    shared = nodes.filter("n_convs > 1").drop("depth")
    path = join_groups(rows, shared, "digest", "n_convs", total).select(
        "conv_id", "depth", "words", "last",
        F.when(F.col("n_convs").isNull(), F.col("conv_id")).otherwise(F.col("owner")).alias("owner"),
        F.coalesce("n_convs", F.lit(1)).cast("long").alias("n_convs"),
        F.when(F.coalesce("n_ends", F.col("last").cast("long")) == F.coalesce("n_convs", F.lit(1)), 1).otherwise(0).cast("long").alias("leaf"),
    )
    path = materialize(path, "trie-paths")

    along = Window.partitionBy("conv_id").orderBy("depth")
    whole = Window.partitionBy("conv_id")
    mine = F.col("owner").eqNullSafe(F.col("conv_id"))
    saved = (F.col("n_convs") - 1) * F.col("words")
    seen = path.withColumns({
        "mine": mine, "saved": saved,
        "above": F.lag("owner").over(along), "below": F.lead("owner").over(along),
        "all_leaves": F.sum(F.when(mine, F.col("leaf"))).over(whole), "all_saved": F.sum(F.when(mine, saved)).over(whole),
    })
    # of an owner: its node; of another's chain that this owner's path leaves here: what hangs below
    node = F.struct(
        F.col("owner").alias("conv_id"), "depth", F.lit(True).alias("real"), F.col("above").alias("parent"), "n_convs",
        (~F.col("last")).cast("long").alias("children"), F.col("leaf").alias("leaves"), "saved")
    hung = F.struct(
        F.col("owner").alias("conv_id"), "depth", F.lit(False).alias("real"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("n_convs"),
        F.col("below").eqNullSafe(F.col("conv_id")).cast("long").alias("children"), F.col("all_leaves").alias("leaves"), F.col("all_saved").alias("saved"))
    leaves_here = ~F.col("last") & ~F.col("below").eqNullSafe(F.col("owner")) & F.col("all_leaves").isNotNull()
    parts = seen.select(F.when(mine, node).when(leaves_here, hung).alias("x")).filter("x is not null").select("x.*")
    sums = parts.groupBy("conv_id", "depth").agg(
        F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumns({"n_leaves": F.sum("leaves").over(below), "saved_tokens": F.sum("saved").over(below)})
    ends = _end_hashes(path.filter("last").select("owner", "depth", "conv_id"))
    joined = sums.join(ends, sums["conv_id"].eqNullSafe(ends["owner"]) & (sums["depth"] == ends["depth"]), "left")
    return joined.select(
        sums["conv_id"], sums["depth"].cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
