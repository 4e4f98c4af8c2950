"""Exact dedup against a minimal perfect hash over the distinct digests of a history.

The history's distinct digests are dealt to shards of bounded size. Each shard's digests get a
minimal perfect hash: level by level, every key that is alone at its position of a bit array keeps
that position, the others go on to the next, smaller array; a key's slot is the rank of its bit. Slot
i of a shard holds the full digest and the winner's locator. A lookup computes the slot of an
incoming digest and compares all 32 bytes, so a foreign digest that lands on a slot is never taken
for a member. Members update the winner; nonmembers form groups of their own.

Defined cases: null text counts as empty; texts equal after lower-casing A-Z are one group; the
largest doc_id stays, null ids being smaller than any; of repeated rows with one id exactly one
stays; a very long text is a digest like others; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, bounded_batches, free_name, join_groups

SHARD_KEYS = 30_000
_GAMMA = 1.5
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def _place(k: np.ndarray, level: int, m: int) -> np.ndarray:
    x = k[:, 0] ^ (k[:, 1] * _C1 + np.uint64(level * int(_C2) & (1 << 64) - 1))
    x ^= x >> np.uint64(33)
    x *= _C3
    x ^= x >> np.uint64(29)
    return (x % np.uint64(m)).astype(np.int64)


def build_mphf(digests: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """(bit array of each level, slot of each digest): slots are 0..n-1, each once. The digests
    must be distinct in their first 16 bytes."""
    k = np.frombuffer(b"".join(d[:16] for d in digests), dtype="<u8").reshape(-1, 2)
    slots, rest, levels, base = np.empty(len(k), np.int64), np.arange(len(k)), [], 0
    while len(rest):
        if len(levels) == 200:
            raise ValueError("digests are not distinct")
        m = max(64, int(len(rest) * _GAMMA))
        at = _place(k[rest], len(levels), m)
        bits = np.bincount(at, minlength=m) == 1
        alone = bits[at]
        slots[rest[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        base += int(alone.sum())
        levels.append(bits)
        rest = rest[~alone]
    return levels, slots


def find_slots(levels: list[np.ndarray], digests: list[bytes]) -> np.ndarray:
    """Slot of each digest, or -1 if no level has its bit. Any other digest may get a member's slot."""
    k = np.frombuffer(b"".join(d[:16] for d in digests), dtype="<u8").reshape(-1, 2)
    slots, rest, base = np.full(len(k), -1, np.int64), np.arange(len(k)), 0
    for level, bits in enumerate(levels):
        at = _place(k[rest], level, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits)
        slots[rest[hit]] = base + rank[at[hit]] - 1
        base += int(rank[-1])
        rest = rest[~hit]
    return slots


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole text after lower-casing A-Z."""
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(F.encode(norm, "utf-8"), 256)).alias("digest"))


def _distinct(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest: winner, its rows with that id, all rows. Aggregated before each shuffle,
    so a digest with a third of the rows sends one row per task."""
    by_id = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("real"), "doc_id", "n"))
    return by_id.groupBy("digest").agg(top.alias("top"), F.sum("n").alias("n")).select(
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"),
        "digest", F.col("top.doc_id").alias("winner"), F.col("top.n").alias("top_n"), "n",
    )


INDEX = "shard int, sizes array<int>, bits binary, slots binary, winners array<long>, top_ns array<long>, ns array<long>"


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of a history of (doc_id, digest): one row per shard, of about SHARD_KEYS slots."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        levels, slot = build_mphf(list(pdf.digest))
        by_slot = pdf.iloc[np.argsort(slot)]
        return pd.DataFrame({
            "shard": [int(pdf.shard.iloc[0])], "sizes": [[len(x) for x in levels]],
            "bits": [np.packbits(np.concatenate(levels)).tobytes()], "slots": [b"".join(by_slot.digest)],
            "winners": [[None if pd.isna(x) else int(x) for x in by_slot.winner]],
            "top_ns": [by_slot.top_n.tolist()], "ns": [by_slot.n.tolist()],
        })

    return _distinct(history, shards).groupBy("shard").applyInPandas(build, INDEX)


GROUPS = "digest binary, keep_id long, group_size long, top_n long, in_history boolean"


def look_up(index: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """Groups of the history and the incoming rows together; in_history: a slot's digest was equal."""

    def probe(idx: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        held, out = {}, []
        if len(idx):
            r = idx.iloc[0]
            ends = np.cumsum(r.sizes)
            levels = np.split(np.unpackbits(np.frombuffer(r.bits, np.uint8))[: ends[-1]].astype(bool), ends[:-1])
            slots = [r.slots[i : i + 32] for i in range(0, len(r.slots), 32)]
            held = {i: [slots[i], w, int(n), int(t), True] for i, (w, n, t) in enumerate(zip(r.winners, r.ns, r.top_ns))}
            found = find_slots(levels, list(new.digest)) if len(new) else []
        else:
            found = [-1] * len(new)
        for at, d, w, n, t in zip(found, new.digest, new.winner, new.n, new.top_n):
            w = None if pd.isna(w) else int(w)
            old = held.get(int(at))
            if old is None or old[0] != d:  # the byte check
                out.append([d, w, int(n), int(t), False])
                continue
            old[2] += int(n)
            mine = None if old[1] is None or pd.isna(old[1]) else int(old[1])
            if w == mine:
                old[3] += int(t)
            elif mine is None or (w is not None and w > mine):
                old[1], old[3] = w, int(t)
        out += held.values()
        return pd.DataFrame({
            "digest": [x[0] for x in out], "keep_id": pd.array([None if pd.isna(x[1]) else int(x[1]) for x in out], dtype="Int64"),
            "group_size": [x[2] for x in out], "top_n": [x[3] for x in out], "in_history": [x[4] for x in out],
        })

    return index.groupBy("shard").cogroup(_distinct(incoming, shards).groupBy("shard")).applyInPandas(probe, GROUPS)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept, in_history of every row of ``docs``.

    ``history`` holds (doc_id, text) of rows admitted before; its rows count and can win, but are
    not returned. Without one, the half of ``docs`` whose id hashes even is the history of the
    other half, and all rows are returned; the result is the same for any split.
    """
    bounded_batches(docs.sparkSession, 10_000)
    rows = materialize(digests(docs, text, key).withColumn("row", F.monotonically_increasing_id()), "digests")
    if history is None:
        even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
        old, new, total = rows.filter(even), rows.filter(~even), rows.count()
    else:
        old, new = materialize(digests(history, text, key), "history"), rows
        total = old.count() + new.count()
    shards = max(1, -(-total // SHARD_KEYS))
    index = materialize(build_index(old, shards), "mphf")
    groups = materialize(look_up(index, new, shards), "groups")
    # of rows that repeat an id and text the first written one stays
    repeated = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1").select("first")
    joined = join_groups(rows, groups, "digest", "group_size", total).join(repeated, F.col("row") == F.col("first"), "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ((F.col("top_n") == 1) | F.col("first").isNotNull())
    return joined.select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"), "in_history")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    What goes is decided on (id, digest) alone; texts are shuffled once, to leave those pairs out. Where
    rows repeat an id and text, one of them stays: they are merged before that shuffle's end, so a third of
    all rows may be one row. Null text counts as empty; an empty table gives an empty result.
    """
    key, size, again = free_name(docs, "pair_key", "pair_rows", "pair_stays")

    def pair(digest: Column, doc_id: Column) -> Column:
        return F.concat(digest, F.encode(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), "utf-8"))

    out = exact_dedup(docs)
    pairs = out.groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.max("kept").alias("stays")).filter("n > 1 or not stays")
    pairs = materialize(pairs.select(pair(F.col("digest"), F.col("doc_id")).alias(key), F.col("n").alias(size), F.col("stays").alias(again)), "pairs")
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    marked = docs.withColumn(key, pair(F.unhex(F.sha2(F.encode(norm, "utf-8"), 256)), F.col("doc_id")))
    totals = pairs.agg(F.sum(size).alias("rows"), F.max(again).alias("again")).first()
    # the light pairs are merged and not broadcast where few, so that the cost grows in proportion
    joined = join_groups(marked, pairs.hint("merge"), key, size, totals["rows"] or 0)
    kept = joined.filter(F.col(size).isNull()).select(*docs.columns)
    if totals["again"]:
        kept = kept.unionByName(joined.filter(again).dropDuplicates([key]).select(*docs.columns))
    return kept
