"""Near-duplicate groups by b-bit MinHash.

1. Each text becomes its set of distinct word shingles (64-bit hashes). Texts with equal sets are one
   class, so copies cost one row each and never meet in pairs.
2. HASHES minima per class. BANDS keys over ROWS full minima each give candidates; of each minimum
   BITS low bits (of its mixed value) are kept, packed into longs. Two signatures' similarity is
   estimated from the equal bit groups, counted with bit operations and corrected for the share that
   collides by chance: J = (equal / HASHES - C) / (1 - C), C = 2 ** -BITS. Only pairs estimated
   below the threshold less MARGIN (six standard errors) are dropped unseen.
3. Every class in a bucket is compared with the bucket's smallest class: a star, not all pairs. Links
   are confirmed on full sets and joined to components. Where a bucket then still holds several
   components, its pairs across components are estimated, block by block inside the tasks, and joined
   to rough components, which hold all that may still be linked. A bucket of more than BANDS * BLOCK classes is
   banded again: only those that share one of the other bands as well meet, as pairs at the threshold do. Where a rough component has several
   confirmed components, its pairs across those are confirmed on full sets, again block by block. Tasks
   return links that join components, fewer than their rows, never the pairs: no candidate link between
   different components is lost, and none is written that joins nothing.
4. Components come from alternating large-star and small-star steps on the confirmed links.

A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 < 1e-7, and in a bucket that is banded
again no other one with (1 - 0.8 ** 4) ** 31 < 1e-7.

Defined cases: null text or one without words has no shingle and is linked with nothing; a text with
fewer words than a shingle is one shingle; a row with a null id is linked with nothing and stays; rows
that share an id are one node (the stage, drop_near_copies, links both kinds by a key of its own); a very
long text is one set, held whole in the task that compares it; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import HEAVY_SHARE, bounded_batches, free_name, join_groups, join_heavy_apart, join_salted

HASHES, BANDS, ROWS, BITS = 128, 32, 4, 4
LONGS = HASHES * BITS // 64
MARGIN = 0.22
#: Classes of one bucket in one block of a comparison (more of them in a large corpus), and shingles of one
#: rough component.
BLOCK, LARGEST_BLOCK = 512, 16_384
BLOCK_SHINGLES = 300_000
#: Links that one task contracts.
LOCAL_LINKS = 1_000_000
_RNG = np.random.default_rng(20_240_101)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_P = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64
_NIBBLES = 0x1111111111111111


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``n`` words."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    s = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        s += h[i : i + len(s)] * _P[i]
    return np.unique(_mix(s + _U(k)))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], starts)
    return _mix(out)


def pack_bits(m: np.ndarray) -> np.ndarray:
    """LONGS signed longs for each row of minima: the BITS low bits of each."""
    low = (m & _U((1 << BITS) - 1)).reshape(len(m), LONGS, 64 // BITS)
    shifts = (np.arange(64 // BITS, dtype=np.uint64) * _U(BITS))
    return np.bitwise_or.reduce(low << shifts, axis=2).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    bands = m.reshape(len(m), BANDS, ROWS)
    key = (np.arange(BANDS, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = _mix(key * _P[8 + i] + bands[:, :, i])
    return key.view(np.int64)


def estimate(equal, hashes: int = HASHES, bits: int = BITS):
    """Similarity from the number of equal bit groups, corrected for chance."""
    c = 2.0**-bits
    return (equal / hashes - c) / (1 - c)


def least_equal(threshold: float) -> int:
    """Equal bit groups that a pair must have to be confirmed."""
    c = 2.0**-BITS
    return int(np.ceil(((threshold - MARGIN) * (1 - c) + c) * HASHES))


def equal_groups(a: Column, b: Column) -> Column:
    """Equal bit groups of two packed signatures, by bit counts."""
    total = F.lit(0)
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        y = x
        for s in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, s))
        total = total + (64 // BITS - F.bit_count(y.bitwiseAND(F.lit(_NIBBLES))))
    return total


def _arrays(values: np.ndarray, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * width + 1, width), pa.int32()), pa.array(values.ravel(), pa.int64()))


def signatures(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key, sig, bands of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            texts = b.column(1).to_pylist()
            sizes, keys = np.zeros(len(texts), np.int64), [None] * len(texts)
            sig, bands = np.zeros((len(texts), LONGS), np.int64), np.zeros((len(texts), BANDS), np.int64)
            some: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                if some:
                    at = [i for i, _ in some]
                    m = minima([s for _, s in some])
                    sig[at], bands[at] = pack_bits(m), band_keys(m)
                    some.clear()

            held = 0
            for i, t in enumerate(texts):
                s = shingles(t, words)
                sizes[i] = len(s)
                if len(s):
                    keys[i] = xxh3_128_digest(s.tobytes())
                    some.append((i, s))
                    held += len(s)
                if held > 60_000:
                    flush()
                    held = 0
            flush()
            cols = [b.column(0), pa.array(sizes), pa.array(keys, pa.binary()), _arrays(sig, LONGS), _arrays(bands, BANDS)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set_key", "sig", "bands"])

    rows = docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig array<long>, bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(rep, set) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(s) for s in sets])
                values = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["rep", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "rep long, set array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return join_salted(pairs.join(left, "a"), right, "b", F.xxhash64("a"), pairs.groupBy("b").agg(F.count("*").alias("n"))).filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of one task as stars: each node with the smallest that it reaches by these links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    stars = [(x, r) for x in parent if (r := find(x)) != x]
    if stars:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars)], ["u", "v"])


def components(edges: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, label) of every node of the links (a, b) but the smallest of each component: label is
    that smallest node.

    Links are first contracted to stars inside tasks of about ``local`` links. If that took one task, it
    is done. Otherwise large-star and small-star steps (each node hands its neighbours the smallest it
    knows) alternate with it until the links no longer change; each step reads a written table.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, mark = materialize(now, "links"), None
    while True:
        tasks = max(1, -(-now.count() // local))
        now = materialize(now.repartition(tasks).mapInArrow(_local_stars, "u long, v long").distinct(), "stars")
        if tasks == 1:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.filter("v > u")
        large = join_salted(up, least, "u", F.xxhash64("v"), up.groupBy("u").agg(F.count("*").alias("n"))).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = materialize(small, "links")
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (got["n"], got["h"]):
            break
        mark = (got["n"], got["h"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _in_blocks(rows: DataFrame, by: str, weight: Column | None, most: int) -> DataFrame:
    """Rows dealt so that each pair of one group meets in one task: a group whose weights (1 if none) sum to more
    than ``most`` is dealt to several blocks, and two blocks (p, q) of it are compared at a time. The
    first columns are the group, p, q, and the row's own block i."""
    total = rows.count()
    if weight is None:  # larger blocks of more rows: a row of a large group is copied to fewer of them
        weight, most = F.lit(1), max(most, min(LARGEST_BLOCK, total // HEAVY_SHARE))
    n = rows.groupBy(by).agg(F.ceil(F.sum(weight) / most).cast("int").alias("n"), F.count("*").alias("rows"))
    dealt = join_heavy_apart(rows, n, by, "rows", total).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select(by, F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", *(c for c in rows.columns if c != by))
    return dealt.repartition(by, "p", "q").sortWithinPartitions(by, "p", "q")


def _forest(batches: Iterator[pa.RecordBatch], least: int, percent: int | None) -> Iterator[pa.RecordBatch]:
    """Links between rows of different labels that join all that can be joined, and no more: pairs of
    one group (rows: group, p, q, i, rep, label, sig[, set]) are linked if they have ``least`` equal bit
    groups and, where ``percent`` is given, if their sets are that similar. Once two labels are linked,
    pairs of theirs are not looked at again, so there are fewer links than rows."""
    held, at, found = [], None, []

    def compare() -> None:
        p, q = at[1:]
        block, rep, root = (np.array([r[k] for r in held]) for k in range(3))
        if (root == root[0]).all():
            return
        sig = np.array([r[3] for r in held], np.int64).view(np.uint64)
        size = np.array([len(r[4]) for r in held]) if percent else None
        if percent:  # the sets' members by number: those of one row are marked, and counted in all rows at once
            numbers = np.unique(np.concatenate([r[4] for r in held]), return_inverse=True)[1]
            starts, mark = np.cumsum(size) - size, np.zeros(numbers.max() + 1, np.int32)
        place = np.arange(len(held))
        for i in range(len(held)):
            if block[i] != p:
                continue
            to = np.flatnonzero((block == q) & (root != root[i]) & ((place > i) | (p != q)))
            if percent and len(to):
                lo, hi = np.minimum(size[to], size[i]), np.maximum(size[to], size[i])
                to = to[100 * lo >= percent * hi]
            if not len(to):
                continue
            x = sig[to] ^ sig[i]
            y = x.copy()
            for s in range(1, BITS):
                y |= x >> _U(s)
            to = to[HASHES - np.bitwise_count(y & _U(_NIBBLES)).sum(axis=1, dtype=np.int64) >= least]
            if percent and len(to):
                mine = numbers[starts[i] : starts[i] + size[i]]
                mark[mine] = 1
                both = np.add.reduceat(mark[numbers], starts)[to]
                mark[mine] = 0
                to = to[100 * both >= percent * (size[to] + size[i] - both)]
            for k in to:
                if root[k] == root[i] or rep[k] == rep[i]:
                    continue
                found.append((int(rep[i]), int(rep[k])))
                root[root == root[k]] = root[i]

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
        found.clear()
        return batch

    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(7)]
        if percent:
            sets, ends = b.column(7).flatten().to_numpy(zero_copy_only=False), np.cumsum([0] + pc.list_value_length(b.column(7)).to_pylist())
            columns.append([sets[m:n] for m, n in zip(ends, ends[1:])])
        for group, p, q, *row in zip(*columns):
            if at != (group, p, q):
                if held:
                    compare()
                held, at = [], (group, p, q)
            held.append(row)
        if len(found) > 10_000:
            yield out()
    if held:
        compare()
    if found:
        yield out()


def _meeting(named: DataFrame, classes: DataFrame, most: int | None = None) -> DataFrame:
    """Groups in which classes are still to be compared (key, rep, label, sig): the buckets (named: key, rep, label)
    that hold several labels, those of more than ``most`` classes banded again, which costs BANDS rows a class
    where comparing all blocks of the bucket would cost more."""
    most = most or BANDS * BLOCK

    def mixed(rows: DataFrame) -> DataFrame:
        groups = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("met")).filter("lo < hi").select("key", "met")
        return join_heavy_apart(rows, groups, "key", "met", rows.count())

    named = materialize(mixed(named), "mixed")
    small = named.filter(F.col("met") <= most).join(classes.select("rep", "sig"), "rep").select("key", "rep", "label", "sig")
    if not named.filter(F.col("met") > most).limit(1).count():
        return small
    large = named.filter(F.col("met") > most).join(classes.select("rep", "sig", "bands"), "rep").select("key", "rep", "label", "sig", F.explode("bands").alias("other"))
    again = large.filter("other <> key").withColumn("key", F.xxhash64("key", "other")).drop("other")
    again = mixed(materialize(again, "banded-again"))
    return small.unionByName(again.select("key", "rep", "label", "sig"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    all_sigs = materialize(signatures(docs, words), "signatures")
    some = all_sigs.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    entries = classes.select("rep", F.explode("bands").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    hubs = materialize(hubs, "hubs")
    met = join_heavy_apart(entries, hubs, "key", "n", BANDS * classes.count())
    shared = materialize(met.select("key", "rep", "hub"), "buckets")
    sigs = classes.select("rep", "sig")
    least = least_equal(percent / 100)
    stars = shared.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    per_hub = materialize(stars.groupBy("b").agg(F.count("*").alias("n")), "per-hub")
    near = stars.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a")
    stars = join_salted(near, sigs.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b", F.xxhash64("a"), per_hub)
    stars = materialize(stars.filter(equal_groups(F.col("x"), F.col("y")) >= least).select("a", "b").distinct(), "stars")
    wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(full_sets(docs.join(wanted, "doc_id", "left_semi"), words), "sets")
    first = components(confirm(stars, sets, percent))

    # buckets whose classes, but for the hub that all were compared with, are in several components
    named = shared.filter("rep <> hub").join(first, shared["rep"] == first["node"], "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    named = materialize(named, "named")
    rest = materialize(_meeting(named, classes), "rest")
    rough = _in_blocks(rest, "key", None, BLOCK).mapInArrow(lambda it: _forest(it, least, None), "a long, b long").distinct()
    stars_too = first.select(F.col("node").alias("a"), F.col("label").alias("b"))
    # what may be linked lies in one rough component; where that has several labels, full sets decide
    rough = components(rough.unionByName(stars_too)).withColumnRenamed("label", "rough")
    rough = rough.unionByName(rough.select(F.col("rough").alias("node"), "rough").distinct())  # the smallest too
    inside = rough.join(first, "node", "left").select(F.col("node").alias("rep"), "rough", F.coalesce("label", "node").alias("label"))
    inside = materialize(inside, "rough")
    several = inside.groupBy("rough").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("met")).filter("lo < hi").select("rough", "met")
    inside = join_heavy_apart(inside, several, "rough", "met", inside.count())
    inside = inside.join(sigs, "rep").join(sets, "rep").select("rough", "rep", "label", "sig", "set")
    inside = materialize(inside, "inside")
    bounded_batches(docs.sparkSession, 200)
    more = _in_blocks(inside, "rough", F.size("set") + 500, BLOCK_SHINGLES).mapInArrow(lambda it: _forest(it, least, percent), "a long, b long").distinct()
    final = components(more.unionByName(stars_too))

    named = classes.select("set_key", "rep", "copies").join(final, F.col("rep") == F.col("node"), "left")
    groups = materialize(named.select("set_key", "copies", F.coalesce("label", "rep").alias("component_id")), "groups")
    rows = all_sigs.select("doc_id", "n_shingles", F.when(F.col("n_shingles").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    linked = join_groups(rows.filter("set_key is not null"), groups, "set_key", "copies", all_sigs.count()).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the smallest id of each group, all columns as they were. Where ids are null or
    repeated, rows get a key of their own: a row without id is linked as any other and comes last in its
    group, and of rows that share an id one text stays (rows equal in id and text are one document)."""
    whole = F.col("doc_id").cast("long")
    gone_name, row = free_name(docs, "gone_id", "row_key")
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct(whole).alias("ids")).first()
    if ids["n"] == ids["ids"]:
        out = near_duplicates(docs, words, percent).filter("not kept").select(F.col("doc_id").alias(gone_name)).distinct()
        return docs.join(out, whole == F.col(gone_name), "left_anti").select(*docs.columns)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    linked = near_duplicates(rows, words, percent, row).filter("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
    mine = rows.select(row, whole.alias("id"), F.sha2(F.col("text").cast("string").cast("binary"), 256).alias("digest"))
    named = materialize(mine.join(linked, row), "named")
    best = named.groupBy("component_id").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", row)).alias("best")).filter("copies > 1")
    one = (F.col(row) == F.col(f"best.{row}")) | (F.col("id") == F.col("best.id")) & (F.col("digest") == F.col("best.digest"))
    gone = join_groups(named, best, "component_id", "copies", named.count()).filter(F.col("best").isNotNull() & ~F.coalesce(one, F.lit(False)))
    return rows.join(gone.select(row), row, "left_anti").select(*docs.columns)
