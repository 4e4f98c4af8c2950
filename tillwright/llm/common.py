"""Pieces that several operators of this folder share."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in one Arrow batch at most: very long texts then still fit a Python worker.
BATCH_ROWS = 1000
#: A key with more than 1/HEAVY_SHARE of all rows is heavy, so there are at most HEAVY_SHARE of them.
HEAVY_SHARE = 1000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower Spark's Arrow batch size to ``rows`` if it is larger or unlimited."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would change other letters too."""
    return F.translate(col, UPPER, LOWER)


def n_words(col: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc(col: Column) -> Column:
    """crc32 of the id as decimal text; null for a null id."""
    return F.crc32(F.encode(col.cast("string"), "utf-8"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row per ``key`` in ``groups`` (``size``: its number of rows).

    Groups above total/HEAVY_SHARE rows number at most HEAVY_SHARE, so they are broadcast, and their
    rows are never shuffled by key; no key of the rest holds more than that share of a shuffle.
    """
    limit = max(1, total // HEAVY_SHARE)
    heavy = groups.filter(F.col(size) > limit)
    light = groups.filter(F.col(size) <= limit)
    marked = rows.join(F.broadcast(heavy), key, "left")
    missing = F.col(size).isNull()
    cold = marked.filter(missing).select(*rows.columns).join(light, key, "left")
    return marked.filter(~missing).select(*cold.columns).unionByName(cold)


def join_heavy_apart(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key`` (a long) in ``groups`` (``size``: its rows). Groups above
    total/HEAVY_SHARE rows, HEAVY_SHARE at most, are told apart by a set of constants: their rows are joined
    by broadcast and never shuffled, and no other row takes part in that join."""
    limit = max(1, total // HEAVY_SHARE)
    heavy = [r[0] for r in groups.filter(F.col(size) > limit).select(key).collect()]
    if not heavy:
        return rows.join(groups, key)
    apart = F.col(key).isin(heavy)
    hot = rows.filter(apart).join(F.broadcast(groups.filter(F.col(size) > limit)), key)
    return hot.unionByName(rows.filter(~apart).join(groups.filter(F.col(size) <= limit), key))


def join_salted(rows: DataFrame, table: DataFrame, key: str, other: Column, counts: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per ``key``; counts: its rows n in ``rows``). Keys with
    more than 1/HEAVY_SHARE of the rows are salted: their rows are dealt by ``other`` to parts of that size
    and the table's row is repeated for each part, so that no key gathers in one task. There are at most
    HEAVY_SHARE such keys; they alone are broadcast, without what the table holds for them."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(1, total // HEAVY_SHARE)
    parts = F.ceil(F.col("n") / most).cast("int")
    hot = counts.filter(F.col("n") > most).select(F.col(key).alias("_hot"), parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(other, F.coalesce("_parts", F.lit(1))).cast("int"))
    repeated = table.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.drop("_hot", "_parts").join(repeated.drop("_hot", "_parts"), [key, "_salt"]).drop("_salt")


def free_name(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores put before them until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of text in one range of an ordered pass, about; ranges at most, as their bounds are constants of the plan and
#: a range, of whatever size, is read as a stream; keys looked at for each bound.
RANGE_BYTES = 64 << 20
MOST_RANGES = 20_000
SAMPLE = 20


def range_count(rows: DataFrame, size: Column) -> tuple[int, int]:
    """Number of rows, and of ranges to deal them to: by their bytes, at least the shuffle's partitions, MOST_RANGES at most."""
    got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return got["n"], min(MOST_RANGES, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-got["size"] // RANGE_BYTES)))


def _literal(keys: list, kind: str) -> Column:
    """An array of keys (structs), a constant of the plan whatever its length."""
    return F.from_json(F.lit(json.dumps([k.asDict() for k in keys])), f"array<{kind}>").cast(f"array<{kind}>")


def _range_of(key: Column, bounds: list, kind: str) -> Column:
    """Number of the bounds that are not above ``key``: the block of bounds first, then the bound within it."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    before = lambda keys: F.size(F.filter(keys, lambda x: x <= key))
    start = F.greatest(before(_literal(bounds[::step], kind)) - 1, F.lit(0)) * step
    return start + before(F.slice(_literal(bounds, kind), start + 1, F.lit(step)))


def deal_ranges(rows: DataFrame, n: int, parts: int, beside: Sequence[tuple[str, int]], wrap: bool = False) -> DataFrame:
    """The ``n`` rows dealt to ``parts`` ranges, at most, of the struct ``k``; rows of one key share a range.

    The bounds are keys chosen by their hash (SAMPLE for each), so the ranges are the same in every run.
    beside: which end of a range, "first" or "last", also goes to the range so many steps away (with
    ``wrap`` round the ends), all rows of that key; own is false for those, and turn is 1 where they went
    round. Rows are to be sorted by turn and k in each partition.
    """
    kind = rows.schema["k"].dataType.simpleString()
    share = min(1 << 30, (SAMPLE * parts << 30) // max(1, n) + 1)
    some = rows.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < share).select("k").distinct().collect() if parts > 1 else []
    some = sorted((r["k"] for r in some), key=_key_order)
    bounds = [some[i] for i in sorted({j * len(some) // parts for j in range(1, parts)})] if some else []
    place = _range_of(F.col("k"), bounds, kind)
    ends = rows.groupBy(place.alias("p")).agg(F.min("k").alias("first"), F.max("k").alias("last")).orderBy("p").collect()
    if not ends:
        return rows.withColumns({"own": F.lit(True), "turn": F.lit(0)})
    number = {r["p"]: i for i, r in enumerate(ends)}  # ranges that have rows, numbered anew
    number = F.get(F.from_json(F.lit(json.dumps([number.get(p, 0) for p in range(len(bounds) + 1)])), "array<int>"), place)
    copies = [F.struct(F.lit(0).alias("step"), F.lit(True).alias("own"))]
    if len(ends) > 1 or wrap:
        for end, step in beside:
            at = F.get(_literal([r[end] for r in ends], kind), F.col("p"))
            copies.append(F.when(F.col("k") == at, F.struct(F.lit(step).alias("step"), F.lit(False).alias("own"))))
    dealt = rows.withColumn("p", number).withColumn("c", F.explode(F.array_compact(F.array(*copies)))).withColumn("to", F.col("p") + F.col("c.step"))
    inside = F.col("to").between(0, len(ends) - 1)
    dealt = dealt.withColumns({"own": F.col("c.own"), "turn": F.when(inside, 0).otherwise(1)})
    dealt = dealt.withColumn("to", F.pmod("to", F.lit(len(ends)))) if wrap else dealt.filter(inside)
    return dealt.repartitionById(len(ends), F.col("to")).drop("p", "c", "to")


def _key_order(key) -> tuple:
    """Spark's order of strings is that of their UTF-8 bytes."""
    return tuple(x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x for x in key)


class WordCache(dict):
    """Value by word, made by ``make`` at a miss. Two generations bound the memory: when the young
    one is full it becomes the old one, and words still in use are copied over at their next use."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self.put(word, value)
        return value

    def put(self, word, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = value
