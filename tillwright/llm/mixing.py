"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every row has a 60-bit hash of its id. A source's budget in words is split into whole passes over
the source and a rest below one pass. The rest is met by the rows whose hash lies below a threshold:
words are summed by (source, top 12 bits of the hash), a running sum over those buckets finds the
bucket in which the budget ends, only that bucket is summed again by the next 12 bits, and only the
boundary bucket of that by the single hash. Rows are then filtered by comparing hashes; no rows are
sorted, only at most 4096 bucket sums per source. Thresholds are nested: a larger budget of the same
source takes a superset of the rows. The row at the threshold itself is taken in part, so that a
source's words come within one of its rounded target.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows that
share an id share a hash and, at the threshold, the remainder in proportion to their sizes; an empty
table or one without words takes nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, free_name, n_words

#: With more sources than this the table of thresholds is joined without a broadcast.
BROADCAST_SOURCES = 100_000


def id_hash(col):
    """The first 60 bits of md5 of the id as text ('' for null), as a long."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size) to target: shares by weight, none above cap times its size, the excess
    going to the others by weight. One row per source; the windows run over those rows only.

    With sources in order of cap * size / weight, the capped ones are a prefix; the level (words per
    unit of weight) of the rest is what remains of the total over their weight.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("full", F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")))
    levelled = (
        named.withColumn("full", (cap * F.col("source_size")).cast("double") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
        .withColumn("level", F.first(F.when(F.col("level") <= F.col("full"), F.col("level")), ignorenulls=True).over(every))
    )
    target = F.least((cap * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))
    return levelled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _boundary(sums: DataFrame, bucket: str) -> DataFrame:
    """The bucket of each source in which its budget ends, and what is left of the budget there."""
    w = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("words").over(w)
    return (
        sums.withColumn("upto", upto).filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")))
        .select("source", bucket, (F.col("budget") - F.col("upto") + F.col("words")).alias("budget"), "words")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, hash of every row."""
    base = materialize(
        docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), id_hash(F.col(key)).alias("hash")), "sizes"
    )
    return base.join(_thresholds(base, weights, cap), F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id", "source", "size", "source_size", "target", _taken(F.col("size"), F.col("hash")).alias("taken"), "hash"
    )


def _taken(size: Column, hashed: Column, prefix: str = "") -> Column:
    """Words of a row that the mix takes."""
    passes, at, budget, words = (F.col(prefix + c) for c in ("t_passes", "t_hash", "t_budget", "t_words"))
    part = F.when(hashed < at, size).when(hashed == at, size * budget / words).otherwise(F.lit(0))
    return (passes * size + F.coalesce(F.floor(part), F.lit(0))).cast("long")


def _thresholds(base: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """A row per source: passes, threshold hash, and the words to take of what lies on it."""
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    goal = F.round("target").cast("long")
    budgets = materialize(targets.select(
        "source", "source_size", "target", F.coalesce(F.floor(goal / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).alias("passes"),
    ).withColumn("budget", goal - F.col("passes") * F.col("source_size")), "targets")
    few = budgets.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda df: df

    def inside(rows: DataFrame, cut: DataFrame, bucket: str | None) -> DataFrame:
        cut = cut.select(F.col("source").alias("c_source"), "budget", *([F.col(bucket).alias("c_bucket")] if bucket else []))
        on = F.col("source").eqNullSafe(F.col("c_source"))
        return rows.join(small(cut), on & (F.col(bucket) == F.col("c_bucket")) if bucket else on)

    b1, b2 = F.shiftright("hash", 48).alias("b1"), F.shiftright("hash", 36).alias("b2")
    rows = base.select("source", "size", "hash", b1, b2).filter("size > 0")
    cut = budgets.filter("source_size > 0")
    for bucket, within in (("b1", None), ("b2", "b1"), ("hash", "b2")):
        sums = inside(rows, cut, within).groupBy("source", bucket, "budget").agg(F.sum("size").alias("words"))
        cut = materialize(_boundary(sums, bucket), f"cut-{bucket}")
    cut = cut.select(F.col("source").alias("u_source"), F.col("hash").alias("t_hash"), F.col("budget").alias("t_budget"), F.col("words").alias("t_words"))
    table = budgets.join(small(cut), F.col("source").eqNullSafe(F.col("u_source")), "left").select(
        F.col("source").alias("t_source"), "source_size", "target", F.col("passes").alias("t_passes"), "t_hash", "t_budget", "t_words"
    )
    return small(table)


def mix_rows(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``docs`` as mixed: a row for each whole pass that takes it and, for the row on a source's
    threshold, one more with only its first words, a space between them. Columns as they were;
    n_chars is renewed where the text is cut. Rows of size 0 are not taken."""
    base = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash")), "sizes")
    table = _thresholds(base, weights, cap)
    prefix = "t_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    table = table.toDF(*(f"{prefix}{c}" for c in table.columns))
    size, taken, first = free_name(docs, f"{prefix}size", f"{prefix}taken", f"{prefix}first")
    rows = docs.join(table, F.col("source").eqNullSafe(F.col(f"{prefix}t_source"))).withColumn(size, n_words(F.col("text")))
    rows = rows.filter(F.col(size) > 0).withColumn(taken, _taken(F.col(size), id_hash(F.col("doc_id")), prefix))
    copies = F.array_repeat(F.lit(0), F.floor(F.col(taken) / F.col(size)).cast("int"))
    rest = (F.col(taken) % F.col(size)).cast("int")
    rows = rows.withColumn(first, F.explode(F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)))
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col(first)))
    rows = rows.withColumn("text", F.when(F.col(first) > 0, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(first) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
