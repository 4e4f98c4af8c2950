"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group and groups are placed whole; only a group larger than a shard may be is split,
by a hash of the id and row, into parts of about 1/SPLIT of a shard. Each group goes, largest first, to the shard
where the dot product of its vector and the residual capacity is highest, among those whose residual
bytes can take it. Groups above 1/HEAVY_SHARE of any dimension (3 * HEAVY_SHARE at most) are placed first,
on the driver; the others are dealt by a hash of their text to lots of about LOT groups, and each lot is
placed in a task of its own against its share of the capacity which the heavy groups left in each shard.
A slot is the offset of the row's window in the shard plus its rank there; a window is a hash class of
the rows of a lot in a shard, or of a heavy group's, so that no window holds a whole shard or hot group.

Law: ``bytes``. Defined cases: null text has size 1 and equals only null or empty text; rows with a null
id are rows like others; repeated rows are rows like others, each with a slot of its own; a very long text
is a heavy group; equal dot products go to the first shard; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import HEAVY_SHARE, n_words

SPLIT = 8
#: Light groups placed in one task, about; hash classes of rows for each shard, about.
LOT = 2000
WINDOWS = 2048
DIMENSIONS = ("size", "tokens", "n")


def place(items: np.ndarray, shards: int, capacity: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """Shard of each item (a row of bytes, tokens, rows). Each dimension is a share of its total, and
    bytes, whose law must hold, count as much as the other two together. ``capacity``: each shard's part
    of the totals in each dimension, equal parts where it is not given; ``of``: the totals, if not the items' own."""
    total = np.maximum(items.sum(axis=0) if of is None else of, 1)
    share = items / total
    residual = np.full((shards, share.shape[1]), 1 / shards) if capacity is None else capacity.astype(float)
    weight = np.array([2.0, 1.0, 1.0])
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share[:, 0])):
        fits = residual[:, 0] >= share[i, 0] - 1e-12
        score = (residual * weight) @ share[i]
        score = np.where(fits, score, -np.inf) if fits.any() else residual[:, 0]
        out[i] = int(np.argmax(score))
        residual[out[i]] -= share[i]
    return out


def left_over(items: np.ndarray, where: np.ndarray, shards: int, totals: np.ndarray) -> np.ndarray:
    """Part of what is still to be placed that each shard should take, in each dimension."""
    used = np.zeros((shards, items.shape[1]))
    np.add.at(used, where, items)
    room = np.maximum(totals / shards - used, 0)
    return room / np.maximum(room.sum(axis=0), 1e-9)


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    rows = materialize(docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), n_words(F.col(text)).alias("tokens"),
        F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("group_key"),
        F.monotonically_increasing_id().alias("row"),  # written once; tells rows with null or repeated ids apart
    ), "rows")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    groups = materialize(rows.groupBy("group_key").agg(*sums), "groups")
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMENSIONS), F.count("*").alias("groups")).first()
    limit = {c: max(1, total[c] // HEAVY_SHARE) for c in DIMENSIONS}
    is_heavy = " OR ".join(f"{c} > {v}" for c, v in limit.items())

    # heavy groups, those above a shard's size in parts
    room = max(1, total["size"])
    parts = F.when(F.col("size") * shards > room, F.ceil(F.col("size") * (shards * SPLIT) / F.lit(room))).otherwise(F.lit(1)).cast("int")
    spread = F.greatest(F.ceil(F.col("n") / limit["n"]), F.lit(1)).cast("int")
    heavy = groups.filter(is_heavy).select("group_key", parts.alias("parts"), spread.alias("spread"))
    named = rows.join(F.broadcast(heavy), "group_key", "left")
    mine = named.filter("parts is not null").withColumn("part", F.pmod(F.xxhash64("doc_id", "row", F.lit(7)), F.col("parts")).cast("int"))
    items = mine.groupBy("group_key", "part").agg(*sums).collect()  # at most 3 * HEAVY_SHARE + shards * SPLIT + shards
    items.sort(key=lambda r: (bytes(r["group_key"]), r["part"]))
    vectors = np.array([[r[c] for c in DIMENSIONS] for r in items], float).reshape(-1, 3)
    totals = np.array([total[c] for c in DIMENSIONS], float)
    where = place(vectors, shards, of=totals)
    capacity = left_over(vectors, where, shards, totals)
    placed = spark.createDataFrame([(r["group_key"], r["part"], int(s)) for r, s in zip(items, where)], "group_key binary, part int, shard int")
    out = [mine.join(F.broadcast(placed), ["group_key", "part"]).withColumns({
        "lot": F.lit(-1), "window": F.pmod(F.xxhash64("doc_id", "row"), F.col("spread")).cast("int"),
    })]

    # light groups, lot by lot
    lots = max(1, min(-(-total["groups"] // LOT), 1 << 20))
    lot = F.pmod(F.xxhash64("group_key"), F.lit(lots)).cast("int")

    def place_lot(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_key", ignore_index=True)
        return pd.DataFrame({"group_key": pdf.group_key, "shard": place(pdf[list(DIMENSIONS)].to_numpy(float), shards, capacity).astype("int32")})

    light = groups.filter(f"not ({is_heavy})").withColumn("lot", lot).groupBy("lot").applyInPandas(place_lot, "group_key binary, shard int")
    classes = max(1, WINDOWS // lots)
    out.append(named.filter("parts is null").join(light, "group_key").withColumns({"lot": lot, "window": F.pmod(F.xxhash64("doc_id", "row"), F.lit(classes)).cast("int")}))

    # slots
    columns = ["doc_id", "size", "tokens", "text_crc32", "shard", "lot", "window"]
    dealt = materialize(out[0].select(*columns).unionByName(out[1].select(*columns)), "dealt")
    by = ["shard", "lot", "window"]
    before = Window.partitionBy("shard").orderBy("lot", "window").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "text_crc32", "size"))
    return dealt.withColumn("rank", rank).join(offsets, by).select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"))
