"""Search, sort, pages, distinct and top-k over lists, and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows whose columns, joined by spaces and in lower case, contain the query."""
    q = query.strip().lower()
    return df if not q else df.filter(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))).contains(q))


def search_any(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with a column that contains the query."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c).cast("string")).contains(query.lower()), F.lit(False))
    return df.filter(out)


def sort_text(df: DataFrame, column: str, descending: bool = False, *ties: str) -> DataFrame:
    key = F.lower(F.col(column))
    return df.orderBy(key.desc() if descending else key.asc(), *ties)


def dollars(c: Column) -> Column:
    """The number in a text like ``$1,250.00``."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of an ordered list; Spark keeps offset + size rows per task at most."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def page_numbers(current: int, last: int, shown: int = 5) -> list[int]:
    """The window of page numbers around the current one."""
    start = max(1, min(current - shown // 2, last - shown + 1))
    return list(range(start, min(last, start + shown - 1) + 1))


def first_by(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def near_distinct(values: Column, eps: float = 0.005) -> Column:
    """An array without values closer than ``eps`` to one kept before."""
    start = F.slice(values, 1, 0)
    return F.aggregate(values, start, lambda kept, x: F.when(F.exists(kept, lambda k: F.abs(k - x) < eps), kept).otherwise(F.array_append(kept, x)))


def union_by_priority(frames: list[DataFrame], keys: list[Column], order: str) -> DataFrame:
    """All frames, of equal keys only the row of the earliest frame."""
    out = None
    for i, df in enumerate(frames):
        df = df.withColumn("__p", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__p", order)
    return out.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__p")


def compress_lines(lines: DataFrame, score: Column, best: int = 25, most: int = 80, chars: int = 3500) -> DataFrame:
    """Text of each receipt cut for a prompt: its ``best`` lines by score first, then the others in
    order, ``most`` lines and ``chars`` characters in all; equal lines once."""
    w = Window.partitionBy("receipt_id")
    first = lines.withColumn("__k", F.row_number().over(Window.partitionBy("receipt_id", "line").orderBy("pos"))).filter("__k = 1").drop("__k")
    ranked = first.withColumn("score", score).withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), "pos")))
    place = F.struct(F.when(F.col("rank") <= best, F.struct(F.lit(0).alias("g"), F.col("rank").alias("r"))).otherwise(F.struct(F.lit(1).alias("g"), F.col("pos").cast("int").alias("r"))).alias("at"), F.col("line").alias("line"))
    listed = ranked.groupBy("receipt_id").agg(F.sort_array(F.collect_list(place)).alias("all"))
    joined = F.array_join(F.transform(F.slice("all", 1, most), lambda x: x["line"]), "\n")
    return listed.select("receipt_id", F.substring(joined, 1, chars).alias("text"))


def csv_rows(items: DataFrame) -> DataFrame:
    """Export lines: receipt_id, line_no, quoted name, price, currency; quotes in the name are doubled."""
    name = F.concat(F.lit('"'), F.replace(F.coalesce("item_name", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return items.select("receipt_id", "line_no", F.concat_ws(",", F.col("receipt_id").cast("string"), F.col("line_no").cast("string"), name, F.coalesce(F.col("price").cast("string"), F.lit("")), "currency").alias("csv"))


def json_rows(detail: DataFrame) -> DataFrame:
    """Export payloads: one JSON text per receipt."""
    return detail.select("receipt_id", F.to_json(F.struct(*(c for c in detail.columns))).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)
