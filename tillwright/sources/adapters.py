"""The engine's tables made from the driver's star schema, with integer arithmetic only, so that the
same tables can be made in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scale_partitions

MONEY = "decimal(18,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scale_partitions(spark, sf_dir, name)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def receipts(spark: SparkSession, sf_dir: str, broadcast: bool = True) -> DataFrame:
    """One receipt per order: vendor is the customer, null or blank for two in fifty. Without ``broadcast``
    customers never go through the driver, however small their file looks."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c = c if broadcast else c.hint("merge")
    k = F.col("o_orderkey")
    total = F.col("o_totalprice").cast(MONEY)
    day = F.col("o_orderdate").cast("date")
    pick = lambda n, values: F.get(F.array(*map(F.lit, values)), F.pmod(k, F.lit(n)).cast("int"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        k.alias("receipt_id"),
        F.concat(F.lit("job-"), (k % 97).cast("string")).alias("job_id"),
        F.concat(F.lit("job-"), (k % 97).cast("string"), F.lit("_"), k.cast("string")).alias("source_id"),
        F.when(k % 50 == 0, F.lit(None)).when(k % 50 == 1, F.lit("  ")).otherwise(F.col("c_name")).alias("vendor"),
        day.alias("receipt_date"),
        total.alias("total"),
        F.when(F.col("o_orderstatus") == "F", "Processed").when(F.col("o_orderstatus") == "O", "Pending").otherwise("Failed").alias("status"),
        (k * 37 % 101).cast("int").alias("confidence"),
        F.when(k % 3 == 0, "ocr+llm").otherwise("ocr").alias("extraction_source"),
        pick(4, ["pending", "approved", "rejected", "not_requested"]).alias("ai_review_status"),
        F.when(k % 4 < 3, k * 10 + 1).alias("active_llm_run_id"),
        day.alias("created_at"),
        day.alias("updated_at"),
    )


def items(spark: SparkSession, sf_dir: str, broadcast: bool = True) -> DataFrame:
    """One item per line of an order, numbered within it by a total order of the line's columns. Lines are numbered after
    their parts are joined, so the result is dealt by receipt_id and windows and groups over receipts need no further shuffle.
    Without ``broadcast`` parts never go through the driver."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    p = p if broadcast else p.hint("merge")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("line_no", F.row_number().over(w)).select(
        F.col("l_orderkey").alias("receipt_id"), "line_no", F.coalesce("p_name", F.lit("Unknown")).alias("item_name"),
        F.col("l_extendedprice").cast(MONEY).alias("price"), F.col("l_quantity").cast("int").alias("qty"), F.lit("CAD").alias("currency"),
        (k * 31 % 101).cast("int").alias("confidence"), (k * 17 % 101).cast("int").alias("name_conf"), (k * 13 % 101).cast("int").alias("price_conf"),
        F.col("l_partkey").alias("part_id"),
    )


def priced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items for outlier statistics: events as lines of the receipt of their user."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(F.col("user_id").alias("receipt_id"), F.row_number().over(w).alias("line_no"), F.col("event_type").alias("item_name"), F.col("value").cast(MONEY).alias("price"), "event_id")


def llm_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged model runs: the turns of a conversation are the runs of a receipt."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("receipt_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("llm_run_id"), F.col("role").alias("provider"), F.length("text").cast("long").alias("response_chars"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of OCR text: the non-blank lines of each document, trimmed."""
    d = read(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("receipt_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("receipt_id", "pos", F.trim("line").alias("line")).filter("line <> ''")
