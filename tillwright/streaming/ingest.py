"""Incremental ingest with Structured Streaming. An extension: the batch operators define the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import workflow


def receipt_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Receipts that arrive as JSON files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def monthly_trend_stream(receipts: DataFrame, late: str = "7 days") -> DataFrame:
    """Spend and count by month of the receipt's time. A month is closed by the first receipt of a month that
    starts more than ``late`` after it: with less than 28 days by the next month's first receipt, with 31 days
    by the first of the month after that. Receipts of a closed month are dropped."""
    timed = receipts.withColumn("month_start", F.date_trunc("month", F.to_timestamp("receipt_date"))).withWatermark("month_start", late)
    return timed.groupBy("month_start").agg(F.sum("total").alias("spend"), F.count("*").alias("count")).select(F.date_format("month_start", "yyyy-MM").alias("ym"), "spend", "count")


def upsert_batches(load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch is upserted into the table's current state by source_id.
    ``save`` gets the batch's number, so that writing a batch again replaces what it wrote before."""

    def run(batch: DataFrame, number: int) -> None:
        save(workflow.upsert(load(), batch), number)

    return run
