"""Dashboard aggregates, feeds and lists over ``receipts`` and their children.

Each function takes the tables it reads and returns the payload as a DataFrame. "Now" is always the
argument ``as_of`` (a date literal), so that results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Item states that count as flagged, and the ends of the confidence classes.
FLAGGED_STATES = ("OUTLIER", "FLAGGED", "LOW_CONF", "ERROR")
FAILED_STATES = ("Failed", "Error")
HIGH, MEDIUM = 80, 60


def count_if(condition: Column) -> Column:
    """Rows that meet a condition; 0 (not null) over no rows."""
    return F.count(F.when(condition, 1))


def missing_vendor(receipts: DataFrame) -> DataFrame:
    """Receipts whose vendor is null or blank."""
    return receipts.filter(F.col("vendor").isNull() | (F.trim("vendor") == ""))


def flagged_items(items: DataFrame) -> DataFrame:
    return items.filter(F.col("item_status").isin(*FLAGGED_STATES))


def summary(receipts: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """One row of totals. Both aggregates are single rows, so joining them is free."""
    week_ago = F.date_sub(F.lit(as_of).cast("date"), 7)
    review = F.col("ai_review_status")
    head = receipts.agg(
        F.count("*").alias("total_receipts"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(28,2)").alias("total_spend"),
        F.coalesce(F.round(F.avg("confidence"), 1), F.lit(0.0)).alias("avg_confidence"),
        F.countDistinct("vendor").alias("vendor_count"),
        *(count_if(review == s).alias(n) for s, n in (("pending", "pending_review"), ("approved", "approved_count"), ("rejected", "rejected_count"))),
        count_if(F.col("extraction_source") == "ocr").alias("ocr_only_count"),
        count_if(F.col("extraction_source") == "ocr+llm").alias("ocr_llm_count"),
        count_if(F.col("status").isin(*FAILED_STATES)).alias("failed_count"),
        count_if(F.col("created_at") >= week_ago).alias("new_this_week"),
    )
    return head.crossJoin(flagged_items(items).agg(F.count("*").alias("flagged_items")))


def validation_summary(receipts: DataFrame, items: DataFrame, validation: DataFrame) -> DataFrame:
    """One row of quality totals. Any status other than ``ok`` counts as a mismatch, PASS included."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias
    v = validation.agg(
        total("outliers_count")("price_outliers"),
        count_if(F.col("subtotal_status") != "ok").alias("subtotal_mismatch"),
        total("name_quality_issues")("name_quality_issues"),
        total("price_range_warnings")("price_range_warnings"),
    )
    low = items.agg(count_if(F.col("confidence") < 60).alias("low_confidence_items"))
    return v.crossJoin(low).crossJoin(missing_vendor(receipts).agg(F.count("*").alias("missing_vendor")))


def monthly_trend(receipts: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Spend and count by month from ``months`` months before as_of; a null date drops out."""
    since = F.add_months(F.lit(as_of).cast("date"), -months)
    by_month = receipts.filter(F.col("receipt_date") >= since).groupBy(F.date_format("receipt_date", "yyyy-MM").alias("ym"))
    totals = by_month.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(28,2)").alias("spend"), F.count("*").alias("count"))
    return totals.select("ym", F.date_format(F.to_date(F.concat("ym", F.lit("-01"))), "MMM").alias("month"), "spend", "count").orderBy("ym")


def confidence_distribution(receipts: DataFrame) -> DataFrame:
    """(source, high, medium, low) for ``ocr`` and ``llm``, zero where a source has no receipt."""
    names = receipts.sparkSession.createDataFrame([("ocr", "ocr"), ("ocr+llm", "llm")], "extraction_source string, source string")
    c = F.col("confidence")
    counted = receipts.filter(F.col("extraction_source").isin("ocr", "ocr+llm")).groupBy("extraction_source").agg(
        count_if(c >= HIGH).alias("high"), count_if((c >= MEDIUM) & (c < HIGH)).alias("medium"), count_if(c < MEDIUM).alias("low")
    )
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return names.join(counted, "extraction_source", "left").select("source", zero("high"), zero("medium"), zero("low"))


def activity_feed(receipts: DataFrame, limit: int = 15) -> DataFrame:
    """The newest ``limit`` receipts as feed entries; equal times are ordered by the larger id."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    label = F.coalesce(blank("vendor"), blank("job_id"), F.concat(F.lit("Receipt #"), F.col("receipt_id").cast("string")))
    review, status = F.lower(F.trim(F.coalesce("ai_review_status", F.lit("")))), F.trim(F.coalesce("status", F.lit("")))
    failed = status.isin(*FAILED_STATES)
    # fixed values of the feed: state, type, icon, wording
    states = [
        (review == "approved", "llm", "✓", F.lit("LLM run approved")),
        (review == "rejected", "reject", "✕", F.lit("LLM run rejected")),
        (review == "pending", "flag", "!", F.lit("Pending AI review")),
        (failed, "reject", "✕", F.concat(F.lit("Processing "), F.lower(status))),
        (F.lit(True), "upload", "↑", F.lit("Uploaded")),
    ]

    def choose(value) -> Column:
        out = F.lit(None)
        for row in reversed(states):
            out = F.when(row[0], value(row)).otherwise(out)
        return out

    newest = receipts.orderBy(F.col("updated_at").desc(), F.col("receipt_id").desc()).limit(limit)
    text = F.concat(choose(lambda r: r[3]), F.lit(" — <strong>"), label, F.lit("</strong>"))
    return newest.select("receipt_id", choose(lambda r: F.lit(r[1])).alias("type"), choose(lambda r: F.lit(r[2])).alias("icon"), text.alias("text"))


def receipts_list(receipts: DataFrame, limit: int = 200) -> DataFrame:
    """The newest receipts; data_source is ``llm`` while a run waits for review."""
    pending = F.col("active_llm_run_id").isNotNull() & (F.col("ai_review_status") == "pending")
    newest = receipts.orderBy(F.col("receipt_id").desc()).limit(limit)
    return newest.select(
        "receipt_id", "job_id", "source_id", "vendor", "receipt_date", "total", "status", "confidence",
        "extraction_source", "ai_review_status", "active_llm_run_id", F.when(pending, "llm").otherwise("receipt").alias("data_source"),
    )


def percentages(receipts: DataFrame, key: str) -> DataFrame:
    """Rows and whole percent by ``key``, half up; an empty table has no rows. The total is one row."""
    by = receipts.groupBy(key).agg(F.count("*").alias("n"))
    total = receipts.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    return by.crossJoin(total).select(key, "n", F.floor((F.col("n") * 200 + F.col("total")) / (2 * F.col("total"))).cast("long").alias("percent"))


def vendor_colours(receipts: DataFrame, shown: int = 10, colours: int = 7) -> DataFrame:
    """The newest ``shown`` receipts, each vendor with a colour number by its first appearance."""
    from pyspark.sql import Window

    top = receipts.orderBy(F.col("receipt_id").desc()).limit(shown)
    name = F.coalesce(F.when(F.trim("vendor") != "", F.col("vendor")), F.lit("Unknown"))
    first = F.max("receipt_id").over(Window.partitionBy("name"))
    ranked = top.withColumn("name", name).withColumn("first", first)
    return ranked.select("receipt_id", F.col("name").alias("vendor"), ((F.dense_rank().over(Window.orderBy(F.col("first").desc())) - 1) % colours).cast("int").alias("colour"))
