"""One write of a batch of processed receipts with everything that hangs on them.

Headers are upserted by their source; the receipts' ids, old and new, then go to validation, summary and items.
Writing a batch again gives the same tables: rows that were there keep their ids. The next state of the tables is
returned; ``sources.store`` writes it aside and swaps it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import confidence_100, safe_float
from ..functions.text import name_key
from ..session import materialize
from .review import Tables, currency_3, upsert_child
from .workflow import latest, number_rows

#: Types of what a processed receipt may carry besides its header fields.
VALIDATION = "struct<subtotal_status:string,subtotal_discrepancy:double,subtotal_discrepancy_pct:double,outliers:array<struct<name:string,price:double>>,name_quality_issues:int,price_range_warnings:int,validation_json:string>"
SUMMARY = "struct<subtotal:double,tax:double,total:double,vendor:string,phone:string,address:string,date:string,summary_json:string>"
ITEMS = "array<struct<line_no:int,name:string,price:double,currency:string,confidence:double,name_confidence:double,price_confidence:double,flagged:boolean,reason:string>>"


def _named(c: str) -> Column:
    return F.when(F.trim(F.col(c)) != "", F.col(c))


def _typed(table: DataFrame) -> list[Column]:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]


def _lines(batch: DataFrame, least: float, default_currency: str) -> DataFrame:
    """Item rows: a nameless item is Unknown; a low confidence, an outlier of the receipt's validation and a flag
    set the status, the later over the earlier, and all give their reasons."""
    one = batch.select("receipt_id", "confidence", "currency", "validation", F.posexplode("items").alias("pos", "i"))
    name = F.trim(F.coalesce(F.when(F.trim("i.name") != "", F.col("i.name")), F.lit("Unknown")))
    conf = lambda c: confidence_100(c.cast("string"))
    one = one.select(
        "receipt_id", F.coalesce(F.when(F.col("i.line_no") != 0, F.col("i.line_no")), F.col("pos") + 1).cast("int").alias("line_no"), name.alias("item_name"),
        currency_3(F.col("i.currency"), F.col("currency"), default=default_currency).alias("currency"), F.coalesce("i.price", F.lit(0.0)).alias("unit_price"),
        conf(F.coalesce("i.confidence", "confidence")).alias("confidence"), conf(F.col("i.name_confidence")).alias("name_conf"), conf(F.col("i.price_confidence")).alias("price_conf"),
        F.coalesce("i.flagged", F.lit(False)).alias("_flagged"), F.col("i.reason").alias("_reason"), F.coalesce("validation.outliers", F.array().cast("array<struct<name:string,price:double>>")).alias("_odd"))
    odd = F.exists("_odd", lambda o: F.coalesce((name_key(o["name"]) == name_key(F.col("item_name"))) & (F.round(o["price"], 2) == F.round("unit_price", 2)), F.lit(False)))
    low = ((F.col("name_conf") > 0) & (F.col("name_conf") < least)) | ((F.col("price_conf") > 0) & (F.col("price_conf") < least))
    one = one.withColumns({"_odd": odd, "_low": low})
    said = F.array_compact(F.array(
        F.when(F.col("_low"), F.format_string(f"name_conf=%.1f, price_conf=%.1f (<{least:.1f})", "name_conf", "price_conf")), F.when(F.col("_odd"), F.lit("validation_outlier")),
        F.when(F.col("_flagged"), F.coalesce(F.when(F.col("_reason") != "", F.col("_reason")), F.lit("flagged")))))
    status = F.when(F.col("_flagged"), "FLAGGED").when(F.col("_odd"), "OUTLIER").when(F.col("_low"), "LOW_CONF").otherwise("OK")
    return one.select(
        "receipt_id", "line_no", "item_name", "currency", "unit_price", "confidence", "name_conf", "price_conf", F.col("_odd").cast("int").alias("is_outlier"), status.alias("item_status"),
        F.when(F.size(said) > 0, F.array_join(said, " | ")).alias("status_reason"))


#: Tables that a batch is written to, and what each reads of a processed receipt besides its header fields.
READ = {"receipts": (), "validation": ("validation",), "summary": ("summary",), "items": ("validation", "items")}
WRITTEN = tuple(READ)


def save_processed(t: Tables, processed: DataFrame, now: Column, default_currency: str = "CAD", least: float = 70.0, asked: tuple[str, ...] = WRITTEN) -> Tables:
    """receipts, validation, summary and items after a batch (one row per processed receipt: source_id, job_id,
    receipt_name, vendor, receipt_date, subtotal, tax, total, confidence, currency, raw_json, ocr_json,
    predictionlog_json, seq, validation, summary, items).

    Of rows of one source the largest seq is written. A receipt without a source gets one from its job and contents.
    A receipt goes back to Pending and is not reviewed. Validation and summary are written over where the
    batch has them; items are replaced where it has any, so a repeated run that found none leaves them. No table's next
    state depends on another's but by the receipts' ids; only those ``asked`` for are made, as numbering writes at once."""
    job = F.coalesce(_named("job_id"), F.lit("UNKNOWN_JOB"))
    own = F.concat(job, F.lit("-"), F.substring(F.sha2(F.to_json(F.struct(*processed.columns)), 256), 1, 8))
    batch = processed.withColumns({"job_id": F.trim(job), "source_id": F.trim(F.coalesce(_named("source_id"), own))})
    same = Window.partitionBy("source_id").orderBy("seq").rangeBetween(Window.currentRow, Window.currentRow)
    tied = F.count("*").over(same) > 1  # texts decide only between rows of one seq
    batch = latest(batch.withColumn("_text", F.when(tied, F.to_json(F.struct(*processed.columns)))), "source_id", F.col("seq"), F.col("_text")).drop("_text", "seq")
    old = t["receipts"].select(F.col("source_id").alias("_s"), F.col("receipt_id").alias("_id"), F.col("created_at").alias("_c"))
    batch = batch.drop(*({c for cs in READ.values() for c in cs} - {c for name in asked for c in READ[name]}))
    known = materialize(batch.hint("merge").join(old, F.col("source_id") == F.col("_s"), "left").drop("_s"), "known")  # read twice, by new and old
    fresh = number_rows(known.filter("_id is null").drop("_id"), t["receipts"], "receipt_id", F.col("source_id"))
    again = known.filter("_id is not null").withColumnRenamed("_id", "receipt_id")
    # A batch may be as large as the tables; its file's size says little of its rows, so it is never broadcast.
    batch = materialize(again.unionByName(fresh), "processed").hint("merge")

    def receipts() -> DataFrame:
        money = lambda c: safe_float(F.col(c).cast("string"))
        header = batch.withColumns({
            "receipt_name": F.coalesce(_named("receipt_name"), _named("vendor"), "source_id"), "receipt_date": F.coalesce(_named("receipt_date"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")),
            "subtotal": money("subtotal"), "tax": money("tax"), "total": money("total"), "status": F.lit("Pending"), "confidence": confidence_100(F.col("confidence").cast("string")),
            "extraction_source": F.lit("ocr"), "ai_review_status": F.lit("not_requested"), "active_llm_run_id": F.lit(None).cast("long"), "ocr_json": F.coalesce("ocr_json", F.lit('{"rows": []}')),
            "predictionlog_json": F.coalesce("predictionlog_json", F.lit("{}")), "created_at": F.coalesce("_c", now), "updated_at": now})
        kept = t["receipts"].join(batch.select(F.col("receipt_id")), "receipt_id", "left_anti").select(*t["receipts"].columns)
        return kept.unionByName(header.select(*_typed(t["receipts"])))

    def validation() -> DataFrame:
        v = batch.filter("validation is not null").select("receipt_id", "validation.*").withColumn("outliers_count", F.coalesce(F.size("outliers"), F.lit(0))).drop("outliers")
        return upsert_child(t["validation"], v.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("name_quality_issues", "price_range_warnings")}), now, "validation_id")

    def summary() -> DataFrame:
        s = batch.filter("summary is not null").select("receipt_id", "summary.*", F.col("receipt_date").alias("_date"))
        return upsert_child(t["summary"], s.withColumn("receipt_date", F.coalesce(F.when(F.col("date") != "", F.col("date")), F.col("_date"))).drop("date", "_date"), now, "summary_id")

    def items() -> DataFrame:
        lines = _lines(batch.filter(F.size("items") > 0), least, default_currency)
        ids = t["items"].groupBy(F.col("receipt_id").alias("_r"), F.col("line_no").alias("_n")).agg(F.min("item_id").alias("_i"))
        lines = lines.withColumn("_k", F.row_number().over(Window.partitionBy("receipt_id", "line_no").orderBy("item_name", "unit_price")))
        lines = lines.hint("merge").join(ids, (F.col("receipt_id") == F.col("_r")) & (F.col("line_no") == F.col("_n")) & (F.col("_k") == 1), "left").drop("_r", "_n", "_k")
        new = number_rows(lines.filter("_i is null").drop("_i"), t["items"], "item_id", F.col("receipt_id"), F.col("line_no"), F.col("item_name"), F.col("unit_price"))
        lines = lines.filter("_i is not null").withColumnRenamed("_i", "item_id").unionByName(new)
        others = t["items"].join(batch.filter(F.size("items") > 0).select("receipt_id"), "receipt_id", "left_anti").select(*t["items"].columns)
        return others.unionByName(lines.select(*_typed(t["items"])))

    made = {"receipts": receipts, "validation": validation, "summary": summary, "items": items}
    return t | {name: made[name]() for name in asked}
