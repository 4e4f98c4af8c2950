"""The service's endpoints as functions from tables to the DataFrame of their payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard, review, validation, workflow

Tables = dict[str, DataFrame]


def get_summary(t: Tables, as_of: str) -> DataFrame:
    return dashboard.summary(t["receipts"], t["items"], as_of)


def get_validation_summary(t: Tables) -> DataFrame:
    return dashboard.validation_summary(t["receipts"], t["items"], t["validation"])


def get_monthly_trend(t: Tables, as_of: str) -> DataFrame:
    return dashboard.monthly_trend(t["receipts"], as_of)


def get_confidence_distribution(t: Tables) -> DataFrame:
    return dashboard.confidence_distribution(t["receipts"])


def get_activity(t: Tables) -> DataFrame:
    return dashboard.activity_feed(t["receipts"])


def list_receipts(t: Tables) -> DataFrame:
    return dashboard.receipts_list(t["receipts"])


def get_receipt(t: Tables, receipt_id: int) -> DataFrame:
    """One receipt with items, summary and validation; the filter reaches every scan but that of the runs'
    items, which are joined by the receipt's few run ids."""
    one = lambda df: df.filter(F.col("receipt_id") == receipt_id)
    if "summary" not in t:
        return workflow.receipt_detail(one(t["receipts"]), one(t["items"]), run_items=t.get("run_items"))
    runs = one(t["runs"])
    mine = t["run_items"].join(F.broadcast(runs.select("llm_run_id")), "llm_run_id", "left_semi")
    return review.detail({"receipts": one(t["receipts"]), "items": one(t["items"]), "summary": one(t["summary"]), "runs": runs, "run_items": mine}, one(t["validation"]) if "validation" in t else None)


def get_llm(t: Tables, receipt_id: int) -> DataFrame:
    """The newest model run of a receipt with its items in order; no row without a run."""
    newest = workflow.latest_runs(t["runs"].filter(F.col("receipt_id") == receipt_id))
    mine = t["run_items"].join(F.broadcast(newest.select("llm_run_id")), "llm_run_id", "left_semi")
    return review.run_with_items(newest, mine)


def get_validation(t: Tables, receipt_id: int) -> DataFrame:
    return t["validation"].filter(F.col("receipt_id") == receipt_id)


def get_run(t: Tables, llm_run_id: int) -> DataFrame:
    """A run with its items in order; no row if it is unknown."""
    one = lambda df: df.filter(F.col("llm_run_id") == llm_run_id)
    return review.run_with_items(one(t["runs"]), one(t["run_items"]))


def put_approve(t: Tables, edits: DataFrame, now: Column) -> Tables:
    """All tables that saving the review screen changes, and the refused edits."""
    return review.approve_edits(t, edits, now)


def put_status(t: Tables, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(receipts, refused requests)."""
    return review.set_status(t["receipts"], requests, now)


def post_reject(t: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receipts, refused requests)."""
    return workflow.reject_runs(t["receipts"], requests), workflow.reject_rejects(t["receipts"], requests)


def post_approve_run(t: Tables, requests: DataFrame, now: Column) -> Tables:
    return review.approve_runs(t, requests, now)


def post_reject_run(t: Tables, requests: DataFrame, now: Column) -> Tables:
    return review.reject_runs(t, requests, now)


def post_process(t: Tables) -> DataFrame:
    """Validation of every receipt of a batch."""
    return validation.validate_all(t["receipts"], t["items"])


def post_process_ocr(spark: SparkSession, path: str, first: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, results, summary) of the OCR documents under a path; a broken one is a result with an error."""
    from ..operators import intake
    from ..sources import ocr

    return intake.batch(ocr.scan_json(spark, path), first)


def post_auto_fix_staged(t: Tables, answers: DataFrame, now: Column, default_currency: str = "CAD") -> Tables:
    """Stage model answers (receipt_id, seq, response, ocr_text, has_image, ocr_confidence): the route is chosen
    from the OCR text, the answer is read, and the run waits for review. Answers without a JSON object are in
    ``rejects``."""
    from ..functions import llm_json, text

    route = text.llm_route(F.col("ocr_text"), F.col("has_image"), F.col("ocr_confidence"))
    got = answers.withColumns({"r": llm_json.receipt(F.col("response"), default_currency), "route_used": route})
    lines = F.transform("r.items", lambda x: F.struct(x["name"].alias("name"), F.lit(None).cast("double").alias("qty"), F.lit(None).cast("double").alias("unit_price"), x["price"].alias("price"), F.lit(None).cast("string").alias("currency"), x["confidence"].cast("string").alias("confidence")))
    read = got.filter("r is not null").select(
        "receipt_id", "seq", "route_used", F.lit(True).alias("set_active"), "r.vendor", "r.phone", "r.address", F.col("r.date").alias("receipt_date"), "r.subtotal", "r.tax", "r.total", "r.currency",
        "r.confidence", lines.alias("items"), F.to_json("r").alias("parsed_json"), F.col("response").alias("raw_llm_response"))
    out = review.stage_runs(t, read, now, default_currency)
    lost = got.filter("r is null").select("receipt_id", "seq", F.lit("no JSON object").alias("reason"))
    return out | {"rejects": out["rejects"].unionByName(lost)}


def post_auto_fix(answers: DataFrame, default_currency: str = "CAD") -> DataFrame:
    """Normal fields, arithmetic and status of model answers (receipt_id, response); answers without a
    JSON object have an error instead."""
    from ..functions import llm_json

    got = answers.withColumn("r", llm_json.receipt(F.col("response"), default_currency))
    head = got.filter("r is not null").select("receipt_id", "r.vendor", "r.subtotal", "r.tax", "r.total", "r.currency", "r.confidence", "r.items")
    money = lambda c: F.col(c).cast("decimal(18,2)")
    listed = head.select("receipt_id", F.explode_outer("items").alias("i")).select("receipt_id", money("i.price").alias("price"))
    math = validation.receipt_math(head.select("receipt_id", *(money(c).alias(c) for c in ("subtotal", "tax", "total"))), listed)
    good = head.join(math.select("receipt_id", "item_sum", "subtotal_ok", "total_ok", "validation_status"), "receipt_id").withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(got.filter("r is null").select("receipt_id", F.lit("no JSON object").alias("error")), allowMissingColumns=True)
