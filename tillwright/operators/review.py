"""The review workflow over all the tables that it changes.

Tables are a dict of DataFrames: ``receipts``, ``items``, ``summary``, ``runs``, ``run_items``. Each action
takes all requests of a batch and returns the changed tables under their names, and ``rejects``
(the request's key, reason) for requests that may not be carried out. Each table is read once and joined
with the requests; only new rows are numbered. A batch may name a receipt or a run more than once: the tables then
are what they would be after its requests one by one, in the order of ``seq`` where requests have it, else
in that of their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import confidence_100
from .workflow import STATUSES, latest, number_rows, runs_of_waiting

Tables = dict[str, DataFrame]
ROUTES = ("ocr_text", "vision_image")
REVIEW_STATES = ("not_requested", "pending", "approved", "rejected")
#: Header fields that a run, or the review screen, hands to its receipt.
HEADER = ("vendor", "receipt_date", "subtotal", "tax", "total")


def currency_3(*candidates: Column, default: str = "CAD") -> Column:
    """The first non-empty candidate, trimmed, upper, cut to three letters; CAD if it is shorter."""
    c = F.substring(F.upper(F.trim(F.coalesce(*(F.when(x != "", x) for x in candidates), F.lit(default)))), 1, 3)
    return F.when(F.length(c) == 3, c).otherwise("CAD")


def _review_state(c: str = "ai_review_status") -> Column:
    state = F.lower(F.trim(F.col(c)))
    return F.when(F.coalesce(state, F.lit("")) == "", "not_requested").otherwise(state)


def _set(df: DataFrame, hit: Column, values: dict[str, Column]) -> DataFrame:
    """``df`` with the values of the columns it has, where ``hit`` holds."""
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items() if c in df.columns})


def _conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` in its types; those that ``df`` lacks are null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in like.dtypes))


def _whole(df: DataFrame) -> Column:
    """A row's values as one text, which orders rows that nothing else tells apart."""
    return F.to_json(F.struct(*df.columns))


def _judged(requests: DataFrame, reason: Column, late: str, *first: Column) -> tuple[DataFrame, DataFrame]:
    """(requests that are carried out, all others with their ``reason``): of a receipt's requests without a reason
    the first by ``first`` is carried out, the others get the reason ``late``."""
    judged = requests.withColumn("reason", reason)
    nth = F.row_number().over(Window.partitionBy("receipt_id", F.col("reason").isNull()).orderBy(*first))
    judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (nth > 1), late).otherwise(F.col("reason")))
    return judged.filter("reason is null"), judged.filter("reason is not null")


def stage_runs(t: Tables, answers: DataFrame, now: Column, default_currency: str = "CAD") -> Tables:
    """Append parsed model answers (receipt_id, seq, route_used, set_active, HEADER, currency, confidence, items)
    as runs that wait for approval, with their items numbered in order; the newest staged run with set_active
    becomes its receipt's active one. Ids go on after the largest, by (receipt_id, seq), then the answer's values;
    rejects: bad_route (outside ROUTES), not_found (no such receipt)."""
    known = t["receipts"].select("receipt_id", F.lit(True).alias("_found"))
    fine = F.coalesce(F.col("route_used").isin(*ROUTES), F.lit(False))
    judged = answers.withColumn("_text", _whole(answers)).join(known, "receipt_id", "left").withColumn("reason", F.when(~fine, "bad_route").when(F.col("_found").isNull(), "not_found"))
    rejects = judged.filter("reason is not null").select("receipt_id", "seq", "reason")
    money = judged.filter("reason is null").drop("_found", "reason").withColumns({
        "currency": currency_3(F.col("currency"), default=default_currency), "confidence": confidence_100(F.col("confidence").cast("string")),
        "approval_status": F.lit("pending"), "updated_at": now, "created_at": now,
    })
    new = number_rows(money, t["runs"], "llm_run_id", F.col("receipt_id"), F.col("seq"), F.col("_text"))
    name = F.trim(F.coalesce(F.when(F.trim("i.name") != "", F.col("i.name")), F.lit("Unknown")))
    lines = new.select("llm_run_id", F.col("currency").alias("run_currency"), F.posexplode("items").alias("pos", "i")).select(
        "llm_run_id", (F.col("pos") + 1).alias("line_no"), name.alias("item_name"), F.col("i.qty").alias("qty"), F.col("i.unit_price").alias("unit_price"),
        F.col("i.price").alias("line_price"), currency_3(F.col("i.currency"), F.col("run_currency")).alias("currency"),
        confidence_100(F.col("i.confidence").cast("string")).alias("item_confidence"), now.alias("updated_at"), now.alias("created_at"),
    )
    lines = number_rows(lines, t["run_items"], "llm_item_id", F.col("llm_run_id"), F.col("line_no"))
    active = new.filter("set_active").groupBy(F.col("receipt_id").alias("_r")).agg(F.max("llm_run_id").alias("_run"))
    receipts = t["receipts"].join(active, F.col("receipt_id") == F.col("_r"), "left")
    receipts = _set(receipts, F.col("_run").isNotNull(), {"ai_review_status": F.lit("pending"), "active_llm_run_id": F.col("_run"), "updated_at": now})
    return {
        "receipts": receipts.select(*t["receipts"].columns), "runs": t["runs"].unionByName(_conform(new, t["runs"])),
        "run_items": t["run_items"].unionByName(_conform(lines, t["run_items"])), "rejects": rejects,
    }


def approve_runs(t: Tables, requests: DataFrame, now: Column) -> Tables:
    """Approve runs (llm_run_id, approved_by): the run's values go to the receipt where the run has them, its
    confidence always; its items replace the receipt's; the run is stamped. Of several runs of one receipt the
    last wins. A run that is approved already changes nothing; rejects: not_found, already_approved."""
    asked = requests.groupBy("llm_run_id").agg(F.max("approved_by").alias("_by"))
    known = asked.join(t["runs"], "llm_run_id", "left")
    reason = F.when(F.col("receipt_id").isNull(), "not_found").when(F.col("approval_status") == "approved", "already_approved")
    good = known.filter(reason.isNull())
    last = latest(good, "receipt_id", F.col("llm_run_id"))
    fields = [c for c in HEADER if c in t["runs"].columns and c in t["receipts"].columns]
    new = last.select(F.col("receipt_id").alias("_r"), F.col("llm_run_id").alias("_run"), confidence_100(F.col("confidence").cast("string")).alias("_confidence"), *(F.col(c).alias(f"_{c}") for c in fields))
    receipts = t["receipts"].join(new, F.col("receipt_id") == F.col("_r"), "left")
    values = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields} | {
        "confidence": F.col("_confidence"), "extraction_source": F.lit("ocr+llm"), "ai_review_status": F.lit("approved"), "active_llm_run_id": F.col("_run"), "updated_at": now,
    }
    receipts = _set(receipts, F.col("_run").isNotNull(), values).select(*t["receipts"].columns)
    lines = t["run_items"].join(last.select("llm_run_id", "receipt_id", F.col("currency").alias("run_currency")), "llm_run_id").select(
        "receipt_id", "line_no", "llm_item_id", "item_name", currency_3(F.col("currency"), F.col("run_currency")).alias("currency"), F.coalesce("line_price", F.lit(0)).alias("unit_price"),
        confidence_100(F.col("item_confidence").cast("string")).alias("confidence"), F.lit(0.0).alias("name_conf"), confidence_100(F.col("item_confidence").cast("string")).alias("price_conf"),
        F.lit(0).alias("is_outlier"), F.lit("OK").alias("item_status"), F.concat(F.lit("approved_from_llm_run:"), "llm_run_id").alias("status_reason"),
    )
    runs = t["runs"].join(good.select("llm_run_id", "_by"), "llm_run_id", "left").join(good.select("llm_run_id", F.lit(True).alias("_hit")), "llm_run_id", "left")
    runs = _set(runs, F.col("_hit").isNotNull(), {"approval_status": F.lit("approved"), "approved_by": F.col("_by"), "approved_at": now, "updated_at": now})
    return {
        "receipts": receipts, "items": _replace_items(t["items"], last.select("receipt_id"), lines, ("llm_item_id",)),
        "runs": runs.select(*t["runs"].columns), "rejects": known.filter(reason.isNotNull()).select("llm_run_id", reason.alias("reason")),
    }


def reject_runs(t: Tables, requests: DataFrame, now: Column) -> Tables:
    """Reject runs (llm_run_id, rejected_by): the run is stamped, its receipt's review state is rejected."""
    asked = requests.groupBy("llm_run_id").agg(F.max("rejected_by").alias("_by"), F.lit(True).alias("_hit"))
    known = asked.join(t["runs"].select("llm_run_id", "receipt_id"), "llm_run_id", "left")
    ids = known.filter("receipt_id is not null").select(F.col("receipt_id").alias("_r")).distinct()
    receipts = t["receipts"].join(ids, F.col("receipt_id") == F.col("_r"), "left")
    receipts = _set(receipts, F.col("_r").isNotNull(), {"ai_review_status": F.lit("rejected"), "updated_at": now})
    runs = t["runs"].join(asked, "llm_run_id", "left")
    runs = _set(runs, F.col("_hit").isNotNull(), {"approval_status": F.lit("rejected"), "approved_by": F.col("_by"), "approved_at": now, "updated_at": now})
    return {
        "receipts": receipts.select(*t["receipts"].columns), "runs": runs.select(*t["runs"].columns),
        "rejects": known.filter("receipt_id is null").select("llm_run_id", F.lit("not_found").alias("reason")),
    }


def _replace_items(items: DataFrame, receipts: DataFrame, lines: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Items without those of ``receipts``, and the lines with ids that go on after the largest."""
    kept = items.join(receipts.distinct(), "receipt_id", "left_anti").select(*items.columns)
    return kept.unionByName(_conform(number_rows(lines, items, "item_id", F.col("receipt_id"), F.col("line_no"), *(F.col(c) for c in order)), items))


def upsert_child(table: DataFrame, incoming: DataFrame, now: Column, id_name: str) -> DataFrame:
    """A table of one row per receipt with those of ``incoming`` written over (of several for a receipt the last by
    ``seq``, else by their values): a receipt's row keeps its id and creation time, new ones are numbered after the largest."""
    incoming = latest(incoming.withColumn("_text", _whole(incoming)), "receipt_id", *([F.col("seq")] if "seq" in incoming.columns else []), F.col("_text")).drop("_text")
    values = [c for c in table.columns if c not in (id_name, "receipt_id", "created_at")]
    new = incoming.select(F.col("receipt_id").alias("_r"), *(F.col(c).alias(f"_{c}") for c in values))
    joined = table.join(new.hint("merge"), F.col("receipt_id") == F.col("_r"), "left")
    old = _set(joined, F.col("_r").isNotNull(), {c: F.col(f"_{c}") for c in values}).select(*table.columns)
    fresh = incoming.join(table.select("receipt_id").hint("merge"), "receipt_id", "left_anti").withColumn("created_at", now)
    return old.unionByName(_conform(number_rows(fresh, table, id_name, F.col("receipt_id")), table))


def upsert_summary(summary: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """``upsert_child`` of the summaries."""
    return upsert_child(summary, incoming, now, "summary_id")


def _judge_edits(receipts: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    state = receipts.select("receipt_id", F.col("status").alias("_status"), _review_state().alias("_state"), F.lit(True).alias("_found"))
    amounts = [F.col(c).isNull() for c in ("subtotal", "tax", "total") if c in edits.columns]
    missing = F.greatest(*amounts) if len(amounts) > 1 else amounts[0] if amounts else F.lit(False)
    reason = (
        F.when(missing, "missing_amount").when(F.col("_found").isNull(), "not_found").when(F.col("_status") == "Processed", "read_only")
        .when(~F.col("_state").isin(*REVIEW_STATES), "bad_review_status")
    )
    order = [F.col("seq").asc_nulls_last()] if "seq" in edits.columns else []
    return _judged(edits.withColumn("_text", _whole(edits)).join(state, "receipt_id", "left"), reason, "read_only", *order, F.col("_text"))


def edit_rejects(receipts: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of the review screen that may not be saved: not_found, read_only, bad_review_status, missing_amount.
    The first edit that is saved makes its receipt read-only for the others."""
    return _judge_edits(receipts, edits)[1].select("receipt_id", "reason")


def approve_edits(t: Tables, edits: DataFrame, now: Column) -> Tables:
    """Save what the review screen shows (receipt_id, HEADER, summary_vendor, summary_phone, summary_address,
    summary_receipt_date, items): header values as they are, nulls too; items replaced; the summary written
    over; status Processed. Where a run waited, the review and the run are approved, by ``ui_user``. Of several
    edits of a receipt the first that may be saved is; rejects as in ``edit_rejects``."""
    good, rejected = _judge_edits(t["receipts"], edits)
    good, rejects = good.select(*edits.columns), rejected.select("receipt_id", "reason")
    new = good.select(F.col("receipt_id").alias("_r"), *(F.col(c).alias(f"_{c}") for c in HEADER))
    joined = t["receipts"].join(new, F.col("receipt_id") == F.col("_r"), "left")
    hit, waits = F.col("_r").isNotNull(), _review_state() == "pending"
    stamped = joined.filter(hit & waits & F.col("active_llm_run_id").isNotNull()).select(F.col("active_llm_run_id").alias("_run"))
    values = {c: F.col(f"_{c}") for c in HEADER if c in t["receipts"].columns} | {
        "extraction_source": F.when(waits, "ocr+llm").otherwise(F.col("extraction_source")), "ai_review_status": F.when(waits, "approved").otherwise(F.col("ai_review_status")),
        "status": F.lit("Processed"), "updated_at": now,
    }
    lines = good.select("receipt_id", F.explode("items").alias("i")).select(
        "receipt_id", F.col("i.line_no").alias("line_no"), F.trim(F.coalesce("i.item_name", F.lit(""))).alias("item_name"), currency_3(F.col("i.currency")).alias("currency"), F.col("i.unit_price").alias("unit_price"),
        F.col("i.confidence").alias("confidence"), F.lit(0.0).alias("name_conf"), F.col("i.confidence").alias("price_conf"), F.lit(0).alias("is_outlier"), F.lit("OK").alias("item_status"), F.lit("approved_from_ui_edit").alias("status_reason"),
    )
    amounts = [F.col(c) for c in ("subtotal", "tax", "total")]
    named = {c: F.col(f"summary_{c}") for c in ("vendor", "phone", "address", "receipt_date")}
    whole = F.to_json(F.struct(F.lit(True).alias("edited"), *(c.alias(n) for n, c in named.items()), *amounts), {"ignoreNullFields": "false"})
    summary = good.select("receipt_id", *amounts, *(c.alias(n) for n, c in named.items()), whole.alias("summary_json"))
    runs = t["runs"].join(stamped, F.col("llm_run_id") == F.col("_run"), "left")
    runs = _set(runs, F.col("_run").isNotNull(), {"approval_status": F.lit("approved"), "approved_by": F.lit("ui_user"), "approved_at": now, "updated_at": now})
    return {
        "receipts": _set(joined, hit, values).select(*t["receipts"].columns), "items": _replace_items(t["items"], good.select("receipt_id"), lines),
        "summary": upsert_summary(t["summary"], summary, now), "runs": runs.select(*t["runs"].columns), "rejects": rejects,
    }


def set_status(receipts: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(receipts with their new statuses, rejects (receipt_id, new_status, reason)): not_found, bad_review_status,
    bad_status, read_only, superseded. A Processed receipt may be set to Processed again. Of several requests
    for a receipt one to Processed stands, as it is final, else the last; the others are superseded."""
    state = receipts.select("receipt_id", F.col("status").alias("_status"), _review_state().alias("_state"), F.lit(True).alias("_found"))
    reason = (
        F.when(F.col("_found").isNull(), "not_found").when(~F.col("_state").isin(*REVIEW_STATES), "bad_review_status")
        .when(~F.coalesce(F.col("new_status").isin(*STATUSES), F.lit(False)), "bad_status").when((F.col("_status") == "Processed") & (F.col("new_status") != "Processed"), "read_only")
    )
    last = [F.col("seq").desc_nulls_last()] if "seq" in requests.columns else []
    good, rejected = _judged(requests.join(state, "receipt_id", "left"), reason, "superseded", (F.col("new_status") == "Processed").desc(), *last, F.col("new_status").desc())
    joined = receipts.join(good.select(F.col("receipt_id").alias("_r"), "new_status"), F.col("receipt_id") == F.col("_r"), "left")
    out = _set(joined, F.col("_r").isNotNull(), {"status": F.col("new_status"), "updated_at": now})
    return out.select(*receipts.columns), rejected.select("receipt_id", "new_status", "reason")


def run_with_items(runs: DataFrame, run_items: DataFrame) -> DataFrame:
    """Each run with its items in the order of (line_no, llm_item_id)."""
    rest = [c for c in run_items.columns if c not in ("llm_run_id", "line_no", "llm_item_id")]
    listed = run_items.groupBy("llm_run_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "llm_item_id", *rest))).alias("items"))
    out = runs.join(listed, "llm_run_id", "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast(out.schema["items"].dataType)))


def detail(t: Tables, validation: DataFrame | None = None) -> DataFrame:
    """Receipts with items, summary and validation. While a run waits for review, header, items and summary
    are the run's (data_source ``llm_staging``) and the validation is left out."""
    waiting = F.col("active_llm_run_id").isNotNull() & (_review_state() == "pending")
    own = t["items"].groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("line_no", F.col("item_id").alias("id"), "item_name", "currency", F.col("unit_price").cast("double").alias("unit_price"), F.col("confidence").cast("double").alias("confidence"), "item_status", "status_reason"))).alias("_own"))
    run = run_with_items(t["runs"], t["run_items"])
    staged = F.transform("items", lambda x: F.struct(
        x["line_no"].alias("line_no"), x["llm_item_id"].alias("id"), x["item_name"].alias("item_name"), x["currency"].alias("currency"), x["line_price"].cast("double").alias("unit_price"),
        x["item_confidence"].cast("double").alias("confidence"), F.lit("OK").alias("item_status"), F.concat(F.lit("llm_staging_run:"), F.col("llm_run_id")).alias("status_reason")))
    people = ("phone", "address")
    run = run.select(F.col("llm_run_id").alias("_run"), staged.alias("_staged"), *(F.col(c).alias(f"_{c}") for c in (*HEADER, *people, "confidence", "parsed_json")))
    facts = ("subtotal", "tax", "total", "vendor", *people, "receipt_date", "summary_json")
    summary = t["summary"].select("receipt_id", F.struct(*facts).alias("_summary"))
    out = t["receipts"].join(own, "receipt_id", "left").join(summary, "receipt_id", "left").join(runs_of_waiting(t["receipts"], waiting, run, "_run"), F.col("receipt_id") == F.col("__r"), "left")
    on = F.col("_run").isNotNull()
    kind = t["summary"].select(F.struct(*facts).alias("s")).schema["s"].dataType.simpleString()  # as text: all fields may be null
    from_run = F.struct(*(F.col("_parsed_json" if c == "summary_json" else f"_{c}").alias(c) for c in facts)).cast(kind)
    columns = {c: F.when(on, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in (*HEADER, "confidence")}
    columns["extraction_source"] = F.when(on, "ocr+llm").otherwise(F.col("extraction_source")).alias("extraction_source")
    if validation is not None:
        rest = [c for c in validation.columns if c != "receipt_id"]
        out = out.join(validation.select("receipt_id", F.struct(*rest).alias("_validation")), "receipt_id", "left")
    items = F.when(on, F.col("_staged")).otherwise(F.col("_own"))
    return out.select(
        *(columns.get(c, F.col(c)) for c in t["receipts"].columns), F.coalesce(items, F.array().cast(out.schema["_own"].dataType)).alias("items"),
        F.when(on, from_run).otherwise(F.col("_summary")).alias("summary"),
        *([F.when(~waiting, F.col("_validation")).alias("validation")] if validation is not None else []),
        F.when(waiting, "llm_staging").otherwise("main").alias("data_source"), waiting.alias("validation_skipped"),
    )


#: Columns of the receipts list.
LISTED = ("receipt_id", "job_id", "source_id", "receipt_name", "vendor", "receipt_date", "subtotal", "tax", "total", "status", "confidence", "extraction_source", "ai_review_status", "active_llm_run_id", "ocr_json", "predictionlog_json")


def receipts_list(receipts: DataFrame, limit: int = 200) -> DataFrame:
    """The newest receipts, all listed columns (null where the table lacks one), and where their data is from."""
    waiting = F.col("active_llm_run_id").isNotNull() & (_review_state() == "pending")
    newest = receipts.orderBy(F.col("receipt_id").desc()).limit(limit)
    return newest.select(*(F.col(c) if c in receipts.columns else F.lit(None).cast("string").alias(c) for c in LISTED), F.when(waiting, "llm").otherwise("main").alias("data_source"))


def items_by_source(items: DataFrame) -> DataFrame:
    """A map of the number of items by their source, for each receipt."""
    n = items.groupBy("receipt_id", "source").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("unknown")).alias("k"), "n")))
    return n.groupBy("receipt_id").agg(F.map_from_entries(pairs).alias("by_source"))


def detected(items: DataFrame) -> DataFrame:
    """Items that have a name: not the mark of a price without one."""
    return items.filter(F.coalesce(F.col("item_name"), F.lit("")) != "ITEM_NOT_DETECTED")


def items_by_flag(flagged: DataFrame, flag: str | None = None, clean: bool | None = None) -> DataFrame:
    """Items of one flag, or the clean ones, or all others."""
    if flag is not None:
        return flagged.filter(F.col("flag") == flag)
    return flagged.filter((F.col("flag") == "clean") == F.lit(bool(clean)))


def mean_confidence(lines: DataFrame) -> DataFrame:
    """Mean confidence of each receipt's recognised lines (0 without any) and their number."""
    return lines.groupBy("receipt_id").agg(F.coalesce(F.avg("conf"), F.lit(0.0)).alias("mean_conf"), F.count("*").alias("lines"))


#: Columns and types of the six tables.
SCHEMAS = {
    "receipts": "receipt_id long, job_id string, source_id string, receipt_name string, vendor string, receipt_date string, subtotal double, tax double, total double, status string, confidence double, extraction_source string, ai_review_status string, active_llm_run_id long, raw_json string, ocr_json string, predictionlog_json string, created_at timestamp, updated_at timestamp",
    "items": "item_id long, receipt_id long, line_no int, item_name string, currency string, unit_price double, confidence double, name_conf double, price_conf double, is_outlier int, item_status string, status_reason string",
    "validation": "validation_id long, receipt_id long, subtotal_status string, subtotal_discrepancy double, subtotal_discrepancy_pct double, outliers_count int, name_quality_issues int, price_range_warnings int, validation_json string, created_at timestamp",
    "summary": "summary_id long, receipt_id long, subtotal double, tax double, total double, vendor string, phone string, address string, receipt_date string, summary_json string, created_at timestamp",
    "runs": "llm_run_id long, receipt_id long, source_image_path string, raw_ocr_text string, llm_provider string, llm_model string, route_used string, prompt_version string, raw_llm_response string, parsed_json string, vendor string, phone string, address string, receipt_date string, subtotal double, tax double, total double, currency string, confidence double, validation_status string, approval_status string, approved_by string, approved_at timestamp, created_at timestamp, updated_at timestamp",
    "run_items": "llm_item_id long, llm_run_id long, line_no int, item_name string, qty double, unit_price double, line_price double, currency string, item_confidence double, created_at timestamp, updated_at timestamp",
}


def empty_tables(spark) -> Tables:
    """The six tables without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
