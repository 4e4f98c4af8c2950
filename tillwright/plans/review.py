"""Queries of the review workflow: one per table that an action changes, with SQL over the same tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import review, validation
from ..sources import adapters
from .queries import ITEMS, RECEIPTS, query

NOW = "2001-09-01 12:00:00"
MONEY = adapters.MONEY


def _k():
    return F.col("receipt_id")


def _now():
    return F.lit(NOW).cast("timestamp")


def _tables(spark, d, broadcast: bool = True) -> review.Tables:
    """The workflow's tables: a run for three in four receipts, each with the receipt's items."""
    r, i = adapters.receipts(spark, d, broadcast), adapters.items(spark, d, broadcast)
    money = lambda c: c.cast(MONEY)
    receipts = r.withColumns({"subtotal": money(F.col("total") - 1), "tax": money(F.lit(1)), "created_at": F.col("created_at").cast("timestamp"), "updated_at": F.col("updated_at").cast("timestamp")})
    items = i.select(
        (_k() * 100 + F.col("line_no")).alias("item_id"), "receipt_id", "line_no", "item_name", "currency", F.col("price").alias("unit_price"), F.col("confidence").cast("double").alias("confidence"),
        F.col("name_conf").cast("double").alias("name_conf"), F.col("price_conf").cast("double").alias("price_conf"), F.lit(0).alias("is_outlier"), F.lit("OK").alias("item_status"), F.lit(None).cast("string").alias("status_reason"))
    runs = r.filter(_k() % 4 < 3).select(
        (_k() * 10 + 1).alias("llm_run_id"), "receipt_id", F.when(_k() % 12 == 0, "model").alias("vendor"), F.lit("555").alias("phone"), F.lit(None).cast("string").alias("address"),
        F.when(_k() % 5 == 0, F.col("receipt_date")).alias("receipt_date"), money(F.lit(None)).alias("subtotal"), money(F.when(_k() % 7 == 0, F.lit(2))).alias("tax"), money(F.col("total") + 1).alias("total"),
        F.when(_k() % 5 == 0, " usd").when(_k() % 5 == 1, "eu").alias("currency"), (_k() % 101).cast("double").alias("confidence"), F.lit("{}").alias("parsed_json"),
        F.when(F.col("ai_review_status") == "approved", "approved").otherwise("pending").alias("approval_status"), F.lit(None).cast("string").alias("approved_by"),
        F.lit(None).cast("timestamp").alias("approved_at"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    run_items = i.filter(_k() % 4 < 3).select(
        ((_k() * 10 + 1) * 100 + F.col("line_no")).alias("llm_item_id"), (_k() * 10 + 1).alias("llm_run_id"), "line_no", F.upper("item_name").alias("item_name"), F.col("qty").cast("double").alias("qty"),
        money(F.lit(None)).alias("unit_price"), F.when(F.col("line_no") % 5 != 0, F.col("price")).alias("line_price"), F.when(F.col("line_no") % 2 == 0, "gbp").alias("currency"), F.col("confidence").cast("double").alias("item_confidence"))
    summary = r.filter(_k() % 3 == 0).select((_k() + 7).alias("summary_id"), "receipt_id", money(F.col("total") - 1).alias("subtotal"), money(F.lit(1)).alias("tax"), "total", "vendor", F.lit("111").alias("phone"), F.lit("street").alias("address"), F.col("receipt_date").cast("string").alias("receipt_date"), F.lit("{}").alias("summary_json"), F.col("created_at").cast("timestamp").alias("created_at"))
    return {"receipts": receipts, "items": items, "runs": runs, "run_items": run_items, "summary": summary}


_CONF = "CASE WHEN {0} IS NULL THEN 0 WHEN {0} <= 1 THEN greatest(0, least(100, {0} * 100)) ELSE least(100, {0}) END"
_BASE = f"""WITH {RECEIPTS}, {ITEMS}, rc AS (SELECT *, (total - 1)::DECIMAL(18,2) AS subtotal, 1::DECIMAL(18,2) AS tax FROM receipts),
it AS (SELECT receipt_id * 100 + line_no AS item_id, receipt_id, line_no, item_name, currency, price AS unit_price, confidence::DOUBLE AS confidence, 'OK' AS item_status, NULL::VARCHAR AS status_reason FROM items),
ru AS (SELECT receipt_id * 10 + 1 AS llm_run_id, receipt_id, CASE WHEN receipt_id % 12 = 0 THEN 'model' END AS vendor, CASE WHEN receipt_id % 5 = 0 THEN receipt_date END AS receipt_date, CASE WHEN receipt_id % 7 = 0 THEN 2::DECIMAL(18,2) END AS tax,
  (total + 1)::DECIMAL(18,2) AS total, CASE WHEN receipt_id % 5 = 0 THEN 'USD' WHEN receipt_id % 5 IN (1) THEN 'CAD' END AS cur, (receipt_id % 101)::DOUBLE AS confidence, CASE WHEN ai_review_status = 'approved' THEN 'approved' ELSE 'pending' END AS approval_status FROM receipts WHERE receipt_id % 4 < 3),
ri AS (SELECT (receipt_id * 10 + 1) * 100 + line_no AS llm_item_id, receipt_id, receipt_id * 10 + 1 AS llm_run_id, line_no, upper(item_name) AS item_name, qty::DOUBLE AS qty, CASE WHEN line_no % 5 <> 0 THEN price END AS line_price, CASE WHEN line_no % 2 = 0 THEN 'GBP' END AS cur, confidence::DOUBLE AS item_confidence FROM items WHERE receipt_id % 4 < 3)"""


# staging

def _stage(spark, d) -> review.Tables:
    t = _tables(spark, d)
    item = lambda n, p, c: F.struct(F.lit(n).alias("name"), F.lit(2.0).alias("qty"), F.lit(None).cast(MONEY).alias("unit_price"), p.cast(MONEY).alias("price"), F.lit(c).cast("string").alias("currency"), F.lit("0.5").alias("confidence"))
    answers = t["receipts"].filter(_k() % 6 == 0).select(
        "receipt_id", (_k() * 3).alias("seq"), F.when(_k() % 18 == 0, "other").when(_k() % 12 == 0, "ocr_text").otherwise("vision_image").alias("route_used"), (_k() % 5 != 0).alias("set_active"),
        F.lit("staged").alias("vendor"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("address"), "receipt_date", "subtotal", "tax", "total", F.lit("").alias("currency"), (F.lit(0.25) + _k() % 2).alias("confidence"),
        F.array(item("TEA", F.col("total"), "usd"), item("  ", F.lit(1), None)).alias("items"))
    return review.stage_runs(t, answers, _now(), "EUR")


_STAGED = _BASE + """, an AS (SELECT receipt_id, total, row_number() OVER (ORDER BY receipt_id) AS k FROM rc WHERE receipt_id % 6 = 0 AND receipt_id % 18 <> 0),
nr AS (SELECT (SELECT max(llm_run_id) FROM ru) + k AS llm_run_id, receipt_id, total, k FROM an)"""


@query(_STAGED + " SELECT llm_run_id, receipt_id, 'staged' AS vendor, total, 'EUR' AS currency, 25.0::DOUBLE AS confidence, 'pending' AS approval_status FROM nr UNION ALL SELECT llm_run_id, receipt_id, vendor, total, CASE WHEN receipt_id % 5 = 0 THEN ' usd' WHEN receipt_id % 5 = 1 THEN 'eu' END, confidence, approval_status FROM ru")
def stage_runs(spark, d):
    return _stage(spark, d)["runs"].select("llm_run_id", "receipt_id", "vendor", "total", "currency", "confidence", "approval_status")


@query(_STAGED + """ SELECT (SELECT max(llm_item_id) FROM ri) + row_number() OVER (ORDER BY llm_run_id, line_no) AS llm_item_id, llm_run_id, line_no, item_name, line_price, currency, 50.0::DOUBLE AS item_confidence FROM (
SELECT llm_run_id, 1 AS line_no, 'TEA' AS item_name, total AS line_price, 'USD' AS currency FROM nr UNION ALL SELECT llm_run_id, 2, 'Unknown', 1::DECIMAL(18,2), 'EUR' FROM nr)
UNION ALL SELECT llm_item_id, llm_run_id, line_no, item_name, line_price, CASE WHEN line_no % 2 = 0 THEN 'gbp' END, item_confidence FROM ri""")
def stage_run_items(spark, d):
    return _stage(spark, d)["run_items"].select("llm_item_id", "llm_run_id", "line_no", "item_name", "line_price", "currency", "item_confidence")


@query(_STAGED + " SELECT r.receipt_id, CASE WHEN n.receipt_id IS NOT NULL THEN 'pending' ELSE ai_review_status END AS ai_review_status, coalesce(n.llm_run_id, active_llm_run_id) AS active_llm_run_id FROM rc r LEFT JOIN (SELECT * FROM nr WHERE receipt_id % 5 <> 0) n USING (receipt_id)")
def stage_receipts(spark, d):
    return _stage(spark, d)["receipts"].select("receipt_id", "ai_review_status", "active_llm_run_id")


@query(_STAGED + " SELECT receipt_id, receipt_id * 3 AS seq, 'bad_route' AS reason FROM rc WHERE receipt_id % 18 = 0")
def stage_rejects(spark, d):
    return _stage(spark, d)["rejects"]


# approval and rejection of runs

def _approve(spark, d) -> review.Tables:
    t = _tables(spark, d)
    asked = t["receipts"].filter(_k() % 3 == 0).select((_k() * 10 + 1).alias("llm_run_id"), F.lit("me").alias("approved_by"))
    return review.approve_runs(t, asked, _now())


_APPROVED = _BASE + ", ok AS (SELECT * FROM ru WHERE receipt_id % 3 = 0 AND approval_status <> 'approved')"


@query(_APPROVED + f""" SELECT r.receipt_id, coalesce(o.vendor, r.vendor) AS vendor, coalesce(o.receipt_date, r.receipt_date) AS receipt_date, r.subtotal, coalesce(o.tax, r.tax) AS tax, coalesce(o.total, r.total) AS total,
CASE WHEN o.receipt_id IS NULL THEN r.confidence ELSE ({_CONF.format('o.confidence')})::INT END AS confidence, CASE WHEN o.receipt_id IS NULL THEN extraction_source ELSE 'ocr+llm' END AS extraction_source,
CASE WHEN o.receipt_id IS NULL THEN ai_review_status ELSE 'approved' END AS ai_review_status, coalesce(o.llm_run_id, active_llm_run_id) AS active_llm_run_id FROM rc r LEFT JOIN ok o USING (receipt_id)""")
def approve_receipts(spark, d):
    return _approve(spark, d)["receipts"].select("receipt_id", "vendor", "receipt_date", "subtotal", "tax", "total", "confidence", "extraction_source", "ai_review_status", "active_llm_run_id")


@query(_APPROVED + f""" SELECT item_id, receipt_id, line_no, item_name, currency, unit_price, confidence, status_reason FROM it WHERE receipt_id NOT IN (SELECT receipt_id FROM ok) UNION ALL
SELECT (SELECT max(item_id) FROM it) + row_number() OVER (ORDER BY i.receipt_id, i.line_no), i.receipt_id, i.line_no, i.item_name, coalesce(i.cur, o.cur, 'CAD'), coalesce(line_price, 0)::DECIMAL(18,2), {_CONF.format('item_confidence')}, 'approved_from_llm_run:' || i.llm_run_id FROM ri i JOIN ok o ON o.llm_run_id = i.llm_run_id""")
def approve_items(spark, d):
    return _approve(spark, d)["items"].select("item_id", "receipt_id", "line_no", "item_name", "currency", "unit_price", "confidence", "status_reason")


@query(_APPROVED + f" SELECT llm_run_id, CASE WHEN llm_run_id IN (SELECT llm_run_id FROM ok) THEN 'approved' ELSE approval_status END AS approval_status, CASE WHEN llm_run_id IN (SELECT llm_run_id FROM ok) THEN 'me' END AS approved_by, CASE WHEN llm_run_id IN (SELECT llm_run_id FROM ok) THEN '{NOW}' END AS approved_at FROM ru")
def approve_run_stamps(spark, d):
    return _approve(spark, d)["runs"].select("llm_run_id", "approval_status", "approved_by", F.date_format("approved_at", "yyyy-MM-dd HH:mm:ss").alias("approved_at"))


@query(_BASE + " SELECT receipt_id * 10 + 1 AS llm_run_id, CASE WHEN receipt_id % 4 = 3 THEN 'not_found' ELSE 'already_approved' END AS reason FROM rc WHERE receipt_id % 3 = 0 AND (receipt_id % 4 = 3 OR ai_review_status = 'approved')")
def approve_rejects(spark, d):
    return _approve(spark, d)["rejects"]


def _reject(spark, d) -> review.Tables:
    t = _tables(spark, d)
    return review.reject_runs(t, t["receipts"].filter(_k() % 3 == 1).select((_k() * 10 + 1).alias("llm_run_id"), F.lit("you").alias("rejected_by")), _now())


@query(_BASE + " SELECT receipt_id, CASE WHEN receipt_id % 3 = 1 AND receipt_id % 4 < 3 THEN 'rejected' ELSE ai_review_status END AS ai_review_status FROM rc")
def reject_receipts(spark, d):
    return _reject(spark, d)["receipts"].select("receipt_id", "ai_review_status")


@query(_BASE + " SELECT llm_run_id, CASE WHEN receipt_id % 3 = 1 THEN 'rejected' ELSE approval_status END AS approval_status, CASE WHEN receipt_id % 3 = 1 THEN 'you' END AS approved_by FROM ru")
def reject_run_stamps(spark, d):
    return _reject(spark, d)["runs"].select("llm_run_id", "approval_status", "approved_by")


@query(_BASE + " SELECT receipt_id * 10 + 1 AS llm_run_id, 'not_found' AS reason FROM rc WHERE receipt_id % 3 = 1 AND receipt_id % 4 = 3")
def reject_run_rejects(spark, d):
    return _reject(spark, d)["rejects"]


# the review screen

def _edit(spark, d) -> review.Tables:
    t = _tables(spark, d)
    item = lambda n, name: F.struct(F.lit(n).alias("line_no"), F.lit(name).alias("item_name"), F.lit("usd ").alias("currency"), (F.col("total") / n).cast(MONEY).alias("unit_price"), F.lit(80.0).alias("confidence"))
    edits = t["receipts"].filter(_k() % 5 == 0).select(
        "receipt_id", F.when(_k() % 10 == 0, "edited").alias("vendor"), "receipt_date", "subtotal", F.when(_k() % 15 != 0, F.col("tax")).alias("tax"), (F.col("total") + 2).cast(MONEY).alias("total"),
        F.lit("shop").alias("summary_vendor"), F.lit("222").alias("summary_phone"), F.lit(None).cast("string").alias("summary_address"), F.col("receipt_date").cast("string").alias("summary_receipt_date"), F.array(item(1, " a "), item(2, None)).alias("items"))
    gone = spark.createDataFrame([(-1, Decimal(1), Decimal(1), Decimal(1))], f"receipt_id long, subtotal {MONEY}, tax {MONEY}, total {MONEY}")
    return review.approve_edits(t, edits.unionByName(gone, allowMissingColumns=True), _now())


_EDITED = _BASE + ", ed AS (SELECT * FROM rc WHERE receipt_id % 5 = 0 AND receipt_id % 15 <> 0 AND status <> 'Processed')"


@query(_EDITED + """ SELECT r.receipt_id, CASE WHEN e.receipt_id IS NULL THEN r.vendor WHEN r.receipt_id % 10 = 0 THEN 'edited' END AS vendor, CASE WHEN e.receipt_id IS NULL THEN r.total ELSE (r.total + 2)::DECIMAL(18,2) END AS total, CASE WHEN e.receipt_id IS NULL THEN r.status ELSE 'Processed' END AS status,
CASE WHEN e.receipt_id IS NOT NULL AND r.ai_review_status = 'pending' THEN 'approved' ELSE r.ai_review_status END AS ai_review_status, CASE WHEN e.receipt_id IS NOT NULL AND r.ai_review_status = 'pending' THEN 'ocr+llm' ELSE r.extraction_source END AS extraction_source FROM rc r LEFT JOIN ed e USING (receipt_id)""")
def edit_receipts(spark, d):
    return _edit(spark, d)["receipts"].select("receipt_id", "vendor", "total", "status", "ai_review_status", "extraction_source")


@query(_EDITED + """ SELECT item_id, receipt_id, line_no, item_name, currency, unit_price, status_reason FROM it WHERE receipt_id NOT IN (SELECT receipt_id FROM ed) UNION ALL
SELECT (SELECT max(item_id) FROM it) + row_number() OVER (ORDER BY receipt_id, n), receipt_id, n::INT, CASE WHEN n = 1 THEN 'a' ELSE '' END, 'USD', CASE WHEN n = 1 THEN (total)::DECIMAL(18,2) ELSE ((total * 100 + 1)::BIGINT // 2 / 100.0)::DECIMAL(18,2) END, 'approved_from_ui_edit' FROM ed, range(1, 3) t(n)""")
def edit_items(spark, d):
    return _edit(spark, d)["items"].select("item_id", "receipt_id", "line_no", "item_name", "currency", "unit_price", "status_reason")


@query(_EDITED + """, sm AS (SELECT receipt_id + 7 AS summary_id, receipt_id, total, vendor, '111' AS phone, 'street' AS address FROM rc WHERE receipt_id % 3 = 0), fr AS (SELECT receipt_id, total, row_number() OVER (ORDER BY receipt_id) AS k FROM ed WHERE receipt_id % 3 <> 0)
SELECT s.summary_id, s.receipt_id, CASE WHEN e.receipt_id IS NULL THEN s.total ELSE (e.total + 2)::DECIMAL(18,2) END AS total, CASE WHEN e.receipt_id IS NULL THEN s.vendor ELSE 'shop' END AS vendor, CASE WHEN e.receipt_id IS NULL THEN s.phone ELSE '222' END AS phone, CASE WHEN e.receipt_id IS NULL THEN s.address END AS address FROM sm s LEFT JOIN ed e USING (receipt_id)
UNION ALL SELECT (SELECT max(summary_id) FROM sm) + k, receipt_id, (total + 2)::DECIMAL(18,2), 'shop', '222', NULL FROM fr""")
def edit_summary(spark, d):
    return _edit(spark, d)["summary"].select("summary_id", "receipt_id", "total", "vendor", "phone", "address")


@query(_EDITED + " SELECT llm_run_id, CASE WHEN p THEN 'approved' ELSE approval_status END AS approval_status, CASE WHEN p THEN 'ui_user' END AS approved_by FROM (SELECT ru.*, ru.receipt_id IN (SELECT receipt_id FROM ed WHERE ai_review_status = 'pending') AS p FROM ru)")
def edit_run_stamps(spark, d):
    return _edit(spark, d)["runs"].select("llm_run_id", "approval_status", "approved_by")


@query(_BASE + " SELECT receipt_id, CASE WHEN receipt_id % 15 = 0 THEN 'missing_amount' ELSE 'read_only' END AS reason FROM rc WHERE receipt_id % 5 = 0 AND (receipt_id % 15 = 0 OR status = 'Processed') UNION ALL SELECT -1, 'not_found'")
def edit_rejects(spark, d):
    return _edit(spark, d)["rejects"]


def _statuses(spark, d) -> tuple[DataFrame, DataFrame]:
    r = _tables(spark, d)["receipts"]
    asked = r.filter(_k() % 7 < 3).select("receipt_id", F.when(_k() % 7 == 0, "Processed").when(_k() % 7 == 1, "Error").otherwise("Nonsense").alias("new_status"))
    return review.set_status(r, asked, _now())


@query(_BASE + f" SELECT receipt_id, CASE WHEN g THEN n ELSE status END AS status, CASE WHEN g THEN '{NOW}' ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at FROM (SELECT *, CASE receipt_id % 7 WHEN 0 THEN 'Processed' WHEN 1 THEN 'Error' END AS n, receipt_id % 7 = 0 OR (receipt_id % 7 = 1 AND status <> 'Processed') AS g FROM rc)")
def set_statuses(spark, d):
    return _statuses(spark, d)[0].select("receipt_id", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query(_BASE + " SELECT receipt_id, CASE receipt_id % 7 WHEN 1 THEN 'Error' ELSE 'Nonsense' END AS new_status, CASE receipt_id % 7 WHEN 1 THEN 'read_only' ELSE 'bad_status' END AS reason FROM rc WHERE receipt_id % 7 = 2 OR (receipt_id % 7 = 1 AND status = 'Processed')")
def set_status_rejects(spark, d):
    return _statuses(spark, d)[1]


# batches that name a receipt more than once

def _repeated_edits(spark, d) -> review.Tables:
    """Two edits of every fifth receipt, the first of every fifteenth without its tax, and two of a receipt that isn't there."""
    t = _tables(spark, d)
    item = F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("edit "), F.col("seq").cast("string")).alias("item_name"), F.lit("usd").alias("currency"), F.col("total").cast(MONEY).alias("unit_price"), F.lit(80.0).alias("confidence"))
    edits = t["receipts"].filter(_k() % 5 == 0).withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "receipt_id", "seq", F.concat(F.lit("shop "), F.col("seq").cast("string")).alias("vendor"), "receipt_date", "subtotal", F.when((_k() % 15 != 0) | (F.col("seq") == 2), F.col("tax")).alias("tax"), F.col("total").cast(MONEY).alias("total"),
        F.concat(F.lit("shop "), F.col("seq").cast("string")).alias("summary_vendor"), F.lit("222").alias("summary_phone"), F.lit(None).cast("string").alias("summary_address"), F.lit(None).cast("string").alias("summary_receipt_date"), F.array(item).alias("items"))
    gone = spark.createDataFrame([(-1, n, Decimal(1), Decimal(1), Decimal(1)) for n in (1, 2)], f"receipt_id long, seq int, subtotal {MONEY}, tax {MONEY}, total {MONEY}")
    return review.approve_edits(t, edits.unionByName(gone, allowMissingColumns=True), _now())


_TWICE = _BASE + ", tw AS (SELECT *, CASE WHEN receipt_id % 15 = 0 THEN 'shop 2' ELSE 'shop 1' END AS shop, CASE WHEN receipt_id % 15 = 0 THEN 'edit 2' ELSE 'edit 1' END AS line FROM rc WHERE receipt_id % 5 = 0 AND status <> 'Processed')"


@query(_TWICE + " SELECT r.receipt_id, coalesce(t.shop, r.vendor) AS vendor, CASE WHEN t.receipt_id IS NULL THEN r.status ELSE 'Processed' END AS status FROM rc r LEFT JOIN tw t USING (receipt_id)")
def repeated_edit_receipts(spark, d):
    return _repeated_edits(spark, d)["receipts"].select("receipt_id", "vendor", "status")


@query(_TWICE + " SELECT item_id, receipt_id, line_no, item_name FROM it WHERE receipt_id NOT IN (SELECT receipt_id FROM tw) UNION ALL SELECT (SELECT max(item_id) FROM it) + row_number() OVER (ORDER BY receipt_id), receipt_id, 1, line FROM tw")
def repeated_edit_items(spark, d):
    return _repeated_edits(spark, d)["items"].select("item_id", "receipt_id", "line_no", "item_name")


@query(_TWICE + """, sm AS (SELECT receipt_id + 7 AS summary_id, receipt_id, vendor FROM rc WHERE receipt_id % 3 = 0), fr AS (SELECT receipt_id, shop, row_number() OVER (ORDER BY receipt_id) AS k FROM tw WHERE receipt_id % 3 <> 0)
SELECT s.summary_id, s.receipt_id, coalesce(t.shop, s.vendor) AS vendor FROM sm s LEFT JOIN tw t USING (receipt_id) UNION ALL SELECT (SELECT max(summary_id) FROM sm) + k, receipt_id, shop FROM fr""")
def repeated_edit_summary(spark, d):
    return _repeated_edits(spark, d)["summary"].select("summary_id", "receipt_id", "vendor")


@query(_TWICE + """ SELECT receipt_id, CASE WHEN receipt_id % 15 = 0 AND n = 1 THEN 'missing_amount' ELSE 'read_only' END AS reason FROM rc, range(1, 3) t(n)
WHERE receipt_id % 5 = 0 AND (status = 'Processed' OR n = CASE WHEN receipt_id % 15 = 0 THEN 1 ELSE 2 END) UNION ALL SELECT -1, 'not_found' FROM range(2)""")
def repeated_edit_rejects(spark, d):
    return _repeated_edits(spark, d)["rejects"]


def _repeated_statuses(spark, d) -> tuple[DataFrame, DataFrame]:
    """Three requests for three receipts in seven: Error, then Failed, then Processed, Nonsense or Pending."""
    third = F.when(_k() % 7 == 0, "Processed").when(_k() % 7 == 1, "Nonsense").otherwise("Pending")
    asked = _tables(spark, d)["receipts"].filter(_k() % 7 < 3).select("receipt_id", F.posexplode(F.array(F.lit("Error"), F.lit("Failed"), third)).alias("seq", "new_status"))
    return review.set_status(_tables(spark, d)["receipts"], asked, _now())


@query(_BASE + " SELECT receipt_id, CASE WHEN receipt_id % 7 = 0 THEN 'Processed' WHEN receipt_id % 7 < 3 AND status <> 'Processed' THEN CASE receipt_id % 7 WHEN 1 THEN 'Failed' ELSE 'Pending' END ELSE status END AS status FROM rc")
def repeated_statuses(spark, d):
    return _repeated_statuses(spark, d)[0].select("receipt_id", "status")


@query(_BASE + """, q AS (SELECT receipt_id, status = 'Processed' AS final, n, CASE n WHEN 0 THEN 'Error' WHEN 1 THEN 'Failed' ELSE CASE receipt_id % 7 WHEN 0 THEN 'Processed' WHEN 1 THEN 'Nonsense' ELSE 'Pending' END END AS new_status FROM rc, range(3) t(n) WHERE receipt_id % 7 < 3)
SELECT receipt_id, new_status, CASE WHEN new_status = 'Nonsense' THEN 'bad_status' WHEN final THEN 'read_only' ELSE 'superseded' END AS reason FROM q
WHERE new_status <> 'Processed' AND (final OR new_status = 'Nonsense' OR n < CASE WHEN receipt_id % 7 = 1 THEN 1 ELSE 2 END)""")
def repeated_status_rejects(spark, d):
    return _repeated_statuses(spark, d)[1]


# look-ups

@query(_BASE + " SELECT ru.llm_run_id, any_value(ru.approval_status) AS approval_status, coalesce(string_agg(ri.line_no || ':' || ri.item_name, ';' ORDER BY ri.line_no, ri.llm_item_id), '') AS items FROM ru LEFT JOIN ri ON ri.llm_run_id = ru.llm_run_id GROUP BY 1")
def run_with_items(spark, d):
    t = _tables(spark, d)
    show = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["item_name"])), ";")
    return review.run_with_items(t["runs"], t["run_items"]).select("llm_run_id", "approval_status", show.alias("items"))


@query(_BASE + """, w AS (SELECT r.*, ai_review_status = 'pending' AND active_llm_run_id IS NOT NULL AS p FROM rc r), li AS (SELECT receipt_id, string_agg(line_no || ':' || item_name || ':' || coalesce(unit_price::VARCHAR, '-') || ':' || coalesce(status_reason, '-'), ';' ORDER BY line_no, item_id) AS s FROM it GROUP BY 1),
ls AS (SELECT receipt_id, string_agg(line_no || ':' || item_name || ':' || coalesce(line_price::VARCHAR, '-') || ':llm_staging_run:' || llm_run_id, ';' ORDER BY line_no, llm_item_id) AS s FROM ri GROUP BY 1)
SELECT w.receipt_id, CASE WHEN p THEN ru.vendor ELSE w.vendor END AS vendor, CASE WHEN p THEN ru.total ELSE w.total END AS total, CASE WHEN p THEN ru.confidence ELSE w.confidence END::DOUBLE AS confidence, CASE WHEN p THEN 'ocr+llm' ELSE w.extraction_source END AS extraction_source,
coalesce(CASE WHEN p THEN ls.s ELSE li.s END, '') AS items, CASE WHEN p THEN '555' WHEN w.receipt_id % 3 = 0 THEN '111' END AS summary_phone, CASE WHEN p THEN NULL WHEN w.receipt_id % 2 = 0 THEN 'PASS' END AS validation, CASE WHEN p THEN 'llm_staging' ELSE 'main' END AS data_source, p AS validation_skipped
FROM w LEFT JOIN ru USING (receipt_id) LEFT JOIN li USING (receipt_id) LEFT JOIN ls USING (receipt_id)""")
def receipt_detail_full(spark, d):
    t = _tables(spark, d)
    checks = t["receipts"].filter(_k() % 2 == 0).select("receipt_id", F.lit("PASS").alias("subtotal_status"))
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    show = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["item_name"], dash(x["unit_price"].cast(MONEY)), dash(x["status_reason"]))), ";")
    return review.detail(t, checks).select("receipt_id", "vendor", "total", F.col("confidence").cast("double").alias("confidence"), "extraction_source", show.alias("items"), F.col("summary.phone").alias("summary_phone"), F.col("validation.subtotal_status").alias("validation"), "data_source", "validation_skipped")


@query(_BASE + """ SELECT receipt_id, job_id, source_id, NULL::VARCHAR AS receipt_name, vendor, receipt_date, subtotal, tax, total, status, confidence, extraction_source, ai_review_status, active_llm_run_id, NULL::VARCHAR AS ocr_json, NULL::VARCHAR AS predictionlog_json,
CASE WHEN active_llm_run_id IS NOT NULL AND ai_review_status = 'pending' THEN 'llm' ELSE 'main' END AS data_source FROM rc ORDER BY receipt_id DESC LIMIT 200""")
def receipts_list_full(spark, d):
    return review.receipts_list(_tables(spark, d)["receipts"])


@query(f"WITH {ITEMS} SELECT receipt_id, string_agg(s || '=' || n, ',' ORDER BY s) AS by_source FROM (SELECT receipt_id, CASE qty % 3 WHEN 0 THEN 'rows' WHEN 1 THEN 'blocks' ELSE 'unknown' END AS s, count(*) AS n FROM items GROUP BY 1, 2) GROUP BY 1")
def items_by_source(spark, d):
    i = adapters.items(spark, d).withColumn("source", F.when(F.col("qty") % 3 == 0, "rows").when(F.col("qty") % 3 == 1, "blocks"))
    show = F.array_join(F.transform(F.array_sort(F.map_entries("by_source")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return review.items_by_source(i).select("receipt_id", show.alias("by_source"))


@query(f"WITH {ITEMS} SELECT receipt_id, line_no FROM items WHERE part_id % 9 <> 0")
def detected_items(spark, d):
    i = adapters.items(spark, d).withColumn("item_name", F.when(F.col("part_id") % 9 == 0, "ITEM_NOT_DETECTED").otherwise(F.col("item_name")))
    return review.detected(i).select("receipt_id", "line_no")


@query(f"""WITH {ITEMS}, f AS (SELECT i.receipt_id, i.line_no, CASE WHEN i.part_id % 13 = 0 THEN 'missing_price' WHEN EXISTS (SELECT 1 FROM items s WHERE s.receipt_id = i.receipt_id AND s.item_name = i.item_name AND (s.part_id + s.receipt_id) % 40 = 7) THEN 'price_outlier' ELSE 'clean' END AS flag FROM items i)
SELECT 'clean' AS part, receipt_id, line_no FROM f WHERE flag = 'clean' UNION ALL SELECT 'flagged', receipt_id, line_no FROM f WHERE flag <> 'clean' UNION ALL SELECT 'missing_price', receipt_id, line_no FROM f WHERE flag = 'missing_price'""")
def items_by_flag(spark, d):
    i = adapters.items(spark, d)
    flagged = validation.item_flags(i.withColumn("price", F.when(F.col("part_id") % 13 != 0, F.col("price"))), i.filter("(part_id + receipt_id) % 40 = 7").select("receipt_id", "item_name"))
    parts = {"clean": review.items_by_flag(flagged, clean=True), "flagged": review.items_by_flag(flagged, clean=False), "missing_price": review.items_by_flag(flagged, "missing_price")}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("part"), "receipt_id", "line_no")
        out = df if out is None else out.unionByName(df)
    return out


@query(f"WITH {ITEMS} SELECT receipt_id, round(avg(confidence), 4) AS mean_conf, count(*) AS lines FROM items GROUP BY 1")
def ocr_mean_confidence(spark, d):
    out = review.mean_confidence(adapters.items(spark, d).select("receipt_id", F.col("confidence").cast("double").alias("conf")))
    return out.select("receipt_id", F.round("mean_conf", 4).alias("mean_conf"), "lines")
