"""Registered queries over the driver's tables, each with equivalent DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money, report, text
from ..operators import dashboard, tables, validation, workflow
from ..sources import adapters

AS_OF = "2001-08-01"
#: Bounds that suit the star schema's prices.
RULES = validation.Rules(low_price=1000.0, high_price=50000.0, special_price=40000.0, special_word="RING")

# The same adapters in SQL, for the oracles.
RECEIPTS = """receipts AS (SELECT o_orderkey AS receipt_id, 'job-' || (o_orderkey % 97) AS job_id, 'job-' || (o_orderkey % 97) || '_' || o_orderkey AS source_id,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN '  ' ELSE c_name END AS vendor, o_orderdate::DATE AS receipt_date,
  o_totalprice::DECIMAL(18,2) AS total, CASE o_orderstatus WHEN 'F' THEN 'Processed' WHEN 'O' THEN 'Pending' ELSE 'Failed' END AS status,
  (o_orderkey * 37 % 101)::INT AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN 'ocr+llm' ELSE 'ocr' END AS extraction_source,
  ['pending', 'approved', 'rejected', 'not_requested'][(o_orderkey % 4 + 1)::INT] AS ai_review_status,
  CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey * 10 + 1 END AS active_llm_run_id, o_orderdate::DATE AS created_at, o_orderdate::DATE AS updated_at
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
ITEMS = """items AS (SELECT l_orderkey AS receipt_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INT AS line_no,
  coalesce(p_name, 'Unknown') AS item_name, l_extendedprice::DECIMAL(18,2) AS price, l_quantity::INT AS qty, 'CAD' AS currency,
  ((l_orderkey * 7 + l_linenumber) * 31 % 101)::INT AS confidence, ((l_orderkey * 7 + l_linenumber) * 17 % 101)::INT AS name_conf,
  ((l_orderkey * 7 + l_linenumber) * 13 % 101)::INT AS price_conf, l_partkey AS part_id FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""
EVENTS = """ev AS (SELECT user_id AS receipt_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS line_no, event_type AS item_name, value::DECIMAL(18,2) AS price, event_id FROM events)"""
RUNS = """runs AS (SELECT conv_id AS receipt_id, conv_id * 1000 + turn AS llm_run_id, role AS provider, length(text)::BIGINT AS response_chars FROM conversations)"""
STATS = """pos AS (SELECT receipt_id, count(*) AS n, avg(price::DOUBLE) AS mean, coalesce(stddev_samp(price::DOUBLE), 0) AS sd, list_sort(list(price::DOUBLE)) AS s FROM ev WHERE price > 0 GROUP BY 1),
st AS (SELECT *, s[(n // 4 + 1)::INT] AS q1, s[(3 * n // 4 + 1)::INT] AS q3 FROM pos)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def _subtotals(spark: SparkSession, d: str) -> DataFrame:
    """Receipts with a subtotal near the sum of their items for some, far for others, null for a few."""
    sums = adapters.items(spark, d).groupBy("receipt_id").agg(F.sum("price").alias("s"))
    k = F.col("receipt_id")
    factor = F.when(k % 4 == 0, F.lit("1.00")).when(k % 4 == 1, F.lit("1.03")).otherwise(F.lit("1.20")).cast("decimal(4,2)")
    sub = F.when(k % 11 != 0, (F.coalesce("s", F.lit(0)).cast("decimal(18,2)") * factor).cast("decimal(18,2)"))
    return adapters.receipts(spark, d).join(sums, "receipt_id", "left").withColumn("subtotal", sub).drop("s")


SUBTOTALS = """sums AS (SELECT receipt_id, sum(price) AS s FROM items GROUP BY 1),
sub AS (SELECT r.*, CASE WHEN r.receipt_id % 11 <> 0 THEN (coalesce(s, 0)::DECIMAL(18,2) * CASE WHEN r.receipt_id % 4 = 0 THEN 1.00 WHEN r.receipt_id % 4 = 1 THEN 1.03 ELSE 1.20 END::DECIMAL(4,2))::DECIMAL(18,2) END AS subtotal
  FROM receipts r LEFT JOIN sums USING (receipt_id))"""


def _validation(spark: SparkSession, d: str) -> DataFrame:
    return validation.validate_all(_subtotals(spark, d), adapters.items(spark, d), RULES)


@query(f"""WITH {RECEIPTS} SELECT strftime(receipt_date, '%Y-%m') AS ym, strftime(min(receipt_date), '%b') AS month, sum(total)::DECIMAL(28,2) AS spend, count(*) AS count
FROM receipts WHERE receipt_date >= DATE '{AS_OF}' - INTERVAL 6 MONTH GROUP BY 1""")
def monthly_trend(spark, d):
    return dashboard.monthly_trend(adapters.receipts(spark, d), AS_OF)


_STATUS = f"""ip AS (SELECT receipt_id, count(*) AS n, avg(price::DOUBLE) AS mean, coalesce(stddev_samp(price::DOUBLE), 0) AS sd, list_sort(list(price::DOUBLE)) AS s FROM items WHERE price > 0 GROUP BY 1),
io AS (SELECT DISTINCT i.receipt_id, i.item_name, i.price FROM items i JOIN ip USING (receipt_id) WHERE n >= 3 AND price > 0 AND (
  abs(CASE WHEN sd > 0 THEN (price::DOUBLE - mean) / sd ELSE 0 END) > 2.5 OR price::DOUBLE < s[(n // 4 + 1)::INT] - 1.5 * (s[(3 * n // 4 + 1)::INT] - s[(n // 4 + 1)::INT])
  OR price::DOUBLE > s[(3 * n // 4 + 1)::INT] + 1.5 * (s[(3 * n // 4 + 1)::INT] - s[(n // 4 + 1)::INT]))),
ist AS (SELECT i.*, CASE WHEN io.receipt_id IS NOT NULL THEN 1 ELSE 0 END AS is_outlier,
  CASE WHEN io.receipt_id IS NOT NULL THEN 'OUTLIER' WHEN (name_conf > 0 AND name_conf < 70) OR (price_conf > 0 AND price_conf < 70) THEN 'LOW_CONF' ELSE 'OK' END AS item_status,
  nullif(concat_ws(' | ', CASE WHEN (name_conf > 0 AND name_conf < 70) OR (price_conf > 0 AND price_conf < 70) THEN 'name_conf=' || name_conf || '.0, price_conf=' || price_conf || '.0 (<70.0)' END,
    CASE WHEN io.receipt_id IS NOT NULL THEN 'validation_outlier' END), '') AS status_reason
  FROM items i LEFT JOIN io ON i.receipt_id = io.receipt_id AND i.item_name = io.item_name AND i.price = io.price)"""


@query(f"""WITH {RECEIPTS}, {ITEMS}, {_STATUS} SELECT count(*) AS total_receipts, sum(total)::DECIMAL(28,2) AS total_spend, round(avg(confidence), 1) AS avg_confidence, count(DISTINCT vendor) AS vendor_count,
count(*) FILTER (ai_review_status = 'pending') AS pending_review, count(*) FILTER (ai_review_status = 'approved') AS approved_count, count(*) FILTER (ai_review_status = 'rejected') AS rejected_count,
count(*) FILTER (extraction_source = 'ocr') AS ocr_only_count, count(*) FILTER (extraction_source = 'ocr+llm') AS ocr_llm_count, count(*) FILTER (status IN ('Failed', 'Error')) AS failed_count,
count(*) FILTER (created_at >= DATE '{AS_OF}' - 7) AS new_this_week, (SELECT count(*) FROM ist WHERE item_status IN ('OUTLIER', 'FLAGGED', 'LOW_CONF', 'ERROR')) AS flagged_items FROM receipts""")
def dashboard_summary(spark, d):
    return dashboard.summary(adapters.receipts(spark, d), validation.item_status_by_receipt(adapters.items(spark, d), RULES), AS_OF)


@query(f"""WITH {RECEIPTS}, {ITEMS}, {SUBTOTALS}, {_STATUS} SELECT (SELECT count(*) FROM items i WHERE EXISTS (SELECT 1 FROM io WHERE io.receipt_id = i.receipt_id AND io.item_name = i.item_name AND io.price = i.price) AND i.receipt_id IN (SELECT receipt_id FROM sub))::BIGINT AS price_outliers,
(SELECT count(*) FROM sub) AS subtotal_mismatch, (SELECT count(*) FROM items WHERE receipt_id IN (SELECT receipt_id FROM sub) AND (lower(item_name) LIKE '%0o%' OR lower(item_name) LIKE '%1l%' OR lower(item_name) LIKE '%5s%' OR lower(item_name) LIKE '%8b%' OR lower(item_name) LIKE '%rn%'
  OR length(regexp_replace(item_name, '[^0-9]', '', 'g')) > 0.4 * length(item_name) OR length(item_name) < 3 OR length(item_name) > 40))::BIGINT AS name_quality_issues,
(SELECT count(*) FROM items WHERE receipt_id IN (SELECT receipt_id FROM sub) AND (price < 1000 OR price > 50000 OR (price > 40000 AND upper(item_name) LIKE '%RING%')))::BIGINT AS price_range_warnings,
(SELECT count(*) FROM items WHERE confidence < 60) AS low_confidence_items, (SELECT count(*) FROM receipts WHERE vendor IS NULL OR trim(vendor) = '') AS missing_vendor""")
def validation_summary(spark, d):
    return dashboard.validation_summary(adapters.receipts(spark, d), adapters.items(spark, d), _validation(spark, d))


@query(f"""WITH {RECEIPTS} SELECT CASE extraction_source WHEN 'ocr' THEN 'ocr' ELSE 'llm' END AS source, count(*) FILTER (confidence >= 80) AS high, count(*) FILTER (confidence >= 60 AND confidence < 80) AS medium, count(*) FILTER (confidence < 60) AS low FROM receipts GROUP BY 1""")
def confidence_distribution(spark, d):
    return dashboard.confidence_distribution(adapters.receipts(spark, d))


@query(f"""WITH {RECEIPTS}, top AS (SELECT *, '<strong>' || coalesce(nullif(vendor, ''), nullif(job_id, ''), 'Receipt #' || receipt_id) || '</strong>' AS l FROM receipts ORDER BY updated_at DESC, receipt_id DESC LIMIT 15)
SELECT receipt_id, CASE WHEN ai_review_status = 'approved' THEN 'llm' WHEN ai_review_status = 'rejected' THEN 'reject' WHEN ai_review_status = 'pending' THEN 'flag' WHEN status IN ('Failed', 'Error') THEN 'reject' ELSE 'upload' END AS type,
CASE WHEN ai_review_status = 'approved' THEN '✓' WHEN ai_review_status = 'rejected' THEN '✕' WHEN ai_review_status = 'pending' THEN '!' WHEN status IN ('Failed', 'Error') THEN '✕' ELSE '↑' END AS icon,
CASE WHEN ai_review_status = 'approved' THEN 'LLM run approved' WHEN ai_review_status = 'rejected' THEN 'LLM run rejected' WHEN ai_review_status = 'pending' THEN 'Pending AI review' WHEN status IN ('Failed', 'Error') THEN 'Processing ' || lower(status) ELSE 'Uploaded' END || ' — ' || l AS text FROM top""")
def activity_feed(spark, d):
    return dashboard.activity_feed(adapters.receipts(spark, d))


@query(f"""WITH {RECEIPTS} SELECT receipt_id, job_id, source_id, vendor, receipt_date, total, status, confidence, extraction_source, ai_review_status, active_llm_run_id,
CASE WHEN active_llm_run_id IS NOT NULL AND ai_review_status = 'pending' THEN 'llm' ELSE 'receipt' END AS data_source FROM receipts ORDER BY receipt_id DESC LIMIT 200""")
def receipts_list(spark, d):
    return dashboard.receipts_list(adapters.receipts(spark, d))


@query(f"WITH {RECEIPTS} SELECT receipt_id FROM receipts WHERE vendor IS NULL OR trim(vendor) = ''")
def missing_vendor(spark, d):
    return dashboard.missing_vendor(adapters.receipts(spark, d)).select("receipt_id")


@query(f"WITH {ITEMS}, {_STATUS} SELECT receipt_id, line_no, item_name, price, is_outlier, item_status, status_reason FROM ist")
def item_status(spark, d):
    return validation.item_status_by_receipt(adapters.items(spark, d), RULES).select("receipt_id", "line_no", "item_name", "price", "is_outlier", "item_status", "status_reason")


@query(f"WITH {ITEMS}, {_STATUS} SELECT receipt_id, line_no, item_status FROM ist WHERE item_status IN ('OUTLIER', 'FLAGGED', 'LOW_CONF', 'ERROR')")
def flagged_items(spark, d):
    return dashboard.flagged_items(validation.item_status_by_receipt(adapters.items(spark, d), RULES)).select("receipt_id", "line_no", "item_status")


@query(f"""WITH {RECEIPTS} SELECT status, count(*) AS n, ((count(*) * 200 + (SELECT count(*) FROM receipts)) // (2 * (SELECT count(*) FROM receipts)))::BIGINT AS percent FROM receipts GROUP BY 1""")
def status_percentages(spark, d):
    return dashboard.percentages(adapters.receipts(spark, d), "status")


@query(f"""WITH {RECEIPTS}, top AS (SELECT receipt_id, coalesce(CASE WHEN trim(vendor) <> '' THEN vendor END, 'Unknown') AS vendor FROM receipts ORDER BY receipt_id DESC LIMIT 10),
f AS (SELECT *, max(receipt_id) OVER (PARTITION BY vendor) AS first FROM top) SELECT receipt_id, vendor, ((dense_rank() OVER (ORDER BY first DESC) - 1) % 7)::INT AS colour FROM f""")
def vendor_colours(spark, d):
    return dashboard.vendor_colours(adapters.receipts(spark, d))


@query(f"""WITH {EVENTS}, {STATS} SELECT e.receipt_id, e.line_no, e.item_name, e.price, CASE WHEN abs((price::DOUBLE - mean) / sd) > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS likelihood
FROM ev e JOIN st USING (receipt_id) WHERE price > 0 AND sd > 0 AND abs(price::DOUBLE - mean) > 2 * sd""")
def problematic_items(spark, d):
    return validation.problematic_items(adapters.priced_events(spark, d))


@query(f"""WITH {EVENTS}, {STATS} SELECT receipt_id, line_no, price, is_outlier_iqr, CASE WHEN z > 2.5 THEN 'high' WHEN z < -2.5 THEN 'low' ELSE 'iqr' END AS side FROM (
SELECT e.receipt_id, line_no, price, CASE WHEN sd > 0 THEN (price::DOUBLE - mean) / sd ELSE 0 END AS z, price::DOUBLE < q1 - 1.5 * (q3 - q1) OR price::DOUBLE > q3 + 1.5 * (q3 - q1) AS is_outlier_iqr
FROM ev e JOIN st USING (receipt_id) WHERE price > 0 AND n >= 3) WHERE abs(z) > 2.5 OR is_outlier_iqr""")
def price_outliers(spark, d):
    out = validation.price_outliers(adapters.priced_events(spark, d))
    side = F.when(F.col("z") > 2.5, "high").when(F.col("z") < -2.5, "low").otherwise("iqr")
    return out.select("receipt_id", "line_no", "price", "is_outlier_iqr", side.alias("side"))


@query(f"""WITH {EVENTS}, {STATS}, o AS (SELECT receipt_id, count(*) AS k FROM (SELECT e.receipt_id, CASE WHEN sd > 0 THEN (price::DOUBLE - mean) / sd ELSE 0 END AS z, price::DOUBLE < q1 - 1.5 * (q3 - q1) OR price::DOUBLE > q3 + 1.5 * (q3 - q1) AS q
FROM ev e JOIN st USING (receipt_id) WHERE price > 0 AND n >= 3) WHERE abs(z) > 2.5 OR q GROUP BY 1)
SELECT a.receipt_id, coalesce(st.n, 0) AS n, coalesce(k, 0) AS outliers, CASE WHEN coalesce(st.n, 0) < 3 THEN 'INSUFFICIENT_DATA' WHEN k > 0 THEN 'OUTLIERS_FOUND' ELSE 'OK' END AS status
FROM (SELECT DISTINCT receipt_id FROM ev) a LEFT JOIN st USING (receipt_id) LEFT JOIN o USING (receipt_id)""")
def outlier_status(spark, d):
    return validation.outlier_status(adapters.priced_events(spark, d))


_CHECK = """chk AS (SELECT receipt_id, subtotal, coalesce(s, 0)::DECIMAL(28,2) AS items_total, CASE WHEN subtotal IS NOT NULL THEN (coalesce(s, 0) - subtotal)::DECIMAL(28,2) END AS discrepancy,
CASE WHEN subtotal IS NULL THEN 'SKIPPED' WHEN subtotal = 0 OR abs(coalesce(s, 0) - subtotal) * 100 < abs(subtotal) * 1 THEN 'PASS' WHEN abs(coalesce(s, 0) - subtotal) * 100 < abs(subtotal) * 5 THEN 'WARNING' ELSE 'FAIL' END AS subtotal_status
FROM sub LEFT JOIN (SELECT receipt_id, sum(price) AS s FROM items WHERE price > 0 GROUP BY 1) USING (receipt_id))"""


@query(f"WITH {RECEIPTS}, {ITEMS}, {SUBTOTALS}, {_CHECK} SELECT * FROM chk")
def subtotal_check(spark, d):
    return validation.subtotal_check(_subtotals(spark, d), adapters.items(spark, d))


@query(f"""WITH {RECEIPTS}, {ITEMS}, {SUBTOTALS}, {_CHECK}, {_STATUS},
oc AS (SELECT i.receipt_id, count(*) AS outliers_count, list(i.item_name ORDER BY i.line_no)[1:2] AS onames FROM items i JOIN io ON io.receipt_id = i.receipt_id AND io.item_name = i.item_name AND io.price = i.price GROUP BY 1),
nq AS (SELECT receipt_id, count(*) AS name_quality_issues FROM items WHERE lower(item_name) LIKE '%rn%' OR lower(item_name) LIKE '%0o%' OR lower(item_name) LIKE '%1l%' OR lower(item_name) LIKE '%5s%' OR lower(item_name) LIKE '%8b%' OR length(regexp_replace(item_name, '[^0-9]', '', 'g')) > 0.4 * length(item_name) OR length(item_name) < 3 OR length(item_name) > 40 GROUP BY 1),
pr AS (SELECT receipt_id, count(*) AS price_range_warnings FROM items WHERE price < 1000 OR price > 50000 OR (price > 40000 AND upper(item_name) LIKE '%RING%') GROUP BY 1),
pb AS (SELECT receipt_id, list(item_name ORDER BY line_no, item_name)[1:3] AS pnames FROM items JOIN ip USING (receipt_id) WHERE price > 0 AND sd > 0 AND abs(price::DOUBLE - mean) > 2 * sd GROUP BY 1),
al AS (SELECT chk.*, coalesce(outliers_count, 0) AS outliers_count, coalesce(name_quality_issues, 0) AS name_quality_issues, coalesce(price_range_warnings, 0) AS price_range_warnings, onames, pnames
  FROM chk LEFT JOIN oc USING (receipt_id) LEFT JOIN nq USING (receipt_id) LEFT JOIN pr USING (receipt_id) LEFT JOIN pb USING (receipt_id))
SELECT receipt_id, subtotal_status, outliers_count, name_quality_issues, price_range_warnings, coalesce(nullif(concat_ws(chr(10),
  CASE WHEN subtotal_status = 'FAIL' AND len(pnames) > 0 THEN '✗ Subtotal mismatch: Review items [''' || array_to_string(pnames, ''', ''') || '''] (likely OCR errors or label misalignment)' END,
  CASE WHEN outliers_count > 0 THEN '⚠ Price outliers detected: [''' || array_to_string(onames, ''', ''') || ''']. Verify these prices.' END,
  CASE WHEN name_quality_issues > 0 THEN '⚠ ' || name_quality_issues || ' items have OCR quality issues. Manual review recommended.' END,
  CASE WHEN price_range_warnings > 0 THEN '⚠ ' || price_range_warnings || ' items have suspicious prices.' END), ''), '✓ All validations passed. Receipt looks good!') AS recommendations FROM al""")
def recommendations(spark, d):
    out = _validation(spark, d)
    return out.select("receipt_id", "subtotal_status", "outliers_count", "name_quality_issues", "price_range_warnings", F.array_join("recommendations", "\n").alias("recommendations"))


@query(f"""WITH {ITEMS}, n AS (SELECT receipt_id, line_no, item_name, lower(item_name) LIKE '%rn%' OR lower(item_name) LIKE '%0o%' OR lower(item_name) LIKE '%1l%' OR lower(item_name) LIKE '%5s%' OR lower(item_name) LIKE '%8b%' AS artifact,
length(item_name) < 3 AS too_short, length(item_name) > 40 AS too_long, confidence / 100.0::DOUBLE < 0.65 AS low_conf FROM items) SELECT receipt_id, line_no, artifact, too_short, too_long, low_conf FROM n WHERE artifact OR too_short OR too_long OR low_conf""")
def name_quality(spark, d):
    i = adapters.items(spark, d).withColumn("conf_mean", F.col("confidence") / F.lit(100.0))
    return validation.name_quality(i).select("receipt_id", "line_no", "artifact", "too_short", "too_long", "low_conf")


@query(f"""WITH {ITEMS}, p AS (SELECT receipt_id, line_no, CASE WHEN price <= 0 THEN 'Price <= 0 (likely OCR error)' WHEN price < 1000 THEN 'Very low price: $' || price WHEN price > 50000 THEN 'Suspiciously high: $' || price
WHEN price > 40000 AND upper(item_name) LIKE '%RING%' THEN 'Item ''' || item_name || ''' too expensive: $' || price END AS reason FROM items) SELECT * FROM p WHERE reason IS NOT NULL""")
def price_ranges(spark, d):
    return validation.price_ranges(adapters.items(spark, d), RULES).select("receipt_id", "line_no", "reason")


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')[1] AS first_token FROM documents)
SELECT doc_id AS receipt_id, first_token FROM w WHERE NOT ((regexp_full_match(first_token, '\d+') AND length(first_token) >= 6) OR (NOT regexp_full_match(first_token, '\d+') AND length(first_token) >= 2))""")
def label_sequence(spark, d):
    docs = adapters.read(spark, d, "documents").select(F.col("doc_id").alias("receipt_id"), F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "").alias("tokens"))
    return validation.label_sequence(docs).select("receipt_id", "first_token")


_FLAGS = f"""WITH {ITEMS}, g AS (SELECT receipt_id, line_no, item_name, CASE WHEN part_id % 13 <> 0 THEN price END AS price FROM items), s AS (SELECT DISTINCT receipt_id AS sr, item_name AS sn FROM items WHERE (part_id + receipt_id) % 40 = 7),
f AS (SELECT g.receipt_id, g.line_no, CASE WHEN price IS NULL THEN 'missing_price' WHEN sn IS NOT NULL THEN 'price_outlier' ELSE 'clean' END AS flag, CASE WHEN price IS NULL THEN 'Missing price - not extracted from receipt'
  WHEN sn IS NOT NULL THEN 'Price outlier detected: $' || price ELSE 'OK - passed validation' END AS flag_reason FROM g LEFT JOIN s ON receipt_id = sr AND item_name = sn)"""


def _flags(spark, d):
    i = adapters.items(spark, d).withColumn("price", F.when(F.col("part_id") % 13 != 0, F.col("price")))
    return validation.item_flags(i, i.filter("(part_id + receipt_id) % 40 = 7").select("receipt_id", "item_name"))


@query(_FLAGS + " SELECT * FROM f")
def item_flags(spark, d):
    return _flags(spark, d).select("receipt_id", "line_no", "flag", "flag_reason")


@query(_FLAGS + ", t AS (SELECT count(*) AS total, count(*) FILTER (flag = 'clean') AS clean FROM f) SELECT flag, count(*) AS n, any_value(total) AS total, printf('%.1f', any_value(clean) * 100 / any_value(total)) || '%' AS clean_pct FROM f, t GROUP BY flag")
def flag_summary(spark, d):
    return validation.flag_summary(_flags(spark, d))


@query(f"""WITH {ITEMS}, {_STATUS}, k AS (SELECT *, trim(lower(item_name)) AS k FROM items), a AS (SELECT DISTINCT receipt_id, trim(lower(item_name)) AS k FROM io), b AS (SELECT DISTINCT receipt_id, k FROM k WHERE price < 1000 OR price > 50000 OR (price > 40000 AND k LIKE '%ring%')),
c AS (SELECT DISTINCT receipt_id, k FROM k WHERE k LIKE '%rn%' OR length(k) < 3 OR length(k) > 40)
SELECT k.receipt_id, k.line_no, CASE WHEN a.k IS NOT NULL THEN 'OUTLIER' WHEN b.k IS NOT NULL THEN 'SUSPICIOUS_PRICE' WHEN c.k IS NOT NULL THEN 'NAME_ISSUE' ELSE 'OK' END AS ui_status
FROM k LEFT JOIN a ON k.receipt_id = a.receipt_id AND k.k = a.k LEFT JOIN b ON k.receipt_id = b.receipt_id AND k.k = b.k LEFT JOIN c ON k.receipt_id = c.receipt_id AND k.k = c.k""")
def ui_item_status(spark, d):
    i = adapters.items(spark, d)
    return validation.ui_item_status(i, validation.price_outliers(i, RULES), validation.price_ranges(i, RULES), validation.name_quality(i)).select("receipt_id", "line_no", "ui_status")


@query(f"""WITH {RECEIPTS}, {ITEMS}, {SUBTOTALS}, m AS (SELECT receipt_id, coalesce(s, 0)::DECIMAL(28,2) AS item_sum, CASE WHEN subtotal IS NOT NULL THEN abs(coalesce(s, 0) - subtotal) <= 0.05 END AS subtotal_ok,
CASE WHEN subtotal IS NOT NULL THEN abs(subtotal + CASE WHEN receipt_id % 2 = 0 THEN 1.00 ELSE 0 END - CASE WHEN receipt_id % 8 = 0 THEN subtotal + 1 ELSE total END) <= 0.05 END AS total_ok FROM sub LEFT JOIN sums USING (receipt_id))
SELECT *, CASE WHEN subtotal_ok IS NULL AND total_ok IS NULL THEN 'unvalidated' WHEN total_ok AND coalesce(subtotal_ok, TRUE) THEN 'valid' ELSE 'needs_review' END AS validation_status FROM m""")
def receipt_math(spark, d):
    k = F.col("receipt_id")
    r = _subtotals(spark, d).withColumn("tax", F.when(k % 2 == 0, F.lit(1).cast(adapters.MONEY)))
    r = r.withColumn("total", F.when((k % 8 == 0) & F.col("subtotal").isNotNull(), (F.col("subtotal") + 1).cast(adapters.MONEY)).otherwise(F.col("total")))
    return validation.receipt_math(r, adapters.items(spark, d)).select("receipt_id", "item_sum", "subtotal_ok", "total_ok", "validation_status")


@query(f"""WITH {RECEIPTS}, {ITEMS} SELECT receipt_id, greatest(0, least(100, 40 + CASE WHEN vendor <> '' THEN 10 ELSE 0 END + 15 + CASE WHEN receipt_id % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN receipt_id % 3 = 0 THEN 5 ELSE 0 END + 5 + least(12, 2 * coalesce(n, 0))))::INT AS confidence
FROM receipts LEFT JOIN (SELECT receipt_id, count(*) AS n FROM items GROUP BY 1) USING (receipt_id)""")
def confidence_estimate(spark, d):
    n = adapters.items(spark, d).groupBy("receipt_id").agg(F.count("*").alias("n_items"))
    k = F.col("receipt_id")
    r = adapters.receipts(spark, d).select("receipt_id", "vendor", "total", F.when(k % 2 == 0, 1.0).alias("subtotal"), F.when(k % 3 == 0, 1.0).alias("tax"), F.col("receipt_date").cast("string").alias("date"), F.lit(None).cast("string").alias("phone"))
    return validation.confidence_estimate(r.join(n, "receipt_id", "left").fillna(0, ["n_items"])).select("receipt_id", "confidence")


@query(f"WITH {RUNS} SELECT receipt_id, arg_max(llm_run_id, llm_run_id) AS llm_run_id, arg_max(provider, llm_run_id) AS provider, arg_max(response_chars, llm_run_id) AS response_chars FROM runs GROUP BY 1")
def latest_llm_run(spark, d):
    return workflow.latest_runs(adapters.llm_runs(spark, d))


_DETAIL = f"""WITH {RECEIPTS}, {ITEMS} SELECT r.receipt_id, r.vendor, count(i.line_no) AS n_items, coalesce(string_agg(i.line_no || ':' || i.item_name || ':' || CASE WHEN r.ai_review_status = 'pending' THEN i.qty::VARCHAR ELSE i.price::VARCHAR END, ';' ORDER BY i.line_no), '') AS items,
CASE WHEN r.ai_review_status = 'pending' THEN 'llm' ELSE 'receipt' END AS data_source FROM receipts r LEFT JOIN items i USING (receipt_id) GROUP BY ALL"""


@query(_DETAIL)
def receipt_detail(spark, d):
    i = adapters.items(spark, d)
    staged = i.select((F.col("receipt_id") * 10 + 1).alias("llm_run_id"), "line_no", "item_name", F.col("qty").cast(adapters.MONEY).alias("line_price"))
    out = workflow.receipt_detail(adapters.receipts(spark, d), i, run_items=staged)
    show = lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["item_name"], F.when(F.col("data_source") == "llm", x["unit_price"].cast("int").cast("string")).otherwise(x["unit_price"].cast("string")))
    return out.select("receipt_id", "vendor", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", show), ";").alias("items"), "data_source")


@query(f"""WITH {RECEIPTS} SELECT receipt_id, CASE WHEN ai_review_status = 'pending' AND receipt_id % 8 = 0 THEN (total + 1)::DECIMAL(18,2) ELSE total END AS total, CASE WHEN ai_review_status = 'pending' AND receipt_id % 8 = 0 THEN 'llm' ELSE 'receipt' END AS data_source FROM receipts""")
def ui_source_switch(spark, d):
    r = adapters.receipts(spark, d)
    runs = r.filter("receipt_id % 8 = 0").select((F.col("receipt_id") * 10 + 1).alias("llm_run_id"), (F.col("total") + 1).cast(adapters.MONEY).alias("total"))
    return workflow.ui_source_switch(r, runs, "total")


_INCOMING = "inc AS (SELECT CASE WHEN receipt_id % 10 = 0 THEN source_id ELSE 'new_' || source_id END AS source_id, 'again' AS vendor, (total + 5)::DECIMAL(18,2) AS total, receipt_id AS seq FROM receipts WHERE receipt_id % 5 = 0)"


@query(f"""WITH {RECEIPTS}, {_INCOMING}, n AS (SELECT inc.*, row_number() OVER (ORDER BY inc.source_id) AS k FROM inc LEFT JOIN receipts r USING (source_id) WHERE r.receipt_id IS NULL)
SELECT r.receipt_id, r.source_id, CASE WHEN i.source_id IS NOT NULL THEN 'again' ELSE r.vendor END AS vendor, CASE WHEN i.source_id IS NOT NULL THEN i.total ELSE r.total END AS total, CASE WHEN i.source_id IS NOT NULL THEN 'Pending' ELSE r.status END AS status,
CASE WHEN i.source_id IS NOT NULL THEN 'not_requested' ELSE r.ai_review_status END AS ai_review_status FROM receipts r LEFT JOIN inc i USING (source_id)
UNION ALL SELECT (SELECT max(receipt_id) FROM receipts) + k, source_id, vendor, total, 'Pending', 'not_requested' FROM n""")
def upsert_receipts(spark, d):
    r = adapters.receipts(spark, d)
    inc = r.filter("receipt_id % 5 = 0").select(F.when(F.col("receipt_id") % 10 == 0, F.col("source_id")).otherwise(F.concat(F.lit("new_"), "source_id")).alias("source_id"), F.lit("again").alias("vendor"), (F.col("total") + 5).cast(adapters.MONEY).alias("total"), F.col("receipt_id").alias("seq"))
    out = workflow.upsert(r.select("receipt_id", "source_id", "vendor", "total", "status", "ai_review_status"), inc)
    return out.select("receipt_id", "source_id", "vendor", "total", "status", "ai_review_status")


@query(f"""WITH {ITEMS} SELECT receipt_id, line_no, item_name, price FROM items WHERE receipt_id % 6 <> 0 UNION ALL SELECT receipt_id, line_no, 'new', (price * 2)::DECIMAL(18,2) FROM items WHERE receipt_id % 6 = 0 AND line_no <= 2""")
def replace_items(spark, d):
    i = adapters.items(spark, d).select("receipt_id", "line_no", "item_name", "price")
    new = i.filter("receipt_id % 6 = 0 and line_no <= 2").select("receipt_id", "line_no", F.lit("new").alias("item_name"), (F.col("price") * 2).cast(adapters.MONEY).alias("price"))
    return workflow.replace_rows(i, new)


@query(f"""WITH {RECEIPTS} SELECT receipt_id, CASE WHEN a AND receipt_id % 12 = 0 THEN 'model' ELSE vendor END AS vendor, CASE WHEN a THEN (total + 1)::DECIMAL(18,2) ELSE total END AS total, CASE WHEN a THEN 'approved' ELSE ai_review_status END AS ai_review_status
FROM (SELECT *, receipt_id % 4 IN (0, 2) AND receipt_id % 6 = 0 AS a FROM receipts)""")
def approve_run(spark, d):
    r = adapters.receipts(spark, d)
    runs = r.filter("receipt_id % 6 = 0").select("receipt_id", (F.col("receipt_id") * 10 + 1).alias("llm_run_id"), F.when(F.col("receipt_id") % 12 == 0, "model").alias("vendor"), (F.col("total") + 1).cast(adapters.MONEY).alias("total"))
    return workflow.approve_runs(r, runs).select("receipt_id", "vendor", "total", "ai_review_status")


@query(f"WITH {RECEIPTS} SELECT receipt_id, CASE WHEN receipt_id % 3 = 0 AND ai_review_status = 'pending' AND status <> 'Processed' THEN 'rejected' ELSE ai_review_status END AS ai_review_status FROM receipts")
def reject_run(spark, d):
    r = adapters.receipts(spark, d)
    return workflow.reject_runs(r, r.filter("receipt_id % 3 = 0")).select("receipt_id", "ai_review_status")


@query(f"""WITH {RECEIPTS}, q AS (SELECT receipt_id FROM receipts WHERE receipt_id % 3 = 0 UNION ALL SELECT -1),
j AS (SELECT q.receipt_id, CASE WHEN r.receipt_id IS NULL THEN 'not_found' WHEN status = 'Processed' THEN 'read_only' WHEN ai_review_status <> 'pending' THEN 'not_pending' END AS reason FROM q LEFT JOIN receipts r USING (receipt_id)) SELECT * FROM j WHERE reason IS NOT NULL""")
def reject_refused(spark, d):
    r = adapters.receipts(spark, d)
    ask = r.filter("receipt_id % 3 = 0").select("receipt_id").unionByName(spark.createDataFrame([(-1,)], "receipt_id long"))
    return workflow.reject_rejects(r, ask)


@query(f"WITH {RECEIPTS} SELECT receipt_id, CASE WHEN status <> 'Processed' AND receipt_id % 7 = 1 THEN 'Error' ELSE status END AS status FROM receipts")
def status_transition(spark, d):
    r = adapters.receipts(spark, d)
    ask = r.filter("receipt_id % 7 < 2").select("receipt_id", F.when(F.col("receipt_id") % 7 == 1, "Error").otherwise("Nonsense").alias("new_status"))
    return workflow.set_status(r, ask).select("receipt_id", "status")


@query(f"""WITH {RECEIPTS} SELECT receipt_id, CASE WHEN u THEN 'edited' ELSE vendor END AS vendor, CASE WHEN u THEN (total + 2)::DECIMAL(18,2) ELSE total END AS total, CASE WHEN u THEN 'Processed' ELSE status END AS status, CASE WHEN u AND ai_review_status = 'pending' THEN 'approved' ELSE ai_review_status END AS ai_review_status
FROM (SELECT *, receipt_id % 9 = 0 AND receipt_id % 2 = 0 AND status <> 'Processed' AS u FROM receipts)""")
def ui_approve(spark, d):
    r = adapters.receipts(spark, d)
    edits = r.filter("receipt_id % 9 = 0").select("receipt_id", F.lit("edited").alias("vendor"), F.when(F.col("receipt_id") % 2 == 0, F.col("total") + 2).cast(adapters.MONEY).alias("total"))
    return workflow.ui_approve(r, edits).select("receipt_id", "vendor", "total", "status", "ai_review_status")


@query(f"WITH {RECEIPTS}, {ITEMS} SELECT 'receipts' AS name, count(*) AS n FROM receipts WHERE receipt_id % 10 <> 3 UNION ALL SELECT 'items', count(*) FROM items WHERE receipt_id % 10 <> 3 OR receipt_id NOT IN (SELECT receipt_id FROM receipts)")
def cascade_delete(spark, d):
    r, i = adapters.receipts(spark, d), adapters.items(spark, d)
    left = workflow.cascade_delete(r, {"items": i}, r.filter("receipt_id % 10 = 3"))
    return left["receipts"].agg(F.lit("receipts").alias("name"), F.count("*").alias("n")).unionByName(left["items"].agg(F.lit("items").alias("name"), F.count("*").alias("n")))


@query(f"WITH {RECEIPTS} SELECT receipt_id, source_id FROM receipts WHERE source_id LIKE 'job-42%' ORDER BY receipt_id LIMIT 1")
def prefix_match(spark, d):
    return workflow.prefix_match(adapters.receipts(spark, d), "job-42").select("receipt_id", "source_id")


@query(f"""WITH {ITEMS}, v AS (SELECT receipt_id, row_number() OVER (PARTITION BY receipt_id ORDER BY line_no) AS position, qty FROM items WHERE line_no > 1) SELECT i.receipt_id, i.line_no, v.qty AS r_qty FROM items i LEFT JOIN v ON i.receipt_id = v.receipt_id AND i.line_no = v.position""")
def position_join(spark, d):
    i = adapters.items(spark, d).select("receipt_id", "line_no", "qty")
    out = workflow.position_join(i.select("receipt_id", "line_no"), i.filter("line_no > 1"), "receipt_id", "line_no")
    return out.select("receipt_id", "line_no", "r_qty")


@query(f"""WITH {RECEIPTS}, l AS (SELECT receipt_id, source_id AS a, job_id AS b FROM receipts WHERE receipt_id % 2 = 0), r AS (SELECT CASE WHEN receipt_id % 4 = 0 THEN source_id ELSE job_id END AS k, min(receipt_id) AS id FROM receipts WHERE receipt_id % 6 = 0 GROUP BY 1)
SELECT receipt_id, coalesce(x.id, y.id) AS m_id FROM l LEFT JOIN r x ON l.a = x.k LEFT JOIN r y ON l.b = y.k""")
def multi_key_match(spark, d):
    r = adapters.receipts(spark, d)
    left = r.filter("receipt_id % 2 = 0").select("receipt_id", "source_id", "job_id")
    right = r.filter("receipt_id % 6 = 0").select(F.col("receipt_id").alias("id"), F.when(F.col("receipt_id") % 4 == 0, F.col("source_id")).otherwise(F.col("job_id")).alias("k"))
    return workflow.multi_key_match(left, right, "receipt_id", [F.col("source_id"), F.col("job_id")], [F.col("k")]).select("receipt_id", "m_id")


@query(f"""WITH {RECEIPTS}, r AS (SELECT CASE WHEN receipt_id % 4 = 0 THEN source_id ELSE job_id END AS k, min(receipt_id) AS id FROM receipts GROUP BY 1)
SELECT receipt_id, coalesce(a.id, b.id) AS m_id FROM receipts l LEFT JOIN r a ON l.source_id = a.k LEFT JOIN r b ON l.job_id = b.k""")
def multi_key_match_all(spark, d):
    r = adapters.receipts(spark, d)
    right = r.select(F.col("receipt_id").alias("id"), F.when(F.col("receipt_id") % 4 == 0, F.col("source_id")).otherwise(F.col("job_id")).alias("k"))
    return workflow.multi_key_match(r.select("receipt_id", "source_id", "job_id"), right, "receipt_id", [F.col("source_id"), F.col("job_id")], [F.col("k")]).select("receipt_id", "m_id")


_LINES = """ln AS (SELECT doc_id AS receipt_id, i - 1 AS pos, trim(ls[i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(i)), tl AS (SELECT * FROM ln WHERE line <> '')"""


@query(f"WITH {_LINES} SELECT receipt_id, min(pos)::INT AS pos, line FROM tl GROUP BY receipt_id, line")
def line_dedupe(spark, d):
    return tables.first_by(adapters.text_lines(spark, d), [F.col("receipt_id"), F.col("line")], ["pos"]).select("receipt_id", "pos", "line")


@query(f"WITH {ITEMS} SELECT receipt_id, min(line_no) AS line_no, upper(item_name) AS name, qty FROM items GROUP BY receipt_id, upper(item_name), qty")
def item_dedupe(spark, d):
    i = adapters.items(spark, d).withColumn("name", F.upper("item_name"))
    return tables.first_by(i, [F.col("receipt_id"), F.col("name"), F.col("qty")], ["line_no"]).select("receipt_id", "line_no", "name", "qty")


@query(f"""WITH {_LINES}, u AS (SELECT receipt_id, min(pos) AS pos, line FROM tl GROUP BY receipt_id, line), s AS (SELECT *, length(line) % 7 AS score FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY score DESC, pos) AS rank FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY CASE WHEN rank <= 25 THEN 0 ELSE 1 END, CASE WHEN rank <= 25 THEN rank ELSE pos END) AS k FROM r)
SELECT receipt_id, substr(string_agg(line, chr(10) ORDER BY k), 1, 3500) AS text FROM o WHERE k <= 80 GROUP BY receipt_id""")
def compress_text(spark, d):
    return tables.compress_lines(adapters.text_lines(spark, d), F.length("line") % 7)


@query(f"""WITH {RECEIPTS} SELECT receipt_id FROM receipts WHERE contains(lower(concat_ws(' ', receipt_id::VARCHAR, vendor, receipt_date::VARCHAR, total::VARCHAR, status, confidence::VARCHAR)), '99 pro') OR FALSE""")
def search_receipts(spark, d):
    return tables.search(adapters.receipts(spark, d), "99 PRO", ["receipt_id", "vendor", "receipt_date", "total", "status", "confidence"]).select("receipt_id")


@query(f"WITH {RECEIPTS} SELECT receipt_id, lower(vendor) AS vendor FROM receipts WHERE trim(vendor) <> '' ORDER BY lower(vendor) DESC, receipt_id LIMIT 20 OFFSET 40")
def sorted_page(spark, d):
    r = adapters.receipts(spark, d).filter("trim(vendor) <> ''").select("receipt_id", F.lower("vendor").alias("vendor"))
    return tables.page(r, 3, 20, F.col("vendor").desc(), F.col("receipt_id"))


@query(f"WITH {RECEIPTS} SELECT greatest(1, ceil(count(*) / 15.0))::BIGINT AS pages FROM receipts")
def page_count(spark, d):
    return tables.page_count(adapters.receipts(spark, d), 15)


@query(f"""WITH {ITEMS} SELECT receipt_id, line_no, receipt_id || ',' || line_no || ',"' || replace(item_name, '"', '""') || '",' || price || ',' || currency AS csv FROM items""")
def export_csv(spark, d):
    return tables.csv_rows(adapters.items(spark, d))


@query(f"""WITH {_LINES} SELECT receipt_id, count(*) FILTER (regexp_matches(line, '[A-Za-z]') AND regexp_matches(line, '\\d+\\.\\d{{2}}(\\s+[A-Za-z]?)?$'))::INT AS item_lines, count(*)::INT AS lines,
count(*) FILTER (regexp_matches(line, '\\d+\\$\\d|[A-Za-z]{{1,2}}\\d{{3,}}|\\d+[A-Za-z]+\\d+'))::INT AS broken FROM tl GROUP BY receipt_id""")
def item_lines(spark, d):
    docs = adapters.read(spark, d, "documents").select(F.col("doc_id").alias("receipt_id"), "text")
    broken = F.size(F.filter(text._lines(F.col("text")), lambda x: x.rlike(r"\d+\$\d|[A-Za-z]{1,2}\d{3,}|\d+[A-Za-z]+\d+")))
    return docs.select("receipt_id", text.item_line_count(F.col("text")).alias("item_lines"), text.line_count(F.col("text")).alias("lines"), broken.alias("broken")).filter("lines > 0")


@query("""WITH e AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events) SELECT event_id, CASE WHEN v IS NULL THEN 0 WHEN v <= 1 THEN greatest(0, least(100, v * 100)) ELSE least(100, v) END::DOUBLE AS confidence FROM e""")
def confidence_scale(spark, d):
    return adapters.read(spark, d, "events").select("event_id", money.confidence_100(F.get_json_object("props", "$.k")).alias("confidence"))


@query(f"""WITH {EVENTS}, l AS (SELECT receipt_id, line_no, price, lag(price) OVER w AS p FROM ev WINDOW w AS (PARTITION BY receipt_id ORDER BY line_no)), s AS (SELECT *, CASE WHEN price - p > 30 THEN 1 ELSE 0 END AS cut FROM l)
SELECT receipt_id, line_no, (sum(cut) OVER (PARTITION BY receipt_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))::INT AS region FROM s""")
def region_split(spark, d):
    from ..operators import sequences

    return sequences.regions(adapters.priced_events(spark, d).withColumn("y", F.col("price")), "line_no", "y", 30).select("receipt_id", "line_no", "region")


@query(f"""WITH {RECEIPTS}, {ITEMS}, {SUBTOTALS}, g AS (SELECT sub.receipt_id, subtotal, coalesce(s, 0) - subtotal AS gap, CASE WHEN subtotal = 0 THEN 0 ELSE (coalesce(s, 0) - subtotal)::DOUBLE / subtotal::DOUBLE * 100 END AS pct FROM sub LEFT JOIN sums USING (receipt_id))
SELECT receipt_id, CASE WHEN subtotal IS NULL THEN NULL WHEN abs(pct) < 1 THEN format('✓ Subtotal matches (discrepancy: {{:.2f}}%)', pct) WHEN abs(pct) < 5 THEN format('⚠ Slight discrepancy: ${{:+.2f}} ({{:+.2f}}%)', gap::DOUBLE, pct) ELSE format('✗ Large discrepancy: ${{:+.2f}} ({{:+.2f}}%) — likely OCR/labeling errors', gap::DOUBLE, pct) END AS message FROM g""")
def subtotal_messages(spark, d):
    got = validation.subtotal_check(_subtotals(spark, d), adapters.items(spark, d))
    return got.select("receipt_id", validation.subtotal_message(F.col("subtotal_status"), F.col("discrepancy"), validation.discrepancy_pct(F.col("discrepancy"), F.col("subtotal"))).alias("message"))


@query(f"""WITH {ITEMS}, e AS (SELECT receipt_id, line_no, CASE part_id % 6 WHEN 0 THEN 'ab' WHEN 1 THEN '12345 x' WHEN 2 THEN 'c' || repeat('ream ', 9) WHEN 3 THEN 'corn' WHEN 4 THEN '' ELSE item_name END AS name, part_id % 6 AS k, confidence / 100.0::DOUBLE AS conf FROM items),
i AS (SELECT *, list_filter([CASE WHEN contains(lower(name), 'rn') THEN 'OCR artifacts (0/O, 1/I, 5/S confusion)' END, CASE WHEN k = 1 THEN 'High digit ratio (71.4%) — likely SKU/barcode mixed' END, CASE WHEN len(name) < 3 THEN 'Name too short — likely SKU only' WHEN len(name) > 40 THEN 'Name too long — likely multiple items merged' END,
  CASE WHEN conf < 0.65 THEN format('Low confidence ({{:.2f}})', conf) END], lambda x: x IS NOT NULL) AS issues FROM e),
g AS (SELECT receipt_id, count(*) FILTER (len(issues) > 0) AS num_issues, list(name || ': ' || array_to_string(issues, '; ') ORDER BY line_no) FILTER (len(issues) > 0) AS l FROM i GROUP BY 1)
SELECT receipt_id, CASE WHEN num_issues > 0 THEN 'ISSUES_FOUND' ELSE 'OK' END AS status, num_issues, coalesce(array_to_string(l[:3], '|'), '') AS issues FROM g""")
def name_reports(spark, d):
    """Names short, long, of digits, misread, empty; the first three of a receipt's issues are shown."""
    i, k = adapters.items(spark, d), F.col("part_id") % 6
    name = F.when(k == 0, "ab").when(k == 1, "12345 x").when(k == 2, "c" + "ream " * 9).when(k == 3, "corn").when(k == 4, F.lit(None).cast("string")).otherwise(F.col("item_name"))
    got = validation.name_reports(i.withColumns({"item_name": name, "conf_mean": F.col("confidence") / 100.0}), most=3)
    shown = F.array_join(F.transform("issues", lambda x: F.concat(x["item_name"], F.lit(": "), F.array_join(x["issues"], "; "))), "|")
    return got.select("receipt_id", "status", "num_issues", shown.alias("issues"))


@query(f"""WITH {RECEIPTS}, {ITEMS}, {SUBTOTALS}, g AS (SELECT sub.receipt_id, subtotal, coalesce(s, 0) AS t, coalesce(s, 0) - subtotal AS gap, CASE WHEN subtotal = 0 THEN 0 ELSE round((coalesce(s, 0) - subtotal)::DOUBLE / subtotal::DOUBLE * 100, 2) END AS pct FROM sub LEFT JOIN sums USING (receipt_id)),
n AS (SELECT receipt_id, count(*) AS n FROM items WHERE price > 0 GROUP BY 1)
SELECT g.receipt_id, repeat('=', 80) AS bar, CASE WHEN subtotal IS NULL THEN '    Status: SKIPPED' ELSE '    Status: ' || CASE WHEN abs(gap) * 100 < subtotal OR subtotal = 0 THEN 'PASS' WHEN abs(gap) * 100 < 5 * subtotal THEN 'WARNING' ELSE 'FAIL' END END AS status,
  CASE WHEN subtotal IS NOT NULL THEN format('    Expected:      ${{:.2f}}', subtotal::DOUBLE) || chr(10) || format('    Reconstructed: ${{:.2f}}', t::DOUBLE) || chr(10) || format('    Discrepancy:   ${{:+.2f}} ({{:+.2f}}%)', gap::DOUBLE, pct) ELSE '' END AS sums, coalesce(n, 0) < 3 AS few FROM g LEFT JOIN n USING (receipt_id)""")
def validation_reports(spark, d):
    """Parts of the report that people read: its bar, status, the three sums, and whether outliers could be sought."""
    got = report.validation_text(validation.validate_all(_subtotals(spark, d), adapters.items(spark, d), with_items=True))
    part = lambda p, k=1: F.regexp_extract("report", p, k)
    return got.select("receipt_id", F.element_at(F.split("report", "\n"), 2).alias("bar"), part(r"(    Status: \w+)").alias("status"), part(r"(    Expected:[^\n]*\n[^\n]*\n    Discrepancy:[^\n]*)").alias("sums"), F.col("report").contains("INSUFFICIENT_DATA").alias("few"))
