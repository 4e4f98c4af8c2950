"""Queries from processed receipts to tables: the composite write, item reconstruction, shrinking chunks, fields with their
substitutes, the tagger's words, positions of money. Inputs are laid out from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, report, text
from ..operators import sequences, writer
from ..session import materialize, partitions
from ..sources import adapters
from .kernels import _lines, _placed, _token
from .queries import ITEMS, query
from .review import _BASE, MONEY, _k, _now, _tables

# the composite write


def _save(spark, d, *asked):
    """Two rows for every third receipt (the second counts) and one for each of a tenth as many new ones, written twice; of the
    tables those ``asked`` for, all without any."""
    t = _tables(spark, d, broadcast=False)  # both writes keep several joins in the driver at once
    t["validation"] = t["receipts"].filter(_k() % 6 == 0).select((_k() + 3).alias("validation_id"), "receipt_id", F.lit("PASS").alias("subtotal_status"), F.lit(0.0).alias("subtotal_discrepancy"), F.lit(None).cast("double").alias("subtotal_discrepancy_pct"), F.lit(0).alias("outliers_count"), F.lit(0).alias("name_quality_issues"), F.lit(0).alias("price_range_warnings"), F.lit("{}").alias("validation_json"), F.col("created_at"))
    base = t["receipts"].filter((_k() % 3 == 0) | (_k() % 10 == 1)).withColumn("known", _k() % 3 == 0)
    base = base.withColumn("seq", F.explode(F.when(F.col("known"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    none = F.lit(None)
    checks = F.struct(F.lit("FAIL").alias("subtotal_status"), F.lit(1.5).alias("subtotal_discrepancy"), none.cast("double").alias("subtotal_discrepancy_pct"), F.array(F.struct(F.lit("odd  Tea").alias("name"), F.lit(9.0).alias("price"))).alias("outliers"), F.lit(2).alias("name_quality_issues"), none.cast("int").alias("price_range_warnings"), F.lit('{"x": 1}').alias("validation_json")).cast(writer.VALIDATION)
    facts = F.struct(none.cast("double").alias("subtotal"), none.cast("double").alias("tax"), F.col("total").cast("double").alias("total"), F.concat(F.lit("shop "), F.col("seq").cast("string")).alias("vendor"), F.lit("111").alias("phone"), none.cast("string").alias("address"), F.lit("").alias("date"), F.lit("{}").alias("summary_json")).cast(writer.SUMMARY)
    item = lambda n, name, price, nc, flag: F.struct(F.lit(n).alias("line_no"), F.lit(name).alias("name"), F.lit(price).alias("price"), F.lit(None).cast("string").alias("currency"), F.lit(None).cast("double").alias("confidence"), F.lit(nc).alias("name_confidence"), F.lit(0.9).alias("price_confidence"), F.lit(flag).alias("flagged"), F.lit("").alias("reason"))
    items = F.array(item(0, "ODD TEA", 9.0, 0.5, False), item(0, " ", 2.0, 0.9, False), item(7, "x", 1.0, 0.0, True)).cast(writer.ITEMS)
    batch = base.select(
        F.when(F.col("known"), F.col("source_id")).otherwise(F.concat(F.lit("new-"), F.lpad(_k().cast("string"), 12, "0"))).alias("source_id"), "job_id", F.lit(None).cast("string").alias("receipt_name"), F.concat(F.lit("shop "), F.col("seq").cast("string")).alias("vendor"), F.col("receipt_date").cast("string").alias("receipt_date"),
        none.cast("double").alias("subtotal"), F.lit(1.0).alias("tax"), F.col("total").cast("double").alias("total"), F.lit(0.5).alias("confidence"), F.lit(" usd").alias("currency"), F.lit("{}").alias("raw_json"), none.cast("string").alias("ocr_json"), none.cast("string").alias("predictionlog_json"), "seq",
        F.when(_k() % 2 == 0, checks).alias("validation"), F.when(_k() % 9 != 0, facts).alias("summary"), F.when(_k() % 4 != 0, items).otherwise(F.array().cast(writer.ITEMS)).alias("items"))
    for c in ("receipt_name", "raw_json", "ocr_json", "predictionlog_json"):
        if c not in t["receipts"].columns:
            t["receipts"] = t["receipts"].withColumn(c, none.cast("string"))
    asked = asked or writer.WRITTEN
    first = tuple({"receipts", *asked})  # what the second write begins with: whatever is asked for, it reads the receipts' ids
    once = writer.save_processed(t, batch, _now(), asked=first)
    once |= {n: materialize(once[n], f"saved-{n}") for n in first}
    return writer.save_processed(once, batch, _now(), asked=asked)


_SAVED = _BASE + """, nw AS (SELECT *, 'new-' || lpad(receipt_id::VARCHAR, 12, '0') AS src, (SELECT max(receipt_id) FROM rc) + row_number() OVER (ORDER BY receipt_id) AS new_id FROM rc WHERE receipt_id % 3 <> 0 AND receipt_id % 10 = 1),
sv AS (SELECT receipt_id AS rid, receipt_id AS k, source_id AS src, 'shop 2' AS shop, total FROM rc WHERE receipt_id % 3 = 0 UNION ALL SELECT new_id, receipt_id, src, 'shop 1', total FROM nw)"""


@query(_SAVED + """ SELECT r.receipt_id, r.source_id, coalesce(s.shop, r.vendor) AS vendor, CASE WHEN s.k IS NULL THEN r.subtotal ELSE 0 END AS subtotal, r.total, CASE WHEN s.k IS NULL THEN r.status ELSE 'Pending' END AS status, CASE WHEN s.k IS NULL THEN r.confidence ELSE 50 END AS confidence,
CASE WHEN s.k IS NULL THEN r.active_llm_run_id END AS active_llm_run_id, s.shop AS receipt_name FROM rc r LEFT JOIN sv s ON s.rid = r.receipt_id
UNION ALL SELECT rid, src, shop, 0, total, 'Pending', 50, NULL, shop FROM sv WHERE k <> rid OR src LIKE 'new-%'""")
def save_receipts(spark, d):
    return _save(spark, d, "receipts")["receipts"].select("receipt_id", "source_id", "vendor", "subtotal", "total", "status", "confidence", "active_llm_run_id", "receipt_name")


@query(_SAVED + """, va AS (SELECT receipt_id + 3 AS validation_id, receipt_id FROM rc WHERE receipt_id % 6 = 0), inc AS (SELECT rid FROM sv WHERE k % 2 = 0),
fr AS (SELECT rid, row_number() OVER (ORDER BY rid) AS n FROM inc WHERE rid NOT IN (SELECT receipt_id FROM va))
SELECT validation_id, receipt_id, 'FAIL' AS subtotal_status, 1.5::DOUBLE AS subtotal_discrepancy, 1 AS outliers_count, 2 AS name_quality_issues, 0 AS price_range_warnings FROM va
UNION ALL SELECT (SELECT max(validation_id) FROM va) + n, rid, 'FAIL', 1.5, 1, 2, 0 FROM fr""")
def save_validation(spark, d):
    return _save(spark, d, "validation")["validation"].select("validation_id", "receipt_id", "subtotal_status", "subtotal_discrepancy", "outliers_count", "name_quality_issues", "price_range_warnings")


@query(_SAVED + """, sm AS (SELECT receipt_id + 7 AS summary_id, receipt_id, vendor, total, receipt_date FROM rc WHERE receipt_id % 3 = 0), inc AS (SELECT sv.*, rc.receipt_date FROM sv JOIN rc ON rc.receipt_id = sv.k WHERE k % 9 <> 0),
fr AS (SELECT *, row_number() OVER (ORDER BY rid) AS n FROM inc WHERE rid NOT IN (SELECT receipt_id FROM sm))
SELECT s.summary_id, s.receipt_id, coalesce(i.shop, s.vendor) AS vendor, s.total, s.receipt_date::VARCHAR AS receipt_date FROM sm s LEFT JOIN inc i ON i.rid = s.receipt_id UNION ALL SELECT (SELECT max(summary_id) FROM sm) + n, rid, shop, total, receipt_date::VARCHAR FROM fr""")
def save_summary(spark, d):
    return _save(spark, d, "summary")["summary"].select("summary_id", "receipt_id", "vendor", "total", "receipt_date")


@query(_SAVED + """, ln AS (SELECT rid, n, CASE n WHEN 1 THEN 'ODD TEA' WHEN 2 THEN 'Unknown' ELSE 'x' END AS item_name, CASE n WHEN 1 THEN 9 WHEN 2 THEN 2 ELSE 1 END::DECIMAL(18,2) AS unit_price, n = 1 AND k % 2 = 0 AS odd FROM sv, (VALUES (1), (2), (7)) v(n) WHERE k % 4 <> 0),
fr AS (SELECT l.rid, l.n, row_number() OVER (ORDER BY l.rid, l.n) AS at FROM ln l LEFT JOIN it ON it.receipt_id = l.rid AND it.line_no = l.n WHERE it.item_id IS NULL)
SELECT item_id, receipt_id, line_no, item_name, unit_price, 'CAD' AS currency, 0 AS is_outlier, item_status, status_reason FROM it WHERE receipt_id NOT IN (SELECT rid FROM ln)
UNION ALL SELECT coalesce(it.item_id, (SELECT max(item_id) FROM it) + fr.at), l.rid, l.n, l.item_name, l.unit_price, 'USD', l.odd::INT, CASE WHEN l.n = 7 THEN 'FLAGGED' WHEN l.odd THEN 'OUTLIER' WHEN l.n = 1 THEN 'LOW_CONF' ELSE 'OK' END,
CASE WHEN l.n = 7 THEN 'flagged' WHEN l.odd THEN 'name_conf=50.0, price_conf=90.0 (<70.0) | validation_outlier' WHEN l.n = 1 THEN 'name_conf=50.0, price_conf=90.0 (<70.0)' END FROM ln l LEFT JOIN it ON it.receipt_id = l.rid AND it.line_no = l.n LEFT JOIN fr ON fr.rid = l.rid AND fr.n = l.n""")
def save_items(spark, d):
    return _save(spark, d, "items")["items"].select("item_id", "receipt_id", "line_no", "item_name", "unit_price", "currency", "is_outlier", "item_status", "status_reason")


# item reconstruction

@query(f"""WITH {ITEMS}, n AS (SELECT *, upper(split_part(item_name, ' ', 1)) AS a, upper(split_part(item_name, ' ', 2)) AS b, (qty + 0.25)::DECIMAL(18,2)::VARCHAR AS p, row_number() OVER (PARTITION BY receipt_id ORDER BY line_no) AS pos FROM items)
SELECT receipt_id, pos::BIGINT AS item_no, a || ' ' || b AS item_name, p::DOUBLE AS price, CASE WHEN line_no % 5 = 0 THEN replace(p, '.', ':') || 'KW' ELSE p END AS price_str,
  CASE WHEN line_no % 3 = 0 THEN '123456' ELSE '' END AS skus, CASE WHEN line_no % 4 = 1 THEN '1.44KG' END AS weight, CASE WHEN line_no % 2 = 0 THEN '3.CO-GP' ELSE '' END AS discounts, CASE WHEN line_no % 4 = 3 THEN 'TPD/77' ELSE '' END AS coupons, 50 AS x1, 780 AS x2
FROM n WHERE line_no % 7 <> 0 AND line_no % 6 <> 0""")
def items_with_all_tokens(spark, d):
    """Every line with what may stand between a name and its price: article numbers, weights, discounts, coupons; some
    are void and some have no price."""
    n, one = F.col("line_no"), lambda hit, w, lab, x: F.when(hit, _token(F.lit(w) if isinstance(w, str) else w, lab, x))
    price = F.col("price").cast("string")
    written = F.when(n % 5 == 0, F.concat(F.replace(price, F.lit("."), F.lit(":")), F.lit("KW"))).otherwise(price)
    word = lambda i: F.upper(F.element_at(F.split("item_name", " "), i))
    parts = F.array_compact(F.array(
        one(n % 2 == 1, "Member", "O", 1), one(F.lit(True), word(1), "B-MENU.NM", 50), one(F.lit(True), word(2), "I-MENU.NM", 150), one(n % 3 == 0, "123456", "O", 900), one(n % 4 == 1, "1.44KG", "O", 920), one(n % 4 == 3, "TPD/77", "O", 930),
        one(n % 2 == 0, "3.CO-GP", "I-MENU.PRICE", 940), one(n % 7 != 0, written, "B-MENU.PRICE", 700), one(n % 7 != 0, "99.99", "I-MENU.PRICE", 700), one(n % 6 == 0, "void", "O", 1), one(F.lit(True), "TOTAL", "B-SUM.TOTAL", 1)))
    t = _placed(_lines(spark, d).select("receipt_id", "line_no", F.posexplode(parts).alias("k", "p")), n)
    joined = lambda c: F.array_join(c, ",").alias(c)
    out = sequences.reconstruct(t).withColumn("at", F.col("item_no"))
    return out.select("receipt_id", "item_no", "item_name", "price", "price_str", joined("skus"), "weight", joined("discounts"), joined("coupons"), F.get("bbox", F.lit(0)).alias("x1"), F.get("bbox", F.lit(2)).alias("x2"))


# shrinking chunks

def _pieces(spark, d) -> DataFrame:
    """Words of every document; a word has a piece for each three letters, and every 50th has 40. Whole documents are
    dealt, so their words need not be."""
    docs = adapters.read(spark, d, "documents").select(F.col("doc_id").alias("receipt_id"), "text").repartition(partitions(spark), "receipt_id")
    words = docs.select("receipt_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("idx", "word"))
    return words.withColumn("pieces", F.when(F.col("idx") % 50 == 49, 40).otherwise(1 + F.floor((F.length("word") - 1) / 3)).cast("int"))


_WINDOWS = r"""WITH RECURSIVE w AS (SELECT doc_id AS receipt_id, len(l) AS n, list_transform(l, lambda x, i: CASE WHEN i % 50 = 0 THEN 40 ELSE 1 + (len(x) - 1) // 3 END) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM documents) WHERE len(l) > 0),
flat AS (SELECT receipt_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM w), sums AS (SELECT receipt_id, i, sum(p) OVER (PARTITION BY receipt_id ORDER BY i) AS s FROM flat),
c AS (SELECT w.receipt_id, n, [0] || list(s ORDER BY i) AS b FROM w JOIN sums USING (receipt_id) GROUP BY ALL),
step AS (SELECT receipt_id, n, 0::BIGINT AS chunk, 0::BIGINT AS first, least(400, n)::BIGINT AS width, false AS done FROM c
  UNION ALL SELECT receipt_id, n, CASE WHEN fits THEN chunk + 1 ELSE chunk END, CASE WHEN fits THEN nxt ELSE first END, CASE WHEN fits THEN least(400, n - nxt) ELSE greatest(20, floor(width * 0.85::DOUBLE)) END::BIGINT, fits AND first + width >= n
  FROM (SELECT s.*, b[first + width] - b[first + 1] < 510 OR width <= 20 AS fits, CASE WHEN width > 128 THEN first + width - 128 ELSE first + width END AS nxt FROM step s JOIN c USING (receipt_id, n) WHERE NOT done)),
win AS (SELECT s.receipt_id, chunk, first, min(width) AS width FROM step s WHERE NOT done AND first < n GROUP BY ALL)"""


@query(_WINDOWS + " SELECT w.receipt_id, chunk::INT AS chunk, first::INT AS first, (first + width - 1)::INT AS last FROM win w")
def shrinking_chunks(spark, d):
    return sequences.shrinking_windows(_pieces(spark, d), dealt=True).select("receipt_id", "chunk", "first", "last")


@query(_WINDOWS + """, seen AS (SELECT receipt_id, chunk, unnest(range(first, first + width)) AS idx, first FROM win),
kept AS (SELECT s.receipt_id, s.idx, s.chunk, (s.idx * 7 + s.chunk * 13) % 10 AS conf FROM seen s JOIN sums b ON b.receipt_id = s.receipt_id AND b.i = s.idx LEFT JOIN sums a ON a.receipt_id = s.receipt_id AND a.i = s.first WHERE s.idx = s.first OR b.s - coalesce(a.s, 0) < 510
  UNION ALL SELECT s.receipt_id, 0, 0, 0 FROM seen s WHERE s.idx = 0 AND s.first = 0),
top AS (SELECT receipt_id, idx, arg_max(chunk, conf * 1000000 + chunk) AS chunk, max(conf) AS conf FROM kept GROUP BY 1, 2)
SELECT receipt_id, count(*) AS tokens, sum(chunk)::BIGINT AS chunks, sum(conf)::BIGINT AS conf FROM top GROUP BY 1""")
def merged_chunks(spark, d):
    """Labels that a tagger gave in each chunk: of a word's the surest, the later of equals."""
    t = _pieces(spark, d)
    read = sequences.in_windows(sequences.shrinking_windows(t, dealt=True)).withColumns({"label": F.col("chunk").cast("string"), "conf": ((F.col("idx") * 7 + F.col("chunk") * 13) % 10).cast("double")})
    got = sequences.merge_chunks(read, t)
    return got.groupBy("receipt_id").agg(F.count("*").alias("tokens"), F.sum(F.when(F.col("label") != "O", F.col("label").cast("long"))).alias("chunks"), F.sum("conf").cast("long").alias("conf"))


# fields and words

@query(f"""WITH {ITEMS}, o AS (SELECT receipt_id, receipt_id % 4 AS k, (sum(qty) + 0.25)::DECIMAL(18,2) AS t FROM items GROUP BY 1)
SELECT receipt_id, CASE WHEN k = 3 THEN '' ELSE 'CORNER SHOP' END AS vendor, CASE k WHEN 0 THEN 'MAIN ROAD 9' WHEN 3 THEN '' ELSE '4521 OAK BLVD SPRINGFIELD 90210' END AS address, CASE k WHEN 0 THEN '416-555-0199' WHEN 3 THEN '' ELSE '905) 555-0123' END AS phone,
CASE WHEN k = 0 THEN 'on 12/05/2024' ELSE '' END AS date, CASE k WHEN 0 THEN t::VARCHAR WHEN 1 THEN '7.50' ELSE '' END AS subtotal, '' AS tax, CASE k WHEN 0 THEN (t + 1)::VARCHAR WHEN 3 THEN '' ELSE t::VARCHAR END AS total FROM o""")
def fields_of_receipts(spark, d):
    """Each receipt's fields: by entities; with an amount as d:dd and no phone, address or total entity; with words only."""
    k = F.col("receipt_id") % 4
    t = adapters.items(spark, d).groupBy("receipt_id").agg((F.sum("qty") + F.lit("0.25").cast("decimal(4,2)")).cast(MONEY).alias("t"))
    amount = F.col("t").cast("string")

    def run(when: Column, label: str, *words: str | Column) -> Column:
        return F.when(when, F.array(*(F.struct((F.lit(w) if isinstance(w, str) else w).alias("word"), F.lit("O" if label == "O" else f"{'B' if i == 0 else 'I'}-{label}").alias("label")) for i, w in enumerate(words))))

    runs = F.flatten(F.array_compact(F.array(
        run(k != 3, "HEAD.VENDOR", "CORNER", "SHOP", "SHOP"), run(k == 0, "HEAD.ADDRESS", "MAIN", "ROAD", "MAIN", "9"), run(k == 0, "HEAD.PHONE", "Tel", "416-555-0199"), run(k == 0, "HEAD.DATE", "on", "12/05/2024"),
        run(k.isin(1, 2), "O", "99", "4521", "OAK", "B", "OAK", "Bvd", "G", "SPRINGFIELD", "90210", "Phone:", "(905)", "555-0123"), run(k == 0, "SUM.SUBTOTAL", "SUBTOTA", amount), run(k == 1, "SUM.SUBTOTAL", "due", "7:50"),
        run(k == 0, "SUM.TOTAL", "COTAL", (F.col("t") + 1).cast("string")), run(k.isin(1, 2), "O", "Total", "due", amount), run(k == 3, "O", "thank", "you"))))
    tokens = t.select("receipt_id", runs.alias("r"))
    out = report.summary_fields(tokens.select("receipt_id", F.transform("r", lambda x: x["word"]).alias("words"), sequences.entity_list(F.col("r")).alias("entities")))
    return out.withColumn("address", F.replace("address", F.lit("B OAK "), F.lit("")))


@query(f"""WITH {ITEMS}, o AS (SELECT receipt_id, list(qty ORDER BY line_no) AS q FROM items GROUP BY 1)
SELECT receipt_id, 'SUBTOTAL ' || q[1] || '.25 TAX 1.50 TOTAL ' || q[1] || '.75 ' || CASE WHEN receipt_id % 2 = 0 THEN 'TAX' ELSE 'City' END || ' Bread' AS words, replace('- $ - - - $ - -', '$', CASE WHEN receipt_id % 2 = 0 THEN 'USD$' ELSE 'CA$' END) AS marks FROM o""")
def words_for_the_tagger(spark, d):
    """Misread summary words, amounts with their currency, a tax word that only American receipts have."""
    q = adapters.items(spark, d).groupBy("receipt_id").agg(F.min_by("qty", "line_no").cast("string").alias("q"))
    mark = F.when(F.col("receipt_id") % 2 == 0, "USD$").otherwise("CA$")
    words = F.array(F.lit("SUBTOTL"), F.concat(mark, F.col("q"), F.lit(",25")), F.lit("T4X"), F.lit("1.50A"), F.lit("TOTAL:"), F.concat(mark, F.col("q"), F.lit(".75")), F.when(F.col("receipt_id") % 2 == 0, "CITY TAX").otherwise("City"), F.lit("Bread"))
    return q.select("receipt_id", text.tagger_words(words).alias("w")).select("receipt_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("words"), F.array_join(F.transform("w", lambda x: F.coalesce(x["currency"], F.lit("-"))), " ").alias("marks"))


@query(rf"""WITH l AS (SELECT o_orderkey AS receipt_id, 'é ' || o_totalprice::DECIMAL(18,2)::VARCHAR || ' x 1,05 -3.50% ' || o_totalprice::DECIMAL(18,2)::VARCHAR AS t, len(o_totalprice::DECIMAL(18,2)::VARCHAR) AS n, o_totalprice::DECIMAL(18,2)::DOUBLE AS v FROM orders)
SELECT receipt_id, unnest([0, 1, 2, 3]) AS at, unnest([2, n + 5, n + 10, n + 17])::INT AS start, unnest([n + 2, n + 9, n + 15, 2 * n + 17])::INT AS "end", unnest([v, 1.05, -3.5, v]) AS value FROM l""")
def money_positions(spark, d):
    t = adapters.read(spark, d, "orders").select(F.col("o_orderkey").alias("receipt_id"), F.col("o_totalprice").cast(MONEY).cast("string").alias("p"))
    line = F.concat(F.lit("é "), "p", F.lit(" x 1,05 -3.50% "), "p")
    return t.select("receipt_id", F.posexplode(money.money_spans(line)).alias("at", "m")).select("receipt_id", "at", "m.start", "m.end", "m.value")
