"""Queries over small literal inputs, for operators whose input the driver's tables do not hold.

Their SQL lists the rows derived by hand from the rules (GOLD below), except where it computes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import llm_json, money, text
from ..operators import items, labels, long_rows, sequences, summary, tables
from ..sources import adapters
from .queries import ORACLES, QUERIES, query


def gold(columns: str, rows: list[tuple], **types: str):
    """Register with the expected rows as SQL. ``types``: of columns whose literals have another type."""

    def show(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    kinds = {"receipt_id": "BIGINT"} | types
    named = ", ".join(f"{c}::{kinds[c]} AS {c}" if c in kinds else c for c in columns.split(", "))
    return query(f"SELECT {named} FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns})")


def _texts(spark: SparkSession, values: list) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


@gold("i, price", [(0, None), (1, 40.0), (2, -9.95), (3, 1.0), (4, 99.0), (5, None), (6, 12.5), (7, -3.25), (8, None), (9, 0.0), (10, 1255.0), (11, 1.99)])
def parse_price(spark, d):
    df = _texts(spark, ["12:56", "40:00", "9.95-", "$1", ".99", "", "12,50", "-3.25", "3000000.00", "0.00", "l1 1255", "3 for 1.99"])
    return df.select("i", money.parse_price(F.col("t")).alias("price"))


@gold("i, amount", [(0, 12.34), (1, -12.34), (2, 1234.56), (3, 1234.56), (4, None), (5, 1234.0), (6, 18.0)])
def normalize_amount(spark, d):
    return _texts(spark, ["$12.34", "(12.34)", "1,234.56", "1.234,56", "18.00%", "1,234", "18%$"]).select("i", money.normalize_amount(F.col("t")).alias("amount"))


@gold("i, money", [(0, 10.5), (1, 1234.5), (2, None), (3, 0.0), (4, -2.25), (5, None), (6, 100.0)])
def parse_money(spark, d):
    return _texts(spark, ["$1O.5", "1,234.50", "n/a", "0", "-2.25", "abc", "1OO"]).select("i", money.parse_money(F.col("t")).alias("money"))


@gold("i, strict, loose", [(0, "12.50", "12.50"), (1, "", "12.50"), (2, "1234.50", "1234.50"), (3, "", ""), (4, "5.00", "5.00")])
def amounts(spark, d):
    return _texts(spark, ["TOTAL 12.50", "cotal 12:50", "1,234.50", "none", "3.00 and 5.00"]).select("i", money.extract_amount(F.col("t")).alias("strict"), money.extract_amount_loose(F.col("t")).alias("loose"))


@gold("i, code, found", [(0, "USD", "$"), (1, "BRL", "R$"), (2, "CAD", None), (3, "EUR", "€"), (4, "GBP", None), (5, "CAD", "$"), (6, "USD", "$"), (7, "CAD", None)])
def currency(spark, d):
    return _texts(spark, ["US$", "R$", "??", "€", "gbp", "$", "$USD", None]).select("i", money.normalize_currency(F.col("t")).alias("code"), money.detect_currency(F.col("t")).alias("found"))


@gold("i, phone", [(0, "416-555-0199"), (1, "416-555-0199"), (2, "555-0199"), (3, None)])
def phone(spark, d):
    return _texts(spark, ["(416) 555 0199", "1-416-555-0199", "555-0199", "n/a"]).select("i", money.normalize_phone(F.col("t")).alias("phone"))


@gold("i, date", [(0, "2024-03-07"), (1, "2024-03-07"), (2, "2024-03-07"), (3, "2024-03-07"), (4, "2024-03-07"), (5, "soon"), (6, None)])
def dates(spark, d):
    return _texts(spark, ["3/7/2024", "7 Mar 2024", "2024-03-07", "2024.3.7", "March 7, 2024", "soon", "unknown"]).select("i", money.normalize_date(F.col("t")).alias("date"))


@gold("i, c100, c01, cnull", [(0, 85.0, 0.85, 85.0), (1, 100.0, 1.0, 100.0), (2, 85.0, 0.85, 85.0), (3, 100.0, 1.0, 100.0), (4, 0.0, 0.0, 0.0), (5, 0.0, None, None)])
def confidences(spark, d):
    df = _texts(spark, ["0.85", "1", "85", "130", "-2", None])
    return df.select("i", money.confidence_100(F.col("t")).alias("c100"), money.confidence_01(F.col("t")).alias("c01"), money.confidence_or_null(F.col("t")).alias("cnull"))


@gold("i, amount, cur, word", [(0, "12.50", "CA$", "12.50"), (1, "bread", None, "bread"), (2, "3.99", "€", "3.99"), (3, "40:75", None, "40.75"), (4, "12:30", None, "12:30"), (5, "5.99F", None, "5.99")])
def tokens_money(spark, d):
    df = _texts(spark, ["CA$12,50", "bread", "€3.99", "40:75", "12:30", "5.99F"]).withColumn("s", money.split_currency(F.col("t")))
    return df.select("i", F.col("s.amount").alias("amount"), F.col("s.currency").alias("cur"), money.normalize_word(F.col("t")).alias("word"))


@gold("i, amount", [(0, 7.98), (1, None), (2, 12.0), (3, 2.5)])
def rightmost_amount(spark, d):
    return _texts(spark, ["2 @ 3.99 7.98", "GST 5.00%", "TAX 13.00 12.00", "rate 5.00 2.50"]).select("i", money.rightmost_amount(F.col("t")).alias("amount"))


@gold("i, keyword, distance", [(0, "SUBTOTAL", 0), (1, "TOTAL", 0), (2, "TOTAL", 1), (3, None, None), (4, "SUBTOTAL", 1)])
def fuzzy_keyword(spark, d):
    df = _texts(spark, ["the subtotal is", "grand total", "totl", "banana", "subtotl"])
    return df.withColumn("m", text.best_keyword(F.col("t"), ["SUBTOTAL", "TOTAL", "TAX"])).select("i", "m.keyword", "m.distance")


@gold("i, word", [(0, "SUBTOTAL"), (1, "TOTAL"), (2, "TAX"), (3, "12.50"), (4, "apple"), (5, "")])
def summary_words(spark, d):
    return _texts(spark, ["Sub-total", "TOTOL", "Tax", "12.50", "apple", " "]).select("i", text.summary_word(F.col("t"), ["SUBTOTAL", "SUB-TOTAL"], ["TOTAL"], ["TAX", "GST"]).alias("word"))


@gold("i, weak, name", [(0, True, None), (1, False, "ORANGE JUICE"), (2, True, None), (3, True, None), (4, False, "BANANAS"), (5, True, None), (6, False, "COM BDS"), (7, True, None)])
def weak_names(spark, d):
    df = _texts(spark, ["KG", "ORANGE JUICE 4.99", "123456", "GROCERY", "BANANAS", "$3.99", "COM BDS", "BCDFG"])
    return df.select("i", text.is_weak_name(F.col("t")).alias("weak"), text.good_name(F.col("t")).alias("name"))


@gold("i, has_total, has_date, amounts, total_amount", [(0, True, True, 1, True), (1, False, False, 2, False)])
def quality_signals(spark, d):
    return _texts(spark, ["TOTAL 5.00 on 12/05/2024", "1.50 2.50"]).select("i", text.quality_signals(F.col("t")).alias("q")).select("i", F.col("q.has_total"), F.col("q.has_date"), F.col("q.amounts"), F.col("q.total_amount"))


@gold("i, route, full_route", [(0, "vision_image", "vision_image"), (1, "ocr_text", "ocr_text"), (2, "vision_image", "vision_image"), (3, "ocr_text", "vision_image"), (4, "ocr_text", "ocr_text")])
def llm_route(spark, d):
    good, plain = "BREAD 2.99\nMILK 4.49\nTOTAL 7.48", "one\ntwo\nthree"
    df = spark.createDataFrame([(0, "", True, None), (1, good, True, 0.9), (2, good, True, 0.1), (3, plain, True, 0.9), (4, "", False, None)], "i int, t string, image boolean, conf double")
    return df.select("i", text.llm_route(F.col("t"), F.col("image"), F.col("conf")).alias("route"), text.llm_route(F.col("t"), F.col("image"), F.col("conf"), free_tier=False).alias("full_route"))


@gold("i, family", [(0, "long_grocery"), (1, "default")])
def receipt_family(spark, d):
    df = spark.createDataFrame([(0, ["REAL", "CANADIAN", "PRODUCE", "1.2", "KG"], [0], False), (1, ["CAFE", "LATTE"], [0], False)], "i int, w array<string>, r array<int>, l boolean")
    return df.select("i", text.receipt_family(F.col("w"), F.col("r"), F.col("l")).alias("family"))


@gold("i, phone, address, total", [(0, "416-555-0199", "1200 MAIN BLVD TOWN 90210", "12.50"), (1, "", "", "")])
def header_fields(spark, d):
    df = spark.createDataFrame([(0, "Phone : 416-555-0199 1200 MAIN B vd TOWN 90210 TOTAL DUE 12.50"), (1, "nothing here")], "i int, t string").withColumn("w", F.split("t", " "))
    return df.select("i", text.phone_near(F.col("w")).alias("phone"), text.address_fallback(F.col("w")).alias("address"), text.total_fallback(F.col("t")).alias("total"))


ANSWERS = [
    'Here: ```json\n{"vendor": " Corner  Shop ", "phone": "4165550199", "date": "3/7/2024", "items": [{"name": "Tea", "price": 2.99}, 5, {"item_name": "Milk", "price": 0, "line_total": "4.49"}], "subtotal": 7.48, "tax": "0.37", "total": "$7.85", "currency": "$"}\n```',
    '{"vendor": null, "receipt_items": [{"name": "Jam", "line_price": "3.29", "confidence": 0.9}], "total": "n/a", "confidence": 77}',
    "no json here",
]


@gold("i, vendor, phone, date, items, subtotal, tax, total, currency, confidence", [
    (0, "Corner Shop", "416-555-0199", "2024-03-07", "1:Tea:2.99;3:Milk:4.49", 7.48, 0.37, 7.85, "CAD", 92.0), (1, None, None, None, "1:Jam:3.29", None, None, None, "CAD", 77.0), (2, None, None, None, None, None, None, None, None, None),
])
def llm_json_normalize(spark, d):
    df = _texts(spark, ANSWERS).withColumn("r", llm_json.receipt(F.col("t")))
    listed = F.array_join(F.transform("r.items", lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["name"], x["price"].cast("string"))), ";")
    return df.select("i", "r.vendor", "r.phone", "r.date", listed.alias("items"), "r.subtotal", "r.tax", "r.total", "r.currency", "r.confidence")


@gold("i, text", [(0, "a b"), (1, "x\ny"), (2, None)])
def ocr_text_fallback(spark, d):
    return _texts(spark, ['{"text": "a b"}', '{"rows": [{"text": " x "}, {"line_text": "y"}]}', "broken"]).select("i", llm_json.ocr_text(F.col("t")).alias("text"))


TOKENS = "receipt_id long, idx int, word string, label string, conf double, x1 int, y1 int, x2 int, y2 int, row_id int, zone string"


def token_table(spark: SparkSession, receipts: dict[int, list[tuple]]) -> DataFrame:
    """Tokens from (word, label, conf, x, y): boxes of 40 by 10 around x and y; rows and zones are derived."""
    rows = [(r, i, w, lab, c, x - 20, y - 5, x + 20, y + 5, None, None) for r, ts in receipts.items() for i, (w, lab, c, x, y) in enumerate(ts)]
    return spark.createDataFrame(rows, TOKENS)


MENU = {
    1: [("GREEN", "B-MENU.NM", 0.9, 100, 200), ("TEA", "I-MENU.NM", 0.8, 150, 200), ("2.99", "B-MENU.PRICE", 0.9, 700, 200), ("MILK", "B-MENU.NM", 0.9, 100, 240), ("4.49", "B-MENU.PRICE", 0.9, 700, 240), ("TOTAL", "B-SUM.TOTAL", 0.9, 100, 300), ("7.48", "I-SUM.TOTAL", 0.9, 700, 300)],
    2: [("5.00", "B-MENU.PRICE", 0.9, 700, 200), ("SOUP", "B-MENU.NM", 0.9, 100, 220), ("6.00", "B-MENU.PRICE", 0.9, 700, 260), ("PIE", "B-MENU.NM", 0.9, 100, 280)],
    3: [("TACO", "B-MENU.NM", 0.9, 100, 200), ("x7", "I-MENU.NM", 0.9, 150, 200), ("115.50", "B-MENU.PRICE", 0.9, 700, 200), ("16.50", "B-MENU.PRICE", 0.9, 700, 205), ("each", "O", 0.9, 760, 205)],
    4: [("CAKE", "B-MENU.NM", 0.9, 100, 200), ("55.00", "B-MENU.PRICE", 0.9, 650, 200), ("110.00", "B-MENU.PRICE", 0.9, 700, 200)],
    5: [("A", "O", 0.9, 100, 200), ("BAGEL$1.99", "O", 0.9, 150, 200), ("HOT", "O", 0.9, 100, 240), ("DOG", "O", 0.9, 150, 240), ("3.49", "O", 0.9, 700, 240)],
}


@gold('receipt_id, "group", kind, "start", text, conf', [(1, 0, "MENU.NM", 0, "GREEN TEA", 0.85), (1, 1, "MENU.PRICE", 2, "2.99", 0.9), (1, 2, "MENU.NM", 3, "MILK", 0.9), (1, 3, "MENU.PRICE", 4, "4.49", 0.9), (1, 4, "SUM.TOTAL", 5, "TOTAL 7.48", 0.9)])
def bio_sessions(spark, d):
    out = sequences.groups(token_table(spark, {1: MENU[1]}))
    return out.select("receipt_id", (F.col("group") - 1).alias("group"), "kind", "start", "text", F.round("conf", 6).alias("conf"))


@gold("receipt_id, pattern", [(1, "name_then_price"), (2, "price_then_name"), (3, "name_then_price"), (4, "name_then_price")])
def pattern_detect(spark, d):
    g = sequences.groups(token_table(spark, {k: MENU[k] for k in (1, 2, 3, 4)}))
    # the second receipt ends with a name after its last price, and its first price has none before it
    return sequences.pattern(g, reach=1).select("receipt_id", "pattern")


@gold("receipt_id, idx, raw_label, label, word", [
    (1, 0, "O", "B-SUM.SUBTOTAL", "Subtotal"), (1, 1, "O", "B-SUM.TAX", "Tax"), (1, 2, "O", "B-SUM.TOTAL", "Total"), (1, 3, "O", "B-SUM.SUBTOTAL", "33.90"), (1, 4, "O", "B-SUM.TAX", "3.39"), (1, 5, "O", "B-SUM.TOTAL", "37.29"), (1, 6, "B-MENU.NM", "B-MENU.NM", "Visa"),
])
def label_chain_summary(spark, d):
    words = [("Subtotal", "O", 0.9, 100, 500), ("Tax", "O", 0.9, 100, 530), ("Total", "O", 0.9, 100, 560), ("33.90", "O", 0.9, 700, 500), ("3.39", "O", 0.9, 700, 530), ("37.29", "O", 0.9, 700, 560), ("Visa", "B-MENU.NM", 0.9, 100, 600)]
    return labels.repair_labels(token_table(spark, {1: words})).select("receipt_id", "idx", "raw_label", "label", "word")


@gold("receipt_id, idx, label, word", [
    (1, 0, "B-MENU.NM", "ORG"), (1, 1, "I-MENU.NM", "APPLES"), (1, 2, "O", "0123456789"), (1, 3, "O", "MRJ"), (1, 4, "B-MENU.PRICE", "4.99"), (2, 0, "O", "Tel"), (2, 1, "B-MENU.NM", "Bagel"), (2, 2, "I-MENU.NM", "40.75"),
])
def label_chain_items(spark, d):
    grocery = [("ORG", "O", 0.9, 100, 300), ("APPLES", "B-MENU.NM", 0.9, 150, 300), ("0123456789", "I-MENU.NM", 0.5, 300, 300), ("MRJ", "I-MENU.NM", 0.9, 500, 300), ("4.99", "O", 0.9, 700, 300)]
    cafe = [("Tel", "B-MENU.NM", 0.9, 100, 50), ("Bagel", "I-MENU.NM", 0.9, 100, 300), ("40:75", "O", 0.9, 700, 300)]
    return labels.repair_labels(token_table(spark, {1: grocery, 2: cafe})).select("receipt_id", "idx", "label", "word")


@gold("receipt_id, item_no, name, price, unit_price, source", [
    (1, 1, "GREEN TEA", 2.99, None, "labeled_name_price"), (1, 2, "MILK", 4.49, None, "labeled_name_price"), (3, 1, "TACO x7", 115.5, 16.5, "labeled_name_price"), (4, 1, "CAKE", 110.0, 55.0, "labeled_name_price"),
    (5, 1, "BAGEL", 1.99, None, "unlabeled_embedded"), (5, 2, "HOT DOG", 3.49, None, "unlabeled_separate"),
])
def items_adaptive(spark, d):
    out = items.extract_items(token_table(spark, {k: MENU[k] for k in (1, 3, 4, 5)}))
    return out.select("receipt_id", "item_no", "name", "price", "unit_price", "source")


@gold("receipt_id, item_no, name, price, source", [(2, 1, "SOUP", 5.0, "labeled_price_name"), (2, 2, "PIE", 6.0, "labeled_price_name")])
def items_price_name(spark, d):
    return items.extract_items(token_table(spark, {2: MENU[2]}), "price_then_name").select("receipt_id", "item_no", "name", "price", "source")


@gold("receipt_id, item_no, name, price, source", [(1, 1, "SALAD", 7.0, "labeled_mixed_name_price"), (1, 2, "ITEM_NOT_DETECTED", 3.0, "labeled_mixed_orphan_price"), (1, 3, "ITEM_NOT_DETECTED", 2.0, "labeled_mixed_orphan_price")])
def items_mixed(spark, d):
    words = [("SALAD", "B-MENU.NM", 0.9, 100, 200), ("7.00", "B-MENU.PRICE", 0.9, 700, 200), ("note", "O", 0.9, 100, 240), ("word", "O", 0.9, 100, 250), ("here", "O", 0.9, 100, 255), ("3.00", "B-MENU.PRICE", 0.9, 700, 260), ("TART", "B-MENU.NM", 0.9, 100, 280), ("a", "O", 0.9, 1, 300), ("b", "O", 0.9, 1, 310), ("c", "O", 0.9, 1, 320), ("2.00", "B-MENU.PRICE", 0.9, 700, 340)]
    return items.extract_items(token_table(spark, {1: words}), "mixed").select("receipt_id", "item_no", "name", "price", "source")


@gold("receipt_id, subtotal, tax, total, pattern, n_items", [(1, 7.48, None, 7.48, "name_then_price", 2)], tax="DOUBLE")
def summary_extract(spark, d):
    out = items.extract_summary(token_table(spark, {1: MENU[1]}))
    return out.select("receipt_id", F.round("subtotal", 2).alias("subtotal"), F.round("tax", 2).alias("tax"), "total", "pattern", "n_items")


@query("""WITH t(i, subtotal, tax, total, s) AS (VALUES (0, NULL, NULL, NULL, 10.0), (1, 10.0, 11.0, NULL, 10.0), (2, 10.0, 0.5, NULL, 0.0), (3, 10.0, 0.5, 11.5, 0.0), (4, 10.0, 0.0, 11.5, 0.0)), a AS (SELECT i, coalesce(subtotal, CASE WHEN s > 0 THEN s END) AS subtotal, tax, total FROM t),
b AS (SELECT i, subtotal, CASE WHEN total IS NULL AND tax > subtotal THEN tax - subtotal WHEN total IS NULL AND tax IS NULL AND subtotal > 0 THEN 0 ELSE tax END AS tax, CASE WHEN total IS NULL AND tax > subtotal THEN tax WHEN total IS NULL AND tax IS NULL AND subtotal > 0 THEN subtotal ELSE coalesce(total, subtotal + tax) END AS total FROM a)
SELECT i, subtotal::DOUBLE AS subtotal, round(CASE WHEN subtotal <> 0 AND tax <> 0 AND total <> 0 AND abs(subtotal + tax - total) > 0.05 THEN total - subtotal ELSE tax END, 4)::DOUBLE AS tax, total::DOUBLE AS total FROM b""")
def summary_correct(spark, d):
    df = spark.createDataFrame([(0, None, None, None, 10.0), (1, 10.0, 11.0, None, 10.0), (2, 10.0, 0.5, None, 0.0), (3, 10.0, 0.5, 11.5, 0.0), (4, 10.0, 0.0, 11.5, 0.0)], "i int, subtotal double, tax double, total double, items_sum double")
    return summary.correct(df).select("i", "subtotal", F.round("tax", 4).alias("tax"), "total")


@gold("receipt_id, pre_total, gratuity, subtotal, tax", [(1, 55.51, 9.01, 50.05, 5.46)])
def summary_fuzzy(spark, d):
    values = spark.createDataFrame([(1, 64.52, v, True) for v in (50.05, 5.46, 55.51, 9.01, 64.52)], "receipt_id long, total double, value double, has_keyword boolean")
    g = summary.gratuity(values)
    parts = summary.split_pairs(values.join(g, "receipt_id").withColumn("base", F.col("pre_total")).select("receipt_id", "base", "value"))
    return g.join(parts, "receipt_id").select("receipt_id", "pre_total", "gratuity", "subtotal", "tax")


@gold("i, kept, total", [(0, "1.0,2.0,2.01", 5.01), (1, "", 0.0)])
def near_dedupe(spark, d):
    df = spark.createDataFrame([(0, [1.0, 1.004, 2.0, 2.01, 1.0]), (1, [])], "i int, v array<double>")
    return df.select("i", F.array_join(F.transform(tables.near_distinct(F.col("v")), lambda x: x.cast("string")), ",").alias("kept"), summary.distinct_sum(F.col("v")).alias("total"))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, value AS y FROM events),
r(user_id, idx, anchor, row_no) AS (SELECT user_id, idx, y, 0 FROM e WHERE idx = 0 UNION ALL SELECT e.user_id, e.idx, CASE WHEN abs(e.y - r.anchor) > 15 THEN e.y ELSE r.anchor END, r.row_no + CASE WHEN abs(e.y - r.anchor) > 15 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.idx = r.idx + 1)
SELECT user_id AS receipt_id, idx::INT AS idx, row_no::INT AS "row" FROM r""")
def row_ids(spark, d):
    e = adapters.priced_events(spark, d).select("receipt_id", (F.col("line_no") - 1).alias("idx"), F.col("price").cast("double").alias("y"))
    return sequences.row_ids(e)


@gold("receipt_id, idx, row", [(1, i, r) for i, r in enumerate((0, 0, 1, 1, 2, 2, 3))])
def row_ids_fixture(spark, d):
    df = spark.createDataFrame([(1, i, float(y)) for i, y in enumerate((10, 12, 40, 44, 60, 74, 90))], "receipt_id long, idx int, y double")
    return sequences.row_ids(df)


@gold("receipt_id, text", [(1, "GREEN TEA"), (1, "2.99"), (1, "MILK"), (1, "4.49"), (1, "TOTAL 7.48")])
def entity_merge(spark, d):
    return sequences.entities(token_table(spark, {1: MENU[1]})).select("receipt_id", "text")


@gold("receipt_id, last_total, first_summary", [(1, 6, 5), (2, None, None)])
def summary_boundary(spark, d):
    return sequences.summary_start(token_table(spark, {1: MENU[1], 2: MENU[2]}))


@gold("receipt_id, item_no, item_name, price, conf_mean", [(1, 1, "GREEN TEA", 2.99, 0.8667), (1, 2, "MILK", 4.49, 0.9)], item_no="BIGINT")
def reconstruct_items(spark, d):
    return sequences.reconstruct(token_table(spark, {1: MENU[1]})).select("receipt_id", "item_no", "item_name", "price", "conf_mean")


@query("""WITH w AS (SELECT doc_id AS receipt_id, generate_subscripts(l, 1) - 1 AS idx FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS l FROM documents))
SELECT receipt_id, c::INT AS chunk, count(*) AS n FROM w, unnest(range(0, 200)) t(c) WHERE idx >= c * 272 AND idx < c * 272 + 400 GROUP BY ALL""")
def chunk_windows(spark, d):
    words = adapters.read(spark, d, "documents").select(F.col("doc_id").alias("receipt_id"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("idx", "word"))
    return sequences.chunk_windows(words).groupBy("receipt_id", "chunk").agg(F.count("*").alias("n"))


LONG = [
    (1, 0, 0, "21-GROCERY", 100, 0.9), (1, 1, 1, "ORANGE JUICE", 130, 0.8), (1, 2, 2, "MRJ 4.99", 132, 0.7), (1, 3, 3, "BANANAS 1.25", 170, 0.9), (1, 4, 4, "WHITE BREAD", 210, 0.9), (1, 5, 5, "2.49", 240, 0.6),
    (1, 6, 6, "SUBTOTAL 8.73", 300, 0.9), (1, 7, 7, "GST 5.00% 0.44", 330, 0.9), (1, 8, 8, "TOTAL 9.17", 360, 0.9),
]


@gold("receipt_id, item_no, name, price, source", [(1, 1, "ORANGE JUICE", 4.99, "long_row_layout_same_line"), (1, 2, "WHITE BREAD", 2.49, "long_row_layout_prev_line"), (1, 3, "BANANAS", 1.25, "long_row_seq_direct")])
def items_long(spark, d):
    rows = spark.createDataFrame(LONG, "receipt_id long, row_id int, start int, text string, y_top int, conf double")
    return long_rows.extract_long_items(rows).select("receipt_id", "item_no", "name", "price", "source")


@gold("receipt_id, subtotal, total, subtotal_confidence, total_confidence", [(1, 8.73, 9.17, 0.92, 0.92)])
def summary_rows(spark, d):
    rows = spark.createDataFrame(LONG, "receipt_id long, row_id int, start int, text string, y_top int, conf double")
    return summary.from_rows(rows)


@gold("i, subtotal, tax, total", [(0, 10.0, 0.5, 10.5), (1, 10.0, 1.5, 11.5), (2, 10.0, 0.5, 10.5), (3, 10.0, 0.5, 90.0)])
def summary_long(spark, d):
    df = spark.createDataFrame([(0, 10.0, None, 10.5), (1, 10.0, 0.1, 11.5), (2, 10.0, 0.5, None), (3, 10.0, 0.5, 90.0)], "i int, subtotal double, tax double, total double")
    return summary.correct_long(summary.tax_from_delta(df)).select("i", "subtotal", "tax", "total")


@gold("receipt_id, subtotal, tax", [(1, 8.5, 0.44), (2, 5.0, 0.3)])
def summary_merge(spark, d):
    schema = "receipt_id long, subtotal double, subtotal_confidence double, tax double, tax_confidence double"
    a = spark.createDataFrame([(1, 8.0, 0.5, 0.44, 0.9), (2, None, None, 0.3, 0.2)], schema)
    b = spark.createDataFrame([(1, 8.5, 0.92, 0.1, 0.5), (2, 5.0, 0.1, None, None)], schema)
    return summary.merge_sources(a, b, ("subtotal", "tax")).select("receipt_id", "subtotal", "tax")


__all__ = ["ORACLES", "QUERIES"]
