"""Queries for the remaining operators: block order, token splitting, look-ups, lists, export, workflow logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money, report, text
from ..operators import blocks, long_blocks, sequences, tables, validation, workflow
from ..sources import adapters, ocr
from . import api
from .fixtures import MENU, ORACLES, QUERIES, _texts, gold, token_table
from .queries import ITEMS, RECEIPTS, query

BLOCKS = "receipt_id long, pos int, text string, x1 int, y1 int, x2 int, y2 int"


@gold('receipt_id, place, "row", text', [(1, 0, 0, "MILK"), (1, 1, 0, "4.49"), (1, 2, 1, "TEA"), (1, 3, 1, "2.99"), (1, 4, 2, "TEA")])
def reading_order(spark, d):
    rows = [(1, 0, "TEA", 100, 140, 200, 160), (1, 1, "4.49", 700, 103, 760, 121), (1, 2, "MILK", 100, 100, 200, 120), (1, 3, "2.99", 700, 142, 760, 160), (1, 4, "tea", 100, 140, 200, 160), (1, 5, "TEA", 100, 300, 200, 320)]
    return blocks.order_blocks(spark.createDataFrame(rows, BLOCKS)).select("receipt_id", "place", "row", "text")


@gold("receipt_id, kept", [(1, 1), (2, 2), (3, 2)])
def iou_dedupe(spark, d):
    rows = [(1, 0, "a", 0, 0, 10, 10), (1, 1, "A ", 0, 0, 10, 10), (2, 0, "a", 0, 0, 10, 10), (2, 1, "a", 20, 20, 30, 30), (3, 0, "a", 0, 0, 10, 10), (3, 1, "b", 0, 0, 10, 10)]
    return blocks.order_blocks(spark.createDataFrame(rows, BLOCKS)).groupBy("receipt_id").agg(F.count("*").cast("int").alias("kept"))


@gold("i, tokens", [(0, "SB|GRAPE"), (1, "Subtotal"), (2, "Table|12"), (3, "3kg"), (4, "01:15PM"), (5, "Thank"), (6, "BEEF)|12.00"), (7, "AB12"), (8, "5|Rolls"), (9, ""), (10, "#123|20.05.2023")])
def smart_split(spark, d):
    df = _texts(spark, ["SBGRAPE", "Sub total", "Table12", "3kg", "01:15PM", "Than k", "BEEF)12.00", "AB12", "5Rolls", "", "#123 20.05.2023"])
    return df.select("i", F.array_join(blocks.split_tokens(F.col("t")), "|").alias("tokens"))


@gold("receipt_id, name", [(1, "raw"), (2, "gray")])
def variant_choice(spark, d):
    v = spark.createDataFrame([(1, "raw", 5.0, False, 9.0), (1, "gray", 4.0, False, 1.0), (1, "thin", 0.1, False, 99.0), (2, "gray", 3.0, False, 2.0), (2, "raw", 1.0, True, 2.0), (2, "raw", 0.5, True, 50.0)], "receipt_id long, name string, cheap_score double, must_try boolean, score double")
    return blocks.best_variant(blocks.rank_variants(v, 2))


@gold("receipt_id, row_id, text, x1, x2, zone", [(1, 0, "GREEN TEA 2.99", 80, 720, "body"), (1, 1, "MILK 4.49", 80, 720, "body")])
def line_summary(spark, d):
    t = token_table(spark, {1: MENU[1][:5]}).withColumns({"row_id": F.when(F.col("idx") < 3, 0).otherwise(1), "zone": sequences.zone_of(F.col("y1"), F.col("y2"))})
    return sequences.lines(t).select("receipt_id", "row_id", "text", "x1", "x2", "zone")


@gold("receipt_id, row_id, text, prices, has_name, has_price, has_summary", [(1, 0, "GREEN TEA 2.99", "2.99", True, True, False), (1, 1, "TOTAL 7.48", "", False, False, True)])
def row_build(spark, d):
    t = token_table(spark, {1: MENU[1][:3] + MENU[1][5:]}).withColumn("row_id", F.when(F.col("idx") < 3, 0).otherwise(1))
    return sequences.rows(t).select("receipt_id", "row_id", "text", F.array_join("prices", ",").alias("prices"), "has_name", "has_price", "has_summary")


@gold("receipt_id, row_id, line", [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 2)])
def physical_lines(spark, d):
    df = spark.createDataFrame([(1, 0, 100), (1, 1, 112), (1, 2, 116), (1, 3, 140)], "receipt_id long, row_id int, y_top int")
    return sequences.physical_lines(df).select("receipt_id", "row_id", "line")


@gold("receipt_id, idx, word", [(1, 0, "5 BLVD"), (1, 4, "x")])
def same_box_merge(spark, d):
    rows = [(1, 0, "5", 0, 0, 9, 9), (1, 1, "B", 0, 0, 9, 9), (1, 2, "vd", 0, 0, 9, 9), (1, 3, "1", 20, 0, 29, 9), (1, 4, "x", 20, 0, 29, 9)]
    return sequences.same_box(spark.createDataFrame(rows, "receipt_id long, idx int, word string, x1 int, y1 int, x2 int, y2 int")).select("receipt_id", "idx", "word")


@gold("receipt_id, idx, around", [(2, 0, "5.00 SOUP"), (2, 1, "5.00 SOUP 6.00"), (2, 2, "SOUP 6.00 PIE"), (2, 3, "6.00 PIE")])
def context_window(spark, d):
    return token_table(spark, {2: MENU[2]}).select("receipt_id", "idx", sequences.context("word", 1, 1).alias("around"))


@gold("receipt_id, total, last", [(1, 8.0, 9.0)])
def argmax_later(spark, d):
    df = spark.createDataFrame([(1, 0, 7.0, 0.9), (1, 1, 8.0, 0.9), (1, 2, 9.0, 0.5)], "receipt_id long, idx int, value double, conf double")
    return df.groupBy("receipt_id").agg(sequences.argmax_later("value").alias("total"), F.max_by("value", "idx").alias("last"))


@gold("receipt_id, idx, label, conf", [(1, 0, "B", 0.9), (1, 1, "C", 0.8)])
def chunk_merge(spark, d):
    df = spark.createDataFrame([(1, 0, 0, "A", 0.5), (1, 0, 1, "B", 0.9), (1, 1, 0, "A", 0.8), (1, 1, 1, "C", 0.8)], "receipt_id long, idx int, chunk int, label string, conf double")
    return sequences.merge_chunks(df)


@gold("receipt_id, idx, changed", [(1, 0, False), (1, 1, True)])
def prediction_log(spark, d):
    df = spark.createDataFrame([(1, 0, "a", "O", "O", 0.5), (1, 1, "b", "O", "B-X", 0.5)], "receipt_id long, idx int, word string, raw_label string, label string, conf double")
    return sequences.prediction_log(df).select("receipt_id", "idx", "changed")


@query(f"""WITH {ITEMS}, c AS (SELECT receipt_id, line_no, name_conf / 100.0::DOUBLE AS n, price_conf / 100.0::DOUBLE AS p FROM items) SELECT receipt_id, line_no, CASE WHEN n >= 0.7 AND p >= 0.7 THEN 'high' ELSE 'low' END AS tier FROM c""")
def confidence_split(spark, d):
    i = adapters.items(spark, d).withColumns({"name_confidence": F.col("name_conf") / F.lit(100.0), "price_confidence": F.col("price_conf") / F.lit(100.0)})
    return validation.confidence_split(i).select("receipt_id", "line_no", "tier")


@query(f"""WITH {ITEMS} SELECT receipt_id, line_no, CASE WHEN part_id % 7 = 0 THEN 'missing_price' ELSE '' END || CASE WHEN confidence < 60 THEN ',low_confidence' ELSE '' END AS issues, part_id % 7 <> 0 AND confidence >= 60 AS valid FROM items""")
def structural_validity(spark, d):
    i = adapters.items(spark, d).withColumns({"price": F.when(F.col("part_id") % 7 != 0, F.col("price")), "conf_mean": F.col("confidence") / F.lit(100.0)})
    got = validation.structurally_valid(i)
    show = F.concat(F.when(F.array_contains("issues", "missing_price"), "missing_price").otherwise(""), F.when(F.array_contains("issues", "low_confidence"), ",low_confidence").otherwise(""))
    return got.select("receipt_id", "line_no", show.alias("issues"), "valid")


@gold("wanted, path", [("/old/a.txt", "/data/a.txt"), ("/data/x/b.txt", "/data/x/b.txt"), ("/none", None)])
def path_resolution(spark, d):
    files = spark.createDataFrame([("/data/a.txt",), ("/data/b.txt",), ("/data/x/b.txt",)], "path string")
    return ocr.resolve_paths(spark.createDataFrame([("/old/a.txt",), ("/data/x/b.txt",), ("/none",)], "wanted string"), files)


@gold("source_id, pos, line", [("a", 0, "first"), ("a", 1, "second"), ("b", 0, "view")])
def best_text_lines(spark, d):
    files = spark.createDataFrame([("/t/a.txt", "first\n\n second "), ("/t/a_best.txt", "other"), ("/t/b_view.txt", "view")], "path string, value string")
    return ocr.best_text(files, spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string"))


@gold("i, url, kept", [(0, "/images/r.png", "processed/r_best_view.png"), (1, "/images/x.jpg", "/other/x.jpg")])
def image_paths(spark, d):
    return _texts(spark, ["/p/processed/r_best_view.png", "/other/x.jpg"]).select("i", ocr.image_url(F.col("t")).alias("url"), ocr.relative_path(F.col("t")).alias("kept"))


@gold("i, fine, first_box", [(0, True, "0,0,500,100"), (1, False, None)])
def ocr_check(spark, d):
    df = spark.createDataFrame([(0, ["a", "b"], [[0, 0, 2000, 10], [0, 0, 10, 10]], [4000, 100], [0], None), (1, ["a"], [], None, None, None)], "i int, words array<string>, bboxes array<array<int>>, image_size array<int>, row_ids array<int>, zones array<string>")
    good, bad = ocr.check(df)
    show = lambda x, ok, box: x.select("i", F.lit(ok).alias("fine"), box.alias("first_box"))
    return show(good, True, F.array_join(F.transform(F.get("bboxes", F.lit(0)), lambda v: v.cast("string")), ",")).unionByName(show(bad, False, F.lit(None).cast("string")))


@query(f"""WITH {RECEIPTS} SELECT receipt_id FROM receipts WHERE contains(lower(vendor), '#00000001') OR contains(lower(status), 'fail')""")
def search_columns(spark, d):
    return tables.search_any(adapters.receipts(spark, d), "#00000001", ["vendor"]).unionByName(tables.search_any(adapters.receipts(spark, d), "FAIL", ["status"])).select("receipt_id").distinct()


@gold("i, amount", [(0, 1250.0), (1, -3.5), (2, None)])
def dollar_sort(spark, d):
    return _texts(spark, ["$1,250.00", "-$3.50", "free"]).select("i", tables.dollars(F.col("t")).alias("amount"))


@gold("k, v", [("a", 1), ("b", 2), ("c", 5)])
def union_priority(spark, d):
    s = "k string, v int"
    one, two = spark.createDataFrame([("a", 1), ("b", 2)], s), spark.createDataFrame([("b", 4), ("c", 5)], s)
    return tables.union_by_priority([one, two], [F.col("k")], "v")


@query(f"""WITH {RECEIPTS} SELECT receipt_id, '{{"receipt_id":' || receipt_id || ',"status":"' || status || '","total":' || total || '}}' AS json FROM receipts""")
def export_json(spark, d):
    return tables.json_rows(adapters.receipts(spark, d).select("receipt_id", "status", "total"))


@gold("receipt_id, status, review, run, refused", [(1, "Processed", "approved", 7, 1), (2, "Pending", "not_requested", None, 1), (3, "Pending", "approved", 5, 0)], run="BIGINT")
def workflow_fold(spark, d):
    log = [(1, 1, "save", None), (1, 2, "stage_run", 7), (1, 3, "ui_approve", None), (1, 4, "fail", None), (2, 1, "reject_run", 3), (3, 1, "stage_run", 5), (3, 2, "reject_run", 5), (3, 3, "approve_run", 5)]
    return workflow.fold_events(spark.createDataFrame(log, "receipt_id long, seq long, action string, llm_run_id long"))


@query(f"WITH {RECEIPTS} SELECT receipt_id, NULL::VARCHAR AS phone, status FROM receipts")
def additive_columns(spark, d):
    r = adapters.receipts(spark, d).select("receipt_id", "status")
    return workflow.add_columns(r, {"phone": "string", "status": "string"})


@query(f"""WITH {RECEIPTS} SELECT receipt_id, CASE WHEN receipt_id % 3 = 0 THEN receipt_id * 100 + 2 ELSE active_llm_run_id END AS active_llm_run_id, CASE WHEN receipt_id % 3 = 0 THEN 'pending' ELSE ai_review_status END AS ai_review_status FROM receipts""")
def stage_runs(spark, d):
    r = adapters.receipts(spark, d)
    runs = r.filter("receipt_id % 3 = 0").select("receipt_id", F.explode(F.array(F.col("receipt_id") * 100 + 1, F.col("receipt_id") * 100 + 2)).alias("llm_run_id"))
    return workflow.stage_run(r, runs).select("receipt_id", "active_llm_run_id", "ai_review_status")


@gold("i, label, thousands, back, prefix", [(0, "AB", "1 234 567.50", 1234567.5, 12.5), (1, "?", "0.00", 0.0, None)])
def display_formats(spark, d):
    df = spark.createDataFrame([(0, " anna  bell carr", 1234567.5, "12:5-"), (1, "", 0.0, "x")], "i int, v string, m double, p string")
    shown = money.format_thousands(F.col("m"))
    return df.select("i", text.initials(F.col("v")).alias("label"), shown.alias("thousands"), money.parse_thousands(shown).alias("back"), money.price_prefix(F.col("p")).alias("prefix"))


@gold("i, box, angle", [(0, "1.0,2.0,11.0,6.0", 0.0)])
def quads(spark, d):
    df = spark.createDataFrame([(0, [[1.0, 2.0], [11.0, 2.0], [11.0, 6.0], [1.0, 5.0]])], "i int, q array<array<double>>")
    return df.select("i", F.array_join(F.transform(money.quad_to_box(F.col("q")), lambda v: v.cast("string")), ",").alias("box"), money.edge_angle(F.col("q")).alias("angle"))


@gold("i, lines", [(0, "Soda 27.36|Subtotal 2.60|thanks")])
def pseudo_lines(spark, d):
    df = spark.createDataFrame([(0, ["Soda", "27.36", " ", "Subtotal", "2.60", "thanks"])], "i int, w array<string>")
    return df.select("i", F.array_join(text.pseudo_lines(F.col("w")), "|").alias("lines"))


@query("""WITH t AS (SELECT doc_id AS receipt_id, text FROM documents) SELECT receipt_id, round(10 * 0.5 + 2 * ln(1 + len(regexp_extract_all(text, '\\p{L}')) + len(regexp_extract_all(text, '\\p{Nd}'))) + ln(1 + len(regexp_extract_all(text, '\\p{Nd}')))
+ 1.5 * ln(1 + len(list_filter(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: trim(x) <> ''))) - 2 * ln(1 + len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s.,:;/$%()\\-+*#&@''"]'))), 4) AS score FROM t WHERE trim(text) <> ''""")
def text_scores(spark, d):
    t = adapters.read(spark, d, "documents").select(F.col("doc_id").alias("receipt_id"), "text").filter("trim(text) <> ''")
    return t.select("receipt_id", F.round(text.text_score(F.col("text"), F.lit(0.5)), 4).alias("score"))


@gold("i, total, subtotal, tax, tip, value", [(0, True, False, False, False, 12.5), (1, True, True, False, False, 10.0), (2, False, False, True, False, 0.5), (3, False, False, False, True, 2.0), (4, False, False, True, False, None), (5, False, False, False, False, None)])
def summary_lines(spark, d):
    df = _texts(spark, ["Grand Total $12.50", "SUBTOTAL 10.00", "GST 0.50", "Gratuity 2.00", "GST 5%", "12:30 pm"]).withColumn("r", report.summary_line(F.col("t"), ["GST", "HST", "TAX"]))
    return df.select("i", "r.total", "r.subtotal", "r.tax", "r.tip", "r.value")


@gold("i, line", [(0, "  3 | green tea          B-MENU.NM        0.950"), (1, " 12 | a very long word t O                0.000")])
def prediction_lines(spark, d):
    df = spark.createDataFrame([(0, 3, "green  tea", "B-MENU.NM", 0.95), (1, 12, "a very long word that goes on", None, None)], "i int, idx int, word string, label string, conf double")
    return df.select("i", report.prediction_line(F.col("idx"), F.col("word"), F.col("label"), F.col("conf")).alias("line"))


@gold("receipt_id, vendor, address, phone, date", [(1, "CORNER SHOP", "1 MAIN ST", "555", "12/05/2024")])
def header_entities(spark, d):
    df = spark.createDataFrame([(1, 0, "HEAD.VENDOR", "CORNER SHOP SHOP"), (1, 5, "HEAD.ADDRESS", "MAIN ST"), (1, 3, "HEAD.ADDRESS", "1"), (1, 7, "HEAD.PHONE", "555"), (1, 8, "HEAD.DATE", "on 12/05/2024 at")], "receipt_id long, start int, kind string, text string")
    return report.header_fields(df)


@gold("total, ok, failed", [(3, 2, 1)], total="BIGINT", ok="BIGINT", failed="BIGINT")
def batch_counters(spark, d):
    return report.batch_summary(spark.createDataFrame([(None,), (None,), ("bad",)], "error string"))


@gold("i, total, price, confidence", [(0, 10.5, 0.0, 100.0)])
def edited_values(spark, d):
    df = spark.createDataFrame([(0, 10.0, 0.5, -3.0, 140.0)], "i int, s double, t double, p double, c double")
    return df.withColumn("e", report.clamp_item(F.col("p"), F.col("c"))).select("i", report.edited_total(F.col("s"), F.col("t")).alias("total"), "e.price", "e.confidence")


@gold("receipt_id, item_sum, subtotal_ok, total_ok, validation_status, error", [(1, 10.77, True, True, "valid", None), (2, None, None, None, None, "no JSON object")], item_sum="DECIMAL(28,2)")
def auto_fix(spark, d):
    answer = '{"vendor": "X", "items": [{"name": "a", "price": 2.99}, {"name": "b", "price": 4.49}, {"name": "c", "price": 3.29}], "subtotal": 10.77, "tax": 0.54, "total": 11.31}'
    out = api.post_auto_fix(spark.createDataFrame([(1, answer), (2, "sorry")], "receipt_id long, response string"))
    return out.select("receipt_id", "item_sum", "subtotal_ok", "total_ok", "validation_status", "error")


LONG_TOKENS = [
    ("06038318930", "O", 0.9, 100, 130), ("ORANGE", "B-MENU.NM", 0.9, 200, 130), ("JUICE", "I-MENU.NM", 0.8, 260, 130), ("MRJ", "O", 0.9, 400, 130), ("4.99", "B-MENU.PRICE", 0.9, 700, 130),
    ("06038300001", "O", 0.9, 100, 170), ("WHITE", "O", 0.9, 200, 170), ("BREAD", "O", 0.9, 260, 170), ("RICE", "O", 0.9, 330, 170), ("CAKES", "O", 0.9, 380, 170), ("2.49", "O", 0.9, 700, 170), ("3.79", "O", 0.9, 760, 170),
    ("06038300002", "O", 0.9, 100, 210), ("BANANAS", "O", 0.9, 200, 210), ("06038300003", "O", 0.9, 100, 250), ("1.25", "O", 0.6, 700, 250),
    ("SUBTOTAL", "O", 0.9, 100, 300), ("12.52", "O", 0.9, 700, 300), ("TOTAL", "O", 0.9, 100, 330), ("13.02", "O", 0.9, 700, 330),
]


@gold("receipt_id, item_no, name, price, source", [(1, 1, "ORANGE JUICE", 4.99, "long_block_direct"), (1, 2, "WHITE BREAD", 2.49, "long_block_multi_split"), (1, 3, "RICE CAKES", 3.79, "long_block_multi_split"), (1, 4, "BANANAS", 1.25, "long_block_name_fwd")])
def items_blocks(spark, d):
    return long_blocks.extract_block_items(token_table(spark, {1: LONG_TOKENS})).select("receipt_id", "item_no", "name", "price", "source")


@gold("receipt_id, name, price", [(1, "ORANGE JUICE", 4.99), (1, "BANANAS", 1.25), (1, "WHITE BREAD RICE CAKES", 3.79)])
def long_receipt_items(spark, d):
    """The tokens without labels are one group that holds SUBTOTAL, so blocks end before it; rows go on to its row."""
    t = _rowed(spark)
    return long_blocks.extract_long(t)[0].select("receipt_id", "name", "price")


def _rowed(spark):
    return token_table(spark, {1: LONG_TOKENS}).withColumn("row_id", ((F.col("y1") - 125) / 10).cast("int"))


@gold("receipt_id, subtotal, tax, total", [(1, 12.52, 0.5, 13.02)])
def long_receipt_summary(spark, d):
    return long_blocks.extract_long(_rowed(spark))[1].select("receipt_id", "subtotal", "tax", "total")


__all__ = ["ORACLES", "QUERIES"]
