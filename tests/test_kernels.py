"""The grouped kernels without Spark, their invariants, and their agreement with the native forms."""

import random

from pyspark.sql import functions as F

from tillwright.functions import money
from tillwright.operators import items, labels, sequences, tables, validation, workflow
from tillwright.plans.fixtures import MENU, token_table


def page(words):
    return labels.Page([w[0] for w in words], [w[1] for w in words], [w[2] for w in words], [(w[3] - 20, w[4] - 5, w[3] + 20, w[4] + 5) for w in words])


def random_words(rng, n):
    kinds = ["O", "B-MENU.NM", "I-MENU.NM", "B-MENU.PRICE", "I-MENU.PRICE", "B-SUM.TOTAL", "B-SUM.TAX", "I-SUM.SUBTOTAL"]
    words = ["TEA", "4.99", "total", "Tax", "123456", "MRJ", "-3.00", "x2", "40:75", "Visa", "sub", "12", "gst4", "", "Crème"]
    return [(rng.choice(words), rng.choice(kinds), rng.random(), rng.randint(0, 1000), 130 + 20 * (i // 3)) for i in range(n)]


def test_chain_keeps_tokens_and_settles():
    rng = random.Random(4)
    for _ in range(60):
        words = random_words(rng, rng.randint(0, 25))
        p = labels.repair(page(words))
        assert len(p.labels) == len(words) and all(x == "O" or x[:2] in ("B-", "I-") for x in p.labels)
        again = list(p.labels)
        labels.zones(p)
        labels.zones(p)
        labels.orphan_prices(p)
        assert len(again) == len(p.labels)


def test_empty_and_single_tokens():
    assert labels.repair(page([])).labels == []
    assert items.adaptive([], [], [], []) == []
    g = items.group_tokens(["4.99"], ["B-MENU.PRICE"], [0.9], [(0, 0, 1, 1)])
    assert [(x.name, x.price) for x in items.adaptive(g, ["4.99"], ["B-MENU.PRICE"], [0.9])] == [("ITEM_NOT_DETECTED", 4.99)]


def test_each_price_group_is_used_once():
    rng = random.Random(9)
    for _ in range(80):
        words = random_words(rng, 20)
        g = items.group_tokens([w[0] for w in words], [w[1] for w in words], [w[2] for w in words], [(0, w[4], 1, w[4]) for w in words])
        prices = sum(x.price for x in g)
        for f in (items.price_then_name, items.mixed):
            assert len(f(g)) <= prices


def test_two_prices():
    assert items.total_and_unit(115.5, 16.5, "taco x7", False) == (115.5, 16.5)
    assert items.total_and_unit(55.0, 110.0, "cake", False) == (110.0, 55.0)
    assert items.total_and_unit(5.0, 7.3, "cake", False) is None
    assert items.total_and_unit(5.0, 7.3, "cake", True) == (7.3, 5.0)


def test_native_and_scalar_prices_agree(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("0123456789.,:-$ xOl1S") for _ in range(rng.randint(0, 8))) for _ in range(400)] + [None, "12:56", "40:00", "9.95-"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", money.parse_price(F.col("t")).alias("p")).collect()
    for r in got:
        assert r.p == items.price_of(values[r.i]), values[r.i]


def test_rows_do_not_depend_on_partitions(spark):
    t = token_table(spark, MENU)
    one = sorted(map(tuple, items.extract_items(t.repartition(1)).select("receipt_id", "item_no", "name", "price").collect()))
    many = sorted(map(tuple, items.extract_items(t.repartition(8)).select("receipt_id", "item_no", "name", "price").collect()))
    assert one == many and one


def test_region_split_is_signed(spark):
    df = spark.createDataFrame([(1, i, float(y)) for i, y in enumerate((0, 20, 60, 30, 70))], "receipt_id long, idx int, y double")
    assert [r.region for r in sequences.regions(df).orderBy("idx").collect()] == [0, 0, 1, 1, 2]


def test_outliers_by_hand(spark):
    df = spark.createDataFrame([(1, i, "x", float(p)) for i, p in enumerate((1, 2, 3, 4, 10))] + [(2, 0, "x", 1.0), (2, 1, "x", 900.0)], "receipt_id long, line_no int, item_name string, price double")
    assert [(r.receipt_id, r.price) for r in validation.price_outliers(df).collect()] == [(1, 10.0)]
    assert {r.receipt_id: r.status for r in validation.outlier_status(df).collect()} == {1: "OUTLIERS_FOUND", 2: "INSUFFICIENT_DATA"}


def test_item_status_by_hand(spark):
    rows = [(1, 1, "a", 1.0, 0.0, 0.0, False), (1, 2, "b", 1.0, 90.0, 60.0, False), (1, 3, "c", 1.0, 90.0, 60.0, False), (1, 4, "d", 1.0, 90.0, 90.0, True)]
    df = spark.createDataFrame(rows, "receipt_id long, line_no int, item_name string, price double, name_conf double, price_conf double, flagged boolean")
    out = validation.item_status(df, df.filter("item_name = 'c'")).orderBy("line_no").collect()
    assert [r.item_status for r in out] == ["OK", "LOW_CONF", "OUTLIER", "FLAGGED"] and out[2].status_reason.count("|") == 1


def test_fold_events(spark):
    log = [(1, 1, "save", None), (1, 2, "stage_run", 7), (1, 3, "ui_approve", None), (1, 4, "fail", None), (2, 1, "reject_run", 3), (3, 1, "stage_run", 5), (3, 2, "reject_run", 5), (3, 3, "approve_run", 5)]
    df = spark.createDataFrame(log, "receipt_id long, seq long, action string, llm_run_id long")
    got = {r.receipt_id: (r.status, r.review, r.refused) for r in workflow.fold_events(df).collect()}
    assert got == {1: ("Processed", "approved", 1), 2: ("Pending", "not_requested", 1), 3: ("Pending", "approved", 0)}


def test_page_numbers():
    assert tables.page_numbers(1, 3) == [1, 2, 3] and tables.page_numbers(5, 20) == [3, 4, 5, 6, 7] and tables.page_numbers(20, 20) == [16, 17, 18, 19, 20]


def test_multi_key_match_takes_the_best_right_row_of_a_key_before_the_join(spark):
    rng = random.Random(8)
    keys = [None, "", "hot", "hot", "hot", "a", "b", "c"]
    left = [(i, rng.choice(keys), rng.choice(keys)) for i in range(60)]
    right = [(i, rng.choice(keys), rng.choice(keys)) for i in range(40, 70)]
    l_, r_ = spark.createDataFrame(left, "id long, a string, b string"), spark.createDataFrame(right, "rid long, k string, j string")
    out = workflow.multi_key_match(l_, r_, "id", [F.col("a"), F.col("b")], [F.col("k"), F.col("j")])
    want = {}
    for i, *mine in left:
        hits = [(lp, rp, r[0]) for lp, key in enumerate(mine) if key for r in right for rp, k in enumerate(r[1:]) if k == key]
        want[i] = min(hits)[2] if hits else None
    assert {r.id: r.m_rid for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert "Aggregate [rkey" in plan[join:]  # else a key of n rows on either side makes n * n pairs


def test_a_suspicious_name_counts_in_its_own_receipt_only(spark):
    from tillwright.operators import validation

    items = spark.createDataFrame([(1, "TEA", 2.0), (2, "TEA", 3.0), (2, "MILK", None), (3, None, 1.0)], "receipt_id long, item_name string, price double")
    names = spark.createDataFrame([(1, "TEA"), (2, "MILK"), (3, None)], "receipt_id long, item_name string")
    got = sorted((r.receipt_id, r.item_name or "", r.flag, r.flag_reason) for r in validation.item_flags(items, names).collect())
    assert got == [(1, "TEA", "price_outlier", "Price outlier detected: $2.00"), (2, "MILK", "missing_price", "Missing price - not extracted from receipt"), (2, "TEA", "clean", "OK - passed validation"), (3, "", "clean", "OK - passed validation")]


def test_numbers_go_on_without_gaps(spark):
    from tillwright.operators.workflow import number_rows
    from pyspark.sql import functions as F

    old = spark.createDataFrame([(7,)], "id long")
    got = number_rows(spark.range(1000).repartition(7).withColumnRenamed("id", "v"), old, "id", F.col("v").desc()).collect()
    assert sorted((r.id, r.v) for r in got) == [(8 + i, 999 - i) for i in range(1000)]
    assert number_rows(spark.range(0).withColumnRenamed("id", "v"), old, "id", F.col("v")).count() == 0


def test_empty_tables_go_through_the_workflow(spark):
    from pyspark.sql import functions as F

    from tillwright.operators import review

    t, now = review.empty_tables(spark), F.current_timestamp()
    assert set(t) == {"receipts", "items", "validation", "summary", "runs", "run_items"}
    out = review.approve_runs(t, spark.createDataFrame([(5, "me")], "llm_run_id long, approved_by string"), now)
    assert [tuple(r) for r in out["rejects"].collect()] == [(5, "not_found")] and out["items"].count() == 0
    assert review.detail(t).count() == 0


def test_token_splitting_by_rule():
    from tillwright.operators import blocks

    cases = {
        "LGWATER": ["LG", "WATER"], "GLAZED HAM": ["GLAZED", "HAM"], "JUICE4.25": ["JUICE", "4.25"], "16Feb19": ["16Feb19"], "2024-02-16 9:24PM": ["2024-02-16", "9:24PM"], "Ba lance 3.10": ["Balance", "3.10"],
        "VAT:GB12": ["VAT:GB12"], "Table7": ["Table", "7"], "Table7 330ml": ["Table", "7", "330ml"], "-12,50": ["-12,50"], "12Eggs": ["12", "Eggs"], "AB12C": ["AB12C"], "ABCDEF12": ["ABCDEF", "12"],
        "thankyou": ["THANK", "YOU"], "3$4": ["3", "$4"], "see www.a1b.com": ["see", "www.a1b.com"], "": [], None: [],
    }
    assert {t: blocks.split_text(t) for t in cases} == cases
    assert list(blocks.protected("a 1:30 b 2.50kg")) == [(2, 6), (9, 15)]


def test_fuzzy_summary_with_a_gratuity(spark):
    from tillwright.operators import summary

    rows = [
        (1, "Subtotal 50.05\nTax 5.46\nTotal 55.51\n18% Gratuity\nGratuity 9.01\nTotal 64.52"), (2, "Soda 27.36\nSubtotal 2.60\nTotal 29.96"), (3, "x\nitem a 1.00\nitem b 9.00"), (4, None), (5, "Subtotl 10.00\nTtal 11.30\nHST 1.30"),
    ]
    got = {r.receipt_id: (r.subtotal, r.tax, r.total, r.pre_total, r.gratuity) for r in summary.fuzzy(spark.createDataFrame(rows, "receipt_id long, text string")).collect()}
    assert got[1] == (50.05, 5.46, 64.52, 55.51, 9.01)
    assert got[2][:3] == (27.36, 2.6, 29.96) and got[3][2] == 9.0 and got[4] == (None,) * 5 and got[5][:3] == (None, 1.3, 11.3)  # the amount counts in the edit distance


def test_summary_rescue_and_row_tax(spark):
    from tillwright.operators import summary

    base = spark.createDataFrame([(1, None, None, 9.0, 0.0, 0.0, 0.5), (2, None, 1.0, None, 0.0, 0.9, 0.0)], "receipt_id long, subtotal double, tax double, total double, subtotal_confidence double, tax_confidence double, total_confidence double")
    first = spark.createDataFrame([(1, 8.0, 1.0)], "receipt_id long, subtotal double, total double")
    rows = spark.createDataFrame([(1, "HST 100.00 @ 13% 13.00"), (1, "GST 2.50"), (1, "GST 2.50"), (2, "Tax 44.00"), (2, "TOTAL TAX 3.00")], "receipt_id long, text string")
    taxes = summary.row_tax(rows)
    assert {r.receipt_id: r.tax for r in taxes.collect()} == {1: 2.5}
    got = {r.receipt_id: tuple(r)[1:] for r in summary.rescue(base, first, taxes.select("receipt_id", "tax")).collect()}
    assert got == {1: (8.0, 2.5, 9.0, 0.8, 0.92, 0.5), 2: (None, 1.0, None, 0.0, 0.9, 0.0)}


def test_a_failing_receipt_does_not_stop_the_others(spark):
    from tillwright.operators import items

    rows = [(1, 0, "TEA", "B-MENU.NM", 0.9, 0, 0, 9, 9), (1, 1, "2.99", "B-MENU.PRICE", 0.9, 20, 0, 29, 9), (None, 0, "TEA", "B-MENU.NM", 0.9, 0, 0, 9, 9), (None, 1, "2.99", "B-MENU.PRICE", 0.9, 20, 0, 29, 9)]
    t = spark.createDataFrame(rows, "receipt_id long, idx int, word string, label string, conf double, x1 int, y1 int, x2 int, y2 int")
    good = items.extract_items(t).collect()
    assert all(r.receipt_id == 1 for r in good)
    errors = items.extract_items(t, with_errors=True).filter("error is not null").collect()
    assert len(errors) == 1 and errors[0].receipt_id is None and errors[0].name is None


def test_batches_that_name_a_receipt_twice(spark):
    from tillwright.operators import review

    empty = review.empty_tables(spark)
    t = dict(empty)
    t["receipts"] = spark.createDataFrame([(1, "Pending", "pending", 11), (2, "Processed", "approved", None)], "receipt_id long, status string, ai_review_status string, active_llm_run_id long").select(
        "receipt_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in empty["receipts"].schema if f.name not in ("receipt_id", "status", "ai_review_status", "active_llm_run_id")), "status", "ai_review_status", "active_llm_run_id").select(*empty["receipts"].columns)
    now = F.lit("2001-01-01").cast("timestamp")
    asked = spark.createDataFrame([(1, "Failed", 1), (1, "Processed", 2), (1, "Error", 3), (1, "x", 4), (2, "Failed", 5), (9, "Failed", 6), (9, "Failed", 7), (None, None, 8)], "receipt_id long, new_status string, seq int")
    out, rejects = review.set_status(t["receipts"], asked, now)
    assert sorted((r.receipt_id, r.status) for r in out.collect()) == [(1, "Processed"), (2, "Processed")]
    assert sorted((str(r.receipt_id), str(r.new_status), r.reason) for r in rejects.collect()) == [
        ("1", "Error", "superseded"), ("1", "Failed", "superseded"), ("1", "x", "bad_status"), ("2", "Failed", "read_only"), ("9", "Failed", "not_found"), ("9", "Failed", "not_found"), ("None", "None", "not_found")]
    assert review.set_status(t["receipts"], asked.limit(0), now)[0].count() == 2
    item = "struct<line_no:int,item_name:string,currency:string,unit_price:double,confidence:double>"
    kind = f"receipt_id long, vendor string, receipt_date string, subtotal double, tax double, total double, summary_vendor string, summary_phone string, summary_address string, summary_receipt_date string, items array<{item}>"
    edit = lambda k, v, tax: (k, v, None, 1.0, tax, 2.0, v, None, None, None, [(1, v, "usd", 1.0, 5.0)])
    edits = spark.createDataFrame([edit(1, "b", 1.0), edit(1, "a", 1.0), edit(1, "a", 1.0), edit(1, "0", None), edit(2, "c", 1.0), edit(7, "d", 1.0)], kind)
    got = review.approve_edits(t, edits, now)
    assert [(r.receipt_id, r.vendor) for r in got["receipts"].orderBy("receipt_id").collect()] == [(1, "a"), (2, None)]
    assert [(r.receipt_id, r.item_name) for r in got["items"].collect()] == [(1, "a")] and [(r.receipt_id, r.vendor) for r in got["summary"].collect()] == [(1, "a")]
    assert sorted((r.receipt_id, r.reason) for r in got["rejects"].collect()) == [(1, "missing_amount"), (1, "read_only"), (1, "read_only"), (2, "read_only"), (7, "not_found")]
    answer = "receipt_id long, seq long, route_used string, set_active boolean, vendor string, receipt_date string, subtotal double, tax double, total double, currency string, confidence double, items array<struct<name:string,qty:double,unit_price:double,price:double,currency:string,confidence:string>>"
    answers = spark.createDataFrame([(1, 5, "ocr_text", True, v, None, 1.0, 1.0, 2.0, None, 0.5, []) for v in ("b", "a")] + [(8, 1, "ocr_text", True, "z", None, 1.0, 1.0, 2.0, None, 0.5, [])], answer)
    staged = review.stage_runs(t, answers, now)
    assert [(r.llm_run_id, r.vendor) for r in staged["runs"].orderBy("llm_run_id").collect()] == [(1, "a"), (2, "b")]
    assert [tuple(r) for r in staged["rejects"].collect()] == [(8, 1, "not_found")] and staged["receipts"].filter("active_llm_run_id = 2").count() == 1
    twice = spark.createDataFrame([(1, "me"), (1, "you"), (5, "me"), (5, "me")], "llm_run_id long, approved_by string")
    runs = staged | {"receipts": t["receipts"], "items": t["items"]}
    assert [tuple(r) for r in review.approve_runs(runs, twice, now)["rejects"].collect()] == [(5, "not_found")] and review.approve_runs(runs, twice, now)["receipts"].count() == 2
    assert review.reject_runs(runs, twice.withColumnRenamed("approved_by", "rejected_by"), now)["receipts"].count() == 2


def test_money_spans_are_those_of_a_scan(spark):
    import re

    texts = ["", "1.00 11.00 1.00", "GST 21.00 @ 5.00 % 1.05", "a-1,50b$2.005 3.0 .44 é9.99", "7.77 7.77", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", "t", money.money_spans(F.col("t")).alias("s")).collect():
        assert [(s.start, s.end, s.raw) for s in r.s or []] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[-+]?\$?\d+[.,]\d{2}", r.t or "")]


def test_long_summary_by_rule(spark):
    """Surest label, amount up to two groups after a tax word, base and rate, sums that don't fit."""
    from tillwright.operators import long_blocks

    def receipt(k, *lines):
        return [(k, 100 * i + j, w, lab, conf, 100 * j, 30 * i, 100 * j + 80, 30 * i + 20, i) for i, line in enumerate(lines) for j, (w, lab, conf) in enumerate(line)]

    sub = lambda v, c=0.9: [("SUBTOTAL", "B-SUM.SUBTOTAL", c), (v, "I-SUM.SUBTOTAL", c)]
    tot = lambda v, c=0.9: [("TOTAL", "B-SUM.TOTAL", c), (v, "I-SUM.TOTAL", c)]
    rows = [
        *receipt(1, sub("100.00"), [("HST", "O", 0.9), ("12.50", "O", 0.9)]),  # no total row: the word TOTAL is in SUBTOTAL's
        *receipt(2, sub("10.00", 0.99), sub("20.00", 0.5), tot("31.05"), [("GST", "O", 0.9), ("20.00", "O", 0.9), ("@", "O", 0.9), ("5.25", "O", 0.9), ("%", "O", 0.9), ("1.05", "O", 0.9)]),
        *receipt(3, [("PST", "B-TAX", 0.9)], [("x", "B-MENU.NM", 0.9)], [("0.70", "B-MENU.PRICE", 0.9)], [("AMT", "B-SUM.TOTAL", 0.8), ("9.99", "I-SUM.TOTAL", 0.8)]),
        *receipt(4, [("hello", "O", 0.9)]),
        *receipt(5, [("COUPON", "O", 0.9), ("-3.00", "O", 0.9)], tot("50.00")),
    ]
    t = spark.createDataFrame(rows, "receipt_id long, idx int, word string, label string, conf double, x1 int, y1 int, x2 int, y2 int, row_id int")
    got = {r.receipt_id: r for r in long_blocks.extract_long(t)[1].collect()}
    assert (got[1].subtotal, got[1].tax, got[1].total) == (100.0, 0.0, 100.0)
    assert (got[2].subtotal, got[2].tax, got[2].total, got[2].subtotal_confidence) == (10.0, 1.05, 31.05, 0.99)  # the surest group; the difference is no tax
    assert (got[3].subtotal, got[3].tax, got[3].total, got[3].tax_confidence) == (None, 0.7, 9.99, 0.85)
    assert got[4].total is None and got[4].subtotal is None and got[4].total_confidence == 0.0
    assert (got[5].discount, got[5].discount_confidence, got[5].total) == (3.0, 0.9, 50.0)


def test_native_and_scalar_texts_agree(spark):
    """What the kernel of long receipts asks of a text is what the column functions say of it."""
    from tillwright.functions import scalar, text
    from tillwright.operators import summary

    rng = random.Random(6)
    words = ["TEA", "Crème", "ÉTOTAL", "total", "Subtotal", "GST", "5%", "5.00", "13", "$4.99", "1,25", "-3.00", "kg", "1.2 kg", "/kg", "EA", "INT 2", "MRJ", "GPHR)", "21-GROCERY", "dairy", "123456", "x", "XL", "bcdf", "a1b2", "(x)", "--", "ß", "visa", "THANK YOU", "REF#", "savings", "@", "²", "茶", "12:30", "\t", "  ", ""]
    texts = [*words, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(600))]
    c, u = F.col("t"), F.upper(F.trim("t"))
    spans = F.transform(money.money_spans(c), lambda m: F.struct(m["start"], m["end"], m["value"], m["raw"], money.is_tax_rate(m["raw"], m["value"])))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", text.good_name(c), text.is_weak_name(c), text.is_junk_row(c), text.is_section(u, True), text.is_footer(u, True), text.is_summary_anchor(c), text.name_key(c), spans)
    for i, *said, found in got.collect():
        t = texts[i]
        u = t.strip(" ").upper()
        assert said == [scalar.good_name(t), scalar.is_weak_name(t), scalar.is_junk_row(t), scalar.is_section(u), scalar.is_footer(u), scalar.is_summary_anchor(t), scalar.name_key(t)], t
        assert [tuple(x) for x in found] == [(*m, scalar.is_tax_rate(m[3], m[2])) for m in scalar.money_spans(t)], t
    values = [[round(rng.choice([1.0, 1.004, 1.005, 2.675, rng.random() * 9]), 3) for _ in range(4)] for _ in range(50)]
    for v, total, cents in spark.createDataFrame([(v,) for v in values], "v array<double>").select("v", summary.distinct_sum(F.col("v")), F.transform("v", lambda x: F.round(x, 2))).collect():
        assert (total, cents) == (scalar.distinct_sum(v), [scalar.to_cent(x) for x in v])


def test_chunks_against_a_plain_walk(spark):
    """Chunks that shrink, among them tokens with more pieces than a chunk holds."""
    rng = random.Random(4)
    receipts = {k: [rng.choice([1, 1, 2, 3, 40, 600]) if rng.random() < 0.1 else rng.randint(1, 3) for _ in range(n)] for k, n in enumerate([1, 5, 19, 20, 399, 400, 401, 1500])}
    rows = [(k, i, p) for k, ps in receipts.items() for i, p in enumerate(ps)]
    got = sequences.shrinking_windows(spark.createDataFrame(rows, "receipt_id long, idx int, pieces int").repartition(3))
    want = []
    for k, ps in receipts.items():
        start = chunk = 0
        while True:
            end = min(start + 400, len(ps))
            while True:
                read, seen = 0, 0
                for p in ps[start:end]:
                    if read >= 510:
                        break
                    read, seen = read + p, seen + 1
                if seen == end - start or end - start <= 20:
                    break
                end = start + max(20, int((end - start) * 0.85))
            want.append((k, chunk, start, end - 1, start + seen))
            chunk += 1
            if end >= len(ps):
                break
            start = end - 128 if end - 128 > start else end
    assert sorted(map(tuple, got.collect())) == want
    tokens = spark.createDataFrame(rows, "receipt_id long, idx int, pieces int")
    read = sequences.in_windows(got).withColumns({"label": F.lit("B-X"), "conf": F.lit(0.5)})
    merged = sequences.merge_chunks(read, tokens)
    assert merged.count() == len(rows) and merged.filter("label = 'O'").count() == len(rows) - sequences.in_windows(got).select("receipt_id", "idx").distinct().count()


def test_reconstruction_by_rule(spark):
    names = "receipt_id idx word label conf x1 y1 x2 y2".split()
    line = lambda *ws: [(1, i, w, lab, 0.9, i, 0, i + 1, 9) for i, (w, lab) in enumerate(ws)]
    words = line(("Costco", "B-MENU.NM"), ("9.99", "B-MENU.PRICE"), ("1234567", "O"), ("MILK", "I-MENU.NM"), ("2:50A", "B-MENU.PRICE"), (None, "O"), ("EGGS", "B-MENU.NM"), ("4.CO-", "B-MENU.PRICE"), ("0.5lb", "O"), ("tpd/12", "O"), ("3", "B-MENU.PRICE"), ("x", "I-MENU.PRICE"), ("JAM", "B-MENU.NM"), ("5.00", "B-MENU.PRICE"), ("Void", "O"), ("TEA", "B-MENU.NM"), ("1.00-", "B-MENU.PRICE"), ("PIE", "B-MENU.NM"), ("abc", "B-MENU.PRICE"))
    got = sequences.reconstruct(spark.createDataFrame(words, ", ".join(f"{c} {'string' if c in ('word', 'label') else 'double' if c == 'conf' else 'long'}" for c in names))).orderBy("item_no").collect()
    assert [(r.item_name, r.price, r.price_str, r.skus, r.weight, r.discounts, r.coupons) for r in got] == [
        ("MILK", 2.5, "2:50A", ["1234567"], None, [], []), ("EGGS", 3.0, "3", [], "0.5lb", ["4.CO-"], ["tpd/12"]), ("PIE", None, "abc", [], None, [], [])]
    assert got[1].tokens == ["EGGS", "3", "x", "0.5lb"]


def test_a_failing_long_receipt_or_label_page_does_not_stop_the_others(spark, monkeypatch):
    from tillwright.operators import streams

    def run(key, rows):
        if key == 2:
            raise ValueError("broken")
        return [(key, len(rows))]

    df = spark.createDataFrame([(k, i) for k in (1, 2, 3) for i in range(k)], "receipt_id long, idx int")
    fields = [("receipt_id", "long"), ("n", "int")]
    assert sorted(tuple(r) for r in streams.by_receipt(df, ("receipt_id", "idx"), "idx", streams.isolated(run, 2), fields).collect()) == [(1, 1), (3, 3)]
    with_error = streams.by_receipt(df, ("receipt_id", "idx"), "idx", streams.isolated(run, 2, True), [*fields, ("error", "string")]).collect()
    assert [r.error for r in sorted(with_error)] == [None, "ValueError: broken", None]
