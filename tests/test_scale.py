"""What only shows on larger tables: keys, sums and plans that the small ones don't have."""

import datetime

import duckdb
import pytest

from tests.test_queries import normal
from tillwright.plans import registry as fixtures
from tillwright.sources import adapters

PARTS = [(k, f"red tea{k % 3}", "B", "T", k % 50 + 1, 1.0) for k in (*range(1, 8), 999_999, 1_000_000, 12_345_678, 3_000_000_000)]
#: Lines' quantities of an order; with 0.25 more each, sums of four are whole.
QUANTITIES = [(1, 1, 1, 1), (1, 1, 1, 2), (1, 2, 3, 6), (2, 3, 4, 5), (7, 8), (9, 9, 9), (1, 1, 2, 2)]
ORDERS = [(5 * i + k, q) for i, q in enumerate(QUANTITIES) for k in range(5)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d, day = str(tmp_path_factory.mktemp("odd")), datetime.datetime(2000, 1, 1)
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    write("part", PARTS, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    write("orders", [(k, k % 3, "FOP"[k % 3], 10.0 + k, day, "1") for k, _ in ORDERS], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    write("customer", [(k, f"c{k}", 0, 0.0, "x") for k in range(3)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    lines = [(k, i, 0, i, float(n), 10.0, 0.0, 0.0, "N", "O", day) for k, q in ORDERS for i, n in enumerate(q, 1)]
    write("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    write("supplier", [(k, f"s{k}", 0, 0.0) for k in range(40)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    return d


def same(spark, d, name):
    db = duckdb.connect()
    for t in ("part", "orders", "customer", "lineitem", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    df, want = fixtures.QUERIES[name](spark, d), db.sql(fixtures.ORACLES[name])
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got and got == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["uploads_and_tiles", "long_summaries_of_orders"])
def test_odd_keys_and_sums_match_sql(spark, folder, name):
    """Numbers of seven digits and more; subtotals that are exactly a tax's rate."""
    same(spark, folder, name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_are_not_broadcast(spark, folder):
    """However small a file looks: customers, parts, a batch of processed receipts."""
    from tillwright.plans.processed import _save

    saved = _save(spark, folder)
    for df in (adapters.receipts(spark, folder, False), adapters.items(spark, folder, False), saved["receipts"]):
        assert "Broadcast" not in plan(df)
    for name in ("validation", "summary", "items"):  # there only the first numbers of the ranges are
        assert plan(saved[name]).count("BroadcastHashJoin") == 1


def test_images_are_written_by_tasks(spark, folder, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_, **__):
        raise AssertionError("rows go through the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    same(spark, folder, "images_listed")


def test_label_lists_are_dealt_once(spark, folder):
    """One shuffle of the orders, none of their tokens; the labels are those of the token rows."""
    from pyspark.sql import functions as F

    from tillwright.operators import labels
    from tillwright.plans.label_steps import CASES, _case

    orders = adapters.read(spark, folder, "orders").select(F.col("o_orderkey").alias("receipt_id"), F.lit("1.25").alias("p")).repartition("receipt_id")
    assert plan(_case(orders, len(CASES) - 1)).count("Exchange hashpartitioning") == 1
    rows = [(k, i, w, lab, c, x, r * 30, x + 50, r * 30 + 20, r, z) for k in (1, 2) for i, (r, w, lab, c, x, z) in enumerate(CASES[-1][1])]
    t = spark.createDataFrame(rows, "receipt_id long, idx int, word string, label string, conf double, x1 int, y1 int, x2 int, y2 int, row_id int, zone string")
    long = labels.repair_labels(t).groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("idx", "label"))).alias("l")).select("receipt_id", F.col("l.label").alias("labels"))
    assert sorted(map(tuple, labels.label_lists(t).collect())) == sorted(map(tuple, long.collect()))


def test_words_are_read_once():
    """Readings of a word are remembered; the stream reads columns, with and without nulls."""
    import pyarrow as pa

    from tillwright.operators import items, streams

    items.tidy.cache_clear()
    assert [items.tidy(" 9.95* ") for _ in range(3)] == ["9.95"] * 3 and items.tidy.cache_info().misses == 1
    for given in ([1, 2], [1, None], [0.5, 2.0], ["a", "b", "a"], ["a", None], [[1], [2]]):
        assert streams.values(pa.array(given)) == given


def test_expressions_compute_texts_once(spark):
    """Within functions on arrays nothing is shared unless it is bound: the words' text, a word's letters."""
    from pyspark.sql import functions as F

    from tillwright.functions import text

    shown = lambda c: c._jc.toString() if hasattr(c, "_jc") else str(c)
    assert shown(text.tagger_words(F.col("w"))).count("array_join(") == 1
    assert shown(text.best_keyword(F.col("w"), ["TOTAL", "DUE"])).count("regexp_replace(") == 1
    assert shown(text.is_footer(F.col("w"))).count("upper(") == 1
    assert not any("upper(" in shown(f(F.col("w"), True)) for f in (text.is_footer, text.is_section))
    t = spark.createDataFrame([("TOTEL",), ("DUE",), ("cost",), ("it's",), ("",)], "w string")
    got = [r[0] and tuple(r[0]) for r in t.select(text.best_keyword(F.col("w"), ["TOTAL", "DUE", "it's"])).collect()]
    assert got == [("TOTAL", 1), ("DUE", 0), None, ("IT'S", 0), None]
    assert t.filter(text.best_keyword(F.col("w"), []).isNotNull()).count() == 0


def test_few_bytes_are_joined_in_a_task(spark, folder):
    """Shuffles' partitions are joined up to 1 MB, as their rows are laid out in many tokens; smaller bounds stand."""
    from tillwright import session

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        for given, want in (("64MB", session.JOINED_BYTES), ("16k", 16 << 10)):
            spark.conf.set(key, given)
            adapters.read(spark, folder, "lineitem")
            assert spark.conf.get(key) == f"{want}b"
    finally:
        spark.conf.set(key, before)


def test_items_hold_their_tokens_once(spark):
    """A list for an item, not one for each kind of token: names, prices and the rest come from it, in order."""
    from tillwright.operators import sequences

    rows = [(1, 0, "TEA", "B-MENU.NM"), (1, 1, "123456", "O"), (1, 2, "2.50", "B-MENU.PRICE"), (1, 3, "1.CO-", "I-MENU.PRICE"), (1, 4, "POT", "I-MENU.NM"), (1, 5, "NIL", "B-MENU.NM"), (1, 6, "devoid", "I-MENU.NM"), (1, 7, "1.00", "B-MENU.PRICE"), (1, 8, "PIE", "B-MENU.NM"), (1, 9, "3.00 void", "B-MENU.PRICE")]
    t = spark.createDataFrame([(*r, 0.5, 1, 2, 3, 4) for r in rows], "receipt_id long, idx int, word string, label string, conf double, x1 int, y1 int, x2 int, y2 int")
    got = sequences.reconstruct(t)
    assert got._jdf.queryExecution().analyzed().toString().count("collect_list(") == 1
    assert [(r.item_name, r.price, r.skus, r.discounts) for r in got.orderBy("item_no").collect()] == [("TEA POT", 2.5, ["123456"], ["1.CO-"]), ("NIL devoid", 1.0, [], [])]


def test_chunks_are_merged_where_they_are_dealt(spark):
    """Chunks and whole texts are shuffled, their words are not; a word that no chunk reads is O, a label without a word goes."""
    from pyspark.sql import functions as F

    from tillwright.operators import sequences
    from tillwright.session import partitions

    windows = spark.createDataFrame([(1, 0, 0, 2, 3), (1, 1, 2, 4, 4), (2, 0, 0, 1, 2)], "receipt_id long, chunk int, first int, last int, seen int")
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "a")], "receipt_id long, t string").repartition(partitions(spark), "receipt_id")
    tokens = texts.select("receipt_id", F.posexplode(F.split("t", " ")).alias("idx", "word"))
    read = sequences.in_windows(windows).withColumns({"label": F.concat(F.lit("L"), F.col("chunk").cast("string")), "conf": F.lit(0.5)})
    got = sequences.merge_chunks(read, tokens)
    assert plan(got).count("Exchange") == 2 and "Join" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "L0", 0.5), (1, 1, "L0", 0.5), (1, 2, "L1", 0.5), (1, 3, "L1", 0.5), (1, 4, "O", 0.0), (2, 0, "L0", 0.5)]


def test_receipts_without_a_run_do_not_meet_in_one_task(spark):
    """Only receipts that wait are dealt by their run's id, which is null for the others."""
    from pyspark.sql import functions as F

    from tillwright.operators import workflow

    receipts = spark.createDataFrame([(1, 11, "pending"), (2, None, "pending"), (3, 31, "approved"), (4, None, None), (5, 51, "pending")], "receipt_id long, active_llm_run_id long, ai_review_status string")
    items = spark.createDataFrame([(k, 1, f"tea{k}", 1.0) for k in range(1, 5)], "receipt_id long, line_no int, item_name string, price double")
    lines = spark.createDataFrame([(11, 1, "run11", 2.0), (31, 1, "run31", 2.0)], "llm_run_id long, line_no int, item_name string, line_price double")
    got = workflow.receipt_detail(receipts, items, run_items=lines)
    switch = workflow.ui_source_switch(receipts.withColumn("total", F.lit(1.0)), lines.select("llm_run_id", F.col("line_price").alias("total")), "total")
    for df in (got, switch):
        assert "hashpartitioning(active_llm_run_id" not in plan(df) and "hashpartitioning(__active" in plan(df)
    shown = [(r.receipt_id, [x.item_name for x in r["items"]], r.data_source) for r in got.orderBy("receipt_id").collect()]
    assert shown == [(1, ["run11"], "llm"), (2, ["tea2"], "receipt"), (3, ["tea3"], "receipt"), (4, ["tea4"], "receipt"), (5, [], "llm")]
    assert sorted(map(tuple, switch.collect())) == [(1, 2.0, "llm"), (2, 1.0, "receipt"), (3, 1.0, "receipt"), (4, 1.0, "receipt"), (5, 1.0, "receipt")]


def test_outliers_are_not_joined_back(spark, folder):
    """An item's status comes from windows over its receipt: the only join is that of parts."""
    same(spark, folder, "item_status")
    assert plan(fixtures.QUERIES["item_status"](spark, folder)).count("Join") == 1


def test_requests_are_dealt_before_they_are_made_distinct(spark):
    """No task holds the ids of a scan's whole split; a request made twice counts once."""
    from tillwright.operators import workflow

    receipts = spark.createDataFrame([(1, "Pending", "pending", 11), (2, "Processed", "pending", 21)], "receipt_id long, status string, ai_review_status string, active_llm_run_id long")
    asked = spark.createDataFrame([(1,), (2,), (1,), (2,), (3,)], "receipt_id long")
    done, refused = workflow.reject_runs(receipts, asked), workflow.reject_rejects(receipts, asked)
    for df in (done, refused):
        lines = plan(df).splitlines()
        depth = lambda what: [x.index(what) for x in lines if what in x]
        assert depth("HashAggregate") and max(depth("HashAggregate")) < max(depth("Exchange"))
    assert sorted((r.receipt_id, r.ai_review_status) for r in done.collect()) == [(1, "rejected"), (2, "pending")]
    assert sorted(map(tuple, refused.collect())) == [(2, "read_only"), (3, "not_found")]


def test_paths_are_grouped_where_they_are_joined(spark):
    """Both sides are dealt by name once, and no list of files is broadcast; a path wanted twice comes once, one without a file too."""
    from tillwright.sources import ocr

    files = spark.createDataFrame([("/d/a/best_images/1.png",), ("/d/x/1.png",), ("/d/b/best_images/1.png",), ("/d/in/2.png",), ("/d/b/2.png",), ("/d/j3/best_images/3.png",), ("/d/a/best_images/3.png",)], "path string")
    wanted = spark.createDataFrame([("in/1.png", "j1.json"), ("in/2.png", "j2.json"), ("in/2.png", "j2.json"), ("in/3.png", "j3.json"), ("in/4.png", None)], "wanted string, document string")
    got = ocr.resolve_paths(wanted, files, "/d")
    assert plan(got).count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("in/1.png", "/d/a/best_images/1.png"), ("in/2.png", "/d/in/2.png"), ("in/3.png", "/d/j3/best_images/3.png"), ("in/4.png", None)]


def test_odd_items_are_held_once(spark):
    """One list for a receipt's outliers and problematic items, besides that of its prices; three and two of them in order."""
    from tillwright.operators import validation

    rows = [(1, k, f"n{k}", "10.00" if k < 20 else "900.00") for k in range(21)] + [(2, 1, "a", "1.00")]
    items = spark.createDataFrame(rows, "receipt_id long, line_no int, item_name string, price string").selectExpr("receipt_id", "line_no", "item_name", "cast(price as decimal(18,2)) price")
    receipts = spark.createDataFrame([(1, "5.00"), (2, "1.00"), (3, None)], "receipt_id long, subtotal string").selectExpr("receipt_id", "cast(subtotal as decimal(18,2)) subtotal")
    got = validation.validate_all(receipts, items, with_items=True)
    assert got._jdf.queryExecution().analyzed().toString().count("collect_list(") == 2
    a, b, c = got.orderBy("receipt_id").collect()
    assert [(x.item_name, float(x.price), x.z_score) for x in a.problems] == [("n20", 900.0, 4.36)] and [(x.item_name, float(x.price)) for x in a.outliers] == [("n20", 900.0)]
    assert (a.outliers_count, a.price_range_warnings, a.outliers_status, b.outliers_status, c.outliers_status) == (1, 1, "OUTLIERS_FOUND", "INSUFFICIENT_DATA", "INSUFFICIENT_DATA")
    assert b.problems == [] and c.problems is None and c.subtotal_status == "SKIPPED" and len(a.recommendations) == 4 - (a.name_quality_issues == 0)


def test_fields_are_read_where_receipts_are_dealt(spark, folder):
    """One scan and one shuffle of the lines; a receipt's words are not laid out in rows, sorted or joined back."""
    shown = plan(fixtures.QUERIES["fields_of_receipts"](spark, folder))
    assert shown.count("Exchange hashpartitioning") == 1
    assert not any(step in shown for step in ("Sort", "Generate", "Window", "ObjectHashAggregate"))
    same(spark, folder, "fields_of_receipts")


def test_entity_lists_are_those_of_token_rows(spark):
    """Also for an I without its B, a change of type, O and null between, null words, no tokens at all."""
    from pyspark.sql import functions as F

    from tillwright.operators import sequences

    labels = ["I-A", "I-A", "B-A", "I-B", "O", "I-B", None, "I-B", "I-", "B-", "", "b-A", "I-SUM.TAX", "B-SUM.TAX"]
    words = ["w0", None, "", " w3 ", *(f"w{i}" for i in range(4, 14))]
    receipts = {1: list(zip(words, labels)), 2: [("x", "B-A")], 3: [("x", "O"), ("y", None)], 4: [], 5: None, 6: [(None, "B-A"), (None, "I-A"), ("z", "B-C")]}
    t = spark.createDataFrame(list(receipts.items()), "receipt_id long, r array<struct<word: string, label: string>>")
    tokens = t.select("receipt_id", F.posexplode("r").alias("idx", "w")).select("receipt_id", "idx", "w.word", "w.label", F.lit(0.9).alias("conf"))
    got = t.select("receipt_id", F.explode(sequences.entity_list(F.col("r"))).alias("e")).select("receipt_id", "e.*")
    want = sequences.entities(tokens)
    assert got.columns == want.columns and want.count() == 12
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_substitutes_search_the_words_once(spark):
    """The ZIP code's place and the repaired text are bound, not searched anew for each street number and branch."""
    from pyspark.sql import functions as F

    from tillwright.functions import money, text

    shown = lambda c: spark.range(1).select(F.array(F.lit("a")).alias("w"), F.lit("t").alias("t")).select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert shown(text.address_fallback(F.col("w"))).count("d{5}") == 1 and shown(money.extract_amount_loose(F.col("t"))).count("COTAL") == 1
    rows = [(["1", "4521", "OAK", "B", "vd", "G", "12345", "90210"],), (["12", "OAK"],), (["12345"],), (["99999", "OAK", "90210"],), (["455", *["x"] * 40, "90210"],), ([],), (None,), (["777", None, "90210"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "w array<string>").select(text.address_fallback(F.col("w"))).collect()]
    assert got == ["4521 OAK BLVD 12345", "", "", "", "", "", "", "777 90210"]
    amounts = [r[0] for r in spark.createDataFrame([("cotal 12:50",), ("due 1,234.50",), (None,), ("x",)], "t string").select(money.extract_amount_loose(F.col("t"))).collect()]
    assert amounts == ["12.50", "1234.50", "", ""]


@pytest.mark.parametrize("name", ["long_items_of_orders", "long_summaries_of_orders"])
def test_long_receipts_are_read_from_one_stream(spark, folder, name):
    """A long receipt's tokens are laid out and sorted once, however many ways it is read in, and its summary is not joined."""
    found = plan(fixtures.QUERIES[name](spark, folder))
    assert (found.count("MapInArrow"), found.count("Sort [receipt_id"), found.count("Generate posexplode"), found.count("SortMergeJoin")) == (1, 1, 3, 0)
    same(spark, folder, name)


def test_equal_pages_are_repaired_once(spark, folder, monkeypatch):
    """Receipts that are a row each: no token is laid out, sorted or shuffled; the labels are those of the token rows."""
    from pyspark.sql import functions as F

    from tillwright.operators import labels
    from tillwright.plans.label_steps import CASES

    found = plan(fixtures.QUERIES["label_steps_of_orders"](spark, folder))
    assert "Sort [" not in found and "posexplode" not in found
    pages = [*([(r, w, lab, c, x, z) for r, w, lab, c, x, z in tokens] for _, tokens, _ in CASES), [(5, None, None, None, None, None), (None, "total", "", 0.5, 700, None), (6, '"4.99\\\x1f', "O", 0.1, 700, "body")]]
    times = lambda c, by, more=0: None if c is None else c * by + more
    rows = [(k, i, w, lab, c, x, times(r, 30), times(x, 1, 50), times(r, 30, 20), r, z) for k in range(2 * len(pages)) for i, (r, w, lab, c, x, z) in enumerate(pages[k % len(pages)])]
    t = spark.createDataFrame(rows, "receipt_id long, idx int, word string, label string, conf double, x1 int, y1 int, x2 int, y2 int, row_id int, zone string")
    held = F.array_sort(F.collect_list(F.struct("idx", F.col("word"), F.struct("label", "conf", "x1", "y1", "x2", "y2", "row_id", "zone").alias("mark"))))
    whole = t.groupBy("receipt_id").agg(held.alias("t")).select("receipt_id", F.col("t.word").alias("words"), F.col("t.mark").alias("marks"))
    got = labels.label_pages(whole.unionByName(whole.limit(1).select(F.lit(99).cast("long").alias("receipt_id"), F.slice("words", 1, 0).alias("words"), F.lit(None).cast("array<struct<label:string,conf:double,x1:int,y1:int,x2:int,y2:int,row_id:int,zone:string>>").alias("marks"))))
    assert sorted(map(tuple, got.collect())) == sorted([*map(tuple, labels.label_lists(t).collect()), (99, [])])
    short = whole.filter("receipt_id = 0").select("receipt_id", "words", F.concat(F.slice("marks", 1, 1), F.array(F.lit(None))).alias("marks"))
    assert [r.labels for r in labels.label_pages(short).collect()] == [["O", "O", "O", "O"]]
    made = []
    monkeypatch.setattr(labels, "_repaired", lambda steps: lambda receipt, rows: made.append(rows) or [(receipt, i, w, lab, lab) for i, w, lab, *_ in rows])
    taken = []
    monkeypatch.setattr(type(whole), "mapInArrow", lambda df, f, schema: taken.append((df, f)) or df)
    labels.label_pages(whole)
    out = list(taken[0][1](iter(taken[0][0].toArrow().to_batches())))
    assert sum(b.num_rows for b in out) == 2 * len(pages) and len(made) == len(pages)


def test_only_the_asked_tables_are_written(spark, folder, monkeypatch):
    """A save of receipts numbers and stores no items, validations or summaries, and what it makes is what a whole save makes."""
    from tillwright.operators import workflow, writer
    from tillwright.plans import processed

    whole = {n: sorted(map(str, df.drop("created_at", "updated_at", "reviewed_at").collect())) for n, df in processed._save(spark, folder).items() if n in writer.WRITTEN}
    for asked in writer.WRITTEN:
        named = []
        for module in (workflow, writer, processed):
            kept = module.materialize
            monkeypatch.setattr(module, "materialize", lambda df, name, kept=kept: named.append((name, df.columns)) or kept(df, name))
        found = processed._save(spark, folder, asked)[asked]
        monkeypatch.undo()
        assert sorted(map(str, found.drop("created_at", "updated_at", "reviewed_at").collect())) == whole[asked]
        ids = {"receipts": "receipt_id", "validation": "validation_id", "summary": "summary_id", "items": "item_id"}
        assert {n for n, _ in named} == {"known", "numbered-receipt_id", "processed", "saved-receipts", f"saved-{asked}", f"numbered-{ids[asked]}"}
        assert all(set(c) & {"validation", "summary", "items"} == set(writer.READ[asked]) for n, c in named if n in ("known", "processed"))


def test_rows_of_one_seq_are_told_apart_by_their_text(spark):
    """Of rows of one source the largest seq is written, of equal ones the one whose text is larger; others need no text."""
    from pyspark.sql import functions as F

    from tillwright.operators import writer
    from tillwright.plans.review import _now

    none = {c: F.lit(None).cast("string") for c in ("job_id", "receipt_name", "receipt_date", "currency", "raw_json", "ocr_json", "predictionlog_json")}
    none |= {c: F.lit(None).cast("double") for c in ("subtotal", "tax", "total", "confidence")}
    none |= {"validation": F.lit(None).cast(writer.VALIDATION), "summary": F.lit(None).cast(writer.SUMMARY), "items": F.lit(None).cast(writer.ITEMS)}
    batch = spark.createDataFrame([("a", "x", 1), ("a", "b", 2), ("a", "c", 2), ("b", "z", None), ("b", "y", None), ("c", "q", 3), ("c", "r", 1)], "source_id string, vendor string, seq int").withColumns(none)
    t = {"receipts": spark.createDataFrame([], "receipt_id long, source_id string, vendor string, created_at timestamp")}
    got = writer.save_processed(t, batch, _now(), asked=("receipts",))["receipts"]
    assert sorted((r.source_id, r.vendor) for r in got.collect()) == [("a", "c"), ("b", "z"), ("c", "q")]
