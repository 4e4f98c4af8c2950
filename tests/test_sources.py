import json

from pyspark.sql import functions as F

from tillwright.operators import sequences
from tillwright.sources import ocr
from tillwright.streaming import ingest


def test_scan_and_check(spark, tmp_path):
    docs = {"a": {"id": "a", "words": ["X", "Y"], "bboxes": [[0, 0, 2000, 10], [0, 0, 10, 10]], "image_size": [4000, 100], "row_ids": [0]}, "b": {"id": "b", "words": ["X"], "bboxes": []}, "c": {"id": "c"}}
    for k, v in docs.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
    good, bad = ocr.check(ocr.scan_json(spark, str(tmp_path)))
    row = good.collect()
    assert [r.id for r in row] == ["a"] and row[0].bboxes[0] == [0, 0, 500, 100] and row[0].row_ids is None
    assert {r.id: r.error for r in bad.collect()} == {"b": "words and boxes differ in length", "c": "missing words or boxes"}
    t = sequences.explode_tokens(good.withColumn("receipt_id", F.lit(1)))
    assert [(r.idx, r.word, r.x2) for r in t.orderBy("idx").collect()] == [(0, "X", 500), (1, "Y", 2)]


def test_paths(spark):
    files = spark.createDataFrame([("/data/x/a_best.txt", "1\n\n 2 "), ("/data/a.txt", "9")], "path string, value string")
    got = ocr.best_text(files, spark.createDataFrame([("a",)], "source_id string")).collect()
    assert [(r.pos, r.line) for r in got] == [(0, "9")]
    r = ocr.resolve_paths(spark.createDataFrame([("/old/a.txt",), ("/none",)], "wanted string"), files).collect()
    assert {x.wanted: x.path for x in r} == {"/old/a.txt": "/data/a.txt", "/none": None}
    u = spark.createDataFrame([("/p/processed/r_best_view.png",)], "p string").select(ocr.image_url(F.col("p")), ocr.relative_path(F.col("p"))).first()
    assert tuple(u) == ("/images/r.png", "processed/r_best_view.png")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, day in enumerate(("2024-01-01", "2024-01-01", "2024-02-20")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"source_id": f"s{i}", "receipt_date": day, "total": 2.0}))
    s = ingest.receipt_stream(spark, str(tmp_path / "in"), "source_id string, receipt_date string, total double", 1)
    q = ingest.monthly_trend_stream(s).writeStream.outputMode("append").format("memory").queryName("trend").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["spend"], r["count"]) for r in spark.sql("SELECT * FROM trend").collect()] == [(4.0, 2)]


def test_paths_by_rank(spark):
    f = ["/d/in/a.png", "/d/doc/best_images/a.png", "/d/x/best_images/a.png", "/d/z/a.png", "/d/y/a.png"]
    wanted = spark.createDataFrame([("in/a.png", "/json/doc.json"), (" ", None), (None, None)], "wanted string, document string")
    for i, want in enumerate(["/d/in/a.png", "/d/doc/best_images/a.png", "/d/x/best_images/a.png", "/d/y/a.png"]):
        got = ocr.resolve_paths(wanted, spark.createDataFrame([(p,) for p in f[i:]], "path string"), "/d").collect()
        assert {r.wanted: r.path for r in got} == {"in/a.png": want, " ": None, None: None}


def test_store_reads_complete_versions_only(spark, tmp_path):
    from tillwright.sources.store import TableStore

    s = TableStore(spark, f"file://{tmp_path}/t")
    assert s.version() == 0
    assert s.write({"a": spark.range(3), "b": spark.range(1)}) == 1 and s.write({"a": spark.range(5)}) == 2
    spark.range(9).write.parquet(f"{s.root}/3/a")
    assert s.version() == 2 and s.read()["a"].count() == 5 and set(s.read()) == {"a"}
    assert s.write({"a": spark.range(7)}) == 3 and s.read()["a"].count() == 7


def test_upsert_stream_written_again(spark, tmp_path):
    from tillwright.sources.store import TableStore

    s = TableStore(spark, f"file://{tmp_path}/t")
    s.write({"r": spark.createDataFrame([], "receipt_id long, source_id string, seq long, total double")})
    run = ingest.upsert_batches(lambda: s.read()["r"], lambda df, n: s.write({"r": df}))
    batch = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "source_id string, seq long, total double")
    run(batch, 0)
    run(batch, 0)
    assert [tuple(r) for r in s.read()["r"].orderBy("receipt_id").select("receipt_id", "source_id", "total").collect()] == [(1, "a", 2.0), (2, "b", 3.0)]


def test_one_csv_and_broken_files(spark, tmp_path):
    import csv
    import glob

    from tillwright.operators import intake, tables

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": "a", "image_path": "x/a.png", "image_size": [10, 40], "words": ["TOTAL", "9.99"], "bboxes": [[0, 0, 1, 1]] * 2}, indent=2))
    (tmp_path / "in" / "b.json").write_text('{"id": "b", "words": [')
    good, bad = ocr.check(ocr.scan_json(spark, str(tmp_path / "in")))
    assert good.count() == 1 and [r.error for r in bad.collect()] == ["missing words or boxes"]
    rows = intake.ocr_csv_rows(good)
    for _ in range(2):
        tables.append_csv(rows, f"file://{tmp_path}/out")
    lines = [x for f in glob.glob(f"{tmp_path}/out/*.csv") for x in csv.reader(open(f))]
    assert len(rows.columns) == 18 and lines.count(rows.columns) == 2 and [x[0] for x in lines if x != rows.columns] == ["a.png"] * 2
