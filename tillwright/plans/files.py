"""Queries that go through files and streams: what they read is written from whole tables to the shared folder first.
And the service's endpoints, each over the tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, intake, tables, workflow
from ..session import shared_dir
from ..sources import adapters, ocr
from ..sources.store import TableStore
from ..streaming import ingest
from . import api
from .processed import _save
from .queries import ITEMS, query
from .review import _BASE, MONEY, _k, _now, _tables


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex[:12]}"


# OCR documents as files

def _ocr_files(spark, d) -> str:
    """A JSON document per line for every order, words and boxes from its lines; each 40th is cut off, each 41st lacks a box."""
    i = adapters.items(spark, d).groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "item_name"))).alias("l"))
    words = F.transform("l", lambda x: x["item_name"])
    boxes = F.transform("l", lambda x: F.array(F.lit(10), x["line_no"] * 20, F.lit(90), x["line_no"] * 20 + 15))
    doc = F.struct(F.col("receipt_id").cast("string").alias("id"), F.concat(F.lit("r/"), F.col("receipt_id").cast("string"), F.lit(".png")).alias("image_path"), F.array(F.lit(1000), F.lit(3000)).alias("image_size"), words.alias("words"),
                   F.when(F.col("receipt_id") % 41 == 0, F.slice(boxes, 2, 1000)).otherwise(boxes).alias("bboxes"), F.lit(0.5).alias("mean_conf"))
    text = F.to_json(doc)
    folder = _folder(spark)
    i.select(F.when(F.col("receipt_id") % 40 == 0, F.substring(text, 1, 30)).otherwise(text).alias("value")).write.text(folder, lineSep="\n")
    return folder


@query(f"""WITH {ITEMS}, n AS (SELECT receipt_id, count(*) AS n FROM items GROUP BY 1)
SELECT CASE WHEN receipt_id % 40 <> 0 THEN receipt_id::VARCHAR END AS id, CASE WHEN receipt_id % 40 = 0 THEN 'missing words or boxes' WHEN receipt_id % 41 = 0 THEN 'words and boxes differ in length' END AS error, CASE WHEN receipt_id % 40 = 0 OR receipt_id % 41 = 0 THEN 0 ELSE n END::INT AS words FROM n""")
def ocr_files_scanned(spark, d):
    docs = spark.read.schema(ocr.SCHEMA).json(_ocr_files(spark, d)).withColumn("path", F.col("_metadata.file_path"))
    good, bad = ocr.check(docs)
    return good.select("id", F.lit(None).cast("string").alias("error"), F.size("words").alias("words")).unionByName(bad.select("id", "error", F.lit(0).alias("words")))


@query(f"""WITH {ITEMS} SELECT receipt_id::VARCHAR AS source_id, (row_number() OVER (PARTITION BY receipt_id ORDER BY line_no))::INT - 1 AS idx, item_name AS word, (line_no * 20)::INT AS y1 FROM items WHERE receipt_id % 40 <> 0 AND receipt_id % 41 <> 0""")
def ocr_tokens_of_files(spark, d):
    docs = spark.read.schema(ocr.SCHEMA).json(_ocr_files(spark, d)).withColumn("path", F.col("_metadata.file_path"))
    return intake.batch(docs)[0].select("source_id", "idx", "word", "y1")


def _write_files(spark, names: DataFrame, folder: str) -> None:
    """A file of one byte at each ``path`` under the shared folder. Tasks write them where the folder is mounted as files;
    in another store, which Python tasks can't write to, the driver does, one by one."""
    conf, new = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    fs = new(folder).getFileSystem(conf)
    if fs.getScheme() != "file":
        for r in names.toLocalIterator():
            out = fs.create(new(f"{folder}/{r.path}"))
            out.write(1)
            out.close()
        return
    top = fs.makeQualified(new(folder)).toUri().getPath()

    def write(rows) -> None:
        for r in rows:
            path = f"{top}/{r.path}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as out:
                out.write(b"\1")

    names.repartition(3 * spark.sparkContext.defaultParallelism).foreachPartition(write)


@query("""SELECT s_suppkey AS id, 'img' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpeg' ELSE '.webp' END AS name, 1::BIGINT AS length FROM supplier WHERE s_suppkey % 4 <> 3""")
def images_listed(spark, d):
    """A file for every supplier in nested folders, each fourth no image: images are found by their suffix."""
    folder, k = _folder(spark), F.col("s_suppkey")
    suffix = F.when(k % 4 == 0, ".png").when(k % 4 == 1, ".jpeg").when(k % 4 == 2, ".webp").otherwise(".txt")
    names = adapters.read(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("img"), k.cast("string"), suffix).alias("name"))
    _write_files(spark, names.select(F.concat((F.col("id") % 7).cast("string"), F.lit("/"), "name").alias("path")), folder)
    found = ocr.list_images(spark, folder).select(ocr.base_name(F.col("path")).alias("name"), "length")
    return found.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("id"), "name", "length")


# sinks

@query(_BASE + " SELECT receipt_id, vendor, total::DOUBLE AS total, n::BIGINT AS items, first_item FROM (SELECT r.receipt_id, r.vendor, r.total, count(i.line_no) AS n, arg_min(i.item_name, i.line_no) AS first_item FROM rc r LEFT JOIN it i USING (receipt_id) GROUP BY ALL)")
def json_export_read_back(spark, d):
    """Nested payloads, one a receipt, written as JSON lines and read again."""
    t = _tables(spark, d)
    listed = t["items"].groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "item_name", "unit_price"))).alias("items"))
    whole = t["receipts"].join(listed, "receipt_id", "left").select("receipt_id", F.struct("vendor", "total", "status").alias("header"), F.coalesce("items", F.array().cast(listed.schema["items"].dataType)).alias("items"))
    folder = _folder(spark)
    tables.write_json(whole, folder)
    got = spark.read.schema("receipt_id long, header struct<vendor:string,total:double,status:string>, items array<struct<line_no:int,item_name:string,unit_price:double>>").json(folder)
    return got.select("receipt_id", "header.vendor", "header.total", F.size("items").cast("long").alias("items"), F.get("items.item_name", F.lit(0)).alias("first_item"))


@query(f"""WITH {ITEMS}, n AS (SELECT receipt_id, count(*) AS n FROM items GROUP BY 1)
SELECT receipt_id || '.png' AS filename, 0.5::DOUBLE AS mean_confidence, n::INT AS token_count, true AS token_box_match, false AS has_total_keyword, false AS has_amount_near_total, 0 AS num_amounts, false AS has_date_pattern, true AS is_long_receipt,
  'best_images/' || receipt_id || '_best_ocr.png' AS best_image_path, 'best_texts/' || receipt_id || '_best.txt' AS best_text_path, 'best_images/' || receipt_id || '_best_view.png' AS best_view_image_path, 18 AS columns FROM n WHERE receipt_id % 40 <> 0 AND receipt_id % 41 <> 0""")
def csv_appended(spark, d):
    """The summary of two batches of OCR documents appended to one CSV, all its columns, and read again."""
    good, _ = ocr.check(spark.read.schema(ocr.SCHEMA).json(_ocr_files(spark, d)).withColumn("path", F.col("_metadata.file_path")))
    rows = intake.ocr_csv_rows(good)
    folder = _folder(spark)
    for left in (0, 1):
        tables.append_csv(rows.filter(F.length("filename") % 2 == left), folder)
    got = spark.read.schema(", ".join(f"{c} {t}" for c, t in rows.dtypes)).option("header", True).csv(folder)
    return got.select("filename", "mean_confidence", "token_count", "token_box_match", "has_total_keyword", "has_amount_near_total", "num_amounts", "has_date_pattern", "is_long_receipt", "best_image_path", "best_text_path", "best_view_image_path", F.lit(len(got.columns)).alias("columns"))


@query(_BASE + " SELECT receipt_id, status, 2::BIGINT AS version FROM rc UNION ALL SELECT -1, 'broken attempt', 2")
def versions_swapped(spark, d):
    """Two versions of the tables and a broken third: the second is read."""
    t = _tables(spark, d)
    store = TableStore(spark, _folder(spark))
    store.write({"receipts": t["receipts"].select("receipt_id", F.lit("old").alias("status"))})
    store.write({"receipts": t["receipts"].select("receipt_id", "status").unionByName(spark.createDataFrame([(-1, "broken attempt")], "receipt_id long, status string"))})
    t["receipts"].limit(1).write.parquet(f"{store.root}/3/receipts")  # no mark
    return store.read()["receipts"].withColumn("version", F.lit(store.version()).cast("long"))


# streams

@query("""WITH e AS (SELECT user_id, value::DECIMAL(18,2) AS v, strftime(ts, '%Y-%m') AS ym FROM events)
SELECT ym, sum(v)::DOUBLE AS spend, count(*) AS count FROM e GROUP BY 1""")
def trend_of_a_stream(spark, d):
    """Monthly trend with watermark and state over all events, as files that arrive in order of time; one receipt far
    in the future closes the last month and is not in the result."""
    source, sink, state = _folder(spark), _folder(spark), _folder(spark)
    e = adapters.read(spark, d, "events").select(F.col("event_id").cast("string").alias("source_id"), F.date_format("ts", "yyyy-MM-dd").alias("receipt_date"), F.col("value").cast(MONEY).alias("total"))
    e.repartitionByRange(4, "receipt_date").write.json(source)
    spark.createDataFrame([("end", "2999-01-01", None)], e.schema).coalesce(1).write.mode("append").json(source)
    s = ingest.receipt_stream(spark, source, f"source_id string, receipt_date string, total {MONEY}", 1000)
    q = ingest.monthly_trend_stream(s).writeStream.outputMode("append").format("parquet").option("checkpointLocation", state).option("path", sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("ym string, spend decimal(28,2), count long").parquet(sink).select("ym", F.col("spend").cast("double").alias("spend"), "count")


@query("WITH u AS (SELECT user_id, count(*) AS n, arg_max(value::DECIMAL(18,2), event_id) AS v FROM events GROUP BY 1) SELECT 'u' || user_id AS source_id, v::DOUBLE AS total, row_number() OVER (ORDER BY 'u' || user_id) AS place FROM u")
def upserts_of_a_stream(spark, d):
    """Receipts that arrive again and again, upserted batch by batch: the last of each source stays."""
    source, state = _folder(spark), _folder(spark)
    e = adapters.read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"), F.col("value").cast(MONEY).alias("total"), F.col("event_id").alias("seq"))
    e.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(source)
    store = TableStore(spark, _folder(spark))
    store.write({"receipts": spark.createDataFrame([], f"receipt_id long, source_id string, total {MONEY}")})
    run = ingest.upsert_batches(lambda: store.read()["receipts"], lambda df, n: store.write({"receipts": df}))
    files = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1000).parquet(source)
    q = files.writeStream.foreachBatch(run).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return store.read()["receipts"].select("source_id", F.col("total").cast("double").alias("total"), F.col("receipt_id").alias("place"))


# image variants

@query("""WITH v AS (SELECT o_orderkey AS receipt_id, ['gray', 'clahe+sharpen', 'Adaptive_Thresh', 'thresh'][i] AS name, (o_orderkey * i * 7 % 23)::DOUBLE AS score, i AS rank FROM orders, range(1, 5) t(i)),
p AS (SELECT *, CASE WHEN rank <= 2 THEN score - CASE WHEN rank = 2 THEN 1 ELSE 0 END END AS shown FROM v i)
SELECT receipt_id, arg_max(name, score * 10 - rank) AS "read", arg_max(name, shown * 10 - rank) FILTER (rank <= 2) AS "view" FROM p GROUP BY 1""")
def views_of_variants(spark, d):
    k, names = F.col("o_orderkey"), F.array(*map(F.lit, ("gray", "clahe+sharpen", "Adaptive_Thresh", "thresh")))
    v = adapters.read(spark, d, "orders").select(k.alias("receipt_id"), F.posexplode(names).alias("i", "name"))
    v = v.select("receipt_id", "name", (F.col("i") + 1).alias("rank"), (F.col("receipt_id") * (F.col("i") + 1) * 7 % 23).cast("double").alias("score"))
    return blocks.best_views(v)


@query("""SELECT o_orderkey AS receipt_id, CASE o_orderkey % 5 WHEN 0 THEN '/data/in/' || o_orderkey || '.png' WHEN 1 THEN '/data/doc' || o_orderkey || '/best_images/' || o_orderkey || '.png'
WHEN 2 THEN '/data/a/best_images/' || o_orderkey || '.png' WHEN 3 THEN '/data/b/' || o_orderkey || '.png' END AS path FROM orders""")
def paths_by_four_steps(spark, d):
    """Each order's image: at its path, beside its document, in other best images, anywhere, nowhere; worse places hold it too."""
    k = F.col("o_orderkey")
    o = adapters.read(spark, d, "orders").select(k.alias("k"), F.concat(k.cast("string"), F.lit(".png")).alias("n"))
    at = [F.concat(F.lit("/data/in/"), "n"), F.concat(F.lit("/data/doc"), F.col("k").cast("string"), F.lit("/best_images/"), "n"), F.concat(F.lit("/data/a/best_images/"), "n"), F.concat(F.lit("/data/b/"), "n")]
    files = o.select(F.explode(F.array_compact(F.array(*(F.when(F.col("k") % 5 <= i, c) for i, c in enumerate(at))))).alias("path"))
    wanted = o.select("k", F.concat(F.lit("in/"), "n").alias("wanted"), F.concat(F.lit("/json/doc"), F.col("k").cast("string"), F.lit(".json")).alias("document"))
    got = ocr.resolve_paths(wanted, files, "/data")
    return got.select(F.regexp_extract("wanted", r"(\d+)", 1).cast("long").alias("receipt_id"), "path")


# endpoints

def _served(spark, d):
    t = _tables(spark, d)
    t["validation"] = t["receipts"].filter(_k() % 2 == 0).select("receipt_id", F.lit("PASS").alias("subtotal_status"))
    return t


def _one(spark, d, running: bool = False) -> int:
    """The smallest receipt, or the smallest that waits with a run."""
    r = adapters.receipts(spark, d)
    return (r.filter("active_llm_run_id is not null and ai_review_status = 'pending'") if running else r).agg(F.min("receipt_id")).first()[0]


_WAITS = "(SELECT min(receipt_id) FROM rc WHERE active_llm_run_id IS NOT NULL AND ai_review_status = 'pending')"


@query(_BASE + f""" SELECT r.receipt_id, u.vendor, u.total, 'llm_staging' AS data_source, (SELECT string_agg(line_no || ':' || item_name, ';' ORDER BY line_no, llm_item_id) FROM ri WHERE ri.receipt_id = r.receipt_id) AS items FROM rc r JOIN ru u USING (receipt_id) WHERE r.receipt_id = {_WAITS}""")
def endpoint_receipt(spark, d):
    show = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["item_name"])), ";")
    return api.get_receipt(_served(spark, d), _one(spark, d, True)).select("receipt_id", "vendor", "total", "data_source", show.alias("items"))


@query(_BASE + " SELECT receipt_id, 'PASS' AS subtotal_status FROM rc WHERE receipt_id = (SELECT min(receipt_id) FROM rc) AND receipt_id % 2 = 0")
def endpoint_validation(spark, d):
    return api.get_validation(_served(spark, d), _one(spark, d))


@query(_BASE + f" SELECT llm_run_id, receipt_id, total, (SELECT count(*) FROM ri WHERE ri.llm_run_id = ru.llm_run_id)::INT AS items FROM ru WHERE receipt_id = {_WAITS}")
def endpoint_llm(spark, d):
    return api.get_llm(_served(spark, d), _one(spark, d, True)).select("llm_run_id", "receipt_id", "total", F.size("items").alias("items"))


@query(_BASE + f" SELECT llm_run_id, receipt_id, (SELECT count(*) FROM ri WHERE ri.llm_run_id = ru.llm_run_id)::INT AS items FROM ru WHERE llm_run_id = {_WAITS} * 10 + 1")
def endpoint_run(spark, d):
    return api.get_run(_served(spark, d), _one(spark, d, True) * 10 + 1).select("llm_run_id", "receipt_id", F.size("items").alias("items"))


@query(_BASE + " SELECT receipt_id, CASE WHEN receipt_id % 5 = 0 AND status <> 'Processed' THEN 'Processed' ELSE status END AS status FROM rc")
def endpoint_approve(spark, d):
    t = _served(spark, d)
    text = lambda c: F.lit(None).cast("string").alias(c)
    lines = F.array().cast("array<struct<line_no:int,item_name:string,currency:string,unit_price:double,confidence:double>>")
    edits = t["receipts"].filter(_k() % 5 == 0).select("receipt_id", "vendor", "receipt_date", "subtotal", "tax", "total", *map(text, ("summary_vendor", "summary_phone", "summary_address", "summary_receipt_date")), lines.alias("items"))
    return api.put_approve(t, edits, _now())["receipts"].select("receipt_id", "status")


@query(_BASE + " SELECT receipt_id, CASE WHEN status <> 'Processed' THEN 'Error' ELSE status END AS status FROM rc")
def endpoint_status(spark, d):
    t = _served(spark, d)
    return api.put_status(t, t["receipts"].select("receipt_id", F.lit("Error").alias("new_status")), _now())[0].select("receipt_id", "status")


@query(_BASE + """, q AS (SELECT *, ai_review_status = 'pending' AND active_llm_run_id IS NOT NULL AND status <> 'Processed' AS fine FROM rc)
SELECT receipt_id, CASE WHEN fine THEN 'rejected' ELSE ai_review_status END AS answer FROM q UNION ALL SELECT receipt_id, CASE WHEN status = 'Processed' THEN 'read_only' WHEN ai_review_status <> 'pending' THEN 'not_pending' ELSE 'no_active_run' END FROM q WHERE NOT fine""")
def endpoint_reject(spark, d):
    t = _served(spark, d)
    done, refused = api.post_reject(t, t["receipts"].select("receipt_id"))
    return done.select("receipt_id", F.col("ai_review_status").alias("answer")).unionByName(refused.select("receipt_id", F.col("reason").alias("answer")))


@query(_BASE + " SELECT llm_run_id, 'approved' AS approval_status, 'run' AS part FROM ru UNION ALL SELECT llm_run_id, 'rejected', 'other' FROM ru")
def endpoint_judge_runs(spark, d):
    t = _served(spark, d)
    ask = lambda who: t["runs"].select("llm_run_id", F.lit("me").alias(who))
    yes, no = api.post_approve_run(t, ask("approved_by"), _now())["runs"], api.post_reject_run(t, ask("rejected_by"), _now())["runs"]
    return yes.select("llm_run_id", "approval_status", F.lit("run").alias("part")).unionByName(no.select("llm_run_id", "approval_status", F.lit("other").alias("part")))


@query(f"""WITH {ITEMS}, n AS (SELECT receipt_id, count(*) AS n FROM items WHERE receipt_id % 40 <> 0 AND receipt_id % 41 <> 0 GROUP BY 1)
SELECT (SELECT count(DISTINCT receipt_id) FROM items) AS total, count(*) AS ok, (SELECT count(DISTINCT receipt_id) FROM items) - count(*) AS failed, sum(n)::BIGINT AS tokens FROM n""")
def endpoint_process(spark, d):
    """Every OCR document as a file of its own kind: broken ones are counted, the others go on."""
    docs = spark.read.schema(ocr.SCHEMA).json(_ocr_files(spark, d)).withColumn("path", F.col("_metadata.file_path"))
    return intake.batch(docs)[2]


@query(_BASE + """ SELECT receipt_id, CASE WHEN receipt_id % 3 = 0 THEN ai_review_status ELSE 'pending' END AS state, CASE WHEN receipt_id % 3 = 0 THEN 'no JSON object' END AS reason FROM rc""")
def endpoint_auto_fix(spark, d):
    """An answer of the model for every receipt, each third one without JSON."""
    t = _served(spark, d)
    answer = F.when(_k() % 3 == 0, "sorry").otherwise(F.concat(F.lit('```json\n{"vendor": "V", "items": [{"name": "tea", "price": 1.5}], "total": "'), F.col("total").cast("string"), F.lit('"}\n```')))
    got = api.post_auto_fix_staged(t, t["receipts"].select("receipt_id", F.lit(1).alias("seq"), answer.alias("response"), F.lit("TOTAL 1.00").alias("ocr_text"), F.lit(False).alias("has_image"), F.lit("0.9").alias("ocr_confidence")), _now())
    return got["receipts"].select("receipt_id", F.col("ai_review_status").alias("state")).join(got["rejects"].select("receipt_id", "reason"), "receipt_id", "left")
