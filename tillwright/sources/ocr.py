"""OCR documents: scans, checks, and look-ups of files by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id string, image_path string, image_size array<int>, words array<string>, bboxes array<array<int>>, row_ids array<int>, zones array<string>, line_bboxes array<array<int>>, token_confs array<double>, "
    "mean_conf double, num_tokens int, lines array<struct<row_id:int,text:string,bbox:array<int>,zone:string>>, meta struct<ocr_long_receipt:boolean,ocr_mode:string,tile_h:int,tile_overlap:int>"
)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document with its file's path; a document that is no JSON has nulls."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("path", F.col("_metadata.file_path"))


def check(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): words and boxes must be there and of equal length. Boxes beyond the page of 0..1000
    are scaled to it; row_ids and zones of another length are dropped."""
    from ..functions.money import boxes_are_normal, to_page

    fine = F.col("words").isNotNull() & F.col("bboxes").isNotNull() & (F.size("words") == F.size("bboxes"))
    fine = F.coalesce(fine, F.lit(False))
    size = lambda i: F.greatest(F.get("image_size", F.lit(i)), F.lit(1))
    good = docs.filter(fine).withColumns({
        "bboxes": F.when(boxes_are_normal(F.col("bboxes")), F.col("bboxes")).otherwise(to_page(F.col("bboxes"), size(0), size(1))),
        "row_ids": F.when(F.size("row_ids") == F.size("words"), F.col("row_ids")), "zones": F.when(F.size("zones") == F.size("words"), F.col("zones")),
    })
    return good, docs.filter(~fine).withColumn("error", F.when(F.col("words").isNull() | F.col("bboxes").isNull(), "missing words or boxes").otherwise("words and boxes differ in length"))


def best_text(files: DataFrame, wanted: DataFrame, suffixes: tuple[str, ...] = ("", "_best_view", "_best", "_view")) -> DataFrame:
    """Non-blank trimmed lines of each wanted source's text file (files: path, value as read with
    wholetext): the exact stem first, then the stems with the suffixes in order."""
    named = files.withColumn("stem", stem(F.col("path")))
    keys = wanted.select("source_id", F.posexplode(F.array(*(F.concat("source_id", F.lit(s)) for s in suffixes))).alias("rank", "stem"))
    best = named.join(keys, "stem").groupBy("source_id").agg(F.min_by("value", F.struct("rank", "path")).alias("value"))
    return best.select("source_id", F.posexplode(F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "line"))


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files under a folder, by name; only their listing is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,bmp,tif,tiff,webp}").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime").orderBy("path")


def resolve_paths(wanted: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """The file of each wanted path (wanted; optionally document: the path of its JSON file), null without one: the
    path under ``root``; else its name in the best images beside a folder of the document's name; else in any
    folder of best images; else anywhere; of several the first by path."""
    top = root.rstrip("/") + "/" if root else ""
    f = files.select("path", base_name(F.col("path")).alias("name"))
    path = F.trim("wanted")
    doc = stem(F.col("document")) if "document" in wanted.columns else F.lit(None).cast("string")
    w = wanted.select("wanted", base_name(path).alias("name"), F.concat(F.lit(top), path).alias("_flat"), F.concat(F.lit(top), doc, F.lit("/best_images/"), base_name(path)).alias("_beside"))
    at = F.col("path")
    step = F.when(at == F.col("_flat"), 0).when(at == F.col("_beside"), 1).when(at.endswith(F.concat(F.lit("/best_images/"), F.col("name"))), 2).otherwise(3)
    # by merge, as the files grow with the wanted paths; with the name among the keys groups need no further shuffle
    hit = w.join(f.hint("merge"), "name", "left")
    best = hit.groupBy("name", "wanted", "_beside").agg(F.min(F.when(at.isNotNull(), F.struct(step.alias("step"), "path"))).alias("b")).withColumn("path", F.col("b.path"))
    return best.select("wanted", "path")


def image_url(path: Column, base: str = "/images/") -> Column:
    """URL of a receipt's image: its name without view suffixes."""
    return F.concat(F.lit(base), F.regexp_replace(base_name(path), r"(_best_view|_best|_view)(?=\.)", ""))


def relative_path(path: Column) -> Column:
    """A path from ``processed/`` or ``best_images/`` on, else as it is."""
    cut = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"((?:processed|best_images)/.*)$", 1)
    return F.when(cut != "", cut).otherwise(path)
