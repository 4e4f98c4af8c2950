"""From uploads and OCR documents to rows: names, image geometry, batches with one failure per file, and the
common item form of a model's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.money import clean_text
from ..sources import ocr

#: Image suffixes that are kept.
SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")


def upload_name(number: Column, file_name: Column) -> Column:
    """``RSCAN-000001.png``: the number in six digits, more if it has more, and the file's suffix, ``.jpg`` for
    an unknown one."""
    suffix = F.lower(F.regexp_extract(file_name, r"(\.[^./\\]+)$", 1))
    return F.concat(F.format_string("RSCAN-%06d", number.cast("long")), F.when(suffix.isin(*SUFFIXES), suffix).otherwise(".jpg"))


def job_id(at: Column, unique: Column) -> Column:
    """Time stamp and eight hexadecimal digits of a unique text."""
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.md5(F.encode(unique, "utf-8")), 1, 8))


def is_long(height: Column, width: Column, aspect: float = 2.6, least: int = 1600) -> Column:
    """Whether an image is that of a long receipt: by its aspect or its height; never without a width."""
    return F.coalesce((width > 0) & ((height / width >= aspect) | (height >= least)), F.lit(False))


def tiles(height: Column, tile: int = 1200, overlap: int = 200) -> Column:
    """Array of struct(top, bottom): tiles of an image from the top, each overlapping the one before; the last
    one ends at the bottom."""
    step = max(1, tile - overlap)
    tops = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((height - tile) / step), F.lit(0)).cast("int")), lambda i: i * step)
    cut = F.transform(tops, lambda y: F.struct(y.alias("top"), F.least(y + tile, height).cast("int").alias("bottom")))
    return F.when(height > 0, cut).otherwise(F.slice(cut, 1, 0))


def shrinking(size: Column, least: int = 50, ratio: float = 0.85, most: int = 40) -> Column:
    """Sizes of a chunk that are tried in turn while the tagger would cut it: each ``ratio`` of the one before,
    rounded down, to ``least``."""
    steps = F.sequence(F.lit(1), F.lit(most))
    tried = F.aggregate(steps, F.array(size.cast("int")), lambda a, _: F.when(F.element_at(a, -1) > least, F.array_append(a, F.greatest(F.lit(least), F.floor(F.element_at(a, -1) * ratio)).cast("int"))).otherwise(a))
    return tried


def mean_line_confidence(confs: Column) -> Column:
    """Mean of a document's line confidences, 0 without any."""
    return F.coalesce(F.aggregate(confs, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(confs) > 0, F.size(confs)), F.lit(0.0))


def ocr_summary(docs: DataFrame) -> DataFrame:
    """One row per good OCR document: source, sizes, counts, mean confidence, family and the text's signals."""
    words = F.array_join("words", " ")
    signals = text.quality_signals(words)
    size = lambda i: F.get("image_size", F.lit(i))
    return docs.select(
        F.coalesce("id", ocr.stem(F.col("path"))).alias("source_id"), ocr.base_name(F.col("image_path")).alias("image"), size(0).alias("width"), size(1).alias("height"),
        is_long(size(1), size(0)).alias("is_long"), F.size("words").alias("num_tokens"), F.size(F.array_distinct(F.coalesce("row_ids", F.array().cast("array<int>")))).alias("num_rows"),
        mean_line_confidence(F.coalesce("token_confs", F.array().cast("array<double>"))).alias("mean_conf"), text.receipt_family(F.col("words"), F.col("row_ids"), is_long(size(1), size(0))).alias("family"),
        signals["has_total"].alias("has_total"), signals["has_date"].alias("has_date"), signals["amounts"].alias("amounts"), F.substring(words, 1, 200).alias("head"),
    )


def ocr_csv_rows(docs: DataFrame) -> DataFrame:
    """The 18 columns of the OCR summary file for good documents (optionally best_variant, score and overlay, whether an
    overlay was drawn): what was found, and where the step put its files."""
    stem, words = ocr.stem(F.col("image_path")), F.array_join("words", " ")
    signals = text.quality_signals(words)
    size = lambda i: F.get("image_size", F.lit(i))
    given = lambda c, kind: F.col(c) if c in docs.columns else F.lit(None).cast(kind)
    at = lambda folder, end: F.concat(F.lit(folder + "/"), stem, F.lit(end))
    rows = F.coalesce("row_ids", F.array().cast("array<int>"))
    return docs.select(
        ocr.base_name(F.col("image_path")).alias("filename"), given("best_variant", "string").alias("best_variant"), given("score", "double").alias("score"),
        F.coalesce("mean_conf", mean_line_confidence(F.coalesce("token_confs", F.array().cast("array<double>")))).alias("mean_confidence"), F.coalesce(F.size("lines"), F.size(F.array_distinct(rows))).alias("num_lines"),
        at("best_images", "_best_ocr.png").alias("best_image_path"), at("best_texts", "_best.txt").alias("best_text_path"), at("variant_scores", "_variants.json").alias("variant_scores_json"), at("best_ocr_json_full", ".json").alias("best_ocr_json_full"),
        F.when(F.coalesce(given("overlay", "boolean"), F.lit(False)), at("overlays", ".png")).otherwise("").alias("overlay_path"), F.size("words").alias("token_count"), (F.size("words") == F.size("bboxes")).alias("token_box_match"),
        signals["has_total"].alias("has_total_keyword"), signals["total_amount"].alias("has_amount_near_total"), signals["amounts"].alias("num_amounts"), signals["has_date"].alias("has_date_pattern"), is_long(size(1), size(0)).alias("is_long_receipt"),
        at("best_images", "_best_view.png").alias("best_view_image_path"))


def tokens(docs: DataFrame) -> DataFrame:
    """Words of good documents with their boxes, in order: what tagging and extraction start from."""
    t = docs.select(F.coalesce("id", ocr.stem(F.col("path"))).alias("source_id"), F.posexplode(F.arrays_zip("words", "bboxes", *(F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("row_ids", "array<int>"), ("zones", "array<string>"), ("token_confs", "array<double>"))))).alias("idx", "t"))
    box = lambda i: F.get("t.bboxes", F.lit(i))
    return t.select("source_id", "idx", F.col("t.words").alias("word"), F.col("t.row_ids").alias("row_id"), F.col("t.zones").alias("zone"), F.coalesce("t.token_confs", F.lit(0.0)).alias("conf"), *(box(i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


def batch(docs: DataFrame, first: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, results, summary) of a batch of OCR documents in the order of their paths, the ``first`` ones if
    given. A document that cannot be used is a result with an error; the others go on."""
    if first is not None:
        docs = docs.orderBy("path").limit(first)
    good, bad = ocr.check(docs)
    results = good.select("path", F.lit(None).cast("string").alias("error"), F.size("words").alias("num_tokens")).unionByName(bad.select("path", "error", F.lit(0).alias("num_tokens")))
    ok = F.count(F.when(F.col("error").isNull(), 1))
    return tokens(good), results, results.agg(F.count("*").alias("total"), ok.alias("ok"), (F.count("*") - ok).alias("failed"), F.coalesce(F.sum("num_tokens"), F.lit(0)).alias("tokens"))


def items_of_answer(answers: DataFrame) -> DataFrame:
    """Items of parsed answers (receipt_id, items: array of struct(name, item_name, price, line_price, confidence))
    in the form of extracted ones: numbered from 1; a name under either key, else Unknown; price 0 and confidence 1
    where missing; the price is unit and line price too."""
    one = answers.select("receipt_id", F.posexplode("items").alias("pos", "i"))
    price = F.coalesce("i.price", "i.line_price", F.lit(0.0)).cast("double")
    name = F.coalesce(clean_text(F.col("i.name")), clean_text(F.col("i.item_name")), F.lit("Unknown"))
    return one.select(
        "receipt_id", (F.col("pos") + 1).alias("line_no"), name.alias("item_name"), price.alias("price"), price.alias("unit_price"), price.alias("line_price"),
        F.coalesce("i.confidence", F.lit(1.0)).cast("double").alias("price_confidence"), F.lit("llm").alias("source"),
    )
