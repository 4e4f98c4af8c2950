"""Ordered-token operators: rows, regions, sessions, context, patterns, boundaries.

Tokens have receipt_id, idx (the only order), word, label, conf, x1, y1, x2, y2, row_id, zone. All
windows are partitioned by receipt_id, so consecutive operators share one exchange; a receipt is
bounded, and parallelism is across receipts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import let
from ..session import partitions
from .streams import by_receipt

KEY = "receipt_id"


def _w(order: str = "idx") -> Window:
    return Window.partitionBy(KEY).orderBy(order)


def explode_tokens(docs: DataFrame) -> DataFrame:
    """OCR documents (parallel arrays) to tokens. A missing or short row_ids, zones or token_confs gives null."""
    box = lambda i: F.get(F.get("bboxes", F.col("idx")), F.lit(i)).cast("int")
    same = lambda c: F.when(F.size(c) == F.size("words"), F.get(c, F.col("idx")))
    rows = docs.select("*", F.posexplode("words").alias("idx", "word"))
    return rows.select(KEY, "idx", "word", *(box(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), same("row_ids").alias("row_id"), same("zones").alias("zone"), same("token_confs").alias("conf"))


def zone_of(y1: Column, y2: Column) -> Column:
    """header above 120, footer below 900 on a page of 1000, by the middle of the box."""
    y = (y1 + y2) / 2
    return F.when(y < 120, "header").when(y > 900, "footer").otherwise("body")


def regions(df: DataFrame, order: str = "idx", y: str = "y", gap: float = 30) -> DataFrame:
    """Number of the region: a new one begins where y is more than ``gap`` below the row before (upward
    jumps never split)."""
    w = _w(order)
    cut = F.when(F.col(y) - F.lag(y).over(w) > gap, 1).otherwise(0)
    return df.withColumn("__cut", cut).withColumn("region", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__cut")


def anchor_rows(values: Column, tolerance: float = 15) -> Column:
    """Row numbers of an array of y-centres in order: a new row where a value is more than the tolerance
    from the anchor, which moves only then."""
    first = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, y: Column) -> Column:
        new = a["anchor"].isNull() | (F.abs(y - a["anchor"]) > tolerance)
        row = a["row"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, y).otherwise(a["anchor"]).alias("anchor"), row.alias("row"), F.array_append(a["rows"], row).alias("rows"))

    return F.aggregate(F.transform(values, lambda v: v.cast("double")), first, step, lambda a: a["rows"])


def row_ids(df: DataFrame, order: str = "idx", y: str = "y", tolerance: float = 15) -> DataFrame:
    """(receipt_id, order, row) by anchor_rows over the rows in order."""
    got = df.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(order, F.col(y).alias("y")))).alias("s"))
    got = got.withColumn("rows", anchor_rows(F.transform("s", lambda x: x["y"]), tolerance))
    return got.select(KEY, F.explode(F.arrays_zip(F.transform("s", lambda x: x[order]).alias("o"), F.col("rows").alias("row"))).alias("z")).select(KEY, F.col("z.o").alias(order), F.col("z.row").alias("row"))


def physical_lines(rows: DataFrame, tolerance: float = 15) -> DataFrame:
    """Line of each row (receipt_id, row_id, y_top): rows sorted by y_top, grouped by anchor."""
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy(KEY).orderBy("y_top", "row_id")))
    lines = row_ids(ranked, "at", "y_top", tolerance).withColumnRenamed("row", "line")
    return ranked.join(lines, [KEY, "at"]).drop("at")


def sessions(tokens: DataFrame) -> DataFrame:
    """BIO groups: ``group`` is a running number that grows at B-, at a change of type, and at every O."""
    w = _w()
    kind = F.when(F.col("label").rlike("^[BI]-"), F.substring("label", 3, 1000))
    new = F.when(F.col("label").startswith("B-") | F.col("kind").isNull() | ~F.col("kind").eqNullSafe(F.lag("kind").over(w)), 1).otherwise(0)
    return tokens.withColumn("kind", kind).withColumn("__new", new).withColumn("group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def groups(tokens: DataFrame) -> DataFrame:
    """One row per BIO group: text, tokens, mean confidence, label (B before I before the last), first index."""
    s = sessions(tokens).filter("kind is not null")
    ordered = F.sort_array(F.collect_list(F.struct("idx", "word", "label")))
    got = s.groupBy(KEY, "group", "kind").agg(ordered.alias("t"), F.avg("conf").alias("conf"), F.min("idx").alias("start"))
    return got.select(KEY, "group", "kind", "start", "conf", F.array_join(F.transform("t", lambda x: x["word"]), " ").alias("text"), F.transform("t", lambda x: x["word"]).alias("tokens"), F.when(F.exists("t", lambda x: x["label"].startswith("B-")), F.concat(F.lit("B-"), "kind")).otherwise(F.concat(F.lit("I-"), "kind")).alias("label"))


def entities(tokens: DataFrame) -> DataFrame:
    """Merged entities in order: an I without its B begins one, O ends one."""
    return groups(tokens).select(KEY, "start", "kind", "text")


def entity_list(tokens: Column) -> Column:
    """``entities`` of a receipt whose tokens are one array of struct(word, label) in order, as an array of
    struct(start, kind, text): tokens are neither laid out in rows nor sorted."""
    def of_kinds(kinds: Column) -> Column:
        begins = lambda x, i: x["label"].startswith("B-") | F.get(kinds, i).isNull() | ~F.get(kinds, i).eqNullSafe(F.get(kinds, i - 1))
        starts = F.filter(F.transform(tokens, lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull())
        return let(starts, of_starts(kinds))

    def of_starts(kinds: Column):
        words = lambda at, end: F.transform(F.slice(tokens, at + 1, end - at), lambda x: x["word"])
        entity = lambda s, at, i: F.struct(at.alias("start"), F.get(kinds, at).alias("kind"), F.array_join(words(at, F.coalesce(F.get(s, i + 1), F.size(tokens))), " ").alias("text"))
        return lambda s: F.filter(F.transform(s, lambda at, i: entity(s, at, i)), lambda e: e["kind"].isNotNull())

    kind = lambda x: F.when(x["label"].rlike("^[BI]-"), F.substring(x["label"], 3, 1000))
    return let(F.transform(tokens, kind), of_kinds)


def rows(tokens: DataFrame) -> DataFrame:
    """One row per printed row: text, box, mean confidence, prices by label, and what kinds of labels it has."""
    has = lambda p: F.max(F.when(F.col("label").rlike(p), 1).otherwise(0)).cast("boolean")
    got = tokens.groupBy(KEY, "row_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "word"))).alias("t"), F.min("idx").alias("start"),
        F.min("x1").alias("x1"), F.min("y1").alias("y_top"), F.max("x2").alias("x2"), F.max("y2").alias("y_bottom"), F.avg("conf").alias("conf"),
        F.array_sort(F.collect_list(F.when(F.col("label").rlike("PRICE"), F.struct("idx", "word")))).alias("p"),
        has("MENU.NM").alias("has_name"), has("MENU.PRICE").alias("has_price"), has("^.-SUM").alias("has_summary"), has("TAX").alias("has_tax"), has("DISCOUNT").alias("has_discount"),
    )
    words = lambda c: F.transform(c, lambda x: x["word"])
    return got.withColumns({"text": F.array_join(words("t"), " "), "prices": words("p")}).drop("t", "p")


def lines(tokens: DataFrame) -> DataFrame:
    """Text, box and zone of each row."""
    got = tokens.groupBy(KEY, "row_id").agg(F.sort_array(F.collect_list(F.struct("idx", "word"))).alias("t"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.min_by("zone", "idx").alias("zone"))
    return got.withColumn("text", F.array_join(F.transform("t", lambda x: x["word"]), " ")).drop("t")


def same_box(tokens: DataFrame) -> DataFrame:
    """Words with one box as one token, in order of first appearance; a lone 1 is dropped."""
    got = tokens.filter(F.col("word") != "1").groupBy(KEY, "x1", "y1", "x2", "y2").agg(F.sort_array(F.collect_list(F.struct("idx", "word"))).alias("t"), F.min("idx").alias("idx"))
    text = F.regexp_replace(F.array_join(F.transform("t", lambda x: x["word"]), " "), r"(?i)\bB\s*vd\b", "BLVD")
    return got.select(KEY, "idx", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("word"), "x1", "y1", "x2", "y2").filter("word <> ''")


def context(column: str, before: int, after: int, order: str = "idx") -> Column:
    """The texts around a row, joined by spaces."""
    return F.array_join(F.collect_list(column).over(_w(order).rowsBetween(-before, after)), " ")


def last_index(condition: Column) -> Column:
    """Largest idx of the receipt where a condition holds, null if nowhere."""
    return F.max(F.when(condition, F.col("idx"))).over(Window.partitionBy(KEY))


def first_index(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("idx"))).over(Window.partitionBy(KEY))


def summary_start(tokens: DataFrame, least: float = 0.5) -> DataFrame:
    """(receipt_id, last_total, first_summary): the last TOTAL label, and the first index that credibly
    begins the summary: a keyword, or a summary label with enough confidence or tax or money near it."""
    w = _w().rowsBetween(-2, 2)
    near = F.exists(F.collect_list("word").over(w), lambda x: x.rlike(r"(?i)tax|gst|hst|pst|\d+[.,]\d{2}"))
    word = F.col("word").rlike(r"(?i)^(sub\s*-?total|total|tax|gst|hst|pst|qst|amount\s*due|balance)\b")
    summary = F.col("label").rlike("^[BI]-(SUM|TAX)")
    credible = word | (summary & ((F.col("conf") >= least) | F.col("near")))
    marked = tokens.withColumn("near", near)
    return marked.groupBy(KEY).agg(F.max(F.when(F.col("label").contains("SUM.TOTAL"), F.col("idx"))).alias("last_total"), F.min(F.when(credible, F.col("idx"))).alias("first_summary"))


def pattern(named: DataFrame, reach: int = 3, dominance: float = 1.5) -> DataFrame:
    """Layout of a receipt's groups (kind MENU.NM or MENU.PRICE in order of ``group``): prices with a name
    among the ``reach`` groups before them against those with one after; dominance decides."""
    w = Window.partitionBy(KEY).orderBy("group")
    name = F.col("kind") == "MENU.NM"
    before = F.max(F.when(name, 1).otherwise(0)).over(w.rowsBetween(-reach, -1))
    after = F.max(F.when(name, 1).otherwise(0)).over(w.rowsBetween(1, reach))
    got = named.withColumns({"__b": F.coalesce(before, F.lit(0)), "__a": F.coalesce(after, F.lit(0))}).filter(F.col("kind") == "MENU.PRICE")
    n = got.groupBy(KEY).agg(F.sum("__b").alias("name_before"), F.sum("__a").alias("name_after"))
    kind = F.when(F.col("name_before") > dominance * F.col("name_after"), "name_then_price").when(F.col("name_after") > dominance * F.col("name_before"), "price_then_name").otherwise("mixed")
    return n.withColumn("pattern", kind)


def argmax_later(value: str, conf: str = "conf", order: str = "idx") -> Column:
    """The value with the largest confidence, the later of equals."""
    return F.max_by(value, F.struct(conf, order))


def chunk_windows(tokens: DataFrame, size: int = 400, back: int = 128) -> DataFrame:
    """Each token in every overlapping chunk that holds it: chunk c covers ``size`` tokens from c * (size - back)."""
    step = size - back
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - size) / step) + 1)
    return tokens.withColumn("chunk", F.explode(F.sequence(first, F.floor(F.col("idx") / step)))).withColumn("chunk", F.col("chunk").cast("int")).filter(F.col("idx") < F.col("chunk") * step + size)


def shrinking_windows(tokens: DataFrame, size: int = 400, back: int = 128, capacity: int = 510, least: int = 20, ratio: float = 0.85, dealt: bool = False) -> DataFrame:
    """(receipt_id, chunk, first, last, seen): the chunks in which a tagger of ``capacity`` pieces reads a receipt's
    tokens (idx from 0 without gaps, pieces: parts of a token). A chunk of ``size`` tokens shrinks by ``ratio`` while its
    last token would be cut off, to ``least``; the next one begins ``back`` tokens before its end, or at its end where that
    would not be further on. Tokens first to last make the chunk, those before ``seen`` are read. ``dealt``: a receipt's
    tokens are in one partition already.

    Each chunk starts where the one before ended, so a receipt's are found in order, over one sorted stream."""

    def run(key, rows: list[tuple]) -> list[tuple]:
        before = [0]  # pieces before each token
        for _, pieces in rows:
            before.append(before[-1] + max(0, pieces or 0))
        n, start, out = len(rows), 0, []
        while start < n:
            width = min(size, n - start)
            while before[start + width - 1] - before[start] >= capacity and width > least:
                width = max(least, int(width * ratio))
            end = start + width
            seen = end
            while before[seen - 1] - before[start] >= capacity:
                seen -= 1
            out.append((key, len(out), start, end - 1, seen))
            if end >= n:
                break
            start = end - back if end - back > start else end
        return out

    fields = [("receipt_id", "long"), ("chunk", "int"), ("first", "int"), ("last", "int"), ("seen", "int")]
    return by_receipt(tokens, (KEY, "idx", "pieces"), "idx", run, fields, dealt)


def in_windows(windows: DataFrame) -> DataFrame:
    """(receipt_id, idx, chunk) for each token that a chunk reads. Chunks are dealt by receipt, so their tokens need not be."""
    dealt = windows.repartition(partitions(windows.sparkSession), KEY)
    return dealt.select(KEY, "chunk", F.explode(F.sequence("first", F.col("seen") - 1)).alias("idx"))


def merge_chunks(predictions: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Per token the label with the largest confidence over its chunks, the later chunk of equals; with ``tokens``
    (receipt_id, idx) also those that no chunk has read, as O without confidence, and no others.

    Tokens come into the group of their predictions as rows without a chunk: where both are dealt by receipt in
    equally many partitions, no token is shuffled."""
    read = predictions.select(KEY, "idx", F.struct("conf", "chunk", "label").alias("b"))
    if tokens is None:
        return read.groupBy(KEY, "idx").agg(F.max("b").alias("b")).select(KEY, "idx", "b.label", "b.conf")
    both = read.withColumn("n", F.lit(0)).unionByName(tokens.select(KEY, "idx", F.lit(None).cast(read.schema["b"].dataType).alias("b"), F.lit(1).alias("n")))
    got = both.groupBy(KEY, "idx").agg(F.max("b").alias("b"), F.max("n").alias("n")).filter("n = 1")
    return got.select(KEY, "idx", F.coalesce("b.label", F.lit("O")).alias("label"), F.coalesce("b.conf", F.lit(0.0)).alias("conf"))


def prediction_log(tokens: DataFrame, raw: str = "raw_label", final: str = "label") -> DataFrame:
    """Rows of a log: what post-processing changed."""
    return tokens.select(KEY, "idx", "word", raw, final, (~F.col(raw).eqNullSafe(F.col(final))).alias("changed"), "conf")


# Words of a page's head and the patterns of tokens between a name and its price.
HEAD_WORDS = ("costco", "wholesale", "member", "basket", "date", "time")
SKU, WEIGHT = r"^\d{6,10}$", r"(?i)\d+\.?\d*\s*(KG|LB|OZ|G|ML|L)"


def reconstruct(tokens: DataFrame) -> DataFrame:
    """Items by label: each B-MENU.NM, or an article number before the first one, opens an item, which takes what
    follows up to the next: names, prices, article numbers, weights, discounts, coupons. A void mark drops it, and so does a
    missing name or price; the first price counts, and box and confidence are those of names and prices. Words of
    the page's head and the first tokens of summary groups are passed over."""
    word, label = F.trim(F.coalesce("word", F.lit(""))), F.coalesce("label", F.lit("O"))
    t = tokens.withColumns({"word": word, "label": label}).filter((F.col("word") != "") & ~F.lower("word").isin(*HEAD_WORDS) & ~F.col("label").startswith("B-SUM.") & (F.col("label") != "B-TAX"))
    up = F.upper("word")
    of_type = lambda k: F.col("label").startswith(f"B-{k}") | F.col("label").startswith(f"I-{k}")
    discount = (up.endswith("-") | up.contains("CO-") | up.contains("-GP")) & up.rlike(r"\d")
    kind = (
        F.when(of_type("MENU.NM"), "name").when(of_type("MENU.PRICE"), F.when(discount, "discount").otherwise("price"))
        .when(F.col("word").rlike(SKU), "sku").when(F.col("word").rlike(WEIGHT), "weight").when(up.contains("TPD"), "coupon"))
    w = _w().rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("kind", kind).withColumns({
        "item": F.sum(F.when(F.col("label").startswith("B-MENU.NM"), 1).otherwise(0)).over(w), "open": F.max(F.when(F.col("kind") == "sku", 1).otherwise(0)).over(w)})
    t = t.filter((F.col("item") > 0) | (F.col("open") > 0))
    main = F.col("kind").isin("name", "price")
    end = lambda f, c: f(F.when(main, F.col(c))).alias(c)
    # one list of an item's tokens, told apart afterwards: a list for each kind would hold and sort every token six times
    got = t.groupBy(KEY, "item").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("idx", "word", "kind")))).alias("t"), F.max(up.contains("VOID") & up.rlike(r"\bVOID\b")).alias("void"), F.avg(F.when(main, F.col("conf"))).alias("conf_mean"),
        end(F.min, "x1"), end(F.min, "y1"), end(F.max, "x2"), end(F.max, "y2"))
    got = got.filter(~F.col("void"))
    of = lambda k: F.filter("t", lambda x: x["kind"] == k).alias(k)
    got = got.select("*", *(of(k) for k in ("name", "price", "sku", "weight", "discount", "coupon"))).filter((F.size("name") > 0) & (F.size("price") > 0))
    words = lambda c: F.transform(c, lambda x: x["word"])
    first = F.get(words("price"), F.lit(0))
    value = F.regexp_extract(F.replace(F.regexp_replace(F.upper(first), "-+$", ""), F.lit(":"), F.lit(".")), r"^(\d{1,6}(?:\.\d{1,2})?)", 1).try_cast("double")
    return got.select(
        KEY, F.col("item").alias("item_no"), F.array_join(words("name"), " ").alias("item_name"), value.alias("price"), first.alias("price_str"), words("sku").alias("skus"), F.get(words("weight"), F.lit(0)).alias("weight"),
        words("discount").alias("discounts"), words("coupon").alias("coupons"), F.concat(words("sku"), words("name"), words("price"), words("weight")).alias("tokens"), F.round("conf_mean", 4).alias("conf_mean"), F.array("x1", "y1", "x2", "y2").alias("bbox"))
