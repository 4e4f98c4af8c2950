"""Lines and texts for people: summary lines read from text, prediction logs, validation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .money import let, normalize_amount
from .text import best_keyword, is_time

#: Keywords of summary lines, in the order in which they are tried.
TOTAL_WORDS = ["TOTAL", "GRAND TOTAL", "TOTAL AMOUNT", "AMOUNT DUE", "NET TOTAL", "FINAL TOTAL", "INVOICE TOTAL", "TOTAL DUE", "MONTANT TOTAL", "IMPORTE TOTAL", "TOTAAL", "TOTAL A PAGAR", "BALANCE DUE"]
SUBTOTAL_WORDS = ["SUBTOTAL", "SUB-TOTAL", "SUB TOTAL", "SUBTOTAL AMOUNT", "BEFORE TAX", "NET AMOUNT", "AMOUNT BEFORE TAX", "SOUS-TOTAL", "SUBTOTAL FINAL", "SUBTOTAL NETTO"]
TIP_WORDS = ("GRATUITY", "TIP", "SERVICE CHARGE")


def summary_line(line: Column, tax_words: list[str], most: int = 3) -> Column:
    """struct of what a line says: which keywords it has, and its last amount (none of a percentage
    without a currency, none of a time of day)."""
    u = F.upper(F.coalesce(line, F.lit("")))
    numbers = F.regexp_extract_all(u, F.lit(r"(\(?[-+]?\$?\d[\d,]*(?:[.,]\d{2})?\)?)"), F.lit(1))
    percent = u.contains("%") & ~(u.contains("$") | u.contains("USD") | u.contains("CAD"))
    value = F.when(~percent & ~is_time(line), normalize_amount(F.try_element_at(numbers, F.lit(-1))))
    tip = F.lit(False)
    for w in TIP_WORDS:
        tip = tip | u.contains(w)
    has = lambda words: best_keyword(u, words, most).isNotNull()
    return F.struct(has(TOTAL_WORDS).alias("total"), has(SUBTOTAL_WORDS).alias("subtotal"), has(tax_words).alias("tax"), tip.alias("tip"), value.alias("value"))


def prediction_line(idx: Column, word: Column, label: Column, confidence: Column, word_width: int = 18, label_width: int = 16) -> Column:
    """``  3 | word               label            0.950``: fixed widths, longer texts cut."""
    pad = lambda c, n: F.rpad(F.substring(c, 1, n), n, " ")
    clean = F.trim(F.regexp_replace(F.coalesce(word, F.lit("")), r"\s+", " "))
    shown = F.when(F.trim(F.coalesce(label, F.lit(""))) == "", F.lit("O")).otherwise(F.trim(label))
    return F.concat(F.lpad(F.coalesce(idx, F.lit(0)).cast("string"), 3, " "), F.lit(" | "), pad(clean, word_width), F.lit(" "), pad(shown, label_width), F.lit(" "), F.format_string("%.3f", F.coalesce(confidence, F.lit(0.0))))


def rows_text(rows: Column) -> Column:
    """Text of an array of row structs, one a line, empty rows left out."""
    return F.array_join(F.filter(F.transform(rows, lambda r: F.trim(r["text"])), lambda x: x != ""), "\n")


def shown_price(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_string("$%.2f", c.cast("double")))


def validation_text(validated: DataFrame) -> DataFrame:
    """The report of each receipt of ``validate_all`` (with its items): a heading, the subtotal with its problematic
    items, the outliers, the recommendations. Fixed values: the wording and the widths."""
    bar, gap = "=" * 80, F.col("discrepancy").cast("double")
    pct = F.when(F.col("subtotal") == 0, F.lit(0.0)).otherwise(F.round(gap / F.col("subtotal").cast("double") * 100, 2))
    item = lambda x: F.format_string("      - %-40s $%7.2f", F.coalesce(x["item_name"], F.lit("UNKNOWN")), x["price"].cast("double"))
    listed = lambda c, f: F.coalesce(F.transform(c, f), F.array().cast("array<string>"))
    checked = F.when(F.col("subtotal_status") == "SKIPPED", F.array().cast("array<string>")).otherwise(F.concat(
        F.array(F.format_string("    Expected:      $%.2f", F.col("subtotal").cast("double")), F.format_string("    Reconstructed: $%.2f", F.col("items_total").cast("double")), F.format_string("    Discrepancy:   $%+.2f (%+.2f%%)", gap, pct)),
        listed("problems", lambda x: F.concat(item(x), F.format_string(" (Z-score: %5.1f)", x["z_score"])))))
    lines = F.concat(
        F.array(F.lit("\n" + bar), F.lit(" " * 31 + "VALIDATION REPORT" + " " * 32), F.lit(bar), F.lit("\n[1] SUBTOTAL CONSISTENCY"), F.concat(F.lit("    Status: "), "subtotal_status")), checked,
        F.array(F.lit("\n[2] PRICE OUTLIER DETECTION"), F.concat(F.lit("    Status: "), "outliers_status")), listed("outliers", item), F.array(F.lit("\n[3] RECOMMENDATIONS")), F.transform("recommendations", lambda x: F.concat(F.lit("    "), x)), F.array(F.lit("\n" + bar)))
    return validated.select("receipt_id", F.array_join(lines, "\n").alias("report"))


def clamp_item(price: Column, confidence: Column) -> Column:
    """An edited item: no negative price, confidence within 0..100."""
    return F.struct(F.greatest(F.lit(0.0), F.coalesce(price, F.lit(0.0))).alias("price"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.0)))).alias("confidence"))


def edited_total(subtotal: Column, tax: Column) -> Column:
    return F.round(F.coalesce(subtotal, F.lit(0.0)) + F.coalesce(tax, F.lit(0.0)), 2)


def distinct_words(c: Column) -> Column:
    """A field with each of its words once."""
    return let(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.array_join(F.array_distinct(w), " "))


def header_fields(entities: DataFrame) -> DataFrame:
    """vendor, address, phone, date of each receipt from its merged entities (kind HEAD.*), in order,
    repeated words once; the first date-like part of the date; '' where there is none."""
    joined = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == f"HEAD.{k}", F.struct("start", "text")))), lambda x: x["text"]), " ")
    got = entities.groupBy("receipt_id").agg(*(joined(k).alias(k.lower()) for k in ("VENDOR", "ADDRESS", "PHONE", "DATE")))
    date = F.regexp_extract("date", r"\b(\d{2}[-/]\d{2}[-/]\d{2,4})\b", 1)
    return got.select("receipt_id", distinct_words(F.col("vendor")).alias("vendor"), distinct_words(F.col("address")).alias("address"), distinct_words(F.col("phone")).alias("phone"), F.when(date != "", date).otherwise(distinct_words(F.col("date"))).alias("date"))


def summary_fields(receipts: DataFrame) -> DataFrame:
    """vendor, address, phone, date, subtotal, tax, total of each receipt, '' where nothing says it. A receipt is one row
    (receipt_id, words, entities: arrays in order), so nothing is shuffled.

    First what its entities say (kind HEAD.* or SUM.*, joined in order): a phone must be one, an amount is the last
    in its text. Every field has each of its words once. Then ranked substitutes over the receipt's words: the amount
    after TOTAL, a phone near its keyword or anywhere, a street number up to a ZIP code."""
    from .money import extract_amount, extract_amount_loose
    from .text import PHONE, address_fallback, phone_near, total_fallback

    kinds = {k.split(".")[1].lower(): k for k in ("HEAD.VENDOR", "HEAD.ADDRESS", "HEAD.PHONE", "HEAD.DATE", "SUM.SUBTOTAL", "SUM.TAX", "SUM.TOTAL")}
    joined = lambda k: F.array_join(F.transform(F.filter("entities", lambda e: e["kind"] == k), lambda e: e["text"]), " ")
    got = receipts.select("receipt_id", "words", *(joined(k).alias(f"_{n}") for n, k in kinds.items()))
    text = {n: F.coalesce(f"_{n}", F.lit("")) for n in kinds} | {"phone": F.regexp_extract(F.coalesce("_phone", F.lit("")), PHONE, 1)}
    text |= {n: extract_amount_loose(F.col(f"_{n}")) for n in ("subtotal", "tax", "total")}
    got = got.select("receipt_id", "words", *(distinct_words(c).alias(n) for n, c in text.items()))
    other = {"total": total_fallback(F.array_join("words", " ")), "phone": phone_near(F.col("words")), "address": address_fallback(F.col("words"))}
    field = lambda n: F.when(F.col(n) != "", F.col(n)).otherwise(other[n]) if n in other else F.col(n)
    return got.select("receipt_id", *(field(n).alias(n) for n in ("vendor", "address", "phone", "date")), *(extract_amount(field(n)).alias(n) for n in ("subtotal", "tax", "total")))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row for a batch of results (error is null where a receipt went well): counts and the rate."""
    ok = F.count(F.when(F.col("error").isNull(), 1))
    return results.agg(F.count("*").alias("total"), ok.alias("ok"), (F.count("*") - ok).alias("failed"))
