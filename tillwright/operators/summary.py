"""Summary amounts (subtotal, tax, total): corrections, merging of sources, and search among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("subtotal", "tax", "total")


def correct(df: DataFrame, items_sum: str = "items_sum", tolerance: float = 0.05) -> DataFrame:
    """A missing subtotal is the items' sum; a tax above the subtotal without a total is the total; a
    missing total is subtotal plus tax, or the subtotal without tax; a tax that does not fit is recomputed
    (a tax of 0 counts as none and is left)."""
    sub = F.coalesce("subtotal", F.when(F.col(items_sum) > 0, F.col(items_sum)))
    a = df.withColumn("subtotal", sub)
    swapped = F.col("total").isNull() & (F.col("tax") > F.col("subtotal"))
    bare = F.col("total").isNull() & F.col("tax").isNull() & (F.col("subtotal") > 0)
    total = F.when(swapped, F.col("tax")).when(bare, F.col("subtotal")).otherwise(F.coalesce("total", F.col("subtotal") + F.col("tax")))
    tax = F.when(swapped, F.col("tax") - F.col("subtotal")).when(bare, F.lit(0)).otherwise(F.col("tax"))
    b = a.select(*(c for c in a.columns if c not in ("tax", "total")), tax.alias("tax"), total.alias("total"))
    off = (F.col("subtotal") != 0) & (F.col("tax") != 0) & (F.col("total") != 0) & (F.abs(F.col("subtotal") + F.col("tax") - F.col("total")) > tolerance)
    return b.withColumn("tax", F.when(off, F.col("total") - F.col("subtotal")).otherwise(F.col("tax")))


def merge_sources(a: DataFrame, b: DataFrame, names: tuple[str, ...] = (*NAMES, "discount")) -> DataFrame:
    """Summaries by receipt_id with ``x`` and ``x_confidence``: b's value where a has none or is less sure."""
    other = b.select("receipt_id", *(F.col(c).alias(f"b_{c}") for n in names for c in (n, f"{n}_confidence")))
    out = a.join(other, "receipt_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    values = {}
    for n in names:
        take = F.col(f"b_{n}").isNotNull() & (F.col(n).isNull() | (zero(f"b_{n}_confidence") >= zero(f"{n}_confidence")))
        values |= {n: F.when(take, F.col(f"b_{n}")).otherwise(F.col(n)), f"{n}_confidence": F.when(take, zero(f"b_{n}_confidence")).otherwise(zero(f"{n}_confidence"))}
    return out.select(*(c for c in a.columns if c not in values), *(v.alias(k) for k, v in values.items()))


def from_rows(rows: DataFrame, conf: float = 0.92) -> DataFrame:
    """subtotal and total of each receipt from the text of its rows: the first row (by start) of each
    keyword with a positive amount that is no rate."""
    from ..functions.money import rightmost_amount

    u = F.upper("text")
    amount = rightmost_amount(F.col("text"))
    sub, tot = u.contains("SUBTOTAL"), u.contains("TOTAL") & ~u.contains("SUBTOTAL") & ~u.contains("SAVINGS")
    got = rows.withColumns({"amount": amount, "sub": sub, "tot": tot}).filter("amount > 0 and (sub or tot)").groupBy("receipt_id")
    first = lambda c: F.min_by(F.when(F.col(c), F.col("amount")), F.when(F.col(c), F.col("start")))
    out = got.agg(first("sub").alias("subtotal"), first("tot").alias("total"))
    return out.withColumns({f"{n}_confidence": F.when(F.col(n).isNotNull(), conf).otherwise(0.0) for n in ("subtotal", "total")})


def tax_from_delta(df: DataFrame, most: float = 20.0, off: float = 1.0) -> DataFrame:
    """The tax is what the total exceeds the subtotal by, where that is 0 to ``most`` and the tax is
    missing or off by more than ``off``."""
    delta = F.round(F.col("total") - F.col("subtotal"), 2)
    use = delta.between(0, most) & (F.col("tax").isNull() | (F.abs(F.col("tax") - delta) > off))
    return df.withColumn("tax", F.when(use, delta).otherwise(F.col("tax")))


def correct_long(df: DataFrame, tolerance: float = 0.25, most: float = 20.0) -> DataFrame:
    """Of long receipts: a mismatch is mended by the tax where that stays within bounds; a missing total is the sum."""
    delta = F.round(F.col("total") - F.col("subtotal"), 2)
    off = (F.abs(F.col("subtotal") + F.col("tax") - F.col("total")) > tolerance) & delta.between(0, most)
    total = F.coalesce("total", F.round(F.col("subtotal") + F.col("tax"), 2))
    return df.select(*(c for c in df.columns if c not in ("tax", "total")), F.when(off, delta).otherwise(F.col("tax")).alias("tax"), total.alias("total"))


def distinct_sum(values: Column, eps: float = 0.005) -> Column:
    """Sum of tax parts, equal ones once, to the cent."""
    from .tables import near_distinct

    return F.round(F.aggregate(near_distinct(values, eps), F.lit(0.0), lambda a, x: a + x), 2)


def split_pairs(values: DataFrame, base: str = "base", eps: float = 0.06, share: float = 0.40) -> DataFrame:
    """subtotal and tax of each receipt (rows: receipt_id, base, value, distinct): the two of its values
    whose sum is nearest to the base, within ``eps``, tax at most ``share`` of it; of equals the larger
    subtotal. A receipt has at most 24 tail values and its keyword lines, so the join by receipt is small."""
    pos = values.filter((F.col("value") > 0) & (F.col("value") <= F.col(base) + 5))
    a, b = pos.select("receipt_id", base, F.col("value").alias("s")), pos.select(F.col("receipt_id").alias("r"), F.col("value").alias("t"))
    err = F.abs(F.col("s") + F.col("t") - F.col(base))
    pairs = a.join(b, (F.col("receipt_id") == F.col("r")) & (F.col("s") > F.col("t"))).filter((F.col("t") <= share * F.col(base)) & (err <= eps))
    best = F.min_by(F.struct("s", "t"), F.struct(F.round(err, 9), -F.col("s")))
    return pairs.groupBy("receipt_id").agg(best.alias("p")).select("receipt_id", F.col("p.s").alias("subtotal"), F.col("p.t").alias("tax"))


def gratuity(values: DataFrame, marked: str = "has_keyword", eps: float = 0.06, share: float = 0.40) -> DataFrame:
    """pre_total and gratuity of each receipt (rows: receipt_id, total, value, has_keyword): a value up to
    ``share`` of the total such that another value is the rest, or near it where the receipt speaks of a tip."""
    pos = values.filter("value > 0")
    g = pos.filter(F.col("value") <= share * F.col("total")).select("receipt_id", "total", marked, F.col("value").alias("g"))
    rest = pos.filter(F.col("value") < F.col("total")).select(F.col("receipt_id").alias("r"), F.col("value").alias("c"))
    gap = F.min(F.abs(F.col("total") - F.col("g") - F.col("c")))
    scored = g.join(rest, F.col("receipt_id") == F.col("r")).groupBy("receipt_id", "total", marked, "g").agg(gap.alias("err"))
    score = F.when(F.col("err") <= eps, 0.5).otherwise(0.0) + F.when(F.col(marked), 0.2).otherwise(0.0) - F.col("err")
    best = scored.filter((F.col("err") <= eps) | F.col(marked)).groupBy("receipt_id", "total").agg(F.max_by("g", score).alias("gratuity"))
    return best.select("receipt_id", F.round(F.col("total") - F.col("gratuity"), 2).alias("pre_total"), "gratuity")


#: Tax words by region; the universal ones hold everywhere.
TAX_WORDS = {
    "UNIVERSAL": [
        "TAX", "VAT", "GST", "HST", "PST", "QST", "SALES TAX", "SERVICE TAX", "SVC", "SERVICE", "IVA", "MWST", "TVA", "BTW", "GST/HST", "KDV", "MOMS", "IGIC", "ICMS", "ISS", "IPI",
        "TIP", "GRATUITY", "GRAT", "SERVICE CHARGE", "18% GRATUITY", "15% GRATUITY",
    ],
    "CANADA": ["GST", "HST", "PST", "QST", "GST/HST"],
    "USA": ["SALES TAX", "TAX", "STATE TAX", "CITY TAX"],
    "EU": ["VAT", "TVA", "MWST", "IVA", "BTW"],
}
#: What a tip is called, and how money is written in a summary line.
TIPS = ("GRATUITY", "TIP", "SERVICE CHARGE")
AMOUNT = r"([-(]?\$?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2}))"
TIME_LINE = r"(?i)^\d{1,2}[:.]\d{2,4}(\s*[ap]\.?m\.?)*$"


def tax_words(regions: Column) -> Column:
    """The tax words of the regions in their order, each once."""
    lists = F.create_map(*(x for k, v in TAX_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_distinct(F.flatten(F.transform(regions, lambda r: F.try_element_at(lists, r))))


def summary_lines(text: Column, most: int = 3) -> Column:
    """Array of struct(line, value, total, subtotal, tax, tip) of a receipt's non-blank lines: the last amount
    (none in a line of a time or of percents) and which keywords the line holds or nearly is. A line of a
    subtotal holds TOTAL too."""
    from ..functions.money import let, normalize_amount
    from ..functions.report import SUBTOTAL_WORDS, TOTAL_WORDS
    from ..functions.text import any_of, best_keyword, regions

    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    american = F.array_contains(regions(text), "USA")

    def read(line: Column, up: Column, american: Column) -> Column:
        raw = F.try_element_at(F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(1)), F.lit(-1))
        percent = up.contains("%") & ~any_of(up, ("$", "USD", "CAD"))
        value = F.when(~percent & ~line.rlike(TIME_LINE), let(raw, normalize_amount))
        near = lambda words: best_keyword(up, words, most).isNotNull()
        tax = near(TAX_WORDS["UNIVERSAL"]) | (american & near(TAX_WORDS["USA"]))  # the other regions' words are universal too
        return F.struct(line.alias("line"), value.alias("value"), near(TOTAL_WORDS).alias("total"), near(SUBTOTAL_WORDS).alias("subtotal"), tax.alias("tax"), any_of(up, TIPS).alias("tip"))

    return let(american, lambda us: let(lines, lambda x: F.transform(x, lambda line: let(F.upper(line), lambda up: read(line, up, us)))))


def fuzzy(df: DataFrame, text: str = "text", eps: float = 0.06, share: float = 0.40, tail: int = 24) -> DataFrame:
    """subtotal, tax, total, pre_total and gratuity of each receipt from its text, within the row.

    1. The last value of the lines of each keyword. 2A. Where a subtotal's line has the tax and one of the two
    lines before it the subtotal, so that they sum to the total, they change places. 2B. The total is the
    largest value of its lines, else of the last ``tail`` lines; among those lines' values and the keywords' a
    gratuity is sought whose rest is another value, and then the two values that sum to what is left."""
    got = df.withColumn("_lines", summary_lines(F.col(text)))
    values = lambda keep: F.filter(F.transform(F.filter("_lines", keep), lambda x: x["value"]), lambda v: v.isNotNull())
    last = lambda a: F.try_element_at(F.col(a), F.lit(-1))
    got = got.withColumns({"_total": values(lambda x: x["total"]), "_subtotal": values(lambda x: x["subtotal"]), "_tax": values(lambda x: x["tax"]), "_tip": values(lambda x: x["tip"])})
    got = got.withColumn("_tail", F.filter(F.transform(F.slice(F.reverse("_lines"), 1, tail), lambda x: x["value"]), lambda v: v.isNotNull()))

    free = lambda i: (lambda x: F.when(~x["total"] & ~x["subtotal"] & ~x["tax"], x["value"]))(F.get(F.col("_lines"), i))
    swapped = F.filter(F.transform("_lines", lambda x, i: F.struct(F.when(x["subtotal"], x["value"]).alias("now"), F.coalesce(free(i - 1), free(i - 2)).alias("before"))),
                       lambda p: (F.abs(p["now"] + p["before"] - last("_total")) <= eps) & (p["before"] >= p["now"]))
    got = got.withColumn("_swap", F.get(swapped, F.lit(0)))

    every = F.array_distinct(F.transform(F.concat(F.reverse("_tail"), "_subtotal", "_tax", "_total", "_tip"), lambda v: F.round(v, 4)))
    final = F.coalesce(F.array_max("_total"), F.array_max(F.filter("_tail", lambda v: v > 0)))
    got = got.withColumns({"_all": every, "_final": final, "_asks": F.exists("_lines", lambda x: x["tip"])})

    def weigh(g: Column) -> Column:
        rest = F.col("_final") - g
        gaps = F.transform(F.filter("_all", lambda v: (v > 0) & (v < F.col("_final"))), lambda v: F.abs(rest - v))
        gap = F.coalesce(F.array_min(gaps), F.lit(0.0))
        score = F.when((F.size(gaps) > 0) & (gap <= eps), 0.5).otherwise(0.0) + F.when(F.col("_asks"), 0.2).otherwise(0.0) - gap
        return F.struct(g.alias("g"), gap.alias("gap"), F.round(score, 9).alias("score"))

    tips = F.filter(F.array_distinct(F.concat(F.transform("_tip", lambda v: F.round(v, 4)), "_all")), lambda g: (g > 0) & (g <= share * F.col("_final")))
    fits = F.filter(F.transform(tips, weigh), lambda w: (w["gap"] <= eps) | F.col("_asks"))
    best = F.aggregate(fits, F.struct(F.lit(None).cast("double").alias("g"), F.lit(None).cast("double").alias("gap"), F.lit(None).cast("double").alias("score")), lambda a, w: F.when(a["g"].isNull() | (w["score"] > a["score"]), w).otherwise(a))
    got = got.withColumn("_grat", best["g"]).withColumn("_base", F.coalesce(F.col("_final") - F.col("_grat"), F.col("_final")))

    some = F.filter("_all", lambda v: (v > 0) & (v <= F.col("_base") + 5))
    pairs = F.flatten(F.transform(some, lambda s: F.transform(F.filter(some, lambda t: (t < s) & (t <= share * F.col("_base")) & (F.abs(s + t - F.col("_base")) <= eps)), lambda t: F.struct(F.round(F.abs(s + t - F.col("_base")), 9).alias("gap"), (-s).alias("minus"), t.alias("tax")))))
    got = got.withColumn("_pair", F.array_min(pairs))
    cents = lambda c: F.round(c, 2)
    return got.select(
        *df.columns, F.coalesce(-F.col("_pair.minus"), F.col("_swap.before"), last("_subtotal")).alias("subtotal"), F.coalesce(F.col("_pair.tax"), F.col("_swap.now"), last("_tax")).alias("tax"),
        F.coalesce("_final", last("_total")).alias("total"), cents(F.when(F.col("_grat").isNotNull(), F.col("_base"))).alias("pre_total"), F.col("_grat").alias("gratuity"),
    )


def subtotal_of_spans(spans: Column) -> Column:
    """The first number between 10 and 10,000 among the tokens of summary spans (type, text, tokens) that speak
    of a subtotal."""
    said = F.filter(spans, lambda s: (s["type"] == "SUMMARY_LINE") & F.upper(s["text"]).contains("SUBTOTAL"))
    numbers = F.flatten(F.transform(said, lambda s: F.transform(s["tokens"], lambda t: t.try_cast("double"))))
    return F.get(F.filter(numbers, lambda v: (v > 10) & (v < 10000)), F.lit(0))


def rescue(df: DataFrame, first: DataFrame, rows: DataFrame, first_conf: float = 0.80, rows_conf: float = 0.92) -> DataFrame:
    """Summaries with what they miss filled from a first reading (``first_conf``), then from the rows'
    (``rows_conf``): receipt_id and any of NAMES each."""
    out = df
    for other, conf in ((first, first_conf), (rows, rows_conf)):
        names = [n for n in NAMES if n in other.columns]
        out = out.join(other.select("receipt_id", *(F.col(n).alias(f"_{n}") for n in names)), "receipt_id", "left")
        values = {}
        for n in names:
            take = F.col(n).isNull() & F.col(f"_{n}").isNotNull()
            values |= {n: F.coalesce(n, f"_{n}"), f"{n}_confidence": F.when(take, conf).otherwise(F.col(f"{n}_confidence"))}
        out = out.withColumns(values).drop(*(f"_{n}" for n in names))
    return out


def row_tax(rows: DataFrame, most: float = 20.0, conf: float = 0.92) -> DataFrame:
    """tax of each receipt from its rows: the sum of the distinct amounts up to ``most`` of rows that name a tax,
    not counting a base that is written before ``@ rate``."""
    from ..functions.money import rightmost_amount

    bare = F.regexp_replace("text", r"\$?\d+[.,]\d{2}\s*@\s*\d+(?:[.,]\d+)?\s*%?", " ")
    named = rows.filter(F.upper("text").rlike(r"\b(TAX|GST|HST|PST|QST|VAT)\b") & ~F.upper("text").contains("TOTAL")).withColumn("amount", rightmost_amount(bare))
    got = named.filter(F.col("amount").between(0, most)).groupBy("receipt_id").agg(distinct_sum(F.array_sort(F.collect_list("amount"))).alias("tax"))
    return got.withColumn("tax_confidence", F.lit(conf))
