"""The summary of a long receipt, and where its items end.

It is read twice: from the runs of equal labels, where each field is the surest value and a tax's amount may stand
up to two groups after its word, and from the printed rows. Both give all candidates and the two stops, receipt by receipt
in the kernel of ``long_blocks``; what follows is arithmetic within a row.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money, scalar
from ..functions.scalar import REMEMBERED, pattern
from .items import price_of

# Words of taxes (misread ones too) and discounts in groups and in rows, labels that end the items.
TAX_GROUP = pattern(r"\b(TAX|GST|PST|HST|QST|VAT|G5T|P5T|H5T|Q5T|6ST|PSD|HSD|QSD)\b", True)
DISCOUNT_GROUP = pattern(r"\b(SAVE|SAVINGS|DISCOUNT|COUPON|PROMO|ARCP|POINTS REDEEMED)\b", True)
SUBTOTAL, TOTAL = pattern(r"\bSUBTOTAL\b", True), pattern(r"\bTOTAL\b", True)
NAMED_TAX, PLAIN_TAX = pattern(r"\b(GST|PST|HST|QST)\b"), pattern(r"\bTAX\b")
BASE, RATE = pattern(r"(\d+(?:[.,]\d+)?)\s*@\s*\d+(?:[.,]\d+)?\s*%"), pattern(r"@\s*(\d+(?:[.,]\d+)?)\s*%")
DISCOUNT_ROW = ("SAVE", "SAVINGS", "ARCP", "POINTS REDEEMED")
TAX_LABELS = ("B-TAX", "I-TAX", "B-SUM.TAX", "I-SUM.TAX")
STOP_LABELS = ("B-SUM.SUBTOTAL", "B-SUM.TOTAL", "B-SUM.TAX", "B-TAX")
#: Bounds: a tax part of a group and of a row, a tax that is the difference of total and subtotal, what a sum may be off by.
PART_GROUP, PART_ROW, MOST_TAX, OFF_TAX, OFF_SUM, OFF_ITEMS = 10.0, 20.0, 20.0, 1.0, 0.25, 1.00
FIELDS = ("subtotal", "tax", "total", "discount")
KEY = "receipt_id"
#: What groups and rows say of a receipt: a value and its confidence for each field, what rows say of a field that is
#: missing otherwise, and the sum of the items.
FIRST = ("first_subtotal", "first_total", "rescue_subtotal", "rescue_total")
SAID = [(KEY, "long"), *((f"{by}_{f}_{x}", "double") for by in "gr" for f in FIELDS for x in "vc"), *((c, "double") for c in FIRST), ("items_sum", "double")]


@lru_cache(REMEMBERED)
def _group(t: str) -> tuple:
    """Of a group's text: its value, whether that is a tax amount (no percent sign, no whole number that is a rate, 0 to
    PART_GROUP), names a discount, savings, a tax, subtotal, total, whether it begins the summary, a footer."""
    value, up = price_of(t, 0.0), t.upper()
    fits = "%" not in t and value is not None and value not in money.TAX_RATES and 0 <= value <= PART_GROUP
    savings = "TOTAL" in up and "SAVINGS" in up
    return (
        value, fits, bool(DISCOUNT_GROUP.search(t)), savings, bool(TAX_GROUP.search(t)) and not savings, bool(SUBTOTAL.search(t)), bool(TOTAL.search(t)) and "SUBTOTAL" not in up,
        scalar.is_summary_anchor(t), scalar.is_footer(t.strip(" ").upper()))


def label_groups(tokens: list[tuple]) -> list[tuple[int, str, str, float]]:
    """(start, label, text, conf) of each run of tokens of one type: a B and a change of type begin a group, tokens without a
    label are a type of their own."""
    out: list[list] = []
    last = None
    for t in tokens:
        label, conf = t[2] or "O", t[3] or 0.0
        begins = label[:2] == "B-"
        kind = label[2:] if begins or label[:2] == "I-" else label
        if begins or kind != last:
            out.append([t[0], label, [t[1] or ""], conf])
            last = kind
        else:
            g = out[-1]
            g[1] = min(g[1], label)
            g[2].append(t[1] or "")
            g[3] += conf
    return [(start, label, " ".join(words).strip(" "), conf / len(words)) for start, label, words, conf in out]


def read_groups(tokens: list[tuple]) -> tuple[tuple, int | None]:
    """Value and confidence of each field, the surest value and the later of equals, and the idx at which the first group of a
    summary or footer begins."""
    groups = label_groups(tokens)
    read = [_group(g[2]) for g in groups]
    subtotal = total = discount = (None, None)
    parts, stop = [], None
    for i, ((start, label, _, conf), (value, fits, cheap, savings, named, says_subtotal, says_total, anchor, footer)) in enumerate(zip(groups, read)):
        if stop is None and (anchor or label in STOP_LABELS or footer and conf >= 0.50):
            stop = start
        if not cheap and fits and (label in TAX_LABELS or named):
            parts.append(value)
        elif not cheap and not fits and named:
            parts += [x[0] for x in read[i + 1 : i + 3] if x[1]][:1]
        if value is None:
            continue
        if (label in ("B-SUM.SUBTOTAL", "I-SUM.SUBTOTAL") or says_subtotal) and (subtotal[1] is None or conf >= subtotal[1]):
            subtotal = value, conf
        if not savings and (label in ("B-SUM.TOTAL", "I-SUM.TOTAL") or says_total) and (total[1] is None or conf >= total[1]):
            total = value, conf
        if cheap:
            discount = abs(value), conf
    tax = (scalar.distinct_sum(parts), 0.85) if parts else (None, None)
    return (*subtotal, *tax, *total, *discount), stop


def printed(tokens: list[tuple]) -> list[tuple]:
    """(row_id, text, y_top, conf) of each printed row, in order."""
    out: dict[int | None, list] = {}
    for _, word, _, conf, _, y1, _, _, row in tokens:
        r = out.get(row)
        if r is None:
            r = out[row] = [[], None, 0.0, 0]
        if word is not None:
            r[0].append(word)
        if y1 is not None and (r[1] is None or y1 < r[1]):
            r[1] = y1
        if conf is not None:
            r[2] += conf
            r[3] += 1
    return [(k, " ".join(words), y, conf / n if n else None) for k, (words, y, conf, n) in sorted(out.items(), key=lambda x: (x[0] is not None, x[0] or 0))]


@lru_cache(REMEMBERED)
def _row(t: str) -> tuple:
    """Of a row's text: whether it is a subtotal, a total, a discount, any total, whether it begins the summary; its last amount
    that is no rate, its tax part and its last amount."""
    spans, up = scalar.money_spans(t), t.upper()
    kept = [v for _, end, v, raw in spans if "%" not in t[end : end + 3] and not scalar.is_tax_rate(raw, v)]
    any_total = "TOTAL" in up and "SAVINGS" not in up
    sub = bool(spans) and "SUBTOTAL" in up
    tot = bool(spans) and any_total and "SUBTOTAL" not in up
    off = bool(spans) and not sub and not tot and any(w in up for w in DISCOUNT_ROW)
    part = _row_tax(t, up, spans) if spans and not sub and not tot and not off else None
    stops = any_total or scalar.is_summary_anchor(t) or scalar.is_footer(t.strip(" ").upper())
    return sub, tot, off, bool(spans) and any_total, stops, kept[-1] if kept else None, part, spans[-1][2] if spans else None


def _row_tax(t: str, up: str, spans: list[tuple]) -> float | None:
    """A row's tax part. Of a named tax the last amount that is no rate and neither base nor rate of ``base @ rate %``;
    of a plain TAX row its last amount."""
    if NAMED_TAX.search(up):
        other = [float(x.replace(",", ".")) for p in (BASE, RATE) for x in p.findall(t)]
        free = [v for _, end, v, raw in spans if not any(abs(b - v) < 0.005 for b in other) and "%" not in t[end : end + 3] and not scalar.is_tax_rate(raw, v) and 0.01 <= v <= PART_ROW]
        return free[-1] if free else None
    plain = spans[-1][2]
    return plain if PLAIN_TAX.search(up) and 0 <= plain <= PART_ROW else None


def read_rows(rows: list[tuple]) -> tuple[tuple, int | None]:
    """Value and confidence of each field, FIRST, and the row at which summary or footer begin."""
    subtotal = total = discount = (None, None)
    first: dict[str, float] = {}
    parts, stop = [], None
    for row, t, *_ in rows:
        if not t:
            continue
        sub, tot, off, any_total, stops, amount, part, last = _row(t)
        if part is not None:
            parts.append(part)
        if row is None:  # without a place it is neither the first nor the last
            continue
        if stops and stop is None:
            stop = row
        if off:
            discount = abs(last), 0.85
        if amount is None:
            continue
        if sub:
            subtotal = amount, 0.95
            first.setdefault("first_subtotal", amount)
            if amount > 0:
                first.setdefault("rescue_subtotal", amount)
        if tot:
            total = amount, 0.95
            if amount > 0:
                first.setdefault("rescue_total", amount)
        if any_total:
            first.setdefault("first_total", amount)
    tax = (scalar.distinct_sum(parts), 0.90) if parts else (None, None)
    return (*subtotal, *tax, *total, *discount, *map(first.get, FIRST)), stop


def settle(said: DataFrame) -> DataFrame:
    """subtotal, tax, total, discount and their confidences of each receipt (SAID).

    A row's value stands where the groups have none or are less sure. What is missing then is what the first row of its
    word says. A missing tax, or one that is off by more than OFF_TAX, is the difference of total and subtotal, where
    that is 0 to MOST_TAX; so is one with which the sum is off by more than OFF_SUM. A missing total is the sum; a
    missing subtotal is the items' sum, where that is the total but for OFF_ITEMS."""
    zero = F.lit(0.0)
    joined = said
    for f in FIELDS:
        row, group = (F.when(F.col(f"{by}_{f}_v").isNotNull(), F.struct(F.col(f"{by}_{f}_v").alias("v"), F.col(f"{by}_{f}_c").alias("c"))) for by in "rg")
        take = row.isNotNull() & (group.isNull() | (row["c"] >= group["c"]))
        joined = joined.withColumn(f"{f}_confidence", F.when(take, row["c"]).otherwise(F.coalesce(group["c"], zero))).withColumn(f, F.when(take, row["v"]).otherwise(group["v"]))
    for f in ("subtotal", "total"):
        for other, conf in ((f"first_{f}", 0.80), (f"rescue_{f}", 0.92)):
            take = F.col(f).isNull() & F.col(other).isNotNull()
            joined = joined.withColumns({f"{f}_confidence": F.when(take, F.greatest(F.col(f"{f}_confidence"), F.lit(conf))).otherwise(F.col(f"{f}_confidence")), f: F.coalesce(f, other)})
    delta = F.round(F.col("total") - F.col("subtotal"), 2)
    mend = F.coalesce(delta.between(0, MOST_TAX) & (F.col("tax").isNull() | (F.abs(F.col("tax") - delta) > OFF_TAX)), F.lit(False))
    joined = joined.withColumns({"tax": F.when(mend, delta).otherwise(F.col("tax")), "tax_confidence": F.when(mend, F.greatest("tax_confidence", F.lit(0.92))).otherwise(F.col("tax_confidence"))})
    unequal = F.coalesce((F.abs(F.col("subtotal") + F.col("tax") - F.col("total")) > OFF_SUM) & delta.between(0, MOST_TAX), F.lit(False))
    joined = joined.withColumn("tax", F.when(unequal, delta).otherwise(F.col("tax")))
    summed = F.col("total").isNull() & F.col("subtotal").isNotNull() & F.col("tax").isNotNull()
    joined = joined.withColumns({"total": F.when(summed, F.round(F.col("subtotal") + F.col("tax"), 2)).otherwise(F.col("total")), "total_confidence": F.when(summed, F.least("subtotal_confidence", "tax_confidence")).otherwise(F.col("total_confidence"))})
    bought = F.coalesce("items_sum", zero)
    fall = F.coalesce(F.col("subtotal").isNull() & (F.abs(bought - F.col("total")) <= OFF_ITEMS), F.lit(False))
    joined = joined.withColumns({"subtotal": F.when(fall, F.round(bought, 2)).otherwise(F.col("subtotal")), "subtotal_confidence": F.when(fall, 0.40).otherwise(F.col("subtotal_confidence"))})
    return joined.select(KEY, *(c for f in FIELDS for c in (f, f"{f}_confidence")))
