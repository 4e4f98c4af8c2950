"""Long receipts: items from printed rows.

What a row is (its name, prices, unit price, kind) is read from its text, once for each text that a task meets; the pairing
of names and prices uses rows up in order. Both are one kernel per receipt.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from ..functions import scalar, text
from ..functions.scalar import REMEMBERED, pattern
from .items import price_of
from .streams import by_receipt, isolated

# Prices by unit, amounts, weights, words without letters.
_UNIT_PRICE, _MONEY = pattern(r"(\$\s*\d+[.,]\d{2})\s*/\s*(?:kg|lb|lbs)", True), pattern(r"([-+]?\$?\d+[.,]\d{2})")
_WEIGHT, _SIGNS, _SPACE = pattern(r"\b\d+(?:[.,]\d+)?\s*(kg|lb|lbs)\b", True), pattern(r"^[\d.,$%\-+/\\]+$"), pattern(r"\s+")


def is_dull(u: str) -> bool:
    """Words that cut a name: units, numbers, codes, section words, junk."""
    return u in text.JUNK or u in text.WEAK or bool(_SIGNS.search(u)) or scalar.is_section(u)


@lru_cache(REMEMBERED)
def features(t: str) -> tuple:
    """Of a row's text what pairing needs: name, prices, all prices, junk, skip, has a unit price, and the clean parts of a
    row that names several items. A row is cut at its dull words; the parts that are good names stay."""
    unit = [v for x in _UNIT_PRICE.findall(t) if (v := price_of(x, 0.0)) is not None]
    found = [(x, price_of(x, 0.0)) for x in _MONEY.findall(t)]
    final = [v for x, v in found if v is not None and not any(abs(u - v) < 0.005 for u in unit) and not scalar.is_tax_rate(x, v)]
    prices = [v for v in final if not 0 < v < 3.5] if _WEIGHT.search(t) else final
    parts: list[str] = []
    if len(final) >= 2:
        cut = " ".join("\n" if is_dull(w) else w for w in _SPACE.split(t.upper()))
        parts = [n for x in cut.split("\n") if (n := scalar.good_name(x))]
    u = t.strip(" ").upper()
    return scalar.good_name(t), prices, final, scalar.is_junk_row(t), scalar.is_section(u) or scalar.is_footer(u) or scalar.is_summary_anchor(t), bool(unit), parts


@dataclass
class Row:
    """One printed row as the pairing sees it."""

    name: str | None
    prices: list[float]
    final: list[float]
    junk: bool
    skip: bool
    unit: bool
    parts: list[str]
    y: float
    conf: float
    used: bool = False


def by_layout(rows: list[Row], tolerance: float = 15) -> list[tuple[str, float, float, str]]:
    """Prices that stand alone with names on the same physical line, else on the line before, else after,
    unless that line has a price of its own. Rows that were paired are used up."""
    lines: list[list[int]] = []
    top = None
    for i in sorted(range(len(rows)), key=lambda i: rows[i].y):
        if top is None or abs(rows[i].y - top) > tolerance:
            lines.append([])
            top = rows[i].y
        lines[-1].append(i)
    lines = [sorted(x) for x in lines]
    free = lambda line: [i for i in line if not rows[i].used and not rows[i].skip]
    priced = lambda line: any(rows[i].final and not rows[i].junk for i in line)
    out = []
    for k, line in enumerate(lines):
        alone = [(i, p) for i in free(line) if rows[i].junk for p in rows[i].final]
        if not alone:
            continue
        for step, where in ((0, "same"), (-1, "prev"), (1, "next")):
            if not 0 <= k + step < len(lines) or step and priced(lines[k + step]):
                continue
            names = [i for i in free(lines[k + step]) if rows[i].name]
            if names:
                for (i, p), j in zip(alone, names):
                    out.append((rows[j].name, p, rows[i].conf, f"long_row_layout_{where}_line"))
                    rows[i].used = rows[j].used = True
                break
    return out


def in_order(rows: list[Row]) -> list[tuple[str, float, float, str]]:
    """Names and prices of the rows that are left, in order; a name waits for the next price, and gives
    way only to a name with more letters."""
    letters = lambda s: sum(ch.isalpha() for ch in s)
    out: list[tuple[str, float, float, str]] = []
    waiting: str | None = None
    i = 0
    while i < len(rows):
        r = rows[i]
        i += 1
        if r.used or r.skip:
            continue
        if len(r.prices) >= len(r.parts) >= 2:
            out += [(n, p, r.conf, "long_row_seq_multi_split") for n, p in zip(r.parts, r.prices)]
            r.used, waiting = True, None
        elif r.name and r.prices and not r.unit:
            chosen = r
            j = next((j for j in range(i, len(rows)) if not rows[j].used), None)
            if j is not None and rows[j].junk and not rows[j].skip and rows[j].prices and abs(rows[j].prices[-1] - r.prices[-1]) > 0.005:
                chosen, i = rows[j], j + 1
            out.append((r.name, chosen.prices[-1], chosen.conf, "long_row_seq_direct"))
            r.used = chosen.used = True
            waiting = None
        elif r.name and not r.prices:
            if waiting is None or letters(r.name) > letters(waiting):
                waiting, r.used = r.name, True
        elif r.prices and waiting is not None and (r.junk or not r.name):
            out.append((waiting, r.prices[-1], r.conf, "long_row_seq_junk" if r.junk else "long_row_seq_price"))
            r.used, waiting = True, None
    return out


ITEMS = "receipt_id long, item_no int, name string, price double, price_confidence double, source string"


def pair_rows(rows: list[tuple]) -> list[tuple[str, float, float, str]]:
    """Items of rows (text, y_top, conf) in order: by layout first, then in order over what is left."""
    data = [Row(*features(t), float(y or 0), float(c or 0)) for t, y, c in rows]
    return by_layout(data) + in_order(data)


def extract_long_items(rows: DataFrame) -> DataFrame:
    """Items of every receipt's rows (receipt_id, row_id, text, y_top, conf). A receipt that fails gives no rows."""

    def run(receipt, rows: list[tuple]) -> list[tuple]:
        return [(receipt, k, *x) for k, x in enumerate(pair_rows([(t or "", y, c) for _, t, y, c in rows]), 1)]

    fields = [tuple(c.split()) for c in ITEMS.split(", ")]
    return by_receipt(rows, ("receipt_id", "row_id", "text", "y_top", "conf"), "row_id", isolated(run, len(fields)), fields)
