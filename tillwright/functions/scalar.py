"""Scalar forms of what ``text``, ``money`` and ``summary`` say of one value, for kernels over a receipt; tests hold the
two together. Patterns read digits, white space and the case of letters as the column functions do, in ASCII. What is asked
of a text is remembered, as receipts share most of their words."""

from __future__ import annotations

import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

from .money import TAX_RATES
from .text import JUNK, PAYMENT_PHRASES, PROMO_PHRASES, SECTIONS, UNITS, WEAK, WEAK_PARTS

#: Bound: readings of texts that a task remembers.
REMEMBERED = 1 << 15
_WHITE = r" \t\n\x0b\f\r"
_PART, _END = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\$|[A-Za-z]"), r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"


def pattern(p: str, any_case: bool = False) -> re.Pattern:
    """A pattern of the column functions, read as they read it."""

    def one(m: re.Match) -> str:
        x = m[0]
        if x[0] == "[":
            return x.replace(r"\d", "0-9").replace(r"\s", _WHITE)
        known = {r"\d": "[0-9]", r"\s": f"[{_WHITE}]", "$": _END}.get(x)
        return known or (f"[{x.lower()}{x.upper()}]" if any_case and x.isalpha() else x)

    return re.compile(_PART.sub(one, p))


# The patterns of ``text`` and ``money``.
_SPACE = pattern(r"\s+")
_SECTION = pattern(r"^\d{1,2}\s*-\s*[A-Z]+|\b(" + "|".join(SECTIONS) + r")\b")
_FOOTER = pattern("|".join(map(re.escape, (*PROMO_PHRASES, *PAYMENT_PHRASES))) + r"|\b(VERIFIED|PIN|CARD|MASTERCARD|VISA|CREDIT|APPLE|TRIAL|MEMBERS|GET UP TO)\b")
_ANCHOR = pattern(r"\b(subtotal|total|tax|gst|pst|hst|qst|amount|tendered|change)\b", True)
_UNIT_NAME = pattern(r"^(?:(kg|lb|lbs|ea|each|pk|unit|int|/kg|/lb)|\d+(?:[.,]\d+)?\s*(kg|lb|lbs|g|gm|ea|each))$|^\d{5,}$", True)
_COUNT_NAME = pattern(r"^(?:(INT|EA|EACH|PK)\s*\d*|\d+\s*(EA|EACH|PK))$")
_NO_LETTERS = pattern(r"^[^A-Za-z_]+$")
_TAKEN_OFF = (
    pattern(r"^\d{1,2}\s*-\s*[A-Za-z]+\s*"), pattern(r"^\d{5,}\s+"), pattern(r"\b(MRJ|HRJ|NRJ|GRJ|PRJ|GPHRJ|GPRQ|GPRO|GPMRJ)\b", True), pattern(r"[-+]?\$?\d+(?:[.,]\d{2})"),
    pattern(r"\b\d+(?:[.,]\d+)?\s*(kg|lb|lbs|ea|each)\b", True), pattern(r"\b(GROSS|NET|TARE|INT|EA|KG|LB|LBS|PT|NT|RP|IS|UNIT|PK)\b", True))
_NAME_ENDS = pattern(r"^[ \-:;,.]+|[ \-:;,.]+$")
_JUNK_PARTS = (pattern(r"[-+]?\$?\d+(?:[.,]\d{2,})"), pattern(r"\b\d+(?:[.,]\d+)?\s*%"), pattern(r"\b(" + "|".join(w for w in JUNK if w.isalpha()) + r")\b", True), pattern(r"^[ \-:;,./]+|[ \-:;,./]+$"))
_KEY = re.compile("[^a-z0-9 ]+")
_MONEY, _RATE = pattern(r"[-+]?\$?\d+(?:[.,]\d{2})"), pattern(r"^(5|6|7|13|15)(?:[.,]0+)?$")
_CENT = Decimal("0.01")


def letters(t: str) -> int:
    return sum([ch.isalpha() for ch in t])


def is_section(u: str) -> bool:
    """Of a trimmed upper-case text."""
    return bool(_SECTION.search(u))


@lru_cache(REMEMBERED)
def is_footer(u: str) -> bool:
    """Of a trimmed upper-case text."""
    return bool(_FOOTER.search(u))


def is_summary_anchor(t: str) -> bool:
    return bool(_ANCHOR.search(t))


@lru_cache(REMEMBERED)
def is_weak_name(t: str) -> bool:
    t = t.strip(" ")
    u = t.upper()
    if u == "" or u in WEAK or u in JUNK or t.startswith("$") or _UNIT_NAME.search(t) or _COUNT_NAME.search(u) or is_section(u) or is_footer(u):
        return True
    parts = [x for x in _SPACE.split(u) if x]
    clean = [x for x in parts if x not in WEAK and x not in JUNK and not _NO_LETTERS.search(x)]
    if len(clean) >= 2 and letters(" ".join(clean)) >= 5 and not any(x in UNITS for x in clean):
        return False
    latin = [ch for ch in u if "A" <= ch <= "Z"]
    a, d, n, single = letters(t), sum([ch.isdecimal() for ch in t]), len(latin), " " not in u
    marks = sum([unicodedata.category(ch)[0] not in "LN" and ch not in " \t\n\x0b\f\r" for ch in t])
    vowels = sum([ch in "AEIOU" for ch in latin])
    return (
        a < 3 or len(u) <= 2 and u not in ("XL", "BB") or d >= a and d >= 2 or d >= 2 and marks >= 1 and a <= 8 or d >= 1 and d >= a and a <= 6
        or n >= 4 and single and vowels == 0 or n >= 5 and len(clean) <= 1 and single and vowels / n < 0.15 or letters(u) / len(u) < 0.20
        or bool(parts) and all(x in WEAK_PARTS or _NO_LETTERS.search(x) for x in parts) or a <= 4 and any(x in ("EA", "INT", "EACH") for x in parts)
    )


@lru_cache(REMEMBERED)
def good_name(t: str) -> str | None:
    t = t.strip(" ")
    for p in _TAKEN_OFF:
        t = p.sub("", t).strip(" ")
    t = _NAME_ENDS.sub("", _SPACE.sub(" ", t))
    return t if t and not is_weak_name(t) else None


def is_junk_row(t: str) -> bool:
    s = t = t.strip(" ")
    for p in _JUNK_PARTS:
        s = p.sub("", s)
    return t == "" or s == "" or is_weak_name(s)


@lru_cache(REMEMBERED)
def name_key(t: str) -> str:
    return _KEY.sub("", _SPACE.sub(" ", t.strip(" ").lower()))


@lru_cache(REMEMBERED)
def to_cent(v: float) -> float:
    return float(Decimal(repr(v)).quantize(_CENT, ROUND_HALF_UP))


def is_tax_rate(raw: str, value: float | None) -> bool:
    return "%" in raw or bool(_RATE.search(raw.replace("$", "").strip(" "))) or value in TAX_RATES


def money_spans(t: str) -> list[tuple[int, int, float, str]]:
    """(start, end, value, raw) of all money in a text, in order."""
    from ..operators.items import price_of

    found = ((m.start(), m.end(), price_of(m[0], 0.0), m[0]) for m in _MONEY.finditer(t))
    return [x for x in found if x[2] is not None]


def distinct_sum(values: list[float], eps: float = 0.005) -> float:
    """Sum of tax parts, equal ones once, to the cent."""
    kept: list[float] = []
    for v in values:
        if not any(abs(k - v) < eps for k in kept):
            kept.append(v)
    total = 0.0
    for v in kept:
        total += v
    return to_cent(total)
