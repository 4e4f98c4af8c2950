"""Money, dates, codes and confidences: column functions that clean one value each.

All are built-in expressions. Texts that cannot be read give null, or the stated default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Misread pairs and what they stand for, replaced in this order.
MISREAD = (("O0", "00"), ("l1", "11"), ("S5", "55"), ("B8", "88"), ("Z2", "22"))
#: Code by currency symbol; "$" alone is the default.
SYMBOLS = {
    "US$": "USD", "USD$": "USD", "CAD$": "CAD", "C$": "CAD", "CA$": "CAD", "AU$": "AUD", "A$": "AUD", "NZ$": "NZD",
    "HK$": "HKD", "SG$": "SGD", "£": "GBP", "€": "EUR", "¥": "JPY", "¥CN": "CNY", "CN¥": "CNY", "₹": "INR", "₩": "KRW",
    "฿": "THB", "₺": "TRY", "₽": "RUB", "R$": "BRL", "MX$": "MXN", "ZAR": "ZAR", "R": "ZAR",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Whole numbers that are tax rates in percent.
TAX_RATES = (5.0, 6.0, 7.0, 13.0, 15.0)


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once: expressions that use it often stay small."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _double(c: Column) -> Column:
    return c.try_cast("double")


def _last(text: Column, pattern: str) -> Column:
    """The last match of a pattern's only group, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def safe_float(c: Column, default: float = 0.0) -> Column:
    """A number, or the default for null, empty or other text."""
    return F.coalesce(_double(c), F.lit(default))


def optional_float(c: Column) -> Column:
    return _double(c)


def clean_noise(c: Column) -> Column:
    """OCR noise removed: a long run of x is nothing, outer marks go, misread pairs are mended."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^x{6,}$", ""), r"^[\s*:;,.+=]+|[\s*:;,.+=]+$", "")
    for wrong, right in MISREAD:
        t = F.replace(t, F.lit(wrong), F.lit(right))
    return F.trim(t)


def parse_price(c: Column, least: float = 0.01, most: float = 2_000_000.0) -> Column:
    """A price: clock times are none, ``40:00`` is 40.00, ``9.95-`` and ``-9.95`` are negative; the last
    d.dd or d,dd, else the last .dd, else ,dd, else the longest whole number. 0 is a price; others must
    lie in least..most, negative ones not below -most."""
    def value(t: Column) -> Column:
        negative = t.rlike(r"-\s*$") | t.startswith("-")
        bare = F.trim(F.regexp_replace(t, r"^-+|-+\s*$", ""))
        return let(bare, lambda b: F.when(negative, -_unsigned(b)).otherwise(_unsigned(b)))

    def read(raw: Column) -> Column:
        clock = raw.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")
        dotted = F.when(raw.rlike(r"^\d{1,7}:\d{2}$"), F.replace(raw, F.lit(":"), F.lit("."))).otherwise(F.regexp_replace(raw, r"(?<=\d):(?=\d{2}\b)", "."))
        return F.when(~clock & (raw != ""), let(clean_noise(dotted), value))

    fits = lambda v: F.when((v == 0) | v.between(least, most) | v.between(-most, 0), v)
    return let(let(F.trim(c.cast("string")), read), fits)


def _unsigned(t: Column) -> Column:
    runs = F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1))
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    dotted = F.coalesce(_last(t, r"(\d+[.,]\d{2})"), _last(t, r"(\.[0-9]{2})"), _last(t, r"(,[0-9]{2})"))
    return F.coalesce(_double(F.replace(dotted, F.lit(","), F.lit("."))), _double(longest))


def normalize_amount(c: Column) -> Column:
    """An amount of a summary line: percents are none, currency marks go, (x) is negative, and of dot and
    comma the later one is the decimal mark; a lone comma is one if two digits follow it at the end."""
    def decimal(t: Column) -> Column:
        dot, comma = t.contains("."), t.contains(",")
        dot_later = F.length(F.substring_index(t, ".", -1)) < F.length(F.substring_index(t, ",", -1))
        dots, commas = F.replace(t, F.lit("."), F.lit("")), F.replace(t, F.lit(","), F.lit(""))
        pointed = lambda x: F.replace(x, F.lit(","), F.lit("."))
        return F.when(dot & comma & dot_later, commas).when(dot & comma, pointed(dots)).when(t.rlike(r",\d{2}$"), pointed(t)).otherwise(commas)

    def signed(t: Column) -> Column:
        bare = F.regexp_replace(t, r"^\(|\)$", "")
        value = _double(let(bare, decimal))
        return F.when(t.startswith("(") | t.endswith(")"), -F.abs(value)).otherwise(value)

    percent = c.contains("%") & ~F.upper(c).rlike(r"\$|USD|CAD")
    return F.when(~percent, let(F.regexp_replace(c, r"[^0-9\-().,]", ""), signed))


def parse_money(c: Column) -> Column:
    """A number of a model's answer: O is 0, thousands separators and signs of currency go; to the cent."""
    s = F.trim(c.cast("string"))
    t = F.regexp_replace(F.translate(s, "Oo,$", "00"), r"[^\d.\-]", "")
    return F.when(~F.lower(s).isin("", "null", "none", "n/a"), F.round(_double(t), 2))


def parse_number(c: Column) -> Column:
    """Like parse_money, but letters are not read as digits and nothing is rounded."""
    return _double(F.regexp_replace(F.translate(F.trim(c.cast("string")), ",$", ""), r"[^\d.\-]", ""))


def repair_total_words(c: Column) -> Column:
    """Upper case, with two usual misreadings of TOTAL and SUBTOTAL mended."""
    return F.replace(F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit("COTAL"), F.lit("TOTAL")), F.lit("SUBTOTA"), F.lit("SUBTOTAL"))


def extract_amount(c: Column) -> Column:
    """The last amount in a text (commas dropped) as text, '' without one; four and more digits lose their sign."""
    found = F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), ",", ""), F.lit(r"([-+]?\d{1,3}\.\d{2}|\d+\.\d{2})"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def extract_amount_loose(c: Column) -> Column:
    """extract_amount of the repaired text, else its first d:dd or d.dd with a dot."""
    loose = lambda t: F.regexp_replace(F.regexp_extract(t, r"(\d{1,4}[:.]\d{2})", 1), ":", ".")
    return let(repair_total_words(c), lambda t: let(extract_amount(t), lambda strict: F.when(strict != "", strict).otherwise(loose(t))))


def money_values(c: Column) -> Column:
    """All money in a text, in order."""
    found = F.regexp_extract_all(c, F.lit(r"([-+]?\$?\d+(?:[.,]\d{2}))"), F.lit(1))
    return F.filter(F.transform(found, lambda x: parse_price(x, 0.0)), lambda x: x.isNotNull())


def money_spans(c: Column) -> Column:
    """Array of struct(start, end, value, raw) of all money in a text, in order; positions from 0, end exclusive.

    Matches don't overlap, so each is the first place of its text at or after the end of the one before."""
    found = F.regexp_extract_all(c, F.lit(r"([-+]?\$?\d+(?:[.,]\d{2}))"), F.lit(1))
    span = "array<struct<start:int,end:int,value:double,raw:string>>"
    none = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def step(a: Column, raw: Column) -> Column:
        start = F.call_function("locate", raw, c, a["at"] + 1) - 1
        one = lambda s: F.struct((s + F.length(raw)).alias("at"), F.array_append(a["spans"], F.struct(s.alias("start"), (s + F.length(raw)).alias("end"), parse_price(raw, 0.0).alias("value"), raw.alias("raw"))).alias("spans"))
        return let(start, one)

    return F.filter(F.aggregate(found, none, step, lambda a: a["spans"]), lambda m: m["value"].isNotNull())


def is_tax_rate(raw: Column, value: Column) -> Column:
    """Whether a number is a tax rate and not an amount: a percent sign, or exactly one of the rates."""
    bare = F.trim(F.replace(raw, F.lit("$"), F.lit("")))
    return F.coalesce(raw.contains("%") | bare.rlike(r"^(5|6|7|13|15)(?:[.,]0+)?$") | value.isin(*TAX_RATES), F.lit(False))


def rightmost_amount(c: Column) -> Column:
    """The last money that is no tax rate and has no percent sign within three characters after it."""
    found = F.regexp_extract_all(c, F.lit(r"([-+]?\$?\d+[.,]\d{2}(?!.{0,2}%))"), F.lit(1))
    priced = F.transform(found, lambda x: F.struct(x.alias("raw"), parse_price(x, 0.0).alias("value")))
    kept = F.filter(priced, lambda x: x["value"].isNotNull() & ~is_tax_rate(x["raw"], x["value"]))
    return F.try_element_at(kept, F.lit(-1))["value"]


def clean_text(c: Column) -> Column:
    """Trimmed, white space collapsed; blank and words for nothing are null."""
    t = F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))
    return let(t, lambda x: F.when(~F.lower(x).isin("", "null", "none", "n/a", "unknown"), x))


def normalize_currency(c: Column, default: str = "CAD") -> Column:
    """A three-letter code: as given, by symbol, or with leading dollar signs removed; else the default."""
    t = F.upper(clean_text(c))
    names, codes = F.array(*map(F.lit, SYMBOLS)), F.array(*map(F.lit, SYMBOLS.values()))
    known = F.try_element_at(F.map_from_arrays(names, codes), t)
    bare = F.trim(F.regexp_replace(t, r"^\$+", ""))
    return F.coalesce(F.when(t.rlike("^[A-Z]{3}$"), t), known, F.when(bare.rlike("^[A-Z]{3}$"), bare), F.lit(default))


#: Codes that are looked for before the symbols, the longer first.
CODES = ("CAD$", "AUD$", "USD$", "SGD$", "NZD$", "HKD$", "CA$", "CHF", "SEK", "NOK", "DKK", "NZD", "AUD", "SGD", "HKD", "THB", "CLP", "COP", "ARS", "ZAR", "AED", "SAR", "ILS", "R$")


def detect_currency(c: Column) -> Column:
    """Currency mark that a text contains: codes, then symbols, then the dollar; null without one."""
    marks = (*CODES, "£", "€", "¥", "₹", "$")
    out = F.lit(None)
    for m in reversed(marks):
        out = F.when(F.coalesce(c.contains(m), F.lit(False)), F.lit(m)).otherwise(out)
    return out


def split_currency(c: Column) -> Column:
    """struct(amount, currency) of a token like ``CA$12,50``; other tokens are the amount, trimmed."""
    t = F.trim(F.coalesce(c, F.lit("")))
    joined = t
    for spaced, plain in (("C A $", "CA$"), ("C A D", "CAD"), ("A U D", "AUD"), ("U S D", "USD")):
        joined = F.replace(joined, F.lit(spaced), F.lit(plain))
    joined = F.regexp_replace(joined, r"\s+", "")
    pattern = r"(?i)^(CA\$|CAD\$?|AUD\$?|USD\$?|SGD\$?|NZD\$?|HKD\$?|EUR|GBP|JPY|\$|€|£|¥)([-+]?\d{1,6}[.,]\d{2})$"

    def parts(x: Column) -> Column:
        amount = F.regexp_extract(x, pattern, 2)  # never empty in a token that fits
        return let(amount, lambda a: F.struct(F.when(a != "", F.replace(a, F.lit(","), F.lit("."))).otherwise(t).alias("amount"), F.when(a != "", F.regexp_extract(x, pattern, 1)).alias("currency")))

    return let(joined, parts)


def colon_price(c: Column) -> Column:
    """``h:mm`` with a dot where it is no time of day. A token has one such pair in practice."""
    pattern = r"\b(\d{1,4}):(\d{2})\b"
    pair = c.contains(":")
    h, m = F.regexp_extract(c, pattern, 1).try_cast("int"), F.regexp_extract(c, pattern, 2).try_cast("int")
    return F.when(pair & ((h > 23) | (m > 59)), F.regexp_replace(c, pattern, "$1.$2")).otherwise(c)


def normalize_word(c: Column) -> Column:
    """A token as the tagger wants it: decimal dots, no currency, no trailing marks or letters of a price."""
    t = let(F.regexp_replace(split_currency(c)["amount"], r"(\d),(\d{2})\b", "$1.$2"), colon_price)
    for pattern, to in ((r"^:(\d)", "$1"), (r"(\d\.\d{2})[.:*]+$", "$1"), (r"(\d\.\d{2})[A-Za-z]+$", "$1"), (r"(\d\.\d{2})-A\b", "$1"), (r"[<>\";]+", "")):
        t = F.regexp_replace(t, pattern, to)
    return t


def normalize_date(c: Column) -> Column:
    """yyyy-mm-dd text from Y-M-D, M-D-Y or a month's name; the parts are not checked; else unchanged."""
    return let(clean_text(c), _date)


def _date(s: Column) -> Column:
    n = F.regexp_replace(s, r"[/\\.\s]+", "-")
    two = lambda x: F.lpad(x, 2, "0")
    part = lambda p, i: F.regexp_extract(n, p, i)
    ymd, mdy = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    name_day, day_name = r"^([A-Za-z]{3,9})[,\-\s]+(\d{1,2})[,\-\s]+(\d{4})$", r"^(\d{1,2})[,\-\s]+([A-Za-z]{3,9})[,\-\s]+(\d{4})$"
    month = lambda p, i: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(s, p, i), 1, 3)))

    def named(p: str, m: int, d: int) -> Column:
        return F.when(s.rlike(p) & (month(p, m) > 0), F.concat_ws("-", F.regexp_extract(s, p, 3), two(month(p, m).cast("string")), two(F.regexp_extract(s, p, d))))

    return F.coalesce(
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s), F.when(n.rlike(ymd), F.concat_ws("-", part(ymd, 1), two(part(ymd, 2)), two(part(ymd, 3)))),
        F.when(n.rlike(mdy), F.concat_ws("-", part(mdy, 3), two(part(mdy, 1)), two(part(mdy, 2)))), named(name_day, 1, 2), named(day_name, 2, 1), s,
    )


def normalize_phone(c: Column) -> Column:
    """ddd-ddd-dddd of ten digits, or eleven after a 1; else unchanged."""
    s = clean_text(c)
    d = F.regexp_replace(s, r"\D+", "")
    ten = F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10))
    return F.coalesce(F.regexp_replace(ten, r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3"), s)


def month_label(c: Column) -> Column:
    """``2026-01`` to ``Jan``."""
    return F.date_format(F.to_date(F.concat(c, F.lit("-01"))), "MMM")


def confidence_100(c: Column) -> Column:
    """0..100: values up to 1 are shares, null or text is 0."""
    v = _double(c)
    return F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(v <= 1.0, v * 100).otherwise(v))), F.lit(0.0))


def confidence_or_null(c: Column) -> Column:
    """0..100, only 0..1 being shares; null stays null."""
    v = _double(c)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(F.when((v >= 0) & (v <= 1), v * 100).otherwise(v), 2))) + F.when(v.isNotNull(), 0.0)


def confidence_01(c: Column) -> Column:
    """0..1, values above 1 being percents; null stays null."""
    v = _double(c)
    return F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(v > 1, v / 100).otherwise(v))))


def price_prefix(c: Column) -> Column:
    """The number at the start of a token, ``:`` read as a dot, a trailing minus dropped."""
    t = F.regexp_replace(F.replace(F.trim(c), F.lit(":"), F.lit(".")), r"-+$", "")
    return _double(F.regexp_extract(t, r"^\$?(\d+(?:\.\d+)?)", 1))


def format_thousands(c: Column) -> Column:
    """1234567.5 to ``1 234 567.50``."""
    return F.translate(F.format_number(c, 2), ",", " ")


#: Currencies as they are written in Canadian English.
CANADIAN = {"CAD": "$", "USD": "US$", "EUR": "€", "GBP": "£", "AUD": "A$", "NZD": "NZ$", "HKD": "HK$", "MXN": "MX$", "BRL": "R$", "INR": "₹", "ILS": "₪"}


def format_money(c: Column, currency: Column) -> Column:
    """1234.5 and CAD to ``$1,234.50``; other codes of three letters stand before the amount, with a no-break space;
    what is no code gives a dollar sign and the plain number. A minus comes first."""
    code = F.upper(F.coalesce(currency, F.lit("CAD")))
    sign = F.when(c < 0, "-").otherwise("")
    mark = F.try_element_at(F.create_map(*(F.lit(x) for kv in CANADIAN.items() for x in kv)), code)
    amount = F.format_number(F.abs(c), 2)
    plain = F.concat(F.lit("$"), F.format_string("%.2f", c.cast("double")))
    return F.when(code.rlike("^[A-Z]{3}$"), F.concat(sign, F.coalesce(mark, F.concat(code, F.lit("\u00a0"))), amount)).otherwise(plain)


def parse_thousands(c: Column) -> Column:
    return _double(F.translate(c, " ", ""))


def boxes_are_normal(boxes: Column, probe: int = 50) -> Column:
    """Whether the first boxes already lie on the 0..1000 page (none above 1100)."""
    return F.coalesce(F.array_max(F.transform(F.slice(boxes, 1, probe), lambda b: F.array_max(b))) <= 1100, F.lit(True))


def to_page(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes scaled to the 0..1000 page, clamped to it."""
    scale = lambda b, i: F.least(F.lit(1000), F.greatest(F.lit(0), F.floor(F.get(b, F.lit(i)) * 1000 / (width if i % 2 == 0 else height)))).cast("int")
    return F.transform(boxes, lambda b: F.array(*(scale(b, i) for i in range(4))))


def quad_to_box(points: Column) -> Column:
    """(x1, y1, x2, y2) around a polygon of (x, y) points."""
    x, y = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def edge_angle(points: Column, most: float = 30.0) -> Column:
    """Angle in degrees of a quad's top edge, null beyond ``most``; the median over a page is its skew."""
    d = lambda i: F.get(F.get(points, F.lit(1)), F.lit(i)) - F.get(F.get(points, F.lit(0)), F.lit(i))
    a = F.degrees(F.atan2(d(1), d(0)))
    return F.when(F.abs(a) <= most, a)
