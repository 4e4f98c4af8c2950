"""Text and token predicates as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the receipts' vocabulary.
SECTIONS = (
    "GROCERY", "PRODUCE", "MEATS", "MEAT", "BAKERY", "DELI", "FROZEN", "DAIRY", "SEAFOOD", "PHARMACY", "HOME", "HEALTH", "BEAUTY", "FLORAL", "INSTORE", "NATURAL", "ORGANIC",
)
PAYMENT_PHRASES = (
    "DEBIT", "PURCHASE", "INTERAC", "CHANGE", "TENDERED", "CUSTOMER COPY", "VERIFIED BY PIN", "CARD TYPE", "REF#", "ACCOUNT", "CHEQUING", "SAVINGS", "STORE MANAGER", "TRANS. TYPE", "AUTH", "DATE/TIME", "DATETIME",
)
PROMO_PHRASES = (
    "PC OPTIMUM", "OPTIMUM", "APPLE TV", "APPLE MUSIC", "APPLE FITNESS", "SURVEY", "FREE TRIAL", "MEMBERS GET", "THANK YOU", "POINTS", "CODE:", "CUSTOMER COPY", "RETAIN THIS COPY", "VALIDATION",
    "STOREOPINION", "FULL CONTEST RULES", "OFFER VALID", "NEW YEAR", "EARN", "CLAIM YOUR FREE TRIAL",
)
WEAK = ("EA", "KG", "LB", "LBS", "IS", "NT", "PT", "RP", "MRJ", "HRJ", "ARCP", "DS", "INT", "UNIT", "PK")
WEAK_PARTS = ("EA", "KG", "LB", "LBS", "PT", "NT", "IS", "RP", "MRJ", "HRJ", "DS", "INT", "PK")
JUNK = ("GPHRJ", "GPRQ", "GPRO", "GPHR)", "HRJ", "MRJ", "NRJ", "PRJ", "GPHRJ.", "HRJ.", "MRJ.", "GPRO)", "GPRD", "GPRQ)", "GPHRD", "GPMRJ")
UNITS = ("EA", "INT", "EACH", "KG", "LB", "LBS", "PK", "UNIT")
TOTAL_WORDS = ("total", "subtotal", "sub total", "tax", "gst", "hst", "pst")
BROKEN = (r"\d+\$\d", r"[A-Za-z]{1,2}\d{3,}", r"\d+[A-Za-z]+\d+", r"[^\w\s.,\-$:/]{2,}")


def any_of(c: Column, words) -> Column:
    """Whether a text has one of the words as a substring."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def name_key(c: Column) -> Column:
    """Key of an item's name: lower case, one space, then everything but letters and digits dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " "), r"[^a-z0-9 ]+", "")


def display_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")


def letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def digits(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Nd}"))


def alpha_ratio(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.lit(0.0)).otherwise(letters(t) / F.length(t))


def is_time(c: Column) -> Column:
    """A time of day, with or without seconds and am or pm."""
    return F.trim(c).rlike(r"(?i)^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?\s*([ap]\.?m\.?)?$")


def _capitals(c: Column, ready: bool) -> Column:
    return c if ready else F.upper(F.trim(F.coalesce(c, F.lit(""))))


def is_section(c: Column, ready: bool = False) -> Column:
    """``ready``: the text is trimmed upper case and not null."""
    return _capitals(c, ready).rlike(r"^\d{1,2}\s*-\s*[A-Z]+|\b(" + "|".join(SECTIONS) + r")\b")


def is_footer(c: Column, ready: bool = False) -> Column:
    """``ready``: the text is trimmed upper case and not null."""
    phrases = "|".join(rf"\Q{p}\E" for p in (*PROMO_PHRASES, *PAYMENT_PHRASES))
    words = r"\b(VERIFIED|PIN|CARD|MASTERCARD|VISA|CREDIT|APPLE|TRIAL|MEMBERS|GET UP TO)\b"  # others are phrases too
    return _capitals(c, ready).rlike(f"{phrases}|{words}")


def is_summary_anchor(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)\b(subtotal|total|tax|gst|pst|hst|qst|amount|tendered|change)\b")


def is_weak_name(c: Column) -> Column:
    """Whether a text is too poor to name an item: units, weights, codes, section heads, payment lines,
    too few letters, too many digits, no vowels. Two clean words with five letters are never weak once
    the outright rules have passed."""
    from .money import let

    return let(F.trim(F.coalesce(c, F.lit(""))), _weak)


def _weak(t: Column) -> Column:
    """What is used more than once is computed once: within functions on arrays nothing is shared otherwise."""
    from .money import let

    def outright(u: Column) -> Column:
        return (
            (u == "") | u.isin(*WEAK, *JUNK) | t.startswith("$") | t.rlike(r"(?i)^(?:(kg|lb|lbs|ea|each|pk|unit|int|/kg|/lb)|\d+(?:[.,]\d+)?\s*(kg|lb|lbs|g|gm|ea|each))$|^\d{5,}$")
            | u.rlike(r"^(?:(INT|EA|EACH|PK)\s*\d*|\d+\s*(EA|EACH|PK))$") | is_section(u, True) | is_footer(u, True)
        )

    def named(u: Column, clean: Column) -> Column:
        return (F.size(clean) >= 2) & (letters(F.array_join(clean, " ")) >= 5) & ~F.exists(clean, lambda x: x.isin(*UNITS))

    def poor(u: Column, parts: Column, clean: Column) -> Column:
        latin = F.regexp_replace(u, "[^A-Z]", "")
        counts = F.struct(letters(t).alias("a"), digits(t).alias("d"), F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]")).alias("marks"), F.regexp_count(latin, F.lit("[AEIOU]")).alias("vowels"), F.length(latin).alias("n"), (~u.contains(" ")).alias("single"))

        def judge(v: Column) -> Column:
            a, d, marks, vowels, n, single = (v[x] for x in ("a", "d", "marks", "vowels", "n", "single"))
            return (
                (a < 3) | ((F.length(u) <= 2) & ~u.isin("XL", "BB")) | ((d >= a) & (d >= 2)) | ((d >= 2) & (marks >= 1) & (a <= 8)) | ((d >= 1) & (d >= a) & (a <= 6))
                | ((n >= 4) & single & (vowels == 0)) | ((n >= 5) & (F.size(clean) <= 1) & single & (vowels / n < 0.15)) | (alpha_ratio(u) < 0.20)
                | ((F.size(parts) > 0) & F.forall(parts, lambda x: x.isin(*WEAK_PARTS) | x.rlike(r"^[\d\W]+$"))) | ((a <= 4) & F.exists(parts, lambda x: x.isin("EA", "INT", "EACH")))
            )

        return let(counts, judge)

    def judge(u: Column) -> Column:
        parts = F.filter(F.split(u, r"\s+"), lambda x: x != "")
        clean = lambda p: F.filter(p, lambda x: ~x.isin(*WEAK, *JUNK) & ~x.rlike(r"^[\d\W]+$"))
        rest = let(parts, lambda p: let(clean(p), lambda k: F.when(named(u, k), False).otherwise(poor(u, p, k))))
        return F.when(outright(u), True).otherwise(rest)

    return let(F.upper(t), judge)


def good_name(c: Column) -> Column:
    """What is left of a row's text as an item's name, or null: codes, prices, weights and units are taken off."""
    t = F.trim(F.coalesce(c, F.lit("")))
    # fixed values: what is taken off, in this order
    for pattern in (
        r"(?i)^\d{1,2}\s*-\s*[A-Z]+\s*", r"^\d{5,}\s+", r"(?i)\b(MRJ|HRJ|NRJ|GRJ|PRJ|GPHRJ|GPRQ|GPRO|GPMRJ)\b", r"[-+]?\$?\d+(?:[.,]\d{2})",
        r"(?i)\b\d+(?:[.,]\d+)?\s*(kg|lb|lbs|ea|each)\b", r"(?i)\b(GROSS|NET|TARE|INT|EA|KG|LB|LBS|PT|NT|RP|IS|UNIT|PK)\b",
    ):
        t = F.trim(F.regexp_replace(t, pattern, ""))
    from .money import let

    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ \-:;,.]+|[ \-:;,.]+$", "")
    return let(t, lambda x: F.when((x != "") & ~_weak(x), x))


def is_junk_row(c: Column) -> Column:
    """A row with nothing but prices, percents and junk."""
    t = F.trim(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(t, r"[-+]?\$?\d+(?:[.,]\d{2,})", ""), r"\b\d+(?:[.,]\d+)?\s*%", "")
    s = F.regexp_replace(s, r"(?i)\b(" + "|".join(w for w in JUNK if w.isalpha()) + r")\b", "")
    s = F.regexp_replace(s, r"^[ \-:;,./]+|[ \-:;,./]+$", "")
    return (t == "") | (s == "") | is_weak_name(s)


def has_total_words(c: Column) -> Column:
    return any_of(F.lower(c), TOTAL_WORDS)


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")


def item_line_count(c: Column) -> Column:
    """Lines with a letter that end with a price, or a price and one letter."""
    return F.size(F.filter(_lines(c), lambda x: x.rlike(r"[A-Za-z]") & x.rlike(r"\d+\.\d{2}(\s+[A-Za-z]?)?$")))


def line_count(c: Column) -> Column:
    return F.size(_lines(c))


def broken_score(c: Column) -> Column:
    """Share of lines that look broken; 1 without lines."""
    n = F.size(_lines(c))
    bad = F.size(F.filter(_lines(c), lambda x: x.rlike("|".join(BROKEN))))
    return F.when(n == 0, F.lit(1.0)).otherwise(bad / F.greatest(n, F.lit(1)))


def line_score(c: Column) -> Column:
    """How useful a line is in a prompt: keywords 6, money 4, dates 2, phone numbers 2, letters 1."""
    points = lambda pattern, n: F.when(c.rlike(pattern), n).otherwise(0)
    return (
        points(r"(?i)total|tax|gst|hst|pst|visa|cash|change|date|tel|phone", 6) + points(r"\d+\.\d{2}", 4) + points(r"[A-Za-z]", 1)
        + points(r"\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b", 2) + points(r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}", 2)
    )


def quality_signals(c: Column) -> Column:
    """struct of has_total, has_date, amounts, total_amount (an amount within 40 characters after TOTAL)."""
    u = F.upper(F.coalesce(c, F.lit("")))
    return F.struct(
        u.rlike(r"\bTOTAL\b").alias("has_total"), u.rlike(r"\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b").alias("has_date"),
        F.regexp_count(u, F.lit(r"\d+\.\d{2}")).alias("amounts"), u.rlike(r"(?s)TOTAL.{0,40}?\d+\.\d{2}").alias("total_amount"),
    )


def text_score(c: Column, confidence: Column) -> Column:
    """10 conf + 2 log1p(letters and digits) + log1p(digits) + 1.5 log1p(lines) - 2 log1p(odd signs); -1e9 if empty."""
    t = F.coalesce(c, F.lit(""))
    odd = F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,:;/$%()\-+*#&@'\"]"))
    score = 10 * confidence + 2 * F.log1p(letters(t) + digits(t)) + F.log1p(digits(t)) + 1.5 * F.log1p(F.size(_lines(t))) - 2 * F.log1p(odd)
    return F.when(F.trim(t) == "", F.lit(-1e9)).otherwise(score)


def best_keyword(c: Column, keywords: list[str], most: int = 2) -> Column:
    """struct(keyword, distance): the first keyword that the text contains (distance 0), else the one at
    the least edit distance from the text's letters, digits and percent signs, the first of equals, if
    that is ``most`` or less; else null."""
    from .money import let

    ks = [k.strip().upper() for k in keywords if k and k.strip()]
    if not ks:
        return F.lit(None).cast("struct<keyword:string,distance:int>")
    # a keyword whose length differs by more than ``most`` is farther than that: each length has its candidates
    bare = ["".join(ch for ch in k if ch.isalnum() or ch == "%") for k in ks]
    candidates = {n: [(i, k, b) for i, (k, b) in enumerate(zip(ks, bare)) if abs(len(b) - n) <= most] for n in range(1, max(map(len, bare)) + most + 1)}
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = lambda found: "array(" + ", ".join(f"named_struct('at', {i}, 'keyword', {quoted(k)}, 'bare', {quoted(b)})" for i, k, b in found) + ")"
    by_length = F.expr("map(" + ", ".join(f"{n}, {rows(found)}" for n, found in candidates.items() if found) + ")")  # one call for the whole table
    known_words = F.expr(f"array({', '.join(map(quoted, ks))})")

    def nearest(squeezed: Column) -> Column:
        rated = F.transform(F.try_element_at(by_length, F.length(squeezed)), lambda k: F.struct(F.levenshtein(squeezed, k["bare"]).alias("distance"), k["at"], k["keyword"]))
        return let(F.array_min(rated), lambda b: F.when(b["distance"] <= most, F.struct(b["keyword"].alias("keyword"), b["distance"].alias("distance"))))

    def match(u: Column) -> Column:
        exact = F.get(F.filter(known_words, lambda k: u.contains(k)), F.lit(0))
        known = let(exact, lambda e: F.when(e.isNotNull(), F.struct(e.alias("keyword"), F.lit(0).alias("distance"))))
        return F.coalesce(known, let(F.regexp_replace(u, "[^A-Z0-9%]", ""), nearest))

    return let(F.upper(F.coalesce(c, F.lit(""))), match)


def summary_word(c: Column, subtotal: list[str], total: list[str], tax: list[str], most: int = 2) -> Column:
    """A token as SUBTOTAL, TOTAL or TAX (tried in that order), numbers and other tokens as they are."""
    from .money import let

    def usual(t: Column) -> Column:
        number = t.rlike(r"^[$€£¥₹]?\s*[-+]?\d[\d,.]*$")
        out = F.when((t == "") | number, t)
        for name, words in (("SUBTOTAL", subtotal), ("TOTAL", total), ("TAX", tax)):
            out = out.when(best_keyword(t, words, most).isNotNull(), F.lit(name))
        return out.otherwise(t)

    return let(F.trim(F.coalesce(c, F.lit(""))), usual)


def tagger_words(words: Column, most: int = 2) -> Column:
    """Array of struct(word, currency), one for each of a receipt's words, which keep their places: summary words in
    their usual form, with the tax words of the regions that the words hint at; then a currency mark before an amount
    taken off and kept aside; then the word as the tagger wants it."""
    from ..operators.summary import TAX_WORDS
    from .money import let, normalize_word, split_currency
    from .report import SUBTOTAL_WORDS, TOTAL_WORDS

    def usual(words: Column, found: Column) -> Column:
        def one(w: Column) -> Column:
            read = lambda tax: summary_word(w, SUBTOTAL_WORDS, TOTAL_WORDS, tax, most)
            american = [*TAX_WORDS["USA"], *TAX_WORDS["UNIVERSAL"]]  # the other regions' words are universal too
            form = F.when(F.array_contains(found, "USA"), read(american)).otherwise(read(TAX_WORDS["UNIVERSAL"]))
            return let(form, lambda x: let(split_currency(x), lambda p: F.struct(normalize_word(p["amount"]).alias("word"), p["currency"].alias("currency"))))

        return F.transform(words, one)

    return let(words, lambda ws: let(regions(F.array_join(ws, " ")), lambda found: usual(ws, found)))


def regions(c: Column) -> Column:
    """Tax regions that a text hints at: by its taxes, else by its currency; the universal one is always last."""
    from .money import detect_currency, let

    by_currency = lambda cur: F.when(cur.isin("CA$", "CAD$"), "CANADA").when(cur.isin("$", "USD$"), "USA").when(cur == "€", "EU")
    by_tax = lambda u: F.when(u.rlike("GST|HST|PST|QST"), "CANADA").when(u.rlike("VAT|TVA|MWST|BTW"), "EU")
    first = let(c, lambda t: F.coalesce(let(F.upper(F.coalesce(t, F.lit(""))), by_tax), let(detect_currency(t), by_currency)))
    return F.filter(F.array(first, F.lit("UNIVERSAL")), lambda x: x.isNotNull())


#: Fixed value: a phone number with optional country code.
PHONE = r"(\b(?:\+?\d{1,3}[-\s]?)?(?:\(?\d{3}\)?[-\s]?)\d{3}[-\s]?\d{4}\b)"


def phone_near(words: Column, keyword: str = "phone", reach: int = 18) -> Column:
    """The first phone number within ``reach`` words from a word that holds the keyword, else anywhere; '' without."""
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.lower(w).contains(keyword), F.regexp_extract(F.array_join(F.slice(words, i + 1, reach), " "), PHONE, 1))), lambda x: x != "")
    return F.coalesce(F.get(hits, F.lit(0)), F.regexp_extract(F.array_join(words, " "), PHONE, 1))


def address_fallback(words: Column, reach: int = 30) -> Column:
    """From the nearest street number before the first ZIP code to it, without junk; '' without both."""
    from .money import let

    places = lambda keep: F.filter(F.transform(words, lambda w, i: F.when(keep(w), i)), lambda i: i.isNotNull())
    nearest = lambda zip_at: F.array_max(F.filter(places(lambda w: w.rlike(r"^\d{3,6}$")), lambda i: (i < zip_at) & (i > zip_at - reach)))

    def between(start: Column, zip_at: Column) -> Column:
        kept = F.filter(F.slice(words, start + 1, zip_at - start + 1), lambda w: ~w.isin("1", "d", "G", "M", "sc"))
        text = F.regexp_replace(F.array_join(kept, " "), r"(?i)\bB\s*vd\b", "BLVD")
        return F.when(start.isNotNull(), F.trim(F.regexp_replace(text, r"\s+", " ")))

    first_zip = F.array_min(places(lambda w: w.rlike(r"\b\d{5}\b")))
    return F.coalesce(let(first_zip, lambda zip_at: let(nearest(zip_at), lambda start: between(start, zip_at))), F.lit(""))


def total_fallback(c: Column) -> Column:
    """Amount after TOTAL DUE or TOTAL, '' without one."""
    return F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), r"TOTAL(?:\s+DUE)?\s+([0-9]+\.[0-9]{2})", 1)


def llm_route(text: Column, has_image: Column, confidence: Column, free_tier: bool = True, least_conf: float = 0.45, least_items: int = 1, broken: float = 0.95, prefer_long: bool = False, long_lines: int = 200) -> Column:
    """ocr_text or vision_image: which of the two a receipt is sent to the model as."""
    from .money import confidence_01

    blank, conf, n, score = F.trim(F.coalesce(text, F.lit(""))) == "", confidence_01(confidence), line_count(text), broken_score(text)
    if free_tier:
        poor = (n < 3) | F.coalesce(conf < 0.20, F.lit(False)) | (score > 0.95)
    else:
        poor = F.coalesce(conf < least_conf, F.lit(False)) | (item_line_count(text) < least_items) | ~has_total_words(text) | (score > broken)
        if prefer_long:
            poor = poor | ((n >= long_lines) & (score > 0.20))
    return F.when(has_image & (blank | poor), "vision_image").otherwise("ocr_text")


def receipt_family(words: Column, row_ids: Column, long_receipt: Column) -> Column:
    """long_grocery from four points of size, units, departments and shops, else default."""
    t = F.upper(F.array_join(words, " "))
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = (
        points(long_receipt, 2) + points(F.size(words) > 250, 1) + points(F.size(F.array_distinct(row_ids)) > 120, 1) + points(any_of(t, (" KG", "/KG", " LB", "/LB", " EA ")), 1)
        + points(any_of(t, ("PRODUCE", "GROCERY", "BAKERY", "MEATS", "DELI")), 2) + points(any_of(t, ("SUPERSTORE", "COSTCO", "WALMART", "REAL CANADIAN")), 2)
    )
    return F.when(score >= 4, "long_grocery").otherwise("default")


def pseudo_lines(words: Column) -> Column:
    """Words as lines: a line ends with each word that has a dollar sign or is an amount."""
    from .money import normalize_amount

    kept = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    ends = F.transform(kept, lambda w: F.when(w.contains("$") | normalize_amount(w).isNotNull(), F.concat(w, F.lit("\n"))).otherwise(F.concat(w, F.lit(" "))))
    return F.filter(F.transform(F.split(F.array_join(ends, ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def initials(c: Column, n: int = 2) -> Column:
    """First letters of the first ``n`` words, upper case; ? for a blank name."""
    parts = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")
    out = F.upper(F.array_join(F.transform(F.slice(parts, 1, n), lambda x: F.substring(x, 1, 1)), ""))
    return F.when(out == "", F.lit("?")).otherwise(out)


#: What review states are called and how they are coloured; colours of a receipt's status.
STATE_LABELS = {"approved": "Approved", "pending": "Pending", "not_requested": "OCR only", "rejected": "Rejected"}
STATE_PILLS = {"approved": "pill-ok", "pending": "pill-pend", "not_requested": "pill-none", "rejected": "pill-rej"}
BADGES = {"Approved": "success", "Pending": "warning", "Failed": "error"}


def _by_value(c: Column, known: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in known.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def state_label(c: Column) -> Column:
    """A review state in words; others as they are."""
    return _by_value(c, STATE_LABELS, c)


def state_pill(c: Column) -> Column:
    return _by_value(c, STATE_PILLS, F.lit("pill-none"))


def badge_color(c: Column) -> Column:
    return _by_value(c, BADGES, F.lit("info"))


def clean_ocr_text(c: Column) -> Column:
    """A text with one kind of line end, two of them in a row at most, none at its ends."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


# Money as a token, tax words, labels of a summary.
MONEY_TOKEN = r"^\$?\s*\d{1,7}[.,]\d{2}\s*$"
TAX_LINE = r"(?i)\b(tax|vat|gst|hst|pst|qst|sales\s*tax|tps|tvq)\b"
SUMMARY_LABELS = ("SUM.SUBTOTAL", "SUM.TAX", "SUM.TOTAL", "TAX")


def is_money_token(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).rlike(MONEY_TOKEN)


def is_real_tax(c: Column) -> Column:
    """Whether a text names a tax; tips and fees alone are none."""
    return F.coalesce(c, F.lit("")).rlike(TAX_LINE)


def as_unlabelled(label: Column, conf: Column, least: float = 0.50) -> Column:
    """Whether a token counts as one without a label: it has none, or a summary's with too little confidence."""
    lab = F.coalesce(F.when(label != "", label), F.lit("O"))
    summary = lab.isin(*(f"{b}-{k}" for b in "BI" for k in SUMMARY_LABELS))
    return (lab == "O") | (summary & (F.coalesce(conf, F.lit(0.0)) < least))


def nearest_keyword(c: Column, keywords: list[str], most: int = 2) -> Column:
    """struct(keyword, distance): the keyword at the least edit distance, the first of equals, by letters and digits;
    a token of four of them at most must be one. Null without one."""
    from .money import let

    bare = lambda k: "".join(ch for ch in k.upper() if ch.isascii() and ch.isalnum())
    table = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(k).alias("keyword"), F.lit(bare(k)).alias("bare")) for i, k in enumerate(keywords)))

    def match(t: Column) -> Column:
        rated = F.transform(table, lambda k: F.struct(F.levenshtein(t, k["bare"]).alias("distance"), k["at"], k["keyword"]))
        fits = F.filter(rated, lambda k: k["distance"] <= F.when(F.length(t) <= 4, 0).otherwise(most))
        return F.when(t != "", let(F.array_min(fits), lambda b: F.when(b.isNotNull(), F.struct(b["keyword"].alias("keyword"), b["distance"].alias("distance")))))

    return let(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", ""), match)
