"""Label post-processing: one ordered chain of repairs per receipt.

The repairs look ahead by varying numbers of tokens and read what earlier ones wrote, so a receipt's
tokens go through the whole chain in one kernel, fed from a sorted stream (one shuffle by receipt_id); the core is
plain Python over a ``Page`` and is tested without Spark. A receipt is bounded by its paper.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .streams import by_receipt

# The vocabulary of the tagger's repairs. Each is matched against a whole trimmed token.
HEADER_END, FOOTER_START, PRICE_COLUMN, UNSURE = 120, 900, 650, 0.75
PATTERNS = {
    "price": r"-?\$?\d{1,4}[.,]\d{2}",
    "minus": r"-\$?\d{1,4}[.,]\d{2}",
    "number": r"\d+",
    "quantity": r"\d{1,2}",
    "code": r"\d{6,14}",
    "flag": r"mrj|hrj|gphrj|gpmrj|gprq|fp|pp|rp",
    "rate": r"\d+\.?\d*\s*%",
    "subtotal": r"subtotal|sub[\s\-]?total|sub|slbtotal|(sub[.\-]?tot|subt[oa]|slbtotal|s[uo]btotal)[:.]?",
    "total": r"total|grand\s*total|amount\s*due|balance\s*due|balance|settled|tot\.?|(tot[.\-]?al|totol|t[o0]tal|debittend)[:.]?",
    "tax": r"tax|vat|gst|hst|pst|qst|sst|service\s*charge|srv\.?|(\.?tax|taxtotal|p=pst\d*|g=gst\d*|pste?\d*[.%]*)[:.]?",
    "discount": r"discount|disc\.?|saving|coupon|promo",
    "due": r"due|amount",
    "guests": r"gst\d*",
    "guests_glued": r"gst\d+",
    "modifier": r"ca|us|state|local|city|county|fed|federal|provincial|national|regional|g|p",
    "odd_total": r"iotal[:.]?[:.]?",
    "arcp": r"arcp\d*[.\d]*",
    "payment": r"cash|card|visa|mastercard|amex|discover|wells?\s*fargo|chase|debit|debtt|credit|tap|nfc|apple\s*pay|google\s*pay|interac|interao|change|tender|paid|payment|charged|approved|auth|tip|gratuity|suggested|tip\s*\d|server\s*tip|shopping\s*card|shop\s*card",
    "never_menu": r"table|tbl|chk|gst|pst|hst|qst|station|server|date|time|receipt|order|guests?|items?|subtotal|total|tax|vat|balance|due|thank|please|visit|call|online|www\.|http|change|cash|debit|credit|card|interac|approved|auth|terminal|ref|rrn|transaction|purchase|savings|refund|amount|deposit",
    "header_word": r"tel|vat|reg|gst|abn|ein|tin|fax|email|web|www|http|©|registered|steakhouse|grill|restaurant|bistro|cafe|bar",
    "after_total": r"transaction|record|type|purchase|acct|chequing|account|amount|card|number|date|time|reference|author|invoice|interac|approved|approveli|approveei|uerified|verified|retain|copy|customer|important|signature|required|items|sold|savings|refund|change|cash|debit|credit|f|ds|tn|tnd|nue|rr\.|rr|rf",
    "category": r"\d{2}-[a-z].*",
    "per_unit": r"\d+\.?\d*\s*(kg|lb|g|oz|l|ml)[@/]?|\d+\s*(for|@|at)\s*\$?\d|[234]\.for\$\d|\d+\.\d+kg|gross|tare=|net[\d\w]*",
}
_COMPILED = {k: re.compile(v, re.I) for k, v in PATTERNS.items()}
#: Summary keywords in the order in which they are tried: confidence, words that may follow
#: the keyword, marks that may stand between prices, zones.
SUMMARY = {
    "subtotal": ("SUM.SUBTOTAL", 0.95, None, (":", "$"), ("body", "footer")),
    "total": ("SUM.TOTAL", 0.95, "due", (":", "$"), ("body", "footer")),
    "tax": ("SUM.TAX", 0.90, "rate", (":", "%"), ("body", "footer")),
    "discount": ("MENU.DISCOUNTPRICE", 0.88, None, (":", "-"), ("body",)),
}
_SUM = ("SUM.TOTAL", "SUM.TAX", "SUM.SUBTOTAL")


@lru_cache(1 << 16)
def _matches(kind: str, word: str) -> bool:
    """Receipts share most of their words, so what a word is stays known across the receipts of a task."""
    return bool(_COMPILED[kind].fullmatch(word.strip()))


class Page:
    """One receipt's tokens, in order, with the labels as they stand."""

    def __init__(self, words, labels, confs, boxes, rows=None, zones=None):
        self.words, self.labels, self.confs = [str(w) if w is not None else "" for w in words], list(labels), [float(c) if c is not None else 0.0 for c in confs]
        self.n = len(self.words)
        self.middle = [(b[0] + b[2]) / 2 for b in boxes]
        height = [(b[1] + b[3]) / 2 for b in boxes]
        self.box_zones = ["header" if y < HEADER_END else "footer" if y > FOOTER_START else "body" for y in height]
        self.zones = list(zones) if zones is not None and len(zones) == self.n and all(zones) else self.box_zones
        self.rows = list(rows) if rows is not None and len(rows) == self.n and all(r is not None for r in rows) else _rows(height)

    def is_(self, kind: str, i: int) -> bool:
        return 0 <= i < self.n and _matches(kind, self.words[i])

    def any_(self, kinds: Iterable[str], i: int) -> bool:
        return any(self.is_(k, i) for k in kinds)

    def put(self, i: int, label: str, conf: float, at_least: bool = False) -> None:
        self.labels[i] = label
        self.confs[i] = max(self.confs[i], conf) if at_least else conf

    def clear(self, i: int) -> None:
        self.put(i, "O", 1.0)

    def by_row(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i, r in enumerate(self.rows):
            out.setdefault(r, []).append(i)
        return out

    def last_total(self) -> int:
        return max((i for i, x in enumerate(self.labels) if x == "B-SUM.TOTAL"), default=-1)


def _rows(heights: list[float], tolerance: float = 15) -> list[int]:
    out, anchor, row = [], None, -1
    for y in heights:
        if anchor is None or abs(y - anchor) > tolerance:
            anchor, row = y, row + 1
        out.append(row)
    return out


def unsure_noise(p: Page) -> None:
    """Article numbers and flags with an unsure label lose it."""
    for i, lab in enumerate(p.labels):
        if p.confs[i] < UNSURE and (("MENU.NM" in lab and p.is_("code", i)) or ("MENU" in lab and p.is_("flag", i))):
            p.clear(i)


def zones(p: Page) -> None:
    """Labels that a token's zone or kind rules out."""
    for i, lab in enumerate(p.labels):
        menu = "MENU" in lab
        out = (
            lab != "O" and (p.zones[i] == "header" or p.is_("header_word", i))
            or menu and (p.zones[i] == "footer" or p.any_(("flag", "never_menu"), i))
            or "MENU.NM" in lab and p.is_("code", i)
        )
        if out:
            p.clear(i)


def _real_tax_near(p: Page, i: int) -> bool:
    return p.is_("modifier", i) and any(p.is_("tax", j) for j in range(i + 1, min(i + 4, p.n)))


def keywords(p: Page) -> None:
    """Summary keywords get their label and the prices right after them continue it."""
    i = 0
    while i < p.n:
        kind = next((k for k, rule in SUMMARY.items() if p.zones[i] in rule[4] and p.is_(k, i)), None)
        if kind == "tax":
            few = p.is_("quantity", i + 1) and int(p.words[i + 1]) <= 20
            if p.is_("guests_glued", i) or (p.is_("guests", i) and few):
                p.clear(i)
                i += 1
                continue
        if kind == "discount" and p.labels[i] == "B-SUM.TAX" and p.is_("modifier", i):
            kind = None
        if kind is None:
            if p.labels[i] == "B-SUM.TAX" and _real_tax_near(p, i) or p.words[i].strip().lower() in ("items", "items.sold:") and "SUM" in p.labels[i]:
                p.clear(i)
            i += 1
            continue
        label, conf, follow, marks, _ = SUMMARY[kind]
        p.put(i, f"B-{label}", conf, at_least=True)
        i += 1
        while follow and p.is_(follow, i):
            if follow == "due":
                p.put(i, f"I-{label}", conf)
            i += 1
        while i < p.n and (p.is_("price", i) or p.words[i].strip() in marks):
            if p.is_("price", i):
                p.put(i, f"I-{label}", conf)
            i += 1


def two_columns(p: Page) -> None:
    """k keywords and then exactly k prices: the prices belong to the keywords in order."""
    heads = {f"B-{k}": f"I-{k}" for k in _SUM}

    def collect(i: int, wanted: Callable[[int], bool]) -> tuple[list[int], int]:
        found = []
        while i < p.n:
            if wanted(i):
                found.append(i)
            elif not (p.labels[i] == "O" and not p.is_("price", i) and not p.is_("due", i)):
                break
            i += 1
        return found, i

    i = 0
    while i < p.n:
        if p.labels[i] not in heads:
            i += 1
            continue
        keys, end = collect(i, lambda j: p.labels[j] in heads)
        if len(keys) > 1:
            prices, end = collect(end, lambda j: p.is_("price", j))
            if len(prices) == len(keys):
                for k, j in zip(keys, prices):
                    if p.labels[j] != heads[p.labels[k]]:
                        p.put(j, heads[p.labels[k]], 0.90, at_least=True)
        i = max(end, i + 1)


def odd_keywords(p: Page) -> None:
    """Keywords that were misread in other ways."""
    for i in range(p.n):
        if p.zones[i] == "header":
            continue
        word, after = p.words[i].strip().lower(), p.words[i + 1].strip().lower() if i + 1 < p.n else ""
        if p.labels[i] == "O" and p.is_("odd_total", i):
            p.put(i, "B-SUM.TOTAL", 0.85)
        if word == "taxable" and after in ("total:", "total", "iotal::", "iotal"):
            p.put(i, "B-SUM.SUBTOTAL", 0.88)
            p.clear(i + 1)
        if p.is_("arcp", i):
            p.clear(i)


def sequence(p: Page) -> None:
    """Continuations without a beginning begin; numbers, prices, codes and flags are no names."""
    open_kind = None
    for i, lab in enumerate(p.labels):
        prefix, _, kind = lab.partition("-")
        if prefix == "I" and kind != open_kind:
            p.labels[i] = f"B-{kind}"
        open_kind = kind if prefix in ("B", "I") else None
    for i in range(p.n):
        if "MENU.NM" in p.labels[i]:
            if p.is_("number", i):
                p.clear(i)
            elif p.is_("price", i):
                p.put(i, "B-MENU.PRICE", 0.88, at_least=True)
    for i in range(p.n):
        before_name = i + 1 < p.n and "MENU.NM" in p.labels[i + 1]
        if "MENU" in p.labels[i] and (p.is_("quantity", i) and before_name or p.is_("flag", i)):
            p.clear(i)


def names(p: Page) -> None:
    """A name spreads over its row: to the right up to what ends it, to the left over what it skipped."""
    dull = ("number", "price", "never_menu", "code", "flag")
    for row in p.by_row().values():
        start = next((i for i in row if p.labels[i] == "B-MENU.NM"), None)
        if start is None:
            continue
        for i in (i for i in row if i > start):
            lab = p.labels[i]
            if p.zones[i] == "header" or p.any_(("price", "code", "flag"), i) or lab.startswith("B-") and lab != "B-MENU.NM" or lab == "O" and p.confs[i] >= 0.92 and p.is_("never_menu", i):
                break
            if lab != "I-MENU.NM" and not p.any_(dull, i) and len(p.words[i].strip()) > 1:
                p.put(i, "I-MENU.NM", 0.80, at_least=True)
        left = [i for i in row if i < start]
        if left and p.is_("quantity", left[0]):
            left = left[1:]
        first = True
        for i in left:
            if p.any_(dull, i) or len(p.words[i].strip()) <= 1:
                continue
            p.put(i, "B-MENU.NM" if first else "I-MENU.NM", 0.80, at_least=True)
            if first:
                p.labels[start] = "I-MENU.NM"
                first = False


def price_column(p: Page) -> None:
    """Prices in the right column of the body; the first of a row begins."""
    taken = set()
    for i in range(p.n):
        if not p.is_("price", i):
            continue
        lab, row = p.labels[i], p.rows[i]
        if lab[2:] in (*_SUM, "SUM.PRICE"):
            taken.add(row)
            continue
        weak = lab in ("B-MENU.PRICE", "I-MENU.PRICE") and p.confs[i] < UNSURE
        if p.middle[i] > PRICE_COLUMN and p.box_zones[i] == "body" and (lab == "O" or weak):
            p.put(i, "I-MENU.PRICE" if row in taken else "B-MENU.PRICE", 0.88, at_least=True)
        if p.labels[i] in ("B-MENU.PRICE", "I-MENU.PRICE"):
            taken.add(row)


def one_beginning(p: Page) -> None:
    for i in range(1, p.n):
        if p.labels[i] == p.labels[i - 1] == "B-MENU.NM" and p.rows[i] == p.rows[i - 1] and not p.is_("price", i):
            p.labels[i] = "I-MENU.NM"


def after_total(p: Page) -> None:
    """Nothing after the last total is an item."""
    for i in range(p.n):
        if p.labels[i] == "B-SUM.TAX" and _real_tax_near(p, i):
            p.clear(i)
    last = p.last_total()
    if last < 0:
        return
    i = last + 1
    while i < p.n and p.labels[i] in tuple(f"I-{k}" for k in _SUM):
        i += 1
    for i in range(i, p.n):
        if p.labels[i][2:] not in _SUM and ("MENU" in p.labels[i] or p.any_(("payment", "after_total"), i)):
            p.clear(i)


def discounts(p: Page) -> None:
    for i in range(p.n):
        if p.zones[i] == "body" and p.labels[i] == "O" and p.is_("minus", i):
            p.put(i, "B-MENU.DISCOUNTPRICE", 0.85, at_least=True)


def orphan_prices(p: Page) -> None:
    begun = {p.rows[i] for i, x in enumerate(p.labels) if x == "B-MENU.PRICE"}
    for i, lab in enumerate(p.labels):
        if lab == "I-MENU.PRICE" and p.rows[i] not in begun:
            p.labels[i] = "B-MENU.PRICE"
            begun.add(p.rows[i])


def loose_prices(p: Page) -> None:
    last = p.last_total()
    for i in range(p.n if last < 0 else last + 1):
        if p.labels[i] == "O" and p.zones[i] == "body" and p.is_("price", i) and p.middle[i] > PRICE_COLUMN:
            p.put(i, "B-MENU.PRICE", 0.82, at_least=True)


def colons(p: Page) -> None:
    """A colon in what is no time of day is a decimal point."""
    for i in range(p.n):
        m = re.fullmatch(r"(\d{1,4}):(\d{2})", p.words[i].strip())
        if m and (int(m[1]) > 23 or int(m[2]) > 59):
            p.words[i] = f"{int(m[1])}.{m[2]}"
            if p.labels[i] == "O" and p.middle[i] > PRICE_COLUMN:
                p.put(i, "B-MENU.PRICE", 0.82, at_least=True)


def grocery_rows(p: Page) -> None:
    """Rows of name, code, flag, price: codes, flags, categories and units lose their label, the rightmost
    price is the price, what stands before the code is the name (a unit too)."""
    for row in p.by_row().values():
        if p.zones[row[0]] != "body":
            continue
        for i in row:
            if p.any_(("code", "flag", "category", "per_unit"), i):
                p.clear(i)
        price = next((i for i in reversed(row) if p.is_("price", i)), None)
        if price is not None and p.labels[price] == "O":
            p.put(price, "B-MENU.PRICE", 0.85, at_least=True)
        first = True
        for i in row:
            if p.is_("code", i):
                break
            if i != price and p.labels[i] == "O" and len(p.words[i].strip()) > 1 and not p.any_(("number", "price", "flag", "never_menu", "category"), i):
                p.put(i, "B-MENU.NM" if first else "I-MENU.NM", 0.82 if first else 0.80, at_least=True)
                first = False


#: The chain, in order; each repair reads what those before it wrote.
CHAIN = (unsure_noise, zones, keywords, two_columns, odd_keywords, sequence, names, price_column, one_beginning, after_total, discounts, orphan_prices, loose_prices, colons, grocery_rows)


def repair(p: Page, chain=CHAIN) -> Page:
    for step in chain:
        step(p)
    return p


OUT = "receipt_id long, idx int, word string, raw_label string, label string, conf double, row_id int, zone string"


def repair_labels(tokens: DataFrame, steps: tuple[str, ...] | None = None) -> DataFrame:
    """Tokens (receipt_id, idx, word, label, conf, x1, y1, x2, y2, row_id, zone) with repaired words,
    labels and confidences; raw_label is the label before. ``steps`` names a part of the chain."""
    run = _repaired(steps)
    return by_receipt(tokens, _COLUMNS, "idx", run, [tuple(c.split()) for c in OUT.split(", ")])


def label_lists(tokens: DataFrame, steps: tuple[str, ...] | None = None) -> DataFrame:
    """(receipt_id, labels) of ``repair_labels``, one row per receipt with its labels in order: rows that are read by
    receipt leave the kernel so, and need no shuffle to come together again."""
    run = _repaired(steps)
    whole = lambda receipt, rows: [(receipt, [x[4] for x in run(receipt, rows)])]
    return by_receipt(tokens, _COLUMNS, "idx", whole, [("receipt_id", "long"), ("labels", "array<string>")])


#: Bound: pages whose labels a task remembers.
REMEMBERED_PAGES = 1 << 12


def label_pages(pages: DataFrame, steps: tuple[str, ...] | None = None) -> DataFrame:
    """``label_lists`` of receipts that are a row each: receipt_id, words and marks, two arrays in the order of the tokens
    (marks: struct of label, conf, x1, y1, x2, y2, row_id, zone). Tokens are neither laid out, sorted nor shuffled, and pages of a
    batch that are equal in all words and marks are repaired once."""
    run = _repaired(steps)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(REMEMBERED_PAGES)
        def repaired(words: str, marks: str) -> list[str]:
            pairs = zip_longest(said := json.loads(words), json.loads(marks)[: len(said)])  # a token may lack its mark
            rows = [(i, w, *map((m or {}).get, _MARKS)) for i, (w, m) in enumerate(pairs)]
            return [x[4] for x in run(None, rows)] if rows else []

        for b in batches:
            words, marks = (b.column(i).dictionary_encode() for i in (1, 2))
            pairs, at = np.unique(words.indices.to_numpy() * np.int64(len(marks.dictionary)) + marks.indices.to_numpy(), return_inverse=True)
            texts, shapes = words.dictionary.to_pylist(), marks.dictionary.to_pylist()
            got = [repaired(texts[p // len(shapes)], shapes[p % len(shapes)]) for p in pairs.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.string())).take(pa.array(at))], names=["receipt_id", "labels"])

    whole = lambda c: F.to_json(F.coalesce(c, F.array()))
    return pages.select("receipt_id", whole(F.col("words")), whole(F.col("marks"))).mapInArrow(stream, "receipt_id long, labels array<string>")


_MARKS = ("label", "conf", "x1", "y1", "x2", "y2", "row_id", "zone")
_COLUMNS = ("receipt_id", "idx", "word", *_MARKS)


def _repaired(steps: tuple[str, ...] | None) -> Callable[[object, list[tuple]], list[tuple]]:
    chain = tuple(f for f in CHAIN if steps is None or f.__name__ in steps)

    def run(receipt, rows: list[tuple]) -> list[tuple]:
        idx, words, labels, confs, *rest = (list(c) for c in zip(*rows))
        boxes, row_ids, zones_ = [[x or 0 for x in b] for b in zip(*rest[:4])], rest[4], rest[5]
        whole = lambda c: None if any(x is None for x in c) else c
        try:
            p = repair(Page(words, [x or "O" for x in labels], confs, boxes, whole(row_ids), whole(zones_)), chain)
            got = p.words, p.labels, p.confs, [int(r) for r in p.rows], p.zones
        except Exception:  # whatever one receipt's data breaks: its tokens stay as they are
            got = words, labels, confs, row_ids, zones_
        return [(receipt, i, w, raw, lab, c, r, z) for i, raw, w, lab, c, r, z in zip(idx, labels, *got)]

    return run
