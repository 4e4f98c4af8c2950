"""Item and summary extraction from label groups: a grouped-map kernel per receipt.

The extractors consume names and prices greedily, which is sequential within a receipt; receipts are
independent. The core works on a list of ``Group`` and is tested without Spark. Patterns of layout,
regions and the summary's corrections also exist as native operators (``sequences``, ``summary``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from ..functions.money import MISREAD
from .streams import by_receipt, isolated

# Words and patterns that decide what a group is.
EACH = re.compile(r"\b(each|ea\.?|@)\b", re.I)
TIP = re.compile(r"\b(gratuity|grat|tip|tipping|service)\b|\b\d{1,2}\s*%\b", re.I)
TIMES = re.compile(r"(?:^|\s)(?:x|×)\s*(\d{1,2})(?:\b|$)", re.I)
QUANTITY_NOISE = re.compile(r"(x|×|x'|x’|x\.|x:|x;)\s*\d{0,2}", re.I)
SUMMARY_CONTEXT = re.compile(r"\b(total|subtotal|amount|tax|gst|pst|hst|vat|tendered|change|tip|gratuity)\b", re.I)
SUMMARY_START = re.compile(r"(amount|subtotal|sub\s*total|tax|total)\b", re.I)
TAX = re.compile(r"\b(tax|gst|pst|hst|vat|tps|tvq)\b", re.I)
REAL_TAX = re.compile(r"\b(tax|vat|gst|hst|pst|qst|sales\s*tax|tps|tvq)\b", re.I)
MONEY = re.compile(r"\$?\s*\d{1,7}[.,]\d{2}\s*")
STOPS = re.compile(r"\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}:\d{2}|\d{3}-\d{3}-\d{4}|\b(cashier|order|ticket|thank|visit|restaurant)\b|#", re.I)
SUMMARY_WORDS = ("subtotal", "sub total", "subtot", "total", "tot", "tax", "gst", "pst", "hst", "vat", "discount", "disc", "promo", "coupon", "void", "comp")
TIP_WORDS = ("tip", "gratuity", "suggested", "suggestions", "cash", "change", "tendered", "thank you", "percent", "%", "18%", "20%", "25%")
NO_NAME, ANY_NAME = "ITEM_NOT_DETECTED", "ITEM"
_RUN_OF_X, _MARKS, _EMBEDDED = re.compile(r"[xX]{6,}$|x{6,}"), re.compile(r"^[\s*:;,.+=]+|[\s*:;,.+=]+$"), re.compile(r"(.+?)\$\s*(\d+[.,]\d{2}|\d+)")
#: Bound: readings of words that a task remembers, as a receipt's are asked for many times.
REMEMBERED = 1 << 15


@dataclass(frozen=True)
class Settings:
    """Bounds of the extraction."""

    least_price: float = 0.01
    most_price: float = 2_000_000.0
    least_label_conf: float = 0.50
    keyword_distance: int = 2
    region_gap: float = 30
    reach: int = 3
    unlabeled_most: float = 500.0
    back: int = 6


@lru_cache(REMEMBERED)
def tidy(text: str) -> str:
    """Without runs of x, outer marks and misread pairs."""
    t = (text or "").strip()
    if _RUN_OF_X.match(t):
        return ""
    t = _MARKS.sub("", t)
    for wrong, right in MISREAD:
        t = t.replace(wrong, right)
    return t.strip()


@lru_cache(REMEMBERED)
def price_of(text: str | None, least: float = 0.01, most: float = 2_000_000.0) -> float | None:
    """The scalar form of ``functions.money.parse_price``; tests hold the two together."""
    raw = (text or "").strip()
    clock = re.fullmatch(r"(\d{1,2}):(\d{2})", raw)
    if not raw or clock and int(clock[1]) < 24 and int(clock[2]) < 60:
        return None
    raw = raw.replace(":", ".") if re.fullmatch(r"\d{1,7}:\d{2}", raw) else re.sub(r"(?<=\d):(?=\d{2}\b)", ".", raw)
    raw = tidy(raw)
    negative = raw.startswith("-") or raw.endswith("-")
    raw = raw.strip("-").strip()
    found = next((m for p in (r"\d+[.,]\d{2}", r"\.\d{2}", r",\d{2}") if (m := re.findall(p, raw))), None)
    digits = re.findall(r"\d+", raw)
    if not digits:
        return None
    value = float(found[-1].replace(",", ".") if found else max(digits, key=len))
    value = -value if negative else value
    fits = value == 0 or (-most <= value if value < 0 else least <= value <= most)
    return value if fits else None


@dataclass
class Group:
    """Neighbouring tokens of one label."""

    label: str
    text: str
    tokens: list[str]
    conf: float
    boxes: list[tuple] = field(default_factory=list)

    @property
    def name(self) -> bool:
        return self.label == "B-MENU.NM"

    @property
    def more(self) -> bool:
        return self.label == "I-MENU.NM"

    @property
    def price(self) -> bool:
        return self.label == "B-MENU.PRICE"

    @property
    def summary(self) -> bool:
        return self.label[2:].startswith(("SUM.", "TAX"))

    @property
    def x(self) -> float | None:
        xs = [v for b in self.boxes for v in (b[0], b[2])]
        return (min(xs) + max(xs)) / 2 if xs else None

    @property
    def y(self) -> float:
        ys = [b[1] for b in self.boxes]
        return (min(ys) + max(ys)) / 2 if ys else 0.0


def group_tokens(words, labels, confs, boxes) -> list[Group]:
    """Groups in order: a B and a change of type begin one; tokens without a label are a type of their own."""
    out: list[Group] = []
    parts: list[list[float]] = []
    last = ""
    for w, lab, c, b in zip(words, labels, confs, boxes):
        begins = lab[:2] == "B-"
        kind = lab[2:] if begins or lab[:2] == "I-" else lab
        if out and not begins and kind == last:
            out[-1].tokens.append(w)
            out[-1].boxes.append(tuple(b))
            parts[-1].append(c)
        else:
            out.append(Group(lab, "", [w], 0.0, [tuple(b)]))
            parts.append([c])
            last = kind
    for g, cs in zip(out, parts):
        g.text, g.conf = " ".join(g.tokens), sum(cs) / len(cs)
    return out


@dataclass
class Item:
    name: str
    price: float
    unit_price: float | None
    tokens: list[str]
    conf: float
    source: str


def _item(name: str, price: float, g: Group, source: str, unit: float | None = None) -> Item:
    return Item(name, price, unit, list(g.tokens), g.conf, source)


def _around(groups: list[Group], i: int, reach: int = 2) -> str:
    return " ".join([x for g in groups[max(0, i - reach) : i + reach + 1] for x in (tidy(g.text), *g.tokens) if x])


def _says(pattern: re.Pattern, parts: tuple[str, ...], text: str) -> bool:
    """Whether the pattern is found; plain text without any of ``parts``, one of which every match holds, is not searched."""
    if text.isascii():
        low = text.lower()
        if not any([p in low for p in parts]):
            return False
    return bool(pattern.search(text))


def _tip(text: str) -> bool:
    return _says(TIP, ("%", "tip", "grat", "service"), text)


def _each(text: str) -> bool:
    return _says(EACH, ("ea", "@"), text)


def _name_run(groups: list[Group], i: int) -> tuple[str, int]:
    """The name that begins at i and the place after its continuations."""
    j = i + 1
    while j < len(groups) and groups[j].more:
        j += 1
    return " ".join(t for t in (tidy(g.text) for g in groups[i:j]) if t), j


def total_and_unit(a: float, b: float, name: str, each: bool) -> tuple[float, float] | None:
    """(total, unit) of two prices in a row, if something says that they are that: a word for each, a
    quantity in the name that one times the other meets, or a whole ratio from 2 to 12."""
    high, low = max(a, b), min(a, b)
    if each:
        return high, low
    m = TIMES.search(name)
    times = int(m[1]) if m and 1 <= int(m[1]) <= 50 else None
    if low <= 0:
        return None
    near = lambda x, y: abs(x - y) <= max(0.05 * y, 0.10)
    if times and near(low * times, high):
        return high, low
    if times and near(high * times, low):
        return low, high
    whole = round(high / low)
    return (high, low) if 2 <= whole <= 12 and abs(high / low - whole) <= 0.05 else None


def name_then_price(groups: list[Group], s: Settings = Settings()) -> list[Item]:
    """Names followed by their prices; a name without one waits for the second of two later prices."""
    out: list[Item] = []
    used: set[int] = set()
    waiting: str | None = None
    read = lambda j: price_of(tidy(groups[j].text), 0.0, s.most_price)
    for i, g in enumerate(groups):
        if not g.name:
            continue
        parts, j, met = [tidy(g.text)], i + 1, False
        while j < len(groups) and not groups[j].price and not groups[j].name and not groups[j].label.startswith("B-SUM."):
            if groups[j].more:
                parts.append(tidy(groups[j].text))
            j += 1
        name = " ".join(p for p in parts if p).strip()
        if j < len(groups) and groups[j].price:
            met = True
            first = None if _tip(_around(groups, j)) else read(j)
            if first is not None:
                name = name or ANY_NAME
                second = read(j + 1) if j + 1 < len(groups) and groups[j + 1].price else None
                after = tidy(groups[j + 2].text) if j + 2 < len(groups) else ""
                if second is None:
                    out.append(_item(name, first, groups[j], "labeled_name_price"))
                else:
                    each = _each(after) or _each(_around(groups, j + 1))
                    pair = total_and_unit(first, second, name, each)
                    if pair is None and waiting:
                        out.append(_item(name, first, groups[j], "labeled_name_price"))
                        out.append(_item(waiting, second, groups[j + 1], "labeled_pending_name_price"))
                        waiting = None
                    else:
                        total, unit = pair or (first, None)
                        out.append(_item(name, total, groups[j], "labeled_name_price", unit))
                    used.add(j + 1)
                used.add(j)
        if not met and name:
            waiting = name
    for i, g in enumerate(groups):
        if not g.more or i in used:
            continue
        owned = any(groups[j].name and not any(x.price for x in groups[j + 1 : i]) for j in range(max(0, i - 5), i))
        if owned:
            continue
        parts = [tidy(g.text)]
        if i:
            before = tidy(groups[i - 1].text)
            if re.search("[A-Za-z]", before) and not SUMMARY_CONTEXT.search(before):
                parts.insert(0, re.sub(r"^\d+\W*", "", before).strip())
        j = i + 1
        while j < len(groups) and not groups[j].price and not groups[j].name and not groups[j].label.startswith("B-SUM."):
            if groups[j].more:
                parts.append(tidy(groups[j].text))
            j += 1
        if j < len(groups) and groups[j].price and not _tip(_around(groups, j)) and read(j) is not None:
            out.append(_item(" ".join(p for p in parts if p).strip() or ANY_NAME, read(j), groups[j], "labeled_orphan_i_menu"))
            used.add(j)
    for i, g in enumerate(groups):
        if g.price and i not in used and not _tip(_around(groups, i)) and not _each(_around(groups, i)) and read(i) is not None:
            out.append(_item(NO_NAME, read(i), g, "labeled_orphan_price"))
    return out


def price_then_name(groups: list[Group], s: Settings = Settings()) -> list[Item]:
    """Prices followed by their names; prices without one near are stacked, and later names take the
    newest of the stack."""
    out: list[Item] = []
    stack: list[tuple[Group, float]] = []
    i = 0
    while i < len(groups) and not groups[i].summary:
        g = groups[i]
        if g.price and (value := price_of(tidy(g.text), 0.0, s.most_price)) is not None:
            at = None
            for j in range(i + 1, min(len(groups), i + s.reach + 1)):
                if groups[j].summary or groups[j].price:
                    break
                if groups[j].name:
                    at = j
                    break
            if at is None:
                stack.append((g, value))
            else:
                out.append(_item(_name_run(groups, at)[0] or ANY_NAME, value, g, "labeled_price_name"))
        elif g.name and stack:
            name, i = _name_run(groups, i)
            top, value = stack.pop()
            out.append(_item(name or ANY_NAME, value, top, "labeled_price_name_buffered"))
            continue
        i += 1
    return out + [_item(NO_NAME, value, g, "labeled_price_name_orphan_buffer") for g, value in stack]


def mixed(groups: list[Group], s: Settings = Settings()) -> list[Item]:
    """Undecided layout: names with the price right after them, continuations without a name likewise,
    then prices with a name after them, then prices alone."""
    out: list[Item] = []
    used: set[int] = set()
    read = lambda j: price_of(tidy(groups[j].text), 0.0, s.most_price)

    def forward(i: int, source: str) -> None:
        parts, j = [tidy(groups[i].text)], i + 1
        used.add(i)
        while j < len(groups) and (j in used or groups[j].more):
            if j not in used:
                parts.append(tidy(groups[j].text))
                used.add(j)
            j += 1
        if j < len(groups) and groups[j].price and read(j) is not None:
            out.append(_item(" ".join(parts).strip(), read(j), groups[j], source))
            used.add(j)

    for i, g in enumerate(groups):
        if g.name and i not in used:
            forward(i, "labeled_mixed_name_price")
    for i, g in enumerate(groups):
        if g.more and i not in used and not any(x.name for x in groups[max(0, i - 5) : i]):
            forward(i, "labeled_mixed_orphan_i")
    for i, g in enumerate(groups):
        if not g.price or i in used or read(i) is None:
            continue
        if any(j in used and (groups[j].name or groups[j].more) for j in range(max(0, i - 3), i)):
            continue
        for j in range(i + 1, min(len(groups), i + s.reach + 1)):
            if j in used:
                continue
            if groups[j].price:
                break
            if groups[j].name:
                parts = [j]
                while parts[-1] + 1 < len(groups) and parts[-1] + 1 not in used and groups[parts[-1] + 1].more:
                    parts.append(parts[-1] + 1)
                used.update([*parts, i])
                out.append(_item(" ".join(tidy(groups[k].text) for k in parts).strip(), read(i), g, "labeled_mixed_price_name"))
                break
    for i, g in enumerate(groups):
        if g.price and i not in used and read(i) is not None:
            out.append(_item(NO_NAME, read(i), g, "labeled_mixed_orphan_price"))
    return out


def layout(groups: list[Group], reach: int, dominance: float | None) -> str:
    """name_then_price, price_then_name or mixed, by the prices with a name before or after them."""
    labels = [g.label for g in groups]
    at = [i for i, lab in enumerate(labels) if lab == "B-MENU.PRICE"]
    near = [labels[max(0, i - reach) : i] for i in at]
    before = sum(["B-MENU.NM" in x or "I-MENU.NM" in x for x in near])
    after = sum(["B-MENU.NM" in labels[i + 1 : i + 1 + reach] for i in at])
    k = dominance or 1.0
    return "name_then_price" if before > k * after else "price_then_name" if after > k * before else "mixed"


def swap_by_x(groups: list[Group]) -> list[Group]:
    """Two names and then two prices, each price nearer to the other's name: the prices change places."""
    out, i = list(groups), 0
    while i + 4 <= len(out):
        a, b, p, q = out[i : i + 4]
        xs = [g.x for g in (a, b, p, q)] if a.name and b.name and p.price and q.price else [None]
        if None not in xs and abs(xs[2] - xs[1]) < abs(xs[2] - xs[0]) and abs(xs[3] - xs[0]) < abs(xs[3] - xs[1]):
            out[i + 2], out[i + 3] = q, p
            i += 4
        else:
            i += 1
    return out


def split_regions(groups: list[Group], s: Settings) -> list[list[Group]]:
    """Regions by jumps in y, tiny ones merged: noise and lone names into the next, a price into the
    region of the name right before it."""
    regions: list[list[Group]] = []
    for i, g in enumerate(groups):
        if not i or g.y - groups[i - 1].y > s.region_gap:
            regions.append([])
        regions[-1].append(g)
    out: list[list[Group]] = []
    carried: list[Group] = []
    for k, region in enumerate(regions):
        region = carried + region
        carried = []
        after = regions[k + 1] if k + 1 < len(regions) else None
        tiny = len(region) <= 2
        noise = tiny and all(QUANTITY_NOISE.fullmatch(tidy(g.text)) or g.label.startswith("B-SUM.") and g.conf < 0.70 and len(tidy(g.text)) <= 6 for g in region)
        lone = tiny and all(g.name or g.more for g in region) and after is not None and after[0].name and any(g.price for g in after[:6])
        if after is not None and (noise or lone):
            carried = region
        elif out and (noise or out[-1][-1].name and region[0].price):
            out[-1] += region
        else:
            out.append(region)
    return out


@lru_cache(REMEMBERED)
def _squeeze(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", text.lower())


@lru_cache(REMEMBERED)
def _like_keyword(word: str, keywords: tuple[str, ...], most: int) -> bool:
    w = _squeeze(word)
    if not w:
        return False
    if len(w) <= 4:
        return any(w == _squeeze(k) for k in keywords)
    return any(_distance(w, _squeeze(k), most) <= most for k in keywords)


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or more than ``most`` once it cannot be less."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def summary_bound(words: list[str], labels: list[str], confs: list[float], s: Settings = Settings()) -> int | None:
    """Place at which items end: after the last TOTAL label, else where the summary credibly begins."""
    totals = [i for i, x in enumerate(labels) if x in ("B-SUM.TOTAL", "I-SUM.TOTAL")]
    if totals:
        return totals[-1] + 1
    for i, (w, lab, c) in enumerate(zip(words, labels, confs)):
        if SUMMARY_START.match(w.strip()):
            return i
        if lab.startswith("B-SUM") or lab == "B-TAX":
            money = any(MONEY.fullmatch(x) for x in words[max(0, i - 2) : i + 3])
            if c >= s.least_label_conf or SUMMARY_CONTEXT.search(w) or lab in ("B-TAX", "B-SUM.TAX") and (TAX.search(w) or money):
                return i
    return None


def unlabeled(words: list[str], labels: list[str], confs: list[float], s: Settings = Settings()) -> list[Item]:
    """Items among tokens without a label: ``Name$9.99`` in one, then prices with the words before them."""
    loose = [lab == "O" or lab[2:].startswith(("SUM.", "TAX")) and c < s.least_label_conf for lab, c in zip(labels, confs)]
    if True not in loose:
        return []
    end = summary_bound(words, labels, confs, s)
    end = len(words) if end is None else end
    free = loose.__getitem__
    key = lambda w: _like_keyword(w, SUMMARY_WORDS, s.keyword_distance) or _like_keyword(w, TIP_WORDS, s.keyword_distance)
    value = lambda t: (price_of(t, s.least_price, s.unlabeled_most) or None)
    out: list[Item] = []
    used: set[int] = set()
    for i in range(end):
        w = words[i].strip()
        m = _EMBEDDED.fullmatch(w) if free(i) and "$" in w else None
        if m and not key(w) and tidy(m[1]) and value(m[2]) is not None:
            out.append(Item(tidy(m[1]), value(m[2]), None, [words[i]], confs[i], "unlabeled_embedded"))
            used.add(i)
    for i in range(end):
        w = words[i]
        if i in used or not free(i) or not MONEY.fullmatch(w.strip()) or value(w) is None or SUMMARY_CONTEXT.search(" ".join(words[max(0, i - 5) : i] + words[i + 1 : i + 6])):
            continue
        j = i - 1
        while j >= 0 and i - 1 - j < s.back and j not in used:
            x = words[j].strip()
            if STOPS.search(x) or sum(ch.isdigit() for ch in x) >= 4 or not free(j) or key(x) or MONEY.fullmatch(x):
                break
            j -= 1
        name = tidy(" ".join(x.strip() for x in words[j + 1 : i]))
        if name:
            out.append(Item(name, value(w), None, [w], confs[i], "unlabeled_separate"))
            used.update(range(j + 1, i + 1))
    return out


def adaptive(groups: list[Group], words: list[str], labels: list[str], confs: list[float], s: Settings = Settings()) -> list[Item]:
    """The extractor that fits the receipt's layout, or each region's; then the unlabeled items."""
    by = {"name_then_price": name_then_price, "price_then_name": price_then_name, "mixed": mixed}
    kind = layout(groups, s.reach, 1.5)
    moved = swap_by_x(groups)
    if kind != "mixed":
        out = by[kind](moved, s)
    else:
        out = [x for r in split_regions(moved, s) for x in by[layout(r, 2, None)](swap_by_x(r), s)]
    return out + unlabeled(words, labels, confs, s)


def summary_fields(groups: list[Group], s: Settings = Settings()) -> dict[str, float | None]:
    """subtotal, tax and total with their confidences: the surest value of each, the later of equals;
    without a tax label, a number at a tax word within three groups of the subtotal or total."""
    out: dict[str, float | None] = {"subtotal": None, "tax": None, "total": None}
    conf = dict.fromkeys(out, 0.0)
    at: dict[str, int] = {}
    labelled = expecting = False
    for i, g in enumerate(groups):
        text, kind = tidy(g.text), g.label[2:]
        for name in ("subtotal", "total"):
            if kind == f"SUM.{name.upper()}":
                at[name] = i
                v = price_of(text, s.least_price, s.most_price)
                if v is not None and (out[name] is None or g.conf >= conf[name]):
                    out[name], conf[name] = v, g.conf
        if kind in ("TAX", "SUM.TAX"):
            labelled = True
            begins = g.label.startswith("B-")
            if begins:
                conf["tax"] = max(conf["tax"], g.conf)
            real = bool(REAL_TAX.search(text))
            v = price_of(text, 0.0, s.most_price) if real else None
            if v is not None and not (begins and "%" in text) and (out["tax"] is None or g.conf >= conf["tax"]):
                out["tax"], conf["tax"] = v, g.conf
        elif not labelled and any(abs(i - j) <= 3 for j in at.values()):
            expecting = expecting or bool(TAX.search(text)) and not re.search(r"\btotal\s*tax\b", text, re.I)
            v = price_of(text, 0.0, s.most_price) if expecting and "%" not in text else None
            if v is not None:
                out["tax"], conf["tax"], expecting = v, max(conf["tax"], g.conf), False
    if out["subtotal"] is not None and out["tax"] is not None and out["tax"] > out["subtotal"]:
        out["subtotal"], out["tax"] = out["tax"], out["subtotal"]
        conf["subtotal"], conf["tax"] = conf["tax"], conf["subtotal"]
    return out | {f"{k}_conf": v for k, v in conf.items()}


def corrected(f: dict[str, float | None], items_sum: float) -> dict[str, float | None]:
    """The summary made to agree: see ``summary.correct``, of which this is the scalar form."""
    f = dict(f)
    if f["subtotal"] is None and items_sum > 0:
        f["subtotal"] = items_sum
    sub, tax, total = f["subtotal"], f["tax"], f["total"]
    if total is None and sub is not None and tax is not None and tax > sub:
        total, tax = tax, tax - sub
        f["tax_conf"] = min(f["tax_conf"], 0.5)
    elif total is None and sub is not None and tax is not None:
        total = sub + tax
        f["total_conf"] = min(f["subtotal_conf"], f["tax_conf"])
    elif total is None and sub is not None and sub > 0:
        total, tax = sub, 0.0
    if sub and tax and total and abs(sub + tax - total) > 0.05:
        tax = total - sub
    return f | {"subtotal": sub, "tax": tax, "total": total}


ITEMS = "receipt_id long, item_no int, name string, price double, unit_price double, price_tokens array<string>, price_confidence double, source string"
SUMMARY = "receipt_id long, subtotal double, tax double, total double, subtotal_conf double, tax_conf double, total_conf double, pattern string, n_items int"
KINDS = {"adaptive": None, "name_then_price": name_then_price, "price_then_name": price_then_name, "mixed": mixed}


def _receipt(rows: list[tuple]):
    """Words, labels, confidences and groups of one receipt's tokens (idx, word, label, conf, box), in order."""
    words, labels, confs = [r[1] or "" for r in rows], [r[2] or "O" for r in rows], [r[3] or 0.0 for r in rows]
    boxes = [b if None not in b else tuple([x or 0 for x in b]) for b in [r[4:] for r in rows]]
    return words, labels, confs, group_tokens(words, labels, confs, boxes)


_COLUMNS = ("receipt_id", "idx", "word", "label", "conf", "x1", "y1", "x2", "y2")


def _isolated(tokens: DataFrame, run: Callable[[object, list[tuple]], list[tuple]], schema: str, with_errors: bool) -> DataFrame:
    """``run`` for each receipt, as rows of the schema: tokens are dealt by receipt once and each partition is
    read as one sorted stream, a receipt in memory at a time. One that raises gives no rows, or where
    ``with_errors`` one row with its id and the error alone: the other receipts go on."""
    fields = [tuple(c.split()) for c in (schema + ", error string" * with_errors).split(", ")]
    return by_receipt(tokens, _COLUMNS, "idx", isolated(run, len(fields) - with_errors, with_errors), fields)


def extract_items(tokens: DataFrame, kind: str = "adaptive", settings: Settings = Settings(), with_errors: bool = False) -> DataFrame:
    """Items of every receipt's tokens. ``kind`` forces one extractor. A receipt that fails gives no rows, or
    its error."""

    def run(receipt, rows: list[tuple]) -> list[tuple]:
        words, labels, confs, groups = _receipt(rows)
        found = adaptive(groups, words, labels, confs, settings) if kind == "adaptive" else KINDS[kind](groups, settings)
        return [(int(receipt), i, x.name, x.price, x.unit_price, x.tokens, x.conf, x.source) for i, x in enumerate(found, 1)]

    return _isolated(tokens, run, ITEMS, with_errors)


def extract_summary(tokens: DataFrame, settings: Settings = Settings(), with_errors: bool = False) -> DataFrame:
    """Corrected subtotal, tax and total of every receipt, with its layout and number of items. A receipt that
    fails gives no row, or its error."""

    def run(receipt, rows: list[tuple]) -> list[tuple]:
        words, labels, confs, groups = _receipt(rows)
        found = adaptive(groups, words, labels, confs, settings)
        f = corrected(summary_fields(groups, settings), sum(x.price for x in found))
        return [(int(receipt), *(f[k] for k in ("subtotal", "tax", "total", "subtotal_conf", "tax_conf", "total_conf")), layout(groups, settings.reach, 1.5), len(found))]

    return _isolated(tokens, run, SUMMARY, with_errors)


def windows(values: list, size: int) -> Iterator[list]:
    """Consecutive windows of a list."""
    return (values[i : i + size] for i in range(max(0, len(values) - size + 1)))
