"""Reading a model's answer: JSON from free text into one normal struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import clean_text, confidence_or_null, let, normalize_currency, normalize_date, normalize_phone, parse_money

_ITEM = "struct<name:string,item_name:string,price:string,line_price:string,line_total:string,confidence:string>"
_TOP = ("vendor", "phone", "address", "date", "receipt_date", "subtotal", "tax", "total", "currency", "confidence")
SCHEMA = "struct<" + ",".join(f"{c}:string" for c in _TOP) + ",items:array<string>,receipt_items:array<string>>"


def json_block(c: Column) -> Column:
    """The fenced object of a text, else from its first brace to its last, else null."""
    t = F.trim(c)
    fenced = F.regexp_extract(t, r"(?is)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(fenced != "", fenced), F.when(bare != "", bare))


def _some(*columns: Column) -> Column:
    """The first that is neither null, empty, 0 nor false: how alias names fall through."""
    return F.coalesce(*(F.when(~c.isin("", "0", "0.0", "false"), c) for c in columns[:-1]), columns[-1])


def items(raw: Column) -> Column:
    """Normal items of an array of JSON texts. Numbers are given before entries that are no objects are left out."""

    def one(text: Column, i: Column) -> Column:
        o = F.from_json(text, _ITEM)
        return F.when(F.trim(text).startswith("{"), F.struct(
            (i + 1).alias("line_no"), clean_text(_some(o["name"], o["item_name"])).alias("name"),
            parse_money(_some(o["price"], o["line_price"], o["line_total"])).alias("price"), confidence_or_null(o["confidence"]).alias("confidence"),
        ))

    return F.filter(F.transform(raw, one), lambda x: x.isNotNull())


def receipt(c: Column, default_currency: str = "CAD") -> Column:
    """struct of the normal fields of an answer; null if it holds no JSON object. A missing confidence is
    estimated from the fields there are."""
    def fields(o: Column) -> Column:
        listed = items(F.coalesce(F.when(F.size(o["items"]) > 0, o["items"]), o["receipt_items"], F.array().cast("array<string>")))
        return F.struct(
            clean_text(o["vendor"]).alias("vendor"), normalize_phone(o["phone"]).alias("phone"), clean_text(o["address"]).alias("address"), normalize_date(_some(o["date"], o["receipt_date"])).alias("date"), listed.alias("items"),
            *(parse_money(o[k]).alias(k) for k in ("subtotal", "tax", "total")), normalize_currency(o["currency"], default_currency).alias("currency"), confidence_or_null(o["confidence"]).alias("given"),
        )

    def whole(r: Column) -> Column:
        points = lambda k, n: F.when(r[k].isNotNull(), n).otherwise(0)
        guess = F.lit(40) + sum(points(k, n) for k, n in (("vendor", 10), ("total", 15), ("subtotal", 8), ("tax", 5), ("date", 5), ("phone", 5))) + F.least(F.lit(12), 2 * F.size(r["items"]))
        kept = ("vendor", "phone", "address", "date", "items", "subtotal", "tax", "total", "currency")
        return F.struct(*(r[k].alias(k) for k in kept), F.coalesce(r["given"], F.least(F.lit(100), guess).cast("double")).alias("confidence"))

    read = lambda b: F.when(F.try_parse_json(b).isNotNull(), let(let(F.from_json(b, SCHEMA), fields), whole))
    return let(json_block(c), read)


def items_only(c: Column, default_currency: str = "CAD") -> Column:
    """struct of items, currency and confidence of an answer that lists items only."""
    o = F.from_json(json_block(c), SCHEMA)
    return F.struct(items(F.coalesce(o["items"], F.array().cast("array<string>"))).alias("items"), normalize_currency(o["currency"], default_currency).alias("currency"), confidence_or_null(o["confidence"]).alias("confidence"))


def merge_summary_and_items(summary: Column, listed: Column) -> Column:
    """The summary with the items of a second answer, its currency and confidence filling what is missing."""
    keep = ("vendor", "phone", "address", "date", "subtotal", "tax", "total")
    return F.struct(*(summary[k].alias(k) for k in keep), listed["items"].alias("items"), F.coalesce(summary["currency"], listed["currency"]).alias("currency"), F.coalesce(summary["confidence"], listed["confidence"]).alias("confidence"))


def ocr_text(c: Column) -> Column:
    """Text of an OCR document: ``text``, else the rows' text or line_text, one a line; null if it is no JSON."""
    rows = F.from_json(F.get_json_object(c, "$.rows"), "array<struct<text:string,line_text:string>>")
    joined = F.array_join(F.filter(F.transform(rows, lambda r: F.trim(F.coalesce(r["text"], r["line_text"]))), lambda x: x != ""), "\n")
    text = F.get_json_object(c, "$.text")
    return F.coalesce(F.when(F.trim(text) != "", text), joined)


def tolerant(c: Column) -> Column:
    """A JSON text as variant, null where it is broken."""
    return F.try_parse_json(c)


def write(c: Column) -> Column:
    """JSON text of a struct; {} for null."""
    return F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("{}"))
