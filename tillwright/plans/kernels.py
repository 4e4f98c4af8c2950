"""Extraction kernels over every order: tokens are laid out from its lines, so the items and amounts that must
come out are the lines' own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, items, long_blocks, sequences
from ..sources import adapters
from .queries import ITEMS, query

MONEY = adapters.MONEY
_IT = f"{ITEMS}, pr AS (SELECT receipt_id, line_no, item_name, qty + 0.25 AS price FROM items)"


def _lines(spark, d) -> DataFrame:
    price = (F.col("qty") + F.lit("0.25").cast("decimal(4,2)")).cast(MONEY)
    return adapters.items(spark, d).select("receipt_id", "line_no", "item_name", price.alias("price"))


def _placed(t: DataFrame, line: Column) -> DataFrame:
    """Tokens (receipt_id, line, k, p: word, label, x) with their index and box: a line every 30 units."""
    y = line * 30
    return t.select("receipt_id", (line * 100 + F.col("k")).cast("int").alias("idx"), "p.word", "p.label", F.lit(0.9).alias("conf"), F.col("p.x").cast("int").alias("x1"), y.cast("int").alias("y1"), (F.col("p.x") + 80).cast("int").alias("x2"), (y + 18).cast("int").alias("y2"))


def _token(word: Column, label: str | Column, x) -> Column:
    return F.struct(word.alias("word"), (F.lit(label) if isinstance(label, str) else label).alias("label"), (F.lit(x) if isinstance(x, int) else x).alias("x"))


def _tokens(spark, d, price_first: bool = False) -> DataFrame:
    name = F.transform(F.split("item_name", " "), lambda w, k: _token(w, F.when(k == 0, "B-MENU.NM").otherwise("I-MENU.NM"), 50 + k * 90))
    price = F.array(_token(F.col("price").cast("string"), "B-MENU.PRICE", 700))
    t = _lines(spark, d).select("receipt_id", "line_no", F.posexplode(F.concat(price, name) if price_first else F.concat(name, price)).alias("k", "p"))
    return _placed(t, F.col("line_no"))


@query(f"WITH {_IT} SELECT receipt_id, line_no AS item_no, item_name AS name, price::DOUBLE AS price FROM pr")
def items_of_orders(spark, d):
    return items.extract_items(_tokens(spark, d)).select("receipt_id", "item_no", "name", "price")


@query(f"WITH {_IT} SELECT receipt_id, line_no AS item_no, item_name AS name, price::DOUBLE AS price FROM pr")
def items_price_first(spark, d):
    return items.extract_items(_tokens(spark, d, price_first=True), kind="price_then_name").select("receipt_id", "item_no", "name", "price")


@query(f"WITH {_IT}, s AS (SELECT receipt_id, sum(price) AS sub, count(*) AS n FROM pr GROUP BY 1) SELECT receipt_id, sub::DOUBLE AS subtotal, 1.05::DOUBLE AS tax, (sub + 1.05)::DOUBLE AS total, n::INT AS n_items FROM s")
def summaries_of_orders(spark, d):
    """Items, then SUBTOTAL, TAX and TOTAL with their amounts."""
    sums = _lines(spark, d).groupBy("receipt_id").agg(F.sum("price").alias("sub"), F.max("line_no").alias("last"))
    tax = F.lit("1.05").cast(MONEY)
    pairs = ((1, "SUBTOTAL", "SUM.SUBTOTAL", F.col("sub")), (2, "TAX", "SUM.TAX", tax), (3, "TOTAL", "SUM.TOTAL", F.col("sub") + tax))
    rows = F.array(*(F.struct(F.lit(n).alias("n"), F.array(_token(F.lit(w), f"B-{label}", 50), _token(v.cast(MONEY).cast("string"), f"I-{label}", 700)).alias("t")) for n, w, label, v in pairs))
    t = sums.select("receipt_id", "last", F.explode(rows).alias("r")).select("receipt_id", (F.col("last") + F.col("r.n")).alias("line"), F.posexplode("r.t").alias("k", "p"))
    both = _tokens(spark, d).unionByName(_placed(t, F.col("line")))
    return items.extract_summary(both).select("receipt_id", F.round("subtotal", 2).alias("subtotal"), F.round("tax", 2).alias("tax"), F.round("total", 2).alias("total"), "n_items")


@query(f"WITH {_IT} SELECT receipt_id, (row_number() OVER (PARTITION BY receipt_id ORDER BY line_no))::INT - 1 AS place, item_name AS text FROM pr")
def reading_order_of_orders(spark, d):
    """Blocks in the reverse of their order on the page, each twice: copies go, the page's order comes back."""
    b = _lines(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    y = F.col("line_no") * 30
    b = b.select("receipt_id", (1000 - 2 * F.col("line_no") + F.col("copy")).cast("int").alias("pos"), F.col("item_name").alias("text"), F.lit(50).alias("x1"), y.cast("int").alias("y1"), F.lit(300).alias("x2"), (y + 18).cast("int").alias("y2"))
    return blocks.order_blocks(b).select("receipt_id", "place", "text")


@query(f"WITH {ITEMS} SELECT receipt_id, line_no * 100 AS start, 'MENU.NM' AS kind, item_name AS text FROM items UNION ALL SELECT receipt_id, line_no * 100 + 2, 'MENU.PRICE', (qty + 0.25)::DECIMAL(18,2)::VARCHAR FROM items")
def entities_of_orders(spark, d):
    return sequences.entities(_tokens(spark, d)).select("receipt_id", "start", "kind", "text")


@query(f"WITH {ITEMS} SELECT receipt_id, line_no AS row_id, item_name || ' ' || (qty + 0.25)::DECIMAL(18,2)::VARCHAR AS text, 50 AS x1, line_no * 30 AS y_top, TRUE AS has_name, TRUE AS has_price, FALSE AS has_summary FROM items")
def rows_of_orders(spark, d):
    t = _tokens(spark, d).withColumn("row_id", F.floor(F.col("idx") / 100).cast("int"))
    return sequences.rows(t).select("receipt_id", "row_id", "text", "x1", "y_top", "has_name", "has_price", "has_summary")


@query(f"WITH {ITEMS} SELECT receipt_id, line_no AS row_id, item_name || ' ' || (qty + 0.25)::DECIMAL(18,2)::VARCHAR AS text, 50 AS x1, line_no * 30 AS y1, 780 AS x2, line_no * 30 + 18 AS y2, CASE WHEN line_no % 2 = 0 THEN 'body' ELSE 'header' END AS zone FROM items")
def line_summaries_of_orders(spark, d):
    row = F.floor(F.col("idx") / 100).cast("int")
    t = _tokens(spark, d).withColumns({"row_id": row, "zone": F.when(row % 2 == 0, "body").otherwise("header")})
    return sequences.lines(t).select("receipt_id", "row_id", "text", "x1", "y1", "x2", "y2", "zone")


@query(f"WITH {ITEMS}, t AS (SELECT receipt_id, line_no * 100 + k AS idx, CASE k WHEN 0 THEN split_part(item_name, ' ', 1) WHEN 1 THEN split_part(item_name, ' ', 2) ELSE (qty + 0.25)::DECIMAL(18,2)::VARCHAR END AS word FROM items, range(0, 3) r(k)) SELECT receipt_id, idx::INT AS idx, concat_ws(' ', lag(word) OVER w, word, lead(word) OVER w) AS around FROM t WINDOW w AS (PARTITION BY receipt_id ORDER BY idx)")
def context_of_orders(spark, d):
    return _tokens(spark, d).select("receipt_id", "idx", sequences.context("word", 1, 1).alias("around"))


# long receipts

def _long_tokens(spark, d) -> DataFrame:
    """Every order as a long receipt, in five layouts of its summary: a labelled tax; an unlabelled one with base and
    rate; a total alone; no total; savings and no tax. After the summary each has lines that look like items."""
    t = _tokens(spark, d).withColumn("row_id", F.floor(F.col("idx") / 100).cast("int"))
    sums = _lines(spark, d).groupBy("receipt_id").agg(F.sum("price").alias("sub"), F.max("line_no").alias("last"))
    tax, sub, k = F.lit("1.05").cast(MONEY), F.col("sub").cast(MONEY), F.col("receipt_id") % 5
    show = lambda c: c.cast(MONEY).cast("string")

    def line(when: Column, *words: tuple[Column | str, str]) -> Column:
        tokens = F.array(*(_token(F.lit(w) if isinstance(w, str) else w, label, 50 + 160 * i) for i, (w, label) in enumerate(words)))
        return F.when(when, tokens)

    some, total = F.lit(True), show(sub + tax)
    rows = F.array_compact(F.array(
        line(k.isin(0, 1, 3, 4), (F.when(k == 3, "AMOUNT").otherwise("SUBTOTAL"), "B-SUM.SUBTOTAL"), (show(sub), "I-SUM.SUBTOTAL")),
        line(k == 0, ("HST", "B-TAX"), ("1.05", "I-TAX")),
        line(k == 1, ("GST", "O"), ("21.00", "O"), ("@", "O"), ("5.00", "O"), ("%", "O"), ("1.05", "O")),
        line(k == 3, ("QST", "O")), line(k == 3, ("1.05", "O")),
        line(k == 4, ("SAVINGS", "O"), ("2.40", "O")),
        line(k.isin(0, 1, 4), ("TOTAL", "B-SUM.TOTAL"), (total, "I-SUM.TOTAL")),
        line(k == 2, ("TOTAL", "B-SUM.TOTAL"), (show(sub), "I-SUM.TOTAL")),
        line(k == 4, ("TOTAL", "O"), ("SAVINGS", "O"), ("9.99", "O")),
        line(some, ("APPLE", "B-MENU.NM"), ("PIE", "I-MENU.NM"), ("7.77", "B-MENU.PRICE")), line(some, ("LEMON", "O"), ("TART", "O"), ("8.88", "O"))))
    s = sums.select("receipt_id", "last", F.posexplode(rows).alias("n", "r")).select("receipt_id", (F.col("last") + 1 + F.col("n")).alias("line"), F.posexplode("r").alias("k", "p"))
    s = _placed(s, F.col("line")).withColumn("row_id", F.floor(F.col("idx") / 100).cast("int"))
    return t.unionByName(s)


@query(f"WITH {_IT}, u AS (SELECT receipt_id, upper(item_name) AS name, price::DOUBLE AS price, min(line_no) AS n FROM pr GROUP BY ALL) SELECT receipt_id, row_number() OVER (PARTITION BY receipt_id ORDER BY n)::INT AS item_no, name, price FROM u")
def long_items_of_orders(spark, d):
    return long_blocks.extract_long(_long_tokens(spark, d))[0].select("receipt_id", "item_no", F.upper("name").alias("name"), "price")


@query(f"""WITH {_IT}, s AS (SELECT receipt_id, receipt_id % 5 AS k, sum(price) AS sub, sum(DISTINCT price) AS one FROM pr GROUP BY 1),
u AS (SELECT receipt_id, sum(price) AS bought FROM (SELECT DISTINCT receipt_id, item_name, price FROM pr) GROUP BY 1)
SELECT receipt_id, CASE WHEN k <> 2 OR abs(bought - sub) <= 1 THEN CASE WHEN k = 2 THEN bought ELSE sub END END::DOUBLE AS subtotal, CASE WHEN k <> 2 THEN 1.05 END::DOUBLE AS tax, (sub + CASE WHEN k = 2 THEN 0 ELSE 1.05 END)::DOUBLE AS total, CASE WHEN k = 4 THEN 9.99 END::DOUBLE AS discount,
CASE WHEN k = 2 THEN CASE WHEN abs(bought - sub) <= 1 THEN 0.4 ELSE 0 END WHEN k = 3 OR sub IN (5, 6, 7, 13, 15) THEN 0.9 ELSE 0.95 END::DOUBLE AS subtotal_confidence, CASE k WHEN 2 THEN 0 WHEN 4 THEN 0.92 WHEN 3 THEN 0.85 ELSE 0.9 END::DOUBLE AS tax_confidence FROM s JOIN u USING (receipt_id)""")
def long_summaries_of_orders(spark, d):
    """A row's amount that is exactly a tax's rate is no amount: such a subtotal is the label groups', with their confidence."""
    out = long_blocks.extract_long(_long_tokens(spark, d))[1]
    return out.select("receipt_id", *(F.round(c, 2).alias(c) for c in ("subtotal", "tax", "total", "discount")), "subtotal_confidence", "tax_confidence")
