"""Value functions over whole tables: texts are written from known numbers, dates and names, so that the SQL
gives the expected value from the column and not from a second reading of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import llm_json, money, text
from ..operators import intake, summary, tables
from ..sources import adapters, ocr
from .queries import query

MONEY = adapters.MONEY


def _lines(spark, d) -> DataFrame:
    """Lines with their price, quantity and a choice of writing."""
    li = adapters.read(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").cast(MONEY).alias("p"), F.col("l_quantity").cast("int").alias("q"),
        F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0").alias("mm"), F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(7)).cast("int").alias("way"))


_LI = """li AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice::DECIMAL(18,2) AS p, l_quantity::INT AS q, l_partkey % 60 AS m, lpad((l_partkey % 60)::VARCHAR, 2, '0') AS mm, ((l_orderkey + l_linenumber) % 7)::INT AS way FROM lineitem)"""


def _way(*choices) -> Column:
    out = F.lit(None)
    for i, c in reversed(list(enumerate(choices))):
        out = F.when(F.col("way") == i, c).otherwise(out)
    return out


_P = lambda: F.col("p").cast("string")
_cat = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))


@query(f"""WITH {_LI} SELECT k, n, CASE way WHEN 0 THEN p::DOUBLE WHEN 1 THEN -p::DOUBLE WHEN 2 THEN p::DOUBLE WHEN 3 THEN CASE WHEN q >= 24 THEN (q || '.' || mm)::DOUBLE END WHEN 4 THEN -p::DOUBLE WHEN 6 THEN p::DOUBLE END AS price FROM li""")
def prices_of_lines(spark, d):
    t = _way(_cat("$", _P()), _cat(_P(), "-"), F.translate(_P(), ".", ","), _cat(F.col("q").cast("string"), ":", F.col("mm")), _cat("-", _P()), F.lit("xxxxxxxx"), _cat("* ", _P(), " +"))
    return _lines(spark, d).select("k", "n", money.parse_price(t).alias("price"))


@query(f"""WITH {_LI} SELECT k, n, CASE way WHEN 1 THEN -p::DOUBLE WHEN 4 THEN NULL WHEN 5 THEN floor(p)::DOUBLE ELSE p::DOUBLE END AS amount FROM li""")
def amounts_of_lines(spark, d):
    grouped = F.format_number(F.col("p"), 2)
    t = _way(_cat("$", _P()), _cat("(", _P(), ")"), grouped, F.translate(grouped, ",.", ".,"), _cat(F.col("q").cast("string"), ".00%"), F.format_number(F.floor("p"), 0), _cat("CAD ", _P()))
    return _lines(spark, d).select("k", "n", money.normalize_amount(t).alias("amount"))


@query(f"""WITH {_LI} SELECT k, n, CASE way WHEN 3 THEN NULL WHEN 4 THEN -p::DOUBLE WHEN 5 THEN q::DOUBLE ELSE p::DOUBLE END AS money, CASE way WHEN 1 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN -p::DOUBLE WHEN 5 THEN q::DOUBLE ELSE p::DOUBLE END AS number FROM li WHERE way <> 1
UNION ALL SELECT k, n, p::DOUBLE, NULL FROM li WHERE way = 1""")
def numbers_of_answers(spark, d):
    t = _way(_cat("$", F.format_number(F.col("p"), 2)), F.translate(_P(), "0", "O"), _cat(" ", _P(), " "), F.lit("n/a"), _cat("-", _P()), F.col("q").cast("string"), _P())
    number = F.when(F.col("way") != 1, money.parse_number(t))  # letters are no digits there
    return _lines(spark, d).select("k", "n", money.parse_money(t).alias("money"), number.alias("number"))


@query(f"""WITH {_LI} SELECT k, n, CASE WHEN way < 3 THEN p::VARCHAR ELSE '' END AS strict, CASE WHEN way < 3 THEN p::VARCHAR ELSE q || '.' || mm END AS loose FROM li""")
def amounts_in_texts(spark, d):
    qm = _cat(F.col("q").cast("string"), ":", F.col("mm"))
    t = _way(_cat("TOTAL ", _P()), _cat("3.10 and ", _P()), _cat("total ", F.format_number(F.col("p"), 2), " CAD"), _cat("cotal ", qm), _cat("SUBTOTA ", qm), _cat("tax ", qm, " x"), qm)
    return _lines(spark, d).select("k", "n", money.extract_amount(t).alias("strict"), money.extract_amount_loose(t).alias("loose"))


@query(f"""WITH {_LI} SELECT k, n, p::DOUBLE AS last, CASE way WHEN 0 THEN '1.25;' || p ELSE p::VARCHAR END AS all_values FROM li WHERE way < 3""")
def money_in_texts(spark, d):
    t = _way(_cat("a 1.25 b $", _P()), _cat(_P(), " at 13.00%"), _cat("x ", _P(), " 13.00"))
    shown = F.filter(F.transform(money.money_values(t), lambda x: x.cast(MONEY).cast("string")), lambda x: x != "13.00")
    return _lines(spark, d).filter("way < 3").select("k", "n", money.rightmost_amount(t).alias("last"), F.array_join(shown, ";").alias("all_values"))


@query(f"""WITH {_LI} SELECT k, n, CASE way WHEN 1 THEN q || '.' || mm WHEN 3 THEN CASE WHEN q > 23 THEN q || '.' || mm ELSE q || ':' || mm END ELSE p::VARCHAR END AS word, CASE way WHEN 0 THEN 'CA$' WHEN 2 THEN '€' END AS currency FROM li""")
def words_of_prices(spark, d):
    whole = F.col("p") < 1000000
    t = _way(_cat("CA$ ", _P()), _cat(":", F.col("q").cast("string"), ".", F.col("mm"), "*"), _cat("€", F.translate(_P(), ".", ",")), _cat(F.col("q").cast("string"), ":", F.col("mm")), _cat(_P(), "A"), _cat(_P(), "."), _cat("<", _P(), ">"))
    return _lines(spark, d).filter(whole).select("k", "n", money.normalize_word(t).alias("word"), money.split_currency(t)["currency"].alias("currency"))


@query(f"""WITH {_LI} SELECT k, n, p::DOUBLE AS prefix, translate(format('{{:,.2f}}', p::DOUBLE), ',', ' ') AS shown, p::DOUBLE AS again FROM li""")
def price_formats(spark, d):
    t = _way(_cat("$", _P()), _cat(_P(), "--"), F.translate(_P(), ".", ":"), _P(), _cat(_P(), " EA"), _cat(_P(), "kg"), _cat(" ", _P()))
    shown = money.format_thousands(F.col("p"))
    return _lines(spark, d).select("k", "n", money.price_prefix(t).alias("prefix"), shown.alias("shown"), money.parse_thousands(shown).alias("again"))


@query("""SELECT c_custkey AS k, ['USD', 'BRL', 'EUR', 'GBP', 'CAD', 'CAD', 'USD', 'INR'][(c_custkey % 8 + 1)::INT] AS code, [NULL, 'R$', '€', NULL, NULL, '$', '$', '₹'][(c_custkey % 8 + 1)::INT] AS mark FROM customer""")
def currencies(spark, d):
    k = F.col("c_custkey")
    t = F.get(F.array(*map(F.lit, ["us", "R$", "€", "gbp", "??", "$", "$USD", "₹"])), (k % 8).cast("int"))
    t = F.when(k % 8 == 0, "USD").otherwise(t)
    return adapters.read(spark, d, "customer").select(k.alias("k"), money.normalize_currency(t).alias("code"), money.detect_currency(t).alias("mark"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 5 THEN 'on ' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, strftime(o_orderdate, '%b') AS month FROM orders""")
def dates(spark, d):
    o, k = adapters.read(spark, d, "orders"), F.col("o_orderkey") % 6
    day = F.col("o_orderdate")
    t = F.when(k == 0, F.date_format(day, "yyyy/M/d")).when(k == 1, F.date_format(day, "M-d-yyyy")).when(k == 2, F.date_format(day, "MMM d, yyyy")).when(k == 3, F.date_format(day, "d MMMM yyyy")).when(k == 4, F.date_format(day, " yyyy.MM.dd ")).otherwise(F.date_format(day, "'on' yyyy"))
    return o.select(F.col("o_orderkey").alias("k"), money.normalize_date(t).alias("date"), money.month_label(F.date_format(day, "yyyy-MM")).alias("month"))


@query("""WITH c AS (SELECT c_custkey AS k, lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 10, '4') AS t FROM customer) SELECT k, CASE k % 4 WHEN 3 THEN '55-' || k ELSE substr(t, 1, 3) || '-' || substr(t, 4, 3) || '-' || substr(t, 7) END AS phone,
CASE WHEN k % 4 = 0 THEN substr(t, 1, 3) || '-' || substr(t, 4, 3) || '-' || substr(t, 7) ELSE '' END AS near FROM c""")
def phones(spark, d):
    k = F.col("c_custkey")
    t = F.lpad((k * 7919 % 10000000000).cast("string"), 10, "4")
    part = lambda a, n: F.substring(t, a, n)
    dashed = F.concat_ws("-", part(1, 3), part(4, 3), part(7, 4))
    raw = F.when(k % 4 == 0, t).when(k % 4 == 1, _cat("1 (", part(1, 3), ") ", part(4, 3), "-", part(7, 4))).when(k % 4 == 2, F.concat_ws(".", part(1, 3), part(4, 3), part(7, 4))).otherwise(_cat("55-", k.cast("string")))
    words = F.when(k % 4 == 0, F.array(F.lit("Telephone:"), F.lit("no"), dashed)).otherwise(F.array(F.lit("no"), F.lit("number")))
    return adapters.read(spark, d, "customer").select(k.alias("k"), money.normalize_phone(raw).alias("phone"), text.phone_near(words).alias("near"))


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size <= 1 THEN 100.0 ELSE least(100, p_size * 3)::DOUBLE END AS or_null, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size * 3 > 1 THEN least(1, p_size * 3 / 100.0)::DOUBLE END AS share, CASE WHEN p_size % 5 = 0 THEN 7.5 ELSE p_size * 3.0 END::DOUBLE AS safe FROM part WHERE p_size > 1""")
def confidences(spark, d):
    t = F.when(F.col("p_size") % 5 == 0, "none").otherwise((F.col("p_size") * 3).cast("string"))
    return adapters.read(spark, d, "part").filter("p_size > 1").select(F.col("p_partkey").alias("k"), money.confidence_or_null(t).alias("or_null"), money.confidence_01(t).alias("share"), money.safe_float(t, 7.5).alias("safe"))


@query(f"""WITH {_LI}, b AS (SELECT k, n, q * 13 AS x, m * 11 AS y, q * 13 + way * 40 AS x2, m * 11 + 25 AS y2 FROM li) SELECT k, n, least(1000, floor(x * 1000 / 900.0))::INT AS left_edge, least(1000, floor(y * 1000 / 700.0))::INT AS top, least(1000, floor(x2 * 1000 / 900.0))::INT AS right_edge, least(1000, floor(y2 * 1000 / 700.0))::INT AS bottom FROM b""")
def boxes_on_page(spark, d):
    x, y = F.col("q") * 13, F.col("mm").cast("int") * 11
    quad = F.array(F.array(x, y), F.array(x + F.col("way") * 40, y + 5), F.array(x + F.col("way") * 40, y + 25), F.array(x, y + 20))
    box = money.quad_to_box(quad)
    scaled = F.get(money.to_page(F.array(box), F.lit(900), F.lit(700)), F.lit(0))
    return _lines(spark, d).select("k", "n", *(F.get(scaled, F.lit(i)).alias(c) for i, c in enumerate(("left_edge", "top", "right_edge", "bottom"))))


@query(f"""WITH {_LI}, a AS (SELECT k, degrees(atan2(m - 20, q)) AS a FROM li) SELECT k, round(median(a) FILTER (abs(a) <= 30), 6) AS skew FROM a GROUP BY k""")
def page_skew(spark, d):
    quad = F.array(F.array(F.lit(0), F.lit(20)), F.array(F.col("q"), F.col("mm").cast("int")))
    return _lines(spark, d).groupBy("k").agg(F.round(F.median(money.edge_angle(quad)), 6).alias("skew"))


_WORDS = ("SUBTOTAL", "TOTAL", "TAX", "CHANGE", "BLUE", "STEEL")


@query(f"""WITH w AS (SELECT p_partkey AS k, upper(split_part(p_name, ' ', 1)) AS u FROM part), c AS (SELECT k, u, i, [{', '.join(f"'{w}'" for w in _WORDS)}][i] AS kw FROM w, range(1, {len(_WORDS) + 1}) t(i)),
b AS (SELECT k, min(i) FILTER (contains(u, kw)) AS exact, arg_min(kw, levenshtein(u, kw) * 100 + i) AS near, min(levenshtein(u, kw)) AS far FROM c GROUP BY 1)
SELECT k, CASE WHEN exact IS NOT NULL THEN [{', '.join(f"'{w}'" for w in _WORDS)}][exact] WHEN far <= 2 THEN near END AS keyword, CASE WHEN exact IS NOT NULL THEN 0 WHEN far <= 2 THEN far END::INT AS distance FROM b""")
def nearest_keywords(spark, d):
    hit = text.best_keyword(F.split("p_name", " ")[0], list(_WORDS))
    return adapters.read(spark, d, "part").select(F.col("p_partkey").alias("k"), hit["keyword"].alias("keyword"), hit["distance"].alias("distance"))


@query("""SELECT p_partkey AS k, regexp_replace(lower(p_name), '[^a-z0-9 ]+', '', 'g') AS key, upper(substr(p_name, 1, 1)) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) AS initials, round(length(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) / length(p_name), 6) AS alpha,
lower(p_name) LIKE '%total%' AS total_words FROM part""")
def part_names(spark, d):
    messy = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" "))
    return adapters.read(spark, d, "part").select(
        F.col("p_partkey").alias("k"), text.name_key(messy).alias("key"), text.initials(messy).alias("initials"), F.round(text.alpha_ratio(F.col("p_name")), 6).alias("alpha"), F.lower("p_name").contains("total").alias("total_words"))


@query(f"""WITH {_LI} SELECT k, n, CASE way WHEN 0 THEN q < 24 WHEN 1 THEN q < 24 WHEN 2 THEN TRUE ELSE FALSE END AS is_time FROM li""")
def times_of_day(spark, d):
    t = _way(_cat(F.col("q").cast("string"), ":", F.col("mm")), _cat(F.col("q").cast("string"), ":", F.col("mm"), ":00 pm"), _cat("9:", F.col("mm"), "AM"), _P(), _cat("7:", F.col("mm"), "9"), F.lit("noon"), F.lit("12-30"))
    return _lines(spark, d).select("k", "n", text.is_time(t).alias("is_time"))


@query(f"""WITH {_LI} SELECT k, n, CASE WHEN way IN (0, 1) THEN p::VARCHAR ELSE '' END AS total, way IN (0, 1, 2) AS has_total, way IN (0, 1) AS total_amount, CASE way WHEN 2 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS amounts FROM li WHERE way < 5""")
def totals_in_texts(spark, d):
    t = _way(_cat("x total due ", _P()), _cat("Total  ", _P()), F.lit("TOTAL none"), _cat("sum ", _P()), _cat(_P(), " ", _P()))
    s = text.quality_signals(t)
    return _lines(spark, d).filter("way < 5").select("k", "n", text.total_fallback(t).alias("total"), s["has_total"].alias("has_total"), s["total_amount"].alias("total_amount"), s["amounts"].alias("amounts"))


_DOCS = """ln AS (SELECT doc_id, trim(ls[i]) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(i))"""
_BROKEN = "|".join(f"(?:{p})" for p in text.BROKEN)


@query("WITH " + _DOCS + ", l2 AS (SELECT doc_id, count(*) FILTER (line <> '') AS n, count(*) FILTER (line <> '' AND regexp_matches(line, '" + _BROKEN.replace("'", "''") + "')) AS bad FROM ln GROUP BY 1) SELECT doc_id, round(CASE WHEN n = 0 THEN 1 ELSE bad / n END, 9) AS broken FROM l2")
def broken_lines(spark, d):
    return adapters.read(spark, d, "documents").select("doc_id", F.round(text.broken_score(F.col("text")), 9).alias("broken"))


@query("WITH " + _DOCS + r""", s AS (SELECT doc_id, CASE WHEN regexp_matches(line, '(?i)total|tax|gst|hst|pst|visa|cash|change|date|tel|phone') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(line, '\d+\.\d{2}') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(line, '[A-Za-z]') THEN 1 ELSE 0 END
+ CASE WHEN regexp_matches(line, '\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(line, '\d{3}[-.\s]?\d{3}[-.\s]?\d{4}') THEN 2 ELSE 0 END AS score FROM ln WHERE line <> '') SELECT doc_id, sum(score)::BIGINT AS points, count(*) AS lines FROM s GROUP BY 1""")
def line_points(spark, d):
    lines = adapters.text_lines(spark, d)
    return lines.groupBy(F.col("receipt_id").alias("doc_id")).agg(F.sum(text.line_score(F.col("line"))).alias("points"), F.count("*").alias("lines"))


@query(r"""WITH ln AS (SELECT doc_id AS receipt_id, i - 1 AS pos, trim(ls[i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(i)),
u AS (SELECT receipt_id, min(pos) AS pos, line FROM ln WHERE line <> '' GROUP BY receipt_id, line), s AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)total|tax|gst|hst|pst|visa|cash|change|date|tel|phone') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(line, '\d+\.\d{2}') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(line, '[A-Za-z]') THEN 1 ELSE 0 END
+ CASE WHEN regexp_matches(line, '\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(line, '\d{3}[-.\s]?\d{3}[-.\s]?\d{4}') THEN 2 ELSE 0 END AS score FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY score DESC, pos) AS rank FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY CASE WHEN rank <= 25 THEN 0 ELSE 1 END, CASE WHEN rank <= 25 THEN rank ELSE pos END) AS k FROM r)
SELECT receipt_id, substr(string_agg(line, chr(10) ORDER BY k), 1, 3500) AS text FROM o WHERE k <= 80 GROUP BY receipt_id""")
def compress_by_score(spark, d):
    return tables.compress_lines(adapters.text_lines(spark, d), text.line_score(F.col("line")))


@query("""WITH j AS (SELECT o_orderkey AS k, o_totalprice::DECIMAL(18,2) AS p, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 5 AS w FROM orders)
SELECT k, CASE WHEN w < 4 THEN 'Shop ' || k END AS vendor, CASE WHEN w < 4 THEN p::DOUBLE END AS total, CASE WHEN w < 3 THEN day END AS date, CASE WHEN w < 4 THEN CASE WHEN w = 3 THEN 0 ELSE 2 END END AS n_items, CASE WHEN w < 4 THEN CASE w WHEN 0 THEN 85.0 WHEN 1 THEN 74.0 WHEN 2 THEN 90.0 ELSE 65.0 END END::DOUBLE AS confidence, CASE WHEN w < 4 THEN CASE WHEN w = 1 THEN 'USD' ELSE 'CAD' END END AS currency, CASE WHEN w IN (0, 1, 2) THEN 2.5 END::DOUBLE AS second_price FROM j""")
def model_answers(spark, d):
    """Answers with a fence, bare, in prose, without items, and without JSON."""
    k, w = F.col("o_orderkey"), F.col("o_orderkey") % 5
    p, day = F.col("o_totalprice").cast(MONEY), F.date_format("o_orderdate", "yyyy-MM-dd")
    items = '"items": [{"name": " TEA ", "price": "$1.00"}, {"item_name": "null", "line_total": 2.5, "confidence": 0.5}]'
    head = lambda *more: _cat('{"vendor": " Shop  ', k.cast("string"), '", "total": "', F.format_number(p, 2), '"', *more)
    t = (
        F.when(w == 0, _cat("```json\n", head(', "date": "', day, '", "confidence": 0.85, ', items, "}"), "\n```")).when(w == 1, head(', "receipt_date": "', F.date_format("o_orderdate", "M/d/yyyy"), '", "currency": "$USD", ', items, "}"))
        .when(w == 2, _cat("Here it is: ", head(', "date": "', day, '", "confidence": 90, ', items, "}"), " - done")).when(w == 3, head("}")).otherwise("I could not read it")
    )
    r = llm_json.receipt(t)
    return adapters.read(spark, d, "orders").select(k.alias("k"), r["vendor"].alias("vendor"), r["total"].alias("total"), r["date"].alias("date"), F.when(r.isNotNull(), F.size(r["items"])).alias("n_items"), r["confidence"].alias("confidence"), r["currency"].alias("currency"), F.get(r["items"], F.lit(1))["price"].alias("second_price"))


@query("""SELECT o_orderkey AS k, '/images/IMG_' || o_orderkey || '.png' AS url, CASE o_orderkey % 3 WHEN 0 THEN 'processed/a/IMG_' || o_orderkey || '_best_view.png' WHEN 1 THEN 'best_images/IMG_' || o_orderkey || '_view.png' ELSE '/tmp/IMG_' || o_orderkey || '.png' END AS path FROM orders""")
def image_paths(spark, d):
    k = F.col("o_orderkey")
    name = _cat("IMG_", k.cast("string"))
    p = F.when(k % 3 == 0, _cat("C:\\data\\processed\\a\\", name, "_best_view.png")).when(k % 3 == 1, _cat("/srv/best_images/", name, "_view.png")).otherwise(_cat("/tmp/", name, ".png"))
    return adapters.read(spark, d, "orders").select(k.alias("k"), ocr.image_url(p).alias("url"), ocr.relative_path(p).alias("path"))




# summaries, uploads, batches

@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 3 AS w, (o_orderkey % 600 + 50.37)::DECIMAL(18,2) AS s FROM orders), v AS (SELECT *, round(s * 0.13, 2)::DECIMAL(18,2) AS t, round(s * 0.2, 2)::DECIMAL(18,2) AS g FROM r)
SELECT k AS receipt_id, s::DOUBLE AS subtotal, t::DOUBLE AS tax, CASE WHEN w = 2 THEN s + t + g ELSE s + t END::DOUBLE AS total, CASE WHEN w = 2 THEN s + t ELSE s END::DOUBLE AS pre_total, CASE WHEN w = 2 THEN g ELSE t END::DOUBLE AS gratuity FROM v""")
def fuzzy_summaries(spark, d):
    """Plain, reversed and tipped summaries. Without a tip the tax is taken for one: its rest is the subtotal."""
    k = F.col("o_orderkey")
    r = adapters.read(spark, d, "orders").select(k.alias("receipt_id"), (k % 3).alias("w"), (k % 600 + F.lit("50.37").cast(MONEY)).cast(MONEY).alias("s"))
    r = r.withColumns({"t": F.round(F.col("s") * F.lit("0.13").cast("decimal(4,2)"), 2).cast(MONEY), "g": F.round(F.col("s") * F.lit("0.2").cast("decimal(4,2)"), 2).cast(MONEY)})
    n = lambda c: F.col(c).cast("string")
    both, due = (F.col("s") + F.col("t")).cast(MONEY).cast("string"), (F.col("s") + F.col("t") + F.col("g")).cast(MONEY).cast("string")
    lines = F.when(F.col("w") == 0, _cat("SHOP\n12:30PM\nSubtotal $", n("s"), "\nGST 5%\nHST ", n("t"), "\nTotal ", both)).when(F.col("w") == 1, _cat("Soda ", n("s"), "\nSubtotal ", n("t"), "\nGrand Total ", both))
    lines = lines.otherwise(_cat("Subtotal ", n("s"), "\nHST ", n("t"), "\nTotal ", both, "\nGratuity ", n("g"), "\nTotal due ", due))
    return summary.fuzzy(r.select("receipt_id", lines.alias("text"))).select("receipt_id", "subtotal", "tax", F.round("total", 2).alias("total"), "pre_total", "gratuity")


@query("""WITH w AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN ['CANADA', 'UNIVERSAL'] WHEN 1 THEN ['USA', 'UNIVERSAL'] WHEN 2 THEN ['EU', 'UNIVERSAL'] ELSE ['UNIVERSAL'] END AS r FROM customer)
SELECT k, array_to_string(r, ',') AS regions, CASE k % 4 WHEN 1 THEN 'SALES TAX,TAX,STATE TAX' WHEN 0 THEN 'GST,HST,PST' WHEN 2 THEN 'VAT,TVA,MWST' ELSE 'TAX,VAT,GST' END AS first_words, CASE k % 4 WHEN 1 THEN 29 ELSE 27 END::INT AS n FROM w""")
def tax_words_of_regions(spark, d):
    k = F.col("c_custkey")
    t = F.when(k % 4 == 0, "gst 1.00").when(k % 4 == 1, "$5").when(k % 4 == 2, "mwst").otherwise("nothing")
    r, words = text.regions(t), summary.tax_words(text.regions(t))
    return adapters.read(spark, d, "customer").select(k.alias("k"), F.array_join(r, ",").alias("regions"), F.array_join(F.slice(words, 1, 3), ",").alias("first_words"), F.size(words).alias("n"))


@query(f"""WITH {_LI} SELECT k, (list(q ORDER BY n, q) FILTER (q > 10))[1] AS subtotal FROM li GROUP BY k""")
def span_subtotals(spark, d):
    """The first quantity above ten among the tokens of a receipt's summary span."""
    one = _lines(spark, d).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "q"))), lambda x: x["q"].cast("string")).alias("q"))
    span = lambda kind, said: F.struct(F.lit(kind).alias("type"), F.lit(said).alias("text"), F.concat(F.array(F.lit("x")), "q").alias("tokens"))
    spans = F.array(span("ITEM_LINE", "subtotal"), span("SUMMARY_LINE", "tax"), span("SUMMARY_LINE", "Subtotal"))
    return one.select("k", summary.subtotal_of_spans(spans).cast("int").alias("subtotal"))


@query("""SELECT p_partkey AS k, 'RSCAN-' || lpad(p_partkey::VARCHAR, greatest(6, len(p_partkey::VARCHAR))::INT, '0') || CASE p_partkey % 3 WHEN 0 THEN '.png' ELSE '.jpg' END AS name, p_size * 70 >= 1600 OR p_size * 70 >= 2.6 * 900 AS is_long,
1 + greatest(0, ceil((p_size * 70 - 1200) / 1000.0))::INT AS n_tiles, greatest(0, ceil((p_size * 70 - 1200) / 1000.0))::INT * 1000 AS last_top, p_size * 70 AS last_bottom, 400 AS first_size, 340 AS second_size FROM part""")
def uploads_and_tiles(spark, d):
    k, h = F.col("p_partkey"), F.col("p_size") * 70
    cut = intake.tiles(h)
    sizes = intake.shrinking(F.lit(400))
    return adapters.read(spark, d, "part").select(
        k.alias("k"), intake.upload_name(k, F.when(k % 3 == 0, "a/b.PNG").when(k % 3 == 1, "x.gif").otherwise("y")).alias("name"), intake.is_long(h, F.lit(900)).alias("is_long"),
        F.size(cut).alias("n_tiles"), F.element_at(cut, -1)["top"].cast("int").alias("last_top"), F.element_at(cut, -1)["bottom"].alias("last_bottom"), F.get(sizes, F.lit(0)).alias("first_size"), F.get(sizes, F.lit(1)).alias("second_size"))


def _ocr_docs(spark, d) -> DataFrame:
    """OCR documents: an order's lines as words; some without boxes, some with one too few."""
    li = _lines(spark, d).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "p", "q"))).alias("x"))
    words = F.transform("x", lambda x: x["p"].cast("string"))
    boxes = F.transform("x", lambda x, i: F.array(x["q"], i * 20, x["q"] + 100, i * 20 + 15))
    broken = F.when(F.col("k") % 10 == 1, F.lit(None)).when(F.col("k") % 10 == 2, F.slice(boxes, 2, 100)).otherwise(boxes)
    return li.select(
        F.col("k").cast("string").alias("id"), _cat("/scan/", F.col("k").cast("string"), ".json").alias("path"), _cat("/img/", F.col("k").cast("string"), ".png").alias("image_path"), F.array(F.lit(900), (F.col("k") % 3000).cast("int")).alias("image_size"),
        words.alias("words"), broken.alias("bboxes"), F.transform("x", lambda x, i: i).alias("row_ids"), F.lit(None).cast("array<string>").alias("zones"), F.transform("x", lambda x: x["q"] / 100.0).alias("token_confs"))


@query(f"""WITH {_LI}, g AS (SELECT k, count(*) AS n FROM li GROUP BY 1), e AS (SELECT k, n, CASE k % 10 WHEN 1 THEN 'missing words or boxes' WHEN 2 THEN 'words and boxes differ in length' END AS error FROM g)
SELECT '/scan/' || k || '.json' AS path, error, CASE WHEN error IS NULL THEN n ELSE 0 END::INT AS num_tokens FROM e""")
def ocr_batch_results(spark, d):
    return intake.batch(_ocr_docs(spark, d))[1]


@query(f"""WITH {_LI}, g AS (SELECT k, count(*) AS n FROM li GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (k % 10 NOT IN (1, 2)) AS ok, count(*) FILTER (k % 10 IN (1, 2)) AS failed, coalesce(sum(n) FILTER (k % 10 NOT IN (1, 2)), 0)::BIGINT AS tokens FROM g""")
def ocr_batch_summary(spark, d):
    return intake.batch(_ocr_docs(spark, d))[2]


@query(f"""WITH {_LI} SELECT k::VARCHAR AS source_id, row_number() OVER (PARTITION BY k ORDER BY n, p, q)::INT - 1 AS idx, p::VARCHAR AS word, (q / 100.0)::DOUBLE AS conf, q AS x1 FROM li WHERE k % 10 NOT IN (1, 2)""")
def ocr_tokens(spark, d):
    return intake.batch(_ocr_docs(spark, d))[0].select("source_id", "idx", "word", "conf", "x1")


@query(f"""WITH {_LI} SELECT k::VARCHAR AS source_id, k || '.png' AS image, (k % 3000)::INT AS height, k % 3000 >= 1600 AS is_long, count(*)::INT AS num_tokens, round(avg(q / 100.0), 6) AS mean_conf FROM li WHERE k % 10 NOT IN (1, 2) GROUP BY k""")
def ocr_summaries(spark, d):
    from ..sources import ocr as source

    good, _ = source.check(_ocr_docs(spark, d))
    out = intake.ocr_summary(good)
    return out.select("source_id", "image", "height", "is_long", "num_tokens", F.round("mean_conf", 6).alias("mean_conf"))


@query(f"""WITH {_LI} SELECT k AS receipt_id, row_number() OVER (PARTITION BY k ORDER BY n, p, q)::INT AS line_no, CASE q % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'Unknown' END AS item_name, CASE q % 3 WHEN 0 THEN p WHEN 1 THEN q ELSE 0 END::DOUBLE AS price, CASE WHEN q % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS price_confidence FROM li""")
def answer_items(spark, d):
    q3 = lambda x: x["q"] % 3
    items = F.transform(F.array_sort(F.collect_list(F.struct("n", "p", "q"))), lambda x: F.struct(
        F.when(q3(x) == 0, " a ").alias("name"), F.when(q3(x) == 1, "b").alias("item_name"), F.when(q3(x) == 0, x["p"].cast("double")).alias("price"), F.when(q3(x) == 1, x["q"].cast("double")).alias("line_price"), F.when(x["q"] % 2 == 0, 0.5).alias("confidence")))
    a = _lines(spark, d).groupBy(F.col("k").alias("receipt_id")).agg(items.alias("items"))
    return intake.items_of_answer(a).select("receipt_id", "line_no", "item_name", "price", "price_confidence")
