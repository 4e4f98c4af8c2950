"""Per-receipt validation of items: statistics, outliers, names, ranges, flags, arithmetic.

Items have receipt_id, line_no, item_name, price; everything is grouped by receipt_id, and the
windows of one receipt share one exchange. Bounds are compared exactly as given (strict or not).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Bounds of the checks; the defaults are those of receipts in dollars."""

    problem_sd: float = 2.0
    high_sd: float = 3.0
    outlier_sd: float = 2.5
    fence: float = 1.5
    low_price: float = 0.50
    high_price: float = 500.0
    special_price: float = 100.0
    special_word: str = "THHCFRENCH"
    pass_pct: float = 1.0
    warn_pct: float = 5.0
    digit_ratio: float = 0.4
    shortest: int = 3
    longest: int = 40
    least_conf: float = 0.65


#: Substrings, in lower case, that count as signs of misread characters.
ARTIFACTS = ("0o", "1l", "5s", "8b", "rn")


def _each() -> Window:
    return Window.partitionBy("receipt_id")


def price_stats(items: DataFrame) -> DataFrame:
    """mean, sd (0 for one price), median and positional quartiles of the positive prices."""
    p = F.when(F.col("price") > 0, F.col("price").cast("double"))
    got = items.groupBy("receipt_id").agg(
        F.count(p).alias("n"), F.avg(p).alias("mean"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("sd"), F.median(p).alias("median"),
        F.sort_array(F.collect_list(p)).alias("sorted"),
    )
    at = lambda num: F.get("sorted", F.floor(F.col("n") * num / 4).cast("int"))
    return got.select("receipt_id", "n", "mean", "sd", "median", at(1).alias("q1"), at(3).alias("q3"))


def problematic_items(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Positive prices more than two deviations from their receipt's mean."""
    w, p = _each(), F.col("price").cast("double")
    z = (p - F.col("mean")) / F.col("sd")
    rated = items.filter("price > 0").withColumns({"mean": F.avg(p).over(w), "sd": F.coalesce(F.stddev_samp(p).over(w), F.lit(0.0))})
    return rated.filter((F.col("sd") > 0) & (F.abs(p - F.col("mean")) > rules.problem_sd * F.col("sd"))).select(
        "receipt_id", "line_no", "item_name", "price", F.when(F.abs(z) > rules.high_sd, "HIGH").otherwise("MEDIUM").alias("likelihood")
    )


def price_outliers(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Positive prices far from the mean or outside the quartile fences, in receipts with three or more."""
    s, p = price_stats(items).filter("n >= 3"), F.col("price").cast("double")
    span = F.col("q3") - F.col("q1")
    z = F.when(F.col("sd") > 0, (p - F.col("mean")) / F.col("sd")).otherwise(F.lit(0.0))
    beyond = (p < F.col("q1") - rules.fence * span) | (p > F.col("q3") + rules.fence * span)
    text = lambda sign: F.concat(F.lit("Z-score "), F.format_string("%.1f", "z"), F.lit(f" ({sign} mean "), F.format_string("%.2f", "mean"), F.lit(")"))
    reason = F.when(F.col("z") > rules.outlier_sd, text(">>")).when(F.col("z") < -rules.outlier_sd, text("<<")).otherwise("Beyond IQR bounds")
    rated = items.filter("price > 0").join(s, "receipt_id").withColumns({"z": z, "is_outlier_iqr": beyond})
    return rated.filter(F.col("is_outlier_iqr") | (F.abs("z") > rules.outlier_sd)).withColumn("reason", reason)


def outlier_status(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """INSUFFICIENT_DATA, OUTLIERS_FOUND or OK for each receipt."""
    found = price_outliers(items, rules).groupBy("receipt_id").agg(F.count("*").alias("outliers"))
    status = F.when(F.col("n") < 3, "INSUFFICIENT_DATA").when(F.col("outliers") > 0, "OUTLIERS_FOUND").otherwise("OK")
    return price_stats(items).join(found, "receipt_id", "left").select("receipt_id", "n", F.coalesce("outliers", F.lit(0)).alias("outliers"), status.alias("status"))


def subtotal_check(receipts: DataFrame, items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Sum of positive prices against the receipt's subtotal: PASS, WARNING, FAIL, or SKIPPED without one."""
    sums = items.filter("price > 0").groupBy("receipt_id").agg(F.sum("price").alias("items_total"))
    return _checked(receipts.select("receipt_id", "subtotal").join(sums, "receipt_id", "left"), rules)


def _checked(got: DataFrame, rules: Rules, *more: str) -> DataFrame:
    got = got.withColumn("items_total", F.coalesce("items_total", F.lit(0)).cast("decimal(28,2)"))
    gap = F.col("items_total") - F.col("subtotal")
    # of a subtotal of 0 the percentage is 0; compared without division, so exactly
    within = lambda pct: (F.col("subtotal") == 0) | (F.abs(gap) * 100 < F.abs("subtotal") * F.lit(pct).cast("decimal(6,2)"))
    status = F.when(F.col("subtotal").isNull(), "SKIPPED").when(within(rules.pass_pct), "PASS").when(within(rules.warn_pct), "WARNING").otherwise("FAIL")
    return got.select("receipt_id", "subtotal", "items_total", F.when(F.col("subtotal").isNotNull(), gap).cast("decimal(28,2)").alias("discrepancy"), status.alias("subtotal_status"), *more)


def subtotal_message(status: Column, gap: Column, pct: Column) -> Column:
    """What a person reads of a subtotal check; null where it was skipped. The wording."""
    gap, pct = gap.cast("double"), pct.cast("double")
    return (
        F.when(status == "PASS", F.format_string("✓ Subtotal matches (discrepancy: %.2f%%)", pct))
        .when(status == "WARNING", F.format_string("⚠ Slight discrepancy: $%+.2f (%+.2f%%)", gap, pct))
        .when(status == "FAIL", F.format_string("✗ Large discrepancy: $%+.2f (%+.2f%%) — likely OCR/labeling errors", gap, pct)))


def discrepancy_pct(gap: Column, subtotal: Column) -> Column:
    """The gap in percent of the subtotal; 0 for a subtotal of 0."""
    return F.when(subtotal == 0, F.lit(0.0)).otherwise(gap.cast("double") / subtotal.cast("double") * 100)


def has_artifact(name: Column) -> Column:
    out = F.lit(False)
    for a in ARTIFACTS:
        out = out | F.lower(name).contains(a)
    return out


def _name_issues(items: DataFrame, rules: Rules) -> dict[str, Column]:
    name = F.coalesce("item_name", F.lit(""))
    conf = F.coalesce(F.expr("try_cast(conf_mean as double)"), F.lit(1.0)) if "conf_mean" in items.columns else F.lit(1.0)
    digits = F.length(F.regexp_replace(name, r"\P{Nd}", ""))
    ratio = F.when(F.length(name) > 0, digits / F.length(name)).otherwise(F.lit(0.0))
    return {
        "artifact": has_artifact(name), "digit_heavy": ratio > rules.digit_ratio, "too_short": F.length(name) < rules.shortest,
        "too_long": F.length(name) > rules.longest, "low_conf": conf < rules.least_conf,
    }


def _name_issue(items: DataFrame, rules: Rules) -> Column:
    out = F.lit(False)
    for c in _name_issues(items, rules).values():
        out = out | c
    return out


def name_quality(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Items with issues of their name: misread characters, digits, length, confidence (null is 1)."""
    return items.withColumns(_name_issues(items, rules)).filter("artifact or digit_heavy or too_short or too_long or low_conf")


def name_reports(items: DataFrame, rules: Rules = Rules(), most: int = 10) -> DataFrame:
    """Per receipt: status, the number of items with issues of their name, and the first ``most`` of them
    (item_name, price, conf, issues). Fixed values: the wording of the issues."""
    name = F.coalesce("item_name", F.lit(""))
    conf = F.coalesce(F.expr("try_cast(conf_mean as double)"), F.lit(1.0)) if "conf_mean" in items.columns else F.lit(1.0)
    ratio = F.when(F.length(name) > 0, F.length(F.regexp_replace(name, r"\P{Nd}", "")) / F.length(name)).otherwise(F.lit(0.0))
    rated = items.withColumns({k: c for k, c in _name_issues(items, rules).items()})
    said = F.array_compact(F.array(
        F.when(F.col("artifact"), "OCR artifacts (0/O, 1/I, 5/S confusion)"), F.when(F.col("digit_heavy"), F.format_string("High digit ratio (%.1f%%) — likely SKU/barcode mixed", ratio * 100)),
        F.when(F.col("too_short"), "Name too short — likely SKU only").when(F.col("too_long"), "Name too long — likely multiple items merged"), F.when(F.col("low_conf"), F.format_string("Low confidence (%.2f)", conf))))
    one = F.struct("line_no", name.alias("item_name"), F.col("price"), conf.alias("conf"), F.col("said").alias("issues"))
    got = rated.withColumn("said", said).groupBy("receipt_id").agg(F.count(F.when(F.size("said") > 0, 1)).alias("num_issues"), F.array_sort(F.collect_list(F.when(F.size("said") > 0, one))).alias("all"))
    return got.select("receipt_id", F.when(F.col("num_issues") > 0, "ISSUES_FOUND").otherwise("OK").alias("status"), "num_issues", F.transform(F.slice("all", 1, most), lambda x: x.dropFields("line_no")).alias("issues"))


def _range_reason(rules: Rules) -> Column:
    p, shown = F.col("price"), F.format_string("$%.2f", F.col("price").cast("double"))
    return (
        F.when(p <= 0, "Price <= 0 (likely OCR error)").when(p < rules.low_price, F.concat(F.lit("Very low price: "), shown))
        .when(p > rules.high_price, F.concat(F.lit("Suspiciously high: "), shown))
        .when((p > rules.special_price) & F.upper("item_name").contains(rules.special_word), F.concat(F.lit("Item '"), "item_name", F.lit("' too expensive: "), shown))
    )


def _out_of_range(rules: Rules) -> Column:
    """Whether ``_range_reason`` names one, without its text."""
    p = F.col("price")
    return (p <= 0) | (p < rules.low_price) | (p > rules.high_price) | ((p > rules.special_price) & F.upper("item_name").contains(rules.special_word))


def price_ranges(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Suspicious prices; the first rule that holds names the reason. Null prices pass."""
    return items.withColumn("reason", _range_reason(rules)).filter("reason is not null")


def label_sequence(items: DataFrame) -> DataFrame:
    """Items whose first token is neither an article number nor like a name. ``tokens`` is an array."""
    first = F.get("tokens", F.lit(0))
    number = first.rlike(r"^\p{Nd}+$")
    fine = (number & (F.length(first) >= 6)) | (~number & (F.length(first) >= 2))
    return items.filter(F.size("tokens") > 0).withColumn("first_token", first).filter(~fine)


def _rated(items: DataFrame, rules: Rules) -> tuple[DataFrame, Column, Column]:
    """Items with the statistics of their receipt, by windows over one exchange; whether an item is an outlier,
    and whether it is problematic."""
    w, p = _each(), F.when(F.col("price") > 0, F.col("price").cast("double"))
    at = lambda k: F.get("sorted", F.floor(F.col("n") * k / 4).cast("int"))
    rated = items.withColumns({"p": p, "n": F.count(p).over(w), "mean": F.avg(p).over(w), "sd": F.coalesce(F.stddev_samp(p).over(w), F.lit(0.0)), "sorted": F.sort_array(F.collect_list(p).over(w))})
    rated = rated.withColumns({"q1": at(1), "q3": at(3)}).drop("sorted")
    span, off = F.col("q3") - F.col("q1"), F.abs(F.col("p") - F.col("mean"))
    far = (F.col("sd") > 0) & (off / F.col("sd") > rules.outlier_sd)
    beyond = (F.col("p") < F.col("q1") - rules.fence * span) | (F.col("p") > F.col("q3") + rules.fence * span)
    outlier = F.coalesce((F.col("n") >= 3) & (far | beyond), F.lit(False))
    return rated, outlier, F.coalesce((F.col("sd") > 0) & (off > rules.problem_sd * F.col("sd")), F.lit(False))


def validate_all(receipts: DataFrame, items: DataFrame, rules: Rules = Rules(), with_items: bool = False) -> DataFrame:
    """A row per receipt: status of each check, counts, and the recommendations in order; with_items also the first three
    problematic items (item_name, price, z_score), the first three outliers (item_name, price) and the outliers' status."""
    rated, outlier, problem = _rated(items, rules)
    z = F.when(F.col("sd") > 0, F.round((F.col("p") - F.col("mean")) / F.col("sd"), 2))
    # each condition is found once; an item that is odd in either way is held once, in one list
    odd = F.struct("line_no", "item_name", "price", z.alias("z_score"), "problem", "outlier")
    of = lambda c, k: F.slice(F.filter("odd", lambda x: x[c]), 1, k)
    pick = lambda c, *cols: F.transform(of(c, 3), lambda x: F.struct(*(x[n].alias(n) for n in ("item_name", "price", *cols))))
    names = lambda c, k: F.transform(of(c, k), lambda x: x["item_name"])
    more = {"problems": pick("problem", "z_score"), "outliers": pick("outlier"), "priced": F.col("priced")} if with_items else {}
    count = lambda c: F.count(F.when(c, 1))
    # one exchange by receipt_id serves the windows and this aggregate
    found = rated.withColumns({"outlier": outlier, "problem": problem}).groupBy("receipt_id").agg(
        count(F.col("outlier")).alias("outliers_count"), count(_name_issue(items, rules)).alias("name_quality_issues"), count(_out_of_range(rules)).alias("price_range_warnings"),
        F.sort_array(F.collect_list(F.when(F.col("problem") | F.col("outlier"), odd))).alias("odd"), F.sum(F.when(F.col("price") > 0, F.col("price"))).alias("items_total"), F.max("n").alias("priced"),
    )
    found = found.select("receipt_id", "outliers_count", "name_quality_issues", "price_range_warnings", names("problem", 3).alias("problem_names"), names("outlier", 2).alias("outlier_names"), "items_total", *(c.alias(k) for k, c in more.items()))
    out = _checked(receipts.select("receipt_id", "subtotal").join(found, "receipt_id", "left"), rules, "outliers_count", "name_quality_issues", "price_range_warnings", "problem_names", "outlier_names", *more)
    if with_items:
        status = F.when(F.coalesce("priced", F.lit(0)) < 3, "INSUFFICIENT_DATA").when(F.coalesce("outliers_count", F.lit(0)) > 0, "OUTLIERS_FOUND").otherwise("OK")
        out = out.withColumn("outliers_status", status).drop("priced")
    out = out.fillna(0, ["outliers_count", "name_quality_issues", "price_range_warnings"])
    listed = lambda c: F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
    # fixed values: the wording of the recommendations
    texts = F.array(
        F.when((F.col("subtotal_status") == "FAIL") & (F.size("problem_names") > 0), F.concat(F.lit("✗ Subtotal mismatch: Review items "), listed("problem_names"), F.lit(" (likely OCR errors or label misalignment)"))),
        F.when(F.col("outliers_count") > 0, F.concat(F.lit("⚠ Price outliers detected: "), listed("outlier_names"), F.lit(". Verify these prices."))),
        F.when(F.col("name_quality_issues") > 0, F.concat(F.lit("⚠ "), F.col("name_quality_issues").cast("string"), F.lit(" items have OCR quality issues. Manual review recommended."))),
        F.when(F.col("price_range_warnings") > 0, F.concat(F.lit("⚠ "), F.col("price_range_warnings").cast("string"), F.lit(" items have suspicious prices."))),
    )
    some = F.filter(texts, lambda x: x.isNotNull())
    clear = F.array(F.lit("✓ All validations passed. Receipt looks good!"))
    return out.withColumn("recommendations", F.when(F.size(some) > 0, some).otherwise(clear)).drop("problem_names", "outlier_names")


def item_flags(items: DataFrame, suspicious: DataFrame) -> DataFrame:
    """flag and flag_reason of each item: missing_price, price_outlier (its name is among the ``suspicious``
    ones (receipt_id, item_name) of its own receipt), clean."""
    names = suspicious.select(F.col("receipt_id").alias("s_receipt"), F.col("item_name").alias("s_name")).filter("s_name is not null").distinct()
    on = (F.col("receipt_id") == F.col("s_receipt")) & (F.coalesce("item_name", F.lit("")) == F.col("s_name"))
    flag = F.when(F.col("price").isNull(), "missing_price").when(F.col("s_name").isNotNull(), "price_outlier").otherwise("clean")
    # fixed values: the wording of the reasons
    reason = (
        F.when(F.col("flag") == "missing_price", "Missing price - not extracted from receipt")
        .when(F.col("flag") == "price_outlier", F.concat(F.lit("Price outlier detected: $"), F.format_string("%.2f", F.col("price").cast("double")))).otherwise("OK - passed validation")
    )
    return items.join(names, on, "left").withColumn("flag", flag).withColumn("flag_reason", reason).drop("s_receipt", "s_name")


def flag_summary(flagged: DataFrame) -> DataFrame:
    """Counts by flag (flags without an item are left out), all items, and the share that is clean."""
    total = flagged.agg(F.count("*").alias("total"), F.count(F.when(F.col("flag") == "clean", 1)).alias("clean"))
    pct = F.concat(F.format_string("%.1f", F.col("clean") * 100 / F.greatest("total", F.lit(1))), F.lit("%"))
    return flagged.groupBy("flag").agg(F.count("*").alias("n")).crossJoin(total).select("flag", "n", "total", pct.alias("clean_pct"))


def structurally_valid(items: DataFrame, least: float = 0.60) -> DataFrame:
    """``issues`` of each item: missing name, missing price, low confidence; valid where there are none."""
    conf = F.col("conf_mean") if "conf_mean" in items.columns else F.lit(None).cast("double")
    issues = F.filter(F.array(
        F.when(F.trim(F.coalesce("item_name", F.lit(""))) == "", "missing_name"), F.when(F.col("price").isNull(), "missing_price"), F.when(conf < least, "low_confidence"),
    ), lambda x: x.isNotNull())
    return items.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def confidence_split(items: DataFrame, least: float = 0.70) -> DataFrame:
    """tier ``high`` where name and price confidence (null is 0) reach ``least``, else ``low`` with a reason."""
    n, p = (F.coalesce(c, F.lit(0.0)) for c in ("name_confidence", "price_confidence"))
    reason = F.format_string(f"name_conf=%.2f, price_conf=%.2f (<{least:.2f})", n, p)
    high = (n >= least) & (p >= least)
    return items.withColumns({"tier": F.when(high, "high").otherwise("low"), "confidence_reason": F.when(~high, reason)})


def item_status(items: DataFrame, outliers: DataFrame, least: float = 70) -> DataFrame:
    """is_outlier, item_status, status_reason by the writer's rules: a low confidence (0 is none), an
    outlier by normalised name and price to the cent, a flag; the later wins, reasons are joined."""
    from ..functions.text import name_key

    keys = outliers.select(F.col("receipt_id").alias("o_receipt"), name_key(F.col("item_name")).alias("o_name"), F.round("price", 2).alias("o_price"), F.lit(1).alias("hit")).filter("o_name <> '' and o_price is not null").distinct()
    on = (F.col("receipt_id") == F.col("o_receipt")) & (name_key(F.col("item_name")) == F.col("o_name")) & (F.round("price", 2) == F.col("o_price"))
    got = items.join(keys, on, "left").withColumn("is_outlier", F.coalesce("hit", F.lit(0))).drop("o_receipt", "o_name", "o_price", "hit")
    return _status(got, least)


def item_status_by_receipt(items: DataFrame, rules: Rules = Rules(), least: float = 70) -> DataFrame:
    """``item_status`` with the outliers of the items themselves: an item is like an outlier of its receipt in
    name and price only if it is one, so windows over one exchange do and the outliers are not joined back.
    Prices must be whole cents."""
    from ..functions.text import name_key

    rated, outlier, _ = _rated(items, rules)
    hit = outlier & (name_key(F.col("item_name")) != "")
    return _status(rated.withColumn("is_outlier", hit.cast("int")).drop("p", "n", "mean", "sd", "q1", "q3"), least)


def _status(got: DataFrame, least: float) -> DataFrame:
    under = lambda c: (F.col(c) > 0) & (F.col(c) < least)
    low = under("name_conf") | under("price_conf")
    flagged = F.col("flagged") if "flagged" in got.columns else F.lit(False)
    show = lambda c: F.format_string("%.1f", F.col(c).cast("double"))
    reasons = F.filter(F.array(
        F.when(low, F.concat(F.lit("name_conf="), show("name_conf"), F.lit(", price_conf="), show("price_conf"), F.lit(f" (<{least:.1f})"))),
        F.when(F.col("is_outlier") == 1, "validation_outlier"), F.when(flagged, F.coalesce(F.col("flag_reason") if "flag_reason" in got.columns else F.lit(None), F.lit("flagged"))),
    ), lambda x: x.isNotNull())
    status = F.when(flagged, "FLAGGED").when(F.col("is_outlier") == 1, "OUTLIER").when(low, "LOW_CONF").otherwise("OK")
    return got.withColumns({"item_status": status, "status_reason": F.when(F.size(reasons) > 0, F.array_join(reasons, " | "))})


def ui_item_status(items: DataFrame, outliers: DataFrame, suspicious: DataFrame, named: DataFrame) -> DataFrame:
    """Status by three sets of (receipt_id, item_name), compared normalised; the first that holds wins."""
    from ..functions.text import display_key

    out = items.withColumn("k", display_key(F.col("item_name")))
    for i, df in enumerate((outliers, suspicious, named)):
        keys = df.select(F.col("receipt_id").alias(f"r{i}"), display_key(F.col("item_name")).alias(f"k{i}")).distinct()
        out = out.join(keys, (F.col("receipt_id") == F.col(f"r{i}")) & (F.col("k") == F.col(f"k{i}")), "left")
    status = F.when(F.col("k0").isNotNull(), "OUTLIER").when(F.col("k1").isNotNull(), "SUSPICIOUS_PRICE").when(F.col("k2").isNotNull(), "NAME_ISSUE").otherwise("OK")
    return out.withColumn("ui_status", status).drop("k", *(f"{c}{i}" for c in "rk" for i in range(3)))


def receipt_math(receipts: DataFrame, items: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """item_sum, subtotal_ok, total_ok (null where a part is missing) and the validation status."""
    tol = F.lit(tolerance).cast("decimal(10,4)")
    sums = items.filter("price is not null").groupBy("receipt_id").agg(F.sum("price").cast("decimal(28,2)").alias("item_sum"))
    got = receipts.select("receipt_id", "subtotal", "tax", "total").join(sums, "receipt_id", "left").withColumn("item_sum", F.coalesce("item_sum", F.lit(0)).cast("decimal(28,2)"))
    sub = F.when(F.col("subtotal").isNotNull(), F.abs(F.col("item_sum") - F.col("subtotal")) <= tol)
    tot = F.when(F.col("subtotal").isNotNull() & F.col("total").isNotNull(), F.abs(F.col("subtotal") + F.coalesce("tax", F.lit(0)) - F.col("total")) <= tol)
    status = F.when(F.col("subtotal_ok").isNull() & F.col("total_ok").isNull(), "unvalidated").when(F.col("total_ok") & F.coalesce("subtotal_ok", F.lit(True)), "valid").otherwise("needs_review")
    return got.withColumns({"subtotal_ok": sub, "total_ok": tot}).withColumn("validation_status", status)


def confidence_estimate(results: DataFrame) -> DataFrame:
    """Confidence of a parsed result from what it holds: 40, and more for each field and item, 100 at most."""
    has = lambda c, n: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), n).otherwise(0)
    # fixed values: points of a field
    points = {"vendor": 10, "total": 15, "subtotal": 8, "tax": 5, "date": 5, "phone": 5}
    score = F.lit(40) + sum(has(c, n) for c, n in points.items()) + F.least(F.lit(12), 2 * F.col("n_items"))
    return results.withColumn("confidence", F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("int"))
