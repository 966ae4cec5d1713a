"""Auditing and repairing goods descriptions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.functions.goods import diagnose
from portolan.functions.text import blank_to_null, strip
from portolan.operators.changes import edit_order

_FLAG_ISSUE = {"headers": fv.ISSUE_HEADER, "skus": fv.ISSUE_CODE, "prefixes": fv.ISSUE_TARIFF}


def audit_prefilter(df: DataFrame, kind: str | None) -> DataFrame:
    """A coarse text test that keeps the costly diagnosis off most rows."""
    patterns = fv.AUDIT_PREFILTER.get(kind or "all")
    if not patterns:
        return df
    return df.filter(functools.reduce(lambda a, b: a | b, [F.col("description").ilike(p) for p in patterns]))


def audit_filter(df: DataFrame, kind: str | None) -> DataFrame:
    """The exact test on diagnosed rows."""
    flawed = df.filter(~F.col("is_clean"))
    if kind == "cutoffs":
        return flawed.filter("needs_source")
    if kind in _FLAG_ISSUE:
        return flawed.filter(F.array_contains("issues", _FLAG_ISSUE[kind]))
    return flawed


def audit_items(items: DataFrame, dispatches: DataFrame, kind: str | None = None) -> DataFrame:
    """Flawed goods lines with what they should read; page the result for display."""
    narrow = items.select("id", "dispatch_id", "item_no", "subitem_no", "brand", "product_code", "description")
    flawed = audit_filter(diagnose(audit_prefilter(narrow, kind)), kind)
    headers = dispatches.select(F.col("id").alias("dispatch_id"), "number")
    return flawed.join(headers, "dispatch_id")


def audit_summary(items: DataFrame) -> DataFrame:
    """Quality of the whole catalogue in one row.

    Equal (description, brand, code) triples are counted first, so that each
    distinct text is diagnosed once.
    """
    triples = items.groupBy("description", "brand", "product_code").agg(F.count("*").alias("n"))
    checked = diagnose(triples)

    def lines(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    def with_issue(name: str) -> Column:
        return lines(F.array_contains("issues", name))

    sums = checked.agg(
        lines(F.lit(True)).alias("items"),
        lines(F.col("is_clean")).alias("clean"),
        lines(~F.col("is_clean")).alias("flawed"),
        lines(F.col("needs_source")).alias("cutoffs"),
        with_issue(fv.ISSUE_HEADER).alias("headers"),
        with_issue(fv.ISSUE_CODE).alias("codes"),
        with_issue(fv.ISSUE_TARIFF).alias("prefixes"),
    )
    share = F.when(F.col("items") > 0, F.round(F.col("clean") * 100.0 / F.col("items"), 1)).otherwise(F.lit(100.0))
    return sums.withColumn("clean_pct", share)


def apply_corrections(items: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply hand corrections (item_id, new_description, new_code, new_brand).

    A NULL code or brand keeps the old one; a blank code clears it and a blank
    brand becomes the no-brand label.  Of repeated corrections of a line the last by
    ``edit_no`` counts, if there is such a column, and else the greatest.  Returns the new lines and the corrections
    whose line does not exist.
    """
    given = F.struct(edit_order(corrections).alias("no"), "new_description", "new_code", "new_brand")
    edits = corrections.groupBy(F.col("item_id").alias("id")).agg(F.max(given).alias("_last"))
    edits = edits.select("id", F.lit(True).alias("_edit"), "_last.new_description", "_last.new_code", "_last.new_brand")
    edited = F.col("_edit").isNotNull()
    joined = items.join(edits, "id", "left")
    code = F.when(edited & F.col("new_code").isNotNull(), blank_to_null(strip("new_code"))).otherwise(F.col("product_code"))
    brand = F.when(
        edited & F.col("new_brand").isNotNull(), F.coalesce(blank_to_null(strip("new_brand")), F.lit(fv.NO_BRAND_LABEL))
    ).otherwise(F.col("brand"))
    text = F.when(edited, F.coalesce(strip("new_description"), F.lit(""))).otherwise(F.col("description"))
    updated = (
        joined.withColumn("description", text).withColumn("product_code", code).withColumn("brand", brand).select(*items.columns)
    )
    unknown = corrections.join(items.select(F.col("id").alias("item_id")), "item_id", "left_anti").withColumn(
        "error", F.format_string("Ítem ID %s no encontrado", F.col("item_id").cast("string"))
    )
    return updated, unknown


def apply_high_confidence_fixes(items: DataFrame) -> DataFrame:
    """Goods lines with the safe suggestions applied and a ``fixed`` flag."""
    checked = diagnose(items)
    safe = (F.col("audit_confidence") == "high") & ~F.col("needs_source")
    new_text = safe & ~F.col("suggested_description").eqNullSafe(F.col("description"))
    new_code = safe & (F.col("suggested_code") != "") & ~F.col("suggested_code").eqNullSafe(F.col("product_code"))
    return (
        checked.withColumn("fixed", new_text | new_code)
        .withColumn("_code", F.when(new_code, F.col("suggested_code")).otherwise(F.col("product_code")))
        .withColumn("_text", F.when(new_text, F.col("suggested_description")).otherwise(F.col("description")))
        .drop("product_code", "description")
        .withColumnsRenamed({"_code": "product_code", "_text": "description"})
        .select(*items.columns, "fixed")
    )


def fix_counts(fixed_items: DataFrame) -> DataFrame:
    """How many lines and declarations a batch of fixes touched."""
    return fixed_items.filter("fixed").agg(
        F.count("*").alias("items"), F.countDistinct("dispatch_id").alias("dispatches")
    )


def recover_cutoffs(items: DataFrame, extracted: DataFrame) -> DataFrame:
    """Fill descriptions lost at a page break from a new extraction.

    ``extracted`` has dispatch_id, item_no, subitem_no, description, brand,
    product_code and seq (its order); of equal keys the last one counts.
    """
    keys = ["dispatch_id", "item_no", "subitem_no"]
    lost = items.filter(F.col("description").contains("Subítem")).select(*keys).distinct()
    same = functools.reduce(lambda a, b: a & b, [extracted[k].eqNullSafe(lost[k]) for k in keys])
    wanted = extracted.join(lost, same, "left_semi")
    last = wanted.groupBy(*keys).agg(F.max_by(F.struct("description", "brand", "product_code"), F.col("seq")).alias("new"))
    usable = last.filter(~F.col("new.description").contains("Subítem")).select(*[F.col(k).alias(f"_{k}") for k in keys], "new")
    match = functools.reduce(lambda a, b: a & b, [items[k].eqNullSafe(usable[f"_{k}"]) for k in keys])
    hit = F.col("new").isNotNull() & F.col("description").contains("Subítem")
    brand_known = (F.col("new.brand") != fv.NO_BRAND_LABEL) & (F.col("new.brand") != "")
    return (
        items.join(usable, match, "left")
        .withColumn("recovered", F.coalesce(hit, F.lit(False)))
        .withColumn("brand", F.when(F.col("recovered") & brand_known, F.col("new.brand")).otherwise(F.col("brand")))
        .withColumn(
            "product_code",
            F.when(F.col("recovered"), F.coalesce(blank_to_null("new.product_code"), F.col("product_code"))).otherwise(F.col("product_code")),
        )
        .withColumn("description", F.when(F.col("recovered"), F.col("new.description")).otherwise(F.col("description")))
        .select(*items.columns, "recovered")
    )
