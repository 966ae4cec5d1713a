"""Dashboards, summaries, facets and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.dates import day_text
from portolan.functions.hs import enrich_hs
from portolan.functions.text import blank_to_null, non_blank
from portolan.operators.search import top_k


def total_of(c: str) -> Column:
    """Sum of money rounded to cents; 0 where there is nothing to sum."""
    return F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)


def distinct_count(c: str, approx: bool = False) -> Column:
    """Number of distinct non-blank values."""
    value = blank_to_null(c)
    return F.approx_count_distinct(value) if approx else F.countDistinct(value)


def dashboard_kpis(dispatches: DataFrame, items: DataFrame, today: str, approx: bool = False) -> DataFrame:
    """One row of headline numbers.

    Headers and lines are stacked into one narrow table so that a single
    aggregation answers all of them, with partial sums before the exchange.
    """
    day = F.lit(today).cast("date")
    headers = dispatches.select(
        F.lit(1).alias("header"), F.lit(0).alias("line"), "date", "status", "fob", "total", "net_weight",
        F.lit(None).cast("string").alias("brand"),
    )
    lines = items.select(F.lit(0).alias("header"), F.lit(1).alias("line"), "brand")
    stacked = headers.unionByName(lines, allowMissingColumns=True)

    def headers_where(condition):
        return F.count_if((F.col("header") == 1) & condition)

    return stacked.agg(
        F.sum("header").alias("dispatches"),
        headers_where(F.col("date") >= F.trunc(day, "year")).alias("this_year"),
        headers_where(F.col("date") >= F.trunc(day, "month")).alias("this_month"),
        headers_where(F.col("status") == "REVISAR").alias("to_review"),
        headers_where(F.col("status") == "CONFIRMADO").alias("confirmed"),
        headers_where(F.col("status") == "PROCESADO").alias("processed"),
        total_of("fob").alias("fob"),
        total_of("total").alias("total"),
        total_of("net_weight").alias("net_weight"),
        F.sum("line").alias("items"),
        distinct_count("brand", approx).alias("brands"),
    )


def effective_cif(df: DataFrame) -> DataFrame:
    """Total CIF; where all CIF values are 0, FOB + freight + insurance."""
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("cif", "fob", "freight", "insurance")])
    rebuilt = F.col("fob") + F.col("freight") + F.col("insurance")
    use_parts = (F.col("cif") == 0) & (F.col("fob") > 0)
    return sums.select(F.round(F.when(use_parts, rebuilt).otherwise(F.col("cif")), 2).alias("cif"))


def union_companies(df: DataFrame) -> DataFrame:
    """Every importer and exporter once, with the roles it appears in."""
    roles = F.array(
        F.struct(F.col("importer").alias("company"), F.lit(1).alias("importer"), F.lit(0).alias("exporter")),
        F.struct(F.col("exporter").alias("company"), F.lit(0).alias("importer"), F.lit(1).alias("exporter")),
    )
    named = df.select(F.inline(roles)).filter(non_blank("company"))
    return named.groupBy("company").agg(F.max("importer").alias("importer"), F.max("exporter").alias("exporter"))


def company_counts(df: DataFrame) -> DataFrame:
    """Distinct importers, distinct exporters, and companies of either role."""
    return union_companies(df).agg(
        F.coalesce(F.sum("importer"), F.lit(0)).alias("importers"),
        F.coalesce(F.sum("exporter"), F.lit(0)).alias("exporters"),
        F.count("*").alias("companies"),
    )


def dispatches_by_year(df: DataFrame) -> DataFrame:
    dated = df.filter(F.col("date").isNotNull())
    grouped = dated.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("dispatches"), total_of("fob").alias("fob"))
    return grouped.orderBy(F.desc("year"))


def rows_per_year(df: DataFrame, column: str = "date") -> DataFrame:
    dated = df.filter(F.col(column).isNotNull())
    return dated.groupBy(F.year(column).alias("year")).agg(F.count("*").alias("lines")).orderBy("year")


def dispatches_by_origin(df: DataFrame, k: int = 8) -> DataFrame:
    named = df.filter(non_blank("origin"))
    grouped = named.groupBy("origin").agg(F.count("*").alias("dispatches"), total_of("fob").alias("fob"))
    return top_k(grouped, "dispatches", "origin", k)


def brand_totals(items: DataFrame, dispatches: DataFrame, q: str | None = None) -> DataFrame:
    """Per brand: lines, declarations and latest date.

    Lines are first counted per (brand, declaration), which shrinks a frequent
    brand before the join and turns the distinct count into a plain one.
    """
    from portolan.operators.search import filter_brands

    named = items.filter(non_blank("brand"))
    if q:
        named = filter_brands(named, q)
    per_dispatch = named.groupBy("brand", "dispatch_id").agg(F.count("*").alias("n"))
    dated = per_dispatch.join(dispatches.select(F.col("id").alias("dispatch_id"), "date"), "dispatch_id")
    return dated.groupBy("brand").agg(
        F.sum("n").alias("items"), F.count("*").alias("dispatches"), F.max("date").alias("last_date")
    )


def brand_summary(items: DataFrame, dispatches: DataFrame, q: str | None = None) -> DataFrame:
    totals = brand_totals(items, dispatches, q)
    shown = F.coalesce(day_text("last_date"), F.lit("-"))
    return totals.withColumn("last_date", shown).orderBy(F.desc("items"), F.asc("brand"))


def top_brands(items: DataFrame, k: int = 15) -> DataFrame:
    named = items.filter(non_blank("brand"))
    grouped = named.groupBy("brand").agg(F.count("*").alias("items"), total_of("total_value").alias("total_value"))
    return top_k(grouped, "items", "brand", k)


def top_hs(items: DataFrame, k: int = 12) -> DataFrame:
    """The most frequent HS codes with their labels, looked up for k rows only."""
    counted = items.filter(non_blank("hs_code")).groupBy("hs_code").agg(F.count("*").alias("items"))
    top = enrich_hs(top_k(counted, "items", "hs_code", k))
    return top.select("hs_code", "hs_short", "hs_label", "hs_chapter_label", "items", F.concat_ws(" ", "hs_short", "hs_label").alias("display"))


def catalog_kpis(filtered: DataFrame) -> DataFrame:
    """Counts over a filtered catalogue with its most frequent code and origin.

    The lines are reduced to counts per (brand, code, origin) once; everything
    else is read from that small table.  Equal counts go to the smaller name.
    """
    base = filtered.groupBy(
        blank_to_null("brand").alias("brand"), blank_to_null("hs_code").alias("hs_code"), blank_to_null("origin").alias("origin")
    ).agg(F.count("*").alias("n"))
    entries = F.array(
        *[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("brand", "hs_code", "origin")],
        F.struct(F.lit("line").alias("kind"), F.lit("line").alias("value")),
    )
    counts = base.select("n", F.inline(entries)).groupBy("kind", "value").agg(F.sum("n").alias("n"))
    named = counts.filter(F.col("value").isNotNull())
    best = named.groupBy("kind").agg(
        F.count("*").alias("distinct_values"),
        F.sum("n").alias("lines"),
        F.max("n").alias("best_n"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("best_value"),
    )

    def of(kind, column):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    return best.agg(
        F.coalesce(of("line", "lines"), F.lit(0)).alias("items"),
        F.coalesce(of("brand", "distinct_values"), F.lit(0)).alias("brands"),
        F.coalesce(of("hs_code", "distinct_values"), F.lit(0)).alias("hs_codes"),
        of("hs_code", "best_value").alias("top_hs"),
        F.coalesce(of("hs_code", "best_n"), F.lit(0)).alias("top_hs_items"),
        of("origin", "best_value").alias("top_origin"),
    )


def sheet_kpis(sheets: DataFrame) -> DataFrame:
    return sheets.agg(
        F.count("*").alias("sheets"),
        F.count_if(F.col("status") == "FINIQUITADO").alias("closed"),
        F.count_if(F.col("status") == "BORRADOR").alias("drafts"),
        total_of("grand_total").alias("grand_total"),
        distinct_count("importer").alias("importers"),
    )


def sheet_totals(sheet_items: DataFrame) -> DataFrame:
    """Totals per worksheet, each rounded to cents."""
    quantity = F.coalesce("quantity", F.lit(0.0))

    def total(c):
        return F.round(F.sum(c), 2)

    return sheet_items.groupBy("sheet_id").agg(
        total(quantity).alias("total_quantity"),
        total(quantity * F.coalesce("invoice_price", F.lit(0.0))).alias("total_invoice"),
        total(quantity * F.coalesce("normal_price", F.lit(0.0))).alias("total_normal"),
        total(F.coalesce("line_total", F.lit(0.0))).alias("grand_total"),
    )


def items_value_sum(items: DataFrame, key: str = "doc_id") -> DataFrame:
    return items.groupBy(key).agg(F.sum(F.coalesce("total_value", F.lit(0.0))).alias("items_value"))


def executive_summary(dispatches: DataFrame, items: DataFrame) -> DataFrame:
    """Metric and value rows of the export summary."""
    headers = dispatches.select(F.lit(1).alias("header"), F.lit(0).alias("line"), "fob", "cif", "total", "net_weight")
    lines = items.select(F.lit(0).alias("header"), F.lit(1).alias("line"))
    one_row = headers.unionByName(lines, allowMissingColumns=True).agg(
        F.sum("header").cast("double").alias("Total de Despachos Registrados"),
        F.sum("line").cast("double").alias("Total de Ítems / Subítems"),
        total_of("fob").alias("Valor FOB Total (USD)"),
        total_of("cif").alias("Valor CIF Total (USD)"),
        total_of("total").alias("Total Impuestos / Tributos (Gs)"),
        total_of("net_weight").alias("Peso Neto Total (Kg)"),
    )
    return one_row.unpivot([], one_row.columns, "metric", "value")


def distinct_facets(items: DataFrame, dispatches: DataFrame) -> DataFrame:
    """All values of the filter lists, with the label of HS codes.

    One pass per table: the columns are stacked and de-duplicated together.
    """

    def stacked(df, pairs):
        entries = [F.struct(F.lit(k).alias("facet"), F.col(c).cast("string").alias("value")) for k, c in pairs]
        return df.select(F.inline(F.array(*entries)))

    values = stacked(items, [("brand", "brand"), ("hs_code", "hs_code")]).unionByName(
        stacked(
            dispatches.withColumn("year", F.year("date")),
            [("owner", "owner"), ("importer", "importer"), ("origin", "origin"), ("year", "year")],
        )
    )
    distinct = values.filter(non_blank("value")).distinct()
    labelled = enrich_hs(distinct.withColumn("hs_code", F.when(F.col("facet") == "hs_code", F.col("value"))))
    label = F.when(F.col("facet") == "hs_code", F.col("hs_option")).otherwise(F.col("value"))
    return labelled.select("facet", "value", label.alias("label")).orderBy("facet", "value")


def scan_counters(status: DataFrame, column: str = "status") -> DataFrame:
    """How many files a scan found, imported, skipped and failed on."""
    state = F.col(column)
    return status.agg(
        F.count("*").alias("found"),
        F.count_if(state.isin("PROCESADO", "PROCESADO_EXITOSO", "REVISAR")).alias("imported"),
        F.count_if(state.isin("OMITIDO", "DUPLICADO")).alias("skipped"),
        F.count_if(state == "ERROR").alias("failed"),
    )


def document_method(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """How a document was read: OCR, digital text, or both, and its page count."""
    ocr = F.count_if(F.upper("method") == "OCR")
    method = F.when(ocr == F.count("*"), "OCR").when(ocr > 0, "MIXTO").otherwise("DIGITAL_TEXT")
    return pages.groupBy(key).agg(method.alias("method"), F.count("*").cast("int").alias("page_count"))
