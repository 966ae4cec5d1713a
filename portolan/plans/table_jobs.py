"""The column functions as three jobs over whole tables of raw text: headers, goods lines, worksheet rows.

Each job has a declared schema in and out.  Input columns that are missing count as NULL, others than
declared follow behind the output as they are.  ``unreadable`` names the fields that hold text which could
not be read, so nothing is lost without a mark; no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions import dates, goods, numbers, text
from portolan.functions.hs import enrich_hs
from portolan.functions.text import blank_to_null, clean_text
from portolan.operators.brands import apply_brand_rules
from portolan.plans.documents import assign_status

_TEXTS = lambda *names: ", ".join(f"{n} string" for n in names)

HEADERS_IN = "id bigint, " + _TEXTS(
    "number", "date", "importer", "importer_doc", "exporter", "broker", "broker_doc", "channel", "currency", "fob", "freight", "insurance", "cif", "first_page",
) + ", items_value double, confidence double, is_duplicate boolean"
HEADERS_OUT = (
    "id bigint, number string, date date, importer string, importer_doc string, exporter string, broker string, broker_doc string, channel string, light string, "
    "currency string, fob double, freight double, insurance double, cif double, doc_type string, confidence double, is_duplicate boolean, unreadable array<string>, "
    "errors array<string>, status string"
)
ITEMS_IN = "id string, dispatch_id bigint, " + _TEXTS("description", "brand", "product_code", "hs_code", "quantity", "unit_value", "total_value")
ITEMS_OUT = (
    "id string, dispatch_id bigint, description string, brand string, product_code string, skeleton string, family string, variant string, label string, "
    "hs_code string, hs_short string, hs_label string, quantity double, unit_value double, total_value double, issues array<string>, audit_confidence string, unreadable array<string>"
)
SHEET_ROWS_IN = "id bigint, " + _TEXTS("date", "number", "importer", "goods", "product_code", "quantity", "invoice_price", "normal_price", "total", "adjusted_value", "vat", "duty")
SHEET_ROWS_OUT = (
    "id bigint, date date, number string, importer string, goods string, product_code string, quantity double, invoice_price double, normal_price double, "
    "line_total double, adjusted_value double, vat_rate double, duty_rate double, row_hash string, unreadable array<string>"
)


def _declared(df: DataFrame, schema: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the declared columns in their types under ``_in`` names, and the names of the others."""
    own, fields = set(df.columns), T._parse_datatype_string(schema).fields
    columns = [(F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f"_in_{f.name}") for f in fields]
    others = [c for c in df.columns if c not in {f.name for f in fields}]
    return df.select(*columns, *others), others


def _shaped(df: DataFrame, schema: str, others: list[str]) -> DataFrame:
    fields = T._parse_datatype_string(schema).fields
    names = {f.name for f in fields}
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields), *(F.col(c) for c in others if c not in names))


def _raw(name: str) -> Column:
    return F.col(f"_in_{name}")


def _unreadable(values: dict[str, Column]) -> Column:
    """Names of the fields whose text holds something, but no value."""
    return F.array_compact(F.array(*(F.when(clean_text(_raw(n)).isNotNull() & v.isNull(), F.lit(n)) for n, v in values.items())))


def normalize_headers(headers: DataFrame, today: str) -> DataFrame:
    """``HEADERS_IN`` to ``HEADERS_OUT``: cleaned, typed and reconciled headers with their errors and status."""
    rows, others = _declared(headers, HEADERS_IN)
    read = {"date": dates.parse_date(_raw("date"))} | {n: numbers.parse_currency(_raw(n)) for n in ("fob", "freight", "insurance", "cif")}
    fob = numbers.reconcile_fob("_fob", F.coalesce(_raw("items_value"), F.lit(0.0)))
    rows = rows.withColumns({f"_{n}": v for n, v in read.items()})
    rows = rows.withColumns({
        "id": _raw("id"), "number": clean_text(_raw("number")), "date": F.col("_date"), "importer": text.normalize_company(_raw("importer")),
        "importer_doc": text.normalize_document(_raw("importer_doc")), "exporter": text.normalize_company(_raw("exporter")), "broker": clean_text(_raw("broker")),
        "broker_doc": text.normalize_document(_raw("broker_doc")), "channel": F.upper(clean_text(_raw("channel"))), "light": text.channel_label(_raw("channel")),
        "currency": F.coalesce(text.normalize_currency_code(_raw("currency")), F.lit("USD")), "fob": fob, "freight": F.col("_freight"), "insurance": F.col("_insurance"),
        "doc_type": text.document_type(_raw("first_page")), "confidence": F.coalesce(_raw("confidence"), F.lit(0.0)), "is_duplicate": F.coalesce(_raw("is_duplicate"), F.lit(False)),
        "unreadable": _unreadable({n: F.col(f"_{n}") for n in read}),
    })
    rows = rows.withColumn("cif", numbers.reconcile_cif("_cif", "fob", "freight", "insurance"))
    return _shaped(assign_status(rows, today), HEADERS_OUT, others)


def clean_items(items: DataFrame, rules: DataFrame) -> DataFrame:
    """``ITEMS_IN`` to ``ITEMS_OUT``: product code and name out of the raw text, brand by rule, family, prices, and what is wrong with the text."""
    rows, others = _declared(items, ITEMS_IN)
    read = {n: numbers.parse_currency(_raw(n)) for n in ("quantity", "unit_value", "total_value")}
    rows = rows.withColumns({f"_{n}": v for n, v in read.items()} | {"brand": clean_text(_raw("brand")), "_obs": goods.observation(_raw("description"), clean_text(_raw("brand")))})
    rows = rows.withColumn("_diagnosis", goods.diagnosis("_in_description", "_in_brand", "_in_product_code"))
    rows = apply_brand_rules(rows, rules)
    own = F.when(F.col("brand") != text.fv.NO_BRAND_LABEL, F.col("brand"))
    rows = rows.withColumns({
        "id": _raw("id"), "dispatch_id": _raw("dispatch_id"), "description": blank_to_null("_obs.text"), "hs_code": clean_text(_raw("hs_code")),
        "product_code": F.coalesce(blank_to_null(F.trim(_raw("product_code"))), blank_to_null("_obs.code")), "skeleton": text.brand_skeleton(own),
        "_family": goods.family_variant(goods.variant_name(F.col("_obs.text"), own)), "quantity": F.col("_quantity"), "total_value": F.col("_total_value"),
        "unit_value": numbers.unit_price("_unit_value", "_quantity", "_total_value"), "issues": F.col("_diagnosis.issues"), "audit_confidence": F.col("_diagnosis.audit_confidence"),
        "unreadable": _unreadable({n: F.col(f"_{n}") for n in read}),
    })
    rows = rows.withColumns({"family": F.col("_family.family"), "variant": F.col("_family.variant"), "label": goods.goods_label(own, F.col("description"))})
    return _shaped(enrich_hs(rows), ITEMS_OUT, others)


def normalize_sheet_rows(rows: DataFrame) -> DataFrame:
    """``SHEET_ROWS_IN`` to ``SHEET_ROWS_OUT``: worksheet rows with numbers, rates, dates, codes and line totals."""
    rows, others = _declared(rows, SHEET_ROWS_IN)
    amounts = {n: F.when(clean_text(_raw(n)).isNotNull(), numbers.parse_numeric(_raw(n))) for n in ("quantity", "invoice_price", "normal_price", "total")}
    rates = {"vat": numbers.parse_tax_pct(_raw("vat")), "duty": numbers.parse_tax_pct(_raw("duty"))}
    code = F.regexp_extract(F.coalesce(_raw("goods"), F.lit("")), r"\b([0-9]{8,14})\b", 1)
    digit = {n: F.when(_raw(n).rlike("[0-9]"), v) for n, v in amounts.items()}  # parse_numeric gives 0 for text without a number
    rows = rows.withColumns({f"_{n}": v for n, v in (amounts | rates).items()} | {"_date": dates.parse_sheet_date(_raw("date"))})
    rows = rows.withColumns({
        "id": _raw("id"), "date": F.col("_date"), "number": clean_text(_raw("number")), "importer": text.normalize_company(_raw("importer")), "goods": clean_text(_raw("goods")),
        "product_code": F.coalesce(blank_to_null(F.regexp_replace(F.trim(_raw("product_code")), r"^([0-9]+)\.0$", "$1")), blank_to_null(code)),
        "quantity": F.col("_quantity"), "invoice_price": F.col("_invoice_price"), "normal_price": F.col("_normal_price"),
        "line_total": numbers.line_total("_quantity", "_invoice_price", F.coalesce("_normal_price", F.lit(0.0)), F.coalesce("_total", F.lit(0.0))),
        "adjusted_value": numbers.clean_num(_raw("adjusted_value")), "vat_rate": F.col("_vat"), "duty_rate": F.col("_duty"),
        "unreadable": _unreadable(digit | rates | {"date": F.col("_date")}),
    })
    seed = F.concat_ws("_", F.lit("HISTORICO"), F.year("date").cast("string"), "number", "importer", numbers.plain_text("line_total"))
    return _shaped(rows.withColumn("row_hash", F.sha2(seed, 256)), SHEET_ROWS_OUT, others)
