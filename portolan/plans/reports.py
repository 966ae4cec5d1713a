"""Projections for exports, views and events.  Column titles are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.functions.dates import day_text
from portolan.functions.numbers import line_total, money_text, percent_text
from portolan.functions.report import field_meta, format_value
from portolan.functions.text import blank_to_null, or_default, zero_to_null
from portolan.operators.aggregates import executive_summary

_TYPES = {**{f: k for f, k in fv.EDITABLE_FIELDS.items()}, "origin": "text", "gross_weight": "number"}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _money(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _transport_paper() -> Column:
    return F.coalesce(blank_to_null("bl"), blank_to_null("awb"), F.lit(""))


def dispatches_export(df: DataFrame) -> DataFrame:
    """The 19 columns of the declaration CSV."""
    return df.select(
        F.col("id").alias("ID"), or_default("owner", fv.NO_OWNER_LABEL).alias("Dueno_Cliente"), _text("number").alias("Numero_Despacho"),
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("Fecha"), _text("customs_office").alias("Aduana"),
        _text("regime").alias("Regimen"), _text("channel").alias("Canal"), _text("importer").alias("Importador"), _text("importer_doc").alias("RUC"),
        _text("exporter").alias("Proveedor"), _transport_paper().alias("BL_AWB"), _text("container").alias("Contenedor"), _money("fob").alias("FOB"),
        _money("freight").alias("Flete"), _money("insurance").alias("Seguro"), _money("cif").alias("CIF"), or_default("currency", "USD").alias("Moneda"),
        _money("total").alias("Impuestos"), _text("status").alias("Estado"),
    )


def items_export(joined: DataFrame) -> DataFrame:
    """The 19 columns of the goods CSV; input are lines joined with their declaration."""
    return joined.select(
        F.col("dispatch_id").alias("ID_DESPACHO"), _text("number").alias("NUMERO_DESPACHO"),
        F.coalesce(day_text("date"), F.lit("")).alias("FECHA_DESPACHO"), _text("owner").alias("DUENO_CLIENTE"), _text("importer").alias("IMPORTADOR"),
        F.col("item_no").alias("ITEM"), F.coalesce(F.nullif("subitem_no", F.lit(0)).cast("string"), F.lit("")).alias("SUBITEM"),
        _text("hs_code").alias("NCM_POSICION"), or_default("brand", fv.NO_BRAND_LABEL).alias("MARCA"), _text("product_code").alias("CODIGO_EAN"),
        _text("description").alias("DESCRIPCION"), _money("quantity").alias("CANTIDAD"), or_default("unit", "UNIDAD").alias("UNIDAD"),
        _money("unit_value").alias("FOB_UNITARIO"), _money("total_value").alias("FOB_TOTAL"), percent_text("vat_rate").alias("IVA_PCT"),
        percent_text("duty_rate").alias("ARANCEL_PCT"), _text("origin").alias("PAIS_ORIGEN"),
        F.coalesce(F.nullif("page", F.lit(0)), F.lit(1)).alias("PAGINA"),
    )


def workbook_frames(dispatches: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """The three datasets of the workbook export: declarations, goods, summary."""
    heads = dispatches.select(
        "id", or_default("owner", fv.NO_OWNER_LABEL).alias("owner"), _text("number").alias("number"),
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"), *[_text(c).alias(c) for c in (
            "customs_office", "regime", "channel", "importer", "importer_doc", "exporter", "origin", "broker")],
        (_text("transport_mode") if "transport_mode" in dispatches.columns else F.lit("")).alias("transport_mode"),
        _transport_paper().alias("transport_paper"), _text("container").alias("container"),
        *[_money(c).alias(c) for c in ("fob", "freight", "insurance", "cif")], or_default("currency", "USD").alias("currency"),
        *[_money(c).alias(c) for c in ("total", "net_weight", "packages")], _text("status").alias("status"), _text("file_name").alias("file_name"),
    )
    parents = dispatches.select(F.col("id").alias("dispatch_id"), "number", F.col("owner").alias("parent_owner"))
    lines = items.join(parents, "dispatch_id").select(
        "id", "dispatch_id", _text("number").alias("number"), _text("parent_owner").alias("owner"), "item_no",
        F.coalesce(F.nullif("subitem_no", F.lit(0)).cast("string"), F.lit("")).alias("subitem_no"), _text("hs_code").alias("hs_code"),
        _text("product_code").alias("product_code"), or_default("brand", fv.NO_BRAND_LABEL).alias("brand"), _text("description").alias("description"),
        _money("quantity").alias("quantity"), or_default("unit", "UNIDAD").alias("unit"), _money("unit_value").alias("unit_value"),
        _money("total_value").alias("total_value"), F.coalesce(F.nullif("page", F.lit(0)), F.lit(1)).alias("page"),
    )
    own = items.join(dispatches.select(F.col("id").alias("dispatch_id")), "dispatch_id", "left_semi")
    return {"dispatches": heads, "items": lines, "summary": executive_summary(dispatches, own)}


def sheet_export(sheet_items: DataFrame) -> DataFrame:
    """Lines of worksheets, each worksheet followed by its TOTALES row.

    The lines and the totals are two branches of one plan; ``sort_key`` puts the
    total behind the lines when a single worksheet is written.
    """
    total = F.coalesce(
        zero_to_null("line_total"), F.round(F.coalesce("quantity", F.lit(0.0)) * F.coalesce("normal_price", F.lit(0.0)), 2)
    )
    lines = sheet_items.select("sheet_id", F.lit(0).alias("sort_key"), "goods", "quantity", "invoice_price", "normal_price", total.alias("line_total"))
    totals = lines.groupBy("sheet_id").agg(
        F.lit(1).alias("sort_key"), F.lit("TOTALES").alias("goods"), F.round(F.sum("quantity"), 2).alias("quantity"),
        F.lit(None).cast("double").alias("invoice_price"), F.lit(None).cast("double").alias("normal_price"),
        F.round(F.sum("line_total"), 2).alias("line_total"),
    )
    return lines.unionByName(totals)


def dispatch_report(df: DataFrame) -> DataFrame:
    """The printed list: shortened names and formatted money."""

    def cut(c: str, n: int) -> Column:
        return F.substring(or_default(c, "-"), 1, n)

    return df.select(
        F.col("id").cast("string").alias("id"), cut("owner", 15).alias("owner"), or_default("number", "-").alias("number"),
        F.coalesce(day_text("date"), F.lit("-")).alias("date"), cut("importer", 20).alias("importer"), or_default("importer_doc", "-").alias("importer_doc"),
        cut("exporter", 18).alias("exporter"), money_text("fob").alias("fob"), money_text("cif").alias("cif"), or_default("status", "-").alias("status"),
    )


ITEM_FIELDS = ["id", "item_no", "subitem_no", "hs_code", "product_code", "brand", "description", "quantity", "unit_value", "total_value"]


def items_json(items: DataFrame, dispatch_id=None) -> DataFrame:
    """Goods lines as JSON objects, one per row, with their place in the declaration."""
    if dispatch_id is not None:
        items = items.filter(F.col("dispatch_id") == dispatch_id)
    body = F.to_json(F.struct(*ITEM_FIELDS), {"ignoreNullFields": "false"})
    return items.select("dispatch_id", "item_no", "subitem_no", body.alias("json"))


def field_audit_view(dispatches: DataFrame) -> DataFrame:
    """Header fields as rows with label, shown value and provenance; blanks are left out."""
    entries = []
    for field, label in fv.AUDIT_FIELD_LABELS.items():
        if field not in dispatches.columns:
            continue
        kind = _TYPES.get(field, "text")
        raw = F.col(field).cast("string")
        meta = field_meta("field_meta", field) if "field_meta" in dispatches.columns else F.struct(
            F.lit(0.95).alias("confidence"), F.lit(1).alias("page"), F.lit("TEXT").alias("method"))
        shown = F.struct(
            F.lit(field).alias("field"), F.lit(label).alias("label"), format_value(F.col(field), field, kind).alias("value"), raw.alias("raw"),
            meta["confidence"].alias("confidence"), meta["page"].alias("page"), meta["method"].alias("method"),
        )
        entries.append(F.when(blank_to_null(raw).isNotNull(), shown))
    rows = dispatches.select("id", F.explode(F.array_compact(F.array(*entries))).alias("f"))
    return rows.select("id", "f.*")


def filter_fields(view: DataFrame, q: str) -> DataFrame:
    """Rows of the field audit whose label, field or value contains ``q``."""
    from portolan.operators.search import filter_rows

    return filter_rows(view, q, ["label", "field", "value"])


def dispatch_info_json(dispatches: DataFrame) -> DataFrame:
    """One JSON object per declaration with its field audit; at most 24 fields each."""
    fields = field_audit_view(dispatches).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("field", "label", "value", "confidence", "page", "method"))).alias("fields")
    )
    head = dispatches.select("id", "number", "owner", "status", "channel", "file_name")
    return head.join(fields, "id", "left").select("id", F.to_json(F.struct("*")).alias("json"))


def dispatch_events(dispatches: DataFrame, item_counts: DataFrame, source: str) -> DataFrame:
    """One event per new declaration (``item_counts`` has id and items)."""
    joined = dispatches.join(item_counts, "id", "left")
    body = F.struct(
        or_default("number", "S/N").alias("number"), or_default("importer", "No identificado").alias("importer"),
        or_default("owner", fv.NO_OWNER_LABEL).alias("owner"), F.upper(or_default("channel", "VERDE")).alias("channel"),
        _money("fob").alias("fob"), _money("cif").alias("cif"), F.coalesce("items", F.lit(0)).alias("items"),
        or_default("file_name", "despacho.pdf").alias("file"),
    )
    return joined.select("id", F.lit("despacho_procesado").alias("event"), F.to_json(F.struct(F.lit(source).alias("source"), body.alias("dispatch"))).alias("payload"))


def owner_events(audits: DataFrame, dispatches: DataFrame) -> DataFrame:
    """One event per owner change in the change log."""
    changed = audits.filter("field = 'owner'").join(
        dispatches.select(F.col("id").alias("dispatch_id"), "number", "importer"), "dispatch_id"
    )
    body = F.struct(or_default("number", "S/N").alias("number"), or_default("importer", "-").alias("importer"), "old_value", "new_value")
    return changed.select(F.col("dispatch_id").alias("id"), F.lit("propietario_actualizado").alias("event"), F.to_json(body).alias("payload"))


def batch_event(new: DataFrame) -> DataFrame:
    """One summary row for a batch of new declarations: count and the first three numbers.

    Only the three smallest sort keys are kept per task, whatever the batch size.
    """
    named = new.filter(blank_to_null("number").isNotNull())
    first = named.orderBy("id").limit(3).agg(F.array_sort(F.collect_list(F.struct("id", "number"))).alias("_first"), F.lit(1).alias("_one"))
    counts = new.agg(F.count("*").alias("count"), F.count(blank_to_null("number")).alias("_named"), F.lit(1).alias("_one"))
    joined = counts.join(first, "_one")
    numbers = F.array_join(F.transform("_first", lambda x: x["number"]), ", ")
    more = F.when(F.col("_named") > 3, F.concat(F.lit(" y "), (F.col("_named") - 3).cast("string"), F.lit(" más"))).otherwise("")
    text = F.when(
        F.col("_named") > 0, F.concat(F.lit("Se agregaron "), F.col("count").cast("string"), F.lit(" despachos: "), numbers, more)
    ).otherwise(F.concat(F.lit("Se agregaron "), F.col("count").cast("string"), F.lit(" nuevos despachos automáticamente.")))
    return joined.select("count", text.alias("message"))
