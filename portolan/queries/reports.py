"""Exports, views, events and synchronisation results."""

from pyspark.sql import functions as F

from portolan.functions import numbers, text
from portolan.operators import search
from portolan.plans import reports
from portolan.queries.changes import _heads, _lines
from portolan.queries.imports import sample_sheet_items
from portolan.queries.oracle_tables import with_tables
from portolan.queries.registry import query
from portolan.sources import sample_tables as st
from portolan.streaming import folder_job, watch


@query("export_dispatches", with_tables("""
SELECT id AS "ID", coalesce(nullif(owner, ''), 'Sin Asignar') AS "Dueno_Cliente", number AS "Numero_Despacho", coalesce(CAST(date AS VARCHAR), '') AS "Fecha",
  customs_office AS "Aduana", regime AS "Regimen", channel AS "Canal", importer AS "Importador", importer_doc AS "RUC", exporter AS "Proveedor",
  coalesce(bl, awb, '') AS "BL_AWB", container AS "Contenedor", fob AS "FOB", freight AS "Flete", insurance AS "Seguro", cif AS "CIF",
  currency AS "Moneda", total AS "Impuestos", status AS "Estado" FROM dispatches"""))
def export_dispatches(spark, sf):
    return reports.dispatches_export(st.dispatches(spark, sf))


@query("export_items", with_tables("""
SELECT dispatch_id AS "ID_DESPACHO", number AS "NUMERO_DESPACHO", coalesce(strftime(date, '%d/%m/%Y'), '') AS "FECHA_DESPACHO", coalesce(owner, '') AS "DUENO_CLIENTE",
  importer AS "IMPORTADOR", item_no AS "ITEM", coalesce(CAST(subitem_no AS VARCHAR), '') AS "SUBITEM", coalesce(hs_code, '') AS "NCM_POSICION",
  coalesce(nullif(brand, ''), 'Sin Marca') AS "MARCA", coalesce(product_code, '') AS "CODIGO_EAN", description AS "DESCRIPCION", quantity AS "CANTIDAD",
  unit AS "UNIDAD", coalesce(unit_value, 0) AS "FOB_UNITARIO", total_value AS "FOB_TOTAL", CAST(round(vat_rate * 100) AS INTEGER) || '.0%' AS "IVA_PCT",
  CASE WHEN duty_rate IS NULL THEN '' ELSE CAST(round(duty_rate * 100) AS INTEGER) || '.0%' END AS "ARANCEL_PCT", i.origin AS "PAIS_ORIGEN", page AS "PAGINA"
FROM items i JOIN dispatches d ON d.id = dispatch_id"""))
def export_items(spark, sf):
    return reports.items_export(search.items_with_dispatch(st.items(spark, sf), st.dispatches(spark, sf)))


@query("workbook_dispatches", with_tables("""
SELECT id, coalesce(nullif(owner, ''), 'Sin Asignar') AS owner, broker, coalesce(bl, awb, '') AS transport_paper, net_weight, packages, file_name FROM dispatches"""))
def workbook_dispatches(spark, sf):
    frames = reports.workbook_frames(st.dispatches(spark, sf), st.items(spark, sf))
    return frames["dispatches"].select("id", "owner", "broker", "transport_paper", "net_weight", "packages", "file_name")


@query("workbook_items", with_tables("""
SELECT i.id, dispatch_id, number, coalesce(owner, '') AS owner, coalesce(nullif(brand, ''), 'Sin Marca') AS brand, coalesce(unit_value, 0) AS unit_value, page
FROM items i JOIN dispatches d ON d.id = dispatch_id"""))
def workbook_items(spark, sf):
    frames = reports.workbook_frames(st.dispatches(spark, sf), st.items(spark, sf))
    return frames["items"].select("id", "dispatch_id", "number", "owner", "brand", "unit_value", "page")


@query("workbook_summary", with_tables("""
, d AS (SELECT * FROM dispatches WHERE status = 'REVISAR')
SELECT 'Total de Despachos Registrados' AS metric, CAST(count(*) AS DOUBLE) AS value FROM d
UNION ALL SELECT 'Total de Ítems / Subítems', CAST(count(*) AS DOUBLE) FROM items WHERE dispatch_id IN (SELECT id FROM d)
UNION ALL SELECT 'Valor FOB Total (USD)', round(sum(fob), 2) FROM d UNION ALL SELECT 'Valor CIF Total (USD)', round(sum(cif), 2) FROM d
UNION ALL SELECT 'Total Impuestos / Tributos (Gs)', round(sum(total), 2) FROM d UNION ALL SELECT 'Peso Neto Total (Kg)', round(sum(net_weight), 2) FROM d"""))
def workbook_summary(spark, sf):
    chosen = search.search_dispatches(st.dispatches(spark, sf), status="REVISAR")
    return reports.workbook_frames(chosen, st.items(spark, sf))["summary"]


@query("sheet_export", with_tables("""
, lines AS (SELECT dispatch_id AS sheet_id, description AS goods, quantity,
    CASE WHEN item_no % 3 = 0 THEN total_value WHEN item_no % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE quantity * (item_no + 0.5) END AS line_total
  FROM items)
SELECT sheet_id, 0 AS sort_key, goods, quantity, CAST(line_total AS DOUBLE) AS line_total FROM lines
UNION ALL SELECT sheet_id, 1, 'TOTALES', round(sum(quantity), 2), round(sum(line_total), 2) FROM lines GROUP BY sheet_id"""))
def sheet_export(spark, sf):
    return reports.sheet_export(sample_sheet_items(spark, sf)).select("sheet_id", "sort_key", "goods", "quantity", "line_total")


@query("dispatch_report", with_tables("""
SELECT CAST(id AS VARCHAR) AS id, substr(coalesce(nullif(owner, ''), '-'), 1, 15) AS owner, number, coalesce(strftime(date, '%d/%m/%Y'), '-') AS date,
  substr(importer, 1, 20) AS importer, importer_doc, substr(exporter, 1, 18) AS exporter, '$' || format('{:,.2f}', fob) AS fob,
  '$' || format('{:,.2f}', cif) AS cif, status FROM dispatches"""))
def dispatch_report(spark, sf):
    return reports.dispatch_report(st.dispatches(spark, sf))


@query("items_json", with_tables("""
SELECT dispatch_id, item_no, subitem_no, id AS item_id, brand, total_value FROM items"""))
def items_json(spark, sf):
    rows = reports.items_json(st.items(spark, sf))
    parsed = F.from_json("json", "id string, brand string, total_value double")
    return rows.withColumn("j", parsed).select("dispatch_id", "item_no", "subitem_no", F.col("j.id").alias("item_id"), "j.brand", "j.total_value")


_VIEW = """
SELECT id, 'number' AS field, 'Número de Despacho' AS label, number AS value FROM dispatches
UNION ALL SELECT id, 'owner', 'Dueño / Cliente', owner FROM dispatches WHERE owner <> ''
UNION ALL SELECT id, 'date', 'Fecha Oficial', strftime(date, '%d/%m/%Y') FROM dispatches WHERE date IS NOT NULL
UNION ALL SELECT id, 'fob', 'Valor FOB (USD)', format('{:,.2f}', fob) FROM dispatches
UNION ALL SELECT id, 'packages', 'Cantidad de Bultos', format('{:,.0f}', packages) FROM dispatches
UNION ALL SELECT id, 'total', 'Total Tributos (Gs)', format('{:,.0f}', total) FROM dispatches
UNION ALL SELECT id, 'origin', 'País de Origen', origin FROM dispatches WHERE origin <> ''
UNION ALL SELECT id, 'bl', 'Documento BL / AWB', bl FROM dispatches WHERE bl IS NOT NULL"""


@query("field_audit_view", with_tables(_VIEW))
def field_audit_view(spark, sf):
    view = reports.field_audit_view(st.dispatches(spark, sf))
    return view.filter(F.col("field").isin("number", "owner", "date", "fob", "packages", "total", "origin", "bl")).select("id", "field", "label", "value")


@query("filter_fields", with_tables(f"SELECT * FROM ({_VIEW}) WHERE lower(label) LIKE '%fob%' OR lower(field) LIKE '%fob%' OR lower(value) LIKE '%fob%'"))
def filter_fields(spark, sf):
    view = reports.field_audit_view(st.dispatches(spark, sf))
    return reports.filter_fields(view, "FOB").select("id", "field", "label", "value")


#: Fields of the field audit that the sample declarations have.
_SHOWN = ["number", "owner", "date", "importer", "importer_doc", "exporter", "origin", "broker", "customs_office", "regime", "channel", "fob", "freight", "insurance",
          "cif", "exchange_rate", "total", "net_weight", "packages", "bl", "container"]
_FILLED = " + ".join(f"CASE WHEN CAST({f} AS VARCHAR) <> '' THEN 1 ELSE 0 END" for f in _SHOWN)


@query("dispatch_info_json", with_tables(f"""
SELECT id, number, owner, status, channel, file_name, CAST({_FILLED} AS INTEGER) AS fields, CASE WHEN date IS NULL THEN NULL ELSE strftime(date, '%d/%m/%Y') END AS shown_date,
  format('{{:,.2f}}', cif) AS shown_cif FROM dispatches"""))
def dispatch_info_json(spark, sf):
    rows = reports.dispatch_info_json(st.dispatches(spark, sf))
    fields = "array<struct<field:string,label:string,value:string,confidence:double,page:int,method:string>>"
    j = F.from_json("json", f"number string, owner string, status string, channel string, file_name string, fields {fields}")
    shown = lambda name: F.get(F.filter("j.fields", lambda x: x["field"] == name), F.lit(0))["value"]
    parsed = rows.select("id", j.alias("j"))
    return parsed.select("id", "j.number", "j.owner", "j.status", "j.channel", "j.file_name", F.size("j.fields").alias("fields"), shown("date").alias("shown_date"), shown("cif").alias("shown_cif"))


@query("field_audit_provenance", with_tables(" UNION ALL ".join(
    f"SELECT id, '{f}' AS field, CASE WHEN id % {k + 2} = 0 THEN CAST(0.95 AS DOUBLE) ELSE CAST({k + 50} AS DOUBLE) / 100 END AS confidence, "
    f"CASE WHEN id % {k + 2} = 0 THEN 1 ELSE {k + 1} END AS page, CASE WHEN id % {k + 2} = 0 THEN 'TEXT' ELSE 'OCR' END AS method FROM dispatches WHERE CAST({f} AS VARCHAR) <> ''"
    for k, f in enumerate(_SHOWN))))
def field_audit_provenance(spark, sf):
    """All fields of all declarations; every k-th declaration lacks the record of a field."""
    d = st.dispatches(spark, sf)
    records = [F.when(F.col("id") % (k + 2) != 0, F.struct(F.lit(f).alias("key"), F.struct(F.lit((k + 50) / 100).alias("confidence"), F.lit(k + 1).alias("page"), F.lit("OCR").alias("method")).alias("value")))
               for k, f in enumerate(_SHOWN)]
    view = reports.field_audit_view(d.withColumn("field_meta", F.map_from_entries(F.array_compact(F.array(*records)))))
    return view.select("id", "field", "confidence", "page", "method")


@query("dispatch_events", with_tables("""
SELECT d.id, number, coalesce(nullif(owner, ''), 'Sin Asignar') AS owner, fob, count(i.id) AS items FROM dispatches d LEFT JOIN items i ON i.dispatch_id = d.id GROUP BY ALL"""))
def dispatch_events(spark, sf):
    counts = st.items(spark, sf).groupBy(F.col("dispatch_id").alias("id")).agg(F.count("*").alias("items"))
    events = reports.dispatch_events(st.dispatches(spark, sf), counts, "Carpeta")
    parsed = F.from_json("payload", "dispatch struct<number:string,owner:string,fob:double,items:bigint>")["dispatch"]
    return events.select("id", parsed.alias("d")).select("id", "d.*")


@query("owner_events", with_tables("""
SELECT id, number, coalesce(nullif(owner, ''), 'Sin Asignar') AS old_value, 'ACME' AS new_value FROM dispatches WHERE id % 6 = 2 AND id % 4 <> 0"""))
def owner_events(spark, sf):
    from portolan.operators.changes import set_owner
    from portolan.queries.changes import AT, _owner_edits

    d = st.dispatches(spark, sf)
    audits = set_owner(_heads(spark, sf), _owner_edits(spark, sf).filter("trim(owner) <> ''"), AT)[1]
    events = reports.owner_events(audits, d)
    parsed = F.from_json("payload", "number string, old_value string, new_value string")
    return events.select("id", parsed.alias("p")).select("id", "p.*")


@query("batch_event", with_tables("""
SELECT count(*) AS count, 'Se agregaron ' || count(*) || ' despachos: ' || (SELECT string_agg(number, ', ' ORDER BY id) FROM (SELECT id, number FROM dispatches ORDER BY id LIMIT 3))
  || ' y ' || (count(*) - 3) || ' más' AS message FROM dispatches"""))
def batch_event(spark, sf):
    return reports.batch_event(st.dispatches(spark, sf))


@query("pending_registry", with_tables("""
SELECT number, importer, 'Carpeta' AS source, 'nuevo' AS kind FROM dispatches WHERE status = 'PROCESADO' AND id % 3 <> 0"""))
def pending_registry(spark, sf):
    d = st.dispatches(spark, sf)
    again = d.unionByName(d.filter("id % 2 = 0"))
    return watch.pending_registry(again, d.filter("id % 3 = 0").select("number"), "Carpeta")


@query("new_document_check", with_tables("""
SELECT count(*) FILTER (id % 3 = 0) AS new_files, count(*) FILTER (id % 7 = 0) AS pending_imports, true AS has_new FROM dispatches"""))
def new_document_check(spark, sf):
    d = st.dispatches(spark, sf)
    files = d.select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("n"), "number", F.lit("Q.pdf"))).otherwise(F.col("file_name")).alias("file_name"))
    return watch.new_document_check(files, d, d.filter("false").select("file_name"), d.filter("id % 7 = 0"))


@query("unified_sync_added", with_tables("""
SELECT number, CASE WHEN id % 4 = 0 THEN 'scan' ELSE 'replica' END AS source FROM dispatches WHERE id % 4 IN (0, 1)"""))
def unified_sync_added(spark, sf):
    heads, lines = _heads(spark, sf), _lines(spark, sf)
    local = {"dispatches": heads.filter("id % 4 <> 1"), "items": lines.filter("dispatch_id % 4 <> 1")}
    there = heads.filter("id % 4 = 1 OR id % 4 = 2").withColumn("id", F.col("id") * 3)
    remote = {"dispatches": there, "items": lines.filter("dispatch_id % 4 IN (1, 2)").withColumn("dispatch_id", F.col("dispatch_id") * 3)}
    return watch.unified_sync(heads.filter("id % 4 = 0"), local, remote)["added"]


@query("scan_outcomes", with_tables("""
SELECT file_name, CASE id % 5 WHEN 0 THEN 'OMITIDO' WHEN 1 THEN 'OMITIDO' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'PROCESADO_EXITOSO' ELSE 'ENCONTRADO' END AS status,
  CASE id % 5 WHEN 0 THEN 'Ya existe por nombre de archivo (Despacho Nº ' || number || ')' WHEN 1 THEN 'Ya registrado previamente por contenido idéntico (Despacho Nº ' || id || ')'
    WHEN 2 THEN 'sin páginas' END AS message,
  CASE WHEN id % 5 IN (0, 1) THEN id WHEN id % 5 = 3 THEN -id END AS dispatch_id, CASE WHEN id % 5 = 3 THEN number END AS number,
  CASE WHEN id % 5 = 3 THEN importer END AS importer, CASE WHEN id % 5 = 3 THEN id % 9 END AS items
FROM (SELECT id, number, importer, CASE WHEN id % 5 = 0 THEN file_name ELSE 'f' || id || '.pdf' END AS file_name FROM dispatches)"""))
def scan_outcomes(spark, sf):
    d = st.dispatches(spark, sf)
    key = F.col("id") % 5
    files = d.select(F.when(key == 0, F.col("file_name")).otherwise(F.format_string("f%d.pdf", "id")).alias("file_name"), "file_hash", F.lit("in").alias("source_path"))
    registered = d.filter("id % 5 < 2").withColumn("file_hash", F.when(key == 1, F.col("file_hash"))).withColumn("number", F.when(key == 0, F.col("number")))
    failed = d.filter("id % 5 = 2").select(F.format_string("f%d.pdf", "id").alias("file_name"), F.lit("sin páginas").alias("message"))
    done = d.filter("id % 5 = 3").select("file_hash", F.format_string("f%d.pdf", "id").alias("first_name"), F.lit("in").alias("first_path"), F.lit("PROCESADO_EXITOSO").alias("outcome"),
                                         F.lit(None).cast("string").alias("reason"), (-F.col("id")).alias("new_id"), F.col("number").alias("new_number"), F.col("importer").alias("new_importer"), (F.col("id") % 9).alias("items"))
    return folder_job.scan_outcomes(files, registered, failed, done)


@query("display_values", with_tables("""
SELECT id, CASE channel WHEN 'VERDE' THEN 'green' WHEN 'NARANJA' THEN 'orange' ELSE 'red' END AS light,
  CASE WHEN confidence >= 0.9 THEN 'green' WHEN confidence >= 0.7 THEN 'amber' ELSE 'red' END AS band, substr(number, 1) AS file_number FROM dispatches"""))
def display_values(spark, sf):
    d = st.dispatches(spark, sf)
    return d.select("id", text.channel_label("channel").alias("light"), numbers.confidence_band("confidence").alias("band"),
                    text.number_from_filename(F.concat(F.lit("copia "), F.lower("number"), F.lit(" (2).pdf"))).alias("file_number"))


@query("check_values", with_tables("""
SELECT id, CASE WHEN abs(cif - (fob + freight + insurance)) / CASE WHEN cif = 0 THEN 1 ELSE cif END * 100 > 5 THEN 1 ELSE 0 END AS bad_money,
  CASE WHEN year(date) < 2000 THEN 'old' WHEN year(date) > 2000 THEN 'future' END AS bad_date FROM dispatches"""))
def check_values(spark, sf):
    from portolan.functions.dates import check_date

    d = st.dispatches(spark, sf)
    error = check_date("date", "1998-05-05")
    return d.select("id", numbers.check_financials("fob", "freight", "insurance", "cif").isNotNull().cast("int").alias("bad_money"),
                    F.when(error.contains("antigua"), "old").when(error.contains("futuro"), "future").alias("bad_date"))
