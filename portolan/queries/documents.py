"""Round trips: declarations rendered as pages, extracted, compared with their source."""

from pyspark.sql import functions as F

from portolan.functions import numbers, text
from portolan.functions.dates import parse_date
from portolan.operators import aggregates as agg
from portolan.operators import extraction as ex
from portolan.operators import joins
from portolan.plans import documents as docs
from portolan.queries.oracle_tables import with_tables
from portolan.queries.registry import query
from portolan.session import cut_lineage
from portolan.sources import sample_pages as sp
from portolan.sources import sample_tables as st

TODAY = "2001-01-15"

_GOODS = """
, goods AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS line, CAST(l_suppkey % 4 + 1 AS INTEGER) AS sub, items.hs_code AS hs,
    CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_extendedprice AS l_value,
    CASE WHEN l_linenumber <> 7 AND NOT (l_returnflag = 'A' AND l_quantity = 1) THEN replace(upper(p_brand), '#', '') END AS brand,
    CAST(7840000000000 + l_partkey AS VARCHAR) AS ean, upper(p_name) AS name, CAST(l_linenumber + 1 AS INTEGER) AS page
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN items ON items.id =
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))),
priced AS (
  SELECT *, CAST(cents AS DOUBLE) / 100 AS total_value, CAST(round(CAST(CAST(l_value / qty AS VARCHAR) AS DECIMAL(38,20)), 2) AS DOUBLE) AS per_unit FROM goods),
subitems AS (
  SELECT doc_id, 1 AS tier, line AS item_no, sub AS subitem_no, coalesce(hs, 'S') AS hs_code, ean AS product_code,
    name AS description, coalesce(brand, 'Sin Marca') AS brand, CAST(qty AS DOUBLE) AS quantity, CAST(NULL AS DOUBLE) AS net_weight,
    per_unit AS unit_value, total_value, CAST(NULL AS VARCHAR) AS origin, page FROM priced),
standard AS (
  SELECT doc_id, 3 AS tier, line AS item_no, CAST(NULL AS INTEGER) AS subitem_no, coalesce(hs, 'S') AS hs_code, ean AS product_code,
    name AS description, 'Sin Marca' AS brand, CAST(qty AS DOUBLE) AS quantity, CAST(NULL AS DOUBLE) AS net_weight,
    per_unit AS unit_value, total_value, CAST(NULL AS VARCHAR) AS origin, page FROM priced),
grid AS (
  SELECT doc_id, 2 AS tier, line AS item_no, CAST(NULL AS INTEGER) AS subitem_no, CASE WHEN contains(hs, '.') THEN hs
      WHEN regexp_matches(hs, '^[0-9.]{6,15}[A-Z]?$') THEN hs END AS hs_code,
    CAST(NULL AS VARCHAR) AS product_code,
    CASE WHEN line % 2 = 0 THEN 'FINO' ELSE name END AS description,
    CASE WHEN line % 2 = 0 THEN name ELSE coalesce(brand, 'Sin Marca') END AS brand, CAST(qty AS DOUBLE) AS quantity,
    qty + CAST(0.5 AS DOUBLE) AS net_weight, per_unit AS unit_value, total_value, 'CHINA' AS origin, page FROM priced),
code_blocks AS (
  SELECT *, coalesce(hs, 'S') || ' MERCADERIA VALOR USD '
    || replace(format('{:,}', cents // 100), ',', '.') || ',' || printf('%02d', cents % 100) AS block FROM priced),
codes AS (
  SELECT doc_id, 4 AS tier, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, block) AS INTEGER) AS item_no,
    CAST(NULL AS INTEGER) AS subitem_no, hs AS hs_code, CAST(NULL AS VARCHAR) AS product_code,
    'Mercadería Posición ' || hs AS description, 'Sin Marca' AS brand, CAST(1 AS DOUBLE) AS quantity, CAST(NULL AS DOUBLE) AS net_weight,
    total_value AS unit_value, total_value, CAST(NULL AS VARCHAR) AS origin, page FROM code_blocks WHERE contains(hs, '.')),
mixed AS (
  SELECT * FROM subitems WHERE doc_id % 4 = 0 UNION ALL SELECT * FROM standard WHERE doc_id % 4 = 1
  UNION ALL SELECT * FROM grid WHERE doc_id % 4 = 2 UNION ALL SELECT * FROM codes WHERE doc_id % 4 = 3)
"""
_COLUMNS = ["doc_id", "tier", "item_no", "subitem_no", "hs_code", "product_code", "description", "brand", "quantity",
            "net_weight", "unit_value", "total_value", "origin", "page"]


def _items(layout):
    def run(spark, sf):
        return ex.extract_items(sp.document_pages(spark, sf, layout)).select(*_COLUMNS)

    return run


for _layout in sp.LAYOUTS:
    query(f"extract_{_layout}", with_tables(_GOODS + f"SELECT {', '.join(_COLUMNS)} FROM {_layout}"))(_items(_layout))
query("extract_items", with_tables(_GOODS + f"SELECT {', '.join(_COLUMNS)} FROM mixed"))(_items(None))

_HEADER = ["number", "date", "importer", "importer_doc", "broker", "exporter", "customs_office", "regime", "channel", "fob",
           "freight", "insurance", "cif", "currency", "exchange_rate", "net_weight", "packages", "total", "bl", "awb", "container"]


@query("extract_fields", with_tables("""
SELECT id AS doc_id, number, date, upper(importer) AS importer, importer_doc, broker, upper(exporter) AS exporter, customs_office,
  regime, channel, fob, freight, insurance, cif, currency, exchange_rate, net_weight, packages, total, bl, awb, container,
  CAST(CASE WHEN date IS NULL THEN 19 ELSE 20 END AS INTEGER) AS fields_found,
  CAST(CASE WHEN date IS NULL THEN 6 ELSE 5 END AS INTEGER) AS fields_missing FROM dispatches"""))
def extract_fields(spark, sf):
    headers = ex.fields_to_header(ex.extract_fields(sp.document_pages(spark, sf)))
    return headers.select("doc_id", *_HEADER, "fields_found", "fields_missing")


@query("field_provenance", with_tables("""
SELECT id AS doc_id, 'fob' AS field, printf('%.2f', fob) AS value, CAST(0.95 AS DOUBLE) AS confidence, 1 AS page,
  CASE WHEN id % 25 = 0 THEN 'OCR' ELSE 'DIGITAL_TEXT' END AS method FROM dispatches
UNION ALL SELECT id, 'channel', channel, 0.98, 1, CASE WHEN id % 25 = 0 THEN 'OCR' ELSE 'DIGITAL_TEXT' END FROM dispatches
UNION ALL SELECT id, 'gross_weight', NULL, 0.0, 1, 'NONE' FROM dispatches
UNION ALL SELECT id, 'container', container, 0.92, 1, CASE WHEN id % 25 = 0 THEN 'OCR' ELSE 'DIGITAL_TEXT' END FROM dispatches"""))
def field_provenance(spark, sf):
    records = ex.field_records(ex.extract_fields(sp.document_pages(spark, sf)))
    shown = F.when(F.col("field") == "fob", F.format_string("%.2f", F.col("raw_value"))).otherwise(F.col("value"))
    return records.filter(F.col("field").isin("fob", "channel", "gross_weight", "container")).withColumn(
        "raw_value", numbers.parse_currency("raw")).select("doc_id", "field", shown.alias("value"), "confidence", "page", "method")


@query("extraction_confidence", with_tables("""
SELECT id AS doc_id, CASE WHEN date IS NULL THEN 19 ELSE 20 END AS fields_found, CASE WHEN date IS NULL THEN 6 ELSE 5 END AS fields_missing,
  round(CASE WHEN date IS NULL THEN CAST(0.92 * 5 + 0.98 + 0.95 * 13 AS DOUBLE) / 19
    ELSE CAST(0.92 * 5 + 0.98 + 0.95 * 14 AS DOUBLE) / 20 END, 2) AS confidence FROM dispatches"""))
def extraction_confidence(spark, sf):
    return ex.extraction_confidence(ex.field_records(ex.extract_fields(sp.document_pages(spark, sf))))


@query("representative_items", with_tables(_GOODS + """
SELECT id AS doc_id, 1 AS item_no, '3303.00.10.000L' AS hs_code, 'Mercadería General Declarada - Despacho ' || number AS description,
  upper(exporter) AS brand, fob AS total_value FROM dispatches WHERE id NOT IN (SELECT doc_id FROM mixed)"""))
def representative_items(spark, sf):
    pages = sp.document_pages(spark, sf)
    found = cut_lineage(ex.extract_items(pages).select("doc_id").distinct())
    headers = ex.fields_to_header(ex.extract_fields(ex.pages_without_items(pages, found)))
    items = ex.representative_items(headers, found)
    return items.select("doc_id", "item_no", "hs_code", "description", "brand", "total_value")


def _files(spark, sf):
    """One file per declaration; some have a wrong name, are too large, or lack pages."""
    d = st.dispatches(spark, sf)
    key = F.col("id")
    return d.select(
        key.alias("doc_id"),
        F.when(key % 41 == 6, F.concat("number", F.lit(".docx"))).otherwise(F.col("file_name")).alias("file_name"),
        "file_hash",
        F.when(key % 43 == 8, F.lit(60 * 1024 * 1024)).otherwise(F.lit(100000)).cast("bigint").alias("bytes"),
    )


_FLOW = _GOODS + """
, sums AS (SELECT doc_id, round(sum(total_value), 2) AS items_value FROM mixed GROUP BY 1),
flow AS (
  SELECT d.*, id % 41 = 6 AS wrong_type, id % 43 = 8 AS too_large, id % 37 = 2 AS known,
    CASE WHEN id % 41 = 6 THEN number || '.docx' ELSE file_name END AS upload_name,
    CASE WHEN coalesce(items_value, fob) > fob THEN items_value ELSE d.fob END AS new_fob
  FROM dispatches d LEFT JOIN sums ON d.id = sums.doc_id),
money AS (
  SELECT *, CASE WHEN cif <= 0 THEN round(new_fob + freight + insurance, 2) ELSE cif END AS new_cif FROM flow),
outcome AS (
  SELECT *, wrong_type OR too_large AS refused, NOT (wrong_type OR too_large) AND known AS repeated,
    CASE WHEN date IS NULL OR year(date) < 2000 OR abs(new_cif - (new_fob + freight + insurance)) / new_cif * 100 > 5
      THEN 'REVISAR' ELSE 'PROCESADO' END AS new_status FROM money)
"""


def _process(spark, sf):
    registered = st.dispatches(spark, sf).filter("id % 37 = 2")
    rules = st.read_table(spark, sf, "part").select(F.translate(F.upper("p_brand"), "#", "").alias("pattern")).distinct().filter(
        "pattern IN ('BRAND1', 'BRAND2', 'BRAND3')").withColumn("target", F.lit("HOUSE"))
    return docs.process_documents(_files(spark, sf), sp.document_pages(spark, sf), registered, rules, TODAY, owner="Carpeta")


@query("process_documents_headers", with_tables(_FLOW + """
SELECT id AS doc_id, number, date, new_fob AS fob, new_cif AS cif, new_status AS status, 'PARAGUAY_SOFIA' AS doc_type,
  CASE WHEN id % 25 = 0 THEN 'OCR' WHEN id % 10 = 0 AND id IN (SELECT doc_id FROM goods) THEN 'MIXTO' ELSE 'DIGITAL_TEXT' END AS extraction_method,
  'Carpeta' AS owner
FROM outcome WHERE NOT refused AND NOT repeated"""))
def process_documents_headers(spark, sf):
    return _process(spark, sf)["headers"].select("doc_id", "number", "date", "fob", "cif", "status", "doc_type", "extraction_method", "owner")


@query("process_documents_items", with_tables(_FLOW + """
SELECT doc_id, tier, mixed.item_no, mixed.hs_code, mixed.description, CASE WHEN mixed.brand IN ('BRAND1', 'BRAND2', 'BRAND3') THEN 'HOUSE' ELSE mixed.brand END AS brand,
  mixed.total_value FROM mixed JOIN outcome ON outcome.id = doc_id WHERE NOT refused AND NOT repeated
UNION ALL SELECT id, 5, 1, '3303.00.10.000L', 'Mercadería General Declarada - Despacho ' || number, upper(exporter), fob
  FROM outcome WHERE NOT refused AND NOT repeated AND id NOT IN (SELECT doc_id FROM mixed)"""))
def process_documents_items(spark, sf):
    return _process(spark, sf)["items"].select("doc_id", "tier", "item_no", "hs_code", "description", "brand", "total_value")


@query("process_documents_log", with_tables(_FLOW + """
SELECT upload_name AS file_name, file_hash, CASE WHEN repeated THEN 'DUPLICATE_CHECK' WHEN id % 25 = 0 THEN 'OCR'
    WHEN id % 10 = 0 AND id IN (SELECT doc_id FROM goods) THEN 'MIXTO' ELSE 'DIGITAL_TEXT' END AS method,
  CASE WHEN repeated THEN 0 WHEN date IS NULL THEN 19 ELSE 20 END AS fields_found
FROM outcome WHERE NOT refused"""))
def process_documents_log(spark, sf):
    return _process(spark, sf)["log"].select("file_name", "file_hash", "method", "fields_found")


@query("process_batch", with_tables(_FLOW + """
SELECT id AS doc_id, upload_name AS file_name, CASE WHEN refused THEN 'ERROR' WHEN repeated THEN 'DUPLICADO' ELSE new_status END AS status,
  CASE WHEN wrong_type THEN 'Solo se permiten archivos PDF' WHEN too_large THEN 'El archivo supera el límite de 50 MB'
    WHEN repeated THEN 'Archivo idéntico ya registrado previamente (ID: ' || id || ', Despacho: ' || number || ')' END AS message,
  CASE WHEN NOT refused AND NOT repeated THEN number END AS number, CASE WHEN NOT refused AND NOT repeated THEN new_fob END AS fob,
  CASE WHEN NOT refused AND NOT repeated THEN new_cif END AS cif FROM outcome"""))
def process_batch(spark, sf):
    return _process(spark, sf)["results"].select("doc_id", "file_name", "status", "message", "number", "fob", "cif")


@query("scan_counters", with_tables(_FLOW + """
SELECT count(*) AS found, count(*) FILTER (NOT refused AND NOT repeated) AS imported, count(*) FILTER (repeated) AS skipped,
  count(*) FILTER (refused) AS failed FROM outcome"""))
def scan_counters(spark, sf):
    return agg.scan_counters(_process(spark, sf)["results"])


_SCAN = _FLOW + """
, scan AS (SELECT *, CASE WHEN known THEN 'OMITIDO' WHEN refused THEN 'ERROR' ELSE 'PROCESADO_EXITOSO' END AS scan_status FROM outcome),
start AS (SELECT max(id) AS last FROM dispatches WHERE id % 37 = 2),
fresh AS (SELECT scan.*, last + row_number() OVER (ORDER BY upload_name) AS new_id FROM scan, start WHERE scan_status = 'PROCESADO_EXITOSO')
"""


def _folder_batch(spark, sf):
    """All files in one batch of the folder job; those with id % 37 = 2 are registered, the replica holds another part."""
    from portolan.streaming import folder_job

    d = st.dispatches(spark, sf)
    files, pages = _files(spark, sf), sp.document_pages(spark, sf)
    listed = files.select("file_name", "file_hash", "bytes", F.lit("in").alias("source_path"))
    tables = {name: folder_job.empty_table(spark, name) for name in folder_job.TABLES} | {"dispatches": d.filter("id % 37 = 2")}
    texts = pages.join(files.select("doc_id", "file_hash"), "doc_id").drop("doc_id")
    rules = spark.createDataFrame([], "pattern string, target string")
    there = d.filter("id % 37 = 3").withColumn("id", F.col("id") * 2)
    remote = {"dispatches": there, "items": st.items(spark, sf).filter("dispatch_id % 37 = 3").withColumn("dispatch_id", F.col("dispatch_id") * 2)}
    return folder_job.folder_batch(listed, texts, tables, rules, f"{TODAY} 10:00:00", "Carpeta", 4, remote)


@query("folder_batch_status", with_tables(_SCAN + """
, counts AS (SELECT doc_id, count(*) AS n FROM mixed GROUP BY 1)
SELECT upload_name AS file_name, scan.scan_status AS status, CASE WHEN scan.known THEN 'Ya existe por nombre de archivo (Despacho Nº ' || scan.number || ')'
    WHEN scan.wrong_type THEN 'Solo se permiten archivos PDF' WHEN scan.too_large THEN 'El archivo supera el límite de 50 MB' END AS message,
  CASE WHEN scan.known THEN scan.id ELSE fresh.new_id END AS dispatch_id, fresh.number, upper(fresh.importer) AS importer,
  CASE WHEN fresh.id IS NOT NULL THEN coalesce(counts.n, 1) END AS items, CAST(4 AS BIGINT) AS batch
FROM scan LEFT JOIN fresh USING (upload_name) LEFT JOIN counts ON fresh.id = doc_id"""))
def folder_batch_status(spark, sf):
    return _folder_batch(spark, sf)["scan_status"]


@query("folder_batch_dispatches", with_tables(_SCAN + """
SELECT id, number, file_name, file_hash, status, cif FROM dispatches WHERE id % 37 = 2
UNION ALL SELECT new_id, number, upload_name, file_hash, new_status, new_cif FROM fresh"""))
def folder_batch_dispatches(spark, sf):
    return _folder_batch(spark, sf)["dispatches"].select("id", "number", "file_name", "file_hash", "status", "cif")


@query("folder_batch_replica", with_tables(_SCAN + """
, r AS (SELECT number FROM dispatches WHERE id % 37 = 3 UNION SELECT number FROM fresh),
lines AS (SELECT fresh.number, count(*) AS n FROM fresh JOIN mixed ON fresh.id = doc_id GROUP BY 1),
old AS (SELECT number, count(*) AS n FROM dispatches d JOIN items i ON dispatch_id = d.id WHERE d.id % 37 = 3 GROUP BY 1)
SELECT r.number, CASE WHEN fresh.id IS NOT NULL THEN coalesce(lines.n, 1) ELSE coalesce(old.n, 0) END AS items
FROM r LEFT JOIN fresh USING (number) LEFT JOIN lines USING (number) LEFT JOIN old USING (number)"""))
def folder_batch_replica(spark, sf):
    out = _folder_batch(spark, sf)
    lines = out["remote_items"].groupBy(F.col("dispatch_id").alias("id")).agg(F.count("*").alias("items"))
    return out["remote_dispatches"].join(lines, "id", "left").select("number", F.coalesce("items", F.lit(0)).alias("items"))


@query("document_method", with_tables("""
, p AS (SELECT id AS doc_id, 1 AS page FROM dispatches UNION SELECT DISTINCT l_orderkey, l_linenumber + 1 FROM lineitem)
SELECT doc_id, CASE WHEN doc_id % 25 = 0 OR (doc_id % 10 = 0 AND min(page) > 1) THEN 'OCR' WHEN doc_id % 10 = 0 AND max(page) > 1 THEN 'MIXTO'
  ELSE 'DIGITAL_TEXT' END AS method, CAST(count(*) AS INTEGER) AS page_count FROM p GROUP BY doc_id"""))
def document_method(spark, sf):
    return agg.document_method(sp.document_pages(spark, sf))


def _texts_as_pages(spark, sf):
    """Conversation turns in the role of pages: text that is not a declaration."""
    c = st.read_table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_num"), "text",
                    F.lit(None).cast("string").alias("method"))


@query("page_stats", """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_num, CAST(length(trim(text, E' \\t\\n\\r')) AS INTEGER) AS char_count,
  CASE WHEN length(trim(text, E' \\t\\n\\r')) < 35 THEN 'OCR' ELSE 'DIGITAL_TEXT' END AS method FROM conversations""")
def page_stats(spark, sf):
    return ex.page_stats(_texts_as_pages(spark, sf)).select("doc_id", "page_num", "char_count", "method")


@query("classify_documents", """
SELECT doc_id, CASE WHEN contains(upper(text), 'DESPACHO NUMERO:') OR contains(upper(text), 'SISTEMA SOFIA')
    OR (contains(upper(text), 'FECHA OFIC:') AND contains(upper(text), 'ADUANA :')) THEN 'PARAGUAY_SOFIA'
  WHEN contains(upper(text), 'DUA') THEN 'DUA_CUSTOMS' WHEN contains(upper(text), 'BILL OF LADING') THEN 'BILL_OF_LADING'
  WHEN contains(upper(text), 'COMMERCIAL INVOICE') OR contains(upper(text), 'FACTURA COMERCIAL') THEN 'COMMERCIAL_INVOICE'
  ELSE 'GENERIC_CUSTOMS' END AS doc_type FROM documents""")
def classify_documents(spark, sf):
    return st.read_table(spark, sf, "documents").select("doc_id", text.document_type("text").alias("doc_type"))


@query("fields_of_other_text")
def fields_of_other_text(spark, sf):
    return ex.fields_to_header(ex.extract_fields(ex.page_stats(_texts_as_pages(spark, sf)))).select(
        "doc_id", "fields_found", "confidence", "doc_type")


@query("clean_text", """
SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(text, '\\*{2,}', '', 'g'),
  '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')), '') AS text
FROM documents""")
def clean_text(spark, sf):
    return st.read_table(spark, sf, "documents").select("doc_id", text.clean_text("text").alias("text"))


@query("parse_currency_roundtrip", "SELECT o_orderkey AS id, o_totalprice AS amount FROM orders")
def parse_currency_roundtrip(spark, sf):
    o = st.read_table(spark, sf, "orders")
    cents, key = st.cents("o_totalprice"), F.col("o_orderkey")
    shown = F.when(key % 3 == 0, sp.local_amount(cents)).when(key % 3 == 1, F.concat(F.lit("USD "), sp.us_amount(cents))).otherwise(
        F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0")))
    return o.select(key.alias("id"), shown.alias("shown")).select("id", numbers.parse_currency("shown").alias("amount"))


@query("parse_date_roundtrip", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders")
def parse_date_roundtrip(spark, sf):
    o = st.read_table(spark, sf, "orders")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    month = F.element_at(F.array(*[F.lit(m) for m in "ENE FEB MAR ABR MAYO JUN JULIO AGO SETIEMBRE OCT NOV DIC".split()]), F.month(day))
    forms = [F.date_format(day, f) for f in ("dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "d/M/yy", "dd-MM-yy")]
    named = F.concat_ws("-", F.date_format(day, "dd"), month, F.date_format(day, "yy"))
    shown = F.element_at(F.array(*forms, named), (key % 7 + 1).cast("int"))
    return o.select(key.alias("id"), shown.alias("shown")).select("id", parse_date("shown").alias("day"))


@query("check_duplicates", with_tables("""
SELECT id, CASE WHEN id % 3 = 0 THEN 'Archivo idéntico ya registrado previamente (ID: ' || id || ', Despacho: ' || number || ')'
    WHEN id % 3 = 1 AND date IS NOT NULL THEN 'Posible despacho ya registrado con mismo Nº ' || number || ', fecha y RUC (ID: ' || id || ')' END AS duplicate_reason,
  CASE WHEN id % 3 = 0 OR (id % 3 = 1 AND date IS NOT NULL) THEN id END AS existing_id FROM dispatches"""))
def check_duplicates(spark, sf):
    d = st.dispatches(spark, sf).select("id", "number", "date", "importer_doc", "file_hash")
    registered = d.withColumn("file_hash", F.when(F.col("id") % 3 == 0, F.col("file_hash")).otherwise(F.sha2(F.lower("number"), 256)))
    registered = registered.filter("id % 3 < 2")
    marked = joins.check_duplicates(d, registered, business_key=True)
    return marked.select("id", "duplicate_reason", "existing_id")


@query("match_file_to_dispatch", with_tables("""
SELECT file_name, id AS dispatch_id, CASE id % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'path' WHEN 2 THEN 'number' WHEN 3 THEN 'hash' END AS matched_by
FROM (SELECT id, CASE id % 4 WHEN 0 THEN file_name WHEN 1 THEN 'scan ' || id || '.pdf' WHEN 2 THEN lower(number) || ' copia.pdf'
  ELSE 'doc' || id || '.pdf' END AS file_name FROM dispatches)"""))
def match_file_to_dispatch(spark, sf):
    d = st.dispatches(spark, sf)
    key = F.col("id")
    stored = F.when(key % 4 == 1, F.concat(F.lit("uploads/2020/01/1579000000_0a1b2c3d_scan "), key.cast("string"), F.lit(".pdf")))
    registered = d.withColumn("stored_path", F.coalesce(stored, F.col("stored_path")))
    name = (F.when(key % 4 == 0, F.col("file_name")).when(key % 4 == 1, F.concat(F.lit(" scan "), key.cast("string"), F.lit(".pdf ")))
            .when(key % 4 == 2, F.concat(F.lower("number"), F.lit(" copia.pdf"))).otherwise(F.concat(F.lit("doc"), key.cast("string"), F.lit(".pdf"))))
    files = d.select(name.alias("file_name"), F.when(key % 4 == 3, F.col("file_hash")).alias("file_hash"))
    return joins.match_file_to_dispatch(files, registered).select("file_name", "dispatch_id", "matched_by")


@query("list_new_files", with_tables("SELECT 'new ' || number || 'X.pdf' AS file_name FROM dispatches WHERE id % 3 = 0"))
def list_new_files(spark, sf):
    d = st.dispatches(spark, sf)
    fresh = F.concat(F.lit("new "), "number", F.lit("X.pdf"))
    files = d.filter("id % 3 < 2").select(F.when(F.col("id") % 3 == 0, fresh).otherwise(F.col("file_name")).alias("file_name"))
    files = files.unionByName(d.filter("id % 3 = 2").select(F.concat(F.lit("bad"), F.col("id").cast("string")).alias("file_name")))
    failed = d.filter("id % 3 = 2").select(F.concat(F.lit("bad"), F.col("id").cast("string")).alias("file_name"))
    return joins.list_new_files(files, d, failed)


@query("storage_path", with_tables("""
SELECT id, 'uploads/' || strftime(created_at, '%Y/%m/') || CAST(epoch(created_at) AS BIGINT) || '_' || substr(file_hash, 1, 8) || '_' || file_name AS path
FROM dispatches"""))
def storage_path(spark, sf):
    return st.dispatches(spark, sf).select("id", docs.storage_path("file_name", "file_hash", "created_at").alias("path"))


@query("recover_cutoffs", with_tables("""
, lost AS (SELECT id, dispatch_id, item_no, subitem_no, 'Subítem ' || item_no || ' - Posición ' || coalesce(hs_code, 'S') AS cut FROM items),
last AS (SELECT l_orderkey AS dispatch_id, l_linenumber AS item_no, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_suppkey % 4 + 1 AS INTEGER) END AS subitem_no,
    max(upper(p_name) || '|' || l_partkey) AS best
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT lost.id, CASE WHEN lost.item_no % 2 = 0 THEN split_part(best, '|', 1) ELSE cut END AS description, lost.item_no % 2 = 0 AS recovered
FROM lost JOIN last ON lost.dispatch_id = last.dispatch_id AND lost.item_no = last.item_no AND lost.subitem_no IS NOT DISTINCT FROM last.subitem_no"""))
def recover_cutoffs(spark, sf):
    from portolan.operators.quality import recover_cutoffs as recover

    items = st.items(spark, sf)
    cut = items.withColumn("description", F.concat(F.lit("Subítem "), F.col("item_no").cast("string"), F.lit(" - Posición "), F.coalesce("hs_code", F.lit("S"))))
    name = F.regexp_replace("description", r" \d+ML$", "")
    again = items.select("dispatch_id", "item_no", "subitem_no", F.when(F.col("item_no") % 2 == 0, name).otherwise(F.lit("Subítem 1 - Posición S")).alias("description"),
                         "brand", "product_code", F.concat_ws("|", name, F.element_at(F.split("id", "-"), 3)).alias("seq"))
    return recover(cut.select("id", "dispatch_id", "item_no", "subitem_no", "description", "brand", "product_code"), again).select("id", "description", "recovered")
