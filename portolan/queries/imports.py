"""Client sheets, valuation worksheets and the historical workbook."""

from pyspark.sql import functions as F

from portolan.functions import goods, numbers
from portolan.operators import aggregates as agg
from portolan.operators import brands as br
from portolan.operators import historical as hist
from portolan.operators import joins, search, sheets, windows
from portolan.queries.oracle_tables import with_tables
from portolan.queries.registry import query
from portolan.sources import sample_tables as st

_ROWS = """
, numbered AS (
  SELECT *, l_orderkey * 1000 + l_linenumber * 100
    + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS row_idx
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

_CLIENT = _ROWS + """
, client AS (
  SELECT 'sheet-' || (l_suppkey % 21) AS file_id, row_idx + 10 AS row_idx, l_quantity AS quantity,
    CASE l_suppkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN upper(p_name) || CASE WHEN l_partkey % 2 = 0 THEN ' LATTAFA' ELSE '' END
      ELSE upper(p_name) || ' HP' END AS goods,
    CASE l_suppkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'Lattafa' ELSE '' END ELSE 'Hp' END AS brand,
    CASE l_suppkey % 3 WHEN 0 THEN CAST(7840000000000 + l_partkey AS VARCHAR) WHEN 1 THEN CAST(l_partkey AS VARCHAR) ELSE 'K' || l_partkey END
      AS product_code,
    CAST(l_partkey % 5000 + 1 AS DOUBLE) / 100 AS invoice_price,
    CAST((l_partkey % 5000 + 1) * CAST(l_quantity AS BIGINT) AS DOUBLE) / 100 AS line_total,
    CASE WHEN l_suppkey % 3 = 1 THEN 'ok' ELSE '' END AS remark
  FROM numbered WHERE l_partkey % 17 <> 0)
"""


@query("import_client_sheet", with_tables(_CLIENT + """
SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY row_idx) AS INTEGER) AS position, invoice_price AS normal_price FROM client"""))
def import_client_sheet(spark, sf):
    known = br.registered_brands(st.items(spark, sf))
    return sheets.import_client_sheet(sheets.trim_cells(st.client_sheet_cells(spark, sf)), known)


@query("find_header_rows", with_tables("""
SELECT DISTINCT 'sheet-' || (l_suppkey % 21) AS file_id, 1 AS header_idx, CASE l_suppkey % 3
    WHEN 0 THEN 'Item|Descripción Mercadería|Marca|Cantidad|Peso kg|Precio Unit.|Total|Proforma 2024'
    WHEN 1 THEN 'Código|Descrição da Mercadoria|Quantidade|Valor Unitário|Valor Total|Observação|Columna 7|Proforma 2024'
    ELSE 'Description|Qty|Unit Price|SKU|Columna 5|Columna 6|Columna 7|Proforma 2024' END AS headers FROM lineitem"""))
def find_header_rows(spark, sf):
    found = sheets.find_header_rows(sheets.trim_cells(st.client_sheet_cells(spark, sf)))
    return found.select("file_id", "header_idx", F.array_join("headers", "|").alias("headers"))


@query("map_columns", with_tables("""
SELECT DISTINCT 'sheet-' || (l_suppkey % 21) AS file_id, CASE l_suppkey % 3
    WHEN 0 THEN 'brand=2 goods=1 invoice_price=5 product_code=0 quantity=3 total_price=6'
    WHEN 1 THEN 'goods=1 invoice_price=3 product_code=0 quantity=2 remark=5 total_price=4'
    ELSE 'goods=0 invoice_price=2 product_code=3 quantity=1' END AS columns FROM lineitem"""))
def map_columns(spark, sf):
    found = sheets.map_columns(sheets.find_header_rows(sheets.trim_cells(st.client_sheet_cells(spark, sf))))
    pairs = F.transform(F.map_entries("columns"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return found.select("file_id", F.array_join(F.array_sort(pairs), " ").alias("columns"))


@query("markdown_tables", with_tables("""
SELECT l_orderkey AS file_id, l_linenumber AS line, upper(p_name) AS name, CAST(l_quantity AS INTEGER) AS quantity
FROM lineitem JOIN part ON l_partkey = p_partkey"""))
def markdown_tables(spark, sf):
    lines = st.read_table(spark, sf, "lineitem").join(
        st.read_table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    text = F.concat(
        F.lit("intro\n| --- | :-: |\n|  | |\n| "), F.col("l_linenumber").cast("string"), F.lit(" | "), F.upper("p_name"), F.lit(" |"),
        F.col("l_quantity").cast("int").cast("string"), F.lit(" |\r\n| open"))
    cells = sheets.markdown_tables_to_cells(lines.select(F.col("l_orderkey").alias("file_id"), text.alias("text")))
    return cells.select("file_id", F.col("cells")[0].cast("int").alias("line"), F.col("cells")[1].alias("name"),
                        F.col("cells")[2].cast("int").alias("quantity"))


@query("delimited_cells", with_tables("""
, rows AS (
  SELECT p_partkey, upper(p_name) AS name, p_brand, CAST(p_size AS VARCHAR) AS size,
    CASE p_partkey % 3 WHEN 0 THEN ';' WHEN 1 THEN chr(9) ELSE ',' END AS sign, repeat(p_type || ' ', 40) AS long FROM part)
SELECT p_partkey AS file_id, 0::BIGINT AS row_idx, 'a|b|c' AS cells FROM rows
UNION ALL SELECT p_partkey, 2, name || '|' || p_brand || ', "x"; y|' || size FROM rows
UNION ALL SELECT p_partkey, 3, 'TV ' || size || '" LED|' || size || '|1' FROM rows
UNION ALL SELECT p_partkey, 4, 'MONITOR ' || size || '" HP|"|2' FROM rows
UNION ALL SELECT p_partkey, 5, 'two' || chr(10) || 'lines' || sign || ' end tail|' || trim(long) || '|3' FROM rows
UNION ALL SELECT p_partkey, 6, 'last|open ' || size || chr(10) || 'to the end' FROM rows"""))
def delimited_cells(spark, sf):
    # The work per byte is heavy: dealt out by a named number, it is not bound to the few splits of a small file.
    part = st.read_table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    sign = F.when(key % 3 == 0, ";").when(key % 3 == 1, "\t").otherwise(",")
    quoted = F.concat(F.lit('"'), F.col("p_brand"), F.lit(', ""x""; y"'))
    rows = [
        ("\r\n", F.lit("a"), F.lit("b"), F.lit("c")), ("\n", F.lit(" "), F.lit(""), F.lit("")), ("\n", F.concat(F.lit(" "), F.upper("p_name")), quoted, size),
        ("\r\n", F.concat(F.lit("TV "), size, F.lit('" LED')), size, F.lit("1")), ("\r", F.concat(F.lit("MONITOR "), size, F.lit('" HP')), F.lit('""""'), F.lit("2")),
        ("\n", F.concat(F.lit('"two\nlines'), sign, F.lit(' end" tail')), F.repeat(F.concat("p_type", F.lit(" ")), 40), F.lit("3")),
        ("", F.lit("last"), F.concat(F.lit('"open '), size, F.lit("\nto the end"))),
    ]
    joined = lambda cells: F.concat(*[x for c in cells for x in (sign, c)][1:])
    text = F.concat(*(F.concat(joined(cells), F.lit(end)) for end, *cells in rows))
    cells = sheets.delimited_to_cells(part.select(key.alias("file_id"), text.alias("text")))
    return cells.select("file_id", "row_idx", F.array_join("cells", "|").alias("cells"))


_HISTORY = _ROWS + """
, cells AS (
  SELECT *, CAST(o_orderdate AS DATE) AS day, l_linenumber <= 2 AS keyed FROM numbered JOIN orders ON o_orderkey = l_orderkey),
filled AS (
  SELECT *, last_value(CASE WHEN keyed THEN day END IGNORE NULLS) OVER w AS date,
    last_value(CASE WHEN keyed THEN printf('H%07d', l_orderkey // 2) END IGNORE NULLS) OVER w AS number,
    last_value(CASE WHEN keyed THEN 'CASA ' || (o_custkey % 97) END IGNORE NULLS) OVER w AS importer
  FROM cells WINDOW w AS (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
usable AS (SELECT * FROM filled WHERE year(date) <= 1999 AND number IS NOT NULL AND importer IS NOT NULL),
groups AS (SELECT number, date, importer, min(row_idx) AS first_row FROM usable GROUP BY ALL),
firsts AS (SELECT number, date, arg_min(importer, first_row) AS importer FROM groups GROUP BY ALL),
wanted AS (SELECT * FROM firsts WHERE CAST(substr(number, 2) AS BIGINT) % 5 <> 0),
history AS (
  SELECT u.*, CAST(row_number() OVER (PARTITION BY u.number, u.date, u.importer ORDER BY row_idx) AS INTEGER) AS item_no,
    CAST(1000 + l_quantity AS DOUBLE) AS quantity, CAST(l_partkey % 50 + 1 AS DOUBLE) AS unit_value,
    CASE WHEN l_partkey % 3 = 0 THEN (1000 + l_quantity) * (l_partkey % 50 + 1) ELSE CAST(l_partkey AS DOUBLE) + CAST(0.25 AS DOUBLE) END AS total_value
  FROM usable u JOIN wanted w ON u.number = w.number AND u.date = w.date AND u.importer = w.importer)
"""


def _history(spark, sf):
    rows = st.historical_rows(spark, sf)
    o = st.read_table(spark, sf, "orders")
    registered = o.filter(F.floor(F.col("o_orderkey") / 2) % 5 == 0).select(
        F.format_string("H%07d", F.floor(F.col("o_orderkey") / 2)).alias("number"), F.to_date("o_orderdate").alias("date"))
    # Rows without a key of their own can carry any earlier one, so both dates of a number are registered.
    return hist.import_historical(rows, registered, 1999)


@query("forward_fill", with_tables(_HISTORY + "SELECT row_idx, date, number, importer FROM filled"))
def forward_fill(spark, sf):
    return hist.filled_rows(st.historical_rows(spark, sf)).select("row_idx", "date", "number", "importer")


@query("historical_dispatches", with_tables(_HISTORY + """
SELECT number, date, importer, round(sum(total_value), 2) AS fob, count(*) AS items,
  nullif(coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN l_suppkey % 6 <> 0 THEN 'PAIS ' || (l_suppkey % 4) END)
    FILTER (l_suppkey % 6 <> 0)), ', '), ''), '') AS origin,
  sha256('HISTORICO_' || year(date) || '_' || number || '_' || importer || '_'
    || regexp_replace(regexp_replace(printf('%.6f', round(sum(total_value), 2)), '0+$', ''), '\\.$', '.0')) AS file_hash
FROM history GROUP BY number, date, importer"""))
def historical_dispatches(spark, sf):
    return _history(spark, sf)[0].select("number", "date", "importer", "fob", "items", "origin", "file_hash")


@query("historical_items", with_tables(_HISTORY + """
SELECT number, date, importer, row_idx, item_no, CASE WHEN l_partkey % 7 <> 0 THEN '3303.00' END AS hs_code,
  CASE WHEN l_partkey % 4 = 0 THEN CAST(7840000000000 + l_partkey AS VARCHAR) END AS product_code,
  CASE WHEN l_partkey % 5 <> 0 THEN p_brand END AS brand, quantity, unit_value, total_value,
  CAST(CASE WHEN l_partkey % 2 = 0 THEN 0.1 ELSE 0.05 END AS DOUBLE) AS vat_rate,
  CAST(CASE WHEN l_partkey % 2 = 0 THEN 0.06 END AS DOUBLE) AS duty_rate FROM history"""))
def historical_items(spark, sf):
    return _history(spark, sf)[1].select(
        "number", "date", "importer", "row_idx", "item_no", "hs_code", "product_code", "brand", "quantity", "unit_value", "total_value",
        "vat_rate", "duty_rate")


@query("number_items", with_tables(_ROWS + """
SELECT l_orderkey, row_idx, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY row_idx) AS INTEGER) AS position FROM numbered"""))
def number_items(spark, sf):
    rows = st.read_table(spark, sf, "lineitem").withColumn("row_idx", st._row_idx()).select("l_orderkey", "row_idx")
    return windows.number_rows(rows, ["l_orderkey"], "row_idx", "position", chunk_rows=250)


@query("first_per_key", with_tables(_ROWS + """
SELECT l_suppkey, arg_min(l_orderkey, row_idx) AS l_orderkey, min(row_idx) AS row_idx FROM numbered GROUP BY l_suppkey"""))
def first_per_key(spark, sf):
    rows = st.read_table(spark, sf, "lineitem").withColumn("row_idx", st._row_idx()).select("l_suppkey", "l_orderkey", "row_idx")
    return windows.first_per_key(rows, ["l_suppkey"], [F.col("row_idx")])


def sample_sheets(spark, sf):
    """One worksheet per order."""
    d = st.dispatches(spark, sf)
    return d.select(
        "id", F.col("number").alias("dispatch_number"), F.concat(F.lit("INV-"), F.col("id").cast("string")).alias("invoice"), "importer", "owner",
        F.col("date").alias("issue_date"), F.when(F.col("id") % 2 == 0, "FINIQUITADO").otherwise("BORRADOR").alias("status"),
        F.col("fob").alias("grand_total"), F.col("created_at").alias("updated_at"))


def sample_sheet_items(spark, sf):
    lines = st.items(spark, sf)
    return lines.select(
        F.col("dispatch_id").alias("sheet_id"), F.col("id").alias("catalog_item_id"), "quantity", F.col("description").alias("goods"), "brand",
        F.col("item_no").cast("double").alias("invoice_price"),
        F.when(F.col("item_no") % 2 == 0, F.lit(0.0)).otherwise(F.col("item_no") + F.lit(0.5)).alias("normal_price"),
        F.when(F.col("item_no") % 3 == 0, F.col("total_value")).otherwise(F.lit(0.0)).alias("line_total"))


_SHEETS = """
, sheets AS (
  SELECT id, number AS dispatch_number, 'INV-' || id AS invoice, importer, owner, date AS issue_date,
    CASE WHEN id % 2 = 0 THEN 'FINIQUITADO' ELSE 'BORRADOR' END AS status, fob AS grand_total, updated_at FROM dispatches),
lines AS (
  SELECT dispatch_id AS sheet_id, id AS catalog_item_id, quantity, CAST(item_no AS DOUBLE) AS invoice_price,
    CASE WHEN item_no % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE item_no + CAST(0.5 AS DOUBLE) END AS normal_price,
    CASE WHEN item_no % 3 = 0 THEN total_value ELSE CAST(0 AS DOUBLE) END AS given FROM items),
priced AS (
  SELECT *, CASE WHEN given <> 0 THEN given WHEN normal_price > 0 THEN quantity * normal_price ELSE quantity * invoice_price END AS line_total FROM lines)
"""


@query("search_sheets", with_tables(_SHEETS + """
SELECT id, invoice, importer, status FROM sheets WHERE (lower(dispatch_number) LIKE '%17%' OR lower(invoice) LIKE '%17%'
  OR lower(importer) LIKE '%17%' OR lower(owner) LIKE '%17%') AND status = 'BORRADOR' AND lower(importer) LIKE '%customer#0%'"""))
def search_sheets(spark, sf):
    found = search.search_sheets(sample_sheets(spark, sf), q="17", status="BORRADOR", importer="customer#0")
    return search.order_sheets(found).select("id", "invoice", "importer", "status")


@query("sheet_kpis", with_tables(_SHEETS + """
SELECT count(*) AS sheets, count(*) FILTER (status = 'FINIQUITADO') AS closed, count(*) FILTER (status = 'BORRADOR') AS drafts,
  round(sum(grand_total), 2) AS grand_total, count(DISTINCT importer) AS importers FROM sheets"""))
def sheet_kpis(spark, sf):
    return agg.sheet_kpis(sample_sheets(spark, sf))


@query("sheet_totals", with_tables(_SHEETS + """
SELECT sheet_id, round(sum(quantity), 2) AS total_quantity, round(sum(quantity * invoice_price), 2) AS total_invoice,
  round(sum(quantity * normal_price), 2) AS total_normal, round(sum(line_total), 2) AS grand_total FROM priced GROUP BY 1"""))
def sheet_totals(spark, sf):
    lines = sample_sheet_items(spark, sf)
    total = numbers.line_total("quantity", "invoice_price", "normal_price", "line_total")
    return agg.sheet_totals(lines.withColumn("line_total", total))


_NEW_SHEETS = """
, fresh AS (SELECT id, CAST(round(sum(line_total), 2) AS DOUBLE) AS grand_total, count(sheet_id) AS n FROM sheets LEFT JOIN priced ON sheet_id = id GROUP BY id)
"""


def _saved(spark, sf):
    heads, lines = sample_sheets(spark, sf), sample_sheet_items(spark, sf)
    edited = heads.filter("id % 4 = 1").select(
        "id", "dispatch_number", F.concat(F.lit(" "), "invoice").alias("invoice"), "importer", "owner",
        F.when(F.col("id") % 8 == 1, "2020-02-30").otherwise("2020-02-28").alias("issue_date"), F.lit("").alias("status"))
    lines = lines.withColumn("line_total", numbers.line_total("quantity", "invoice_price", "normal_price", "line_total"))
    new_lines = sample_sheet_items(spark, sf).join(edited.select(F.col("id").alias("sheet_id")), "sheet_id", "left_semi")
    return sheets.save_sheets(heads, lines, edited, new_lines, "2020-05-05")


@query("save_sheets", with_tables(_SHEETS + _NEW_SHEETS + """
SELECT s.id, s.invoice, CASE WHEN s.id % 4 <> 1 THEN issue_date WHEN s.id % 8 = 1 THEN DATE '2020-05-05' ELSE DATE '2020-02-28' END AS issue_date,
  CASE WHEN s.id % 4 <> 1 THEN status ELSE 'BORRADOR' END AS status,
  CASE WHEN s.id % 4 <> 1 THEN s.grand_total ELSE coalesce(fresh.grand_total, 0) END AS grand_total FROM sheets s JOIN fresh ON fresh.id = s.id"""))
def save_sheets(spark, sf):
    return _saved(spark, sf)[0].select("id", "invoice", "issue_date", "status", "grand_total")


@query("save_sheet_lines", with_tables(_SHEETS + "SELECT sheet_id, catalog_item_id, line_total FROM priced"))
def save_sheet_lines(spark, sf):
    return _saved(spark, sf)[1].select("sheet_id", "catalog_item_id", "line_total")


@query("delete_sheets", with_tables(_SHEETS + "SELECT sheet_id, catalog_item_id FROM lines WHERE sheet_id % 5 <> 0"))
def delete_sheets(spark, sf):
    heads, lines = sample_sheets(spark, sf), sample_sheet_items(spark, sf)
    return sheets.delete_sheets(heads, lines, heads.filter("id % 5 = 0").select("id"))[1].select("sheet_id", "catalog_item_id")


@query("items_used_in_sheets", with_tables(_SHEETS + "SELECT id FROM items"))
def items_used_in_sheets(spark, sf):
    return joins.items_used_in_sheets(st.items(spark, sf), sample_sheet_items(spark, sf)).select("id")


@query("unit_price_and_label", with_tables("""
SELECT id, CASE WHEN coalesce(unit_value, 0) <> 0 THEN unit_value
    ELSE CAST(round(CAST(CAST(total_value / quantity AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE) END AS price,
  CASE WHEN coalesce(brand, '') = '' THEN description ELSE brand || ' - ' || description END AS label FROM items"""))
def unit_price_and_label(spark, sf):
    return st.items(spark, sf).select(
        "id", numbers.unit_price("unit_value", "quantity", "total_value").alias("price"), goods.goods_label("brand", "description").alias("label"))
