"""Extraction on small hand-written documents."""

import datetime as dt

from pyspark.sql import functions as F

from portolan.operators import extraction as ex
from portolan.operators.quality import recover_cutoffs
from portolan.plans.documents import process_documents

SCHEMA = "doc_id bigint, page_num int, text string, method string"

HEADER = """DESPACHO NUMERO: 26001IC04000123A HOJA 1 de 2
REGIMEN : ZF2I - IMPORTACION
ADUANA : 001 - CAPITAL FECHA OFIC: 10/08/2026 17:13:10
IMP./EXP : Gafa s.a AJUSTE 1
RUC/DOC : 80000000-1
VEND/COMP. ACME CORP FOB
DESP. JUAN PEREZ RUC 1
VALOR FOB USD 15.000,50
FLETE : 1.000,00 DOL
SEGURO FACTURA 200,00 DOL
VALOR CIF : 16.200,50
CANAL ASIGNADO
CANAL NARANJA
KILO NETO 1.234,000
MONEDA : DOL
TOTAL GENERAL.. 4.002.948.937"""

GOODS = """DESPACHO NUMERO: X HOJA 2 de 2
NRO ITEM: 1 POS.ARANC.:3303.00.10.000L SUB ITEM NRO: 1
CANTIDAD: 480.00 CANT.ESPEC.: 0 FOB: 9,460.80
MARCA: ARMAF OBSERVACION: 6294015160734 ODYSSEY TYRANT
NRO ITEM: 1 POS.ARANC.:3303.00.10.000L SUB ITEM NRO: 2
CANTIDAD: 0 CANT.ESPEC.: 0 FOB: 10.00
MARCA: ***
"""


def pages(spark, *texts, doc=1):
    return spark.createDataFrame([(doc, i + 1, t, "DIGITAL_TEXT") for i, t in enumerate(texts)], SCHEMA)


def test_header_fields(spark):
    row = ex.fields_to_header(ex.extract_fields(pages(spark, HEADER, GOODS))).first()
    assert (row.number, row.date, row.importer) == ("26001IC04000123A", dt.date(2026, 8, 10), "GAFA S.A.")
    assert (row.importer_doc, row.exporter, row.broker) == ("80000000-1", "ACME CORP", "JUAN PEREZ")
    assert (row.fob, row.freight, row.insurance, row.cif) == (15000.5, 1000.0, 200.0, 16200.5)
    assert (row.channel, row.currency, row.net_weight, row.total) == ("NARANJA", "USD", 1234.0, 4002948937.0)
    assert row.doc_type == "PARAGUAY_SOFIA" and row.page_count == 2 and row.confidence >= 0.85
    assert row.field_meta["fob"].page == 1 and row.field_meta["awb"].method == "NONE"


def test_first_page_and_first_pattern_win(spark):
    row = ex.fields_to_header(ex.extract_fields(pages(spark, "x", "DATE: 99/99/2026 FECHA REGISTRO: 01/02/2026", "FECHA OFIC: 10/08/2026"))).first()
    assert row.date == dt.date(2026, 2, 1)
    assert row.field_meta["date"].page == 2


def test_subitems_and_page_of_match(spark):
    split = GOODS.splitlines()
    rows = ex.extract_items(pages(spark, HEADER, "\n".join(split[:2]), "\n".join(split[2:]))).orderBy("seq").collect()
    assert [(r.item_no, r.subitem_no, r.page) for r in rows] == [(1, 1, 2), (1, 2, 3)]
    assert (rows[0].product_code, rows[0].brand, rows[0].description) == ("6294015160734", "ARMAF", "ODYSSEY TYRANT")
    assert (rows[0].quantity, rows[0].unit_value, rows[0].total_value) == (480.0, 19.71, 9460.8)
    assert (rows[1].brand, rows[1].unit_value) == ("Sin Marca", None)
    assert rows[1].description == "Subítem 2 - Posición 3303.00.10.000L"


def test_grid_block_rules(spark):
    text = "\n".join([
        "1/3 N 3303.00.20.000W", "2/3", "FOB FACTURA", "1.000,00", "DESCRIPCION", "FOB U$S", "PERFUME", "LATTAFA", "10", "UNIDAD", "900,00",
        "KILO NETO", "x", "5,500", "y",
        "3/3", "nothing", "here", "at all",
        "7/8 N 8517.13.00", "FOB FACTURA", "9.000.000,00", "SONY CABLE SONY", "4,00", "SET",
    ])
    rows = ex.extract_items(pages(spark, text)).orderBy("seq").collect()
    # 2/3 lies inside the kept block of 1/3, and 3/3 has nothing worth keeping.
    assert [r.item_no for r in rows] == [1, 7]
    first, last = rows
    assert (first.hs_code, first.description, first.brand, first.quantity) == ("3303.00.20.000W", "PERFUME", "LATTAFA", 10.0)
    assert (first.total_value, first.net_weight, first.unit_value) == (900.0, 5.5, 90.0)
    assert (last.total_value, last.quantity, last.unit) == (0.0, 4.0, "SET")


def test_grid_single_line_brand(spark):
    text = "\n".join(["1/1 N 8517.13.00", "CANTIDAD", "SONY CABLE SONY", "4,00", "SET", "80,00"])
    row = ex.extract_items(pages(spark, text)).first()
    assert (row.description, row.brand, row.total_value) == ("SONY CABLE", "SONY", 80.0)


def test_rescue_and_representative(spark):
    text = "VALOR: 1.234,56\n" + "x" * 150 + " 3303.00.10.000L FOB U$S 99,10 y 8517.13.00.000Y"
    rows = ex.extract_items(pages(spark, text)).orderBy("seq").collect()
    assert [(r.item_no, r.hs_code, r.total_value) for r in rows] == [(1, "3303.00.10.000L", 99.1), (2, "8517.13.00.000Y", 99.1)]
    plain = pages(spark, HEADER)
    items = ex.representative_items(ex.fields_to_header(ex.extract_fields(plain)), ex.extract_items(plain)).collect()
    assert len(items) == 1 and items[0].brand == "ACME CORP" and items[0].total_value == 15000.5


def test_headers_of_documents_without_items_suffice(spark):
    both = pages(spark, HEADER).withColumn("doc_id", F.lit("bare")).unionByName(pages(spark, GOODS).withColumn("doc_id", F.lit("goods")))
    found = ex.extract_items(both).select("doc_id").distinct()
    bare = ex.pages_without_items(both, found)
    assert {r.doc_id for r in bare.collect()} == {"bare"}
    few = ex.representative_items(ex.fields_to_header(ex.extract_fields(bare)), found).collect()
    assert few == ex.representative_items(ex.fields_to_header(ex.extract_fields(both)), ex.extract_items(both)).collect() and len(few) == 1


def test_documents_of_any_size_are_read(spark):
    large = pages(spark, GOODS + "\nx" * 30_000_000)
    assert ex.oversized_documents(large, max_mb=50).count() == 1
    assert ex.extract_items(large).count() == ex.extract_items(pages(spark, GOODS)).count() > 0


def test_page_lines(spark):
    df = pages(spark, " a \r\n\n\t \x0b b\fDESPACHO NUMERO: 1\nUSUARIO: x\nREGIMENES\n  \n")
    assert ex.drop_page_headers(df).first().text == "a\nb\nREGIMENES"


def test_process_documents(spark):
    files = spark.createDataFrame(
        [(1, "a.pdf", "h1", 10), (2, "b.pdf", "h2", 10), (3, "c.doc", "h3", 10), (4, "d.pdf", "h4", 10)],
        "doc_id bigint, file_name string, file_hash string, bytes bigint",
    )
    registered = spark.createDataFrame([(77, "N1", "h2")], "id bigint, number string, file_hash string")
    rules = spark.createDataFrame([("armaf", "ARMAF HOUSE")], "pattern string, target string")
    text = pages(spark, HEADER, GOODS).unionByName(pages(spark, HEADER, doc=2))
    out = process_documents(files, text, registered, rules, "2026-09-01")
    status = {r.doc_id: r.status for r in out["results"].collect()}
    assert status == {1: "PROCESADO", 2: "DUPLICADO", 3: "ERROR", 4: "ERROR"}
    assert {r.brand for r in out["items"].collect()} == {"ARMAF HOUSE", "Sin Marca"}
    assert {r.method for r in out["log"].collect()} == {"DIGITAL_TEXT", "DUPLICATE_CHECK", "ERROR"}


def test_recover_cutoffs_last_duplicate_wins(spark):
    items = spark.createDataFrame(
        [(1, 9, 1, None, "Subítem 1 - Posición X", "Sin Marca", None), (2, 9, 2, 1, "OK", "B", None)],
        "id int, dispatch_id int, item_no int, subitem_no int, description string, brand string, product_code string",
    )
    new = spark.createDataFrame(
        [(9, 1, None, "OLD", "A", "1", 0), (9, 1, None, "NEW", "Sin Marca", "2", 1), (9, 2, 1, "OTHER", "C", "3", 2)],
        "dispatch_id int, item_no int, subitem_no int, description string, brand string, product_code string, seq int",
    )
    rows = recover_cutoffs(items, new).orderBy("id").collect()
    assert [(r.description, r.brand, r.product_code, r.recovered) for r in rows] == [
        ("NEW", "Sin Marca", "2", True), ("OK", "B", None, False)
    ]


def test_fields_need_no_python(spark):
    plan = ex.extract_fields(pages(spark, HEADER))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and F is not None
