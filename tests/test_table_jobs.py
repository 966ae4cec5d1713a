"""The table jobs keep their declared schemas, mark what cannot be read, and carry further columns along."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.plans import table_jobs as jobs


def kinds(df):
    return [(n, t) for n, t in df.dtypes]


def declared(schema):
    return [(f.name, f.dataType.simpleString()) for f in T._parse_datatype_string(schema).fields]


def test_headers(spark):
    rows = spark.createDataFrame(
        [(1, " N1 ", "10-AGO-26", "gafa s.a", "1.000,50", "100", "x", "1.100,50", 2000.0, "keep"), (2, None, "mañana", "**", None, None, None, "abc", None, None)],
        "id bigint, number string, date string, importer string, fob string, freight string, insurance string, cif string, items_value double, extra string",
    )
    out = jobs.normalize_headers(rows, "2026-09-01")
    assert kinds(out) == declared(jobs.HEADERS_OUT) + [("extra", "string")]
    one, two = out.orderBy("id").collect()
    assert (one.number, one.date, one.importer, one.fob, one.freight, one.insurance, one.cif, one.currency, one.extra) == ("N1", dt.date(2026, 8, 10), "GAFA S.A.", 2000.0, 100.0, None, 1100.5, "USD", "keep")
    assert one.unreadable == ["insurance"] and one.status == "REVISAR"
    assert (two.number, two.date, two.importer, two.fob, two.doc_type) == (None, None, None, None, "UNKNOWN") and two.unreadable == ["date", "cif"]
    assert jobs.normalize_headers(rows.filter("false"), "2026-09-01").count() == 0


def test_items(spark):
    rows = spark.createDataFrame(
        [("a", "6294015160734 ODYSSEY TYRANT - .", " armaf ", "2,00", None, "10,00", "x"), ("b", None, "***", "dos", "1,5", None, None)],
        "id string, description string, brand string, quantity string, unit_value string, total_value string, label string",
    )
    rules = spark.createDataFrame([("ARMAF", "Armaf")], "pattern string, target string")
    out = jobs.clean_items(rows, rules)
    assert kinds(out) == declared(jobs.ITEMS_OUT)
    a, b = out.orderBy("id").collect()
    assert (a.product_code, a.description, a.brand, a.quantity, a.unit_value, a.total_value) == ("6294015160734", "ODYSSEY TYRANT", "Armaf", 2.0, 5.0, 10.0)
    assert (a.family, a.label, a.unreadable) == ("Odyssey", "Armaf - ODYSSEY TYRANT", []) and (a.audit_confidence, len(a.issues)) == ("medium", 1)
    assert (b.description, b.product_code, b.quantity, b.unit_value, b.unreadable) == (None, None, None, 1.5, ["quantity"])


def test_sheet_rows(spark):
    rows = spark.createDataFrame(
        [(1, "45000", "N1", "gafa", "X 7840000000012 Y", None, "5", "1,50", None, None, "10%", "6"), (2, "pronto", None, None, None, "12345678.0", "n/a", None, None, "7", "x", None)],
        "id bigint, date string, number string, importer string, goods string, product_code string, quantity string, invoice_price string, normal_price string, total string, vat string, duty string",
    ).withColumn("row", F.lit(1))
    out = jobs.normalize_sheet_rows(rows)
    assert kinds(out) == declared(jobs.SHEET_ROWS_OUT) + [("row", "int")]
    one, two = out.orderBy("id").collect()
    assert (one.date, one.importer, one.product_code, one.quantity, one.line_total, one.vat_rate, one.duty_rate, one.unreadable) == (dt.date(2023, 3, 15), "GAFA S.A.", "7840000000012", 5.0, 7.5, 0.1, 0.06, [])
    assert (two.date, two.product_code, two.line_total, two.vat_rate) == (None, "12345678", 7.0, None) and two.unreadable == ["quantity", "vat", "date"]
