"""Value tables for the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from portolan.functions import dates, goods, hs, numbers, text


def values(spark, rows, fn):
    """Apply a column function to one column of texts, keeping the row order."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.select(fn(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def check(spark, table, fn):
    inputs, expected = zip(*table)
    assert values(spark, inputs, fn) == list(expected)


D = dt.date(2026, 8, 10)


def test_parse_date(spark):
    check(spark, [
        ("10/08/2026 17:13:10", D), ("10/08/2026", D), ("10-08-2026", D), ("2026-08-10", D), ("2026/08/10", D),
        ("10-AUG-26", D), ("10-AGO-2026", D), ("10/08/26", D), ("10-08-26", D),
        ("10-AUG-70", dt.date(1970, 8, 10)), ("10/08/68", dt.date(2068, 8, 10)), ("10/08/69", dt.date(1969, 8, 10)),
        ("31/02/2026", None), ("invalido", None), (None, None), ("", None), ("5/1/2026", dt.date(2026, 1, 5)),
        ("00/01/2026", None), ("12-XYZ-2026", None), ("FECHA: 10/08/2026 x", D),
    ], dates.parse_date)


def test_parse_sheet_date(spark):
    check(spark, [
        ("2019", dt.date(2019, 1, 1)), ("45000", dt.date(2023, 3, 15)), ("10/08/205", dt.date(2025, 8, 10)),
        ("10-08-206", dt.date(2026, 8, 10)), ("2026-08-10 00:00:00", D), ("x", None), (None, None),
    ], dates.parse_sheet_date)


def test_parse_currency(spark):
    check(spark, [
        ("1.234,56", 1234.56), ("668.385,25", 668385.25), ("3.000,00", 3000.0), ("1.103,50", 1103.5),
        ("19.196,000", 19196.0), ("1,234.56", 1234.56), ("USD 12,500.00", 12500.0), ("9,460.80", 9460.8),
        ("4.002.948.937", 4002948937.0), ("573.559.833", 573559833.0), (None, None), ("", None),
        ("1,234", 1.234), ("Gs. 75.000.000", None), ("1234", 1234.0), ("-5,5", -5.5), ("1,2,3", 123.0),
        ("..", None), ("abc", None), ("12,3456", 12.3456), ("1.", 1.0), ("1.5d", 1.5),
    ], numbers.parse_currency)
    check(spark, [("Gs. 75.000.000", 75000000.0)], lambda c: numbers.parse_currency(c, lenient=True))


def test_parse_numeric(spark):
    check(spark, [
        (None, 0.0), ("", 0.0), ("$ 1,234.50", 1234.5), ("1.234,5", 1234.5), ("1,5", 1.5), ("1,234", 1234.0),
        ("1." + "0" * 70 + ",5", 1e70 + 0.5), ("1,5.2,25", 1.52), ("abc 12.5 kg", 12.5), ("none", 0.0), ("R$ 10", 10.0), ("12.0", 12.0), ("1e3", 1000.0), ("1,", 1.0),
    ], numbers.parse_numeric)


def test_plain_text(spark):
    check(spark, [(1e-7, "0.0000001"), (0.1234567, "0.1234567"), (5.0, "5.0"), (-1234567.25, "-1234567.25"), (1e18, "1000000000000000000.0"), (0.0, "0.0"), (1e30, "1.0E30"), (None, None)], numbers.plain_text)
    check(spark, [(float("nan"), "NaN"), (float("inf"), "Infinity"), (float("-inf"), "-Infinity"), (-0.0, "0.0"), (1e19, "1.0E19")], numbers.plain_text)


def test_sheet_numbers(spark):
    check(spark, [("1,234.5", 1234.5), ("x", 0.0), (None, 0.0)], numbers.clean_num)
    check(spark, [("6", 0.06), ("0.1", 0.1), ("1.5%", 0.015), ("1", 1.0), ("x", None)], numbers.parse_tax_pct)


def test_documents_and_companies(spark):
    check(spark, [
        ("RUC: 80000000-1", "80000000-1"), ("RUC/DOC : 800000001", "800000001"),
        ("CNPJ : 12.345.678/0001-90", "12.345.678/0001-90"), (None, None), ("RUC:", None),
    ], text.normalize_document)
    check(spark, [
        ("Gafa s.a", "GAFA S.A."), ("GAFA", "GAFA S.A."), ("H.T s.a", "H.T. S.A."), ("HT S.A", "H.T. S.A."),
        ("Gafas Sol", "GAFAS SOL"), (None, None), ("otra  empresa", "OTRA EMPRESA"),
    ], text.normalize_company)


def test_clean_text(spark):
    check(spark, [
        ("  ACME   S.A  ", "ACME S.A"), ("VALOR ********** IMPONIBLE", "VALOR IMPONIBLE"), (None, None),
        ("a b\n\tc", "a b c"), ("***", None), ("*", "*"),
    ], text.clean_text)


def test_title_case(spark):
    samples = ["x2pro max", "L'OREAL", "ñandú 3d-print", "AL HARAMAIN", ""]
    assert values(spark, samples, text.title_case) == [s.title() for s in samples]


def test_brand_skeleton(spark):
    check(spark, [
        ("Life Pod", "LIFEPOD"), ("LIFE-POD Inc.", "LIFEPOD"), ("Lattafa Perfumes", "LATTAFA"),
        ("Estée Lauder", "ESTEELAUDER"), (None, ""), ("CO", ""), ("COCO", "COCO"),
    ], text.brand_skeleton)


def test_file_number_and_header(spark):
    check(spark, [
        ("26001ic04000123a.pdf", "26001IC04000123A"), ("x 26ZA000000123 y.pdf", "26ZA000000123"), ("abc.pdf", None),
    ], text.number_from_filename)
    check(spark, [("Descrição_da\nMercadoria:", "descricao da mercadoria"), (" P. Unit ", "p. unit"), (None, "")], text.clean_header)


def test_document_type(spark):
    check(spark, [
        ("despacho numero: 1", "PARAGUAY_SOFIA"), ("FECHA OFIC: x ADUANA : y", "PARAGUAY_SOFIA"),
        ("Texto de aduana", "DUA_CUSTOMS"), ("Bill of lading", "BILL_OF_LADING"),
        ("Factura comercial", "COMMERCIAL_INVOICE"), ("hola", "GENERIC_CUSTOMS"), (None, "UNKNOWN"),
    ], text.document_type)


def test_hs(spark):
    df = spark.createDataFrame(
        [("3303.00.10.000L",), ("8517.13.00",), ("85171300",), ("9999",), (None,), ("3307.9",), ("0101.21.00",)], "hs_code string"
    )
    got = {r.hs_code: (r.hs_short, r.hs_label, r.hs_display) for r in hs.enrich_hs(df).collect()}
    assert got["3303.00.10.000L"] == ("3303.00.10", "Perfumes y aguas de tocador", "3303.00.10 (Perfumes y aguas de tocador)")
    assert got["8517.13.00"][1] == "Smartphones / Teléfonos móviles"
    assert got["85171300"][0] == "8517.13.00"
    assert got["9999"][:2] == ("9999", "Mercancías diversas")
    assert got[None] == ("", "Sin Clasificar", "Sin NCM asignado")
    assert got["3307.9"][:2] == ("3307.9", "Artículos de tocador y desodorantes")
    assert got["0101.21.00"][1] == "Animales vivos"


OBSERVATIONS = [
    ("ODYSSEY TYRANT (M)EDP SP 3.4OZ 6294015160734", "", "6294015160734", "ODYSSEY TYRANT (M)EDP SP 3.4OZ"),
    ("6295199818459 L-ARMAF ODYSSEY PINK POP 3.4 EDP SPR", "ARMAF", "6295199818459", "ODYSSEY PINK POP 3.4 EDP SPR"),
    ("I0095135 ARMAF ODYSSEY TYRANT (M)EDP SP 3.4OZ 6294015160734", "ARMAF", "6294015160734",
     "ARMAF ODYSSEY TYRANT (M)EDP SP 3.4OZ"),
    ("RETINOL 0.3% + NIACIN RENEWING SERUM 30ML COD: ITEM NRO.5", "", "", "RETINOL 0.3% + NIACIN RENEWING SERUM 30ML"),
    ("LOS DEMAS EN: 7.000 UNIDADES KHAMRAH 200ML SPRAY CORPORAL", "LATTAFA", "", "KHAMRAH 200ML SPRAY CORPORAL"),
    ("LOS DEMÁS EN 500 KILOS HARINA DE TRIGO ESPECIAL", "", "", "HARINA DE TRIGO ESPECIAL"),
    ("UNIDADES DE RED ACNE BODY WASH 2.0 ITEM: PMEKR55005R04", "MEDICUBE", "PMEKR55005R04", "RED ACNE BODY WASH 2.0"),
    ("2.016-UNIDADES RASASI HAWAS BLACK 100ML (331033)", "RASASI", "", "RASASI HAWAS BLACK 100ML (331033)"),
    ("ARMAF - CLUB DE NUIT", "ARMAF", "", "CLUB DE NUIT"),
    ("", "", "", ""),
    (None, None, "", ""),
    ("HOJA 8 de 11 FECHA OFIC: 10/08/2026 17:13:10 PERFUME X", "", "", "PERFUME X"),
]


def test_split_observation(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(OBSERVATIONS)], "i int, raw string, brand string, c string, d string")
    out = goods.split_observation(df, "raw", "brand", "code", "name").orderBy("i").collect()
    for r in out:
        assert (r.code, r.name) == (r.c, r.d), r.raw


@pytest.mark.parametrize(
    "description, confidence, issue, suggestion, code",
    [
        ("PERFUME LATTAFA ASAD EDP 100ML SPRAY", "none", None, "PERFUME LATTAFA ASAD EDP 100ML SPRAY", ""),
        ("Subítem 31 - Posición 8517.13.00.000Y", "cutoff", "Corte", "Subítem 31 - Posición 8517.13.00.000Y", ""),
        ("SMARTPHONE GALAXY S24 ULTRA 512GB - REF. SM-S928B", "high", "Código/SKU", "SMARTPHONE GALAXY S24 ULTRA 512GB", "SM-S928B"),
        ("HOJA 4 de 12 FECHA OFIC: 10/08/2026 AURICULARES INALAMBRICOS PRO", "high", "encabezado", "AURICULARES INALAMBRICOS PRO", ""),
        ("TELEVISOR SMART TV 55 PULGADAS 4K UHD - .", "medium", "Residuos", "TELEVISOR SMART TV 55 PULGADAS 4K UHD", ""),
    ],
)
def test_diagnose(spark, description, confidence, issue, suggestion, code):
    df = spark.createDataFrame([(description, None, None)], "description string, brand string, product_code string")
    row = goods.diagnose(df).first()
    assert row.audit_confidence == confidence
    assert row.is_clean == (issue is None)
    assert row.needs_source == (confidence == "cutoff")
    assert (row.suggested_description, row.suggested_code) == (suggestion, code)
    assert issue is None or any(issue in i for i in row.issues)


def test_variants(spark):
    df = spark.createDataFrame(
        [("PERFUME LATTAFA ASAD BOURBON EDP 100ML", "Lattafa"), ("AGUA DE TOILETTE", None), (None, "X"),
         ("LATTAFA BADEE AL OUD HONOR GLORY 100 ML", "LATTAFA"), ("ASAD", "LATTAFA"), ("(EDP) 100", "A+B")],
        "d string, b string",
    )
    got = [r.n for r in df.select(goods.variant_name("d", "b").alias("n")).collect()]
    assert got == ["Asad Bourbon", "Agua De Toilette", "Línea General", "Badee Al Oud", "Asad", "Edp  100"]
    named = spark.createDataFrame([("Asad Bourbon",), ("Asad",), ("Badee Al Oud Honor Glory",), ("Badee Al Oud",), ("Asad Spray Set",)], "n string")
    rows = [tuple(r.s) for r in named.select(goods.family_variant("n").alias("s")).collect()]
    assert rows == [
        ("Asad", "Bourbon", "ASAD BOURBON"), ("Asad", "Original / Clásico", "ASAD"),
        ("Badee Al Oud", "Honor Glory", "BADEE AL OUD HONOR"), ("Badee Al Oud", "Original / Clásico", "BADEE AL OUD"),
        ("Asad", "Original / Clásico", "ASAD"),
    ]
