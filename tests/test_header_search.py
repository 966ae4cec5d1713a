"""Header fields: pages behind the one that has the value are not searched, values are worked out once."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from portolan.functions import dates, numbers, text
from portolan.operators import extraction as ex

SCHEMA = "doc_id bigint, page_num int, text string, method string"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_behind_the_found_one_are_not_searched(spark):
    fields = ex.extract_fields(spark.createDataFrame([(1, 1, "x", "X")], SCHEMA))
    plan = optimized(fields)
    # one pass over the pages of a document, which keeps what it has, and no reduction of the records of all pages
    assert "aggregate(" in plan and "collect_list" in plan


def test_pages_with_one_number_or_none_give_the_least_record(spark):
    rows = [
        (1, 2, "VALOR FOB USD 2,00", "X"), (1, 2, "VALOR FACTURA\n9,00", "X"), (1, 3, "FLETE : 1,00", "X"),
        (2, 1, "VALOR FOB USD 5,00", "X"), (2, None, "VALOR FOB USD 7,00", "X"), (2, None, "VALOR FOB USD 6,00", "OCR"),
        (None, 1, None, None), (None, 4, "TOTAL GENERAL.. 8", None),
    ]
    got = {r.doc_id: r for r in ex.extract_fields(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].fob.raw, got[1].fob["rank"], got[1].freight.page) == ("9,00", 0, 3)
    assert (got[2].fob.raw, got[2].fob.page, got[2].extraction_method) == ("6,00", None, "MIXTO")
    assert (got[None].total.raw, got[None].total.method, got[None].doc_type, got[None].page_count) == ("8", "TEXT", "UNKNOWN", 2)


def test_what_takes_work_is_written_once(spark):
    one = spark.range(1).select(F.col("id").cast("string").alias("t"))
    label = "RUC[/]DOC"
    assert optimized(one.select(text.normalize_document("t").alias("d"))).count(label) == 1
    fields = ex.extract_fields(spark.createDataFrame([(1, 1, "x", "X")], SCHEMA))
    assert optimized(fields).count(r"(?iumdU)DESPACHO\s+NUMERO\s*:\s*([A-Z0-9]+), 0") == 1


def _amount(t):
    """What parse_currency reads, sign by sign."""
    m = re.search(r"[-+]?[0-9.,]+", re.sub(r"[A-Za-z$€|]", "", t))
    s = m[0] if m else ""
    if "." in s and "," in s:
        mark = max(".,", key=s.rfind)
        s = "" if s.count(mark) > 1 else s.replace(".," .replace(mark, ""), "")
    for mark in ".,":
        s = s.replace(mark, "." if s.count(mark) == 1 else "")
    return float(s) if re.fullmatch(r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)", s) else None


def test_amounts_written_the_usual_way(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("0123456789.,.,") for _ in range(draw.randrange(1, 9))) + draw.choice(["", "", "", "\n", " x"]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", numbers.parse_currency("t").alias("v"))
    got = {r.i: r.v for r in df.collect()}
    assert {i: got[i] for i in got} == {i: _amount(t) for i, t in enumerate(texts)}


def test_dates_written_the_usual_way(spark):
    cases = {
        "25/01/2000 17:13:10": dt.date(2000, 1, 25), "5-6-2001": dt.date(2001, 6, 5), "5/6-2001": None, "31/02/2001": None, "1/1/0000": None,
        "05/06/2001 ": dt.date(2001, 6, 5), "05/06/20011": dt.date(2001, 6, 5), "5/6/2001 x": dt.date(2001, 6, 5), "10-AGO-26": dt.date(2026, 8, 10), "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", dates.parse_date("t").alias("d"))
    assert {r.t: r.d for r in df.collect()} == cases
