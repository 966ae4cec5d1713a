"""Extraction grows with the text: block starts close together, amounts around codes, documents of very many blocks."""

import random
import re
import time

from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.operators import extraction as ex


def pages_of(spark, texts):
    return spark.createDataFrame([(d, 1, t) for d, t in texts.items()], "doc_id bigint, page_num int, text string")


def test_starts_near_a_kept_one_are_skipped(spark):
    draw = random.Random(2)
    cases = [sorted(draw.sample(range(40), draw.randrange(1, 30))) for _ in range(200)]
    df = spark.createDataFrame([(i, [(a,) for a in c]) for i, c in enumerate(cases)], "i int, c array<struct<at:int>>")
    got = {r.i: [x.at for x in r.k] for r in df.select("i", ex._first_come_blocks(F.col("c")).alias("k")).collect()}
    for i, case in enumerate(cases):
        kept = []
        for at in case:
            if not kept or at > kept[-1] + 2:
                kept.append(at)
        assert got[i] == kept


def test_amounts_around_codes(spark):
    draw = random.Random(6)
    code = lambda: f"{draw.randrange(1000, 9999)}.{draw.randrange(10, 99)}.{draw.randrange(10, 99)}.{draw.randrange(100, 999)}{draw.choice(['', 'X'])}"
    filler = lambda: draw.choice([" ", "\n", " word " * draw.randrange(60), f" FOB U$S {draw.randrange(1, 999)},{draw.randrange(10, 99)} ", " VALOR: 1.234,50 "])
    texts = {i: "".join(filler() + " " + code() for _ in range(draw.randrange(1, 40))) + filler() for i in range(60)}
    got = {}
    for r in ex.extract_items(pages_of(spark, texts), ("codes",)).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.hs_code, r.total_value))
    for i, text in texts.items():
        want = []
        for m in re.finditer(fv.RESCUE_CODE_PATTERN, text):
            around = text[max(0, m.start() - 100) : m.end() + 300]
            found = re.search(fv.RESCUE_FOB_PATTERN, around, re.IGNORECASE)
            want.append((m[1], float(found[1].replace(".", "").replace(",", ".")) if found else None))
        assert got[i] == want, i


def _grid(n):
    return "\n".join(f"{k % 900 + 1}/900 N 3303.00.20.{k % 900 + 100}W\nFOB FACTURA\n1.{k % 1000:03d},50\nPERFUME {k} MARCA{k % 7} 2,00 UNIDAD 1.{k % 1000:03d},50\nESTADO\n0,00\nCHINA\nPANAMA\n2,500\nACEPTADO" for k in range(n))


def test_a_document_of_20000_blocks(spark):
    codes = "\n".join(f"3303.00.20.{k % 900 + 100}W MERCADERIA VALOR USD 1.{k % 1000:03d},50" for k in range(20_000))
    assert ex.extract_items(pages_of(spark, {1: _grid(5), 2: codes[:200]})).count() > 5  # plans and classes are ready
    start = time.time()
    grid = ex.extract_items(pages_of(spark, {1: _grid(20_000)})).agg(F.count("*"), F.sum("total_value"), F.max("seq")).first()
    rescued = ex.extract_items(pages_of(spark, {1: codes}), ("codes",)).agg(F.count("*"), F.sum("total_value")).first()
    assert grid[0] == 20_000 and grid[2] == 19_999 and round(grid[1], 2) == round(sum(1000.5 + k % 1000 for k in range(20_000)), 2)
    around = (codes[max(0, m.start() - 100) : m.end() + 300] for m in re.finditer(fv.RESCUE_CODE_PATTERN, codes))
    amounts = [float(re.search(fv.RESCUE_FOB_PATTERN, x)[1].replace(".", "").replace(",", ".")) for x in around]
    assert rescued[0] == len(amounts) == 20_000 and round(rescued[1], 2) == round(sum(amounts), 2)
    assert time.time() - start < 120


def test_misread_values_are_set_aside_and_limits_are_parameters(spark):
    text = "1/2 N 3303.00.20.100W\nFOB FACTURA\n6.000.000,00\nPERFUME\n2/2 N 3303.00.20.200W\nFOB FACTURA\n10,00"
    pages = pages_of(spark, {1: text})
    rows = ex.extract_items(pages).orderBy("seq").collect()
    assert [(r.total_value, r.dropped_value) for r in rows] == [(0.0, 6_000_000.0), (10.0, None)]
    rows = ex.extract_items(pages, value_limit=1e9).orderBy("seq").collect()
    assert [(r.total_value, r.dropped_value) for r in rows] == [(6_000_000.0, None), (10.0, None)]
    assert [r.total_value for r in ex.extract_items(pages, max_lines=1).orderBy("seq").collect()] == [0.0, 0.0]
