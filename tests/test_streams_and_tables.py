"""Folder streams, stored tables and exports."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from portolan.operators import historical, sheets
from portolan.plans import reports
from portolan.sources import tables
from portolan.sources.schemas import SCHEMAS
from portolan.streaming import watch


def write(path, data):
    with open(path, "wb") as f:
        f.write(data)


def test_watch_folder_once_per_content(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(folder)
    write(folder / "a.pdf", b"one")
    write(folder / "b.PDF", b"one")
    write(folder / "c.txt", b"two")
    registered = spark.createDataFrame([(1, "N1", "x", "u/z.pdf", "known.pdf")], "id bigint, number string, file_hash string, stored_path string, file_name string")

    def handle(batch, epoch):
        watch.unseen(batch, registered).write.mode("overwrite").parquet(watch.batch_folder(out, epoch))

    def scan():
        stream = watch.dedupe_stream(watch.watch_documents(spark, str(folder)))
        watch.start(stream, handle, str(tmp_path / "ckpt"), available_now=True).awaitTermination()
        return sorted(r.file_name for r in spark.read.parquet(out).select("file_name").collect())

    first = scan()
    assert len(first) == 1 and first[0] in ("a.pdf", "b.PDF")
    write(folder / "known.pdf", b"three")
    write(folder / "d.pdf", b"four")
    write(folder / "e.pdf", b"one")
    assert scan() == sorted(first + ["d.pdf"])


def test_page_stream_with_bounded_state(spark, tmp_path):
    src = str(tmp_path / "pages")
    rows = [(1, 1, "t", "OCR", "a.pdf", "h1", 3), (2, 1, "t", "OCR", "b.pdf", "h1", 3)]
    spark.createDataFrame(rows, watch.PAGE_SCHEMA).write.parquet(src)
    once = watch.dedupe_stream(watch.watch_pages(spark, src), "1 day")
    seen = []
    watch.start(once, lambda b, e: seen.extend(r.file_hash for r in b.collect()), str(tmp_path / "c"), available_now=True).awaitTermination()
    assert seen == ["h1"]


def test_state_of_seen_files_is_bounded(spark, tmp_path):
    src, rows = str(tmp_path / "pages"), []
    for k in range(10):
        batch = [(k * 20 + i, 1, "t", "OCR", "a.pdf", f"h{k}-{i}", 3) for i in range(20)]
        spark.createDataFrame(batch, watch.PAGE_SCHEMA).write.mode("append").parquet(src)
        query = watch.start(watch.dedupe_stream(watch.watch_pages(spark, src), "1 second"), lambda b, e: b.count(), str(tmp_path / "c"), available_now=True)
        query.awaitTermination()
        rows.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
    assert max(rows) <= 60, rows


def test_quarantine_and_pending(spark, tmp_path):
    results = spark.createDataFrame(
        [("a.pdf", "PROCESADO", None, "A", "I1"), ("b.pdf", "ERROR", "boom", None, None), ("c.pdf", "PROCESADO", None, "A", None), ("d.pdf", "PROCESADO", None, "B", None)],
        "file_name string, status string, message string, number string, importer string",
    )
    watch.quarantine_failures(results, str(tmp_path / "bad"), 0)
    failed = spark.read.parquet(str(tmp_path / "bad"))
    assert [(r.file_name, r.message) for r in failed.select("file_name", "message").collect()] == [("b.pdf", "boom")]
    none = spark.createDataFrame([], "number string, importer string, source string, kind string, batch int")
    pending = watch.pending_registry(results, none, "Carpeta").withColumn("batch", F.lit(0))
    assert sorted(r.number for r in pending.collect()) == ["A", "B"]
    consumed = spark.createDataFrame([], "batch int")
    rows, mark = watch.consume_pending(pending, consumed)
    assert rows.count() == 2
    assert watch.peek_pending(pending, consumed.unionByName(mark)).count() == 0


def test_versions_and_export(spark, tmp_path):
    root = str(tmp_path / "db")
    heads = spark.createDataFrame([(1, "N,1", dt.date(2026, 8, 10), 0.105)], "id int, number string, date date, r double")
    first = tables.write_tables({"dispatches": heads}, root)
    second = tables.write_tables({"dispatches": heads.withColumn("number", F.lit("N2"))}, root)
    assert first < second and tables.current_version(spark, root) == second
    assert tables.read_tables(spark, root, ["dispatches"])["dispatches"].first().number == "N2"
    assert tables.read_tables(spark, root, ["dispatches"], first)["dispatches"].first().number == "N,1"
    found = tables.read_tables(spark, root, ["dispatches"])["dispatches"]
    assert found.schema.fields[: len(SCHEMAS["dispatches"])] == SCHEMAS["dispatches"].fields and found.columns[-1] == "r"
    tables.write_tables({"dispatches": heads.withColumn("fob", F.lit("text"))}, root)
    with pytest.raises(TypeError):
        tables.read_tables(spark, root, ["dispatches"])
    tables.write_csv(heads.coalesce(1), str(tmp_path / "csv"))
    part = [p for p in os.listdir(tmp_path / "csv") if p.startswith("part")][0]
    text = (tmp_path / "csv" / part).read_text(encoding="utf-8")
    assert text == '﻿id,number,date,r\n1,"N,1",2026-08-10,0.105\n'


def test_binary_documents(spark, tmp_path):
    write(tmp_path / "x.pdf", b"abc")
    row = tables.load_binary_documents(spark, str(tmp_path)).first()
    assert (row.file_name, row.bytes, row.file_hash[:8]) == ("x.pdf", 3, "ba7816bf")


def test_sheets_from_files(spark, tmp_path):
    os.makedirs(tmp_path / "csv")
    write(tmp_path / "csv" / "a.csv", 'Descripcion;Cant;Precio\n"A; ""B""\nC";5;1,50\n;;\nTOTAL;5;1\n'.encode())
    cells = sheets.load_delimited_cells(spark, str(tmp_path / "csv"))
    assert [r.cells for r in cells.orderBy("row_idx").collect()][1] == ['A; "B"\nC', "5", "1,50"]
    lines = sheets.import_client_sheet(cells, spark.createDataFrame([("XX",)], "known string")).collect()
    assert [(r.goods, r.quantity, r.invoice_price, r.line_total, r.position) for r in lines] == [('A; "B"\nC', 5.0, 1.5, 7.5, 1)]


def test_large_cells_and_inch_marks(spark):
    wide, quoted = "w" * 1_000_000, 'q""' * 100_000 + "\n"
    text = f'a;b;c\nTV LED 55" SMART;2;100\nMONITOR 24" HP;1;50\n{wide};"{quoted}";x\n""" ";"" y;z\n'
    rows = sheets.delimited_to_cells(spark.createDataFrame([("f", text)], "file_id string, text string")).orderBy("row_idx").collect()
    want = [["a", "b", "c"], ['TV LED 55" SMART', "2", "100"], ['MONITOR 24" HP', "1", "50"], [wide, 'q"' * 100_000, "x"], ['"', "y", "z"]]
    assert [r.cells for r in rows] == want


def test_header_in_third_row(spark):
    rows = [("f", 0, ["Proforma", "", ""]), ("f", 1, ["", "VALOR", ""]), ("f", 2, ["Mercadoria", "Unitário", "TOTAL"]), ("f", 3, ["Mouse sem fio", "2", "10"])]
    cells = spark.createDataFrame(rows, "file_id string, row_idx bigint, cells array<string>")
    row = sheets.map_columns(sheets.find_header_rows(cells)).first()
    assert row.header_idx == 2 and row.headers == ["Proforma Mercadoria", "VALOR Unitário", "VALOR TOTAL"]
    assert row.columns["goods"] == 0 and row.columns["total_price"] == 2 and row.columns["invoice_price"] == 1


def test_historical_file(spark, tmp_path):
    titles = "Fecha ,N_Despacho,Importadora,Cantidade,Valor Ajustado,Total,Partida_Aranc,Marca,Descripcion,ORIGEN,Iva,%,row_idx"
    body = ["45000,N1,gafa,2,5,0,3303,M,X 7840000000012,CHINA,10%,6,0", ",,,1,1,7.5,nan,,nan,USA,x,,1", "2030,N2,gafa,1,1,1,1,M,Y,CHINA,1,1,2"]
    (tmp_path / "h.csv").write_text("\n".join([titles, *body]) + "\n")
    rows = historical.load_historical_sheet(spark, str(tmp_path / "h.csv"))
    heads, items = historical.import_historical(rows, spark.createDataFrame([], "number string, date date"))
    head = heads.first()
    assert heads.count() == 1 and (head.number, head.date, head.importer, head.fob, head.origin) == ("N1", dt.date(2023, 3, 15), "GAFA S.A.", 17.5, "CHINA, USA")
    got = [(r.item_no, r.total_value, r.product_code, r.description, r.vat_rate, r.duty_rate) for r in items.orderBy("item_no").collect()]
    assert got == [(1, 10.0, "7840000000012", "X 7840000000012", 0.1, 0.06), (2, 7.5, None, "MERCADERIA HISTORICA", None, None)]


def test_batch_event(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B")], "id int, number string")
    assert reports.batch_event(df).first().message == "Se agregaron 2 despachos: A, B"
    assert reports.batch_event(df.withColumn("number", F.lit(None).cast("string"))).first() is not None
