"""What the physical plans of stored tables look like."""

from pyspark.sql import functions as F

from portolan.functions.hs import enrich_hs
from portolan.operators import extraction as ex
from portolan.operators import search
from portolan.sources import sample_tables as st

SF = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, tmp_path):
    items, heads = str(tmp_path / "items"), str(tmp_path / "heads")
    st.items(spark, SF).write.parquet(items)
    st.dispatches(spark, SF).write.parquet(heads)
    found = search.search_items(
        spark.read.parquet(items), spark.read.parquet(heads), hs="3303.00.10.400L", owner="BUILDING", date_from="01/01/1997"
    ).select("id", "number")
    text = plan(found)
    assert "EqualTo(hs_code,3303.00.10.400L)" in text
    assert "EqualTo(owner,BUILDING)" in text and "GreaterThanOrEqual(date,1997-01-01)" in text
    assert "description" not in text.split("ReadSchema")[1] and "fob" not in text


def test_year_is_a_range_on_the_scan(spark, tmp_path):
    heads = str(tmp_path / "heads")
    st.dispatches(spark, SF).write.parquet(heads)
    text = plan(search.search_dispatches(spark.read.parquet(heads), year=1998, status="REVISAR"))
    assert "GreaterThanOrEqual(date,1998-01-01)" in text and "LessThan(date,1999-01-01)" in text and "EqualTo(status,REVISAR)" in text


def test_code_lookup_does_not_shuffle_the_lines(spark, tmp_path):
    items = str(tmp_path / "items")
    st.items(spark, SF).write.parquet(items)
    text = plan(enrich_hs(spark.read.parquet(items)))
    assert text.count("BroadcastHashJoin") == 3 and "hashpartitioning" not in text


def test_page_is_a_top_n(spark):
    text = plan(search.latest(st.dispatches(spark, SF), 10))
    assert "TakeOrderedAndProject" in text


def test_brand_tree_reads_the_lines_once(spark, tmp_path):
    from portolan.operators.brands import facet_hierarchy

    items = str(tmp_path / "lines")
    st.items(spark, SF).write.parquet(items)
    labels = spark.createDataFrame([], "brand string, family string, clean_name string, search_pattern string")
    assert plan(facet_hierarchy(spark.read.parquet(items), labels)).count("FileScan") == 1


def test_replica_matching_reads_each_header_table_at_most_three_times(spark, tmp_path):
    from portolan.operators.replica import match_replica, pull_quick

    heads, lines = st.dispatches(spark, SF), st.items(spark, SF)
    for name, df in (("here", heads.filter("id % 3 <> 0")), ("there", heads.filter("id % 2 = 0")), ("lines", lines)):
        df.write.parquet(str(tmp_path / name))
    here, there, all_lines = (spark.read.parquet(str(tmp_path / n)) for n in ("here", "there", "lines"))
    text = plan(match_replica(there, here))
    assert text.count("/here]") <= 3 and text.count("FileScan") <= 3
    merged = plan(pull_quick(there, all_lines, here, all_lines)[0])
    assert merged.count("FileScan") <= 5


def test_survivors_are_found_by_one_pass_per_key(spark, tmp_path):
    from portolan.operators.replica import survivors

    rows = [(1, "A", "x"), (2, "A", "y"), (3, "B", "y"), (4, "B", "z"), (5, None, "z"), (6, None, ""), (7, " A ", None)]
    spark.createDataFrame(rows, "id bigint, file_name string, file_hash string").write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    for lowest, want in ((True, {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 1}), (False, {1: 7, 2: 7, 3: 5, 4: 5, 5: 5, 6: 6, 7: 7})):
        found = survivors(stored, ("file_name", "file_hash"), lowest)
        assert plan(found).count("FileScan") == 1
        assert {r.id: r.survivor_id for r in found.collect()} == want


def test_sample_replica_reads_the_headers_once(spark):
    from portolan.queries.changes import _heads, _remote

    remote = _remote(spark, SF)
    assert plan(remote).count("FileScan") == plan(_heads(spark, SF)).count("FileScan")
    older = remote.filter("owner = 'OLDER'")
    assert older.filter("(id - 500000000) % 4 <> 1").isEmpty()
    assert older.count() == remote.filter("owner = 'REMOTE' and id % 4 = 1").count() > 0


def test_padded_numbers_are_those_of_the_formatter(spark):
    rows = spark.sql("select * from values (0L), (7L), (99L), (100L), (999999999L), (1000000000L), (-5L), (null) t(k)")
    for width in (2, 9):
        wrong = rows.filter(~st._padded(F.col("k"), width).eqNullSafe(F.format_string(f"%0{width}d", "k")))
        assert wrong.isEmpty()


def test_sample_codes_need_no_formatter(spark):
    codes = spark.range(300).select(F.col("id"), st.hs_code_of(F.col("id")).alias("code"))
    assert "format_string" not in codes._jdf.queryExecution().analyzed().toString()
    got = {r.id: r.code for r in codes.collect()}
    assert (got[0], got[1], got[27], got[26]) == ("33030010000L", "3304.99.90.100L", "8517.13.00.700L", "33051000600L")


def test_documents_are_extracted_once(spark):
    from portolan.operators import extraction as ex

    pages = spark.createDataFrame([(1, 1, "NRO ITEM: 1", "OCR")], "doc_id bigint, page_num int, text string, method string")
    text = plan(ex.extract_items(pages, layouts=("subitems",)))
    assert text.count("regexp_extract_all(") == 1 and "Filter (size(" not in text and "Filter ((size(" not in text


def test_strip_takes_spaces_of_any_kind(spark):
    from portolan.functions.text import strip

    texts = ["", " ", "\u3000\x1c a\u00a0b\n c \u2028\x85", "\ta", "a\r\n", "\u00b0x\u200b", "\U0001f600 ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(strip("t")).collect()
    assert [r[0] for r in rows] == ["", "", "a\u00a0b\n c", "a", "a", "\u00b0x\u200b", "\U0001f600", None]


def test_ends_are_trimmed_without_a_pattern(spark):
    from portolan.functions import text

    assert "regexp" not in plan(spark.range(1).select(text.strip(F.col("id").cast("string"))))
    odd = [" a  b ", " \x1cé\t x　", "​ ", "a b", "", None, " \n", "a    b"]
    rows = spark.createDataFrame(list(enumerate(odd)), "n int, t string").select("n", text.strip("t").alias("s"), text.clean_text("t").alias("c")).orderBy("n").collect()
    assert [r.s for r in rows] == ["a  b", "é\t x", "​", "a b", "", None, "", "a    b"]
    assert [r.c for r in rows] == ["a b", "é x", "​", "a b", None, None, None, "a b"]


def test_header_values_are_found_behind_signs_that_change_length(spark):
    text = "ß ŉ İ K ﬁ\nDESPACHO\nDespacho numero: 26AB1\nKilo neto 1,50\nKİLO NETO 7\nREGİMEN : A\nVALOR FOB USD 5,00"
    found = ex.extract_fields(spark.createDataFrame([(1, 1, text, "X"), (2, 1, text[10:], "X")], "doc_id bigint, page_num int, text string, method string"))
    assert [(r.number.raw, r.net_weight.raw, r.fob.raw) for r in found.collect()] == [("26AB1", "1,50", "5,00")] * 2


def test_values_of_fields_are_read_once(spark):
    pages = spark.createDataFrame([(1, 1, "VALOR FOB USD 5,00", "X")], "doc_id bigint, page_num int, text string, method string")
    records = ex.field_records(ex.extract_fields(pages))
    generated = [line for line in records._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate inline" in line]
    assert generated and "[A-Za-z$" not in generated[0]  # what parse_currency starts with


def test_pages_are_cut_for_all_cores(spark):
    from portolan.sources import sample_pages as sp

    pages = sp.document_pages(spark, SF)
    assert "REPARTITION_BY_NUM" in plan(pages)


def test_documents_are_read_once_for_fields_and_lines(spark, monkeypatch):
    from portolan.plans import documents as docs

    cut, kept = [], docs.cut_lineage
    monkeypatch.setattr(docs, "cut_lineage", lambda df: cut.append(df.columns) or kept(df))
    files = spark.createDataFrame([(1, "a.pdf", "h", 10)], "doc_id bigint, file_name string, file_hash string, bytes bigint")
    pages = spark.createDataFrame([(1, 1, "VALOR FOB USD 5,00", "X")], "doc_id bigint, page_num int, text string, method string")
    registered = spark.createDataFrame([], "id bigint, number string, date date, importer_doc string, file_hash string")
    docs.process_documents(files, pages, registered, spark.createDataFrame([], "pattern string, target string"), "2001-01-15")
    assert {"doc_id", "page_num", "text", "method"} == set(cut[0])


def test_diagnosis_is_evaluated_once(spark):
    from portolan import fixed_values as fv
    from portolan.operators import quality as qa

    items = st.flawed_items(spark, SF)
    for df in (qa.fix_counts(qa.apply_high_confidence_fixes(items)), qa.audit_items(items, st.dispatches(spark, SF), "cutoffs")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(fv.CUTOFF_PATTERN) == 1


def test_cheap_tests_let_through_letters_that_fold(spark):
    from portolan.functions import goods

    texts = ["loſ demás kilos de AB", "ſKu: X123", "ıtem nro. 5 AB", "eſtado: X", "İTEM: PM1234 - AB", " A  B "]
    df = goods.diagnose(spark.createDataFrame([(t, "", "") for t in texts], "description string, brand string, product_code string"))
    got = {r.description: (r.suggested_description, r.suggested_code, r.is_clean) for r in df.collect()}
    assert [got[t] for t in texts] == [('lo\u017f dem\xe1s kilos de AB', '', False), ('\u017f\u212au: X123', 'X123', False), ('AB', '', False), ('e\u017ftado: X', '', False), ('AB', 'PM1234', False), ('A B', '', False)]


def test_facets_of_declarations_exchange_the_lines_once(spark):
    text = plan(search.dispatch_item_facets(st.items(spark, SF)))
    assert text.count("rangepartitioning") == 1 and "hashpartitioning" not in text


def test_cells_of_delimited_files_are_cut_once(spark):
    from portolan.operators.sheets import delimited_to_cells
    from portolan.queries import QUERIES

    files = spark.createDataFrame([("a", "x;y\n;\n1;2"), ("b", ""), ("c", None)], "file_id string, text string")
    cells = delimited_to_cells(files)
    text = cells._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in text.split("\n") if "Filter" in line.split("(")[0] and "regexp_extract_all" in line]
    assert sorted(tuple(r) for r in cells.collect()) == [("a", 0, ["x", "y"]), ("a", 2, ["1", "2"])]
    assert QUERIES["delimited_cells"](spark, SF).rdd.getNumPartitions() == 8
