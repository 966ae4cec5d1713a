"""Declaration pages rendered from the sample declarations, for round trips.

Page 1 is the header page; every further page holds the goods of one line
number.  The goods are written in one of four layouts, by declaration key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.sources import sample_tables as st

LAYOUTS = ("subitems", "standard", "grid", "codes")


def _grouped(whole: Column) -> Column:
    """A whole number with commas between thousands; a missing one as ``null``, as format_string writes it."""
    return F.coalesce(F.format_number(whole, 0), F.lit("null"))


def local_amount(hundredths: Column) -> Column:
    """An amount in cents as 1.234,56."""
    units = F.translate(_grouped(F.floor(hundredths / 100)), ",", ".")
    return F.concat(units, F.lit(","), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def us_amount(hundredths: Column) -> Column:
    """An amount in cents as 1,234.56."""
    units = _grouped(F.floor(hundredths / 100))
    return F.concat(units, F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def _hundredths(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def page_method(doc: Column, page: Column) -> Column:
    return F.when((doc % 25 == 0) | ((doc % 10 == 0) & (page > 1)), "OCR").otherwise("DIGITAL_TEXT")


def header_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = st.dispatches(spark, sf_dir)
    stamp = F.concat(F.lit(" FECHA OFIC: "), F.date_format("date", "dd/MM/yyyy"), F.lit(" 17:13:10"))
    paper = F.coalesce(
        F.concat(F.lit("BL N° : "), "bl"), F.concat(F.lit("AWB N° : "), "awb")
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("DESPACHO NUMERO: "), "number", F.lit(" HOJA 1 de 8")),
        F.concat(F.lit("REGIMEN : "), "regime"),
        F.concat(F.lit("ADUANA : "), "customs_office", F.coalesce(stamp, F.lit(""))),
        F.concat(F.lit("IMP./EXP : "), "importer"),
        F.concat(F.lit("RUC/DOC : "), "importer_doc"),
        F.concat(F.lit("VEND/COMP. "), "exporter"),
        F.concat(F.lit("DESP. "), "broker"),
        F.concat(F.lit("VALOR FOB USD "), local_amount(_hundredths("fob"))),
        F.concat(F.lit("FLETE : "), local_amount(_hundredths("freight")), F.lit(" DOL")),
        F.concat(F.lit("SEGURO FACTURA "), local_amount(_hundredths("insurance")), F.lit(" DOL")),
        F.concat(F.lit("VALOR CIF : "), local_amount(_hundredths("cif"))),
        F.lit("MONEDA : DOL"),
        F.concat(F.lit("TIPO DE CAMBIO : "), local_amount(_hundredths("exchange_rate"))),
        F.concat(F.lit("KILO NETO "), local_amount(_hundredths("net_weight")), F.lit("0")),
        F.concat(F.lit("BULTOS : "), F.col("packages").cast("int").cast("string")),
        F.concat(F.lit("CANAL ASIGNADO CANAL "), "channel"),
        F.concat(F.lit("TOTAL GENERAL.. "), F.translate(_grouped(F.col("total").cast("bigint")), ",", ".")),
        paper,
        F.concat(F.lit("CONTENEDOR : "), "container"),
    )
    page = F.lit(1)
    return d.select(F.col("id").alias("doc_id"), page.alias("page_num"), text.alias("text"), page_method(F.col("id"), page).alias("method"))


def goods_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with what the goods pages print of them."""
    lines = st.read_table(spark, sf_dir, "lineitem")
    parts = st.read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    part = F.col("l_partkey")
    blank_brand = (F.col("l_linenumber") == 7) | ((F.col("l_returnflag") == "A") & (F.col("l_quantity") == 1))
    return lines.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_suppkey") % 4 + 1).cast("int").alias("sub"),
        F.when(part % 101 != 1, st.hs_code_of(part)).alias("hs"),
        F.col("l_quantity").cast("int").alias("qty"),
        st.cents("l_extendedprice").alias("value"),
        F.when(~blank_brand, F.translate(F.upper("p_brand"), "#", "")).alias("brand"),
        (part + F.lit(7840000000000)).cast("string").alias("ean"),
        F.upper("p_name").alias("name"),
    )


def _subitem_block() -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("NRO ITEM: "), F.col("line").cast("string"), F.lit(" POS.ARANC.:"), F.coalesce("hs", F.lit("S")),
                 F.lit(" SUB ITEM NRO: "), F.col("sub").cast("string")),
        F.concat(F.lit("CANTIDAD: "), F.col("qty").cast("string"), F.lit(".00 CANT.ESPEC.: 0 FOB: "), us_amount(F.col("value"))),
        F.concat(F.lit("MARCA: "), F.coalesce("brand", F.lit("***")), F.lit(" OBSERVACION: "), "ean", F.lit(" "), "name"),
    )


def _standard_block() -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("NRO DE PEDIDO: "), F.col("line").cast("string"), F.lit("/7")),
        F.concat(F.lit("POSICION ARANCELARIA: "), F.coalesce("hs", F.lit("S"))),
        F.lit("FOB FACTURA"),
        local_amount(F.col("value")),
        F.lit("DESCRIPCION EN TERMINOS COMERCIALES"),
        F.concat_ws(" ", "ean", "name"),
        F.lit("CANTIDAD UNIDAD FOB U$S"),
        F.concat(F.col("qty").cast("string"), F.lit(",00 UNIDAD")),
    )


def _grid_block() -> Column:
    amount, qty = local_amount(F.col("value")), F.concat(F.col("qty").cast("string"), F.lit(",00"))
    brand = F.coalesce("brand", F.lit("***"))
    one_line = F.concat_ws(" ", F.lit("FINO"), F.col("name"), qty, F.lit("UNIDAD"), amount)
    several = F.concat_ws("\n", F.lit("CANTIDAD UNIDAD FOB U$S"), F.col("name"), brand, qty, F.lit("UNIDAD"), amount)
    return F.concat_ws(
        "\n",
        F.concat(F.col("line").cast("string"), F.lit("/7"), F.coalesce(F.concat(F.lit(" N "), "hs"), F.lit(""))),
        F.lit("FOB FACTURA"),
        amount,
        F.when(F.col("line") % 2 == 0, one_line).otherwise(several),
        F.lit("ESTADO"), F.lit("0,00"), F.lit("CHINA"), F.lit("PANAMA"),
        F.concat(F.col("qty").cast("string"), F.lit(",500")), F.lit("ACEPTADO"),
    )


def _code_block() -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.coalesce("hs", F.lit("S")), F.lit(" MERCADERIA VALOR USD "), local_amount(F.col("value"))),
        F.lit("." * 320),
    )


def goods_pages(spark: SparkSession, sf_dir: str, layout: str | None = None) -> DataFrame:
    """Goods pages; all in one layout, or by declaration key."""
    g = goods_lines(spark, sf_dir)
    blocks = dict(zip(LAYOUTS, (_subitem_block(), _standard_block(), _grid_block(), _code_block())))
    if layout:
        block = blocks[layout]
    else:
        kind = F.col("doc_id") % 4
        block = F.when(kind == 0, blocks["subitems"]).when(kind == 1, blocks["standard"]).when(kind == 2, blocks["grid"]).otherwise(blocks["codes"])
    pages = g.groupBy("doc_id", "line").agg(F.array_join(F.sort_array(F.collect_list(block)), "\n").alias("body"))
    page = F.col("line") + 1
    head = F.concat(F.lit("DESPACHO NUMERO: X HOJA "), page.cast("string"), F.lit(" de 8\n"))
    return pages.select(
        "doc_id", page.cast("int").alias("page_num"), F.concat(head, "body").alias("text"), page_method(F.col("doc_id"), page).alias("method")
    )


def document_pages(spark: SparkSession, sf_dir: str, layout: str | None = None) -> DataFrame:
    """All pages of all sample declarations, laid out by document like a stored pages table.

    The extraction groups by document too, so it needs no exchange of its own. Its work per byte is heavy: with a number of
    its own, the exchange is not merged into about one partition per core by its few bytes, one more of which costs a second wave.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return header_pages(spark, sf_dir).unionByName(goods_pages(spark, sf_dir, layout)).repartition(parts, "doc_id")
