"""Declarations and goods lines derived from the star-schema sample tables.

The sample tables have no declarations, so an order stands for a declaration
and an order line for a goods line.  Missing and blank values, which the sample
tables lack, are placed by key so that both sides of a check can derive them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_HS_CODES = [
    "3303.00.10", "3304.99.90", "3305.10.00", "8517.13.00", "8471.30.12", "8528.72.00",
    "4202.12.10", "6109.10.00", "9503.00.99", "2404.12.00", "0901.21.00", "9999.00.00",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _padded(number: Column, width: int) -> Column:
    """A whole number as ``format_string`` writes it with leading zeros; the common case needs no formatter."""
    plain = number.between(0, 10**width - 1)
    return F.when(plain, F.lpad(number.cast("string"), width, "0")).otherwise(F.format_string(f"%0{width}d", number))


def _money(c: Column) -> Column:
    return c / F.lit(100.0)


def dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declaration header per order."""
    orders = read_table(spark, sf_dir, "orders")
    customers = read_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    nations = read_table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    df = orders.join(customers, "o_custkey").join(nations, "c_nationkey")
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), cents("o_totalprice")
    freight, insurance = F.floor(price / 20), F.floor(price / 100)
    number = F.concat(_padded(F.year("o_orderdate") % 100, 2), F.lit("ZA"), _padded(key, 9))
    return df.select(
        key.alias("id"),
        number.alias("number"),
        F.when(key % 97 != 5, F.to_date("o_orderdate")).alias("date"),
        F.when(key % 53 == 7, "").when(key % 59 != 3, F.col("c_mktsegment")).alias("owner"),
        F.col("c_name").alias("importer"),
        F.format_string("%08d-%d", cust + 80000000, cust % 10).alias("importer_doc"),
        F.format_string("Customer#%09d", (cust * 7) % 500).alias("exporter"),
        F.format_string("BROKER %02d", key % 20).alias("broker"),
        F.when(key % 71 == 9, "").otherwise(F.col("n_name")).alias("origin"),
        F.format_string("%03d - ADUANA", key % 7).alias("customs_office"),
        F.lit("ZF2I - IMPORTACION").alias("regime"),
        F.when(key % 10 < 7, "VERDE").when(key % 10 < 9, "NARANJA").otherwise("ROJO").alias("channel"),
        F.when(key % 5 != 0, F.format_string("BL%08d", key)).alias("bl"),
        F.when(key % 5 == 0, F.format_string("AWB%06d", key)).alias("awb"),
        F.format_string("MSCU%07d", key % 10000000).alias("container"),
        F.col("o_totalprice").alias("fob"),
        _money(freight).alias("freight"),
        _money(insurance).alias("insurance"),
        F.when(key % 31 == 4, F.lit(0.0)).otherwise(_money(price + freight + insurance)).alias("cif"),
        F.lit("USD").alias("currency"),
        (F.lit(7000.0) + key % 500).alias("exchange_rate"),
        (price * 10).cast("double").alias("total"),
        (F.lit(0.5) + key % 9000).alias("net_weight"),
        (F.lit(1.0) + key % 100).alias("packages"),
        F.concat(F.lit("uploads/"), F.date_format("o_orderdate", "yyyy/MM/"), number, F.lit(".pdf")).alias("stored_path"),
        F.concat(number, F.lit(".pdf")).alias("file_name"),
        F.sha2(number, 256).alias("file_hash"),
        F.when(F.col("o_orderstatus") == "F", "CONFIRMADO")
        .when(F.col("o_orderstatus") == "O", "PROCESADO")
        .otherwise("REVISAR")
        .alias("status"),
        ((F.lit(70) + key % 30) / F.lit(100.0)).alias("confidence"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def line_key() -> Column:
    """Columns that identify an order line, as one text."""
    return F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice").cast("string")
    )


def hs_code_of(part: Column) -> Column:
    codes = F.array(*[F.lit(c) for c in SAMPLE_HS_CODES])
    base = F.element_at(codes, (part % len(SAMPLE_HS_CODES) + 1).cast("int"))
    hundreds = part % 10 * 100
    dotted = F.concat(base, F.lit("."), F.when(hundreds == 0, "000").otherwise(hundreds.cast("string")), F.lit("L"))
    return F.when(part % 13 == 0, F.replace(dotted, F.lit("."), F.lit(""))).otherwise(dotted)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One goods line per order line."""
    lines = read_table(spark, sf_dir, "lineitem")
    parts = read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    df = lines.join(parts, "l_partkey")
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    blank_brand = (F.col("l_returnflag") == "A") & (F.col("l_quantity") == 1)
    return df.select(
        line_key().alias("id"),
        F.col("l_orderkey").alias("dispatch_id"),
        line.alias("item_no"),
        F.when(line % 3 != 0, (supp % 4 + 1).cast("int")).alias("subitem_no"),
        F.when(part % 101 != 1, hs_code_of(part)).alias("hs_code"),
        F.when(supp % 6 != 0, (part + F.lit(7840000000000)).cast("string")).alias("product_code"),
        F.concat(F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("ML")).alias("description"),
        F.when(blank_brand, "").when(line != 7, F.col("p_brand")).alias("brand"),
        F.col("l_quantity").alias("quantity"),
        F.lit("UNIDAD").alias("unit"),
        F.when(line % 4 == 0, F.lit(0.0))
        .when(line % 4 != 1, F.col("l_extendedprice") / F.col("l_quantity"))
        .alias("unit_value"),
        F.col("l_extendedprice").alias("total_value"),
        F.abs("l_tax").alias("vat_rate"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("duty_rate"),
        F.when(supp % 11 == 0, "").otherwise(F.concat(F.lit("NATION_"), (supp % 25).cast("string"))).alias("origin"),
        (line + 1).alias("page"),
    )


def flawed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goods lines whose description carries one of eight flaws, by key.

    ``true_name`` is the text a repair should lead back to.
    """
    lines = read_table(spark, sf_dir, "lineitem")
    parts = read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    df = lines.join(parts, "l_partkey")
    kind = (F.col("l_partkey") + F.col("l_suppkey")) % 9
    name, part = F.upper("p_name"), F.col("l_partkey").cast("string")
    brand = F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") == 1), "").when(F.col("l_linenumber") != 7, F.col("p_brand"))
    shown_brand = F.coalesce(F.nullif(brand, F.lit("")), F.lit("XX"))
    text = (
        F.when(kind == 1, F.concat(name, F.lit(" - REF. SM-S"), part, F.lit("B")))
        .when(kind == 2, F.concat(F.lit("HOJA 4 de 12 FECHA OFIC: 10/08/2026 "), name))
        .when(kind == 3, F.concat(F.lit("LOS DEMAS EN: 7.000 UNIDADES "), name))
        .when(kind == 4, F.concat(name, F.lit(" - .")))
        .when(kind == 5, F.format_string("Subítem %d - Posición %d", F.col("l_linenumber"), F.lit(8517)))
        .when(kind == 6, F.concat(F.lit("COD: X"), part, F.lit("7 - "), name))
        .when(kind == 7, F.concat(name, F.lit(" "), (F.col("l_partkey") + F.lit(7840000000000)).cast("string")))
        .when(kind == 8, F.concat(shown_brand, F.lit(" - "), name))
        .otherwise(name)
    )
    return df.select(
        line_key().alias("id"),
        F.col("l_orderkey").alias("dispatch_id"),
        F.col("l_linenumber").alias("item_no"),
        F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("subitem_no"),
        brand.alias("brand"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("K"), part)).alias("product_code"),
        text.alias("description"),
        name.alias("true_name"),
        kind.cast("int").alias("flaw"),
    )


def items_with_brand_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goods lines whose brand is written in one of three ways."""
    lines = read_table(spark, sf_dir, "lineitem")
    parts = read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    number = F.regexp_extract("p_brand", r"#(\d+)", 1)
    line = F.col("l_linenumber")
    brand = (
        F.when(line % 3 == 0, F.concat(F.lit("Brand#"), number))
        .when(line % 3 == 1, F.concat(F.lit("Brand #"), number))
        .otherwise(F.concat(F.lit("BRAND-"), number, F.lit(" Inc.")))
    )
    return lines.join(parts, "l_partkey").select(
        line_key().alias("id"), F.col("l_orderkey").alias("dispatch_id"), brand.alias("brand"),
        F.upper("p_name").alias("description"), F.col("l_extendedprice").alias("total_value"),
    )


def _row_idx() -> Column:
    """Place of an order line in a file: order, line number, then all columns."""
    from pyspark.sql import Window

    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    return F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.row_number().over(same)


def client_sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client price sheets in three layouts, with captions, footers and free samples."""
    lines = read_table(spark, sf_dir, "lineitem")
    parts = read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    part, kind = F.col("l_partkey"), F.col("l_suppkey") % 3
    price = part % 5000 + 1
    units, rest = F.floor(price / 100).cast("string"), F.lpad((price % 100).cast("string"), 2, "0")
    free = part % 17 == 0
    qty = F.col("l_quantity").cast("int").cast("string")
    name = F.upper("p_name")
    a = F.array(
        (part + F.lit(7840000000000)).cast("string"), name, F.col("p_brand"), qty, F.lit("1,5"),
        F.when(free, "0").otherwise(F.concat_ws(",", units, rest)), F.lit(""),
    )
    b = F.array(
        F.concat(part.cast("string"), F.lit(".0")), F.when(part % 2 == 0, F.concat(name, F.lit(" LATTAFA"))).otherwise(name),
        F.concat(qty, F.lit(",00")), F.when(free, "-").otherwise(F.concat(F.lit("R$ "), units, F.lit("."), rest)),
        F.when(free, "0.00").otherwise("5.00"), F.lit("ok"),
    )
    c = F.array(
        F.concat(name, F.lit(" HP")), F.concat(qty, F.lit(".0")),
        F.when(free, "0").otherwise(F.concat(F.lit("$"), units, F.lit("."), rest)), F.concat(F.lit("K"), part.cast("string")),
    )
    body = lines.join(parts, "l_partkey").select(
        F.concat(F.lit("sheet-"), (F.col("l_suppkey") % 21).cast("string")).alias("file_id"),
        (_row_idx() + 10).alias("row_idx"),
        F.when(kind == 0, a).when(kind == 1, b).otherwise(c).alias("cells"),
    )
    files = lines.select((F.col("l_suppkey") % 21).alias("n")).distinct()
    titles = (
        F.when(F.col("n") % 3 == 0, F.array(*[F.lit(t) for t in (
            "Item", "Descripción Mercadería", "Marca", "Cantidad", "Peso kg", "Precio Unit.", "Total")]))
        .when(F.col("n") % 3 == 1, F.array(*[F.lit(t) for t in (
            "Código", "Descrição da Mercadoria", "Quantidade", "Valor Unitário", "Valor Total", "Observação")]))
        .otherwise(F.array(*[F.lit(t) for t in ("Description", "Qty", "Unit Price", "SKU")]))
    )
    caption = F.array(*[F.lit("")] * 7, F.lit("Proforma 2024"))
    footer = F.when(F.col("n") % 3 == 2, F.array(F.lit("Total"), F.lit("99"), F.lit("10.00"))).otherwise(
        F.array(F.lit(""), F.lit("TOTAL: USD"), F.lit("7"), F.lit("7"), F.lit("7"), F.lit("7"), F.lit("7")))
    frame = files.select(
        F.concat(F.lit("sheet-"), F.col("n").cast("string")).alias("file_id"),
        F.inline(F.array(
            F.struct(F.lit(0).cast("bigint").alias("row_idx"), caption.alias("cells")),
            F.struct(F.lit(1).cast("bigint").alias("row_idx"), titles.alias("cells")),
            F.struct(F.lit(9000000000000000).alias("row_idx"), footer.alias("cells")),
        )),
    )
    return body.unionByName(frame)


def historical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a historical workbook whose keys are only given on some lines."""
    lines = read_table(spark, sf_dir, "lineitem")
    parts = read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day"), "o_custkey"
    )
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    keyed = F.col("l_linenumber") <= 2
    shown = (
        F.when(key % 3 == 0, F.date_format("day", "dd/MM/yyyy"))
        .when(key % 3 == 1, F.datediff("day", F.lit("1899-12-30").cast("date")).cast("string"))
        .otherwise(F.date_format("day", "yyyy-MM-dd"))
    )
    return lines.join(parts, "l_partkey").join(orders, "l_orderkey").select(
        F.lit("workbook").alias("file_id"),
        _row_idx().alias("row_idx"),
        F.when(keyed, shown).alias("date_text"),
        F.when(keyed, F.format_string(" H%07d ", F.floor(key / 2))).alias("number_text"),
        F.when(keyed, F.concat(F.lit("casa  "), (F.col("o_custkey") % 97).cast("string"))).alias("importer_text"),
        F.concat(F.lit("1,0"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0")).alias("quantity_text"),
        (part % 50 + 1).cast("string").alias("unit_text"),
        F.when(part % 3 == 0, "0").otherwise(F.format_string("%d.25", part)).alias("total_text"),
        F.when(part % 7 == 0, "nan").otherwise("3303.00").alias("hs_text"),
        F.when(part % 5 == 0, "None").otherwise(F.col("p_brand")).alias("brand_text"),
        F.when(part % 4 == 0, F.format_string("%s %d", F.upper("p_name"), part + F.lit(7840000000000))).otherwise(F.upper("p_name")).alias("description_text"),
        F.when(F.col("l_suppkey") % 6 == 0, "").otherwise(F.concat(F.lit("PAIS "), (F.col("l_suppkey") % 4).cast("string"))).alias("origin_text"),
        F.when(part % 2 == 0, "10%").otherwise("0.05").alias("vat_text"),
        F.when(part % 2 == 0, "6").otherwise("x").alias("duty_text"),
    )
