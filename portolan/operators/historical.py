"""Import of the historical workbook."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.dates import parse_sheet_date
from portolan.functions.numbers import clean_num, parse_tax_pct, plain_text
from portolan.functions.text import normalize_company, strip
from portolan.operators.joins import new_groups
from portolan.operators.search import year_at_most
from portolan.operators.windows import forward_fill, number_rows

# Texts that stand for an empty cell, and what is entered for all
# historical headers.
EMPTY_CELLS = ["nan", "None", ""]
HISTORICAL_HEADER = {
    "channel": "VERDE", "currency": "USD", "stored_path": "HISTORICO_EXCEL", "doc_type": "PLANILLA_EXCEL_HISTORICA",
    "extraction_method": "EXCEL_HISTORICO", "status": "PROCESADO",
}
KEYS = ["number", "date", "importer"]
# Column titles of the historical workbook.
HISTORICAL_COLUMNS = {
    "Fecha ": "date_text", "N_Despacho": "number_text", "Importadora": "importer_text", "Cantidade": "quantity_text",
    "Valor Ajustado": "unit_text", "Total": "total_text", "Partida_Aranc": "hs_text", "Marca": "brand_text",
    "Descripcion": "description_text", "ORIGEN": "origin_text", "Iva": "vat_text", "%": "duty_text",
}


def _cell(c: str):
    text = strip(c)
    return F.when(~text.isin(EMPTY_CELLS), text)


def load_historical_sheet(spark, path: str) -> DataFrame:
    """The exported workbook: its text columns plus row_idx, the place of a row in its file."""
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=False).withColumn("file_id", F.col("_metadata.file_path"))
    return raw.withColumnsRenamed(HISTORICAL_COLUMNS).withColumn("row_idx", F.col("row_idx").cast("bigint"))


def filled_rows(rows: DataFrame) -> DataFrame:
    """Rows with date, number and importer read and filled forward in file order."""
    read = (
        rows.withColumn("date", parse_sheet_date("date_text"))
        .withColumn("number", _cell("number_text"))
        .withColumn("importer", normalize_company(_cell("importer_text")))
    )
    return forward_fill(read, KEYS, "file_id", "row_idx")


def import_historical(rows: DataFrame, registered: DataFrame, max_year: int = 2025) -> tuple[DataFrame, DataFrame]:
    """Headers and goods lines of the historical rows that are not registered yet.

    Rows without number or importer are dropped.  Of several importers under one
    (number, date) only the first in file order is imported.
    """
    dated = year_at_most(filled_rows(rows), max_year)
    usable = dated.filter(F.col("number").isNotNull() & F.col("importer").isNotNull())
    groups = usable.groupBy(*KEYS).agg(F.min("row_idx").alias("first_row"))
    first = groups.groupBy("number", "date").agg(F.min_by("importer", "first_row").alias("importer"))
    wanted = new_groups(first, registered)
    chosen = usable.join(wanted.select(*KEYS), KEYS, "left_semi")

    quantity, unit, total = clean_num("quantity_text"), clean_num("unit_text"), clean_num("total_text")
    value = F.when((total == 0) & (quantity > 0) & (unit > 0), F.round(quantity * unit, 2)).otherwise(total)
    text = F.coalesce(strip("description_text"), F.lit(""))
    text = F.when(text.isin("nan", "None"), "MERCADERIA HISTORICA").otherwise(text)
    lines = chosen.select(
        *KEYS, "row_idx",
        F.when(~strip("hs_text").isin("nan", "None"), strip("hs_text")).alias("hs_code"),
        F.nullif(F.regexp_extract(text, r"\b(\d{8,14})\b", 1), F.lit("")).alias("product_code"),
        text.alias("description"), _cell("brand_text").alias("brand"), quantity.alias("quantity"),
        F.lit("UNIDAD").alias("unit"), unit.alias("unit_value"), value.alias("total_value"),
        parse_tax_pct("vat_text").alias("vat_rate"), parse_tax_pct("duty_text").alias("duty_rate"),
        _cell("origin_text").alias("origin"), F.lit(1).alias("page"),
    )
    items = number_rows(lines, KEYS, "row_idx", "item_no")
    return build_headers(lines), items


def build_headers(lines: DataFrame) -> DataFrame:
    """One header per (number, date, importer) with its total and its origins."""
    sums = lines.groupBy(*KEYS).agg(
        F.round(F.sum("total_value"), 2).alias("fob"),
        F.nullif(F.array_join(F.array_sort(F.collect_set("origin")), ", "), F.lit("")).alias("origin"),
        F.count("*").alias("items"),
    )
    seed = F.concat_ws("_", F.lit("HISTORICO"), F.year("date").cast("string"), "number", "importer", plain_text("fob"))
    return sums.withColumns({k: F.lit(v) for k, v in HISTORICAL_HEADER.items()}).withColumns(
        {
            "owner": F.col("importer"), "freight": F.lit(0.0), "insurance": F.lit(0.0), "cif": F.col("fob"),
            "file_hash": F.sha2(seed, 256), "page_count": F.lit(1), "confidence": F.lit(1.0),
        }
    )
