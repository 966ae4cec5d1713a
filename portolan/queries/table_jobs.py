"""The table jobs over raw text made of the sample tables: every row is printed, read back and checked in all columns."""

from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.plans import table_jobs
from portolan.queries.oracle_tables import with_tables
from portolan.queries.registry import query
from portolan.sources import sample_pages as sp
from portolan.sources import sample_tables as st

_COMPANIES = ["Florace Import", "GAFA s.a.", " eras ", "H.T. sa", "Karry, S.A.", "jordana", "Serena", "suntec", "La  Gloria", "MEGA", "agatres", "ht"]
_CANONICAL = ["FLORACE S.A.", "GAFA S.A.", "ERAS S.R.L.", "H.T. S.A.", "KARRY S.A.", "JORDANA", "SERENA", "SUNTEC", "LA GLORIA", "MEGA", "AGATRES", "H.T. S.A."]


@query("normalize_headers", with_tables(f"""
, r AS (SELECT *, date + INTERVAL 12 YEAR AS later, id % 23 = 3 AS lost, id % 29 = 4 AS vague FROM dispatches)
, m AS (SELECT *, CASE WHEN id % 4 = 0 THEN round(fob * 2, 2) ELSE fob END AS new_fob FROM r)
, c AS (SELECT *, CASE WHEN cif <= 0 THEN round(new_fob + freight + insurance, 2) ELSE cif END AS new_cif FROM m)
, e AS (SELECT *, list_concat(
    CASE WHEN abs(new_cif - (new_fob + freight + insurance)) / new_cif * 100 > 5 THEN ['CIF'] ELSE [] END, CASE WHEN later IS NOT NULL AND NOT vague AND year(later) > 2008 THEN ['future'] ELSE [] END) AS bad FROM c)
SELECT id, number, CASE WHEN NOT vague THEN CAST(later AS DATE) END AS date, CASE WHEN lost THEN {_CANONICAL}[id % 12 + 1] ELSE upper(importer) END AS importer, importer_doc, upper(exporter) AS exporter,
  broker, channel, CASE channel WHEN 'VERDE' THEN 'green' WHEN 'NARANJA' THEN 'orange' ELSE 'red' END AS light, CASE id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
  new_fob AS fob, freight, insurance, new_cif AS cif, CASE WHEN id % 2 = 0 THEN 'PARAGUAY_SOFIA' ELSE 'UNKNOWN' END AS doc_type, CASE WHEN vague THEN 'date' ELSE '' END AS unreadable, len(bad) AS errors,
  CASE WHEN id % 31 = 5 THEN 'DUPLICADO' WHEN vague OR later IS NULL OR confidence < {fv.REVIEW_CONFIDENCE} OR len(bad) > 0 THEN 'REVISAR' ELSE 'PROCESADO' END AS status FROM e"""))
def normalize_headers(spark, sf):
    d = st.dispatches(spark, sf)
    key, day = F.col("id"), F.add_months("date", 144)
    shown = F.when(key % 29 == 4, "sin fecha").when(key % 2 == 0, F.date_format(day, "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    names = F.element_at(F.array(*map(F.lit, _COMPANIES)), (key % 12 + 1).cast("int"))
    amounts = {n: F.concat(F.lit("USD "), sp.local_amount(st.cents(n))) for n in ("fob", "freight", "insurance", "cif")}
    raw = d.select(
        "id", F.concat(F.lit(" **"), "number", F.lit("\n")).alias("number"), shown.alias("date"), F.when(key % 23 == 3, names).otherwise(F.col("importer")).alias("importer"),
        F.concat(F.lit("RUC/DOC: "), "importer_doc").alias("importer_doc"), F.lower("exporter").alias("exporter"), F.concat(F.lit("  "), "broker").alias("broker"), F.lower("channel").alias("channel"),
        F.when(key % 3 == 0, "dol").when(key % 3 == 2, "Eur").alias("currency"), *(v.alias(n) for n, v in amounts.items()), F.when(key % 2 == 0, "despacho numero: x").alias("first_page"),
        F.when(key % 4 == 0, F.col("fob") * 2).alias("items_value"), "confidence", (key % 31 == 5).alias("is_duplicate"),
    )
    out = table_jobs.normalize_headers(raw, "2006-06-01")
    names = [c for c in out.columns if c not in ("broker_doc", "confidence", "is_duplicate", "unreadable", "errors")]
    return out.select(*names, F.array_join("unreadable", ",").alias("unreadable"), F.size("errors").cast("bigint").alias("errors"))


@query("clean_items", with_tables("""
, r AS (SELECT items.*, upper(p_name) AS name, l_partkey, l_suppkey FROM items JOIN lineitem ON items.id = concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))
    JOIN part ON p_partkey = l_partkey)
SELECT id, dispatch_id, name AS description, CASE WHEN coalesce(brand, '') = '' THEN 'Sin Marca' WHEN brand = 'Brand#1' THEN 'HOUSE' ELSE brand END AS brand,
  coalesce(product_code, CAST(l_partkey + 7840000000000 AS VARCHAR)) AS product_code,
  CASE WHEN coalesce(brand, '') = '' THEN '' WHEN brand = 'Brand#1' THEN 'HOUSE' ELSE replace(upper(brand), '#', '') END AS skeleton,
  CASE WHEN coalesce(brand, '') = '' THEN name WHEN brand = 'Brand#1' THEN 'HOUSE - ' || name ELSE brand || ' - ' || name END AS label, hs_code,
  quantity, CAST(round(CAST(CAST(total_value / quantity AS VARCHAR) AS DECIMAL(38,20)), 4) AS DOUBLE) AS unit_value, total_value, '' AS unreadable FROM r"""))
def clean_items(spark, sf):
    i = st.items(spark, sf)
    name, part = F.regexp_replace("description", r" \d+ML$", ""), F.element_at(F.split("id", "-"), 3).cast("bigint")
    ean = (part + F.lit(7840000000000)).cast("string")
    money = lambda c: sp.local_amount(F.round(c * 100).cast("bigint"))
    raw = i.select("id", "dispatch_id", F.concat_ws(" ", ean, name).alias("description"), F.concat(F.lit(" "), "brand", F.lit(" ")).alias("brand"), "product_code", "hs_code",
                   money(F.col("quantity")).alias("quantity"), F.lit("0,00").alias("unit_value"), money(F.col("total_value")).alias("total_value"))
    rules = spark.createDataFrame([("brand#1", "HOUSE")], "pattern string, target string")
    out = table_jobs.clean_items(raw, rules)
    return out.select("id", "dispatch_id", "description", "brand", "product_code", "skeleton", "label", "hs_code", "quantity", "unit_value", "total_value", F.array_join("unreadable", ",").alias("unreadable"))


@query("normalize_sheet_rows", with_tables("""
, r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_shipdate AS DATE) AS day, upper(p_name) AS name, l_partkey + 7840000000000 AS ean, l_quantity AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_linenumber AS n, l_tax, l_discount
    FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT id, n, CASE WHEN n % 5 = 4 THEN NULL ELSE day END AS date, CASE WHEN n % 2 = 0 THEN CAST(ean AS VARCHAR) || ' ' || name ELSE name END AS goods, CAST(ean AS VARCHAR) AS product_code, q AS quantity,
  CAST(cents AS DOUBLE) / 100 AS invoice_price, CASE WHEN n % 3 = 0 THEN CAST(cents + 100 AS DOUBLE) / 100 END AS normal_price,
  CASE WHEN n % 4 = 1 THEN CAST(cents * 2 AS DOUBLE) / 100 WHEN n % 3 = 0 THEN round(q * (CAST(cents + 100 AS DOUBLE) / 100), 2) ELSE round(q * (CAST(cents AS DOUBLE) / 100), 2) END AS line_total,
  CAST(cents AS DOUBLE) / 100 AS adjusted_value, CASE WHEN l_tax = 0.01 THEN CAST(1 AS DOUBLE) ELSE l_tax END AS vat_rate, CASE WHEN n % 7 = 2 THEN NULL ELSE CAST(0.1 AS DOUBLE) END AS duty_rate,
  concat_ws(',', CASE WHEN n % 7 = 2 THEN 'duty' END, CASE WHEN n % 5 = 4 THEN 'date' END) AS unreadable FROM r"""))
def normalize_sheet_rows(spark, sf):
    parts = st.read_table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey")
    lines = st.read_table(spark, sf, "lineitem").join(parts, "l_partkey")
    n, cents, ean = F.col("l_linenumber"), st.cents("l_extendedprice"), (F.col("l_partkey") + F.lit(7840000000000)).cast("string")
    serial = F.datediff("l_shipdate", F.lit("1899-12-30").cast("date")).cast("string")
    raw = lines.select(
        (F.col("l_orderkey") * 10 + n).alias("id"), n.alias("n"), F.when(n % 5 == 4, "pronto").when(n % 2 == 0, serial).otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("date"),
        F.when(n % 2 == 0, F.concat_ws(" ", ean, F.upper("p_name"))).otherwise(F.concat(F.lit("**"), F.upper("p_name"))).alias("goods"), F.when(n % 2 == 1, F.concat(ean, F.lit(".0"))).alias("product_code"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" ")).alias("quantity"), F.concat(F.lit("$ "), sp.local_amount(cents)).alias("invoice_price"),
        F.when(n % 3 == 0, sp.us_amount(cents + 100)).alias("normal_price"), F.when(n % 4 == 1, sp.local_amount(cents * 2)).when(n % 4 == 2, "0").alias("total"), sp.us_amount(cents).alias("adjusted_value"),
        F.concat(F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit("%")).alias("vat"), F.when(n % 7 == 2, "n/a").otherwise("10%").alias("duty"),
    )
    out = table_jobs.normalize_sheet_rows(raw)
    return out.select("id", "n", "date", "goods", "product_code", "quantity", "invoice_price", "normal_price", "line_total", "adjusted_value", "vat_rate", "duty_rate", F.array_join("unreadable", ",").alias("unreadable"))
