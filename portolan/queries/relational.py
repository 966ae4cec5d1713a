"""Searches, joins, aggregates and paging over the sample declarations."""

from pyspark.sql import functions as F

from portolan.operators import aggregates as agg
from portolan.operators import search
from portolan.queries.oracle_tables import with_tables
from portolan.queries.registry import query
from portolan.sources import sample_tables as st

TODAY = "1998-06-15"

_HEADER_SQL = "id, number, date, importer, owner, origin, status, fob"
_ITEM_SQL = "id, dispatch_id, item_no, subitem_no, brand, hs_code, description, total_value"


def _header(df):
    return df.select(*[c.strip() for c in _HEADER_SQL.split(",")])


def _line(df):
    return df.select(*[c.strip() for c in _ITEM_SQL.split(",")])


@query("dispatch_search", with_tables(f"""
SELECT {_HEADER_SQL} FROM dispatches
WHERE (lower(number) LIKE '%1997%' OR lower(importer) LIKE '%1997%' OR lower(exporter) LIKE '%1997%'
  OR lower(importer_doc) LIKE '%1997%' OR lower(owner) LIKE '%1997%' OR lower(origin) LIKE '%1997%'
  OR lower(bl) LIKE '%1997%' OR lower(container) LIKE '%1997%' OR lower(customs_office) LIKE '%1997%'
  OR lower(broker) LIKE '%1997%' OR year(date) = 1997)
  AND status = 'CONFIRMADO' AND lower(owner) LIKE '%build%' AND lower(origin) LIKE '%nation_1%'"""))
def dispatch_search(spark, sf):
    return _header(search.search_dispatches(
        st.dispatches(spark, sf), q="1997", status="CONFIRMADO", owner="build", origin="nation_1"))


@query("dispatch_search_export", with_tables(f"""
SELECT {_HEADER_SQL} FROM dispatches
WHERE (lower(number) LIKE '%99%' OR lower(importer) LIKE '%99%' OR lower(exporter) LIKE '%99%'
  OR lower(owner) LIKE '%99%' OR lower(origin) LIKE '%99%' OR lower(bl) LIKE '%99%')
  AND year(date) = 1999"""))
def dispatch_search_export(spark, sf):
    return _header(search.search_dispatches_for_export(st.dispatches(spark, sf), q="99", year=1999))


@query("dispatch_search_wildcards", with_tables(f"""
SELECT {_HEADER_SQL} FROM dispatches WHERE importer ILIKE '%omer#00%5_%'"""))
def dispatch_search_wildcards(spark, sf):
    return _header(search.search_dispatches(st.dispatches(spark, sf), importer="omer#00%5_", wildcards=True))


@query("catalog_search", with_tables(f"""
SELECT i.id, dispatch_id, item_no, subitem_no, brand, hs_code, description, total_value, number, importer
FROM items i JOIN dispatches d ON d.id = i.dispatch_id
WHERE (lower(description) LIKE '%ring%' OR lower(brand) LIKE '%ring%' OR lower(product_code) LIKE '%ring%'
  OR lower(hs_code) LIKE '%ring%' OR lower(number) LIKE '%ring%' OR lower(importer) LIKE '%ring%' OR lower(owner) LIKE '%ring%')
  AND lower(brand) = 'brand#12' AND date >= DATE '1996-03-01' AND date <= DATE '1999-12-31'"""))
def catalog_search(spark, sf):
    df = search.search_items(st.items(spark, sf), st.dispatches(spark, sf), q="RING", brand=" brand#12 ",
                             date_from="01/03/1996", date_to="31-DIC-99")
    return df.select(*[c.strip() for c in _ITEM_SQL.split(",")], "number", "importer")


@query("catalog_search_equalities", with_tables("""
SELECT i.id, dispatch_id, hs_code, owner, number FROM items i JOIN dispatches d ON d.id = i.dispatch_id
WHERE hs_code = '3303.00.10.400L' AND owner = 'BUILDING'"""))
def catalog_search_equalities(spark, sf):
    df = search.search_items(st.items(spark, sf), st.dispatches(spark, sf), hs="3303.00.10.400L", owner="BUILDING",
                             date_from="not a date")
    return df.select("id", "dispatch_id", "hs_code", "owner", "number")


@query("catalog_lookup", with_tables("""
, ranked AS (
  SELECT i.*, d.number, d.importer, d.date,
    row_number() OVER (ORDER BY d.date DESC NULLS LAST, dispatch_id DESC, i.id DESC) AS rn
  FROM items i JOIN dispatches d ON d.id = i.dispatch_id
  WHERE lower(description) LIKE '%gizmo%' OR lower(brand) LIKE '%gizmo%' OR lower(product_code) LIKE '%gizmo%'
    OR lower(hs_code) LIKE '%gizmo%'),
priced AS (
  SELECT *, CASE WHEN coalesce(unit_value, 0) <> 0 THEN unit_value WHEN quantity > 0 AND total_value <> 0
    THEN round(total_value / quantity, 4) ELSE CAST(0 AS DOUBLE) END AS price
  FROM ranked WHERE rn <= 30)
SELECT id, CASE WHEN coalesce(brand, '') <> '' AND NOT contains(upper(description), upper(brand))
    THEN brand || ' - ' || description ELSE description END AS goods,
  coalesce(brand, '') AS brand, coalesce(product_code, '') AS product_code, coalesce(hs_code, '') AS hs_code,
  price AS normal_price, price AS invoice_price, number, importer, coalesce(strftime(date, '%d/%m/%Y'), '') AS date_text,
  rn = 1 AS most_recent
FROM priced"""))
def catalog_lookup(spark, sf):
    return search.catalog_lookup(st.items(spark, sf), st.dispatches(spark, sf), " gizmo ")


@query("review_queue", with_tables(f"""
SELECT {_HEADER_SQL} FROM dispatches WHERE status IN ('REVISAR', 'PROCESADO', 'DUPLICADO')"""))
def review_queue(spark, sf):
    return _header(search.review_queue(st.dispatches(spark, sf)))


@query("period_this_year", with_tables(f"SELECT {_HEADER_SQL} FROM dispatches WHERE date >= DATE '1998-01-01'"))
def period_this_year(spark, sf):
    return _header(search.period_filter(st.dispatches(spark, sf), TODAY, "year"))


@query("period_this_month", with_tables(f"SELECT {_HEADER_SQL} FROM dispatches WHERE date >= DATE '1998-06-01'"))
def period_this_month(spark, sf):
    return _header(search.period_filter(st.dispatches(spark, sf), TODAY, "month"))


@query("year_at_most", with_tables(f"SELECT {_HEADER_SQL} FROM dispatches WHERE year(date) <= 1997"))
def year_at_most(spark, sf):
    return _header(search.year_at_most(st.dispatches(spark, sf), 1997))


@query("filter_rows", with_tables(f"""
SELECT {_ITEM_SQL} FROM items WHERE lower(brand) LIKE '%8517%' OR lower(description) LIKE '%8517%'
  OR lower(product_code) LIKE '%8517%' OR lower(hs_code) LIKE '%8517%'"""))
def filter_rows(spark, sf):
    return _line(search.filter_rows(st.items(spark, sf), "8517", ["brand", "description", "product_code", "hs_code"]))


@query("filter_dispatch_items", with_tables(f"""
SELECT {_ITEM_SQL} FROM items
WHERE contains(lower(concat_ws(' ', item_no, subitem_no, hs_code, product_code, brand, description,
    printf('%.1f', quantity), unit)), 'small bolt')
  AND lower(brand) = 'brand#3' AND item_no = 2"""))
def filter_dispatch_items(spark, sf):
    return _line(search.filter_dispatch_items(st.items(spark, sf), q="Small Bolt", brand="BRAND#3", item_no=2))


@query("dispatch_item_facets", with_tables("""
SELECT dispatch_id, facet, value, count(*) AS lines FROM (
  SELECT dispatch_id, 'hs_code' AS facet, hs_code AS value FROM items
  UNION ALL SELECT dispatch_id, 'brand', brand FROM items
  UNION ALL SELECT dispatch_id, 'item_no', CAST(item_no AS VARCHAR) FROM items)
WHERE value IS NOT NULL AND value <> '' GROUP BY ALL"""))
def dispatch_item_facets(spark, sf):
    return search.dispatch_item_facets(st.items(spark, sf))


@query("brand_summary", with_tables("""
SELECT brand, count(*) AS items, count(DISTINCT dispatch_id) AS dispatches,
  coalesce(strftime(max(date), '%d/%m/%Y'), '-') AS last_date
FROM items i JOIN dispatches d ON d.id = i.dispatch_id WHERE brand IS NOT NULL AND brand <> '' GROUP BY brand"""))
def brand_summary(spark, sf):
    return agg.brand_summary(st.items(spark, sf), st.dispatches(spark, sf))


@query("brand_filter", with_tables("""
SELECT brand, count(*) AS items, count(DISTINCT dispatch_id) AS dispatches,
  coalesce(strftime(max(date), '%d/%m/%Y'), '-') AS last_date
FROM items i JOIN dispatches d ON d.id = i.dispatch_id WHERE lower(brand) LIKE '%and#1%' GROUP BY brand"""))
def brand_filter(spark, sf):
    return agg.brand_summary(st.items(spark, sf), st.dispatches(spark, sf), q=" AND#1 ")


@query("dashboard_kpis", with_tables("""
SELECT (SELECT count(*) FROM dispatches) AS dispatches,
  (SELECT count(*) FROM dispatches WHERE date >= DATE '1998-01-01') AS this_year,
  (SELECT count(*) FROM dispatches WHERE date >= DATE '1998-06-01') AS this_month,
  (SELECT count(*) FROM dispatches WHERE status = 'REVISAR') AS to_review,
  (SELECT count(*) FROM dispatches WHERE status = 'CONFIRMADO') AS confirmed,
  (SELECT count(*) FROM dispatches WHERE status = 'PROCESADO') AS processed,
  (SELECT round(sum(fob), 2) FROM dispatches) AS fob,
  (SELECT round(sum(total), 2) FROM dispatches) AS total,
  (SELECT round(sum(net_weight), 2) FROM dispatches) AS net_weight,
  (SELECT count(*) FROM items) AS items,
  (SELECT count(DISTINCT brand) FROM items WHERE brand <> '') AS brands"""))
def dashboard_kpis(spark, sf):
    return agg.dashboard_kpis(st.dispatches(spark, sf), st.items(spark, sf), TODAY)


@query("effective_cif", with_tables("""
SELECT CASE WHEN sum(cif) = 0 AND sum(fob) > 0 THEN round(sum(fob) + sum(freight) + sum(insurance), 2)
  ELSE round(sum(cif), 2) END AS cif FROM dispatches"""))
def effective_cif(spark, sf):
    return agg.effective_cif(st.dispatches(spark, sf))


@query("effective_cif_from_parts", with_tables("""
SELECT round(sum(fob) + sum(freight) + sum(insurance), 2) AS cif FROM dispatches WHERE cif = 0"""))
def effective_cif_from_parts(spark, sf):
    return agg.effective_cif(st.dispatches(spark, sf).filter("cif = 0"))


@query("company_counts", with_tables("""
SELECT (SELECT count(DISTINCT importer) FROM dispatches) AS importers,
  (SELECT count(DISTINCT exporter) FROM dispatches) AS exporters,
  (SELECT count(*) FROM (SELECT importer FROM dispatches UNION SELECT exporter FROM dispatches)) AS companies"""))
def company_counts(spark, sf):
    return agg.company_counts(st.dispatches(spark, sf))


@query("union_companies", with_tables("""
SELECT importer AS company FROM dispatches UNION SELECT exporter FROM dispatches"""))
def union_companies(spark, sf):
    return agg.union_companies(st.dispatches(spark, sf)).select("company")


@query("by_year", with_tables("""
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS dispatches, round(sum(fob), 2) AS fob FROM dispatches
WHERE date IS NOT NULL GROUP BY 1"""))
def by_year(spark, sf):
    return agg.dispatches_by_year(st.dispatches(spark, sf))


@query("rows_per_year", with_tables("""
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS lines FROM items JOIN dispatches d ON d.id = dispatch_id
WHERE date IS NOT NULL GROUP BY 1"""))
def rows_per_year(spark, sf):
    return agg.rows_per_year(search.items_with_dispatch(st.items(spark, sf), st.dispatches(spark, sf)))


@query("by_origin_top8", with_tables("""
SELECT origin, count(*) AS dispatches, round(sum(fob), 2) AS fob FROM dispatches WHERE origin <> ''
GROUP BY origin ORDER BY dispatches DESC, origin LIMIT 8"""))
def by_origin_top8(spark, sf):
    return agg.dispatches_by_origin(st.dispatches(spark, sf))


@query("top_brands", with_tables("""
SELECT brand, count(*) AS items, round(sum(total_value), 2) AS total_value FROM items WHERE brand <> ''
GROUP BY brand ORDER BY items DESC, brand LIMIT 15"""))
def top_brands(spark, sf):
    return agg.top_brands(st.items(spark, sf))


@query("catalog_kpis", with_tables("""
, f AS (
  SELECT nullif(brand, '') AS brand, hs_code, nullif(i.origin, '') AS origin
  FROM items i JOIN dispatches d ON d.id = i.dispatch_id
  WHERE date >= DATE '1996-01-01' AND date <= DATE '1999-12-31'),
h AS (SELECT hs_code, count(*) AS n FROM f WHERE hs_code IS NOT NULL GROUP BY 1 ORDER BY n DESC, hs_code LIMIT 1),
o AS (SELECT origin, count(*) AS n FROM f WHERE origin IS NOT NULL GROUP BY 1 ORDER BY n DESC, origin LIMIT 1)
SELECT (SELECT count(*) FROM f) AS items, (SELECT count(DISTINCT brand) FROM f) AS brands,
  (SELECT count(DISTINCT hs_code) FROM f) AS hs_codes, (SELECT hs_code FROM h) AS top_hs,
  (SELECT n FROM h) AS top_hs_items, (SELECT origin FROM o) AS top_origin"""))
def catalog_kpis(spark, sf):
    return agg.catalog_kpis(search.search_items(
        st.items(spark, sf), st.dispatches(spark, sf), date_from="1996-01-01", date_to="1999-12-31"))


@query("executive_summary", with_tables("""
SELECT * FROM (VALUES ('Total de Despachos Registrados', (SELECT CAST(count(*) AS DOUBLE) FROM dispatches)),
  ('Total de Ítems / Subítems', (SELECT CAST(count(*) AS DOUBLE) FROM items)),
  ('Valor FOB Total (USD)', (SELECT round(sum(fob), 2) FROM dispatches)),
  ('Valor CIF Total (USD)', (SELECT round(sum(cif), 2) FROM dispatches)),
  ('Total Impuestos / Tributos (Gs)', (SELECT round(sum(total), 2) FROM dispatches)),
  ('Peso Neto Total (Kg)', (SELECT round(sum(net_weight), 2) FROM dispatches))) t(metric, value)"""))
def executive_summary(spark, sf):
    return agg.executive_summary(st.dispatches(spark, sf), st.items(spark, sf))


@query("items_value_sum", with_tables("""
SELECT dispatch_id, round(sum(total_value), 2) AS items_value FROM items GROUP BY 1"""))
def items_value_sum(spark, sf):
    return agg.items_value_sum(st.items(spark, sf), "dispatch_id").withColumn("items_value", F.round("items_value", 2))


@query("order_recent_page", with_tables("""
SELECT id, number, date FROM dispatches ORDER BY date DESC NULLS LAST, id DESC LIMIT 35 OFFSET 70"""))
def order_recent_page(spark, sf):
    return search.paginate(st.dispatches(spark, sf).select("id", "number", "date"), search.recent_first(), 3, 35)


@query("paginate_items", with_tables("""
SELECT i.id, dispatch_id, item_no, subitem_no, date FROM items i JOIN dispatches d ON d.id = i.dispatch_id
ORDER BY date DESC NULLS LAST, dispatch_id DESC, item_no NULLS FIRST, subitem_no NULLS FIRST, i.id LIMIT 50 OFFSET 100"""))
def paginate_items(spark, sf):
    joined = search.items_with_dispatch(st.items(spark, sf), st.dispatches(spark, sf))
    return search.paginate(joined.select("id", "dispatch_id", "item_no", "subitem_no", "date"), search.item_order(), 3, 50)


@query("page_info", with_tables("""
SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages,
  least(999999, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT)) AS page,
  count(*) > 50 AS has_prev, false AS has_next FROM items"""))
def page_info(spark, sf):
    return search.page_info(st.items(spark, sf), 999999, 50)


@query("page_after", with_tables("""
SELECT id, number, date FROM dispatches WHERE date < DATE '1998-06-15' OR (date = DATE '1998-06-15' AND id < 700) OR date IS NULL
ORDER BY date DESC NULLS LAST, id DESC LIMIT 35"""))
def page_after(spark, sf):
    return search.page_after(st.dispatches(spark, sf).select("id", "number", "date"), ("1998-06-15", 700), 35)


_DATED_ITEMS = """
, dated AS (SELECT i.id, dispatch_id, item_no, subitem_no, date FROM items i JOIN dispatches d ON d.id = dispatch_id),
placed AS (SELECT *, row_number() OVER (ORDER BY date DESC NULLS LAST, dispatch_id DESC, item_no NULLS FIRST, subitem_no NULLS FIRST, id) AS place FROM dated)
"""


def _dated_items(spark, sf):
    dates = st.dispatches(spark, sf).select(F.col("id").alias("dispatch_id"), "date")
    return st.items(spark, sf).select("id", "dispatch_id", "item_no", "subitem_no").join(dates, "dispatch_id")


@query("items_page_after", with_tables(_DATED_ITEMS + """
SELECT id, dispatch_id, item_no, subitem_no, date FROM placed
WHERE place > (SELECT max(place) FROM placed WHERE date > DATE '1996-03-05' OR (date = DATE '1996-03-05' AND dispatch_id >= 500)) AND place <=
  30 + (SELECT max(place) FROM placed WHERE date > DATE '1996-03-05' OR (date = DATE '1996-03-05' AND dispatch_id >= 500))"""))
def items_page_after(spark, sf):
    """The page behind the last line a declaration 500 of that day would have."""
    last = {"date": "1996-03-05", "dispatch_id": 500, "item_no": 1 << 30, "subitem_no": None, "id": ""}
    return search.rows_after(_dated_items(spark, sf), search.ITEM_ORDER, last, 30)


@query("items_page_of_index", with_tables(_DATED_ITEMS + """
SELECT id, dispatch_id, item_no, subitem_no, date FROM placed WHERE place > 119 * 40 AND place <= 120 * 40"""))
def items_page_of_index(spark, sf):
    import uuid

    from portolan.session import shared_folder

    path = shared_folder(spark, f"pages/items-{uuid.uuid4().hex}")
    search.write_page_index(_dated_items(spark, sf), search.ITEM_ORDER, path)
    return search.page_of_index(spark, path, 120, 40)


@query("latest_dispatches", with_tables("""
SELECT id, number, date FROM dispatches ORDER BY date DESC NULLS LAST, id DESC LIMIT 10"""))
def latest_dispatches(spark, sf):
    return search.latest(st.dispatches(spark, sf).select("id", "number", "date"), 10)


@query("items_of_filtered_dispatches", with_tables("""
SELECT i.id, i.dispatch_id, coalesce(number, '') AS number, coalesce(owner, '') AS owner
FROM items i JOIN dispatches d ON d.id = i.dispatch_id WHERE status = 'REVISAR'"""))
def items_of_filtered_dispatches(spark, sf):
    from portolan.operators.joins import items_of

    chosen = search.search_dispatches(st.dispatches(spark, sf), status="REVISAR")
    return items_of(st.items(spark, sf), chosen).select("id", "dispatch_id", "number", "owner")


@query("dispatch_children", with_tables("""
SELECT d.id, number, count(i.id) AS items, round(coalesce(sum(total_value), 0), 2) AS items_value
FROM dispatches d LEFT JOIN items i ON d.id = i.dispatch_id GROUP BY d.id, number"""))
def dispatch_children(spark, sf):
    from portolan.operators.joins import dispatch_children as children

    return children(st.dispatches(spark, sf), st.items(spark, sf)).select(
        "id", "number", "items", F.round("items_value", 2).alias("items_value"))
