"""Filters, searches, ordering and paging over declarations, goods and worksheets."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.functions import goods, numbers
from portolan.functions.dates import day_text, parse_date
from portolan.functions.text import contains_any, contains_text, non_blank, strip
from portolan.session import cut_lineage

DISPATCH_COLUMNS = [
    "number", "importer", "exporter", "importer_doc", "owner", "origin", "bl", "container", "customs_office", "broker",
]
EXPORT_COLUMNS = ["number", "importer", "exporter", "owner", "origin", "bl"]
ITEM_COLUMNS = ["description", "brand", "product_code", "hs_code", "number", "importer", "owner"]
CATALOG_COLUMNS = ["description", "brand", "product_code", "hs_code"]
SHEET_COLUMNS = ["dispatch_number", "invoice", "importer", "owner"]


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions, F.lit(True))


def search_dispatches(
    df: DataFrame, q=None, status=None, importer=None, owner=None, origin=None, year=None,
    columns=DISPATCH_COLUMNS, wildcards: bool = False,
) -> DataFrame:
    """Declarations that match all given criteria.

    ``q`` is looked for in every searched column; four digits also match the
    year.  Equality on status and the year range reach the Parquet scan.
    """
    conditions = []
    if q:
        hit = contains_any(columns, q, wildcards)
        if q.strip().isdigit() and len(q.strip()) == 4:
            hit = hit | F.coalesce(F.year("date") == int(q), F.lit(False))
        conditions.append(hit)
    if status:
        conditions.append(F.col("status") == status)
    for column, value in (("importer", importer), ("owner", owner), ("origin", origin)):
        if value:
            conditions.append(contains_text(column, value, wildcards))
    if year:
        first = F.make_date(F.lit(int(year)), F.lit(1), F.lit(1))
        conditions.append((F.col("date") >= first) & (F.col("date") < F.add_months(first, 12)))
    return df.filter(_all(conditions))


def search_dispatches_for_export(df: DataFrame, **criteria) -> DataFrame:
    """The same search over the six columns of the export."""
    return search_dispatches(df, columns=EXPORT_COLUMNS, **criteria)


def items_with_dispatch(items: DataFrame, dispatches: DataFrame, columns=("number", "date", "importer", "owner")) -> DataFrame:
    """Goods lines with columns of their declaration (inner equi-join)."""
    headers = dispatches.select(F.col("id").alias("dispatch_id"), *columns)
    return items.join(headers, "dispatch_id")


def date_bound(spark, text) -> str | None:
    """A bound given as text, as an ISO date; None where it is not a date."""
    if not text:
        return None
    row = spark.range(1).select(parse_date(F.lit(text)).cast("string")).first()
    return row[0]


def search_items(
    items: DataFrame, dispatches: DataFrame, q=None, brand=None, hs=None, owner=None, dispatch_id=None,
    date_from=None, date_to=None, wildcards: bool = False,
) -> DataFrame:
    """Goods lines joined with their declaration and filtered."""
    spark = items.sparkSession
    conditions = []
    if q:
        conditions.append(contains_any(ITEM_COLUMNS, q, wildcards))
    if brand:
        conditions.append(F.lower("brand") == brand.strip().lower())
    if hs:
        conditions.append(F.col("hs_code") == hs)
    if owner:
        conditions.append(F.col("owner") == owner)
    if dispatch_id:
        conditions.append(F.col("dispatch_id") == dispatch_id)
    lower, upper = date_bound(spark, date_from), date_bound(spark, date_to)
    if lower:
        conditions.append(F.col("date") >= F.lit(lower).cast("date"))
    if upper:
        conditions.append(F.col("date") <= F.lit(upper).cast("date"))
    return items_with_dispatch(items, dispatches).filter(_all(conditions))


def search_sheets(df: DataFrame, q=None, status=None, importer=None, wildcards: bool = False) -> DataFrame:
    conditions = []
    if q:
        conditions.append(contains_any(SHEET_COLUMNS, q, wildcards))
    if status:
        conditions.append(F.col("status") == status)
    if importer:
        conditions.append(contains_text("importer", importer, wildcards))
    return df.filter(_all(conditions))


def catalog_lookup(items: DataFrame, dispatches: DataFrame, q: str, limit: int = 30) -> DataFrame:
    """The newest goods lines that contain ``q``, with price and label.

    The first row of the answer is flagged as the most recent one.
    """
    term = q.strip()
    hits = items.filter(contains_any(CATALOG_COLUMNS, term))
    joined = items_with_dispatch(hits, dispatches, ("number", "date", "importer"))
    newest = [F.desc_nulls_last("date"), F.desc("dispatch_id"), F.desc("id")]
    top = joined.orderBy(*newest).limit(limit)
    # The answer is at most ``limit`` rows, so marking its first row may use one task.
    best = top.agg(F.max(F.struct(F.coalesce("date", F.lit("0001-01-01").cast("date")), "dispatch_id", "id")).alias("best"))
    price = numbers.unit_price("unit_value", "quantity", "total_value")
    shown = top.select(
        "id",
        goods.goods_label("brand", "description").alias("goods"),
        F.coalesce("brand", F.lit("")).alias("brand"),
        F.coalesce("product_code", F.lit("")).alias("product_code"),
        F.coalesce("hs_code", F.lit("")).alias("hs_code"),
        price.alias("normal_price"),
        price.alias("invoice_price"),
        F.coalesce("number", F.lit("")).alias("number"),
        F.coalesce("importer", F.lit("")).alias("importer"),
        F.coalesce(day_text("date"), F.lit("")).alias("date_text"),
    )
    return shown.join(
        best.select(F.col("best.id").alias("id"), F.lit(True).alias("most_recent")), "id", "left"
    ).withColumn("most_recent", F.coalesce("most_recent", F.lit(False)))


def filter_brands(df: DataFrame, q: str, column: str = "brand") -> DataFrame:
    return df.filter(contains_text(column, q.strip()))


def review_queue(df: DataFrame) -> DataFrame:
    """Headers that wait for a person, newest first."""
    waiting = df.filter(F.col("status").isin("REVISAR", "PROCESADO", "DUPLICADO"))
    return waiting.orderBy(F.desc_nulls_last("created_at"), F.desc("id"))


def period_filter(df: DataFrame, today: str, period: str) -> DataFrame:
    """Headers dated in the running year or month of the given day, or later."""
    return df.filter(F.col("date") >= F.trunc(F.lit(today).cast("date"), period))


def year_at_most(df: DataFrame, last_year: int, column: str = "date") -> DataFrame:
    return df.filter(F.col(column) < F.make_date(F.lit(last_year + 1), F.lit(1), F.lit(1)))


def filter_rows(df: DataFrame, q: str, columns) -> DataFrame:
    """Rows where any of the shown columns contains ``q``."""
    return df.filter(contains_any(columns, q))


ROW_COLUMNS = ["item_no", "subitem_no", "hs_code", "product_code", "brand", "description", "quantity", "unit"]


def filter_dispatch_items(items: DataFrame, q=None, hs=None, brand=None, item_no=None) -> DataFrame:
    """Goods lines of a declaration view: ``q`` is looked for in the whole row text."""
    conditions = []
    if q:
        row_text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in ROW_COLUMNS]))
        conditions.append(row_text.contains(q.lower()))
    if hs:
        conditions.append(F.col("hs_code") == hs)
    if brand:
        conditions.append(F.lower("brand") == brand.lower())
    if item_no is not None:
        conditions.append(F.col("item_no") == item_no)
    return items.filter(_all(conditions))


def dispatch_item_facets(items: DataFrame) -> DataFrame:
    """Distinct codes, brands and item numbers of a declaration, first seen first.

    The lines are dealt once, by ranges of declarations, before each becomes three entries: counting and sorting
    need no further exchange.  The lines of a declaration, which is one file, meet in one task.
    """
    place = F.struct(F.col("item_no"), F.coalesce("subitem_no", F.lit(0)), F.col("id").cast("string"))
    entries = F.array(
        *[
            F.struct(F.lit(kind).alias("facet"), F.col(column).cast("string").alias("value"))
            for kind, column in (("hs_code", "hs_code"), ("brand", "brand"), ("item_no", "item_no"))
        ]
    )
    lines = items.select("dispatch_id", "item_no", "subitem_no", "id", "hs_code", "brand").repartitionByRange("dispatch_id")
    seen = lines.select("dispatch_id", place.alias("place"), F.inline(entries)).filter(non_blank("value"))
    first = seen.groupBy("dispatch_id", "facet", "value").agg(F.min("place").alias("place"), F.count("*").alias("lines"))
    return first.orderBy("dispatch_id", "facet", "place").select("dispatch_id", "facet", "value", "lines")


def valid_product_row(description, quantity, unit, total) -> Column:
    """Worksheet rows that are goods: named, not a footer, counted and priced."""
    text = F.lower(description)
    words = "|".join("(?:" + "".join("\\" + ch if ch in "/$." else ch for ch in w) + ")" for w in fv.FOOTER_WORDS)
    footer = text.rlike(f"^(?:{words})$|^(?:{words})[ :]|(?s) (?:{words})$")
    priced = (unit > 0) | (total > 0)
    return (F.length(strip(description)) >= 3) & ~footer & (quantity > 0) & priced


# Ordering and paging --------------------------------------------------------


def recent_first() -> list[Column]:
    return [F.desc_nulls_last("date"), F.desc("id")]


def order_recent(df: DataFrame) -> DataFrame:
    return df.orderBy(*recent_first())


def item_order() -> list[Column]:
    """Newest declaration first, then line order; the id settles equal lines."""
    return [
        F.desc_nulls_last("date"), F.desc("dispatch_id"), F.asc_nulls_first("item_no"),
        F.asc_nulls_first("subitem_no"), F.asc("id"),
    ]


def order_items(df: DataFrame) -> DataFrame:
    return df.orderBy(*item_order())


def order_sheets(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("updated_at"), F.desc("id"))


def latest(df: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    return df.orderBy(*(order or recent_first())).limit(n)


def top_k(df: DataFrame, measure: str, tie: str, k: int) -> DataFrame:
    """The k largest groups; equal measures are ordered by name."""
    return df.orderBy(F.desc(measure), F.asc(tie)).limit(k)


def page_info(df: DataFrame, page: int, per_page: int) -> DataFrame:
    """One row about the pages of a result: total, pages, shown page, neighbours."""
    counted = df.agg(F.count("*").alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint")
    shown = F.least(F.lit(page).cast("bigint"), F.col("pages"))
    return (
        counted.withColumn("pages", pages)
        .withColumn("page", shown)
        .withColumn("has_prev", F.col("page") > 1)
        .withColumn("has_next", F.col("page") < F.col("pages"))
    )


def paginate(df: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """One page of an ordered result; pages behind the last show the last one.

    Only a row count travels to the driver.  The rows up to the page are a top-n over
    ``page * per_page`` rows, found once and written to the checkpoint folder: if they are fewer, they
    are all there are.  Use :func:`page_after` to walk far into a result.
    """
    first = cut_lineage(df.orderBy(*order).limit(page * per_page))
    page = min(page, max(1, math.ceil(first.count() / per_page)))
    return first.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def page_after(df: DataFrame, last, per_page: int) -> DataFrame:
    """The page behind a given (date, id), both descending: cost does not grow with depth."""
    date, key = last
    return rows_after(df, [("date", False), ("id", False)], {"date": date, "id": key}, per_page)


#: Orders (column, ascending) of goods lines and worksheets that end in a unique column.
ITEM_ORDER = [("date", False), ("dispatch_id", False), ("item_no", True), ("subitem_no", True), ("id", True)]
SHEET_ORDER = [("updated_at", False), ("id", False)]


def _sorted_by(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in order]


def rows_after(df: DataFrame, order: list[tuple[str, bool]], last: dict, per_page: int) -> DataFrame:
    """The ``per_page`` rows behind ``last`` (column to value) in an order of (column, ascending): a filter and a top-n.

    NULL is the lowest value: first where a column rises, last where it falls.  The last column must be unique.
    """
    kinds = dict(df.dtypes)
    behind, same = F.lit(False), F.lit(True)
    for name, up in order:
        c, v = F.col(name), F.lit(last[name]).cast(kinds[name])
        if last[name] is None:
            further = c.isNotNull() if up else F.lit(False)
        else:
            further = F.coalesce(c > v, F.lit(False)) if up else (c < v) | c.isNull()
        behind, same = behind | (same & further), same & c.eqNullSafe(v)
    return df.filter(behind).orderBy(*_sorted_by(order)).limit(per_page)


def write_page_index(df: DataFrame, order: list[tuple[str, bool]], path: str) -> None:
    """Store rows in order, as ranges with numbered rows: column ``_range`` rises with the order, ``_row`` counts from 0 in each."""
    by = _sorted_by(order)
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = ranged.withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() % (1 << 33))
    numbered.write.parquet(path)


def page_of_index(spark, path: str, page: int, per_page: int) -> DataFrame:
    """A page of a stored order, whatever its depth; pages behind the last show the last one.

    Each range is a file of its own, so the filter on ``_range`` leaves out the others by their statistics.
    """
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()  # one short row per range
    total = sum(r.n for r in sizes)
    first = (min(page, max(1, math.ceil(total / per_page))) - 1) * per_page
    wanted, before = F.lit(False), 0
    for r in sizes:
        low, high = max(first - before, 0), min(first + per_page - before, r.n)
        if low < high:
            wanted = wanted | ((F.col("_range") == r["_range"]) & F.col("_row").between(low, high - 1))
        before += r.n
    return rows.filter(wanted).orderBy("_range", "_row").drop("_range", "_row")
