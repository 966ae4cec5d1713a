"""Display text of header values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan.functions.dates import day_text
from portolan.functions.text import as_column, blank_to_null

# Field names that are shown without decimals.
INTEGER_FIELDS = {"taxable_value", "total", "total_taxes", "import_tax", "vat", "other_taxes", "packages"}


def format_value(value, field: str, kind: str) -> Column:
    """Display text of one header field; a dash where there is no value."""
    value = as_column(value)
    if kind == "number":
        shown = F.format_string("%,.0f" if field in INTEGER_FIELDS else "%,.2f", value)
        return F.when(value.isNull(), "-").otherwise(shown)
    if kind == "date":
        return F.coalesce(day_text(value), F.lit("-"))
    return F.coalesce(blank_to_null(value), F.lit("-"))


def field_meta(meta, field: str) -> Column:
    """Provenance of a field with defaults for hand-made headers."""
    record = F.try_element_at(as_column(meta), F.lit(field))
    return F.struct(
        F.coalesce(record["confidence"], F.lit(0.95)).alias("confidence"),
        F.coalesce(record["page"], F.lit(1)).alias("page"),
        F.coalesce(record["method"], F.lit("TEXT")).alias("method"),
    )
