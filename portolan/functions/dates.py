"""Dates written in the ways customs papers and worksheets write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.functions.text import as_column, clean_text, let, strip


# How the spellings of a date become year-month-day, one rewrite after another.
# Two-digit years turn at 50 next to a month name and at 69 otherwise.
_MONTHS = {}
for _name, _number in fv.MONTH_PREFIXES.items():
    _MONTHS.setdefault(_number, []).append(_name)
_NUMERIC = [
    (r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$", "$4-$3-$1"), (r"^(\d{1,2})([/-])(\d{1,2})\2(69|[7-9]\d)$", "19$4-$3-$1"),
    (r"^(\d{1,2})([/-])(\d{1,2})\2(\d{2})$", "20$4-$3-$1"), (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
]
_NAMED = [
    (r"(?i)^(\d{1,2})[-/](?:" + "|".join(names) + r")[a-z]*[-/](\d{2,4})$", f"$2-{number}-$1") for number, names in _MONTHS.items()
]
_USUAL = r"^([0-9]{1,2})([/-])([0-9]{1,2})\2(?!0000)([0-9]{4})(?: [0-9:]+)*+\z"
_YEARS = [(r"^([0-4]\d|50)-", "20$1-"), (r"^(5[1-9]|[6-9]\d)-", "19$1-"), (r"^(\d{3})-", "0$1-")]


def _rewritten(text: Column, rules) -> Column:
    for pattern, shape in rules:
        text = F.regexp_replace(text, pattern, shape)
    return text


def parse_date(c) -> Column:
    """A date from text such as 10/08/2026 17:13:10, 2026-08-10 or 10-AGO-26."""

    def written_otherwise(raw: Column) -> Column:
        text = F.regexp_replace(clean_text(raw), r"(?U)^.*?(\d{1,4}[/-]\w+[/-]\d{1,4}).*$", "$1")
        # Month names are tried only where there is a letter.
        shaped = let(text, lambda t: F.when(t.rlike("[A-Za-z]"), _rewritten(t, _NAMED)).otherwise(_rewritten(t, _NUMERIC)))
        return F.regexp_extract(_rewritten(shaped, _YEARS), r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$", 0).try_cast("date")

    # The usual way, with or without a time behind it, needs one rewrite.
    def read(raw: Column) -> Column:
        return F.when(raw.rlike(_USUAL), F.regexp_replace(raw, _USUAL, "$4-$3-$1").try_cast("date")).otherwise(written_otherwise(raw))

    return let(as_column(c), read)


def parse_sheet_date(c) -> Column:
    """A worksheet date: a plain year, a serial day number, or day-first text."""
    text = strip(c)
    number = F.when(text.rlike(r"^[0-9]+(\.[0-9]*)?$"), text.try_cast("double"))
    whole = F.floor(number).cast("int")
    repaired = F.regexp_replace(text, r"(?<sep>[/-])20(?<unit>[56])$", "${sep}202${unit}")
    return (
        F.when(number.between(2000, 2035), F.concat(whole.cast("string"), F.lit("-01-01")).try_cast("date"))
        .when(number.isNotNull() & (number < 3000000), F.date_add(F.lit("1899-12-30").cast("date"), whole))
        .when(number.isNull(), parse_date(repaired))
    )


def day_text(c) -> Column:
    """dd/MM/yyyy."""
    return F.date_format(as_column(c), "dd/MM/yyyy")


def check_date(date, today) -> Column:
    """Error text for a date before 2000 or more than two years ahead, else NULL."""
    date = as_column(date)
    today = F.lit(today).cast("date") if isinstance(today, str) else as_column(today)
    shown = date.cast("string")
    return F.when(
        F.year(date) < 2000,
        F.concat(F.lit("Fecha de despacho ("), shown, F.lit(") demasiado antigua (anterior al año 2000).")),
    ).when(
        F.year(date) > F.year(today) + 2,
        F.concat(F.lit("Fecha de despacho ("), shown, F.lit(") en el futuro no permitida.")),
    )
