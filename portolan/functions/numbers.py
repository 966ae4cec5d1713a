"""Amounts, quantities and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.functions.text import SPACE, as_column, let, strip, zero_to_null

PLAIN_NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
_MARK = "\ue000"  # private-use sign standing for a decided decimal point
_FRONT = "\u0002"


def _to_double(text) -> Column:
    """A double only where the whole text is a number (no suffix letters)."""
    return F.regexp_extract(text, PLAIN_NUMBER, 0).try_cast("double")


def _rewrite(text, *rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def parse_currency(c, lenient: bool = False) -> Column:
    """An amount in either decimal convention; NULL where none can be read.

    With both signs present the later one is the decimal sign.  A single comma
    or point is decimal, several of one kind separate thousands.  With
    ``lenient`` the number must start with a digit, so that the point of an
    abbreviation ("Gs. 75.000.000") is not taken for the amount.
    """
    first = r"[-+]?[0-9][0-9.,]*" if lenient else r"[-+]?[0-9.,]+"

    def written_otherwise(text: Column) -> Column:
        amount = F.regexp_extract(F.regexp_replace(text, r"[A-Za-z$€|]", ""), first, 0)
        plain = _rewrite(
            amount,
            # Both signs, and the decimal one more than once: not a number.
            (r"^(?=.*\.)(?=.*,.*,)(?=.*,[^.]*$).*$|^(?=.*,)(?=.*\..*\.)(?=.*\.[^,]*$).*$", ""),
            # Both signs: drop the one that separates thousands.
            (r"\.(?=.*,[^.]*$)|,(?=.*\.[^,]*$)", ""),
            # The only sign left is the decimal one, any others separate thousands.
            (r"^([^.,]*)[.,]([^.,]*)$", "$1" + _MARK + "$2"),
            (r"[.,]", ""),
            (_MARK, "."),
        )
        return _to_double(plain)

    def read(text: Column) -> Column:
        # The two usual ways, digits with one decimal sign behind any of the other kind, need no rewriting.
        without_points = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        without_commas = F.replace(text, F.lit(","), F.lit(""))
        return (
            F.when(text.rlike(r"^[0-9][0-9.]*+,[0-9]*+\z"), without_points.try_cast("double"))
            .when(text.rlike(r"^[0-9](?:[0-9,]*+\.)?[0-9]*+\z"), without_commas.try_cast("double"))
            .otherwise(written_otherwise(text))
        )

    return let(as_column(c), read)


def parse_numeric(c) -> Column:
    """A worksheet number; 0 where the cell holds none.

    A single comma with at most two digits behind it is decimal, points are.
    """
    plain = _rewrite(
        as_column(c),
        (r"[$€£]|USD|Gs|GS|PYG|R\$", ""),
        (f"{SPACE}+", ""),
        # Where the last comma stands behind the last point, points separate thousands and commas are decimal:
        # such a text gets a mark in front, and from there on each comma becomes one.
        (r"^(?=.*\..*,[^.]*$)", _FRONT),
        (r"(?:^" + _FRONT + r"|(?!^)\G)([^,]*),", "$1" + _MARK),
        (r"\.(?=.*" + _MARK + r")|,(?=.*\.[^,]*$)", ""),
        (_MARK, "."),
        (r"^([^,]*),([^,]{0,2})$", "$1.$2"),
        (r",", ""),
    )
    number = r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)[eE][-+]?[0-9]+$|[-+]?[0-9]*\.?[0-9]+"
    return F.coalesce(F.regexp_extract(plain, number, 0).try_cast("double"), F.lit(0.0))


def clean_num(c) -> Column:
    """A number with thousands commas; 0 where it cannot be read."""
    return F.coalesce(_to_double(F.replace(strip(c), F.lit(","), F.lit(""))), F.lit(0.0))


def parse_tax_pct(c) -> Column:
    """A rate as a fraction: values above 1 are percentages."""
    value = _to_double(F.replace(strip(c), F.lit("%"), F.lit("")))
    return F.round(F.when(value > 1.0, value / 100.0).otherwise(value), 4)


def reconcile_fob(fob, items_sum) -> Column:
    """The declared FOB, raised to the sum of the goods lines where it is lower."""
    fob, items_sum = as_column(fob), as_column(items_sum)
    too_low = fob.isNull() | (fob <= 0) | (fob < items_sum)
    return F.when((items_sum > 0) & too_low, F.round(items_sum, 2)).otherwise(fob)


def reconcile_cif(cif, fob, freight, insurance) -> Column:
    """The declared CIF, or the sum of its parts where it is missing."""
    cif = as_column(cif)
    parts = sum((F.coalesce(as_column(p), F.lit(0.0)) for p in (freight, insurance)), F.coalesce(as_column(fob), F.lit(0.0)))
    return F.when(cif.isNull() | (cif <= 0), F.round(parts, 2)).otherwise(cif)


def check_financials(fob, freight, insurance, cif) -> Column:
    """Error text where CIF is off from FOB + freight + insurance, else NULL.

    The tolerance is 5 percent of CIF.  A CIF of zero counts as an error.
    """
    cif = as_column(cif)
    total = as_column(fob) + as_column(freight) + as_column(insurance)
    pct = F.try_divide(F.abs(cif - total), cif) * 100
    message = F.format_string(
        "El valor CIF (%,.2f) difiere significativamente de la suma FOB+Flete+Seguro (%,.2f). Diferencia: %.1f%%",
        cif, total, F.coalesce(pct, F.lit(100.0)),
    )
    return F.when((total > 0) & (F.coalesce(pct, F.lit(100.0)) > fv.CIF_TOLERANCE_PCT), message)


def line_total(quantity, invoice_price, normal_price, total) -> Column:
    """Line total of a worksheet line: as given, else quantity times price."""
    price = F.when(as_column(normal_price) > 0, as_column(normal_price)).otherwise(as_column(invoice_price))
    return F.coalesce(zero_to_null(total), F.round(as_column(quantity) * price, 2))


def unit_price(unit_value, quantity, total_value) -> Column:
    """Unit value, else total / quantity, else 0."""
    quantity = as_column(quantity)
    derived = F.when(quantity > 0, F.round(zero_to_null(total_value) / quantity, 4))
    return F.coalesce(zero_to_null(unit_value), derived, F.lit(0.0))


def percent_text(rate) -> Column:
    """0.105 as 10.5%; NULL as the empty text."""
    rate = as_column(rate)
    return F.when(rate.isNotNull(), F.format_string("%.1f%%", rate * 100)).otherwise("")


def money_text(value) -> Column:
    """$1,234.56, with $0.00 for a missing amount."""
    return F.format_string("$%,.2f", F.coalesce(as_column(value), F.lit(0.0)))


def plain_text(value) -> Column:
    """A number as a double in full without trailing zeros, for logs and hashes.

    There is no exponent unless the number has over 19 places on one side of the point. What is not
    a number is ``NaN``, the infinite ones are ``Infinity`` and ``-Infinity``, NULL stays NULL.
    """
    value = as_column(value).cast("double")
    shortest = value.cast("string")
    plain = shortest.try_cast("decimal(38,19)")
    shown = F.regexp_replace(F.regexp_replace(plain.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ".0")
    return F.when(plain.cast("double") == value, shown).otherwise(shortest)


def confidence_band(c) -> Column:
    c = as_column(c)
    return F.when(c >= 0.9, "green").when(c >= 0.7, "amber").otherwise("red")
