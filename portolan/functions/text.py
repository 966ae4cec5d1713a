"""Text cleaning, party names, labels and small text helpers."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan import fixed_values as fv

# No visible ASCII sign.  In front of a class of spaces it settles almost every character with one comparison.
NOT_VISIBLE = "[^!-~]"

# What counts as white space in source documents (ASCII and the Unicode spaces).
SPACE = f"[{NOT_VISIBLE}&&" + r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"

# The same signs as plain text, for trimming without a pattern.
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# A run of white space that is not just one blank.
SPACE_RUN = f"(?: {SPACE}++|[{SPACE}&&[^ ]]{SPACE}*+)"

# Regex flags: ignore case with Unicode folding, "\n" as the only line end and
# Unicode classes, so that \b and \s mean the same on every Java version.
RX = "(?iudU)"
RX_LINES = "(?iumdU)"
RX_DOTALL = "(?iusdU)"


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    ``element_at`` works out its type once; ``get`` does so again for each row, through all of ``body``.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c) -> Column:
    """Remove white space of any kind on both ends."""
    return F.btrim(as_column(c), F.lit(SPACES))


def blank_to_null(c) -> Column:
    return F.nullif(as_column(c), F.lit(""))


def zero_to_null(c) -> Column:
    """Treat 0 like a missing number."""
    return F.nullif(as_column(c), F.lit(0.0))


def worked_out(value: Column, none="") -> Column:
    """``nullif`` for a value that takes work: that one writes it twice, for the test and as the result."""
    return let(value, lambda v: F.when(v != F.lit(none), v))


def non_blank(c) -> Column:
    """True where a value is present and not the empty string."""
    c = as_column(c)
    return c.isNotNull() & (c != "")


def or_default(c, default) -> Column:
    """The value, or a default where it is missing or blank."""
    return F.coalesce(blank_to_null(c), F.lit(default))


def clean_text(c) -> Column:
    """Drop runs of asterisks, fold white space to single blanks, blank to NULL."""

    def folded(text: Column) -> Column:
        without_stars = F.regexp_replace(text, r"\*{2,}", "")
        return worked_out(F.trim(F.regexp_replace(without_stars, SPACE_RUN, " ")))

    # Visible ASCII with single blanks inside is clean as it is.
    return let(as_column(c), lambda t: F.when(t.rlike(r"[^ -~]|\*\*|  |^ | \z"), folded(t)).when(t != "", t))


def title_case(c) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    runs = F.regexp_extract_all(as_column(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def normalize_document(c) -> Column:
    """A tax or identity number without its label."""
    label = RX + r"^(?:RUC[/]DOC|RUC|DOC|CNPJ|TAX\s*ID|CPF)[:\s-]*"
    return worked_out(F.trim(F.regexp_replace(clean_text(c), label, "")))


def normalize_company(c) -> Column:
    """A company name in its canonical spelling, else in upper case."""
    names = {prefix.replace(".", ""): name for prefix, name in fv.COMPANY_NAMES.items()}
    canonical = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    initials = "".join(sorted({f(name[0]) for name in names for f in (str.lower, str.upper)}))

    def spelled(cleaned: Column) -> Column:
        key = F.trim(F.translate(F.lower(cleaned), ".,", ""))
        prefix = F.regexp_extract(key, "^(" + "|".join(names) + ")(?= |$)", 1)
        # Only what starts like one of the names, or with a sign that may fold to that, is compared with them.
        known = F.when(cleaned.rlike(f"^[., ]*(?:[{initials}]|[^ -~])"), F.try_element_at(canonical, prefix))
        return F.coalesce(known, F.upper(cleaned))

    return let(clean_text(c), spelled)


def normalize_currency_code(c) -> Column:
    iso = F.create_map(*[F.lit(x) for pair in fv.CURRENCY_CODES.items() for x in pair])
    return let(F.upper(clean_text(c)), lambda code: F.coalesce(F.try_element_at(iso, code), code))


@functools.lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Upper-case Latin letters with marks and the ASCII letter below the mark."""
    marked, plain = [], []
    for point in range(0xC0, 0x1F00):
        char = chr(point)
        base = unicodedata.normalize("NFD", char)[0]
        if base != char and "A" <= base <= "Z":
            marked.append(char)
            plain.append(base)
    return "".join(marked), "".join(plain)


def fold_accents(c) -> Column:
    """Upper-case text reduced to ASCII: marks removed, other characters dropped."""
    marked, plain = _accent_table()
    return F.regexp_replace(F.translate(F.upper(as_column(c)), marked, plain), r"[^\x00-\x7F]", "")


def brand_skeleton(c) -> Column:
    """Letters and digits of a brand without company suffixes, for comparison."""
    words = F.regexp_replace(fold_accents(c), r"[^A-Z0-9\s]", " ")
    suffixes = r"(?<![A-Z0-9])(?:" + "|".join(fv.BRAND_SUFFIX_WORDS) + r")(?![A-Z0-9])"
    return F.coalesce(F.regexp_replace(F.regexp_replace(words, suffixes, " "), r"\s+", ""), F.lit(""))


def edit_distance(a, b, limit: int | None = None) -> Column:
    return F.levenshtein(as_column(a), as_column(b)) if limit is None else F.levenshtein(as_column(a), as_column(b), limit)


def clean_header(c) -> Column:
    """A column title for comparison: lower case, accents folded, few signs kept."""
    lowered = F.lower(strip(c))
    folded = F.translate(lowered, "çáàäâãéèëêíìïîóòöôõúùüû", "caaaaaeeeeiiiiooooouuuu")
    spaced = F.regexp_replace(folded, r"[\r\n\t_]+", " ")
    return F.coalesce(strip(F.regexp_replace(spaced, r"(?U)[^\w\s./-]", "")), F.lit(""))


def channel_label(c) -> Column:
    """Traffic-light colour of an inspection channel; a missing channel is green."""
    channel = F.upper(or_default(c, "VERDE"))
    return F.when(channel.contains("VERDE"), "green").when(channel.contains("NARANJA"), "orange").otherwise("red")


def number_from_filename(c) -> Column:
    """The declaration number inside a file name, upper-cased, or NULL."""
    return F.upper(blank_to_null(F.regexp_extract(as_column(c), "(?U)" + fv.FILE_NUMBER_PATTERN, 1)))


def usable_number(c) -> Column:
    """A declaration number that can serve as a key, else NULL."""
    number = strip(c)
    return F.when(~number.isin(fv.NO_NUMBER_MARKS), number)


def contains_text(c, q: str, wildcards: bool = False) -> Column:
    """Case-insensitive containment; with wildcards, % and _ keep their LIKE meaning."""
    c = as_column(c)
    if wildcards:
        return F.coalesce(c.ilike(f"%{q}%"), F.lit(False))
    return F.coalesce(F.lower(c).contains(q.lower()), F.lit(False))


def contains_any(columns, q: str, wildcards: bool = False) -> Column:
    return functools.reduce(lambda a, b: a | b, [contains_text(c, q, wildcards) for c in columns])


def document_type(first_page, is_upper: bool = False) -> Column:
    """Kind of customs document, from words on its first page."""
    text = as_column(first_page) if is_upper else F.upper(as_column(first_page))

    def has(*words):
        return functools.reduce(lambda a, b: a | b, [text.contains(w) for w in words])

    return (
        F.when(text.isNull(), "UNKNOWN")
        .when(
            has("DESPACHO NUMERO:", "SISTEMA SOFIA") | (has("FECHA OFIC:") & has("ADUANA :")),
            "PARAGUAY_SOFIA",
        )
        .when(has("DECLARACION UNICA DE ADUANAS", "DUA"), "DUA_CUSTOMS")
        .when(has("BILL OF LADING"), "BILL_OF_LADING")
        .when(has("COMMERCIAL INVOICE", "FACTURA COMERCIAL"), "COMMERCIAL_INVOICE")
        .otherwise("GENERIC_CUSTOMS")
    )
