"""Goods descriptions: code and name splitting, diagnosis, family and variant.

The long rewrites read each intermediate text several times.  ``let`` binds such
a text to a name inside one expression, so the expression grows with the number
of steps and not with their product, also after a filter on its result has been
pushed below the projection.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.functions.text import RX, RX_DOTALL, as_column, blank_to_null, clean_text, let, strip, title_case


def _cut(text, pattern: str, flags: str = RX) -> Column:
    return F.trim(F.regexp_replace(text, flags + pattern, ""))


def _group(text, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, RX + pattern, group)


# Cheap tests in front of the patterns.  Each holds for every text its pattern can match; the pattern itself decides.


def _folded(text: Column) -> Column:
    """Upper case, in which letters that match without regard to case are the same; only the Kelvin sign and a dotted I stay apart."""
    return F.upper(text)


def _has(text: Column, *parts: str) -> Column:
    return functools.reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _starts(text: Column, *parts: str) -> Column:
    return functools.reduce(lambda a, b: a | b, [text.startswith(p) for p in parts])


def _names(text: Column, *parts: str) -> Column:
    return let(_folded(text), lambda up: _has(up, *parts))


def _begins(text: Column, *parts: str) -> Column:
    return let(_folded(F.substring(text, 1, 4)), lambda up: _starts(up, *parts))


def _digits(text: Column) -> Column:
    return text.rlike("[0-9]{8}")


def _labelled(text: Column) -> Column:
    """Where a code label like ``REF.`` may stand."""
    return _has(text, ":", ".") & _names(text, "COD", "TEM", "REF", "ART", "SKU", "S\u212aU")


def _starts_labelled(text: Column) -> Column:
    return _has(text, ":", ".") & _begins(text, "COD", "I", "\u0130", "REF", "ART", "S")


def _dashed(text: Column) -> Column:
    return _has(text, "-", "–")


def _is_code(text) -> Column:
    """A labelled token counts as a code if it has a digit or at least 4 signs."""
    return (text != "") & (text.rlike(r"\d") | (F.length(text) >= 4))


def _state(code, text) -> Column:
    return F.struct(code.alias("code"), text.alias("text"))


def _take(
    pattern: str, worth: Callable[[Column], Column], rest: Callable[[Column], Column], accepted: Callable[[Column], Column],
    only_if_empty: bool = False,
):
    """A step that moves a token from the text to the code, tried where the text is ``worth`` it.

    The first token found becomes the code; later ones are only removed.
    """

    def step(s: Column) -> Column:
        wanted = worth(s["text"])
        if only_if_empty:
            wanted = (s["code"] == "") & wanted
        taken = let(
            _group(s["text"], pattern),
            lambda t: F.when(
                accepted(t), _state(F.when(s["code"] == "", t).otherwise(s["code"]), rest(s["text"]))
            ).otherwise(s),
        )
        return F.when(wanted, taken).otherwise(s)

    return step


def _present(token: Column) -> Column:
    return token != ""


_FIRST_EAN = RX + r"^(.*?)" + fv.ANY_EAN_PATTERN + r"(.*)$"
_CODE_STEPS = [
    _take(fv.TRAILING_EAN_PATTERN, _digits, lambda t: _cut(t, fv.TRAILING_EAN_PATTERN), _present),
    _take(fv.LEADING_EAN_PATTERN, _digits, lambda t: F.trim(_group(t, fv.LEADING_EAN_PATTERN, 2)), _present, only_if_empty=True),
    _take(fv.LEADING_CODE_PATTERN, _starts_labelled, lambda t: F.trim(_group(t, fv.LEADING_CODE_PATTERN, 2)), _is_code),
    _take(fv.TRAILING_CODE_PATTERN, _labelled, lambda t: _cut(t, fv.TRAILING_CODE_PATTERN), _is_code),
    _take(fv.LEADING_SKU_PATTERN, lambda t: t.rlike(r"^\S*[0-9]"), lambda t: F.trim(_group(t, fv.LEADING_SKU_PATTERN, 2)), lambda t: t.rlike(r"\d")),
    _take(fv.ANY_EAN_PATTERN, _digits, lambda t: F.trim(F.regexp_replace(t, _FIRST_EAN, "$1 $3")), _present),
]


def literal_pattern(value: Column) -> Column:
    """A pattern that matches a text itself, also where the text holds the end of a quotation."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _without_brand_prefix(text: Column, brand) -> Column:
    """Drop the brand where a lot letter or a separator shows it is a prefix."""
    brand = as_column(brand)
    named = blank_to_null(brand).isNotNull() & ~F.upper(brand).isin(fv.OBSERVATION_NO_BRAND)
    quoted = literal_pattern(F.trim(brand))
    prefix = F.concat(F.lit(RX + r"^(?:[A-Za-z]-[ ]*"), quoted, F.lit("|"), quoted, F.lit(r"\s*[-:])\s*"))
    # The pattern differs per row; most rows have no separator and skip it.
    worth_trying = named & (text.contains("-") | text.contains(":"))
    return F.when(worth_trying, F.trim(F.regexp_replace(text, prefix, F.lit("")))).otherwise(text)


def _tidy(text: Column, brand) -> Column:
    """Item marks, tariff and brand prefixes and loose signs of a cleaned text (its only white space are blanks), in this order."""

    def marked(t: Column) -> Column:
        cut = t
        for pattern in fv.ITEM_SEQUENCE_PATTERNS:
            cut = _cut(cut, pattern)
        return F.when(_names(t, "TEM", "COD"), cut).otherwise(F.trim(t))

    def shorter(full: Column) -> Column:
        counted = _begins(full, "LOS", "LAS", "UN") | full.rlike("^[0-9.,]")
        others = lambda w: F.when(_begins(w, "LOS", "LAS"), _cut(w, fv.TARIFF_OTHERS_PATTERN)).otherwise(w)
        without = let(_cut(full, fv.TARIFF_PREFIX_PATTERN), others)
        return F.when(counted, let(without, lambda w: F.when(F.length(w) >= 3, w).otherwise(full))).otherwise(full)

    def ended(t: Column) -> Column:
        return F.when(_dashed(t), _cut(_cut(t, fv.LOOSE_ENDING_PATTERN), r"[-–]\s*$")).otherwise(F.trim(t))

    def bare(t: Column) -> Column:
        loose = _starts(t, "-", ":", " ") | t.endswith("-") | t.endswith(":") | t.endswith(" ")
        return F.when(loose, _cut(t, r"^[-:\s]+|[-:\s]+$")).otherwise(t)

    def single(t: Column) -> Column:
        return F.trim(F.when(t.contains("  "), F.regexp_replace(t, RX + r"\s{2,}", " ")).otherwise(t))

    steps = [marked, shorter, *([lambda t: _without_brand_prefix(t, brand)] if brand is not None else []), ended, bare, single]
    for step in steps:
        text = let(text, step)
    return text


def observation(text, brand=None) -> Column:
    """Struct (code, text): product code ('' if none) and clean name of a raw text."""

    def cleaned(raw: Column) -> Column:
        untidy = _has(raw, "**", "  ") | raw.startswith(" ") | raw.endswith(" ") | raw.rlike("[^ -~]")
        return F.coalesce(F.when(untidy, clean_text(raw)).otherwise(raw), F.lit(""))

    def split(whole: Column) -> Column:
        def finish(s: Column) -> Column:
            return let(
                _tidy(s["text"], brand), lambda t: _state(s["code"], F.when(t == "", whole).otherwise(t))
            )

        headed = _begins(whole, "HOJA")
        state = _state(F.lit(""), F.when(headed, _cut(whole, fv.LEAKED_HEADER_PATTERN, RX_DOTALL)).otherwise(whole))
        for step in _CODE_STEPS:
            state = let(state, step)
        return let(state, finish)

    return let(let(as_column(text), cleaned), split)


def split_observation(
    df: DataFrame, text: str, brand: str | None = None, code_out: str = "product_code", name_out: str = "description"
) -> DataFrame:
    """Add product code and clean name of a raw observation column."""
    return (
        df.withColumn("_obs", observation(text, brand))
        .withColumn(code_out, F.col("_obs.code"))
        .withColumn(name_out, F.col("_obs.text"))
        .drop("_obs")
    )


def diagnosis(text, brand, code) -> Column:
    """What is wrong with a goods line and what it should read, as one struct."""

    def trimmed(c) -> Column:
        return strip(F.coalesce(as_column(c), F.lit("")))

    def judge(raw: Column) -> Column:
        t, k, new = raw["t"], raw["k"], raw["new"]
        up, cutoff = raw["up"], raw["cutoff"]
        name = F.when(cutoff | (new["text"] == ""), t).otherwise(new["text"])
        product = F.when(cutoff | (new["code"] == ""), k).otherwise(new["code"])
        embedded = _labelled(t) & (t.rlike(RX + fv.EMBEDDED_CODE_START_PATTERN) | t.rlike(RX + fv.TRAILING_CODE_PATTERN))
        leaked = _has(up, "HOJA", "TRAM", "ESTADO") & t.rlike(RX + fv.HEADER_LEAK_PATTERN)
        tariff = (_starts(up, "LOS", "LAS") | up.contains("DADES")) & t.rlike(RX + fv.TARIFF_ISSUE_PATTERN)
        found = F.array_compact(
            F.array(
                F.when(leaked, fv.ISSUE_HEADER),
                F.when(embedded, fv.ISSUE_CODE),
                F.when(tariff, fv.ISSUE_TARIFF),
                F.when(_dashed(t) & (t.endswith("-") | t.rlike(RX + fv.LOOSE_ENDING_PATTERN)), fv.ISSUE_ENDING),
            )
        )
        return F.struct(
            t.alias("t"), k.alias("k"), raw["b"].alias("b"), cutoff.alias("cutoff"), name.alias("name"),
            product.alias("product"), F.when(cutoff, F.array(F.lit(fv.ISSUE_CUTOFF))).otherwise(found).alias("found"),
        )

    def conclude(j: Column) -> Column:
        changed = (j["name"] != j["t"]) | ((j["product"] != j["k"]) & (j["product"] != ""))
        issues = F.when((F.size(j["found"]) == 0) & changed, F.array(F.lit(fv.ISSUE_FORMAT))).otherwise(j["found"])
        strong = F.arrays_overlap(j["found"], F.array(F.lit(fv.ISSUE_CODE), F.lit(fv.ISSUE_HEADER), F.lit(fv.ISSUE_TARIFF)))
        clean = (F.size(j["found"]) == 0) & ~changed
        confidence = F.when(j["cutoff"], "cutoff").when(clean, "none").when(strong, "high").otherwise("medium")
        return F.struct(
            issues.alias("issues"), clean.alias("is_clean"), j["name"].alias("suggested_description"),
            j["product"].alias("suggested_code"), j["b"].alias("suggested_brand"),
            confidence.alias("audit_confidence"), j["cutoff"].alias("needs_source"),
        )

    inputs = F.struct(trimmed(text).alias("t"), trimmed(brand).alias("b"), trimmed(code).alias("k"))
    with_split = let(
        inputs,
        lambda i: F.struct(
            i["t"].alias("t"), i["b"].alias("b"), i["k"].alias("k"), observation(i["t"], i["b"]).alias("new"), _folded(i["t"]).alias("up"),
            (i["t"].contains("-") & i["t"].rlike(RX + fv.CUTOFF_PATTERN)).alias("cutoff"),
        ),
    )
    return let(let(with_split, judge), conclude)


DIAGNOSIS_COLUMNS = [
    "issues", "is_clean", "suggested_description", "suggested_code", "suggested_brand", "audit_confidence", "needs_source",
]


def diagnose(df: DataFrame, text: str = "description", brand: str = "brand", code: str = "product_code") -> DataFrame:
    """Add the parts of the diagnosis of a goods line as columns."""
    # An outer generator is a step of its own: the optimizer copies a plain column into every filter on one of its parts.
    kept = [c for c in df.columns if c not in DIAGNOSIS_COLUMNS]
    return df.select(*kept, F.inline_outer(F.array(diagnosis(text, brand, code))))


def variant_name(text, brand=None) -> Column:
    """A short model name: first three telling words of a description."""
    raw = as_column(text)
    words = F.upper(raw)
    if brand is not None:
        pattern = F.concat(F.lit(r"(?U)\b"), literal_pattern(F.upper(as_column(brand))), F.lit(r"\b"))
        words = F.when(blank_to_null(brand).isNull(), words).otherwise(F.regexp_replace(words, pattern, F.lit(" ")))
    measures = r"(?U)\b\d+[\.,]?\d*\s*(ML|G|KG|L|OZ|W|V|MM|CM|M|PZAS?|UNID?|PCS?)\b"
    words = F.regexp_replace(F.regexp_replace(words, measures, " "), r"[()\[\]/,\-.:;\"'#]", " ")
    tokens = F.filter(
        F.split(strip(words), r"\s+"),
        lambda t: (F.length(t) > 1) & ~t.isin(fv.VARIANT_STOPWORDS) & ~t.rlike(r"^[0-9]+$"),
    )
    fallback = F.substring(strip(F.regexp_replace(raw, r"[()\[\]/,\-.:;]", " ")), 1, 22)
    named = F.when(F.size(tokens) == 0, fallback).otherwise(F.array_join(F.slice(tokens, 1, 3), " "))
    return F.when(blank_to_null(raw).isNull(), F.lit(fv.GENERAL_LINE)).otherwise(title_case(named))


def family_variant(name) -> Column:
    """Struct (family, variant, search_pattern) of a short model name."""
    name = as_column(name)
    upper = F.upper(name)
    alternatives = "|".join(sorted(fv.COMPOUND_FAMILIES, key=len, reverse=True))
    compound = F.regexp_extract(upper, f"^({alternatives})(?= |$)", 1)
    first = F.regexp_extract(upper, r"^\s*(\S+)", 1)
    family = F.when(compound != "", compound).otherwise(first)
    rest = F.when(compound != "", F.substring(upper, F.length(compound) + 1, F.length(upper))).otherwise(
        F.regexp_replace(upper, r"^\s*\S+", "")
    )
    words = F.filter(F.split(rest, r"\s+"), lambda w: (w != "") & ~w.isin(fv.VARIANT_NOISE_WORDS))
    empty = F.size(words) == 0
    return F.struct(
        title_case(family).alias("family"),
        F.when(empty, F.lit(fv.BASE_VARIANT)).otherwise(title_case(F.array_join(words, " "))).alias("variant"),
        F.when(empty, family).otherwise(F.concat_ws(" ", family, F.get(words, 0))).alias("search_pattern"),
    )


def display_variant(family, variant) -> Column:
    family, variant = as_column(family), as_column(variant)
    return F.when(variant == fv.BASE_VARIANT, family).otherwise(F.concat_ws(" - ", family, variant))


def goods_label(brand, description) -> Column:
    """The description with the brand in front unless it already names it."""
    text = F.coalesce(as_column(description), F.lit(""))
    brand = blank_to_null(brand)
    named = F.upper(text).contains(F.upper(brand))
    return F.when(brand.isNotNull() & ~named, F.concat_ws(" - ", brand, text)).otherwise(text)
