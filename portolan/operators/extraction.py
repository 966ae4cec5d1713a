"""From page text to header fields and goods lines.

Input is a ``pages`` table (doc_id, page_num, text, method).  Header fields are
found page by page and reduced per document with partial aggregation.  Goods
lines depend on the text of a whole document, so its pages are brought together
in one row; a document is one uploaded file and larger files than the upload
limit are refused first, which bounds that row.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.functions import numbers
from portolan.functions.dates import parse_date
from portolan.functions.goods import let, observation
from portolan.functions.text import (
    NOT_VISIBLE, RX, RX_DOTALL, RX_LINES, SPACE, blank_to_null, clean_text, document_type, normalize_company,
    normalize_currency_code, normalize_document, strip, worked_out, zero_to_null,
)

# An amount text that can be read as a number (see numbers.parse_currency).
_READABLE_AMOUNT = (
    r"^(?!(?=.*\.)(?=.*,.*,)(?=.*,[^.]*$))(?!(?=.*,)(?=.*\..*\.)(?=.*\.[^,]*$)).*[0-9]"
)


def load_pages(spark, path: str, digital: bool = True) -> DataFrame:
    """Page texts of documents, in the schema the extraction reads."""
    raw = spark.read.schema("doc_id bigint, page_num int, text string, method string").parquet(path)
    return page_stats(raw) if digital else raw


def page_stats(pages: DataFrame) -> DataFrame:
    """Trimmed length per page, and the method where the source left it open.

    Fewer than 35 characters count as a scanned page.
    """
    chars = F.length(strip(F.coalesce("text", F.lit(""))))
    guessed = F.when(chars < fv.MIN_DIGITAL_CHARS, "OCR").otherwise("DIGITAL_TEXT")
    return pages.withColumn("char_count", chars).withColumn("method", F.coalesce(F.col("method"), guessed))


def oversized_documents(pages: DataFrame, max_mb: int = fv.MAX_UPLOAD_MB) -> DataFrame:
    """Documents whose text exceeds the upload limit."""
    size = F.sum(F.octet_length("text"))
    return pages.groupBy("doc_id").agg(size.alias("bytes")).filter(F.col("bytes") > max_mb * 1024 * 1024)


# Header fields --------------------------------------------------------------


def normalize_field(raw: Column, kind: str) -> Column:
    """A raw header value in the type of its class."""
    if kind == "date":
        return parse_date(raw)
    if kind == "number":
        return numbers.parse_currency(raw)
    if kind == "document":
        return normalize_document(raw)
    if kind == "currency":
        return normalize_currency_code(raw)
    if kind == "channel":
        return F.upper(clean_text(raw))
    if kind == "company":
        return normalize_company(raw)
    return clean_text(raw)


def field_confidence(value: Column, kind: str) -> Column:
    """How far a value of a class is trusted, given whether it could be read."""
    good, poor = fv.FIELD_CONFIDENCE[kind]
    usable = value.isin(fv.SPANISH_CHANNELS) if kind == "channel" else value.isNotNull()
    return F.when(usable, good).otherwise(poor)


def _usable(raw: Column, kind: str) -> Column:
    if kind == "number":
        return raw.rlike(_READABLE_AMOUNT)
    if kind in ("text", "company", "channel", "currency"):  # cleaning keeps the first sign, which is no space, unless it is an asterisk
        return (F.ascii(raw) != ord("*")) | clean_text(raw).isNotNull()
    return normalize_field(raw, kind).isNotNull()


# Unicode spaces, which the quick test below reads as blanks.
_WIDE_SPACES = f"[{NOT_VISIBLE}&&" + r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"


def _quick_pattern(pattern: str) -> str:
    """The pattern for upper-cased text; case only matters where it has small letters."""
    small = re.sub(r"\\.|\[[^\]]*\]|\(\?.", lambda m: "o" if "ºo" in m.group(0) else "", pattern)
    return ("(?imd)" if re.search("[a-z]", small) else "(?md)") + pattern


def _opening(pattern: str) -> str:
    """The capitals and signs that every match of a pattern starts with; empty if they are fewer than two."""
    literal = re.match(r"(?:[A-Z/]|\\\.)*", pattern).group(0)
    if re.match("[?*+{]", pattern[len(literal):]):  # the last one may be missing
        literal = re.sub(r"\\?.$", "", literal)
    literal = literal.replace("\\", "")
    return literal if len(literal) > 1 else ""


def _from_opening(page: Column, pattern: str) -> Column:
    """The page from where a match can start at the earliest: the pattern itself is slow, finding its opening is not.

    Places in the upper-cased text are places in the text where both are equally long.
    """
    opening = _opening(pattern)
    if not opening:
        return page["text"]
    return F.when(page["aligned"], F.substr(page["text"], F.instr(page["upper"], opening))).otherwise(page["text"])


def _candidate(page: Column, kind: str, rank: int, word: str, pattern: str) -> Column:
    """The record of one pattern on a page, NULL where it finds nothing usable.

    Three steps of growing cost: a word the pattern cannot do without, the
    pattern on the upper-cased text, and the extraction itself.  Where places agree,
    the extraction starts at the opening and does without the second.
    """
    regex, opening = RX_LINES + pattern, _opening(pattern)
    quick, tested = page["upper"].contains(word), page["upper"].rlike(_quick_pattern(pattern))
    if opening and opening != word:
        quick = quick & page["upper"].contains(opening)
    quick = quick & (page["aligned"] | tested if opening else tested)

    def read(source: Column) -> Column:
        def record(raw: Column) -> Column:
            found = F.struct(
                page["page_num"].alias("page"), F.lit(rank).alias("rank"), raw.alias("raw"), strip(source).alias("source"),
                F.coalesce(page["method"], F.lit("TEXT")).alias("method"),
            )
            return F.when((raw != "") & _usable(raw, kind), found)

        # The value is read from the match itself; the added line end stands for
        # the text a look-ahead saw behind it.
        return F.when(source != "", let(strip(F.regexp_extract(F.concat(source, F.lit("\n")), regex, 1)), record))

    # Where the quick test fails, as for most patterns of a page, nothing is bound and no expression behind it is entered.
    return F.when(quick, let(F.regexp_extract(_from_opening(page, pattern), regex, 0), read))


@functools.cache
def _first_in_document(field: str, page_type: str) -> Column:
    """The record of the earliest page on which a value of the field can be read, by the first pattern that reads one there.

    Later patterns are tried only if the earlier ones gave nothing, and later pages only as long as none was found; of
    pages with one number the least record counts.
    """
    kind, patterns = fv.FIELD_PATTERNS[field]
    none = F.lit(None).cast(f"struct<page:{page_type},rank:int,raw:string,source:string,method:string>")

    def next_page(found: Column, page: Column) -> Column:
        here = F.coalesce(*[_candidate(page, kind, rank, word, pattern) for rank, (word, pattern) in enumerate(patterns)])
        settled = found.isNotNull() & ~found["page"].eqNullSafe(page["page_num"])
        return F.when(settled, found).otherwise(F.least(found, here))

    return F.aggregate("_pages", none, next_page)


def extract_fields(pages: DataFrame) -> DataFrame:
    """One row per document with one record per header field (NULL if not found).

    A record holds page, pattern rank, raw value, source text and method.  The pages of a
    document are brought together like those for its goods lines and searched in order; the earliest page
    wins, and pages behind it are not searched for that field.  The same pass gives the kind of document,
    how it was read and its page count.
    """
    cased = pages.withColumn("_cased", F.upper("text"))
    wide = F.octet_length("_cased") != F.length("_cased")
    searched = cased.withColumn("_upper", F.when(wide, F.regexp_replace("_cased", _WIDE_SPACES, " ")).otherwise(F.col("_cased")))
    # Two capitals beyond ASCII count as I and K where case is ignored.
    folds = F.col("_upper").contains("\u0130") | F.col("_upper").contains("\u212a")
    page = F.struct("page_num", "text", "method", F.col("_upper").alias("upper"), ((F.length("_upper") == F.length("text")) & ~folds).alias("aligned"))
    ocr = F.coalesce(F.sum((F.upper("method") == "OCR").cast("int")), F.lit(0))
    method = F.when(ocr == F.count("*"), "OCR").when(ocr > 0, "MIXTO").otherwise("DIGITAL_TEXT")
    together = searched.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(page)).alias("_pages"), method.alias("extraction_method"), F.count("*").cast("int").alias("page_count")
    )
    page_type = pages.schema["page_num"].dataType.simpleString()
    first = F.filter("_pages", lambda p: p["page_num"].eqNullSafe(F.get("_pages", F.lit(0))["page_num"]))
    return together.select(
        "doc_id",
        *[_first_in_document(f, page_type).alias(f) for f in fv.FIELD_PATTERNS],
        F.array_min(F.transform(first, lambda p: document_type(p["upper"], is_upper=True))).alias("doc_type"),
        "extraction_method",
        "page_count",
    )


def field_records(fields: DataFrame) -> DataFrame:
    """Long form: one row per document and field, found or not.

    The values are read in a projection of their own, once each; inside the rows they would be read for every use.
    """
    fields = fields.withColumns({f"_value_{f}": normalize_field(F.col(f)["raw"], kind) for f, (kind, _) in fv.FIELD_PATTERNS.items()})
    records = []
    for field, (kind, _) in fv.FIELD_PATTERNS.items():
        record = F.col(field)
        value = F.col(f"_value_{field}")
        shown = numbers.plain_text(value) if kind == "number" else value.cast("string")
        records.append(
            F.struct(
                F.lit(field).alias("field"),
                shown.alias("value"),
                record["raw"].alias("raw"),
                F.when(record.isNull(), F.lit(0.0)).otherwise(field_confidence(value, kind)).alias("confidence"),
                F.coalesce(record["page"], F.lit(1)).alias("page"),
                record["source"].alias("source_text"),
                F.coalesce(record["method"], F.lit("NONE")).alias("method"),
            )
        )
    return fields.select("doc_id", F.inline(F.array(*records)))


def fields_to_header(fields: DataFrame) -> DataFrame:
    """Typed header columns, provenance map and extraction confidence."""
    values = fields.select(
        "doc_id", "doc_type", "extraction_method", "page_count",
        *[normalize_field(F.col(f)["raw"], kind).alias(f) for f, (kind, _) in fv.FIELD_PATTERNS.items()],
        *[F.col(f).alias(f"_{f}") for f in fv.FIELD_PATTERNS],
    )
    scores, entries = [], []
    for field, (kind, _) in fv.FIELD_PATTERNS.items():
        record = F.col(f"_{field}")
        score = F.when(record.isNotNull(), field_confidence(F.col(field), kind))
        scores.append(score)
        entries.append(F.lit(field))
        entries.append(
            F.struct(
                record["raw"].alias("raw"),
                F.coalesce(score, F.lit(0.0)).alias("confidence"),
                F.coalesce(record["page"], F.lit(1)).alias("page"),
                record["source"].alias("source_text"),
                F.coalesce(record["method"], F.lit("NONE")).alias("method"),
            )
        )
    with_scores = values.withColumn("_scores", F.array_compact(F.array(*scores))).withColumn("field_meta", F.create_map(*entries))
    found = F.size("_scores")
    total = F.aggregate("_scores", F.lit(0.0), lambda a, s: a + s)
    mean = F.when(found > 0, F.round(total / found, 2)).otherwise(F.lit(0.0))
    return (
        with_scores.withColumn("confidence", mean)
        .withColumn("fields_found", found)
        .withColumn("fields_missing", F.lit(len(fv.FIELD_PATTERNS)) - found)
        .drop("_scores", *[f"_{f}" for f in fv.FIELD_PATTERNS])
    )


def extraction_confidence(records: DataFrame) -> DataFrame:
    """Mean confidence over the found fields of each document, and how many were found."""
    found = F.col("method") != "NONE"
    mean = F.coalesce(F.round(F.avg(F.when(found, F.col("confidence"))), 2), F.lit(0.0))
    return records.groupBy("doc_id").agg(
        mean.alias("confidence"), F.count_if(found).alias("fields_found"), F.count_if(~found).alias("fields_missing")
    )


# Goods lines ----------------------------------------------------------------

# A page starts with a form feed in the joined text.  It is white space to every
# pattern, and counting it in front of a match gives the page of the match.
_PAGE_SIGN = "\f"


# A run of white space that holds a line end, taken as a whole.
_NO_BREAK = f"[{NOT_VISIBLE}&&" + r"[ \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]]"
_ANY_BREAK = f"[{NOT_VISIBLE}&&" + r"[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]]"
_BREAK_RUN = f"(?={NOT_VISIBLE})(?<!{SPACE}){_NO_BREAK}*+{_ANY_BREAK}{SPACE}*+"


def goods_text(text: Column) -> Column:
    """A page as trimmed lines, without blank lines and page headers."""
    lines = strip(F.regexp_replace(text, _BREAK_RUN, "\n"))
    starts = "(?md)^(?:" + "|".join(s.replace(".", r"\.") for s in fv.PAGE_HEADER_STARTS) + r").*\n?"
    return F.regexp_replace(F.regexp_replace(lines, starts, ""), r"\n$", "")


def goods_text_lines(text: Column) -> Column:
    return F.filter(F.split(goods_text(text), "\n"), lambda line: line != "")


def drop_page_headers(pages: DataFrame) -> DataFrame:
    """Pages reduced to the lines that can belong to goods."""
    return pages.withColumn("text", goods_text(F.col("text")))


def documents(pages: DataFrame) -> DataFrame:
    """One row per document with its pages in order; the size of files is checked at upload."""
    page = F.struct("page_num", F.coalesce("text", F.lit("")).alias("text"))
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))


def _item(tier, item_no, hs_code, raw, brand, quantity, unit, value, page, subitem_no=None, net_weight=None,
          origin=None, provenance=None, signs_before=None, signs_inside=None, dropped=None) -> Column:
    """A goods line as found, in the shape common to all layouts."""
    none_int, none_text, none_double = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("double")

    def given(c, none):
        return none if c is None else c

    return F.struct(
        F.lit(tier).alias("tier"),
        item_no.alias("item_no"),
        given(subitem_no, none_int).alias("subitem_no"),
        hs_code.alias("hs_code"),
        raw.alias("raw"),
        brand.alias("brand"),
        quantity.cast("double").alias("quantity"),
        unit.alias("unit"),
        given(net_weight, none_double).alias("net_weight"),
        value.alias("value"),
        given(dropped, none_double).alias("dropped_value"),
        given(origin, none_text).alias("origin"),
        given(provenance, none_text).alias("provenance"),
        given(page, none_int).alias("page"),
        given(signs_before, none_int).alias("signs_before"),
        given(signs_inside, none_int).alias("signs_inside"),
    )


def _count_signs(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(_PAGE_SIGN), F.lit("")))


def _subitems(pages: Column) -> Column:
    """Layout 1: sub-item records over the joined text of all pages."""
    cleaned = F.transform(pages, lambda p: goods_text(p["text"]))
    whole = F.array_join(cleaned, "\n" + _PAGE_SIGN)
    regex = RX_DOTALL + fv.SUBITEM_PATTERN

    def records(text: Column) -> Column:
        def group(m: Column, n: int) -> Column:
            # The added line end stands for the text a look-ahead saw behind the match.
            return F.regexp_extract(F.concat(m, F.lit("\n")), regex, n)

        def one(pair: Column) -> Column:
            m = pair["m"]
            return _item(
                1, group(m, 1).try_cast("int"), clean_text(group(m, 2)), F.coalesce(clean_text(group(m, 7)), F.lit("")),
                F.coalesce(clean_text(group(m, 6)), F.lit("")), numbers.parse_currency(group(m, 4)), F.lit("UNIDAD"),
                numbers.parse_currency(group(m, 5)), None, subitem_no=group(m, 3).try_cast("int"),
                signs_before=_count_signs(pair["gap"]), signs_inside=_count_signs(m),
            )

        def zipped(matches: Column) -> Column:
            gaps = F.slice(F.split(text, regex, -1), F.lit(1), F.size(matches))
            return F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("gap")))

        pairs = let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), zipped)
        return F.transform(pairs, one)

    # The tariff label has no blank in it, so some page must contain it as a whole.
    possible = F.exists(pages, lambda p: F.upper(p["text"]).contains("POS.ARANC."))
    return F.when(possible, let(whole, records))


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(RX + pattern)


def _part(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, RX + pattern, n)


def _first(array: Column, test) -> Column:
    return F.get(F.filter(array, test), F.lit(0))


def _positions(array: Column, first: int = 0) -> Column:
    """0-based positions of an array from ``first`` on."""
    none = F.array().cast("array<int>")
    return F.when(F.size(array) > first, F.sequence(F.lit(first), F.size(array) - 1)).otherwise(none)


def _amount_or_one(text: Column) -> Column:
    return F.coalesce(worked_out(numbers.parse_currency(text), 0.0), F.lit(1.0))


def _commercial(b: Column) -> Column:
    """Name, brand, quantity, unit and value where they stand on one line."""
    pattern = fv.BLOCK_COMMERCIAL_PATTERN
    line = _first(b, lambda x: _matches(x, pattern))
    return let(
        line,
        lambda t: F.when(
            t.isNotNull(),
            F.struct(
                clean_text(_part(t, pattern, 1)).alias("name"),
                F.coalesce(clean_text(_part(t, pattern, 2)), F.lit(fv.NO_BRAND_LABEL)).alias("brand"),
                _amount_or_one(_part(t, pattern, 3)).alias("quantity"),
                F.upper(_part(t, pattern, 4)).alias("unit"),
                numbers.parse_currency(_part(t, pattern, 5)).alias("value"),
            ),
        ),
    )


def _name_and_brand(lines: Column) -> Column:
    """Struct (name, brand) of the lines in front of the quantity."""

    def split(words: Column) -> Column:
        n = F.size(words)

        def ends(k: int) -> Column:
            first = F.upper(F.array_join(F.slice(words, 1, k), " "))
            last = F.upper(F.array_join(F.slice(words, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), " "))
            return (n >= 2 * k) & (first == last)

        def cut(k: int) -> Column:
            return F.struct(
                F.array_join(F.slice(words, F.lit(1), n - k), " ").alias("name"),
                F.array_join(F.slice(words, n - k + 1, F.lit(k)), " ").alias("brand"),
            )

        whole = F.struct(F.get(lines, F.lit(0)).alias("name"), F.lit(None).cast("string").alias("brand"))
        return F.when(ends(1), cut(1)).when(ends(2), cut(2)).otherwise(whole)

    several = F.struct(
        F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), " ").alias("name"), F.element_at(lines, -1).alias("brand")
    )
    one = let(F.split(F.get(lines, F.lit(0)), r"\s+"), split)
    return F.when(F.size(lines) == 1, one).when(F.size(lines) > 1, several)


def _multi_line(b: Column) -> Column:
    """The same values where each stands on its own line around a unit word."""
    number = fv.BLOCK_NUMBER_PATTERN

    def at(i) -> Column:
        return F.get(b, i)

    def read(u: Column) -> Column:
        title = "|".join(w.replace("$", r"\$") for w in fv.BLOCK_TITLE_WORDS)
        before = F.slice(b, F.lit(1), F.greatest(u - 1, F.lit(0)))
        titles = F.filter(
            F.transform(before, lambda x, i: F.when(F.upper(x).rlike(title), i + 1)), lambda i: i.isNotNull()
        )
        start = F.coalesce(F.array_max(titles), F.lit(0))
        texts = F.filter(
            F.slice(b, start + 1, F.greatest(u - 1 - start, F.lit(0))), lambda x: (x != "") & ~x.startswith("******")
        )
        return F.struct(
            F.upper(at(u)).alias("unit"),
            _amount_or_one(at(u - 1)).alias("quantity"),
            F.when(_matches(at(u + 1), number), numbers.parse_currency(at(u + 1))).alias("value"),
            let(texts, _name_and_brand).alias("named"),
        )

    unit_at = _first(_positions(b, 1), lambda i: F.upper(at(i)).isin(fv.BLOCK_UNITS) & _matches(at(i - 1), number))
    return let(unit_at, lambda u: F.when(u.isNotNull(), read(u)))


def _state_block(b: Column) -> Column:
    """Origin, provenance and net weight."""
    number = fv.BLOCK_NUMBER_PATTERN

    def at(i) -> Column:
        return F.get(b, i)

    state_at = _first(_positions(b), lambda i: (F.upper(at(i)) == "ESTADO") & (i + 4 < F.size(b)))

    def read(e: Column) -> Column:
        labelled = F.filter(
            _positions(b),
            lambda i: F.upper(at(i)).contains("KILO NETO") & (i + 2 < F.size(b)) & (e.isNull() | (i < e)),
        )
        weights = F.filter(
            F.transform(labelled, lambda i: _first(F.slice(b, i + 2, F.lit(3)), lambda x: _matches(x, number))),
            lambda x: x.isNotNull(),
        )
        own = F.when(_matches(at(e + 4), number), at(e + 4))
        return F.struct(
            clean_text(at(e + 2)).alias("origin"),
            clean_text(at(e + 3)).alias("provenance"),
            numbers.parse_currency(F.coalesce(own, F.try_element_at(weights, F.lit(-1)))).alias("net_weight"),
        )

    return let(state_at, read)


def _grid_block(header: Column, page: Column, b: Column, value_limit: float) -> Column:
    """One block of the grid layout; NULL where nothing in it is worth keeping.

    A value above ``value_limit`` counts as misread: it is set aside as the line's ``dropped_value``, and the value is 0.
    """
    title = fv.BLOCK_HEADER_PATTERN
    code = F.coalesce(worked_out(_part(header, title, 3)), _first(b, lambda x: _matches(x, fv.BLOCK_CODE_PATTERN)))
    fob_at = F.array_position(F.transform(b, F.upper), "FOB FACTURA").cast("int")
    invoice = F.when(fob_at > 0, numbers.parse_currency(F.get(b, fob_at)))
    parts = F.struct(
        code.alias("code"), invoice.alias("invoice"), _commercial(b).alias("line"), _multi_line(b).alias("multi"),
        _state_block(b).alias("state"),
    )

    def combine(p: Column) -> Column:
        line = p["line"]
        multi = F.when(line.isNull() | line["name"].isNull(), p["multi"])
        name = blank_to_null(F.coalesce(multi["named"]["name"], line["name"]))
        brand = blank_to_null(F.coalesce(multi["named"]["brand"], line["brand"]))
        no_brand = brand.isNull() | brand.rlike(r"^[*\s\-_.]+$") | strip(brand).isin(fv.OBSERVATION_NO_BRAND)
        own_value = F.coalesce(multi["value"], line["value"])
        value = F.coalesce(zero_to_null(own_value), zero_to_null(p["invoice"]), F.lit(0.0))
        kept = p["code"].isNotNull() | zero_to_null(p["invoice"]).isNotNull() | name.isNotNull()
        return F.when(
            kept,
            _item(
                2, _part(header, title, 1).try_cast("int"), p["code"], F.coalesce(name, F.lit("")),
                F.when(no_brand, fv.NO_BRAND_LABEL).otherwise(brand), F.coalesce(multi["quantity"], line["quantity"]),
                F.coalesce(multi["unit"], line["unit"], F.lit("UNIDAD")),
                F.when(value > value_limit, F.lit(0.0)).otherwise(value), page, dropped=F.when(value > value_limit, value),
                net_weight=p["state"]["net_weight"], origin=p["state"]["origin"], provenance=p["state"]["provenance"],
            ),
        )

    return let(parts, combine)


def _first_come_blocks(candidates: Column) -> Column:
    """Those of rising ``candidates`` (field ``at``) that are not within two lines behind one that is kept.

    Each candidate is written as one letter for its distance to the next: a (1 line), b (2) or c (more).
    From left to right a kept one takes along what is within two lines: "aa" two further letters, "a" or "b" one.
    """

    def letters(c: Column) -> Column:
        gap = F.transform(c, lambda x, i: F.coalesce(F.get(c, i + 1)["at"] - x["at"], F.lit(3)))
        return F.array_join(F.transform(gap, lambda g: F.when(g == 1, "a").when(g == 2, "b").otherwise("c")), "")

    def flags(c: Column) -> Column:
        taken = F.regexp_extract_all(letters(c), F.lit("aa.?|[ab].?|c"), F.lit(0))
        return F.split(F.array_join(F.transform(taken, lambda t: F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(t) - 1))), ""), "")

    return let(flags(candidates), lambda kept: F.filter(candidates, lambda c, i: F.get(kept, i) == "1"))


def _grid_items(pages: Column, value_limit: float = fv.BLOCK_VALUE_LIMIT, max_lines: int = fv.BLOCK_MAX_LINES) -> Column:
    """Layout 2: blocks that start with n/total.

    A block runs to the next block start behind its second line, at most ``max_lines``
    lines.  A start inside a kept block is not a start of its own: with blocks that end where
    the next one starts these are starts in its first two lines. The work grows with the lines.
    """
    lines = F.flatten(
        F.transform(pages, lambda p: F.transform(goods_text_lines(p["text"]), lambda t: F.struct(t.alias("t"), p["page_num"].alias("page"))))
    )

    def blocks(all_lines: Column) -> Column:
        heads = F.filter(
            F.transform(all_lines, lambda x, i: F.when(_matches(x["t"], fv.BLOCK_HEADER_PATTERN), i)), lambda i: i.isNotNull()
        )

        def read(hs: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                # at most two starts lie within two lines, so the end is one of the next three
                later = [F.get(hs, i + k) for k in (1, 2, 3)]
                behind = F.coalesce(*[F.when(k > h + 2, k) for k in later])
                end = F.least(F.coalesce(behind, F.size(all_lines)), F.size(all_lines), h + max_lines + 1)
                body = F.transform(F.slice(all_lines, h + 2, end - h - 1), lambda x: x["t"])
                head = F.get(all_lines, h)
                return F.struct(h.alias("at"), let(body, lambda b: _grid_block(head["t"], head["page"], b, value_limit)).alias("item"))

            found = F.filter(F.transform(hs, one), lambda c: c["item"].isNotNull())
            return let(found, lambda candidates: F.transform(_first_come_blocks(candidates), lambda c: c["item"]))

        return let(heads, read)

    # Cheap test for a line that could start a block.
    possible = F.exists(pages, lambda p: p["text"].rlike(r"(?md)^\s*\d{1,3}\s*/\s*\d"))
    return F.when(possible, let(lines, blocks))


def _standard_items(pages: Column) -> Column:
    """Layout 3: one order position after the other, page by page."""
    regex = RX_DOTALL + fv.STANDARD_ITEM_PATTERN

    def of_page(p: Column) -> Column:
        def one(m: Column) -> Column:
            def group(n: int) -> Column:
                return F.regexp_extract(m, regex, n)

            return _item(
                3, group(1).try_cast("int"), clean_text(group(2)), F.coalesce(clean_text(group(4)), F.lit("")),
                F.lit(fv.NO_BRAND_LABEL), worked_out(numbers.parse_currency(group(5)), 0.0),
                F.coalesce(clean_text(group(6)), F.lit("UNIDAD")), numbers.parse_currency(group(3)), p["page_num"],
            )

        found = F.regexp_extract_all(p["text"], F.lit(regex), F.lit(0))
        return F.when(F.upper(p["text"]).contains("PEDIDO"), F.transform(found, one)).otherwise(F.array())

    return F.flatten(F.transform(pages, of_page))


#: Characters before and behind a code that are searched for its amount, and the shortest code.
_RESCUE_BEFORE, _RESCUE_BEHIND, _RESCUE_CODE = 100, 300, 14


def _rescue_items(pages: Column) -> Column:
    """Layout 4: any HS code in the text, with an amount from its surroundings.

    The surroundings are put together from the ends of the texts between codes, of which only
    so many can lie within them; so no position is looked up from the start of the page.
    """
    regex = "(?U)" + fv.RESCUE_CODE_PATTERN
    few_before, few_behind = -(-_RESCUE_BEFORE // _RESCUE_CODE), -(-_RESCUE_BEHIND // _RESCUE_CODE)

    def of_page(p: Column) -> Column:
        text = p["text"]

        def around(codes: Column) -> Column:
            def with_gaps(gaps: Column) -> Column:
                tails = F.transform(gaps, lambda g: F.right(g, F.lit(_RESCUE_BEFORE)))
                starts = F.transform(gaps, lambda g: F.left(g, F.lit(_RESCUE_BEHIND)))
                # what stands before code i ends with gap i; what stands behind it starts with gap i + 1
                left = F.zip_with(F.concat(F.array(F.lit("")), codes), tails, lambda c, g: F.concat(c, g))
                right = F.zip_with(codes, F.slice(starts, F.lit(2), F.size(codes)), lambda c, g: F.concat(c, g))

                return let(F.struct(left.alias("l"), right.alias("r")), lambda s: F.transform(codes, lambda c, i: _rescue_place(c, i, s["l"], s["r"], few_before, few_behind)))

            return let(F.split(text, regex, -1), with_gaps)

        def item(c: Column) -> Column:
            amount = worked_out(F.regexp_extract(c["around"], RX + fv.RESCUE_FOB_PATTERN, 1))
            return _item(
                4, F.lit(0), c["code"], F.lit(""), F.lit(fv.NO_BRAND_LABEL), F.lit(1.0), F.lit("UNIDAD"),
                numbers.parse_currency(amount), p["page_num"],
            )

        return F.transform(let(F.regexp_extract_all(text, F.lit(regex), F.lit(1)), around), item)

    return F.flatten(F.transform(pages, of_page))


def _rescue_place(code: Column, i: Column, left: Column, right: Column, few_before: int, few_behind: int) -> Column:
    """A code and the text around it, from the texts that end before each code and start behind it."""
    first = F.greatest(i - few_before, F.lit(0))
    before = F.right(F.array_join(F.slice(left, first + 1, i - first + 1), ""), F.lit(_RESCUE_BEFORE))
    behind = F.substring(F.array_join(F.slice(right, i + 1, F.lit(few_behind + 1)), ""), F.lit(1), F.length(code) + _RESCUE_BEHIND)
    return F.struct(code.alias("code"), F.concat(before, behind).alias("around"))


_LAYOUTS = {"subitems": _subitems, "grid": _grid_items, "standard": _standard_items, "codes": _rescue_items}


@functools.cache
def _document_items(layouts: tuple[str, ...], value_limit: float, max_lines: int) -> Column:
    """The goods lines of a document row; an expression by name, built once per process."""
    return _first_layout_with_items(F.col("pages"), layouts, {"grid": (value_limit, max_lines)})


def _first_layout_with_items(pages: Column, layouts, limits: dict[str, tuple]) -> Column:
    """The goods lines of the first layout that yields any; later ones are not tried."""
    name, *rest = layouts
    found = _LAYOUTS[name](pages, *limits.get(name, ()))
    if not rest:
        return found
    return let(found, lambda items: F.when(F.size(items) > 0, items).otherwise(_first_layout_with_items(pages, rest, limits)))


def extract_items(pages: DataFrame, layouts=tuple(_LAYOUTS), value_limit: float = fv.BLOCK_VALUE_LIMIT, max_lines: int = fv.BLOCK_MAX_LINES) -> DataFrame:
    """Goods lines of all documents, each read in the first layout that fits it.

    One exchange brings the pages of a document together (an upload is at most 50 MB, see ``validate_upload``);
    everything behind it, including the running page count, keeps that partitioning, and the work of each layout
    grows with the text.  ``value_limit`` and ``max_lines`` are rules of the grid layout: a larger value counts as
    misread (it is kept as ``dropped_value``), and a block has no more lines.
    """
    docs = documents(pages)
    items = _document_items(tuple(layouts), float(value_limit), int(max_lines))
    found = docs.select("doc_id", F.transform("pages", lambda p: p["page_num"]).alias("_pages"), items.alias("_items"))
    # The outer form: for the plain one the optimizer puts a test of the items below them and so extracts all of them twice.
    each = found.select("doc_id", "_pages", F.posexplode_outer("_items").alias("seq", "i")).filter("seq IS NOT NULL")
    rows = each.select("doc_id", "_pages", "seq", "i.*")

    from pyspark.sql import Window

    until_here = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    signs = F.sum(F.col("signs_before") + F.col("signs_inside")).over(until_here) - F.col("signs_inside")
    located = rows.withColumn("page", F.coalesce("page", F.get("_pages", signs.cast("int"))))
    return finish_items(located)


def finish_items(found: DataFrame) -> DataFrame:
    """Names, codes, defaults and unit values of goods lines as found."""
    tier, hs = F.col("tier"), F.col("hs_code")
    obs = F.when(tier < 4, observation("raw", F.when(tier < 3, F.col("brand")))).alias("_obs")
    number = F.when(tier == 4, F.col("seq") + 1).otherwise(F.col("item_no"))
    fallback = (
        F.when(tier == 1, F.concat(F.lit("Subítem "), F.col("subitem_no").cast("string"), F.lit(" - Posición "), hs))
        .when(tier == 4, F.concat(F.lit("Mercadería Posición "), hs))
        .otherwise(F.concat(F.lit("Ítem "), F.col("item_no").cast("string"), F.lit(" - Posición "), F.coalesce(hs, F.lit("N/A"))))
    )
    value, quantity = F.col("value"), F.col("quantity")
    per_unit = F.when(
        (zero_to_null("value").isNotNull()) & (quantity > 0), F.round(value / quantity, 2)
    )
    return found.withColumn("_obs", obs).select(
        "doc_id",
        "seq",
        "tier",
        number.alias("item_no"),
        "subitem_no",
        "hs_code",
        blank_to_null("_obs.code").alias("product_code"),
        F.coalesce(blank_to_null("_obs.text"), blank_to_null("raw"), fallback).alias("description"),
        F.coalesce(blank_to_null("brand"), F.lit(fv.NO_BRAND_LABEL)).alias("brand"),
        F.when(tier == 1, quantity).otherwise(F.coalesce(quantity, F.lit(1.0))).alias("quantity"),
        "unit",
        "net_weight",
        F.when(tier == 4, value).otherwise(per_unit).alias("unit_value"),
        value.alias("total_value"),
        "dropped_value",
        "origin",
        "provenance",
        "page",
    )


def pages_without_items(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Pages of the documents without goods lines: only these need a header for ``representative_items``.

    That keeps the same documents from ``headers``; dropped ahead of the header extraction, the others are not searched for it.
    """
    return pages.join(items.select("doc_id").distinct(), "doc_id", "left_anti")


def representative_items(headers: DataFrame, items: DataFrame) -> DataFrame:
    """One line made from the header for each document without goods lines."""
    empty = headers.join(items.select("doc_id").distinct(), "doc_id", "left_anti")
    fob = F.coalesce("fob", F.lit(0.0))
    text = F.concat(F.lit("Mercadería General Declarada - Despacho "), F.coalesce(blank_to_null("number"), F.lit("S/N")))
    return empty.select(
        "doc_id", F.lit(0).alias("seq"), F.lit(5).alias("tier"), F.lit(1).alias("item_no"), F.lit(None).cast("int").alias("subitem_no"),
        F.lit(fv.HS_REPRESENTATIVE_CODE).alias("hs_code"), F.lit(None).cast("string").alias("product_code"),
        text.alias("description"), F.coalesce(blank_to_null("exporter"), F.lit("General")).alias("brand"),
        F.lit(1.0).alias("quantity"), F.lit("UNIDAD").alias("unit"), "net_weight",
        F.when(fob > 0, fob).alias("unit_value"), F.greatest(fob, F.lit(0.0)).alias("total_value"), F.lit(None).cast("double").alias("dropped_value"),
        F.col("exporter_country").alias("origin"), F.lit(None).cast("string").alias("provenance"), F.lit(1).alias("page"),
    )
