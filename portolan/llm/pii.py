"""Operator 3: personal data by patterns, checksums and context, in SQL functions only.

A pattern proposes spans, a checksum confirms or rejects them, and words nearby raise the score
of those that stay uncertain. The base patterns decide by themselves; further patterns find what
the base ones lose (a card behind a telephone number, account numbers, local numbers) and count
from a score of ``THRESHOLD`` on. Positions follow from the lengths of the parts between matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.shared import filled

KINDS = ("email", "ip", "card", "phone", "iban")
THRESHOLD = 0.7
CONTEXT_CHARS = 40
CHUNK = 256
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DIGITS = r"(?<![0-9])[0-9]{13,}+"
FULL_PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
LOCAL_PHONE = r"0[0-9]{2,4}[ /-][0-9]{3,8}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: Words that make a kind likelier where they stand just before it.
CONTEXT = {
    "email": r"(?i)e-?mail|contact|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|adresse|server|host",
    "card": r"(?i)card|karte|carte|tarjeta|visa|credit",
    "phone": r"(?i)phone|\btel|call|mobile|fax|anruf|appel|llama",
    "iban": r"(?i)iban|account|konto|compte|cuenta|bank",
}
#: Score of a span of each pattern whose checks passed, before its context; and what context adds.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.75, "iban": 0.95, "local": 0.4}
CONTEXT_GAIN = 0.35


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0), lambda at, x: at + of(x))


def matches(text: Column, pattern: str, guard: str | None = None) -> Column:
    """Spans (start, end, value) of all matches, in code points, end exclusive; where ``guard`` is not found there are none.

    Starts are sums over what lies before; these are taken by chunks, so long lists stay cheap.
    """
    gap_and_value = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
        lambda value, gap: F.struct(value.alias("value"), F.char_length(gap).alias("gap"), F.char_length(value).alias("size")),
    )
    steps = F.filter(gap_and_value, lambda x: x["value"].isNotNull())
    width = lambda x: x["gap"] + x["size"]

    def placed(steps: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / CHUNK).cast("int")), lambda k: _total(F.slice(steps, k * CHUNK + 1, CHUNK), width))

        def spans(chunks: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                k = F.floor(i / CHUNK).cast("int")
                before = _total(F.slice(chunks, F.lit(1), k), lambda c: c) + _total(F.slice(steps, k * CHUNK + 1, i - k * CHUNK), width)
                return let(before + x["gap"], lambda at: F.struct(at.alias("start"), (at + x["size"]).alias("end"), x["value"].alias("value")))

            return F.transform(steps, span)

        return let(chunks, spans)

    found = let(steps, placed)
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")
    return F.when(text.rlike(guard), found).otherwise(none) if guard else found


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn check: every second from the right counts double, less 9 above 9."""

    def check(d: Column) -> Column:
        def part(i: Column) -> Column:
            digit = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2)

        return _total(F.transform(F.sequence(F.lit(0), F.length(d) - 1), part), lambda x: x) % 10 == 0

    return let(digits(value), check)


def mod_97(value: Column) -> Column:
    """Whether an account number leaves 1 modulo 97: first four characters last, letters as two digits from 10."""

    def check(v: Column) -> Column:
        turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
        codes = F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
        step = lambda at, c: F.when(c < 65, at * 10 + c - 48).otherwise(at * 100 + c - 55) % 97
        return F.aggregate(codes, F.lit(0), step) == 1

    return let(F.regexp_replace(value, " ", ""), check)


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _ip_parts(value: Column) -> Column:
    small = lambda d: (F.length(d) < 4) & (F.substring(F.concat(F.lit("0"), d), 1, 4).cast("int") <= 255)
    return F.forall(F.split(value, r"\."), lambda part: let(F.regexp_replace(part, "^0+", ""), small))


def _apart(text: Column, x: Column, chars: str) -> Column:
    """Neither the character before nor the one behind a span is one of ``chars``."""
    before = F.when(x["start"] > 0, F.substring(text, x["start"], F.lit(1))).otherwise(F.lit(""))
    return ~before.rlike(chars) & ~F.substring(text, x["end"] + 1, F.lit(1)).rlike(chars)


def _scored(text: Column, spans: Column, kind: str, pattern: str, base: bool) -> Column:
    def span(x: Column) -> Column:
        low = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.substring(text, low + 1, x["start"] - low).rlike(CONTEXT[kind])
        score = F.lit(PRIOR[pattern]) + F.when(near, CONTEXT_GAIN).otherwise(0.0)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("order"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"),
            F.least(score, F.lit(1.0)).alias("score"), F.lit(base).alias("base"), x["value"].alias("value"),
        )

    return F.transform(spans, span)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (order, start, end, kind, score, base, value).

    Spans are sorted by kind as in ``KINDS``, then start; positions are code points, the end exclusive. Base spans
    are always there; further ones have a score of ``THRESHOLD`` or more and overlap no base span of their kind. Null
    and empty texts have none. Repeated rows are judged each; other columns are ignored; an empty table gives an empty table.
    """
    text = F.col("text")
    n_digits = lambda x: F.length(digits(x["value"]))
    base = {
        "email": matches(text, EMAIL, "@"),
        "ip": F.filter(matches(text, IP, r"[0-9]\.[0-9]++\.[0-9]"), lambda x: _ip_parts(x["value"])),
        "card": F.filter(matches(text, CARD, CARD), lambda x: _between(n_digits(x), 13, 19) & luhn(x["value"])),
        "phone": F.filter(matches(text, PHONE, r"\+[0-9]"), lambda x: _between(n_digits(x), 9, 15)),
    }
    further = [
        ("card", "card", F.filter(matches(text, DIGITS, DIGITS), lambda x: _between(F.length(x["value"]), 13, 19) & luhn(x["value"]))),
        ("phone", "phone", F.filter(matches(text, FULL_PHONE, r"\+[0-9]"), lambda x: _between(n_digits(x), 9, 15) & _apart(text, x, "[0-9]"))),
        ("phone", "local", F.filter(matches(text, LOCAL_PHONE, r"0[0-9]{2,4}[ /-][0-9]"), lambda x: _between(n_digits(x), 9, 15) & _apart(text, x, "[0-9+]"))),
        ("iban", "iban", F.filter(matches(text, IBAN, "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), lambda x: _apart(text, x, "[A-Za-z0-9]") & mod_97(x["value"]))),
    ]
    # plain columns first: what is used twice below is then computed once
    rows = docs.select(F.col(id_col).alias("doc_id"), filled(text_col).alias("text"))
    rows = rows.select("doc_id", "text", *(_scored(text, spans, kind, kind, True).alias(f"base_{kind}") for kind, spans in base.items()))
    found = [F.col(f"base_{kind}") for kind in base]
    for kind, pattern, spans in further:
        good = F.filter(_scored(text, spans, kind, pattern, False), lambda x: x["score"] >= THRESHOLD)
        if kind in base:
            own = F.col(f"base_{kind}")
            good = F.filter(good, lambda x: ~F.exists(own, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))  # noqa: B023
        found.append(good)
    return rows.select("doc_id", F.array_sort(reduce(lambda a, b: F.concat(a, b), found)).alias("spans"))


def printed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
