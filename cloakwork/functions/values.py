"""Validation and normal forms of single values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cloakwork.schemas import DIGIT_TYPES

# The multiplication and permutation tables of the Verhoeff checksum.
VERHOEFF_D = (
    "0123456789", "1234067895", "2340178956", "3401289567", "4012395678",
    "5987604321", "6598710432", "7659821043", "8765932104", "9876543210",
)
VERHOEFF_P = (
    "0123456789", "1576283094", "5803796142", "8916043527",
    "9453126870", "4286573901", "2793806415", "7046913258",
)
# Date formats of a birth date, as patterns of the value and of the parser.
DATE_SHAPES = (
    (r"\d{1,2}\s+[A-Za-z]{4,9}\s+\d{4}", "d MMMM yyyy"),
    (r"\d{1,2}\s+[A-Za-z]{3}\s+\d{4}", "d MMM yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}\.\d{1,2}\.\d{1,2}", "yyyy.M.d"),
)
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
# Letters whose upper case is newer than DuckDB's tables (Unicode 16).
UNPAIRED = "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
#: Characters whose upper case is several characters, and the one that each has by itself.
SINGLE_UPPER = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1} | {"ß": "ẞ"}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    return F.call_function("luhn_check", digits(value))


def verhoeff_valid(value: Column) -> Column:
    """Checksum over the digits, the last of which is the check digit."""
    d, p = F.lit("".join(VERHOEFF_D)), F.lit("".join(VERHOEFF_P))
    reversed_digits = F.filter(F.split(F.reverse(digits(value)), ""), lambda x: x != "")

    def step(state: Column, digit: Column) -> Column:
        permuted = F.substring(p, state["i"] % 8 * 10 + digit.cast("int") + 1, F.lit(1)).cast("int")
        return F.struct(
            F.substring(d, state["c"] * 10 + permuted + 1, F.lit(1)).cast("int").alias("c"), (state["i"] + 1).alias("i")
        )

    return F.aggregate(reversed_digits, F.struct(F.lit(0).alias("c"), F.lit(0).alias("i")), step, lambda s: s["c"] == 0)


def ssn_valid(value: Column) -> Column:
    """No unissued area, group or serial, one separator throughout, not all digits alike."""
    d = digits(value)
    area = F.substring(d, 1, 3)
    return (
        ~area.isin("000", "666")
        & (F.substring(d, 1, 1) != "9")
        & (F.substring(d, 4, 2) != "00")
        & (F.substring(d, 6, 4) != "0000")
        & ~F.rlike(d, F.lit(r"^(\d)\1{8}$"))
        & F.rlike(value, F.lit(r"^(?:\d{9}|\d{3}([- .])\d{2}\1\d{4})$"))
    )


def date_of_birth(value: Column) -> Column:
    """The date that ``value`` is in one of the eight formats, else null."""
    lower = F.lower(value)
    # Month names that are neither whole nor three letters (such as "sept") are no month.
    known = F.regexp_extract(lower, r"([a-z]+)", 1).isin(*MONTHS, *(m[:3] for m in MONTHS))
    spaced = F.regexp_replace(F.initcap(lower), r"\s+", " ")
    parsed = [
        F.when(F.rlike(value, F.lit(f"^(?:{shape})$")) & (known | F.lit("MMM" not in form)), F.try_to_timestamp(spaced, F.lit(form)))
        for shape, form in DATE_SHAPES
    ]
    return F.coalesce(*parsed).cast("date")


def ipv4_valid(value: Column) -> Column:
    return F.forall(F.split(value, "[.]"), lambda o: F.try_to_number(o, F.lit("999")).cast("int") <= 255)


def _groups(value: Column) -> Column:
    return F.filter(F.split(value, ":"), lambda g: g != "")


def ipv6_valid(value: Column) -> Column:
    """Eight groups of up to four hex digits, or fewer around one ``::``."""
    groups = _groups(value)
    short = F.contains(value, F.lit("::"))
    return (
        F.rlike(value, F.lit("^[0-9A-Fa-f:]+$"))
        & ~F.contains(value, F.lit(":::"))
        & (F.size(F.split(value, "::")) <= 2)
        & ~F.rlike(value, F.lit("^:[^:]|[^:]:$"))
        & F.forall(groups, lambda g: F.char_length(g) <= 4)
        & F.when(short, F.size(groups) <= 7).otherwise(F.size(groups) == 8)
    )


def ipv6_compressed(value: Column) -> Column:
    """Canonical form: lower case, no leading zeros, the first longest run of zeros as ``::``."""
    halves = F.split(F.lower(value), "::")
    left = _groups(F.element_at(halves, 1))
    right = F.when(F.size(halves) > 1, _groups(F.element_at(halves, -1))).otherwise(F.array().cast("array<string>"))
    fill = F.greatest(8 - F.size(left) - F.size(right), F.lit(0))
    groups = F.concat(left, F.array_repeat(F.lit("0"), fill), right)
    full = F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
    forms = []
    for run in range(8, 1, -1):
        pattern = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?:$|:)(.*)$"
        short = F.concat(F.regexp_extract(full, pattern, 1), F.lit("::"), F.regexp_extract(full, pattern, 2))
        forms.append(F.when(F.rlike(full, F.lit(pattern)), short))
    return F.coalesce(*forms, full)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


def upper_each(value: Column) -> Column:
    """Upper case of each character by itself, as DuckDB has it; F.upper makes several of some (SS of ß)."""
    apart, own = "".join(SINGLE_UPPER) + UNPAIRED, "".join(SINGLE_UPPER.values()) + UNPAIRED
    pieces = F.split(value, f"(?<=[{apart}])|(?=[{apart}])", -1)
    raised = F.transform(pieces, lambda p: F.when(F.rlike(p, F.lit(f"[{apart}]")), F.translate(p, apart, own)).otherwise(F.upper(p)))
    return F.when(F.rlike(value, F.lit(f"[{apart}]")), F.array_join(raised, "")).otherwise(F.upper(value))


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.char_length(value)


def nfkc(value: Column) -> Column:
    """NFKC; only non-ASCII values go to Python."""
    return F.coalesce(_nfkc(F.when(~is_ascii(value), value)), value)


def casefold(value: Column) -> Column:
    return F.coalesce(_casefold(F.when(~is_ascii(value), value)), F.lower(value))


def normalized(entity_type: Column, value: Column, unicode: bool = True) -> Column:
    """Normal form by type; ``unicode=False`` keeps ASCII data wholly on the JVM."""
    clean = F.regexp_replace(F.regexp_replace(nfkc(value) if unicode else value, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    folded = casefold(clean) if unicode else F.lower(clean)
    numerals = F.regexp_replace(clean, r"(?U)\D" if unicode else r"\D", "")
    ip = F.when(F.contains(clean, F.lit(":")), ipv6_compressed(clean)).otherwise(clean)
    return F.when(entity_type.isin(*DIGIT_TYPES), numerals).when(entity_type == "IP_ADDRESS", ip).otherwise(folded)
