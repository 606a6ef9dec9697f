"""Span expressions over code-point offsets, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


BLOCK = 64
TOKEN = r"(?U)\S+"


def as_column(pattern: str | Column) -> Column:
    return F.lit(pattern) if isinstance(pattern, str) else pattern


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find_all(text: Column, pattern: str | Column) -> Column:
    """Every match as array<struct<start, end, value>>; ``pattern`` never matches the empty string.

    Matches and the gaps between them come from one pattern, so a match starts where the gaps and
    matches before it end. Texts without a match skip both extractions.
    """
    p = as_column(pattern)
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    matches, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)

    def advance(state: Column, both: Column) -> Column:
        start = state["at"] + F.char_length(both["gap"])
        end = start + F.char_length(both["match"])
        found = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), both["match"].alias("value"))
        return F.struct(end.cast("int").alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    # The last gap has no match after it.
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda x: x["match"].isNotNull())

    def in_blocks(pairs: Column) -> Column:
        # An array grows by copying: blocks keep texts with many thousands of matches cheap.
        def block(state: Column, k: Column) -> Column:
            begin = F.struct(state["at"].alias("at"), nothing.alias("found"))
            more = F.slice(pairs, k * BLOCK + 1, BLOCK)
            return F.aggregate(
                more, begin, advance, lambda s: F.struct(s["at"].alias("at"), F.concat(state["found"], s["found"]).alias("found"))
            )

        start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))
        last = F.greatest(((F.size(pairs) - 1) / BLOCK).cast("int"), F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), last), start, block, lambda s: s["found"])

    return F.when(F.rlike(text, p), let(pairs, in_blocks)).otherwise(nothing)


def piece(text: Column, start: Column, end: Column) -> Column:
    """``text`` from ``start`` up to ``end``, as offsets from 0."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def overlaps(one: Column, other: Column) -> Column:
    """Half-open spans with a common position; touching spans have none."""
    return (one["start"] < other["end"]) & (other["start"] < one["end"])


def literal(value: Column) -> Column:
    """A pattern that matches exactly ``value``."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def nth_start(text: Column, value: Column, n: Column) -> Column:
    """Start of the ``n``-th (from 1) non-overlapping occurrence of ``value``; an error if there is none."""
    hits = find_all(text, literal(value))
    wrong = F.raise_error(F.lit("annotated value occurrence is not present in case text"))
    return F.when((n >= 1) & (n <= F.size(hits)), F.get(hits, n - 1)["start"]).otherwise(wrong.cast("int"))


def spliced(text: Column, replacements: Column) -> Column:
    """``text`` with each of the sorted, disjoint ``replacements`` (start, end, value) put in."""

    def put(state: Column, r: Column) -> Column:
        return F.struct(
            F.concat(state["out"], piece(text, state["at"], r["start"]), r["value"]).alias("out"), r["end"].alias("at")
        )

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(replacements, begin, put, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))


def tokens(text: Column) -> Column:
    """Runs of non-space characters with their offsets."""
    return find_all(text, TOKEN)
