"""Resolution of competing candidates into disjoint spans, as array expressions.

Clean the boundaries, admit by score and content, rank, then accept from the best down whatever
overlaps nothing accepted. That greedy choice is not an anti-join: a span that only a rejected
one overlaps stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.memo import remembered
from cloakwork.functions.spans import let, overlaps, piece
from cloakwork.operators.recognizers import Rule, candidates_column, registry
from cloakwork.schemas import CANDIDATE, ENTITY_TYPES, GENERIC_ORGANIZATIONS


def _by_type(entity_type: Column, at: int) -> Column:
    chosen = F
    for name, numbers in ENTITY_TYPES.items():
        chosen = chosen.when(entity_type == name, F.lit(numbers[at]))
    return chosen


def _with_bounds(c: Column, start: Column, end: Column) -> Column:
    fields = [c[f].alias(f) for f in ("score", "recognizer", "context", "ordinal")]
    return F.struct(c["entity_type"].alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), *fields)


def cleaned(text: Column, c: Column) -> Column:
    """Names end at a line break; no span begins or ends with white space."""

    def trim(value: Column) -> Column:
        named = c["entity_type"].isin("PERSON", "ORGANIZATION")
        line = F.when(named, F.substring_index(value, "\n", 1)).otherwise(value)

        def bounds(v: Column) -> Column:
            size = F.char_length(v)
            left = size - F.char_length(F.regexp_replace(v, r"(?U)^\s+", ""))
            right = F.char_length(F.regexp_replace(v, r"(?U)\s+$", ""))
            return _with_bounds(c, c["start"] + left, c["start"] + F.greatest(left, right))

        return let(line, bounds)

    return let(piece(text, c["start"], c["end"]), trim)


def admitted(text: Column, c: Column) -> Column:
    """Score at least the type's least; names of two words; organisations that are not generic."""
    value = F.lower(F.regexp_replace(piece(text, c["start"], c["end"]), r"(?U)^\s+|\s+$", ""))
    person = F.regexp_count(value, F.lit(r"(?U)[^\W\d_]+")) >= 2
    organization = (F.regexp_count(value, F.lit(r"\p{L}")) >= 2) & ~value.isin(*GENERIC_ORGANIZATIONS)
    content = F.when(c["entity_type"] == "PERSON", person).when(c["entity_type"] == "ORGANIZATION", organization).otherwise(F.lit(True))
    return (c["score"] >= _by_type(c["entity_type"], 0)) & content


#: Types from the last by name to the first: of full ties the last name wins.
LAST_TYPE_FIRST = sorted(ENTITY_TYPES, reverse=True)


def ranked(candidates: Column) -> Column:
    """Best first: score, precedence, length, then earlier start, later type name, earlier rule."""

    def key(c: Column) -> Column:
        return F.struct(
            (-c["score"]).alias("a"),
            (-_by_type(c["entity_type"], 1)).alias("b"),
            (c["start"] - c["end"]).alias("c"),
            c["start"].alias("d"),
            F.array_position(F.array(*map(F.lit, LAST_TYPE_FIRST)), c["entity_type"]).alias("e"),
            c["ordinal"].alias("f"),
            c.alias("candidate"),
        )

    return F.transform(F.array_sort(F.transform(candidates, key)), lambda k: k["candidate"])


def disjoint(best_first: Column) -> Column:
    """Greedy choice from ``best_first``, in order of start."""

    def take(chosen: Column, c: Column) -> Column:
        return F.when(F.exists(chosen, lambda k: overlaps(k, c)), chosen).otherwise(F.concat(chosen, F.array(c)))

    chosen = F.aggregate(best_first, F.array().cast(f"array<{CANDIDATE}>"), take)
    placed = F.array_sort(F.transform(chosen, lambda c: F.struct(c["start"].alias("s"), c["end"].alias("e"), c.alias("c"))))
    return F.transform(placed, lambda p: p["c"])


def resolved(text: Column, candidates: Column) -> Column:
    """Disjoint spans of ``text`` from its candidates."""
    clean = F.transform(candidates, lambda c: cleaned(text, c)).cast(f"array<{CANDIDATE}>")
    kept = F.filter(clean, lambda c: admitted(text, c))
    return F.when(F.size(candidates) == 0, F.array().cast(f"array<{CANDIDATE}>")).otherwise(
        disjoint(ranked(kept).cast(f"array<{CANDIDATE}>"))
    )


def detect(
    units: DataFrame,
    text_col: str = "text",
    entities: Sequence[str] | None = None,
    deny_lists=None,
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """``units`` with ``entities``: the resolved spans of each text. Narrow: no shuffle."""
    chosen = registry(deny_lists, entities) if rules is None else rules
    found = units.withColumn("__cw_candidates", candidates_column(text_col, tuple(chosen)))
    return found.withColumn("entities", resolved_column(text_col, "__cw_candidates")).drop("__cw_candidates")


@remembered
def resolved_column(text_col: str, candidates_col: str) -> Column:
    return resolved(F.coalesce(F.col(text_col), F.lit("")), F.col(candidates_col))


def entity_rows(detected: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """One row a resolved span, with its value."""
    # A plain explode would infer a filter on the array's size, and so detect everything twice.
    each = detected.select(*keep, text_col, F.explode_outer("entities").alias("c")).where("c is not null")
    return each.select(*keep, "c.*", piece(F.col(text_col), F.col("c.start"), F.col("c.end")).alias("value"))
