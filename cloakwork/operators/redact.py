"""Two-pass redaction of text units: detect and replace, then replay the known values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.lineage import settle
from cloakwork.functions.spans import find_all, spliced
from cloakwork.functions.values import casefold, normalized
from cloakwork.operators.pseudonyms import mapped, replay_dictionary, replay_patterns
from cloakwork.operators.recognizers import Rule
from cloakwork.operators.resolve import detect, entity_rows
from cloakwork.schemas import REPLACEMENT


def replaced(units: DataFrame, rows: DataFrame, keys: Sequence[str] = ("doc_id", "unit_no"), text_col: str = "text") -> DataFrame:
    """``units`` with ``replacements`` and ``redacted``; ``rows`` has keys, start, end, replacement."""
    folded = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.col("replacement").alias("value")))).alias("replacements")
    )
    joined = units.join(folded, list(keys), "left")
    found = F.coalesce("replacements", F.array().cast(f"array<{REPLACEMENT}>"))
    return joined.withColumn("replacements", found).withColumn("redacted", spliced(F.coalesce(F.col(text_col), F.lit("")), F.col("replacements")))


def first_pass(
    units: DataFrame,
    seed: int,
    entities: Sequence[str] | None = None,
    deny_lists: Mapping[str, Sequence[str]] | None = None,
    rules: Sequence[Rule] | None = None,
    unicode: bool = True,
    detector: Callable[..., DataFrame] = detect,
) -> tuple[DataFrame, DataFrame]:
    """Units with ``redacted``, and the mappings (by document).

    Any ``detector`` that adds ``entities`` to units will do. ``redacted`` is null in documents
    whose mapping is incomplete.
    """
    found = entity_rows(detector(units, entities=entities, deny_lists=deny_lists, rules=rules), ["doc_id", "unit_no"])
    found = settle(found)  # read twice: texts are scanned once
    mappings = settle(mapped(found, seed, unicode=unicode))
    keyed = found.withColumn("normalized_original", normalized(F.col("entity_type"), F.col("value"), unicode))
    fakes = mappings.select("doc_id", "entity_type", "normalized_original", "replacement")
    return replaced(units, keyed.join(fakes, ["doc_id", "entity_type", "normalized_original"])), mappings


def replay_hits(texts: DataFrame, mappings: DataFrame, text_col: str = "redacted", unicode: bool = True) -> DataFrame:
    """(doc_id, unit_no, start, end, value, entity_type): known originals that stand in ``texts``.

    Case is of no account and word boundaries neither. Only documents that have known values are
    scanned, each with its own alternation.
    """
    patterns = replay_patterns(replay_dictionary(mappings, unicode=unicode))
    scanned = texts.join(patterns, "doc_id").withColumn("hit", F.explode_outer(find_all(F.col(text_col), F.col("pattern")))).where("hit is not null")
    fold = casefold if unicode else F.lower
    typed = scanned.withColumn("entity_type", F.element_at("by_key", fold(F.col("hit.value"))))
    return typed.select("doc_id", "unit_no", "hit.start", "hit.end", "hit.value", "entity_type")


def second_pass(first: DataFrame, mappings: DataFrame, unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """Units with ``redacted`` after the replay, and the mappings with its occurrences added."""
    hits = settle(replay_hits(first, mappings, unicode=unicode))
    keyed = hits.withColumn("normalized_original", normalized(F.col("entity_type"), F.col("value"), unicode))
    keys = ["doc_id", "entity_type", "normalized_original"]
    fakes = mappings.select(*keys, "replacement")
    again = first.select(*[c for c in first.columns if c not in ("replacements", "redacted")], F.col("redacted").alias("__cw_first"))
    texts = replaced(again, keyed.join(fakes, keys), text_col="__cw_first")
    texts = texts.withColumn("redacted", F.when(F.col("__cw_first").isNotNull(), F.col("redacted"))).drop("__cw_first")
    more = keyed.groupBy(*keys).agg(F.count("*").alias("more"))
    total = F.col("occurrences") + F.coalesce("more", F.lit(0))
    return texts, mappings.join(more, keys, "left").withColumn("occurrences", total).drop("more")


def redact(
    units: DataFrame,
    seed: int,
    entities: Sequence[str] | None = None,
    deny_lists: Mapping[str, Sequence[str]] | None = None,
    rules: Sequence[Rule] | None = None,
    unicode: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Both passes over ``units`` (doc_id, unit_no, text): redacted units and mappings."""
    first, mappings = first_pass(units, seed, entities, deny_lists, rules, unicode)
    return second_pass(first, mappings, unicode)
