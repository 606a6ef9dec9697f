"""Checks of a redaction: every check is a DataFrame of violations that must be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.values import casefold

LEAST_SECRET_LENGTH = 5
RENDER_WARNING = "visual_render_required_before_delivery"
IMAGE_WARNING = "embedded_images_replaced_without_ocr"


def occurrences(text: Column, value: Column) -> Column:
    """Non-overlapping occurrences of a non-empty ``value``."""
    return F.coalesce(F.try_divide(F.char_length(text) - F.char_length(F.replace(text, value, F.lit(""))), F.char_length(value)), F.lit(0)).cast("bigint")


def removed_occurrences(before: DataFrame, after: DataFrame, mappings: DataFrame, unicode: bool = True) -> DataFrame:
    """(doc_id, entity_type, normalized_original, removed) for the mapped values that can be counted.

    ``before`` and ``after`` are (doc_id, text); an original that is part of any replacement of its
    document is left out, as its count says nothing. A document's mappings are an array beside its
    text, so a text is shuffled and folded once, however many values are mapped.
    """
    fold = casefold if unicode else F.lower

    def folded(df: DataFrame, name: str) -> DataFrame:
        own = df.join(listed.select("doc_id"), "doc_id", "left_semi")
        return own.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias(name)).withColumn(name, fold(F.col(name)))

    entry = F.struct("entity_type", "normalized_original", "key", "fake")
    keyed = mappings.withColumns({"key": fold(F.col("original")), "fake": fold(F.col("replacement"))})
    listed = keyed.groupBy("doc_id").agg(F.collect_list(entry).alias("maps"))
    joined = listed.join(folded(before, "source_text"), "doc_id").join(folded(after, "output_text"), "doc_id", "left")
    countable = F.filter("maps", lambda m: ~F.exists("maps", lambda f: F.coalesce(F.contains(f["fake"], m["key"]), F.lit(False))))

    def counted(m: Column) -> Column:
        gone = occurrences(F.col("source_text"), m["key"]) - occurrences(F.coalesce("output_text", F.lit("")), m["key"])
        return F.struct(m["entity_type"].alias("entity_type"), m["normalized_original"].alias("normalized_original"), gone.alias("removed"))

    return joined.select("doc_id", F.inline(F.transform(countable, counted)))


def left_behind(before: DataFrame, after: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mapped values of which no occurrence went away."""
    return removed_occurrences(before, after, mappings).where("removed <= 0")


def hash_mismatches(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Documents whose content hash isn't the one recorded; both are (doc_id, sha256)."""
    e, f = expected.withColumnRenamed("sha256", "expected"), found.withColumnRenamed("sha256", "found")
    return e.join(f, "doc_id", "full_outer").where(~F.col("expected").eqNullSafe(F.col("found")))


def media_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, name, problem) of media (doc_id, name, content, width, height): every one must be
    in both, with other bytes and of the same size."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("doc_id", "name", F.struct(F.sha2("content", 256).alias("sha"), F.struct("width", "height").alias("size")).alias(name))

    both = side(before, "old").join(side(after, "new"), ["doc_id", "name"], "full_outer")
    tests = {"absent": F.isnull("old") | F.isnull("new"), "kept": F.col("old.sha") == F.col("new.sha"), "resized": F.col("old.size") != F.col("new.size")}
    problem = F.coalesce(*[F.when(wrong, F.lit(name)) for name, wrong in tests.items()])
    return both.select("doc_id", "name", problem.alias("problem")).where("problem is not null")


def audit_leaks(audit_json: str, mappings: DataFrame) -> DataFrame:
    """Mapped originals or fakes of five or more characters that stand in the audit's text."""
    both = mappings.select(F.explode(F.array("original", "replacement")).alias("value"))
    secret = both.where(F.char_length(F.trim("value")) >= LEAST_SECRET_LENGTH)
    return secret.where(F.contains(F.lit(audit_json.casefold()), casefold(F.col("value")))).distinct()


def warnings_for(n_images: int) -> list[str]:
    return [IMAGE_WARNING] * bool(n_images) + [RENDER_WARNING]
