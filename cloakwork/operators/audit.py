"""The safe audit: counts by type, never a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_counts(mappings: DataFrame) -> DataFrame:
    """(entity_type, occurrences, mappings)."""
    return mappings.groupBy("entity_type").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("mappings"))


def audit_row(mappings: DataFrame) -> DataFrame:
    """One row: entity_counts (map by type), total_entities, unique_mappings."""
    by_type = type_counts(mappings)
    entry = F.struct("entity_type", "occurrences")
    return by_type.agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("entity_counts"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("total_entities"),
        F.coalesce(F.sum("mappings"), F.lit(0)).alias("unique_mappings"),
    )


def document_audits(mappings: DataFrame) -> DataFrame:
    """The same for each document: (doc_id, entity_counts, total_entities, unique_mappings)."""
    by_type = mappings.groupBy("doc_id", "entity_type").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("mappings"))
    entry = F.struct("entity_type", "occurrences")
    return by_type.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("entity_counts"),
        F.sum("occurrences").alias("total_entities"),
        F.sum("mappings").alias("unique_mappings"),
    )
