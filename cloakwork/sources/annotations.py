"""Annotated cases from JSON, with gold spans found by value and occurrence."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.spans import nth_start
from cloakwork.schemas import ANNOTATIONS


def annotated(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, case_id, text, entities) of an annotation file."""
    rows = spark.read.schema(ANNOTATIONS).option("mode", "FAILFAST").json(path, multiLine=True)
    if rows.where(F.col("datasets").isNull()).limit(1).count():
        raise ValueError("annotation file requires a datasets object")
    each = rows.select(F.explode("datasets").alias("dataset", "cases")).select("dataset", F.explode("cases").alias("c"))
    return each.select("dataset", F.col("c.id").alias("case_id"), F.col("c.text").alias("text"), F.col("c.entities").alias("entities"))


def cases(rows: DataFrame) -> DataFrame:
    return rows.select("dataset", "case_id", "text")


def gold(rows: DataFrame) -> DataFrame:
    """(dataset, case_id, entity_type, start, end); a value that is not there is an error."""
    each = rows.select("dataset", "case_id", "text", F.explode("entities").alias("e"))
    start = nth_start(F.col("text"), F.col("e.value"), F.coalesce("e.occurrence", F.lit(1)))
    placed = each.withColumn("start", start)
    end = (F.col("start") + F.char_length("e.value")).cast("int")
    return placed.select("dataset", "case_id", F.col("e.entity_type").alias("entity_type"), "start", end.alias("end"))


@dataclass(frozen=True)
class Settings:
    """Versions that a run names, and values that are always found, by entity type."""

    config_version: str
    model_version: str
    deny_lists: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


def settings_of(value: object) -> Settings:
    """From parsed JSON: an object with both versions; lists among ``deny_lists`` count, other values don't."""
    match value:
        case {"config_version": str(config), "model_version": str(model), **others} if config and model:
            match others.get("deny_lists", {}):
                case dict(lists):
                    return Settings(config, model, {name: tuple(map(str, own)) for name, own in lists.items() if isinstance(own, list)})
            raise ValueError("deny_lists is an object of lists by entity type")
    raise ValueError("a configuration is an object that names config_version and model_version")


def settings_from(path: str | Path) -> Settings:
    return settings_of(json.loads(Path(path).read_text("utf-8")))
