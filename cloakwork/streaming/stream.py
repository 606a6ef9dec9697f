"""Detection on streams: stateless per text, windowed counts, and a mapping that grows by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakwork.operators.pseudonyms import assigned
from cloakwork.functions.values import normalized
from cloakwork.operators.recognizers import Rule
from cloakwork.operators.resolve import detect, entity_rows


def read_units(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def detected_stream(units: DataFrame, keep: Sequence[str], rules: Sequence[Rule] | None = None) -> DataFrame:
    """A row for each resolved span: the batch projection, unchanged, on a stream."""
    return entity_rows(detect(units, rules=rules), keep)


def windowed_counts(spans: DataFrame, time_col: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Spans by tumbling window and type; rows later than the watermark are left out."""
    timed = spans.withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, width).alias("w"), "entity_type").agg(F.count("*").alias("spans")).select(
        F.col("w.start").alias("window_start"), "entity_type", "spans"
    )


REGISTRY_SCHEMA = (
    "doc_id bigint, entity_type string, normalized_original string, occurrences bigint, "
    "first struct<batch:bigint,unit_no:bigint,start:int,value:string>"
)


def registry_delta(rows: DataFrame, batch: int, unicode: bool = True) -> DataFrame:
    """What a batch of spans adds to the registry (doc_id, entity_type, normalized_original, occurrences, first)."""
    keyed = rows.withColumn("normalized_original", normalized(F.col("entity_type"), F.col("value"), unicode))
    place = F.struct(F.lit(batch).cast("bigint").alias("batch"), "unit_no", "start", "value")
    return keyed.groupBy("doc_id", "entity_type", "normalized_original").agg(F.count("*").alias("occurrences"), F.min(place).alias("first"))


def start_registry(spans: DataFrame, folder: str, checkpoint: str, unicode: bool = True) -> StreamingQuery:
    """Keep a registry in ``folder``: each batch writes its own additions, so its cost follows the batch,
    and a batch that is run again after a failure writes the same ones."""

    def add(batch: DataFrame, number: int) -> None:
        registry_delta(batch, number, unicode).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return spans.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def registry_at(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The registry after batch ``number``: values that were seen keep their place, so their fakes stay."""
    if number < 0:
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    added = spark.read.schema(f"{REGISTRY_SCHEMA}, batch bigint").parquet(folder).where(F.col("batch") <= number)
    return added.groupBy("doc_id", "entity_type", "normalized_original").agg(F.sum("occurrences").alias("occurrences"), F.min("first").alias("first"))


def registry_mappings(registry: DataFrame, seed: int) -> DataFrame:
    """Mappings with replacements from a registry."""
    return assigned(registry, seed)


def for_each(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
