"""A training corpus from raw documents, in five stages over the columns of ``documents``.

Each stage reads what the one before wrote, so a lost executor costs a stage's tasks, not the
pipeline; stages lie in the folder that the session's spark.checkpoint.dir names, and each is
removed once the next is written.

Defined results: null, empty and wordless texts are scored by their features, link with nothing,
hold no passage, stay once in the mix and are dealt to shards; null ids are judged by their
text, sources that are null are one source; of equal rows one stays; an empty table gives no rows; without
labels of both kinds the first stage keeps everything. Extra columns of any name are carried
along untouched; of the last stage's outputs, ``shard`` and ``slot`` replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.lineage import removed, scratch
from cloakwork.llm.decontamination import clean
from cloakwork.llm.mixing import materialised, mixed
from cloakwork.llm.near_dedup import deduplicated
from cloakwork.llm.quality import learned, scored
from cloakwork.llm.sharding import OUTPUTS as SHARD_OUTPUTS
from cloakwork.llm.sharding import interleaved_shards

#: What the operators read; all other columns travel in REST, out of the way of their outputs.
READ = ("doc_id", "text", "source")
REST = "carried along"


def packed(docs: DataFrame) -> DataFrame:
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in READ]
    return docs.select(*READ, F.struct(F.lit(True).alias("__cw_any"), *rest).alias(REST))


def unpacked(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The ``columns`` that were packed, in their order, and ``more``."""
    own = [F.col(c) if c in READ else F.col(REST).getField(c).alias(c) for c in columns if c not in more]
    return rows.select(*own, *more)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts."""
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(scored(packed(docs), model).where("predicted = 1"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return unpacked(deduplicated(packed(docs)), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an exact or a proximity match of the benchmark."""
    return unpacked(clean(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time that a document is in the mix."""
    return unpacked(materialised(mixed(packed(docs))), docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in 40 shards, each with the mixture of the whole."""
    return unpacked(interleaved_shards(packed(docs)), docs.columns, *SHARD_OUTPUTS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", mixture),
    ("sharding", shards),
]

#: A fitted classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` of ``sf_dir``; each is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        folder = scratch(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/rows")
        if before is not None:
            removed(spark, before)
        docs, before = spark.read.parquet(f"{folder}/rows"), folder
    return docs
