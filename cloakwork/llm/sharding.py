"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest within their source, each gets its fractional rank there,
and the table sorted by that rank is cut into runs of equal length, so every shard has the
mixture of the whole. Law: ``rows`` (shard sizes differ by one at most).

Defined results: a null source is a source of its own; a null or empty text has size 16 and
CRC 0; rows with equal doc_id are told apart by their text's CRC, and identical rows take
adjacent ranks; an empty table gives no rows; input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import bucket_count, laid_end_to_end, seeded_key, stratum_key, table, without

OUTPUTS = ("shard", "slot")
PER_ROW_BYTES = 16


def interleaved_shards(
    docs: DataFrame,
    n_shards: int = 40,
    seed: str = "interleave",
    stratum: str = "source",
    id_col: str = "doc_id",
    tie_col: str = "text",
    n_buckets: int | None = None,
) -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0 in each shard).

    Two exchanges of the rows and no global sort: ranks within a source come from hash-bucket
    offsets, positions in the interleaved order from offsets of fractional-rank buckets.
    """
    if n_buckets is None:
        n_buckets = bucket_count(docs.count())
    rows = without(docs, *OUTPUTS).withColumns(
        {
            "__cw_stratum": stratum_key(F.col(stratum)),
            "__cw_tie": F.crc32(F.coalesce(F.col(tie_col).cast("string"), F.lit("")).cast("binary")),
            "__cw_one": F.lit(1).cast("bigint"),
        }
    )
    # The tie too, so that rows without an id of their own are spread as well.
    rows = rows.withColumn("__cw_key", seeded_key(seed, F.col(id_col), F.col(tie_col)))
    ranked = laid_end_to_end(rows, "__cw_stratum", "__cw_key", [id_col, "__cw_tie"], "__cw_one", n_buckets)
    share = (2 * F.col("__cw_start") + 1) / (2 * F.col("__cw_total"))
    ranked = ranked.withColumn("__cw_share", share).withColumn("__cw_band", F.floor(F.col("__cw_share") * n_buckets))
    counts = ranked.groupBy("__cw_band").agg(F.count("*").alias("__cw_n"))
    everything = Window.partitionBy(F.lit(0))  # over the bands alone: at most n_buckets rows
    before = everything.orderBy("__cw_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = counts.select(
        "__cw_band",
        F.coalesce(F.sum("__cw_n").over(before), F.lit(0)).alias("__cw_first"),
        F.sum("__cw_n").over(everything).alias("__cw_all"),
    )
    inside = Window.partitionBy("__cw_band").orderBy("__cw_share", "__cw_stratum", "__cw_key", id_col, "__cw_tie")
    at = F.col("__cw_first") + F.row_number().over(inside) - 1
    placed = ranked.join(bands, "__cw_band").withColumn("__cw_at", at)
    placed = placed.withColumn("shard", F.expr(f"cast(__cw_at * {n_shards} div __cw_all as int)"))
    placed = placed.withColumn("slot", F.expr(f"__cw_at - (shard * __cw_all + {n_shards - 1}) div {n_shards}"))
    return placed.drop(*[c for c in placed.columns if c.startswith("__cw_")])


def op8_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + PER_ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleaved_shards(slim, tie_col="text_crc32").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
