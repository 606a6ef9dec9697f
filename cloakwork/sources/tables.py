"""Text units from tables: documents, lines of long texts, and the text of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIDDEN_ELEMENTS = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
TAG = "<[^>]*>"


TEXT_TABLES = ("documents", "pages")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in TEXT_TABLES else table


def spread(texts: DataFrame) -> DataFrame:
    """Texts dealt evenly over the cores, if the table has no more splits than there are cores.

    A small table may be one row group, which one core would scan alone; a large table, with
    more splits than cores, is left as it lies.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(2 * cores) if texts.rdd.getNumPartitions() <= cores else texts


def text_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit_no, text): a unit for each document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("bigint").alias("unit_no"), F.col(text_col).alias("text"))


def line_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A unit for each line, with its offset: for rules that don't cross a line, in long texts."""
    lines = F.split(F.col(text_col), "\n", -1)
    offsets = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,text:string>>").alias("units")),
        lambda s, line: F.struct(
            (s["at"] + F.char_length(line) + 1).cast("int").alias("at"),
            F.concat(s["units"], F.array(F.struct(s["at"].cast("int").alias("offset"), line.alias("text")))).alias("units"),
        ),
        lambda s: s["units"],
    )
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(offsets).alias("unit_no", "u")).where("u is not null")
    return each.select("doc_id", F.col("unit_no").cast("bigint").alias("unit_no"), "u.offset", "u.text")


def html_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, HIDDEN_ELEMENTS, " "), TAG, " "))


def html_units(pages: DataFrame) -> DataFrame:
    """(page_id, text): what is left of a page without scripts, styles and tags."""
    return pages.select("page_id", html_text(F.col("html")).alias("text"))
