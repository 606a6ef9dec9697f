"""Expressions and helpers shared by the corpus operators.

Column names starting with ``__cw_`` are reserved for intermediates, so tables may carry any
other extra columns. An operator's output column replaces an input column of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: A separator between words of ASCII letters, ASCII digits and all non-ASCII characters.
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast path."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, gap: str) -> Column:
    """Words of ``text`` between runs matching ``gap``; empty array for null or wordless text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gap), lambda w: w != "")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add."""
    return df.drop(*names)


#: Bits of the filter below: at most 8 MB in every executor, whatever the data.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 26


def possibly_in(rows: DataFrame, col: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``col`` isn't among ``wanted``'s only column.

    A bitmap of hashed values, eight bits for each of the counted wanted ones, goes to all executors. It
    lets all wanted rows pass and few others, so that a join by ``col`` need not shuffle the rest. At
    MOST_BITS it stops to grow: beyond some tens of millions of wanted values more and in the end all
    rows pass, which costs the plain join's shuffle and changes no result. Null is a value like others.
    """
    n = wanted.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n).bit_length()))
    spread = F.pmod(F.xxhash64(F.col(wanted.columns[0])), F.lit(bits))
    bitmaps = wanted.select(spread.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__cw_slot"))
    bitmaps = bitmaps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__cw_bits"))
    own = F.pmod(F.xxhash64(F.col(col)), F.lit(bits))
    place = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.call_function("substring", F.col("__cw_bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    bit = F.call_function("shiftright", byte.cast("int"), F.pmod(place, F.lit(8)).cast("int"))
    found = bit.bitwiseAND(F.lit(1)) == 1
    joined = rows.join(F.broadcast(bitmaps), F.bitmap_bucket_number(own) == F.col("__cw_slot"))
    return joined.where(found).drop("__cw_slot", "__cw_bits")


#: A key with more than this part of all rows is heavy: there are fewer such keys than that.
HEAVY = 4096


def joined_by_key(rows: DataFrame, side: DataFrame, key: str, n_rows: int, weight: str, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``side``, which has each ``key`` once and tells in ``weight`` how many of the
    ``n_rows`` have it; ``side``'s other columns come as the struct ``__cw_side``.

    Heavy keys, at most HEAVY, are broadcast, and their rows go along by ``spread`` instead of the key.
    """
    payload = F.struct(*[c for c in side.columns if c != key])
    heavy = F.col(weight) > n_rows / HEAVY
    few = side.where(heavy).select(key, payload.alias("__cw_heavy"))
    rest = side.where(~heavy).select(F.col(key).alias("__cw_key"), payload.alias("__cw_light"))
    known = rows.join(F.broadcast(few), key, "left")
    apart = F.concat(F.lit("~"), spread.cast("string")).cast(rows.schema[key].dataType)
    dealt = known.withColumn("__cw_key", F.when(F.col("__cw_heavy").isNull(), F.col(key)).otherwise(apart))
    both = dealt.join(rest, "__cw_key", "left")
    return both.withColumn("__cw_side", F.coalesce("__cw_heavy", "__cw_light")).drop("__cw_key", "__cw_heavy", "__cw_light")


def bucket_count(n_rows: int, per_bucket: int = 256, most: int = 65536) -> int:
    """Hash buckets for ``n_rows``: grows with the table. ``most`` bounds the offset tables, a row a
    stratum and bucket; at the most, 20 billion slim rows come to some 300,000 a bucket, which sort and spill."""
    return max(16, min(most, n_rows // per_bucket))


def seeded_key(seed: str, *cols: Column) -> Column:
    """Hex digest that orders rows at random but alike in every run."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def stratum_key(col: Column) -> Column:
    """Non-null key that sorts by code point with nulls last."""
    return F.when(col.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col.cast("string")))


def hash_bucket(key: Column, n_buckets: int) -> Column:
    """Bucket by the leading 32 bits of a hex digest, so buckets follow the digest's order."""
    lead = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return F.shiftright(lead * F.lit(n_buckets), 32).cast("int")


def laid_end_to_end(
    rows: DataFrame, stratum: str, key: str, ties: Sequence[str], value: str, n_buckets: int, extra: DataFrame | None = None
) -> DataFrame:
    """Lay the rows of each stratum end to end in the order of ``key``.

    Adds ``__cw_start`` (sum of ``value`` over the rows before) and ``__cw_total`` (of the
    stratum). A stratum is cut into hash buckets whose sums give the offsets, so even one that
    holds a third of all rows is spread over ``n_buckets`` groups: the join and the running sum
    share one exchange on (stratum, bucket). ``extra`` holds further columns by stratum.
    """
    rows = rows.withColumn("__cw_bucket", hash_bucket(F.col(key), n_buckets))
    sums = rows.groupBy(stratum, "__cw_bucket").agg(F.sum(value).alias("__cw_sum"))
    before = Window.partitionBy(stratum).orderBy("__cw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        stratum,
        "__cw_bucket",
        F.coalesce(F.sum("__cw_sum").over(before), F.lit(0)).alias("__cw_offset"),
        F.sum("__cw_sum").over(Window.partitionBy(stratum)).alias("__cw_total"),
    )
    if extra is not None:
        offsets = offsets.join(extra, stratum)
    inside = Window.partitionBy(stratum, "__cw_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__cw_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return rows.join(offsets, [stratum, "__cw_bucket"]).withColumn("__cw_start", start).drop("__cw_offset", "__cw_bucket")
