"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The rows of a source, in seeded order, form one endless token stream that starts over at its
end; it is cut into blocks of equally many words. Blocks go to sources by the highest quotient
target / (2k + 1), for as many houses as there are shards, so every shard has an integer quota
of blocks of each source. Shard by shard, a source's next blocks in seeded order are taken: the
result tells for each row how many of its words each shard takes.

Rows of a source are spread over hash buckets. Windows over sources alone hold a row a source (and shard):
a million sources are some hundred MB, which sort and spill in one task.

Defined results: null or wordless text has size 0 and nothing is taken of it; sources sort by
code point with null last; rows with equal doc_id are ordered by their size, identical rows
are interchangeable; a table without words has targets of 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import SPACED_WORD, bucket_count, laid_end_to_end, seeded_key, stratum_key, table, without

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 16
OUTPUTS = ("size", "source_size", "target", "taken", "shards")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """Targets by source for ``sizes`` (__cw_stratum, __cw_words): one row a source.

    A target stops at ``most_passes`` times its source's size. With sources sorted by size over
    weight the capped ones come first, so running sums give the water level that remains for
    the others: the level before a source is highest at the first source that isn't capped.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("__cw_rank", F.row_number().over(everything.orderBy("__cw_stratum")))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("__cw_rank") - 1) % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("__cw_weight", weight).withColumn("__cw_most", most_passes * F.col("__cw_words"))
    before = everything.orderBy(F.col("__cw_most") / F.col("__cw_weight"), "__cw_stratum").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("__cw_words").over(everything) - F.coalesce(F.sum("__cw_most").over(before), F.lit(0))
    weights_left = F.sum("__cw_weight").over(everything) - F.coalesce(F.sum("__cw_weight").over(before), F.lit(0))
    levels = capped.withColumn("__cw_level", rest / weights_left)
    level = F.max("__cw_level").over(everything)
    target = F.least(F.col("__cw_weight") * level, F.col("__cw_most").cast("double"))
    return levels.select("__cw_stratum", "__cw_words", "__cw_most", target.alias("__cw_target"))


def block_quotas(targets: DataFrame, block_words: int, n_shards: int) -> DataFrame:
    """Sainte-Lague quotas: (__cw_stratum, shard, __cw_block, seats up to that shard, quota).

    Exact without ranking every block: a divisor that is surely too large gives each source
    seats it must get, one that is surely too small bounds what it can get, and only the
    quotients between the two, a few for each source, are ranked for the seats that remain.
    """
    everything = Window.partitionBy(F.lit(0))
    total, n_sources = F.sum("__cw_words").over(everything), F.count("*").over(everything)
    sized = targets.withColumns({"__cw_all": total, "__cw_sources": n_sources})
    sized = sized.withColumn("__cw_block", F.lit(block_words).cast("bigint"))
    houses = sized.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    houses = houses.withColumn("__cw_house", F.expr(f"(__cw_all div __cw_block) * (shard + 1) div {n_shards}"))
    share = F.coalesce(F.try_divide(F.col("__cw_target"), F.col("__cw_all")), F.lit(0.0))
    half = F.col("__cw_sources") / 2
    least = F.greatest(F.floor(share * (F.col("__cw_house") - half) + 0.5) - 1, F.lit(0))
    most = F.floor(share * (F.col("__cw_house") + half) + 0.5) + 1
    houses = houses.withColumns({"__cw_least": least.cast("bigint"), "__cw_seat_most": most.cast("bigint")})
    by_shard = Window.partitionBy("shard")
    houses = houses.withColumn("__cw_left", F.col("__cw_house") - F.sum("__cw_least").over(by_shard))
    seats = houses.withColumn("__cw_seat", F.explode(F.expr("sequence(__cw_least, greatest(__cw_least, __cw_seat_most))")))
    quotient = F.col("__cw_target") / (2 * F.col("__cw_seat") + 1)
    place = F.row_number().over(by_shard.orderBy(quotient.desc(), "__cw_stratum", "__cw_seat"))
    won = seats.withColumn("__cw_won", (place <= F.col("__cw_left")).cast("bigint"))
    seated = won.groupBy("__cw_stratum", "shard", "__cw_block", "__cw_least").agg(F.sum("__cw_won").alias("__cw_won"))
    seated = seated.withColumn("__cw_seats", F.col("__cw_least") + F.col("__cw_won"))
    earlier = F.lag("__cw_seats", 1, 0).over(Window.partitionBy("__cw_stratum").orderBy("shard"))
    return seated.select("__cw_stratum", "shard", "__cw_block", "__cw_seats", (F.col("__cw_seats") - earlier).alias("quota"))


def source_plan(sizes: DataFrame, block_words: int, n_shards: int, weights: tuple[int, ...], most_passes: int) -> DataFrame:
    """By source: target and __cw_parts, the stretch (shard, low, high) of its words that each shard takes."""
    targets = source_targets(sizes, weights, most_passes)
    quotas = block_quotas(targets, block_words, n_shards)
    both = quotas.join(targets.select("__cw_stratum", "__cw_target", "__cw_most"), "__cw_stratum")
    low, high = (F.least(seats * F.col("__cw_block"), F.col("__cw_most")) for seats in (F.col("__cw_seats") - F.col("quota"), F.col("__cw_seats")))
    part = F.struct("shard", low.alias("low"), high.alias("high"))
    return both.groupBy("__cw_stratum").agg(F.first("__cw_target").alias("__cw_target"), F.array_sort(F.collect_list(part)).alias("__cw_parts"))


def words_by_shard(most_passes: int) -> Column:
    """(shard, words) of the shards that take words of a row: its place in every pass against their stretches."""

    def taken(part: Column) -> Column:
        def in_pass(k: int) -> Column:
            begin = F.col("__cw_start") + k * F.col("__cw_total")
            return F.greatest(F.lit(0), F.least(part["high"], begin + F.col("size")) - F.greatest(part["low"], begin))

        words = sum((in_pass(k) for k in range(1, most_passes)), in_pass(0))
        return F.struct(part["shard"].alias("shard"), words.cast("bigint").alias("words"))

    return F.filter(F.transform("__cw_parts", taken), lambda p: p["words"] > 0)


def mixed(
    docs: DataFrame,
    seed: str = "mixture",
    block_words: int = BLOCK_WORDS,
    n_shards: int = 8,
    weights: tuple[int, ...] = WEIGHTS,
    most_passes: int = MOST_PASSES,
    n_buckets: int | None = None,
    size: Column | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target, taken (words the mix takes of the row, repeats
    counted) and shards (array of shard, words: which shards take how many of them)."""
    if n_buckets is None:
        n_buckets = bucket_count(docs.count())
    rows = without(docs, *OUTPUTS).withColumns(
        {
            "__cw_stratum": stratum_key(F.col("source")),
            # The text too, so that rows without an id of their own are spread as well.
            "__cw_key": seeded_key(seed, F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")))),
            "size": word_count(F.col("text")) if size is None else size,
        }
    )
    sizes = rows.groupBy("__cw_stratum").agg(F.sum("size").alias("__cw_words"))
    plan = source_plan(sizes, block_words, n_shards, weights, most_passes)
    laid = laid_end_to_end(rows, "__cw_stratum", "__cw_key", ["doc_id", "size"], "size", n_buckets, plan)
    out = laid.withColumns({"source_size": F.col("__cw_total"), "target": F.col("__cw_target"), "shards": words_by_shard(most_passes)})
    out = out.withColumn("taken", F.aggregate("shards", F.lit(0).cast("bigint"), lambda n, p: n + p["words"]))
    return out.drop(*[c for c in out.columns if c.startswith("__cw_")])


def materialised(mix: DataFrame) -> DataFrame:
    """One row for each time a document is in the mix.

    A document that a source's last block cuts (one a source at most) is kept whole if at least
    half of it is taken. Documents without words take no part in a mix of words and stay once.
    """
    copies = F.when(F.col("size") == 0, 1).otherwise(F.expr("(2 * taken + size) div (2 * size)"))
    repeated = mix.withColumn("__cw_copy", F.explode(F.array_repeat(F.lit(True), copies.cast("int"))))
    return repeated.drop("__cw_copy", *OUTPUTS)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    listed = F.array_join(F.transform("shards", lambda p: F.concat_ws(":", p["shard"].cast("string"), p["words"].cast("string"))), ",")
    return mixed(slim).select("doc_id", "size", "source_size", "target", "taken", listed.alias("shards"))
