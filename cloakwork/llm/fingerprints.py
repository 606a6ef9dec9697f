"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every shingle hash below a fixed fraction of the hash range, so its size
follows the document's, sketches of parts merge by union, and containment can be estimated
between documents of very unequal length. A text of at most SHORT shingles would leave few hashes or
none, so it retains all of them: a sketch names its scale (1 or SCALE; the fraction is 1 / scale), and
two sketches are compared, and merged, at the coarser of their scales, to which the finer one is
cut by the same threshold. Shingles are five words; a text of fewer words is one shingle.

Defined results: null counts as empty; texts without words have an empty sketch, and two equal
sketches are alike (1); a sketch that has nothing at the common scale is unlike any other (0): against a
long text, that befalls a short one of n shingles with a chance of (1 - 1 / SCALE) ** n. Rows with
equal doc_id are ordered by the hash of their text; a null doc_id comes last; a single row is its
own next document.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import split_words, table, without

SHINGLE = 5
SCALE = 4
#: A text of at most so many shingles keeps all of their hashes.
SHORT = 64
HASH_BITS = 40
SKETCH = "struct<scale:int,hashes:array<bigint>>"
GAP = r"[\x20\x09-\x0D]+"
#: Ranges of rows for the next document. Their boundaries are literals; at the most, 20 billion rows
#: come to some 300,000 a range, which sort and spill.
MOST_RANGES = 1 << 16
ROWS_A_RANGE = 2000
OUTPUTS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE, short: int = SHORT) -> Column:
    """(scale, hashes): the sorted distinct leading 40 bits of the retained shingle hashes."""
    words = split_words(text, GAP)

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - shingle + 1, F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, shingle)), 64 - HASH_BITS))
        )

    def retained(h: Column) -> Column:
        own = F.when(F.size(h) <= short, 1).otherwise(scale)
        return _sketch(own, F.when(F.size(h) <= short, h).otherwise(F.filter(h, lambda x: x < (1 << HASH_BITS) // scale)))

    return _let(_let(words, hashes), retained)


def _sketch(scale: Column, hashes: Column) -> Column:
    return F.struct(scale.cast("int").alias("scale"), F.array_sort(F.array_distinct(hashes)).alias("hashes"))


def at_scale(one: Column, scale: Column) -> Column:
    """The hashes of a sketch below the threshold of a coarser ``scale``."""
    return F.when(one["scale"] == scale, one["hashes"]).otherwise(F.filter(one["hashes"], lambda x: x * scale < 1 << HASH_BITS))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(one: Column) -> Column:
    """The sketch as text: its scale, and ten hex digits a hash."""
    digits = F.array_join(F.transform(one["hashes"], lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")
    return F.concat_ws(":", one["scale"].cast("string"), digits)


def merged(one: Column, other: Column) -> Column:
    """The sketch of both texts' shingles together, at the coarser scale."""
    scale = F.greatest(one["scale"], other["scale"])
    return _let(scale, lambda s: _sketch(s, F.concat(at_scale(one, s), at_scale(other, s))))


def containment(one: Column, other: Column) -> Column:
    """Estimated share of the smaller document's shingles that the other has."""

    def share(both: Column) -> Column:
        smaller = F.least(F.size(both["a"]), F.size(both["b"]))
        part = F.size(F.array_intersect(both["a"], both["b"])) / F.greatest(smaller, F.lit(1))
        return F.when(one == other, 1.0).when(smaller == 0, 0.0).otherwise(part).cast("double")

    scale = F.greatest(one["scale"], other["scale"])
    return _let(F.struct(at_scale(one, scale).alias("a"), at_scale(other, scale).alias("b")), share)


def ranges(docs: DataFrame, id_col: str, n_rows: int) -> tuple[list[tuple[int, int]], int]:
    """Boundaries (id, tie) that cut the rows into ranges of about equally many, and the number of
    ranges of rows without an id. An id that holds several ranges' rows is cut by the tie."""
    n = max(1, min(MOST_RANGES, n_rows // ROWS_A_RANGE))
    cuts = [i / n for i in range(1, n)] or [0.5]
    found = docs.agg(F.percentile_approx(F.col(id_col), cuts, max(10000, 5 * n)).alias("b"), F.count_if(F.col(id_col).isNull()).alias("nulls")).first()
    boundaries = []
    for value, same in groupby(sorted(found["b"] or [])) if n > 1 else ():
        m = len(list(same))
        boundaries += [(value, -(2**63) + 2**64 * j // m) for j in range(m)]
    return boundaries, max(1, min(MOST_RANGES, found["nulls"] // ROWS_A_RANGE))


def range_of(value: Column, tie: Column, boundaries: list[tuple[int, int]], n_null: int) -> Column:
    """How many boundaries are at or below (value, tie), by binary search; below 0 where ``value`` is
    null, by the tie alone."""
    without_id = F.least(F.floor((tie.cast("double") / 2.0**64 + 0.5) * n_null), F.lit(n_null - 1)).cast("int") - n_null
    if not boundaries:
        return F.when(value.isNull(), without_id).otherwise(0)
    steps = 1 << (len(boundaries).bit_length() - 1)
    ids, ties = F.lit([b[0] for b in boundaries]), F.lit([b[1] for b in boundaries])
    halves = [steps >> i for i in range(steps.bit_length())]

    def step(at: Column, half: Column) -> Column:
        last = at + half - 1
        reached = (F.get(ids, last) < value) | ((F.get(ids, last) == value) & (F.get(ties, last) <= tie))
        return F.when(F.coalesce((at + half <= len(boundaries)) & reached, F.lit(False)), at + half).otherwise(at)

    return F.when(value.isNull(), without_id).otherwise(F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step))


def with_next(docs: DataFrame, id_col: str, keep: list[str], n_rows: int) -> DataFrame:
    """``docs`` with ``next_<c>`` for each ``c`` of ``keep``, taken from the next row by
    descending id (after the last, the first).

    Rows are dealt by ranges of the id, and of the text's hash where many share or lack one. The first row of each range also goes, as a guest, to
    the range before it, so that the lead within a range never needs its neighbour: one exchange
    of the rows and a handful of rows twice. Only ids and hashes are gathered to find these.
    """
    boundaries, n_null = ranges(docs, id_col, n_rows)
    rows = docs.withColumn("__cw_range", range_of(F.col(id_col), F.col("__cw_tie"), boundaries, n_null))
    order = F.struct(F.col(id_col).isNotNull(), F.coalesce(F.col(id_col), F.lit(0)), F.col("__cw_tie"))
    heads = rows.groupBy("__cw_range").agg(F.max(order).alias("__cw_head"), F.first(F.lit(True)).alias("__cw_some"))
    around = Window.partitionBy(F.lit(0)).orderBy(F.col("__cw_range").desc())  # a row a range
    whole = Window.partitionBy(F.lit(0))
    to = F.coalesce(F.lag("__cw_range").over(around), F.min("__cw_range").over(whole))
    heads = heads.select(F.col("__cw_range").alias("__cw_from"), "__cw_head", to.alias("__cw_to"))
    guests = rows.join(F.broadcast(heads), (F.col("__cw_range") == F.col("__cw_from")) & (order == F.col("__cw_head")))
    guests = guests.withColumn("__cw_range", F.col("__cw_to")).select(*rows.columns)
    both = rows.withColumn("__cw_guest", F.lit(False)).unionByName(guests.withColumn("__cw_guest", F.lit(True)))
    down = Window.partitionBy("__cw_range").orderBy(
        "__cw_guest", F.col(id_col).desc_nulls_last(), F.col("__cw_tie").desc()
    )
    leads = {f"next_{c}": F.lead(c).over(down) for c in keep}
    return both.withColumns(leads).where(~F.col("__cw_guest")).drop("__cw_guest", "__cw_range")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_rows: int | None = None) -> DataFrame:
    """``docs`` with the columns of the contract: each text, its edit and the next document."""
    n_rows = docs.count() if n_rows is None else n_rows
    rows = without(docs, *OUTPUTS).withColumns(
        {"__cw_text": F.coalesce(F.col(text_col), F.lit("")), "__cw_tie": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}
    )
    rows = rows.withColumn("__cw_sketch", sketch(F.col("__cw_text")))
    paired = with_next(rows, id_col, ["__cw_text", "__cw_sketch"], n_rows)
    n_chars = F.char_length("__cw_text")
    cut = F.expr("char_length(__cw_text) div 3").cast("int")
    edited = F.concat(F.substring(F.col("__cw_text"), F.lit(1), n_chars - cut), F.substring(F.col("next___cw_text"), F.lit(1), cut))
    paired = paired.withColumns({"n_chars": n_chars.cast("bigint"), "__cw_edited": edited})
    paired = paired.withColumn("__cw_edited_sketch", sketch(F.col("__cw_edited")))
    out = paired.withColumns(
        {
            "edited_sha256": F.sha2("__cw_edited", 256),
            "fingerprint": fingerprint(F.col("__cw_sketch")),
            "edited_fingerprint": fingerprint(F.col("__cw_edited_sketch")),
            "near_edited": containment(F.col("__cw_sketch"), F.col("__cw_edited_sketch")),
            "near_next": containment(F.col("__cw_sketch"), F.col("next___cw_sketch")),
        }
    )
    return out.drop("next___cw_text", "next___cw_sketch", *[c for c in out.columns if c.startswith("__cw_")])


def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprinted(docs).select("doc_id", *OUTPUTS)
