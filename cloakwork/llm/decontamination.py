"""Benchmark decontamination with a positional inverted index of the training words.

The index is a stored table of postings (row, word, position) of every word of the benchmark; each
text is cut into words once, for it. A window is 10 consecutive words of a benchmark item (all
words of a shorter one). A posting shifted back by a word's place in a window is a start; a phrase
stands where the shifted lists of all its words have a start in common. Lists are intersected from
the rarest on:

1. the postings of the rarest word give starts;
2. those of the next rarest, as far as a bitmap of the starts found lets them pass, confirm them;
3. at what is left, a handful beyond the real occurrences, the lists of all other words are read.

A proximity match tolerates altered, missing and inserted words: of a tile's places (a tile is one
of the runs of 10 words that an item falls into) at least LEAST have a start in a range of SLOP + 1.
It lacks at most a fifth of the places, so it holds one of as many of the rarest and one more, and
two of these and the next: the same three steps find every match. A tile that stands there word by word has
a share of 1; shorter tiles than a window must be complete, but for their order within SLOP.

Nothing is keyed by a word alone: rows of the index have their own number, and where the benchmark
outgrows BROADCAST_BYTES, as measured, joins by word are salted by that number.

Defined results: null or wordless text has no words and no hits; rows with equal doc_id are judged
each by its own text; equal items all count; null item_ids are one item, written ``null``; items without
words have no window; an empty benchmark leaves every document clean; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.functions.lineage import stored
from cloakwork.llm.common import WORD_GAP, ascii_lower, possibly_in, split_words, table, without

WINDOW = 10
#: A broadcast table of the benchmark takes at most so much of every executor.
BROADCAST_BYTES = 64 << 20
#: Bytes of a joined row in memory, besides its strings.
ROW_BYTES = 64
SALTS = 32
#: A proximity match holds at least this share of a tile's places, with starts in a range of SLOP + 1.
SLOP, LEAST = 3, 0.8
#: Positions by block, so that a range of them is looked up by equality.
BLOCK = 64
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OUTPUTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
NEAR_OUTPUTS = ("near_share", "n_near_items", "near_items_sha256", "near_contaminated")


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), WORD_GAP)


class Search(NamedTuple):
    """Windows (window, near, words), exact ones and tiles, and their items (window, item)."""

    windows: DataFrame
    items: DataFrame


def lacks(near: Column, n: Column) -> Column:
    """How many of a window's ``n`` places a match may lack: none, but in a whole tile."""
    return F.when(near & (n >= WINDOW), n - F.ceil(n * LEAST - 1e-9).cast("int")).otherwise(0)


def slop(near: Column) -> Column:
    return F.when(near, SLOP).otherwise(0)


def search(benchmark: DataFrame, near: bool, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Search:
    """All windows, for exact matches, and if ``near`` the tiles; equal ones are one, with a number of its own."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    items = benchmark.select(name.alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.lit(1), F.size("all") - window + 1)

    def cut(starts: Column, near: bool) -> DataFrame:
        each = items.select("item", "all", F.explode(starts).alias("at"))
        return each.select("item", F.lit(near).alias("near"), F.slice("all", F.col("at"), window).alias("words"))

    pieces = cut(F.sequence(F.lit(1), last), False)
    if near:
        tiles = F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(window)), lambda at: F.least(at, last))
        pieces = pieces.unionByName(cut(F.array_distinct(tiles), True))
    windows = stored(pieces.select("near", "words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return Search(windows, stored(pieces.join(windows, ["near", "words"]).select("window", "item").distinct(), "window-items"))


def vocabulary_of(windows: DataFrame) -> DataFrame:
    """(word, term): every word of a window, with a number."""
    words = windows.select(F.explode("words").alias("word")).distinct()
    return stored(words.withColumn("term", F.monotonically_increasing_id()), "vocabulary")


def joined(rows: DataFrame, few: DataFrame, key: str, n_few: int) -> DataFrame:
    """``rows`` (with ``row``) joined by ``key`` to ``few``: broadcast if that is small, as counted,
    else shuffled, with the rows of a common key dealt over SALTS tasks."""
    if n_few * ROW_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(few), key)
    dealt = few.withColumn("__cw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    return possibly_in(rows, key, few.select(key).distinct()).withColumn("__cw_salt", salt).join(dealt, [key, "__cw_salt"]).drop("__cw_salt")


def indexed(docs: DataFrame, vocabulary: DataFrame, own: dict[str, Column], text_col: str) -> DataFrame:
    """The stored index: (row, term, position), and a document's own columns at its first word.

    ``row`` numbers the rows of ``docs`` within the write, which is read again and never repeated.
    Rows without words have one entry without a position.
    """
    n = F.size("__cw_words")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), words_of(F.col(text_col)).alias("__cw_words"), *[c.alias(k) for k, c in own.items()])
    each = rows.select("row", n.cast("bigint").alias("n_words"), *own, F.posexplode_outer("__cw_words").alias("position", "word"))
    head = F.coalesce(F.col("position"), F.lit(0)) == 0
    each = each.withColumns({c: F.when(head, F.col(c)) for c in ("n_words", *own)}).withColumn("head", head)
    size = vocabulary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("b")).first()
    if size["n"] * ROW_BYTES + size["b"] <= BROADCAST_BYTES:
        known = each.join(F.broadcast(vocabulary), "word", "left")
    else:
        # A bitmap of the vocabulary spares most other words the shuffle; first words go along.
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
        dealt = vocabulary.withColumn("__cw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        firsts = each.where("head").withColumn("term", F.lit(None).cast("bigint"))
        found = possibly_in(each, "word", vocabulary.select("word")).withColumn("__cw_salt", salt).join(dealt, ["word", "__cw_salt"])
        found = found.withColumns({c: F.lit(None).cast(each.schema[c].dataType) for c in ("n_words", *own)}).withColumn("head", F.lit(False))
        known = found.select(*each.columns, "term").unionByName(firsts.select(*each.columns, "term"))
    return stored(known.where(F.col("term").isNotNull() | F.col("head")).drop("word"), "postings")


def ranked_terms(windows: DataFrame, vocabulary: DataFrame, freq: DataFrame) -> DataFrame:
    """(window, near, n, place, term, rank): the rarest word of a window has rank 0."""
    places = windows.select("window", "near", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))
    known = places.join(vocabulary, "word").join(freq, "term", "left")
    rarest_first = Window.partitionBy("window").orderBy(F.coalesce("freq", F.lit(0)), "place")
    return stored(known.select("window", "near", "n", "place", "term", (F.row_number().over(rarest_first) - 1).alias("rank")), "terms")


def starts_at(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, window, near, n, start): where a window would start by the postings of some of its words."""
    found = joined(lists, terms.select("term", "window", "near", "n", "place"), "term", terms.count())
    return found.select("row", "window", "near", "n", (F.col("position") - F.col("place")).alias("start"))


def possible_starts(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, window, start): starts that the rarest words' lists leave."""
    may_lack = lacks(F.col("near"), F.col("n"))
    first = stored(starts_at(lists, terms.where(F.col("rank") <= may_lack)), "starts")
    both = F.xxhash64("row", "window")
    second = starts_at(lists, terms.where(F.col("rank") == may_lack + 1)).withColumn("__cw_pair", both)
    second = possibly_in(second, "__cw_pair", first.select(both.alias("__cw_wanted"))).drop("__cw_pair")
    along = Window.partitionBy("row", "window").orderBy("start")
    before, after = F.col("start") - F.lag("start").over(along), F.lead("start").over(along) - F.col("start")
    beside = F.least(before, after) <= slop(F.col("near"))  # nulls are no neighbours
    near = first.unionByName(second).withColumn("beside", beside).where(F.coalesce("beside", F.lit(False)) | (F.col("n") == 1))
    return near.select("row", "window", "start").distinct()


def matches(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, window, near, start, n, share): every match by its first start; share is of the window's places."""
    possible = stored(possible_starts(lists, terms), "possible")
    wanted = possible.join(terms.select("window", "near", "n", "place", "term"), "window")
    low, high = (F.col("start") + F.col("place") + sign * slop(F.col("near")) for sign in (-1, 1))
    blocks = F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))
    wanted = wanted.select("row", "window", "near", "n", "place", "term", low.alias("low"), high.alias("high"), F.explode(blocks).alias("block"))
    # Of the lists, only the blocks that some start asks for go on.
    place = F.xxhash64("row", "term", "block")
    there = lists.withColumn("block", F.floor(F.col("position") / BLOCK)).withColumn("__cw_place", place)
    there = possibly_in(there, "__cw_place", wanted.select(place.alias("__cw_wanted"))).drop("__cw_place")
    found = there.join(wanted, ["row", "term", "block"]).where(F.col("position").between(F.col("low"), F.col("high")))
    found = found.select("row", "window", "near", "n", "place", "position", (F.col("position") - F.col("place")).alias("start")).distinct()
    found, by = stored(found, "found"), ["row", "window", "near", "start", "n"]
    exact = found.where(~F.col("near")).groupBy(*by).agg(F.count("*").alias("held"))
    reach = Window.partitionBy("row", "window").orderBy("start").rangeBetween(0, SLOP)
    # One word of the document stands for one place alone.
    held = F.least(*(F.size(F.collect_set(c).over(reach)) for c in ("place", "position")))
    close = found.where("near").withColumn("held", held).groupBy(*by).agg(F.max("held").alias("held"))
    enough = F.col("held").cast("bigint") >= F.col("n") - lacks(F.col("near"), F.col("n"))
    both = exact.unionByName(close.withColumn("held", F.col("held").cast("bigint")))
    return both.where(enough).withColumn("share", F.col("held") / F.col("n"))


def items_by_row(found: DataFrame, items: DataFrame, name: str) -> DataFrame:
    each = found.select("row", "window").distinct().join(items, "window").select("row", "item")
    return each.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias(name))


def hits_by_row(found: DataFrame, items: DataFrame) -> DataFrame:
    """(row, n_hit, items) of exact matches: n_hit counts the words inside any of them."""
    spans = found.select("row", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    so_far = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(so_far), F.lit(0))))
    counts = spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    return counts.join(items_by_row(found, items, "items"), "row")


def judged_rows(docs: DataFrame, benchmark: DataFrame, own: dict[str, Column], text_col: str = "text", near: bool = True) -> tuple[DataFrame, DataFrame]:
    """The index' heads (row, own..., n_words) and the hits (row, n_hit, items, near_items,
    near_share) of rows that have any, stored."""
    windows, items = search(benchmark, near)
    vocabulary = vocabulary_of(windows)
    index = indexed(docs, vocabulary, own, text_col)
    lists = index.where(F.col("term").isNotNull()).select("row", "term", "position")
    freq = stored(lists.groupBy("term").agg(F.count("*").alias("freq")), "frequencies")
    found = stored(matches(lists, ranked_terms(windows, vocabulary, freq)), "matches")
    hits = hits_by_row(found.where(~F.col("near")), items)
    close = found.where("near")
    shares = close.groupBy("row").agg(F.max("share").alias("near_share"))
    hits = hits.join(shares.join(items_by_row(close, items, "near_items"), "row"), "row", "full_outer")
    return index.where("head").select("row", "n_words", *own), stored(hits, "hits")


def _named(rows: DataFrame, near: bool) -> DataFrame:
    """The output columns from n_words and __cw_hits."""

    def listed(name: str) -> Column:
        return F.coalesce(F.col(f"__cw_hits.{name}"), F.array().cast("array<string>"))

    n_hit = F.coalesce(F.col("__cw_hits.n_hit"), F.lit(0)).cast("bigint")
    outputs = {
        "n_hit": n_hit,
        "n_items": F.size(listed("items")).cast("bigint"),
        "items_sha256": F.sha2(F.array_join(listed("items"), ","), 256),
        "contaminated": n_hit > 0,
    }
    if near:
        outputs |= {
            "near_share": F.coalesce(F.col("__cw_hits.near_share"), F.lit(0.0)),
            "n_near_items": F.size(listed("near_items")).cast("bigint"),
            "near_items_sha256": F.sha2(F.array_join(listed("near_items"), ","), 256),
            "near_contaminated": F.size(listed("near_items")) > 0,
        }
    return rows.withColumns(outputs)


def identity(id_col: str, text_col: str) -> dict[str, Column]:
    """What a row of the table is known by: its id and its text."""
    return {"__cw_id": F.col(id_col), "__cw_text": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}


def hits_by_identity(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, near: bool) -> DataFrame:
    """(__cw_id, __cw_text, __cw_hits) of documents with hits, one of equal rows; stored."""
    heads, hits = judged_rows(docs, benchmark, identity(id_col, text_col), text_col, near)
    rows = heads.join(hits, "row").select("__cw_id", "__cw_text", F.struct("n_hit", "items", "near_items", "near_share").alias("__cw_hits"))
    return stored(rows.dropDuplicates(["__cw_id", "__cw_text"]), "hits-by-document")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = True
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated, by exact occurrences;
    if ``near``, also the largest share, the items and whether there are any by proximity matches."""
    hits = hits_by_identity(docs, benchmark, id_col, text_col, near)
    outputs = OUTPUTS + (NEAR_OUTPUTS if near else ())
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    named = {f"{k}_own": c for k, c in identity(id_col, text_col).items()}
    rows = docs.withColumns(named | {"__cw_n_words": n_words})
    judged = _named(without(_with_hits(rows, hits, "left"), *outputs).withColumnRenamed("__cw_n_words", "n_words"), near)
    return judged.drop(*[c for c in judged.columns if c.startswith("__cw_")])


def _with_hits(rows: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    same = F.col("__cw_id_own").eqNullSafe(F.col("__cw_id")) & (F.col("__cw_text_own") == F.col("__cw_text"))
    return rows.join(hits, same, how)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = True) -> DataFrame:
    """The rows of ``docs`` without any match.

    The hits are a stored table of a few columns: Spark broadcasts it if its files are small."""
    hits = hits_by_identity(docs, benchmark, id_col, text_col, near).select("__cw_id", "__cw_text")
    rows = docs.withColumns({f"{k}_own": c for k, c in identity(id_col, text_col).items()})
    return _with_hits(rows, hits, "left_anti").drop("__cw_id_own", "__cw_text_own")


def op7_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of the index with their hits: no second look at the texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    heads, hits = judged_rows(docs, table(spark, sf_dir, "benchmark"), {"doc_id": F.col("doc_id")})
    packed = hits.select("row", F.struct("n_hit", "items", "near_items", "near_share").alias("__cw_hits"))
    return _named(heads.join(packed, "row", "left"), True).select("doc_id", *OUTPUTS, *NEAR_OUTPUTS)
