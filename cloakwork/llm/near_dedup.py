"""Near-duplicate detection with HyperMinHash registers, verified on full shingle sets.

1. Each text's distinct word shingles (five words unless asked otherwise) are hashed; of every one of 256 buckets the least hash
   is stored as a register of its leading-zero count and ten bits of mantissa. Texts with equal
   sets (a 128-bit digest) form a class, and only classes go on, so exact copies cost nothing.
2. Registers, empty ones filled from others in a fixed order, are hashed in BANDS bands of
   ROWS. Two sets of Jaccard 0.8 share no band with a chance of about 1e-7.
3. In each band bucket the members are linked to one of them, the pivot: the one that shares
   most buckets over all bands. A pair goes on if the Jaccard that its registers estimate,
   corrected for chance collisions, is within five standard deviations of the threshold, and
   is confirmed on the full sets.
4. Connected components of the confirmed links. Where members around one pivot are still in
   several components, pairs between components are formed by a prefix filter with places:
   exact, so it loses no link between different texts, and it forms no pairs of copies that
   each have words enough of their own. These pairs are tested alike.

Joins by a set's digest, which many copies share, broadcast the few digests that hold many rows. A
pivot with many links meets them in joins that adaptive execution splits.

Defined results: null, empty and wordless texts have 0 shingles, link with nothing and are kept.
``grouped``: rows that share a doc_id are judged by their own text, and ``kept`` compares ids: true for
a null doc_id only where its whole component has none. ``deduplicated`` keeps one row of each group, also
of repeated rows and of rows that share or lack an id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.functions.lineage import settle, stored
from cloakwork.llm.common import joined_by_key, possibly_in, table, without
from cloakwork.llm.textbytes import BASE, TO_LOWER, blocks, mixed, shingles, words

SHINGLE = 5  # words, by default
PERCENT = 80
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BANDS, ROWS = 40, 5
WORD = r"[^\x20\x09-\x0D]"
OUTPUTS = ("n_shingles", "component_id", "kept")
#: Expected collisions of registers by chance, from the HyperMinHash paper, for equal sizes.
COLLISIONS = 0.169919487159739093975315012348 * 2 ** (BUCKET_BITS - MANTISSA_BITS)


def registers(hashes: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows, 256) registers: (leading zeros + 1) << 10 | mantissa; 0 is an empty bucket.

    ``hashes`` are sorted within their row, so the first of a bucket is its least.
    """
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cell = row * (1 << BUCKET_BITS) + bucket
    least = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    rest = (hashes[least] << np.uint64(BUCKET_BITS)) >> np.uint64(12)  # 52 bits
    zeros = 52 - np.frexp(rest.astype(np.float64))[1]
    mantissa = ((rest << zeros.astype(np.uint64)) >> np.uint64(51 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    out = np.zeros(n_rows << BUCKET_BITS, np.uint16)
    out[cell[least]] = ((zeros + 1) << MANTISSA_BITS).astype(np.uint16) | mantissa.astype(np.uint16)
    return out.reshape(n_rows, -1)


def filled(regs: np.ndarray) -> np.ndarray:
    """Empty registers take the first non-empty one in an order of their own, alike for all."""
    n = regs.shape[1]
    orders = np.random.default_rng(11).permuted(np.tile(np.arange(n), (n, 1)), axis=1)
    out = regs.copy()
    rows, cells = np.nonzero((regs == 0) & (regs != 0).any(axis=1)[:, None])
    for attempt in range(n):
        if not len(rows):
            break
        lent = regs[rows, orders[cells, attempt]]
        out[rows, cells] = lent
        rows, cells = rows[lent == 0], cells[lent == 0]
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """(n_rows, BANDS) hashes of ROWS registers each."""
    chosen = np.random.default_rng(12).permutation(regs.shape[1])[: BANDS * ROWS].reshape(BANDS, ROWS)
    dense = filled(regs).astype(np.uint64)
    out = np.tile(mixed(np.arange(BANDS, dtype=np.uint64), 3), (len(regs), 1))
    for k in range(ROWS):
        out = mixed(out * np.uint64(BASE) + dense[:, chosen[:, k]], 4)
    return out.view(np.int64)


def estimated_jaccard(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates from rows of registers, and how many buckets each rests on."""
    used = ((one != 0) | (other != 0)).sum(axis=1)
    equal = ((one == other) & (one != 0)).sum(axis=1)
    unlike = 4 * n_one * n_other / np.maximum((n_one + n_other) ** 2, 1)
    chance = COLLISIONS * unlike * used / BUCKETS
    return np.maximum(equal - chance, 0) / np.maximum(used, 1), used


def set_digests(hashes: np.ndarray, row: np.ndarray, n_rows: int) -> list[bytes]:
    """128 bits for the set of each row: wrapped sums of two mixes of its hashes."""
    out = np.zeros((n_rows, 2), np.uint64)
    with_any = np.unique(row)
    if len(with_any):
        firsts = np.searchsorted(row, with_any)
        for k in (0, 1):
            out[with_any, k] = np.add.reduceat(mixed(hashes, 5 + k), firsts)
    return [x.tobytes() for x in out]


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, text_key, n_shingles, node, bands) of each row; ``node`` is the digest of its set."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            ids, keys_of_texts, texts = batch.columns
            for first, past, data, bounds in blocks(texts):
                n = past - first
                hashes, row, _ = words(TO_LOWER[data], bounds)
                hashes, row = shingles(hashes, row, n, size)
                keys = bands(registers(hashes, row, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, n),
                        keys_of_texts.slice(first, n),
                        pa.array(np.bincount(row, minlength=n)),
                        pa.array(set_digests(hashes, row, n), pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel()),
                    ],
                    ["id", "text_key", "n_shingles", "node", "bands"],
                )

    schema = f"id {id_type}, text_key bigint, n_shingles bigint, node binary, bands array<bigint>"
    return docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)).mapInArrow(sketch, schema)


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the registers' estimate does not rule out."""

    def keep(batches):
        for batch in batches:
            one, other = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("regs_a", "regs_b")
            )
            sizes = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            estimate, used = estimated_jaccard(one, other, *sizes)
            slack = 5 * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / np.maximum(used, 1))
            yield batch.select(["a", "b"]).filter(pa.array(estimate >= PERCENT / 100 - slack))

    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("regs").alias("regs_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("regs").alias("regs_b"))
    sized = (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return pairs.join(a, "a").join(b, "b").where(sized).mapInArrow(keep, "a binary, b binary")


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for first, past, data, bounds in blocks(texts):
        hashes, row, _ = words(TO_LOWER[data], bounds)
        hashes, row = shingles(hashes, row, past - first, size)
        yield from np.split(hashes, np.searchsorted(row, np.arange(1, past - first)))


def confirmed(pairs: DataFrame, nodes: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have the Jaccard similarity asked for."""

    def keep(batches):
        for batch in batches:
            linked = []
            for one, other in zip(*(shingle_sets(batch.column(c), size) for c in ("text_a", "text_b")), strict=True):
                both = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(one) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    a = nodes.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(keep, "a binary, b binary")


def least_overlap(n: int) -> int:
    """What a set of ``n`` shares at least with any set that is that similar to it."""
    return -(-PERCENT * n // 100)


def leading(own: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, int]:
    """The hashes of a set that its pivot lacks, and if these are fewer than its prefix has, the
    first of the others; and how many the pivot lacks."""
    shared = np.isin(own, pivot, assume_unique=True)
    apart = own[~shared]
    more = max(0, len(own) - least_overlap(len(own)) + 1 - len(apart))
    others = np.sort(own[shared].view(np.int64))[:more]  # in the order of SQL, which is signed
    return np.concatenate([apart.view(np.int64), others]), len(apart)


def leading_tokens(edges: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(pivot, node, token, late): by pivot, the hashes that can be in a node's prefix."""

    def extract(batches):
        for batch in batches:
            found = [leading(one, other) for one, other in zip(*(shingle_sets(batch.column(c), size) for c in ("text_a", "text_b")), strict=True)]
            sizes = [len(x) for x, _ in found]
            at = pa.array(np.repeat(np.arange(len(found)), sizes))
            tokens = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            late = np.concatenate([np.arange(len(x)) >= n for x, n in found]) if found else np.zeros(0, bool)
            columns = [batch.column("pivot").take(at), batch.column("node").take(at), pa.array(tokens), pa.array(late)]
            yield pa.RecordBatch.from_arrays(columns, ["pivot", "node", "token", "late"])

    a = nodes.select("node", F.col("text").alias("text_a"))
    b = nodes.select(F.col("node").alias("pivot"), F.col("text").alias("text_b"))
    return edges.join(a, "node").join(b, "pivot").mapInArrow(extract, "pivot binary, node binary, token bigint, late boolean")


def open_pairs(edges: DataFrame, labels: DataFrame, nodes: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) around one pivot, in different components, that a prefix filter lets pass.

    All that share a bucket share its pivot. Hashes are put in one order by pivot: those that the
    pivot lacks, rare ones first, then the others. Two sets that are that similar share a hash
    among their prefixes, and the places of the first one that they share leave room for the
    overlap they need. Copies that each have their own ninth or more of other words don't pass.
    """
    placed = settle(edges.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")))
    by_pivot = placed.groupBy("pivot").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n_rows"))
    mixed_pivots = settle(by_pivot.where("low <> high").select("pivot", "n_rows"))
    # The pivots of many members are broadcast.
    around = joined_by_key(placed, mixed_pivots, "pivot", placed.count(), "n_rows", F.xxhash64("node")).where("__cw_side is not null")
    # The pivot itself was tested against all of its members.
    still_open = settle(around.where(F.col("node") != F.col("pivot")).select("pivot", "node", "root"))
    tokens = settle(leading_tokens(still_open.select("pivot", "node"), nodes, size))
    rarity = tokens.groupBy("pivot", "token").agg(F.count("*").alias("freq"))
    # A node has only the first of its late hashes here, so these go by themselves, not by rarity.
    order = Window.partitionBy("pivot", "node").orderBy("late", F.when(~F.col("late"), F.col("freq")), "token")
    ranked = tokens.join(rarity, ["pivot", "token"]).withColumn("place", F.row_number().over(order) - 1)
    known = still_open.select("pivot", "node", "root").join(nodes.select("node", "n_shingles"), "node")
    in_prefix = F.col("place") <= F.col("n_shingles") - F.ceil(F.col("n_shingles") * PERCENT / 100)
    rows = settle(ranked.where("freq > 1").join(known, ["pivot", "node"]).where(in_prefix).drop("late", "freq"))
    crowd = rows.groupBy("pivot", "token", "root").agg(F.count("*").alias("crowd"))
    largest = crowd.groupBy("pivot", "token").agg(F.max(F.struct("crowd", "root"))["root"].alias("largest"), F.count("*").alias("roots"))
    shared = rows.join(largest.where("roots > 1").drop("roots"), ["pivot", "token"])

    def side(name: str) -> list:
        return [F.col(c).alias(f"{c}_{name}") for c in ("node", "root", "n_shingles", "place")]

    # One of a pair is outside of the token's largest component.
    x = shared.where(F.col("root") != F.col("largest")).select("pivot", "token", *side("x"))
    y = shared.select("pivot", "token", *side("y"))
    room = F.least(F.col("n_shingles_x") - F.col("place_x"), F.col("n_shingles_y") - F.col("place_y"))
    enough = (100 + PERCENT) * room >= PERCENT * (F.col("n_shingles_x") + F.col("n_shingles_y"))
    pairs = x.join(y, ["pivot", "token"]).where((F.col("root_x") != F.col("root_y")) & enough)
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link: least label of the neighbours, then of the label's
    own label, until nothing changes; the rounds grow with the logarithm of the longest chain.

    Rounds are cut by written tables: a checkpoint keeps the planner's estimate of sizes, which joins multiply,
    so that its digits triple with every round. Files of digests may be larger in memory, so none is broadcast."""

    def cut(rows: DataFrame) -> DataFrame:
        return stored(rows, "links").hint("merge")

    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        lent = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("lent")), "b")
        least = lent.groupBy(F.col("a").alias("node")).agg(F.min("lent").alias("lent"))
        lower = labels.join(least, "node").select("node", F.col("root").alias("was"), F.least("root", "lent").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = cut(lower.join(up, "root", "left").select("node", F.least("root", "above").alias("root"), "was"))
        changed = not after.where(F.col("root") != F.col("was")).isEmpty()
        labels = after.select("node", "root")
        if not changed:
            return labels


def placed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, text_key, n_shingles, node, root, component_id), a row for each of ``docs``: ``root`` names
    a component, and is null for rows without words."""
    rows = settle(sketches(docs, id_col, text_col, size))
    wordy = rows.where(F.col("n_shingles") > 0)
    classes = settle(wordy.groupBy("node").agg(F.min("id").alias("least_id"), F.count("*").alias("n_rows")))
    firsts = classes.join(wordy, (classes["node"] == wordy["node"]) & classes["least_id"].eqNullSafe(wordy["id"]))
    keyed = firsts.select(classes["node"], F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    # A repeated (id, text) repeats its class here; distinct leaves one.
    members = settle(keyed.join(crowded, "key").distinct())
    reach = members.groupBy("node").agg(F.sum("crowd").alias("reach"))
    needed = settle(reach.join(classes.drop("n_rows"), "node"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = possibly_in(texts, "id", needed.select("least_id"))
    nodes = settle(of_the_class(needed.join(texts, F.col("least_id").eqNullSafe(F.col("id"))), size))

    pivots = members.join(needed.select("node", "reach"), "node").groupBy("key").agg(F.max(F.struct("reach", "node"))["node"].alias("pivot"))
    edges = settle(members.join(pivots, "key").select("node", "pivot").distinct())
    stars = edges.where(F.col("node") != F.col("pivot"))
    stars = stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = settle(confirmed(plausible(stars, nodes), nodes, size))
    labels = components(links)

    # What the pivots left open: pairs around one pivot in different components.
    untested = open_pairs(edges, labels, nodes, size).join(stars, ["a", "b"], "left_anti")
    more = settle(confirmed(plausible(untested, nodes), nodes, size))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    grown = settle(labels.join(classes, "node").groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_nodes")))
    # A component may hold a large part of all nodes; such ones are broadcast.
    homes = joined_by_key(labels, grown, "root", labels.count(), "n_nodes", F.xxhash64("node"))
    homes = homes.select("node", "root", "__cw_side.component_id")
    whole = F.coalesce("component_id", "least_id").alias("component_id")
    homes = settle(classes.join(homes, "node", "left").select("node", F.coalesce("root", "node").alias("root"), whole, "n_rows"))
    # Exact copies share their node; the few nodes that hold many rows are broadcast.
    slim = rows.select("id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    # Texts without words share one digest, but link with nothing: each goes along by itself.
    slim = slim.withColumn("key", F.coalesce("node", F.xxhash64("id", "text_key").cast("string").cast("binary")))
    found = joined_by_key(slim, homes.withColumnRenamed("node", "key"), "key", rows.count(), "n_rows", F.xxhash64("id", "text_key"))
    return found.select("id", "text_key", "n_shingles", "node", "__cw_side.root", "__cw_side.component_id")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), a row for each of ``docs``."""
    home = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return placed(docs, id_col, text_col, size).select(
        F.col("id").alias(id_col), "n_shingles", home.alias("component_id"), F.col("id").eqNullSafe(home).alias("kept")
    )


def of_the_class(own: DataFrame, size: int) -> DataFrame:
    """(node, n_shingles, regs, text): one text of each node's set, also where an id has several."""

    def keep(batches):
        for batch in batches:
            for first, past, data, bounds in blocks(batch.column("text")):
                n = past - first
                hashes, row, _ = words(TO_LOWER[data], bounds)
                hashes, row = shingles(hashes, row, n, size)
                mine = batch.slice(first, n)
                right = [x == y for x, y in zip(mine.column("node").to_pylist(), set_digests(hashes, row, n), strict=True)]
                regs = pa.array([r.tobytes() for r in registers(hashes, row, n)], pa.binary())
                out = [mine.column("node"), pa.array(np.bincount(row, minlength=n)), regs, mine.column("text")]
                yield pa.RecordBatch.from_arrays(out, ["node", "n_shingles", "regs", "text"]).filter(pa.array(right, pa.bool_()))

    slim = own.select("node", "text")
    return slim.mapInArrow(keep, "node binary, n_shingles bigint, regs binary, text string").dropDuplicates(["node"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each group one row, the one of the least id (null last), then
    of the least digest of its text; and all rows without words."""
    wordy = placed(docs, id_col, text_col, size).where("n_shingles > 0")
    copies = wordy.groupBy("root", "id", "text_key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_key", "n")).alias("first")
    chosen = copies.groupBy("root").agg(first).select(F.col("first.id").alias("__cw_id"), F.col("first.text_key").alias("__cw_key"), F.col("first.n").alias("__cw_n"))
    # Two groups never share a text, so (id, digest) names one; as files, their size decides the join.
    chosen = stored(chosen, "kept")
    has_words = F.coalesce(F.rlike(F.col(text_col), F.lit(WORD)), F.lit(False))
    own = F.when(has_words, F.xxhash64(text_col)).otherwise(F.monotonically_increasing_id())
    rows = docs.withColumns({"__cw_own": own, "__cw_wordy": has_words})
    same = F.col(id_col).eqNullSafe(F.col("__cw_id")) & (F.col("__cw_own") == F.col("__cw_key"))
    kept = rows.join(chosen, same, "left").where(~F.col("__cw_wordy") | F.col("__cw_n").isNotNull())
    helpers = ("__cw_own", "__cw_wordy", "__cw_id", "__cw_key", "__cw_n")
    repeated = F.col("__cw_wordy") & (F.col("__cw_n") > 1)
    if chosen.where("__cw_n > 1").isEmpty():
        return kept.drop(*helpers)
    single = kept.where(~F.coalesce(repeated, F.lit(False)))
    return single.unionByName(kept.where(repeated).dropDuplicates(["__cw_own", id_col])).drop(*helpers)


def op2_hyperminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(without(table(spark, sf_dir, "documents"), *OUTPUTS), size=4)
