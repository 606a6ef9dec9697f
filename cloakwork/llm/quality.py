"""Quality classifier: Bradley-Terry pairwise ranking of documents.

A document's strength is a weighted sum of features of its bytes and words. The weights come
from preference pairs (a document labelled 1 beats one labelled 0) by the logistic loss of the
feature differences; the cut is the quantile of the strengths of all usable labelled documents that the
share of rejected labels among them names. The fit uses at most SAMPLE labelled documents, chosen
by digest, and PAIRS pairs, on the driver; every document is scored where it lies, without a
shuffle. Of rows that share a labelled id the fit reads the least text, so that they can't outgrow
the bound; beyond the bound, such an id counts for the cut with its least strength.

Defined results: null counts as empty, and empty texts are scored by their features (all 0);
labels that are null are left out; without labels of both kinds every score is 0.7, so nothing is
rejected; repeated rows repeat their score; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.lineage import settle
from cloakwork.llm.common import possibly_in, seeded_key, table, without
from cloakwork.llm.textbytes import blocks, stretches, words

SAMPLE = 20_000
PAIRS = 60_000
RIDGE = 1e-3
KEEP_AT = 0.7
FOLDS, HELD_OUT = 4, 2
OUTPUTS = ("score", "predicted")

#: Byte classes whose share of the text is a feature: a class for each sign, and the rest.
SIGNS = "#$%&*!|@=<>{}[]()/\\_+~^\"'"
N_CLASSES = len(SIGNS) + 10


def _byte_classes() -> np.ndarray:
    out = np.full(256, len(SIGNS) + 9, np.int64)  # control characters
    for k, sign in enumerate(SIGNS):
        out[ord(sign)] = k
    for k, members in enumerate((range(65, 91), range(97, 123), range(48, 58), [32, 9], [10, 13], [46, 63], [44, 59, 58, 45], range(128, 192), range(192, 256))):
        out[list(members)] = len(SIGNS) + k
    return out


BYTE_CLASS = _byte_classes()
N_FEATURES = 2 * N_CLASSES + 7


def _per(total: np.ndarray, of: np.ndarray) -> np.ndarray:
    return total / np.maximum(of, 1)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, N_FEATURES): byte class shares and their roots, and word statistics."""
    n, size = len(bounds) - 1, np.diff(bounds)
    held = np.zeros(n * N_CLASSES, np.int64)
    for _, own, row in stretches(data, bounds):
        held += np.bincount(row * N_CLASSES + BYTE_CLASS[own], minlength=n * N_CLASSES)
    shares = held.reshape(n, -1) / np.maximum(size, 1)[:, None]
    hashes, at, length = words(data, bounds)
    count = np.bincount(at, minlength=n)
    order = np.lexsort((hashes, at))
    h, a = hashes[order], at[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (a[1:] != a[:-1])
    again = np.zeros(len(at), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
    mean_length = _per(np.bincount(at, length, n), count)
    more = np.column_stack(
        [
            _per(np.bincount(a[fresh], minlength=n), count),
            _per(np.bincount(at[again], minlength=n), count),
            mean_length,
            _per(np.bincount(at, length.astype(float) ** 2, n), count) ** 0.5,
            _per(np.bincount(at[length <= 3], minlength=n), count),
            np.log1p(count),
            np.log1p(count) ** 2 / 10,
        ]
    )
    return np.hstack([shares, np.sqrt(shares), more])


@dataclass(frozen=True)
class Ranking:
    """A linear strength; ``score`` is its sigmoid, shifted so that the cut scores KEEP_AT."""

    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip(x @ self.weights - self.cut + np.log(KEEP_AT / (1 - KEEP_AT)), -30, 30)
        return 1 / (1 + np.exp(-strength))


def fit(x: np.ndarray, label: np.ndarray, seed: int = 5) -> Ranking:
    """Bradley-Terry weights by Newton's method, and the cut by the quantile of rejected labels."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(x.shape[1]), 0.0)
    scale = np.maximum(x.std(axis=0), 1e-6)
    z = x / scale
    draw = np.random.default_rng(seed)
    diff = z[draw.choice(good, PAIRS)] - z[draw.choice(bad, PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        slope = diff.T @ (1 - p) / PAIRS - RIDGE * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / PAIRS + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    return Ranking(w / scale, float(np.quantile(strength, len(bad) / len(label))))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT


def with_features(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    def extract(batches):
        for batch in batches:
            for first, past, data, bounds in blocks(batch.column(0)):
                rest = batch.slice(first, past - first)
                x = features(data, bounds)
                listed = pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([listed, *rest.columns[1:]], ["x", *rest.schema.names[1:]])

    source = docs.select(F.col(text_col).alias("__cw_text"), *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(extract, f"x array<double>{kept}")


def learned(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int | None = None
) -> Ranking:
    """Fit on at most ``sample`` (SAMPLE) labelled documents outside the held-out fold, the first by digest;
    the cut is taken over all of them."""
    sample = SAMPLE if sample is None else sample
    usable = labels.select(F.col(id_col).alias("__cw_id"), F.col(label_col).alias("__cw_label")).where(
        F.col("__cw_label").isin(0, 1) & F.col("__cw_id").isNotNull() & ~held_out(F.col("__cw_id"))
    )
    ids = docs.select(F.col(id_col).alias("__cw_id"))
    usable = usable.distinct().join(ids, "__cw_id", "left_semi")
    chosen = usable.orderBy(seeded_key("quality", F.col("__cw_id")), "__cw_id", "__cw_label").limit(sample)
    texts = docs.select(F.col(id_col).alias("__cw_of"), F.coalesce(F.col(text_col), F.lit("")).alias("__cw_text"))
    labelled = texts.join(F.broadcast(chosen), F.col("__cw_of") == F.col("__cw_id"))
    labelled = labelled.groupBy("__cw_id", "__cw_label").agg(F.min("__cw_text").alias("__cw_text"))
    rows = with_features(labelled, ["__cw_id", "__cw_label"], "__cw_text").toPandas().sort_values(["__cw_id", "__cw_label"])
    x = np.array(rows["x"].tolist(), float).reshape(-1, N_FEATURES)
    model = fit(x, rows["__cw_label"].to_numpy())
    if len(rows) < sample or rows["__cw_label"].nunique() < 2:
        return model
    return replace(model, cut=cut_over(docs, usable, model, id_col, text_col))


def cut_over(docs: DataFrame, usable: DataFrame, model: Ranking, id_col: str, text_col: str) -> float:
    """The quantile of the strengths of all labelled documents that the share of rejected labels names."""

    def strengths(batches):
        for batch in batches:
            for first, past, data, bounds in blocks(batch.column(0)):
                ids = batch.column(1).slice(first, past - first)
                yield pa.RecordBatch.from_arrays([pa.array(features(data, bounds) @ model.weights), ids], ["v", "__cw_id"])

    source = docs.select(F.col(text_col).alias("__cw_text"), F.col(id_col).alias("__cw_id"))
    source = possibly_in(source, "__cw_id", usable.select("__cw_id")).select("__cw_text", "__cw_id")
    each = source.mapInArrow(strengths, f"v double, __cw_id {source.schema['__cw_id'].dataType.simpleString()}")
    each = each.groupBy("__cw_id").agg(F.min("v").alias("v"))
    values = settle(each.join(usable, "__cw_id").select("v", "__cw_label"))
    n, bad = values.agg(F.count("*"), F.count(F.when(F.col("__cw_label") == 0, 1))).first()
    return exact_quantile(values, n, bad / n)


def exact_quantile(values: DataFrame, n: int, share: float, n_bins: int = 1024) -> float:
    """np.quantile of column v with ``n`` rows: the two ranks around it are found by narrowing
    ranges, of which only counts and bounds reach the driver."""
    rank, part = divmod((n - 1) * share, 1)
    rank, below = int(rank), 0
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    while lo < hi:
        inside = values.where(F.col("v").between(lo, hi))
        place = F.least(F.floor((F.col("v") - lo) / (hi - lo) * n_bins), F.lit(n_bins - 1))
        bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        bins = bins.orderBy("bin").collect()
        k = 0
        while below + bins[k]["n"] <= rank:
            below += bins[k]["n"]
            k += 1
        if part and rank + 1 == below + bins[k]["n"]:
            if k + 1 < len(bins):
                # The next rank lies in the next range: the two are neighbours across the boundary.
                return bins[k]["hi"] + (bins[k + 1]["lo"] - bins[k]["hi"]) * part
        lo, hi = bins[k]["lo"], bins[k]["hi"]
    return lo


def scored(docs: DataFrame, model: Ranking, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns (all by default) with ``score`` and ``predicted``."""
    keep = without(docs, *OUTPUTS).columns if keep is None else keep

    def score(batches):
        for batch in batches:
            for first, past, data, bounds in blocks(batch.column(0)):
                rest = batch.slice(first, past - first)
                s = model.score(features(data, bounds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s), pa.array((s >= KEEP_AT).astype(np.int32)), *rest.columns[1:]], [*OUTPUTS, *rest.schema.names[1:]]
                )

    source = docs.select(F.col(text_col).alias("__cw_text"), *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(score, f"score double, predicted int{kept}")


def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
