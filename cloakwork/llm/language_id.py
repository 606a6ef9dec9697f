"""Language ID by Bayesian fusion of evidence.

The log posterior of a language is the sum of: the likelihood of the visible text under
byte-trigram models, the likelihood of the declared markup language, and a prior of the host that
already holds the address suffix. The prior is smoothed along the address: the suffix's language
counts start from the corpus', the domain's from the suffix', the host's from the domain's.
Counts are grouped aggregates over all rows, so hot hosts are combined before the shuffle.

Trigram models are fitted on bounded labelled documents: at most SAMPLE rows of each of the MOST_LANGUAGES
commonest labels, by digest, none of them in the held-out fold (a quarter of the ids, by CRC).
How often a declaration agrees with the text is counted over the whole table. Neighbouring
trigrams repeat each other's evidence, so each counts for TEMPER of itself.

A long text decides by itself, as it should: declaration and host speak where the text is short,
missing or between two languages.

Defined results: null or empty text leaves the other evidence; without any evidence the
corpus' prior decides; ties go to the first language by name; null hosts are one host;
repeated rows count each time and repeat their result; a label beyond the commonest is no
language of the model; where no document is labelled, the only language is UNKNOWN; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.functions.lineage import stored
from cloakwork.llm.common import ascii_lower, joined_by_key, seeded_key, table
from cloakwork.llm.textbytes import TO_LOWER, blocks, stretches
from cloakwork.llm.url_filters import host_of

SAMPLE = 2000
MOST_LANGUAGES = 64
FOLDS, HELD_OUT = 4, 2
HASH_BITS = 16
TEMPER = 1 / 6
UNKNOWN = "und"
SMOOTHING = 4.0  # pseudo-counts of the level above
#: An attribute of its own: neither data-lang nor xml:lang.
DECLARED = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b"
UNSEEN = r"(?is)<(script|style|nav|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;"
OUTPUTS = ("text_lang", "lang", "confidence")


@dataclass(frozen=True)
class TrigramModel:
    languages: tuple[str, ...]
    log_likelihood: np.ndarray  # (2 ** HASH_BITS, languages)

    def score(self, data: np.ndarray, bounds: np.ndarray, temper: float = TEMPER) -> np.ndarray:
        """(texts, languages): tempered log likelihoods of lower-cased texts."""
        n = len(bounds) - 1
        total = np.zeros((n, len(self.languages)))
        for at, row in trigrams(data, bounds):
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row, self.log_likelihood[at, k], n)
        return total * temper


def trigrams(data: np.ndarray, bounds: np.ndarray):
    """Hashed byte trigrams and the text each lies in, by stretch of the block."""
    for first, own, row in stretches(data, bounds):
        more = data[first + len(own) : first + len(own) + 2]  # the next stretch's first two bytes
        low = TO_LOWER[np.concatenate([own, more])].astype(np.int64)
        if len(low) < 3:
            continue
        at = ((low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * 0x9E3779B1 >> 12) & ((1 << HASH_BITS) - 1)
        row = row[: len(at)]
        inside = first + np.arange(len(at)) + 3 <= bounds[row + 1]
        yield at[inside], row[inside]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most_languages: int = MOST_LANGUAGES
) -> TrigramModel:
    """Models of the languages that ``docs`` are labelled with, counted on the executors."""
    text = F.col(text_col)
    keyed = docs.select(F.col(lang_col).alias("lang"), text.alias("text"), F.col(id_col).alias("id"))
    keyed = keyed.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    # Equal rows have one key, other rows of the same id another.
    keyed = keyed.select("lang", "text", seeded_key("language", F.col("id"), F.md5("text")).alias("__cw_key"))
    common = keyed.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    keyed = keyed.join(F.broadcast(common.select("lang")), "lang")
    # The first of every bin of the digest, then the first of these: no sort of a whole language.
    rank = F.row_number().over(Window.partitionBy("__cw_bin").orderBy("__cw_key"))
    firsts = keyed.select("lang", "__cw_key", F.concat_ws(":", "lang", F.substring("__cw_key", 1, 3)).alias("__cw_bin"))
    chosen = firsts.withColumn("r", rank).where(F.col("r") <= -(-sample // 4096)).select("lang", "__cw_key").distinct()
    chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("__cw_key"))).where(F.col("r") <= sample)
    rows = keyed.join(F.broadcast(chosen.drop("r")), ["lang", "__cw_key"], "left_semi").dropDuplicates(["lang", "__cw_key"]).select("lang", "text")

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, past, data, bounds in blocks(batch.column(1)):
                names = sorted(set(langs[first:past]))
                number = np.array([names.index(x) for x in langs[first:past]])
                for at, row in trigrams(data, bounds):
                    for k, name in enumerate(names):
                        mine = np.bincount(at[number[row] == k], minlength=1 << HASH_BITS)
                        tables[name] = tables.get(name, 0) + mine
        for name, counts in tables.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], ["lang", "at", "n"])

    # At most 2 ** HASH_BITS rows for each of at most ``most_languages`` languages come to the driver.
    found = rows.mapInArrow(count, "lang string, at bigint, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(found["lang"].unique())) or (UNKNOWN,)
    counts = np.full((1 << HASH_BITS, len(names)), 0.5)
    for k, name in enumerate(names):
        mine = found[found["lang"] == name]
        counts[mine["at"].to_numpy(), k] += mine["n"].to_numpy()
    return TrigramModel(names, np.log(counts / counts.sum(axis=0)))


def visible_text(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " ")


def declared_language(html: Column) -> Column:
    """The language of the html element; null without one."""
    return F.nullif(F.regexp_extract(ascii_lower(F.coalesce(html, F.lit(""))), DECLARED, 1), F.lit(""))


def with_text_scores(rows: DataFrame, model: TrigramModel) -> DataFrame:
    """``rows`` without ``__cw_text``, with ``__cw_scores``: a number for each language."""
    n = len(model.languages)

    def score(batches):
        for batch in batches:
            for first, past, data, bounds in blocks(batch.column(0)):
                rest = batch.slice(first, past - first)
                x = model.score(data, bounds)
                listed = pa.ListArray.from_arrays(np.arange(0, x.size + 1, n, dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([listed, *rest.columns[1:]], ["__cw_scores", *rest.schema.names[1:]])

    keep = [c for c in rows.columns if c != "__cw_text"]
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.select("__cw_text", *keep).mapInArrow(score, f"__cw_scores array<double>{kept}")


def best_of(scores: Column, languages: tuple[str, ...]) -> Column:
    """The language of the highest score, the first of equals."""
    return F.element_at(F.array(*map(F.lit, languages)), F.array_position(scores, F.array_max(scores)).cast("int"))


def host_priors(rows: DataFrame, languages: tuple[str, ...], whole: list[float]) -> DataFrame:
    """(host, log_prior, n_rows): counts of the languages that texts speak for, smoothed along the address.

    ``whole`` holds the counts of all rows.
    """
    counts = [F.sum((F.col("text_lang") == x).cast("double")) for x in languages]
    hosts = rows.groupBy("host", "domain", "suffix").agg(F.array(*counts).alias("n"), F.count("*").alias("n_rows"))

    def above(keys: list[str], name: str) -> DataFrame:
        sums = [F.sum(F.col("n")[k]) for k in range(len(languages))]
        return hosts.groupBy(*keys).agg(F.array(*sums).alias(name))

    def smoothed(counts: str, prior: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, prior, lambda n, p: (n + SMOOTHING * p) / (total + SMOOTHING))

    flat = F.array(*[F.lit(1.0 / len(languages))] * len(languages))
    corpus = smoothed(F.array(*map(F.lit, whole)), flat)
    suffixes = above(["suffix"], "n_suffix").select("suffix", smoothed("n_suffix", corpus).alias("p_suffix"))
    domains = above(["domain", "suffix"], "n_domain").join(suffixes, "suffix")
    domains = domains.select("domain", "suffix", smoothed("n_domain", F.col("p_suffix")).alias("p_domain"))
    joined = hosts.join(domains, ["domain", "suffix"])
    return joined.select("host", F.transform(smoothed("n", F.col("p_domain")), lambda p: F.log(p)).alias("log_prior"), "n_rows")


def address(host: Column) -> dict[str, Column]:
    """host without user and port, its suffix and its domain (the last two labels)."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(host, F.lit("")), "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return {"host": bare, "suffix": F.element_at(labels, -1), "domain": domain}


def fused(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """From (__cw_scores, declared, host, __cw_rest): (__cw_rest, host, declared, text_lang, lang, confidence)."""
    own = {"text_lang": best_of(F.col("__cw_scores"), languages), "__cw_row": F.xxhash64("__cw_rest", "__cw_scores")}
    named = stored(rows.withColumns(address(F.col("host")) | own), "scored")
    known = F.col("declared").isin(*languages)
    totals = named.agg(
        F.count_if(known & (F.col("declared") == F.col("text_lang"))).alias("agree"),
        F.count_if(known).alias("n"),
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col("text_lang") == x).cast("double").alias(f"n_{k}") for k, x in enumerate(languages)],
    ).first()
    trust = (totals["agree"] + 1) / (totals["n"] + 2)
    whole = [totals[f"n_{k}"] for k in range(len(languages))]
    for_declared = [
        F.when(F.col("declared") == x, F.lit(float(np.log(trust))))
        .when(known, F.lit(float(np.log((1 - trust) / max(len(languages) - 1, 1)))))
        .otherwise(F.lit(0.0))
        for x in languages
    ]
    priors = stored(host_priors(named, languages, whole), "hosts")
    with_prior = joined_by_key(named, priors, "host", totals["n_rows"], "n_rows", F.col("__cw_row"))
    total = F.zip_with(F.zip_with("__cw_scores", F.array(*for_declared), lambda a, b: a + b), "__cw_side.log_prior", lambda a, b: a + b)
    summed = with_prior.withColumn("__cw_scores", total)
    top = F.array_max("__cw_scores")
    weight = F.aggregate(F.transform("__cw_scores", lambda s: F.exp(s - top)), F.lit(0.0), lambda a, x: a + x)
    return summed.select("__cw_rest", "host", "declared", "text_lang", best_of(F.col("__cw_scores"), languages).alias("lang"), (1 / weight).alias("confidence"))


def identified(rows: DataFrame, model: TrigramModel, text: Column, declared: Column, host: Column, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns of ``rows`` (all by default) with text_lang, lang and confidence.

    Only what is kept travels, in one struct, so that its names are of no account.
    """
    kept = [c for c in (rows.columns if keep is None else keep) if c.lower() not in OUTPUTS]
    rest = F.struct(F.lit(True).alias("__cw_any"), *[F.col(f"`{c}`") for c in kept])
    slim = rows.select(text.alias("__cw_text"), declared.alias("declared"), host.alias("host"), rest.alias("__cw_rest"))
    out = fused(with_text_scores(slim, model), model.languages)
    return out.select(*[F.col("__cw_rest").getField(c).alias(c) for c in kept], *OUTPUTS)


def op5_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, and every document with its source in the place of a host."""
    labelled = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source")
    model = fit(labelled)
    pages = table(spark, sf_dir, "pages").select(
        F.lit(None).cast("bigint").alias("doc_id"),
        F.col("page_id").cast("bigint").alias("page_id"),
        host_of(F.col("url")).alias("host"),
        declared_language(F.col("html")).alias("declared"),
        visible_text(F.col("html")).alias("text"),
    )
    docs = labelled.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.lit(None).cast("bigint").alias("page_id"),
        F.concat(F.coalesce("source", F.lit("")), F.lit(".documents")).alias("host"),
        F.lit(None).cast("string").alias("declared"),
        "text",
    )
    both = pages.unionByName(docs)
    found = identified(both, model, F.col("text"), F.col("declared"), F.col("host"), ["doc_id", "page_id", "host", "declared"])
    return found.select("doc_id", "page_id", "host", "declared", "text_lang", "lang", "confidence")
