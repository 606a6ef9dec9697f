"""Every operator on nulls, empty and very long texts, ties, repeated rows, no rows, clashing names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import decontamination, fingerprints, language_id, licenses, mixing, near_dedup, quality, secrets, sharding, url_filters

N = 14
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def benchmark_table(spark):
    rows = [(1, "a repeated row of five words"), (2, None), (3, ""), (4, "a repeated row of five words"), (5, "first text")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(10)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def model_for(spark, docs, labels):
    return quality.learned(docs, labels)


OPERATORS = {
    "secrets": lambda s, d, b, l: secrets.scanned(d),
    "near": lambda s, d, b, l: near_dedup.grouped(d),
    "mix": lambda s, d, b, l: mixing.mixed(d),
    "fingerprints": lambda s, d, b, l: fingerprints.fingerprinted(d),
    "licenses": lambda s, d, b, l: licenses.scanned(d),
    "hits": lambda s, d, b, l: decontamination.decontaminated(d, b),
    "shards": lambda s, d, b, l: sharding.interleaved_shards(d),
    "quality": lambda s, d, b, l: quality.scored(d, quality.learned(d, l)),
    "languages": lambda s, d, b, l: language_id.identified(d, language_id.fit(d), F.col("text"), F.lit("en"), F.col("source")),
    "urls": lambda s, d, b, l: url_filters.filter_urls(d, url_col="text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_empty_tables_and_clashing_names(spark, edges, nothing, clashing, benchmark_table, labels, name):
    run = OPERATORS[name]
    assert run(spark, edges, benchmark_table, labels).count() == N
    assert run(spark, nothing, benchmark_table, labels).count() == 0
    out = run(spark, clashing, benchmark_table, labels)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.count() == N


def test_empty_benchmark_and_labels(spark, edges, benchmark_table, labels):
    assert decontamination.decontaminated(edges, benchmark_table.limit(0)).where("contaminated").isEmpty()
    rows = quality.scored(edges, quality.learned(edges, labels.limit(0))).select("score", "predicted").distinct().collect()
    assert [(round(r["score"], 9), r["predicted"]) for r in rows] == [(0.7, 1)]


def test_near_duplicates_of_edge_rows(spark, edges):
    rows = near_dedup.grouped(edges).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    for k in (0, 1, 2):
        assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in by_id[k]] == [(0, k, True)]
    assert [(r["n_shingles"], r["kept"]) for r in by_id[3]] == [(1, True)]
    assert by_id[5][0]["kept"] and (by_id[6][0]["component_id"], by_id[6][0]["kept"]) == (5, False)
    assert len(by_id[9]) == 3 and all(r["component_id"] == 9 and r["kept"] for r in by_id[9])
    assert all(r["component_id"] == 8 for r in by_id[8])


def test_one_row_of_each_group_stays(spark, edges, nothing):
    kept = near_dedup.deduplicated(edges)
    assert kept.columns == edges.columns and near_dedup.deduplicated(nothing).isEmpty()
    ids = sorted((r["doc_id"], (r["text"] or "")[:8]) for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [(0, ""), (1, ""), (2, " \t\n "), (3, "one"), (4, "é😀ß two"), (5, edges.where("doc_id = 5").first()["text"][:8]), (7, "x" * 8), (8, "same id,"), (8, "same id,"), (9, "a repeat")]
    text = "seven words that stand without an id"
    rows = [(None, text), (None, text), (None, text + " x"), (4, text), (4, text), (None, "alone here with five words"), (None, None), (None, None)]
    out = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(4, text), (None, "alone here with five words"), (None, None), (None, None)], key=str)


def test_sizes_of_edge_rows(spark, edges):
    shards = {(r["doc_id"], r["text"]): r for r in sharding.interleaved_shards(edges, n_shards=3).collect()}
    counts = sharding.interleaved_shards(edges, n_shards=3).groupBy("shard").agg(F.count("*").alias("n"), F.collect_set("slot").alias("s")).collect()
    assert {r["n"] for r in counts} <= {N // 3, N // 3 + 1} and all(sorted(r["s"]) == list(range(r["n"])) for r in counts)
    assert (0, None) in shards
    mix = mixing.mixed(edges).collect()
    assert all(r["size"] == len([w for w in (r["text"] or "").split()]) for r in mix if r["doc_id"] != 7)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mix)
    hits = {(r["doc_id"], r["text"]): r for r in decontaminated(spark, edges)}
    assert hits[0, None]["items_sha256"] == EMPTY_SHA and hits[0, None]["n_words"] == 0
    assert zlib.crc32(b"") == 0


def decontaminated(spark, docs):
    bench = spark.createDataFrame([(1, "a repeated row of five words"), (4, "A repeated, row of five words"), (5, "first text")], "item_id long, text string")
    rows = decontamination.decontaminated(docs, bench).collect()
    repeated = [r for r in rows if r["doc_id"] == 9]
    assert len(repeated) == 3 and all((r["n_hit"], r["n_items"]) == (6, 2) for r in repeated)
    first, second = (next(r for r in rows if r["doc_id"] == 8 and w in r["text"]) for w in ("first", "second"))
    assert (first["n_hit"], second["n_hit"]) == (2, 0)
    return rows


def language_rows(spark, rows):
    docs = spark.createDataFrame([(k, t * 20, l) for k, (t, l) in enumerate([("the of and to ", "en"), ("der die und das ", "de")] * 8)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, declared string, host string")
    out = language_id.identified(df, model, F.col("text"), F.col("declared"), F.col("host")).collect()
    return model, {r["k"]: r for r in out}


def test_declaration_and_host_overturn_a_poor_text(spark):
    sure = [("the and of the to the and of " * 9, "en", "a.org")] * 30 + [("und der die und das der die " * 9, "de", "b.de")] * 30
    rows = [*sure, ("de", "de", "c.org"), ("de", "en", "c.org"), ("", None, "b.de"), ("", None, "other.b.de"), (None, None, "x.de"), ("", "de", "a.org"), ("", None, None), ("", "zz", "b.de"), ("the and of the to " * 40, "de", "b.de")]
    model, out = language_rows(spark, rows)
    n = len(sure)
    assert [out[n + k]["lang"] for k in range(5)] == ["de", "en", "de", "de", "de"] and out[n + 7]["lang"] == "de"
    assert out[n + 8]["lang"] == out[n + 8]["text_lang"] == "en" and out[n]["confidence"] < out[n + 8]["confidence"] <= 1
    # Brute force of the fusion.
    scores = {}
    for k, (text, _, _) in enumerate(rows):
        data = np.frombuffer((text or "").encode(), np.uint8)
        scores[k] = model.score(data, np.array([0, len(data)]))[0] if len(data) else np.zeros(2)
    best = {k: model.languages[int(np.argmax(v))] for k, v in scores.items()}
    known = [(r[1], best[k]) for k, r in enumerate(rows) if r[1] in model.languages]
    trust = (sum(a == b for a, b in known) + 1) / (len(known) + 2)

    def counts(ids):
        return np.array([sum(best[k] == x for k in ids) for x in model.languages], float)

    def smoothed(n, prior):
        return (n + language_id.SMOOTHING * prior) / (n.sum() + language_id.SMOOTHING)

    hosts = [r[2] or "" for r in rows]
    for k, (_, declared, _) in enumerate(rows):
        prior = smoothed(counts(range(len(rows))), np.full(2, 0.5))
        for level in (lambda h: h.split(".")[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h):
            prior = smoothed(counts([j for j, h in enumerate(hosts) if level(h) == level(hosts[k])]), prior)
        said = np.array([trust if x == declared else 1 - trust for x in model.languages]) if declared in model.languages else np.ones(2)
        total = scores[k] + np.log(said) + np.log(prior)
        posterior = np.exp(total - total.max())
        assert out[k]["lang"] == model.languages[int(np.argmax(total))] and out[k]["text_lang"] == best[k]
        assert out[k]["confidence"] == pytest.approx(1 / posterior.sum())


def test_language_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.col("lang").alias("label"))
    rows = language_id.op5_language_evidence(spark, folder).where("doc_id is not null").join(labels, "doc_id")
    rows = rows.where(language_id.held_out(F.col("doc_id")) & F.col("label").isNotNull())
    n, right = rows.agg(F.count("*"), F.count_if(F.col("lang") == F.col("label"))).first()
    assert n > 150 and right / n > 0.98


def test_declared_attribute_and_bounded_labels(spark):
    html = ['<html data-lang="de" lang="en">', '<html xml:lang="de">', "<HTML class=x LANG=fr-CA>", "<html>", None, '<html xml:lang="de" lang="es">']
    df = spark.createDataFrame(list(enumerate(html)), "k int, h string")
    assert [r[0] for r in df.orderBy("k").select(language_id.declared_language(F.col("h"))).collect()] == ["en", None, "fr", None, None, "es"]
    many = spark.range(400).selectExpr("id % 2 AS doc_id", "concat('words ', id) AS text", "concat('l', id % 40) AS lang")
    assert len(language_id.fit(many, most_languages=5).languages) <= 5


def test_language_without_labelled_documents(spark, nothing):
    model = language_id.fit(nothing)
    rows = spark.createDataFrame([("some text", "en", "x.de"), (None, None, None)], "t string, declared string, host string")
    out = language_id.identified(rows, model, F.col("t"), F.col("declared"), F.col("host")).collect()
    assert [(r["lang"], r["confidence"]) for r in out] == [("und", 1.0)] * 2
