"""The pipeline's stages one after another against brute-force decisions."""

import pytest

import corpus_pipeline
from cloakwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert name == "sharding" or out.columns == docs.columns
        kept[name], docs = out, out
    ids = {n: sorted(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in kept.items()}
    accepted = QUERIES["op9_pairwise_quality"](spark, SF).where("predicted = 1").select("doc_id").collect()
    assert ids["quality classifier"] == sorted(r[0] for r in accepted)
    assert set(ids["near-duplicates"]) <= set(ids["quality classifier"]) and len(set(ids["near-duplicates"])) == len(ids["near-duplicates"])
    hit = {r[0] for r in QUERIES["op7_benchmark_hits"](spark, SF).where("contaminated").select("doc_id").collect()}
    assert ids["benchmark decontamination"] == [k for k in ids["near-duplicates"] if k not in hit]
    assert set(ids["source mix"]) <= set(ids["benchmark decontamination"])
    counts = kept["sharding"].groupBy("shard").count().collect()
    assert ids["sharding"] == ids["source mix"] and max(r["count"] for r in counts) - min(r["count"] for r in counts) <= 1


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "source", "shard", "slot"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("k", range(5))
def test_stages_on_edge_rows_extra_columns_and_nothing(spark, edges, clashing, nothing, k):
    """Nulls, empty and very long texts, ties, repeated rows; columns named like outputs; no rows."""
    name, stage = corpus_pipeline.STAGES[k]
    more = ["shard", "slot"] if name == "sharding" else []
    out = stage(spark, clashing, SF)
    assert out.columns == [c for c in clashing.columns if c not in more] + more
    rows = out.collect()
    kept = [c for c in clashing.columns if c not in edges.columns and c not in more]
    assert rows and all(r[c] == "other" for r in rows for c in kept)
    given = {(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in edges.collect()}
    found = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows]
    assert set(found) <= given
    if name == "near-duplicates":
        assert len(found) == len(set(found)) == len(given) - 1  # the two long texts are one group
    if name == "benchmark decontamination":
        assert sorted(map(str, found)) == sorted(str(tuple(r)) for r in edges.select("doc_id", "text", "lang", "source", "n_chars").collect())
    if name == "source mix":
        assert {f for f in found if f[1] is None or not f[1].split()} == {g for g in given if g[1] is None or not g[1].split()}
    if name == "sharding":
        assert len(rows) == edges.count() and {r["slot"] for r in rows} == {0}
    empty = stage(spark, nothing, SF)
    assert empty.columns == [c for c in nothing.columns if c not in more] + more and empty.isEmpty()


def test_without_labels_the_first_stage_keeps_everything(spark, edges, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.quality(spark, edges, str(tmp_path)).count() == edges.count()
