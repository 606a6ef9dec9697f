"""Metrics against a plain implementation; checks; the report; streams."""

import json
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloakwork.cli import main
from cloakwork.operators import audit, evaluate, validate
from cloakwork.operators.recognizers import RULES
from cloakwork.operators.resolve import detect, resolved
from cloakwork.plans import catalogue
from cloakwork.schemas import CANDIDATE, ENTITY_TYPES, GENERIC_ORGANIZATIONS
from cloakwork.sources import annotations
from cloakwork.streaming import stream

SPANS = "dataset string, case_id string, entity_type string, start int, end int"
TEXT = "Alice emailed alice@example.com from 192.0.2.1."


def test_worked_example(spark):
    gold = spark.createDataFrame([("d", "1", "PERSON", 0, 5), ("d", "1", "EMAIL_ADDRESS", 14, 31), ("d", "1", "IP_ADDRESS", 37, 46)], SPANS)
    pred = spark.createDataFrame([("d", "1", "PERSON", 0, 5), ("d", "1", "EMAIL_ADDRESS", 14, 31), ("d", "1", "PHONE_NUMBER", 32, 36)], SPANS)
    cases = spark.createDataFrame([("d", "1", TEXT)], "dataset string, case_id string, text string")
    rows = {(r["dataset"], r["entity_type"]): r for r in evaluate.entity_metrics(gold, pred).collect()}
    whole = rows["combined", None]
    assert (whole["tp"], whole["fp"], whole["fn"], whole["leaked"]) == (2, 1, 1, 1)
    assert whole["precision"] == whole["recall"] == whole["f1"] == pytest.approx(2 / 3) == whole["f2"]
    tokens = {r["dataset"]: r for r in evaluate.token_accuracy(cases, gold, pred).collect()}
    assert (tokens["d"]["correct"], tokens["d"]["n_tokens"]) == (3, 5) == (tokens["combined"]["correct"], tokens["combined"]["n_tokens"])
    report = evaluate.render_report(list(rows.values()), list(tokens.values()), ["d"])
    assert "| TP / FP / FN | 2 / 1 / 1 |" in report and "| Residual leakage | 1 / 3 (0.3333) |" in report


def test_evaluation_command(spark, tmp_path):
    cases = [{"id": "a", "text": "Email: a@example.com a@example.com", "entities": [{"entity_type": "EMAIL_ADDRESS", "value": "a@example.com", "occurrence": 2}]}, {"id": "b", "text": "nothing"}]
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "1", "datasets": {"synthetic_cases": cases}}))
    assert main(["evaluate", "--annotations", str(tmp_path / "a.json"), "--output", str(tmp_path / "r.md")], make_session=lambda: spark) == 0
    assert "## Synthetic Cases" in (tmp_path / "r.md").read_text()
    rows = annotations.gold(annotations.annotated(spark, str(tmp_path / "a.json"))).collect()
    assert [(r["start"], r["end"]) for r in rows] == [(21, 34)]
    cases[0]["entities"][0]["occurrence"] = 3
    (tmp_path / "a.json").write_text(json.dumps({"datasets": {"x": cases}}))
    with pytest.raises(Exception, match="occurrence"):
        annotations.gold(annotations.annotated(spark, str(tmp_path / "a.json"))).collect()


def plain_resolve(text, candidates):
    kept = []
    for order, (kind, start, end, score) in enumerate(candidates):
        if kind in ("PERSON", "ORGANIZATION") and "\n" in text[start:end]:
            end = start + text[start:end].index("\n")
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        value = text[start:end].strip().lower()
        words = sum(1 for w in "".join(c if c.isalpha() else " " for c in value).split())
        if score < ENTITY_TYPES[kind][0] or kind == "PERSON" and words < 2:
            continue
        if kind == "ORGANIZATION" and (sum(c.isalpha() for c in value) < 2 or value in GENERIC_ORGANIZATIONS):
            continue
        kept.append((score, ENTITY_TYPES[kind][1], end - start, -start, kind, -order, start, end))
    chosen = []
    for c in sorted(kept, reverse=True):
        if not any(c[6] < k[7] and k[6] < c[7] for k in chosen):
            chosen.append(c)
    return sorted((c[6], c[7], c[4]) for c in chosen)


def test_resolver_like_a_plain_one(spark):
    draw, rows = random.Random(5), []
    for k in range(300):
        text = "".join(draw.choice("ab cd\n Ltd") for _ in range(40))
        found = []
        for order in range(draw.randrange(8)):
            start = draw.randrange(38)
            found.append((draw.choice(list(ENTITY_TYPES)), start, min(40, start + draw.randrange(1, 14)), draw.choice([0.5, 0.6, 0.85, 0.9, 1.0])))
        rows.append((k, text, [(t, s, e, x, "r", None, i) for i, (t, s, e, x) in enumerate(found)]))
    df = spark.createDataFrame(rows, f"k int, text string, c array<{CANDIDATE}>")
    got = {r["k"]: r["r"] for r in df.select("k", resolved(F.col("text"), F.col("c")).alias("r")).collect()}
    for k, text, found in rows:
        expected = plain_resolve(text, [c[:4] for c in found])
        assert [(e["start"], e["end"], e["entity_type"]) for e in got[k]] == expected, (text, found)


def test_checks(spark):
    maps = spark.createDataFrame(
        [(1, "PERSON", "Rashi Patil", "rashi patil", "Asha Rao", 2), (1, "PERSON", "Rao", "rao", "Dev Shah", 1)],
        "doc_id long, entity_type string, original string, normalized_original string, replacement string, occurrences long",
    )
    before = spark.createDataFrame([(1, "Rashi Patil met RASHI PATIL")], "doc_id long, text string")
    once = spark.createDataFrame([(1, "Asha Rao met RASHI PATIL")], "doc_id long, text string")
    assert validate.left_behind(before, once, maps).isEmpty()  # strictly fewer is enough
    assert [r["normalized_original"] for r in validate.left_behind(before, before, maps).collect()] == ["rashi patil"]
    assert [r["value"] for r in validate.audit_leaks('{"x": "asha rao"}', maps).collect()] == ["Asha Rao"]
    row = audit.audit_row(maps).first()
    assert row["entity_counts"] == {"PERSON": 3} and row["unique_mappings"] == 2
    assert audit.audit_row(maps.limit(0)).first()["total_entities"] == 0


def test_stream_detects_and_keeps_its_registry(spark, tmp_path):
    schema = "doc_id long, unit_no long, text string"
    rules = [r for r in RULES if r.entity_type == "EMAIL_ADDRESS"]
    source = str(tmp_path / "in")
    for k, text in enumerate(["a a@example.com", "b b@example.com A@example.com"]):
        spark.createDataFrame([(1, k, text)], schema).coalesce(1).write.mode("append").parquet(source)
        spans = stream.detected_stream(stream.read_units(spark, source, schema), ["doc_id", "unit_no"], rules)
        stream.start_registry(spans, str(tmp_path / "reg"), str(tmp_path / "check")).awaitTermination()
    one, two = (stream.registry_mappings(stream.registry_at(spark, str(tmp_path / "reg"), k), 17).collect() for k in (0, 1))
    assert [r["occurrences"] for r in one] == [1] and sorted(r["occurrences"] for r in two) == [1, 2]
    assert one[0]["replacement"] in {r["replacement"] for r in two}


def test_detection_of_a_batch_and_extra_columns(spark):
    units = spark.createDataFrame([(1, "x", "mail a@example.com")], "doc_id int, candidates string, text string")
    out = detect(units, rules=[r for r in RULES if r.entity_type == "EMAIL_ADDRESS"])
    assert out.columns == ["doc_id", "candidates", "text", "entities"] and len(out.first()["entities"]) == 1


def test_upper_case_by_character_like_sql(spark, tmp_path):
    """Every character, alone and between others; texts of many, and none."""
    points = [k for k in range(1, 0x110000) if not 0xD800 <= k <= 0xDFFF]
    texts = [chr(k) for k in points] + [f"a{chr(k)}\u0301ßi" for k in points[:0x3000]] + ["Straße, große ﬁsche ŉ", "ßß", "", None]
    pd.DataFrame({"doc_id": range(0, 50 * len(texts), 50), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = {r[0]: r[1:] for r in duck.sql(catalogue.ORACLES["hash_validation"]).fetchall()}
    got = {r["doc_id"]: (r["expected"], r["found"]) for r in catalogue.hash_validation(spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 13_000
