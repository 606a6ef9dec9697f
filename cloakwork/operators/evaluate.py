"""Exact-span evaluation: counts, ratios, token accuracy, residual leakage, and the report."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.lineage import stored
from cloakwork.functions.spans import TOKEN, tokens

CASE = ["dataset", "case_id"]
SPAN = [*CASE, "entity_type", "start", "end"]


def ratio(part: Column, whole: Column) -> Column:
    """0 over 0 is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: int) -> Column:
    return ratio((1 + beta**2) * precision * recall, beta**2 * precision + recall)


class Sides(NamedTuple):
    """Annotated and predicted spans, each detected once and read by every metric."""

    gold: DataFrame
    pred: DataFrame

    @staticmethod
    def of(gold: DataFrame, pred: DataFrame) -> Sides:
        return Sides(*(stored(side.select(*SPAN).distinct(), "spans") for side in (gold, pred)))


def outcomes(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """A row for each distinct span of either side, with tp, fp, fn as 0 or 1."""
    g = gold.select(*SPAN).distinct().withColumn("__cw_g", F.lit(1))
    p = pred.select(*SPAN).distinct().withColumn("__cw_p", F.lit(1))
    both = g.join(p, SPAN, "full_outer")
    in_gold, in_pred = F.col("__cw_g").isNotNull(), F.col("__cw_p").isNotNull()
    return both.select(
        *SPAN,
        (in_gold & in_pred).cast("bigint").alias("tp"),
        (~in_gold & in_pred).cast("bigint").alias("fp"),
        (in_gold & ~in_pred).cast("bigint").alias("fn"),
    )


def leaked(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold spans that no prediction of their case, of any type, contains."""
    g, p = gold.select(*SPAN).distinct().alias("g"), pred.select(*CASE, "start", "end").distinct().alias("p")
    same = (F.col("g.dataset") == F.col("p.dataset")) & (F.col("g.case_id") == F.col("p.case_id"))
    inside = (F.col("p.start") <= F.col("g.start")) & (F.col("p.end") >= F.col("g.end"))
    return g.join(p, same & inside, "left_anti")


def scored(counts: DataFrame) -> DataFrame:
    """Adds support, precision, recall, f1, f2 and the leakage rate to tp, fp, fn and leaked."""
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (
        counts.withColumns({"support": F.col("tp") + F.col("fn"), "precision": precision, "recall": recall})
        .withColumns({"f1": f_beta(F.col("precision"), F.col("recall"), 1), "f2": f_beta(F.col("precision"), F.col("recall"), 2)})
        .withColumn("leakage_rate", ratio(F.col("leaked"), F.col("support")))
    )


def entity_metrics(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Metrics by (dataset, entity_type); a null type is all types, the dataset ``combined`` all datasets.

    One detection serves every level: spans are joined once and rolled up by grouping sets.
    """
    marks = outcomes(gold, pred)
    lost = leaked(gold, pred).withColumn("leaked", F.lit(1).cast("bigint"))
    each = marks.join(lost, SPAN, "left").withColumn("leaked", F.coalesce("leaked", F.lit(0)))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "leaked")]
    level = F.grouping_id("dataset", "entity_type").alias("level")
    levels = each.cube("dataset", "entity_type").agg(level, *sums)
    named = levels.withColumn("dataset", F.when(F.col("level") >= 2, "combined").otherwise(F.col("dataset"))).drop("level")
    return scored(named)


def token_rows(cases: DataFrame) -> DataFrame:
    """(dataset, case_id, token_no, start, end): white-space tokens of each case."""
    each = cases.select(*CASE, F.posexplode_outer(tokens(F.coalesce("text", F.lit("")))).alias("token_no", "t")).where("t is not null")
    return each.select(*CASE, "token_no", "t.start", "t.end")


def _labels(cases_tokens: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    t, s = cases_tokens.alias("t"), spans.select(*CASE, "entity_type", "start", "end").distinct().alias("s")
    same = (F.col("t.dataset") == F.col("s.dataset")) & (F.col("t.case_id") == F.col("s.case_id"))
    over = (F.col("s.start") < F.col("t.end")) & (F.col("t.start") < F.col("s.end"))
    return t.join(s, same & over).groupBy("t.dataset", "t.case_id", "t.token_no").agg(F.sort_array(F.collect_set("s.entity_type")).alias(name))


def token_accuracy(cases: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(dataset, correct, n_tokens, token_accuracy); the dataset ``combined`` is all of them.

    A token that no span touches is right, so all tokens are only counted; those of cases with a
    span are laid out and compared.
    """
    key = [*CASE, "token_no"]
    touched = gold.select(*CASE).union(pred.select(*CASE)).distinct()
    each = token_rows(cases.join(touched, CASE, "left_semi"))
    nothing = F.array().cast("array<string>")
    labelled = _labels(each, gold, "g").join(_labels(each, pred, "p"), key, "full_outer")
    wrong = labelled.where(F.coalesce("g", nothing) != F.coalesce("p", nothing)).groupBy(*CASE).agg(F.count("*").alias("wrong"))
    counted = cases.select(*CASE, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("bigint").alias("n"))
    both = counted.join(wrong, CASE, "left").withColumn("wrong", F.coalesce("wrong", F.lit(0)))
    levels = both.rollup("dataset").agg(F.sum(F.col("n") - F.col("wrong")).alias("correct"), F.sum("n").alias("n_tokens"))
    named = levels.withColumn("dataset", F.coalesce("dataset", F.lit("combined"))).na.fill(0, ["correct", "n_tokens"])
    return named.withColumn("token_accuracy", ratio(F.col("correct"), F.col("n_tokens")))


def render_report(metrics: Sequence, accuracy: Sequence, order: Sequence[str]) -> str:
    """Markdown from collected metric rows: a bounded number of rows, one a dataset and type."""
    tokens_of = {r["dataset"]: r for r in accuracy}
    lines = ["# Detection evaluation", "", "A span counts as found when type and offsets are exactly right. Token accuracy", "compares the labels of white-space tokens; leakage counts annotated spans that no", "prediction covers."]
    for dataset in [*order, "combined"]:
        mine = [r for r in metrics if r["dataset"] == dataset]
        whole = next((r for r in mine if r["entity_type"] is None), None)
        if whole is None:
            continue
        token = tokens_of.get(dataset)
        lines += ["", f"## {dataset.replace('_', ' ').title()}", "", "| Measure | Value |", "|---|---:|"]
        lines += [
            f"| TP / FP / FN | {whole['tp']} / {whole['fp']} / {whole['fn']} |",
            f"| Support | {whole['support']} |",
            *(f"| {name.title()} | {whole[name]:.4f} |" for name in ("precision", "recall", "f1", "f2")),
            f"| Token accuracy | {token['token_accuracy'] if token else 0.0:.4f} |",
            f"| Residual leakage | {whole['leaked']} / {whole['support']} ({whole['leakage_rate']:.4f}) |",
            "",
            "| Entity type | Support | TP | FP | FN | Precision | Recall | F1 | F2 | Leakage |",
            "|---|---:|---:|---:|---:|---:|---:|---:|---:|---:|",
        ]
        for r in sorted((r for r in mine if r["entity_type"] is not None), key=lambda r: r["entity_type"]):
            ratios = " | ".join(f"{r[name]:.4f}" for name in ("precision", "recall", "f1", "f2"))
            lines.append(f"| {r['entity_type']} | {r['support']} | {r['tp']} | {r['fp']} | {r['fn']} | {ratios} | {r['leaked']} |")
    return "\n".join([*lines, ""])
