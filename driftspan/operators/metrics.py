"""Predictive metrics by scope and metrics of out-of-distribution detection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.functions.ranking import range_bounds, range_number

TASKS = ("classification", "regression")


def accuracy(y: Column, predicted: Column) -> Column:
    return F.avg(y.eqNullSafe(predicted).cast("double"))


def rmse(y: Column, predicted: Column) -> Column:
    d = y.cast("double") - predicted.cast("double")
    return F.sqrt(F.avg(d * d))


def mae(y: Column, predicted: Column) -> Column:
    return F.avg(F.abs(y.cast("double") - predicted.cast("double")))


def f1_weighted(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """One row (value): F1 of each class by its confusion counts, weighted by true support."""
    pairs = df.groupBy(F.col(y).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("y").eqNullSafe(F.col("p")), F.col("n")).otherwise(0).alias("tp"))
    sides = sides.unionByName(pairs.select(F.col("p").alias("c"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("tp")))
    per = sides.groupBy("c").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return per.agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("value"))


def roc_points(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(score, p, n, tp, fp, kept): positives and negatives of each distinct score and of it and higher ones.

    kept drops the points between two collinear neighbours. Running totals are taken within
    ranges of the score and offset by the ranges' totals, so no single task sees all scores.
    """
    rows = df.select(F.col(score).cast("double").alias("score"), positive.alias("pos")).where("score IS NOT NULL AND NOT isnan(score) AND pos IS NOT NULL")
    counts = rows.groupBy("score").agg(F.sum(F.col("pos").cast("bigint")).alias("p"), F.sum((~F.col("pos")).cast("bigint")).alias("n"))
    bounds = range_bounds(rows, "score")
    ranged = counts.withColumn("r", range_number("score", bounds, "double"))
    per = ranged.groupBy("r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"), F.max(F.struct("score", "p", "n")).alias("top"))
    above = Window.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    below = Window.orderBy(F.col("r").desc())
    per = per.select(
        "r",
        F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"),
        F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"),
        F.lead("top").over(below).alias("next_top"),
        F.sum("rp").over(Window.partitionBy()).alias("all_p"),
        F.sum("rn").over(Window.partitionBy()).alias("all_n"),
    )
    joined = ranged.join(F.broadcast(per), "r")  # RANGES rows at most
    within = Window.partitionBy("r").orderBy(F.col("score").desc())
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    next_p = F.coalesce(F.lead("p").over(within), F.col("next_top.p"))
    next_n = F.coalesce(F.lead("n").over(within), F.col("next_top.n"))
    points = joined.select(
        "score", "p", "n", (F.sum("p").over(running) + F.col("bp")).alias("tp"), (F.sum("n").over(running) + F.col("bn")).alias("fp"), next_p.alias("next_p"), next_n.alias("next_n"), "all_p", "all_n"
    )
    first = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("n"))
    kept = first | F.col("next_p").isNull() | (F.col("next_p") != F.col("p")) | (F.col("next_n") != F.col("n"))
    return points.withColumn("kept", kept)


def _defined(value: Column) -> Column:
    """value where both classes occur, else null."""
    return F.when((F.max("all_p") > 0) & (F.max("all_n") > 0), value)


def _auroc() -> Column:
    area = F.sum(F.col("n") * ((F.col("tp") - F.col("p")) + F.col("p") / 2.0))
    return _defined(F.try_divide(area, F.max("all_p").cast("double") * F.max("all_n")))


def _fpr_at_tpr(level: float) -> Column:
    tpr, fpr = F.try_divide("tp", "all_p"), F.try_divide("fp", "all_n")
    return _defined(F.coalesce(F.min(F.when(F.col("kept") & (tpr >= level), fpr)), F.max(fpr)))


def auroc(points: DataFrame) -> DataFrame:
    """One row (value) from roc_points; null if a class is missing."""
    return points.agg(_auroc().alias("value"))


def fpr_at_tpr(points: DataFrame, level: float = 0.95) -> DataFrame:
    """One row (value): the false-positive rate of the first kept point whose true-positive rate reaches level, else of the last."""
    return points.agg(_fpr_at_tpr(level).alias("value"))


def detection_metrics(points: DataFrame) -> DataFrame:
    """(metric, value) of auroc and fpr@95tpr from one pass over roc_points."""
    both = points.agg(_auroc().alias("auroc"), _fpr_at_tpr(0.95).alias("fpr"))
    return both.selectExpr("stack(2, 'auroc', auroc, 'fpr@95tpr', fpr) AS (metric, value)")


def probability_score(probabilities: Column) -> Column:
    """1 - the largest class probability of an array column."""
    return 1 - F.array_max(probabilities)


def decision_score(raw: Column) -> Column:
    """The raw score of the second of two classes."""
    return F.element_at(raw, 2).cast("double")


@dataclass(frozen=True)
class MetricsResult:
    id_metrics: dict[str, float]
    ood_metrics: dict[str, float]
    global_metrics: dict[str, float]


class MetricsEvaluator:
    def __init__(self, task: str = "classification"):
        if task not in TASKS:
            raise ValueError(f"Unknown task: {task}")
        self.task = task

    def evaluate(self, df: DataFrame, y: str, predicted: str, is_ood: str = "is_ood", score: str | None = None) -> DataFrame:
        """(scope, metric, value): id and ood scopes that have rows, and with score the global detection metrics."""
        a, b = F.col(y), F.col(predicted)
        per = {"accuracy": accuracy(a, b)} if self.task == "classification" else {"rmse": rmse(a, b), "mae": mae(a, b)}
        by = df.groupBy(F.when(F.col(is_ood), "ood").otherwise("id").alias("scope")).agg(*(v.alias(k) for k, v in per.items()))
        pairs = ", ".join(f"'{k}', {k}" for k in per)
        out = by.selectExpr("scope", f"stack({len(per)}, {pairs}) AS (metric, value)")
        if score is not None:
            found = detection_metrics(roc_points(df, score, F.col(is_ood)))
            out = out.unionByName(found.select(F.lit("global").alias("scope"), "metric", "value"))
        return out

    @staticmethod
    def collect(long: DataFrame) -> MetricsResult:
        """A few rows of evaluate() as dictionaries."""
        found: dict[str, dict] = {"id": {}, "ood": {}, "global": {}}
        for r in long.collect():
            found[r["scope"]][r["metric"]] = r["value"]
        return MetricsResult(found["id"], found["ood"], found["global"])
