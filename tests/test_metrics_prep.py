import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspan.functions import divergence
from driftspan.operators.metrics import MetricsEvaluator, auroc, f1_weighted, fpr_at_tpr, roc_points
from driftspan.operators.prep import Preprocessor


def value(df):
    return df.first()["value"]


def test_evaluate(spark):
    df = spark.createDataFrame([(1, 1, False, 0.1), (1, 0, False, 0.4), (0, 0, True, 0.35), (0, 0, True, 0.8)], "y int, p int, is_ood boolean, s double")
    found = MetricsEvaluator.collect(MetricsEvaluator().evaluate(df, "y", "p", score="s"))
    assert found.id_metrics == {"accuracy": 0.5} and found.ood_metrics == {"accuracy": 1.0}
    assert found.global_metrics == {"auroc": 0.75, "fpr@95tpr": 0.5}
    regression = MetricsEvaluator.collect(MetricsEvaluator("regression").evaluate(df.where("NOT is_ood"), "y", "p"))
    assert regression.id_metrics == {"rmse": math.sqrt(0.5), "mae": 0.5} and regression.ood_metrics == {}
    with pytest.raises(ValueError):
        MetricsEvaluator("ranking")


def test_tied_scores_drop_collinear_points(spark):
    df = spark.createDataFrame([(float(s), b) for s in range(20) for b in (True, False)], "s double, pos boolean")
    points = roc_points(df, "s", F.col("pos"))
    assert value(fpr_at_tpr(points)) == 1.0 and value(auroc(points)) == 0.5
    assert points.where("kept").count() == 2


def test_auroc_equals_pairs(spark):
    r = np.random.default_rng(0)
    s, y = r.integers(0, 400, 3000), r.random(3000) < 0.3
    points = roc_points(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y, strict=True)], "s double, pos boolean"), "s", F.col("pos"))
    pos, neg = s[y], s[~y]
    pairs = (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2
    assert abs(value(auroc(points)) - pairs) < 1e-12


def test_one_class_is_undefined(spark):
    points = roc_points(spark.createDataFrame([(1.0, True)], "s double, pos boolean"), "s", F.col("pos"))
    assert value(auroc(points)) is None and value(fpr_at_tpr(points)) is None


def test_f1(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    assert abs(value(f1_weighted(df, "y", "p")) - (0.5 * 2 + 2 / 3 + 0) / 4) < 1e-12


def test_divergences_equal_numpy(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(0, 1, 500), r.normal(0.5, 1, 300)
    df = spark.createDataFrame([(float(x), False) for x in a] + [(float(x), True) for x in b], "x double, ood boolean")
    p, edges = np.histogram(a, 20, density=True)
    q, _ = np.histogram(b, edges, density=True)

    def kl(u, v):
        u, v = (u + 1e-12) / (u + 1e-12).sum(), (v + 1e-12) / (v + 1e-12).sum()
        return (u * np.log(u / v)).sum()

    m = (p + q) / 2
    for method, want in (("kl", kl(p, q)), ("js", (kl(p, m) + kl(q, m)) / 2)):
        assert abs(value(divergence.histogram_divergence(df, "x", F.col("ood"), method=method)) - want) < 1e-9
    with pytest.raises(ValueError):
        divergence.histogram_divergence(df, "x", F.col("ood"), method="tv")
    assert value(divergence.histogram_divergence(df.where("NOT ood"), "x", F.col("ood"))) is None


def test_scalers(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 2.0, 5.0), (2, 4.0, 5.0)], "row_id long, x double, c double")
    standard = Preprocessor("standard").fit_transform(df, ["x", "c"])[1].orderBy("row_id").collect()
    x = np.array([1, 2, 4.0])
    assert np.allclose([r["x"] for r in standard], (x - x.mean()) / x.std()) and [r["c"] for r in standard] == [0, 0, 0]
    small = Preprocessor("minmax").fit_transform(df, ["x", "c"])[1].orderBy("row_id").collect()
    assert np.allclose([r["x"] for r in small], (x - 1) / 3) and [r["c"] for r in small] == [0, 0, 0]


def test_impute_encode_and_transform(spark):
    df = spark.createDataFrame([(0, 1.0, "b"), (1, None, "a"), (2, float("nan"), None), (3, 4.0, "a")], "row_id long, x double, s string")
    model, out = Preprocessor(None, impute_strategy="median").fit_transform(df, ["x", "s"])
    rows = out.orderBy("row_id").collect()
    assert [r["x"] for r in rows] == [1.0, 2.5, 2.5, 4.0]
    assert [(r["s_a"], r["s_b"]) for r in rows] == [(0, 1), (1, 0), (1, 0), (1, 0)]
    new = model.transform(spark.createDataFrame([(9, None, "z")], "row_id long, x double, s string")).first()
    assert (new["x"], new["s_a"], new["s_b"]) == (2.5, 0.0, 0.0)
    scaled = Preprocessor("standard").fit_transform(df, ["x", "s"])[1].agg(F.avg("s_a")).first()[0]
    assert abs(scaled) < 1e-12
    with pytest.raises(ValueError):
        Preprocessor("robust")
    with pytest.raises(ValueError):
        Preprocessor(impute_strategy="knn")
