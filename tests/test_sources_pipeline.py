from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from driftspan.operators.metrics import MetricsEvaluator
from driftspan.operators.shifts import FeatureStratificationShift
from driftspan.operators.split import TrainTestSplitter
from driftspan.plans.models import MajorityModel, MLModel, NearestCentroidModel, ThresholdModel
from driftspan.plans.pipeline import ShiftPipeline
from driftspan.sources.config import instantiate, load_callable
from driftspan.sources.datasets import CallableDataset, CSVDataset, ParquetDataset, project_path, with_row_id
from driftspan.streaming.scoring import regions, score_batches


def flowers():
    r = np.random.default_rng(0)
    return SimpleNamespace(data=r.normal(size=(30, 4)), feature_names=["a", "b", "c", "d"], target=[i % 3 for i in range(30)])


def write_csv(path, n, first):
    lines = [",price,class"] + [f"{first + i},{'NA' if i == 1 else i / 2},{i % 2}" for i in range(n)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_splits(spark, tmp_path):
    paths = {"source": write_csv(tmp_path / "s.csv", 9, 0), "target": write_csv(tmp_path / "t.csv", 7, 100)}
    data = CSVDataset(spark, paths, "class", "power")
    df = data.load()
    assert df.count() == 16 and data.features == ["unnamed_0", "price"]
    assert {n: s.count() for n, s in data.splits().items()} == {"source": 9, "target": 7}
    assert {r["split_name"]: r["n_rows"] for r in data.summary().collect()} == {"source": 9, "target": 7}
    data.print_summary()
    with pytest.raises(ValueError, match="Target column 'none' not found in split 'source'"):
        CSVDataset(spark, paths, "none").load()
    with pytest.raises(ValueError, match="not found in dataset"):
        CSVDataset(spark, paths["source"], "none").load()
    with pytest.raises(ValueError):
        CSVDataset(spark, 5, "class")


def test_parquet_and_callable(spark, tmp_path):
    spark.range(5).withColumn("y", F.lit(1)).write.parquet(str(tmp_path / "p"))
    assert ParquetDataset(spark, tmp_path / "p", "y").load().count() == 5
    data = CallableDataset(spark, flowers, "flowers")
    assert data.load().count() == 30 and data.features == ["a", "b", "c", "d"] and set(data.feature_types.values()) == {"double"}
    ids = [r["row_id"] for r in with_row_id(data.load()).collect()]
    assert sorted(ids) == list(range(30))


def test_config(spark):
    data = instantiate({"_target_": "callable", "loader": f"{__name__}.flowers", "name": "f"}, spark)
    assert data.load().count() == 30
    assert instantiate('{"_target_": "preprocessor", "scaling": "minmax"}').scaling == "minmax"
    assert load_callable("math.sqrt")(4) == 2
    for bad in ({}, {"_target_": "nothing"}):
        with pytest.raises(ValueError):
            instantiate(bad)
    assert project_path()


def test_pipelines(spark):
    r = np.random.default_rng(0)
    rows = [(i, float(x), float(i % 2 + r.normal(0, 0.2)), i % 2) for i, x in enumerate(r.random(300))]
    df = spark.createDataFrame(rows, "row_id long, place double, signal double, y int").cache()
    strategy = FeatureStratificationShift(["place"], "row_id", 3)
    splitter = TrainTestSplitter("row_id", "y", 2, 0.6, 0.5, (0, 1), (2,), seed=1)
    for model, least in ((NearestCentroidModel(("signal",), "y"), 0.9), (ThresholdModel("signal"), 0.9), (MajorityModel("y"), 0.3), (MLModel(LogisticRegression(), ["signal"], "y"), 0.9)):
        found = ShiftPipeline(model, strategy, splitter, MetricsEvaluator()).run(df)
        metrics = found.collect()
        assert metrics.id_metrics["accuracy"] >= least and metrics.ood_metrics["accuracy"] >= least
        assert ("auroc" in metrics.global_metrics) == hasattr(model, "classes") or isinstance(model, MLModel)
        assert found.counts().count() >= 3


def test_stream_regions(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS row_id", "CAST(id AS double) AS x")
    df.write.parquet(str(tmp_path / "in"))
    bins = FeatureStratificationShift(["x"], "row_id", 4).bins(df)
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = score_batches(stream, [lambda b: regions(b, bins)], lambda b, n: seen.extend(r["partition_id"] for r in b.collect()), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert sorted(seen) == sorted([0] * 25 + [1] * 25 + [2] * 25 + [3] * 25)
