"""Models for pipelines: fit(train) gives an object whose transform(df) adds a prediction column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspan.operators.mf_kmeans import centroid_distances
from driftspan.operators.metrics import decision_score, probability_score

PREDICTION, SCORE = "prediction", "ood_score"


@dataclass(frozen=True)
class MajorityModel:
    """Predicts the most frequent label, ties to the smallest."""

    target: str
    label: object = None

    def fit(self, train: DataFrame) -> MajorityModel:
        top = train.groupBy(self.target).count().orderBy(F.col("count").desc(), F.col(self.target).asc()).limit(1).collect()
        return MajorityModel(self.target, top[0][0] if top else None)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, F.lit(self.label))


@dataclass(frozen=True)
class ThresholdModel:
    """Predicts whether a feature exceeds the training rows' mean."""

    feature: str
    threshold: float | None = None

    def fit(self, train: DataFrame) -> ThresholdModel:
        return ThresholdModel(self.feature, train.agg(F.avg(self.feature)).first()[0])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, (F.col(self.feature) > F.lit(self.threshold)).cast("int"))


@dataclass(frozen=True)
class NearestCentroidModel:
    """Predicts the class of the nearest mean, ties to the smallest class; the score is the distance to it."""

    features: tuple[str, ...]
    target: str
    classes: tuple = ()
    centroids: tuple[tuple[float, ...], ...] = ()

    def fit(self, train: DataFrame) -> NearestCentroidModel:
        means = train.groupBy(self.target).agg(*(F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(self.features))).orderBy(self.target).collect()  # a row a class
        return NearestCentroidModel(self.features, self.target, tuple(r[0] for r in means), tuple(tuple(r[1:]) for r in means))

    def transform(self, df: DataFrame) -> DataFrame:
        d = centroid_distances(F.array(*(F.col(f).cast("double") for f in self.features)), [list(c) for c in self.centroids])
        classes = F.array(*(F.lit(c) for c in self.classes))
        nearest = F.array_position(d, F.array_min(d)).cast("int")
        return df.withColumn(PREDICTION, F.element_at(classes, nearest)).withColumn(SCORE, F.sqrt(F.array_min(d)))


class MLModel:
    """A pyspark.ml classifier or regressor over named feature columns.

    The out-of-distribution score is 1 - the largest probability, else the raw score of two classes.
    """

    def __init__(self, estimator: Estimator, features: list[str], target: str, fitted: Model | None = None):
        self.estimator, self.features, self.target, self.fitted = estimator, features, target, fitted

    def _assembled(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="__features", handleInvalid="keep").transform(df)

    def fit(self, train: DataFrame) -> MLModel:
        estimator = self.estimator.copy({self.estimator.featuresCol: "__features", self.estimator.labelCol: "__label"})
        rows = self._assembled(train).withColumn("__label", F.col(self.target).cast("double"))
        return MLModel(self.estimator, self.features, self.target, estimator.fit(rows))

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.fitted.transform(self._assembled(df))
        made = {}
        if "probability" in out.columns:
            made[SCORE] = probability_score(vector_to_array("probability"))
        elif "rawPrediction" in out.columns:
            made[SCORE] = decision_score(vector_to_array("rawPrediction"))
        keep = [*df.columns, PREDICTION]
        return out.withColumns(made).select(*keep, *made) if made else out.select(*keep)
