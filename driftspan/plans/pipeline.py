"""The evaluation pipeline: partitions, split, fit, predict, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspan.operators.metrics import MetricsEvaluator, MetricsResult
from driftspan.operators.shifts import ShiftStrategy
from driftspan.operators.split import TrainTestSplitter, split_counts
from driftspan.plans.models import PREDICTION, SCORE


@dataclass(frozen=True)
class PipelineResult:
    """Lazy frames, the fitted model, and the metrics as rows (scope, metric, value)."""

    model: object
    split: DataFrame
    predictions: DataFrame
    metrics: DataFrame

    def counts(self) -> DataFrame:
        return split_counts(self.split)

    def release(self) -> None:
        """Lets go of the persisted split; frames read after that work it out anew."""
        self.split.unpersist()

    def collect(self) -> MetricsResult:
        return MetricsEvaluator.collect(self.metrics)


@dataclass(frozen=True)
class ShiftPipeline:
    """The rows of df must be unique by the splitter's row_id."""

    model: object
    strategy: ShiftStrategy
    splitter: TrainTestSplitter
    metrics: MetricsEvaluator

    def run(self, df: DataFrame, validate: bool = True) -> PipelineResult:
        """Actions: partition sizes, strata sizes, the fit; predictions and metrics stay lazy.

        The split is persisted (memory, then disk), for the fit, the predictions and each metric read it.
        """
        assigned = self.strategy.assign(df)
        if validate:
            self.strategy.validate(assigned)
        split = self.splitter.split(assigned).persist()
        fitted = self.model.fit(split.where(F.col("role") == "train"))
        predictions = fitted.transform(split.where(F.col("role") == "test"))
        score = SCORE if SCORE in predictions.columns else None
        return PipelineResult(fitted, split, predictions, self.metrics.evaluate(predictions, self.splitter.target, PREDICTION, score=score))
