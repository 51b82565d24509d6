"""Scoring of streams with what was fitted on a table: bins, a preprocessor, a model. No state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftspan.operators.shifts import PARTITION


def regions(stream: DataFrame, bins: dict[str, Column]) -> DataFrame:
    """The stream with a region column per fitted bin expression and partition_id, their combination in mixed radix.

    Bins come from FeatureStratificationShift.bins of the reference table.
    """
    out = stream.withColumns({f"region_{f}": b for f, b in bins.items()})
    return out.withColumn(PARTITION, F.struct(*(F.col(f"region_{f}") for f in bins)) if len(bins) > 1 else F.col(f"region_{next(iter(bins))}"))


def windowed_counts(stream: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each region per event-time window; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), F.col(PARTITION)).agg(F.count("*").alias("n"))


def score_batches(stream: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies fitted transforms to each micro-batch and hands it to sink; runs until the input is used up."""

    def each(batch: DataFrame, number: int) -> None:
        for step in steps:
            batch = step(batch)
        sink(batch, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
