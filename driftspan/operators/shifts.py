"""Shift strategies: each adds a partition_id to every row."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspan.functions.binning import right_closed_bin
from driftspan.functions.ranking import draw, rank_by_value

PARTITION = "partition_id"


class ShiftStrategy(ABC):
    """Subclasses implement assign(); ids of n_partitions and beyond are allowed and left out by partitions()."""

    def __init__(self, name: str | None = None, n_partitions: int = 2, seed: int = 0):
        self.name = name or type(self).__name__
        self.n_partitions = max(2, n_partitions)
        self.seed = seed

    @abstractmethod
    def assign(self, df: DataFrame) -> DataFrame:
        """df with an int column partition_id."""

    def sizes(self, df: DataFrame) -> DataFrame:
        """(partition_id, n) of an assigned table, ids from 0 to n_partitions - 1 only."""
        return df.where(F.col(PARTITION).between(0, self.n_partitions - 1)).groupBy(PARTITION).agg(F.count("*").alias("n"))

    def validate(self, assigned: DataFrame) -> dict[int, int]:
        """Rows of each partition; ValueError if one of 0 to n_partitions - 1 is empty. One aggregate."""
        found = {r[0]: r[1] for r in self.sizes(assigned).collect()}  # n_partitions rows at most
        empty = [i for i in range(self.n_partitions) if i not in found]
        if empty:
            raise ValueError(f"{self.name}: partitions {empty} are empty.")
        return found

    def partitions(self, df: DataFrame) -> dict[int, DataFrame]:
        """Validated partitions as filtered views of the assigned table."""
        assigned = self.assign(df)
        return {i: assigned.where(F.col(PARTITION) == i) for i in sorted(self.validate(assigned))}


def first_appearance_ids(df: DataFrame, keys: list[str], row_id: str, out: str) -> DataFrame:
    """df with ids of distinct key tuples, numbered by their least row_id; null is a value of its own.

    Bin numbers make few tuples, which one window numbers; strings may make many, which are
    ranked in ranges of the least row_id (if that is a number).
    """
    groups = df.groupBy(*keys).agg(F.min(row_id).alias("__first"))
    many = any(isinstance(df.schema[k].dataType, T.StringType) for k in keys) and isinstance(df.schema[row_id].dataType, T.NumericType)
    number = F.col("__number") if many else F.row_number().over(Window.orderBy("__first"))
    groups = rank_by_value(groups, "__first", out="__number") if many else groups
    groups = groups.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), (number - 1).cast("int").alias(out))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(groups, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))


class FeatureStratificationShift(ShiftStrategy):
    """Partitions by equal-width bins of numeric features and values of all others, combined."""

    def __init__(self, features: list[str], row_id: str, n_partitions: int = 2, name: str | None = None, seed: int = 0):
        if not features:
            raise ValueError("At least one feature is needed.")
        super().__init__(name, n_partitions, seed)
        self.features, self.row_id = list(features), row_id

    def bins(self, df: DataFrame) -> dict[str, Column]:
        """Bin expressions of the numeric features, from one aggregate over all of them."""
        for f in self.features:
            if f not in df.columns:
                raise ValueError(f"Feature '{f}' not in DataFrame columns")
        numeric = [f for f in self.features if isinstance(df.schema[f].dataType, T.NumericType)]
        if not numeric:
            return {}
        stats = []
        for i, f in enumerate(numeric):
            x = F.col(f).cast("double")
            stats += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.sum((x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)).cast("int")).alias(f"bad{i}")]
        row = df.agg(*stats).first()
        out = {}
        for i, f in enumerate(numeric):
            if row[f"bad{i}"]:
                raise ValueError(f"Feature '{f}' has missing or infinite values")
            out[f] = F.lit(0) if row[f"lo{i}"] is None else right_closed_bin(F.col(f).cast("double"), row[f"lo{i}"], row[f"hi{i}"], self.n_partitions)
        return out

    def assign(self, df: DataFrame) -> DataFrame:
        bins = self.bins(df)
        keys = {f"__s{i}": bins.get(f, F.col(f)) for i, f in enumerate(self.features)}
        return first_appearance_ids(df.withColumns(keys), list(keys), self.row_id, PARTITION).drop(*keys)


class NewClassShift(ShiftStrategy):
    """Partitions by the target's integer value."""

    def __init__(self, target: str, n_classes: int, name: str | None = None, seed: int = 0):
        super().__init__(name, n_classes, seed)
        self.target = target

    def assign(self, df: DataFrame) -> DataFrame:
        kind, y = df.schema[self.target].dataType, F.col(self.target)
        if isinstance(kind, T.StringType):
            bad = y.isNull() | ~y.rlike(r"^\s*[+-]?\d+\s*$")
            value = F.trim(y).cast("int")
        elif isinstance(kind, T.BooleanType):
            bad, value = y.isNull(), y.cast("int")
        elif isinstance(kind, T.NumericType):
            x = y.cast("double")
            bad = y.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
            value = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")  # toward zero
        else:
            raise ValueError(f"Target '{self.target}' cannot be read as integers")
        if df.where(bad).limit(1).count():
            raise ValueError(f"Target '{self.target}' has values that are no integers")
        return df.withColumn(PARTITION, value)


class RandomPartitionShift(ShiftStrategy):
    """Partitions at random, fixed by the seed and the row id."""

    def __init__(self, row_id: str, n_partitions: int = 2, name: str | None = None, seed: int = 0):
        super().__init__(name, n_partitions, seed)
        self.row_id = row_id

    def assign(self, df: DataFrame) -> DataFrame:
        number = F.conv(F.substring(draw(self.seed, self.row_id), 1, 8), 16, 10).cast("bigint")
        return df.withColumn(PARTITION, F.pmod(number, F.lit(self.n_partitions)).cast("int"))
