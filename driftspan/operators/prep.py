"""Imputing, one-hot encoding and scaling: fitted by aggregates, applied as literals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALINGS = ("standard", "minmax", None)
STRATEGIES = ("mean", "median", "most_frequent", "constant", None)
#: Most categories of a column; they become columns.
MAX_CATEGORIES = 1000


def _numeric(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]


def _present(c: str, kind: T.DataType) -> Column:
    """The value, with NaN as null."""
    return F.when(~F.isnan(F.col(c)), F.col(c)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c)


@dataclass(frozen=True)
class PreprocessorModel:
    """Fitted state: fill values, categories in order, and (shift, divisor) of scaled columns."""

    features: list[str]
    fills: dict[str, object] = field(default_factory=dict)
    categories: dict[str, list] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)

    def encoded(self, df: DataFrame) -> dict[str, Column]:
        """Expressions of the features, imputed and encoded."""
        out: dict[str, Column] = {}
        for c in self.features:
            kind = df.schema[c].dataType
            x = _present(c, kind)
            if c in self.fills and self.fills[c] is not None:
                if isinstance(kind, T.NumericType):
                    x = x.cast("double")
                x = F.coalesce(x, F.lit(self.fills[c]))
            if c in self.categories:
                for v in self.categories[c]:
                    out[f"{c}_{v}"] = x.eqNullSafe(F.lit(v)).cast("double")
            else:
                out[c] = x
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """df's other columns, then the features; unseen categories are all zeros."""
        out = self.encoded(df)
        for c, (shift, divisor) in self.scales.items():
            out[c] = (out[c].cast("double") - F.lit(shift)) / F.lit(divisor)
        others = [c for c in df.columns if c not in self.features]
        return df.select(*others, *(x.alias(c) for c, x in out.items()))


class Preprocessor:
    """impute, then encode, then scale. Numeric columns take the numeric strategy, all others their most frequent value.

    Null and NaN are missing. One-hot columns are numeric and so are scaled too, unless scale_onehot is False.
    """

    def __init__(self, scaling: str | None = "standard", encoding: str | None = "onehot", impute_strategy: str | None = "mean", fill_value: object = 0, scale_onehot: bool = True):
        if scaling not in SCALINGS:
            raise ValueError(f"Unknown scaling: {scaling}")
        if impute_strategy not in STRATEGIES:
            raise ValueError(f"Unknown impute strategy: {impute_strategy}")
        if encoding not in ("onehot", None):
            raise ValueError(f"Unknown encoding: {encoding}")
        self.scaling, self.encoding, self.impute_strategy, self.fill_value, self.scale_onehot = scaling, encoding, impute_strategy, fill_value, scale_onehot

    def _fills(self, df: DataFrame, features: list[str]) -> dict[str, object]:
        if self.impute_strategy is None:
            return {}
        numeric = _numeric(df, features)
        if self.impute_strategy == "constant":
            return {c: self.fill_value if c in numeric else str(self.fill_value) for c in features}
        modal = features if self.impute_strategy == "most_frequent" else [c for c in features if c not in numeric]
        stats = {"mean": F.avg, "median": lambda x: F.percentile(x, 0.5)}
        out: dict[str, object] = {}
        direct = [c for c in numeric if c not in modal]
        if direct:
            row = df.agg(*(stats[self.impute_strategy](_present(c, df.schema[c].dataType).cast("double")).alias(c) for c in direct)).first()
            out |= {c: row[c] for c in direct}
        for c in modal:  # ties: the smallest value
            counts = df.select(_present(c, df.schema[c].dataType).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
            top = counts.orderBy(F.col("n").desc(), F.col("v").asc()).limit(1).collect()
            out[c] = top[0]["v"] if top else None
        return out

    def _categories(self, df: DataFrame, features: list[str], model: PreprocessorModel) -> dict[str, list]:
        if self.encoding is None:
            return {}
        out = {}
        for c in features:
            if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType)):
                x = model.encoded(df)[c]
                found = [r[0] for r in df.select(x.alias("v")).distinct().limit(MAX_CATEGORIES + 1).collect()]
                if len(found) > MAX_CATEGORIES:
                    raise ValueError(f"column '{c}' has more than {MAX_CATEGORIES} categories")
                out[c] = sorted((v for v in found if v is not None), key=str) + [None] * (None in found)
        return out

    def fit(self, df: DataFrame, features: list[str]) -> PreprocessorModel:
        """Fill values from one aggregate, categories from one distinct a column, scales from one more aggregate."""
        model = PreprocessorModel(features, self._fills(df, features))
        model = PreprocessorModel(features, model.fills, self._categories(df, features, model))
        if self.scaling is None:
            return model
        encoded = model.encoded(df)
        made = {f"{c}_{v}" for c, vs in model.categories.items() for v in vs}
        scaled = [c for c in encoded if (c in made and self.scale_onehot) or (c not in made and isinstance(df.schema[c].dataType, T.NumericType))]
        if not scaled:
            return model
        x = [F.when(~F.isnan(encoded[c].cast("double")), encoded[c].cast("double")) for c in scaled]
        pairs = [(F.avg(v), F.stddev_pop(v)) if self.scaling == "standard" else (F.min(v), F.max(v) - F.min(v)) for v in x]
        row = df.agg(*(e.alias(f"s{i}_{j}") for i, p in enumerate(pairs) for j, e in enumerate(p))).first()
        scales = {c: (row[f"s{i}_0"] or 0.0, row[f"s{i}_1"] or 1.0) for i, c in enumerate(scaled)}
        return PreprocessorModel(features, model.fills, model.categories, scales)

    def fit_transform(self, df: DataFrame, features: list[str]) -> tuple[PreprocessorModel, DataFrame]:
        model = self.fit(df, features)
        return model, model.transform(df)
