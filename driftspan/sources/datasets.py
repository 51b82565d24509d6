"""Datasets: tables with a target, optionally made of named splits."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = "split_name"


def project_path() -> str:
    """The repository's root."""
    return str(Path(__file__).resolve().parents[2])


def rename_blank(df: DataFrame, to: str = "unnamed") -> DataFrame:
    """Names for columns whose header is blank, which Spark calls _c0, _c1 and so on."""
    return df.toDF(*(f"{to}_{c[2:]}" if c.startswith("_c") and c[2:].isdigit() else c for c in df.columns))


def with_row_id(df: DataFrame, name: str = "row_id", order: list[str] | None = None) -> DataFrame:
    """A unique bigint by position, for tables without a key. Write the result before using it twice."""
    if order:
        df = df.orderBy(*order)
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    part = F.shiftright("__place", 33).alias("__part")  # the task's number, above its rows' numbers
    sizes = placed.groupBy(part).agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("__part").alias("__of"), before.alias("__before"))  # a row a task
    numbered = placed.withColumn("__part", part).join(F.broadcast(offsets), F.col("__part") == F.col("__of"))
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select(*df.columns, (within + F.col("__before")).alias(name))


class Dataset(ABC):
    """load() returns one DataFrame with the target as a column, and split_name if the source has named splits."""

    def __init__(self, spark: SparkSession, target: str, name: str | None = None):
        self.spark, self.target, self.name = spark, target, name or type(self).__name__
        self.data: DataFrame | None = None

    @abstractmethod
    def load(self) -> DataFrame: ...

    @property
    def features(self) -> list[str]:
        return [c for c in self._loaded().columns if c not in (self.target, SPLIT)]

    @property
    def feature_types(self) -> dict[str, str]:
        kinds = dict(self._loaded().dtypes)
        return {c: kinds[c] for c in self.features}

    def _loaded(self) -> DataFrame:
        if self.data is None:
            self.data = self.load()
        return self.data

    def splits(self) -> dict[str, DataFrame]:
        """The named splits as filtered views, in order of name."""
        df = self._loaded()
        if SPLIT not in df.columns:
            return {}
        names = sorted(r[0] for r in df.select(SPLIT).distinct().collect())
        return {n: df.where(F.col(SPLIT) == n) for n in names}

    def summary(self) -> DataFrame:
        """(name, split_name, n_rows, n_features, feature_types) a split, or one row without splits; types as "name:type" in order."""
        df = self._loaded()
        split = F.col(SPLIT) if SPLIT in df.columns else F.lit(None).cast("string")
        counts = df.groupBy(split.alias(SPLIT)).agg(F.count("*").alias("n_rows"))
        types = ",".join(f"{c}:{kind}" for c, kind in self.feature_types.items())
        return counts.select(F.lit(self.name).alias("name"), SPLIT, "n_rows", F.lit(len(self.features)).alias("n_features"), F.lit(types).alias("feature_types"))

    def print_summary(self) -> None:
        rows = self.summary().collect()
        print(f"{self.name}: {sum(r['n_rows'] for r in rows)} rows, {len(self.features)} features")
        print("types:", self.feature_types)
        if SPLIT in self._loaded().columns:
            print("splits:", ", ".join(sorted(r[SPLIT] for r in rows)))


class FileDataset(Dataset):
    """path: one path, or a dict of split name to path."""

    def __init__(self, spark: SparkSession, path: str | Path | dict, target: str, name: str | None = None, schema: T.StructType | str | None = None, **options: object):
        super().__init__(spark, target, name)
        if not isinstance(path, (str, Path, dict)):
            raise ValueError("path must be a string, a Path or a dict of split names to paths")
        self.path, self.schema, self.options = path, schema, options

    def read(self, path: str) -> DataFrame:
        raise NotImplementedError

    def _checked(self, df: DataFrame, where: str) -> DataFrame:
        if self.target not in df.columns:
            raise ValueError(f"Target column '{self.target}' not found in {where}")
        return df

    def load(self) -> DataFrame:
        if not isinstance(self.path, dict):
            self.data = self._checked(self.read(str(self.path)), "dataset")
        else:
            parts = [self._checked(self.read(str(p)), f"split '{n}'").withColumn(SPLIT, F.lit(n)) for n, p in self.path.items()]
            self.data = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return self.data


#: What the usual readers of such files take as missing.
NULL_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "<NA>")


class CSVDataset(FileDataset):
    def read(self, path: str) -> DataFrame:
        reader = self.spark.read.option("header", True).options(**self.options)
        reader = reader.schema(self.schema) if self.schema else reader.option("inferSchema", True)
        df = rename_blank(reader.csv(path))
        text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        return df.withColumns({c: F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)) for c in text}) if text else df


class ParquetDataset(FileDataset):
    def read(self, path: str) -> DataFrame:
        return (self.spark.read.schema(self.schema) if self.schema else self.spark.read).options(**self.options).parquet(path)


class CallableDataset(Dataset):
    """loader: a callable without arguments whose result has data (rows), feature_names and target."""

    def __init__(self, spark: SparkSession, loader: Callable, name: str | None = None, target: str | None = None):
        super().__init__(spark, target or "target", name)
        self.loader = loader

    def load(self) -> DataFrame:
        import pandas as pd

        found = self.loader()
        frame = pd.DataFrame(found.data, columns=list(found.feature_names))
        frame[self.target] = list(found.target)
        self.data = self.spark.createDataFrame(frame)
        return self.data


