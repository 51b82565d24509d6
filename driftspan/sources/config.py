"""Objects from dictionaries: {"_target_": name, argument: value, ...}."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from driftspan.operators.prep import Preprocessor
from driftspan.sources.datasets import CallableDataset, CSVDataset, Dataset, ParquetDataset

REGISTRY: dict[str, Callable] = {"csv": CSVDataset, "parquet": ParquetDataset, "callable": CallableDataset, "preprocessor": Preprocessor}


def load_callable(dotted: str) -> Callable:
    """The object at package.module.name."""
    module, _, name = dotted.rpartition(".")
    if not module:
        raise ValueError(f"'{dotted}' is not a dotted name")
    found = getattr(importlib.import_module(module), name)
    if not callable(found):
        raise ValueError(f"'{dotted}' is not callable")
    return found


def instantiate(config: dict | str, spark: SparkSession | None = None) -> object:
    """Builds what _target_ names (a registered name or a dotted one); a loader given as text is resolved too."""
    config = json.loads(config) if isinstance(config, str) else dict(config)
    name = config.pop("_target_", None)
    if name is None:
        raise ValueError("the configuration has no _target_")
    target = REGISTRY.get(name) or load_callable(name)
    if isinstance(config.get("loader"), str):
        config["loader"] = load_callable(config["loader"])
    if isinstance(target, type) and issubclass(target, Dataset):
        config["spark"] = spark or SparkSession.active()
    return target(**config)
