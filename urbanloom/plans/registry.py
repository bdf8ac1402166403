"""Named datasets with checked arguments, methods added to DataFrames, and their registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import MISSING, dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_DATASETS: dict[str, Dataset] = {}
_METHODS: dict[str, Callable[..., DataFrame]] = {}


def checked_bounds(bounds: Sequence[float]) -> tuple[float, ...]:
    """Four or six numbers, lows strictly below highs; ValueError otherwise."""
    values = tuple(float(v) for v in bounds)
    if len(values) not in (4, 6):
        raise ValueError("bounds must have 4 or 6 numbers")
    half = len(values) // 2
    if any(a >= b for a, b in zip(values[:half], values[half:], strict=True)):
        raise ValueError("the low bounds must be below the high bounds")
    return values


@dataclass(frozen=True)
class Dataset:
    """A dataset: a name, a dataclass of its arguments, and what builds it."""

    name: str
    arguments: type
    build: Callable[[SparkSession, Any], DataFrame]
    text: str = ""

    def __call__(self, spark: SparkSession, **given: Any) -> DataFrame:
        unknown = set(given) - {f.name for f in fields(self.arguments)}
        if unknown:
            raise ValueError(f"{self.name} has no argument {', '.join(sorted(unknown))}")
        if "bounds" in given:
            given["bounds"] = checked_bounds(given["bounds"])
        return self.build(spark, self.arguments(**given))

    def options(self) -> dict[str, dict[str, Any]]:
        """Type and default of every argument."""
        return {f.name: {"type": str(f.type), "required": f.default is MISSING and f.default_factory is MISSING, "default": None if f.default is MISSING else f.default} for f in fields(self.arguments)}


def register(dataset: Dataset) -> Dataset:
    if not dataset.name:
        raise ValueError("a dataset needs a name")
    _DATASETS[dataset.name] = dataset
    return dataset


def unregister(name: str) -> None:
    if name not in _DATASETS:
        raise KeyError(name)
    del _DATASETS[name]


def get(name: str) -> Dataset:
    if name not in _DATASETS:
        raise KeyError(f"no dataset {name}; there are {', '.join(sorted(_DATASETS))}")
    return _DATASETS[name]


def datasets() -> dict[str, Dataset]:
    return dict(_DATASETS)


def as_view(spark: SparkSession, name: str, **given: Any) -> None:
    """The dataset as a temporary view of its name, for SQL."""
    get(name)(spark, **given).createOrReplaceTempView(name)


def method(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Register a function of a DataFrame by its name, for apply()."""
    _METHODS[function.__name__] = function
    return function


def apply(df: DataFrame, name: str, *args: Any, **kwargs: Any) -> DataFrame:
    return df.transform(_METHODS[name], *args, **kwargs)
