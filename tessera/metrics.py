"""Metrics and the values they hold."""

from __future__ import annotations

import enum
import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .exceptions import AnalysisError


class Entity(enum.Enum):
    DATASET = "DataSet"
    COLUMN = "Column"
    MULTICOLUMN = "Multicolumn"


class DataType(enum.Enum):
    """Content types of string columns, and what a column can be asked to hold."""

    UNKNOWN = "Unknown"
    FRACTIONAL = "Fractional"
    INTEGRAL = "Integral"
    BOOLEAN = "Boolean"
    STRING = "String"


class ConstrainableDataType(enum.Enum):
    NULL = "null"
    FRACTIONAL = "fractional"
    INTEGRAL = "integral"
    BOOLEAN = "boolean"
    STRING = "string"
    NUMERIC = "numeric"


@dataclass(frozen=True)
class DistributionValue:
    absolute: int
    ratio: float


@dataclass(frozen=True)
class Distribution:
    values: dict[str, DistributionValue]
    number_of_bins: int

    def __getitem__(self, key: str) -> DistributionValue:
        return self.values[key]


@dataclass(frozen=True)
class Violation:
    const_vio: int
    var_vio: int

    def __bool__(self) -> bool:
        return bool(self.const_vio or self.var_vio)


@dataclass(frozen=True)
class Violations:
    """{dependency: {pattern: {attribute: Violation}}}"""

    values: dict[str, dict[str, dict[str, Violation]]]

    def flat(self) -> Iterable[tuple[str, str, str, Violation]]:
        for cfd, patterns in self.values.items():
            for pattern, attributes in patterns.items():
                for attribute, v in attributes.items():
                    yield cfd, pattern, attribute, v

    def any(self) -> bool:
        return any(v for *_, v in self.flat())


@dataclass(frozen=True)
class Metric:
    """Value of an analyzer on some data, or the error that kept it from having one."""

    name: str
    entity: Entity
    instance: str
    value: Any = None
    error: Exception | None = field(default=None, compare=False)

    @property
    def is_success(self) -> bool:
        return self.error is None

    def flatten(self) -> list[tuple[str, str, str, float]]:
        """Rows (entity, instance, name, number)."""
        row = lambda suffix, x: (self.entity.value, self.instance, self.name + suffix, float(x))
        v = self.value
        if not self.is_success:
            return []
        if isinstance(v, Distribution):
            out = [row(".bins", v.number_of_bins)]
            for k, d in v.values.items():
                out += [row(f".abs.{k}", d.absolute), row(f".ratio.{k}", d.ratio)]
            return out
        if isinstance(v, Violations):
            return [r for c, p, a, x in v.flat() for r in (row(f".{c}.{p}.{a}.const", x.const_vio), row(f".{c}.{p}.{a}.var", x.var_vio))]
        if isinstance(v, dict):
            return [row(f".{k}", x) for k, x in v.items()]
        try:
            return [row("", v)]
        except (TypeError, ValueError):
            return []  # a mode that is no number


def failed(name: str, entity: Entity, instance: str, error: Exception) -> Metric:
    return Metric(name, entity, instance, None, error if isinstance(error, AnalysisError) else AnalysisError(f"{type(error).__name__}: {error}"))


def text(value: Any) -> str:
    if isinstance(value, float) and math.isfinite(value) and value == int(value) and abs(value) < 1e15:
        return f"{value:.1f}"
    return str(value)


def metrics_df(spark: SparkSession, metrics: Iterable[Metric]) -> DataFrame:
    rows = [(m.name, m.instance, text(m.value)) for m in metrics if m.is_success]
    return spark.createDataFrame(rows, "name string, instance string, value string")
