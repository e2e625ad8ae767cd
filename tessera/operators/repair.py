"""Repairs: filters, replacements and complex repairers, declared on a Clean and applied by kind.

A Clean's filters are one conjunction; its replacements are one projection in which every column is computed from the
old row, the first matching replacement of a column winning and substring rewrites applying where none matches; then
the complex repairers run in order.  Statistics that replacements need are one aggregate over the unfiltered data.
"""

from __future__ import annotations

import enum
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..exceptions import TransformError
from ..functions import patterns
from ..functions.patterns import EMAIL, URL
from .analyzers import as_tuple


class Way(enum.Enum):
    FIXED = "fixed"
    MAX = "max"
    MIN = "min"
    MEAN = "mean"
    MEDIAN = "median"
    MODE = "mode"
    FORWARD = "forward"
    BACKWARD = "backward"


_NUMERIC_WAYS = {"max", "min", "mean", "median"}


class KeepType(enum.Enum):
    DEFAULT = "default"
    FIRST = "first"
    LAST = "last"


def _value(x: Any) -> Any:
    return getattr(x, "value", x)


def need(schema: T.StructType, column: str, kind: str | None = None) -> None:
    if column not in schema.names:
        raise TransformError(f"no column {column}")
    t = schema[column].dataType
    if kind == "numeric" and not isinstance(t, T.NumericType):
        raise TransformError(f"{column} is {t.simpleString()}, not numeric")
    if kind == "string" and not isinstance(t, T.StringType):
        raise TransformError(f"{column} is {t.simpleString()}, not a string")


def interval(column: str, lower: float | None, lower_closed: bool, upper: float | None, upper_closed: bool) -> Column:
    c, parts = F.col(column), []
    if lower is None and upper is None:
        raise TransformError("a range needs a bound")
    if lower is not None:
        parts.append(c >= lower if lower_closed else c > lower)
    if upper is not None:
        parts.append(c <= upper if upper_closed else c < upper)
    return parts[0] if len(parts) == 1 else parts[0] & parts[1]


@dataclass(frozen=True)
class Filter:
    """Keeps rows where the condition is true; a null condition drops the row in filters and droppers alike."""

    condition: Callable[[], Column]
    column: str | None = None
    kind: str | None = None

    def check(self, schema: T.StructType) -> None:
        if self.column is not None:
            need(schema, self.column, self.kind)


@dataclass(frozen=True)
class Replacer:
    column: str
    condition: Callable[[], Column]
    way: str
    value: Any = None
    kind: str | None = None

    def check(self, schema: T.StructType) -> None:
        need(schema, self.column, "numeric" if self.way in _NUMERIC_WAYS else self.kind)
        if self.way not in {w.value for w in Way}:
            raise TransformError(f"unknown way {self.way!r}")
        if self.way == "fixed" and self.value is None:
            raise TransformError("a fixed replacement needs a value")

    def statistic(self) -> Column | None:
        c = F.col(self.column)
        return {"max": F.max(c), "min": F.min(c), "mean": F.avg(c), "median": F.percentile_approx(c, 0.5, 100), "mode": F.mode(c, True)}.get(self.way)


@dataclass(frozen=True)
class SubReplacer:
    """Rewrites a string column where no replacement of the column matches."""

    column: str
    rewrite: Callable[[Column], Column]

    def check(self, schema: T.StructType) -> None:
        need(schema, self.column, "string")


@dataclass(frozen=True)
class Complex:
    apply: Callable[[DataFrame], DataFrame]
    columns: tuple[str, ...] = ()
    fd: tuple[tuple[str, ...], tuple[float, ...]] | None = None

    def check(self, schema: T.StructType) -> None:
        for c in self.columns:
            need(schema, c)


class Clean:
    def __init__(self, description: str, transformers: Iterable[Any] = (), *, index_col: str = "id") -> None:
        self.description = description
        self.transformers = list(transformers)
        self.index_col = index_col  # order of forward and backward replacements

    def _add(self, t: Any) -> Clean:
        self.transformers.append(t)
        return self

    # filters
    def _filter(self, condition: Callable[[], Column], column: str | None = None, kind: str | None = None) -> Clean:
        return self._add(Filter(condition, column, kind))

    def drop_null(self, column):
        return self._filter(lambda: F.col(column).isNotNull(), column)

    def filter_by_exp(self, exp_str):
        return self._filter(lambda: F.expr(exp_str))

    def drop_by_exp(self, exp_str):
        return self._filter(lambda: ~F.expr(exp_str))

    def filter_positive(self, column):
        return self.filter_by_lower_bound(column, 0, False)

    def filter_non_negative(self, column):
        return self.filter_by_lower_bound(column, 0, True)

    def filter_by_lower_bound(self, column, lower_bound, lower_closed):
        return self.filter_by_range(column, lower_bound, lower_closed, None, False)

    def filter_by_upper_bound(self, column, upper_bound, upper_closed):
        return self.filter_by_range(column, None, False, upper_bound, upper_closed)

    def filter_by_range(self, column, lower_bound, lower_closed, upper_bound, upper_closed):
        return self._filter(lambda: interval(column, lower_bound, lower_closed, upper_bound, upper_closed), column, "numeric")

    def drop_by_range(self, column, lower_bound, lower_closed, upper_bound, upper_closed):
        return self._filter(lambda: ~interval(column, lower_bound, lower_closed, upper_bound, upper_closed), column, "numeric")

    def filter_by_values(self, column, values):
        return self._filter(lambda: F.col(column).cast("string").isin([str(v) for v in values]), column)

    def drop_by_values(self, column, values):
        return self._filter(lambda: ~F.col(column).cast("string").isin([str(v) for v in values]), column)

    def filter_by_data_type(self, column, data_type):
        return self._filter(lambda: patterns.is_type(F.col(column), _value(data_type)), column)

    def drop_by_data_type(self, column, data_type):
        return self._filter(lambda: ~patterns.is_type(F.col(column), _value(data_type)), column)

    def filter_by_pattern(self, column, pattern):
        return self._filter(lambda: F.col(column).rlike(pattern), column, "string")

    def drop_by_pattern(self, column, pattern):
        return self._filter(lambda: ~F.col(column).rlike(pattern), column, "string")

    def filter_by_begin(self, column, begin_str):
        return self.filter_by_pattern(column, f"^{begin_str}")

    def drop_by_begin(self, column, begin_str):
        return self.drop_by_pattern(column, f"^{begin_str}")

    def filter_by_end(self, column, end_str):
        return self.filter_by_pattern(column, f"{end_str}$")

    def drop_by_end(self, column, end_str):
        return self.drop_by_pattern(column, f"{end_str}$")

    def filter_by_sub_str(self, column, sub_str):
        return self.filter_by_pattern(column, f"({sub_str})")

    def drop_by_sub_str(self, column, sub_str):
        return self.drop_by_pattern(column, f"({sub_str})")

    def filter_url(self, column):
        return self.filter_by_pattern(column, URL)

    def filter_email(self, column):
        return self.filter_by_pattern(column, EMAIL)

    # replacements
    def _replace(self, column: str, condition: Callable[[], Column], way: Any, value: Any, kind: str | None = None) -> Clean:
        return self._add(Replacer(column, condition, _value(way), value, kind))

    def fill_null(self, column, way, value=None):
        return self._replace(column, lambda: F.col(column).isNull(), way, value)

    def replace_by_exp(self, column, exp, way, value=None):
        return self._replace(column, lambda: F.expr(exp), way, value)

    def replace_non_positive(self, column, way, value=None):
        return self.replace_by_range(column, None, False, 0, True, way, value)

    def replace_negative(self, column, way, value=None):
        return self.replace_by_range(column, None, False, 0, False, way, value)

    def replace_by_range(self, column, lower_bound, lower_closed, upper_bound, upper_closed, way, value=None):
        return self._replace(column, lambda: interval(column, lower_bound, lower_closed, upper_bound, upper_closed), way, value, "numeric")

    def replace_by_values(self, column, values, way, value=None):
        return self._replace(column, lambda: F.col(column).cast("string").isin([str(v) for v in values]), way, value)

    def replace_by_excluded_values(self, column, excluded_values, way, value=None):
        return self._replace(column, lambda: ~F.col(column).cast("string").isin([str(v) for v in excluded_values]), way, value)

    def replace_by_data_type(self, column, data_type, way, value=None):
        return self._replace(column, lambda: patterns.is_type(F.col(column), _value(data_type)), way, value)

    def replace_by_excluded_data_type(self, column, data_type, way, value=None):
        return self._replace(column, lambda: ~patterns.is_type(F.col(column), _value(data_type)), way, value)

    def replace_by_pattern(self, column, pattern, way, value=None):
        return self._replace(column, lambda: F.col(column).rlike(pattern), way, value, "string")

    def replace_by_excluded_pattern(self, column, pattern, way, value=None):
        return self._replace(column, lambda: ~F.col(column).rlike(pattern), way, value, "string")

    def replace_non_url(self, column, way, value=None):
        return self.replace_by_excluded_pattern(column, URL, way, value)

    def replace_non_email(self, column, way, value=None):
        return self.replace_by_excluded_pattern(column, EMAIL, way, value)

    def replace_by_sub_pattern(self, column, sub_pattern, value):
        return self._add(SubReplacer(column, lambda c: F.regexp_replace(c, sub_pattern, value)))

    def extract_by_sub_pattern(self, column, sub_pattern):
        return self._add(SubReplacer(column, lambda c: F.regexp_extract(c, sub_pattern, 0)))

    # complex repairers
    def drop_duplicates(self, column_or_columns, keep="default", order_by="id"):
        columns, keep = as_tuple(column_or_columns), _value(keep)
        if keep not in {k.value for k in KeepType}:
            raise TransformError(f"unknown way to keep rows {keep!r}")
        return self._add(Complex(lambda df: deduplicate(df, columns, keep, order_by), columns if keep == "default" else (*columns, order_by)))

    def extract_entities(self, column_or_columns, index_col="id", **params):
        from . import entities

        columns = as_tuple(column_or_columns)
        return self._add(Complex(lambda df: entities.resolve(df, columns, index_col=index_col, **params), (*columns, index_col)))

    def repair_by_fd(self, cfd_or_cfds, index_col="id", priorities=()):
        cfds = as_tuple(cfd_or_cfds)
        return self._add(Complex(lambda df: df, (), (cfds, tuple(priorities) or (1.0,) * len(cfds))))

    def impute_null(self, column, dependent_column_or_columns, allowed_values=(), index_col="id"):
        from . import impute

        dependents = as_tuple(dependent_column_or_columns)
        return self._add(Complex(lambda df: impute.naive_bayes(df, column, dependents, allowed_values=tuple(allowed_values), index_col=index_col), (column, *dependents, index_col)))

    def drop_outliers(self, column_or_columns, model, model_params=None, index_col="id"):
        from . import outliers

        columns = as_tuple(column_or_columns)
        return self._add(Complex(lambda df: outliers.solver(_value(model), columns, model_params, index_col=index_col).remove(df), columns))

    def replace_outliers(self, column_or_columns, model, model_params=None, value_or_values=None, index_col="id"):
        from . import outliers

        columns = as_tuple(column_or_columns)
        values = tuple(value_or_values) if isinstance(value_or_values, (list, tuple)) else (value_or_values,) * len(columns)
        return self._add(Complex(lambda df: outliers.solver(_value(model), columns, model_params, index_col=index_col).replace(df, values), columns))


def deduplicate(df: DataFrame, columns: tuple[str, ...], keep: str, order_by: str) -> DataFrame:
    """One row per key.  First and last compare (order_by, all columns), so that ties have one outcome; the rows are reduced
    by aggregation, which combines on the map side: a hot key is never sorted in one task."""
    if keep == "default":
        return df.dropDuplicates(list(columns))
    fields = [f.name for f in df.schema.fields]
    comparable = [f.name for f in df.schema.fields if not _has_map(f.dataType)]
    order = F.struct(F.col(order_by).alias("__o"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(comparable)])
    pick = F.min_by if keep == "first" else F.max_by
    row = F.struct(*[F.col(c) for c in fields])
    return df.groupBy(*columns).agg(pick(row, order).alias("__row")).select(*[F.col("__row")[c].alias(c) for c in fields])


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.MapType):
        return True
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    return isinstance(t, T.StructType) and any(_has_map(f.dataType) for f in t.fields)


def fill_ordered(df: DataFrame, wanted: dict[str, tuple[str, str]], index_col: str) -> DataFrame:
    """Adds, for each name, the last non-null value of a column before the row (forward) or the next after it (backward), by
    the index's order.

    Rows are range-partitioned by the index; each partition's windows run alone, and the value at its border comes from
    a small table of the partitions' own last and first values, so no task ever sees all rows.
    """
    from .ordered import carry

    return carry(df, wanted, index_col)


def stored_statistics(context: Any) -> dict[tuple[str, str], Any]:
    """Statistics for replacements from metrics without a where."""
    from . import analyzers as a

    ways = {a.Maximum: "max", a.Minimum: "min", a.Mean: "mean"}
    return {(x.column, ways[type(x)]): m.value for x, m in context.metrics.items() if type(x) in ways and x.where is None and m.is_success}


def apply(df: DataFrame, transformers: list[Any], index_col: str = "id", known: dict[tuple[str, str], Any] | None = None) -> DataFrame:
    """``known``: statistics {(column, way): value} that need not be computed."""
    for t in transformers:
        try:
            t.check(df.schema)
        except Exception as e:  # noqa: BLE001
            raise TransformError.wrap(e) from e
    filters = [t for t in transformers if isinstance(t, Filter)]
    replacers = [t for t in transformers if isinstance(t, (Replacer, SubReplacer))]
    hard = [t for t in transformers if isinstance(t, Complex)]
    try:
        order = df.columns
        stats, statistic = dict(known or {}), {}
        for t in replacers:
            if isinstance(t, Replacer) and (t.column, t.way) not in stats and (s := t.statistic()) is not None:
                statistic[(t.column, t.way)] = s
        if statistic:
            row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(statistic.values())]).first()
            stats |= dict(zip(statistic, row, strict=True))
        moved = {f"__{t.way}_{t.column}": (t.column, t.way) for t in replacers if isinstance(t, Replacer) and t.way in ("forward", "backward")}
        for f in filters:
            df = df.where(f.condition())
        if moved:
            need(df.schema, index_col)
            df = fill_ordered(df, moved, index_col)
        columns = {}
        for c in dict.fromkeys(t.column for t in replacers):
            kind, case, rest = df.schema[c].dataType, F, F.col(c)
            for t in (t for t in replacers if t.column == c):
                if isinstance(t, SubReplacer):
                    rest = t.rewrite(rest)
                    continue
                if t.way in ("forward", "backward"):
                    new = F.col(f"__{t.way}_{c}")
                else:
                    new = F.lit(t.value if t.way == "fixed" else stats[(c, t.way)]).cast(kind)
                case = case.when(t.condition(), new)
            columns[c] = rest if case is F else case.otherwise(rest)
        df = df.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in order])
        fds = [t.fd for t in hard if t.fd]
        for t in hard:
            if t.fd is None:
                df = t.apply(df)
            elif t.fd is fds[0]:  # all dependencies of a Clean are repaired together
                from . import dependencies

                df = dependencies.repair(df, [c for cs, _ in fds for c in cs], priorities=[p for _, ps in fds for p in ps])
    except Exception as e:  # noqa: BLE001
        raise TransformError.wrap(e) from e
    return df


class RepairRunBuilder:
    def __init__(self, data: DataFrame) -> None:
        self.data = data
        self.cleans: list[Clean] = []
        self.known: dict[tuple[str, str], Any] = {}

    def load_state_with(self, provider: Any) -> RepairRunBuilder:
        """Replacement statistics of a StateProvider's data are taken from there."""
        self.known = stored_statistics(provider.compute())
        return self

    def add_clean(self, clean: Clean) -> RepairRunBuilder:
        self.cleans.append(clean)
        return self

    def add_cleans(self, cleans: Iterable[Clean]) -> RepairRunBuilder:
        self.cleans += cleans
        return self

    def run(self) -> DataFrame:
        df = self.data
        for c in self.cleans:
            df = apply(df, c.transformers, c.index_col, self.known)
        return df


class RepairSuite:
    @staticmethod
    def on_data(data: DataFrame) -> RepairRunBuilder:
        return RepairRunBuilder(data)


