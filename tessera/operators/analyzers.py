"""Analyzers: descriptions of metrics.

A *scan* analyzer is a set of mergeable partial aggregates; all scan analyzers of a run share one ``df.agg``.  The same
partials, stored as a row, can be merged with those of other data (``merges``) and finished into the metric, which is
how incremental runs work.  A *grouping* analyzer needs a frequency table, shared by all that group by the same
columns.  The rest (``Outliers``, ``FunctionalDependency``, ``Entities``) runs operators of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..exceptions import EmptyStateError, IllegalParameterError, NoSuchColumnError, RuntimeAnalysisError, WrongTypeError
from ..functions import patterns
from ..metrics import Distribution, DistributionValue, Entity, Metric, failed

NULL_VALUE = "NullValue"
MAX_BINS = 1000


def as_tuple(columns: str | list[str] | tuple[str, ...]) -> tuple[str, ...]:
    return (columns,) if isinstance(columns, str) else tuple(columns)


def selected(c: Column, where: str | None) -> Column:
    return c if where is None else F.when(F.expr(where), c)


def counted(where: str | None) -> Column:
    return F.count(F.lit(1)) if where is None else F.count_if(F.expr(where))


def number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


@dataclass(frozen=True)
class Analyzer:
    entity: ClassVar[Entity] = Entity.COLUMN

    @property
    def name(self) -> str:
        return type(self).__name__

    @property
    def columns(self) -> tuple[str, ...]:
        c = getattr(self, "column", ())
        return as_tuple(c)

    @property
    def instance(self) -> str:
        return ",".join(self.columns) or "*"

    #: None: any type; else the check the columns' types must pass and its name.
    needs: ClassVar[str | None] = None

    def precondition(self, schema: T.StructType) -> Exception | None:
        for c in self.columns:
            if c not in schema.names:
                return NoSuchColumnError(f"no column {c}")
            kind = schema[c].dataType
            if self.needs == "numeric" and not isinstance(kind, T.NumericType):
                return WrongTypeError(f"{c} is {kind.simpleString()}, not numeric")
            if self.needs == "string" and not isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
                return WrongTypeError(f"{c} is {kind.simpleString()}, not a string")
        return None

    def success(self, value: Any) -> Metric:
        return Metric(self.name, self.entity, self.instance, value)

    def failure(self, error: Exception) -> Metric:
        return failed(self.name, self.entity, self.instance, error)

    def finished(self, row: dict[str, Any]) -> Metric:
        try:
            value = self.finish(row)  # type: ignore[attr-defined]
        except Exception as e:  # noqa: BLE001 - reported as the metric's error
            return self.failure(e)
        return self.failure(EmptyStateError(f"{self.name} has no value: no rows")) if value is None else self.success(value)


# --- scan analyzers -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ScanAnalyzer(Analyzer):
    def partials(self) -> dict[str, Column]:
        raise NotImplementedError

    def merges(self) -> dict[str, Column]:
        """Merged partials from a table of partials; sums unless said otherwise."""
        return {k: F.sum(k) for k in self.partials()}

    def finish(self, row: dict[str, Any]) -> Any:
        raise NotImplementedError


@dataclass(frozen=True)
class Size(ScanAnalyzer):
    where: str | None = None
    entity: ClassVar[Entity] = Entity.DATASET

    def partials(self):
        return {"n": counted(self.where)}

    def finish(self, row):
        return float(row["n"])


@dataclass(frozen=True)
class _Ratio(ScanAnalyzer):
    def hit(self) -> Column:
        raise NotImplementedError

    def partials(self):
        return {"hits": F.count_if(selected(self.hit(), self.where)), "n": counted(self.where)}

    def finish(self, row):
        return row["hits"] / row["n"] if row["n"] else 0.0


@dataclass(frozen=True)
class Completeness(_Ratio):
    column: str | tuple[str, ...]
    where: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "column", tuple(sorted(as_tuple(self.column))))

    @property
    def entity(self):
        return Entity.COLUMN if len(self.columns) == 1 else Entity.MULTICOLUMN

    def hit(self):
        out = F.lit(True)
        for c in self.columns:
            out = out & F.col(c).isNotNull()
        return out


@dataclass(frozen=True)
class Compliance(_Ratio):
    label: str
    predicate: str
    where: str | None = None
    columns_used: tuple[str, ...] = ()

    @property
    def columns(self):
        return self.columns_used

    @property
    def instance(self):
        return self.label

    def hit(self):
        return F.expr(self.predicate)


@dataclass(frozen=True)
class PatternMatch(_Ratio):
    column: str
    pattern: str
    where: str | None = None
    needs: ClassVar[str | None] = "string"

    def hit(self):
        return patterns.matches(F.col(self.column), self.pattern)


@dataclass(frozen=True)
class _Single(ScanAnalyzer):
    """One aggregate of one column."""

    column: str
    where: str | None = None
    needs: ClassVar[str | None] = "numeric"

    def picked(self) -> Column:
        return selected(F.col(self.column), self.where)

    def finish(self, row):
        return None if row["x"] is None else float(row["x"])


@dataclass(frozen=True)
class Minimum(_Single):
    def partials(self):
        return {"x": F.min(self.picked()).cast("double")}

    def merges(self):
        return {"x": F.min("x")}


@dataclass(frozen=True)
class Maximum(_Single):
    def partials(self):
        return {"x": F.max(self.picked()).cast("double")}

    def merges(self):
        return {"x": F.max("x")}


@dataclass(frozen=True)
class Sum(_Single):
    def partials(self):
        return {"x": F.sum(number(self.picked()))}


@dataclass(frozen=True)
class MinLength(_Single):
    needs: ClassVar[str | None] = "string"

    def partials(self):
        return {"x": F.min(F.length(self.picked())).cast("double")}

    def merges(self):
        return {"x": F.min("x")}


@dataclass(frozen=True)
class MaxLength(_Single):
    needs: ClassVar[str | None] = "string"

    def partials(self):
        return {"x": F.max(F.length(self.picked())).cast("double")}

    def merges(self):
        return {"x": F.max("x")}


@dataclass(frozen=True)
class Mean(_Single):
    def partials(self):
        return {"total": F.sum(number(self.picked())), "n": F.count(self.picked())}

    def finish(self, row):
        return row["total"] / row["n"] if row["n"] else None


def _fold(parts: Column, merge) -> Column:  # noqa: ANN001
    """Merges structs pair by pair; parts without rows (n = 0) are left out."""
    kept = F.filter(parts, lambda s: s["n"] > 0)
    return F.when(F.size(kept) > 0, F.reduce(F.slice(kept, 2, 1 << 30), F.get(kept, F.lit(0)), merge))


@dataclass(frozen=True)
class StandardDeviation(_Single):
    """Population standard deviation."""

    def partials(self):
        x = number(self.picked())
        n = F.count(x)
        return {"m": F.struct(n.alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("avg"), F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("m2"))}

    def merges(self):
        def merge(a, b):
            n, d = a["n"] + b["n"], b["avg"] - a["avg"]
            return F.struct(n.alias("n"), (a["avg"] + d * b["n"] / n).alias("avg"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

        return {"m": _fold(F.collect_list("m"), merge)}

    def finish(self, row):
        m = row["m"]
        return math.sqrt(m["m2"] / m["n"]) if m and m["n"] else None


@dataclass(frozen=True)
class Correlation(ScanAnalyzer):
    first: str
    second: str
    where: str | None = None
    needs: ClassVar[str | None] = "numeric"
    entity: ClassVar[Entity] = Entity.MULTICOLUMN

    def __post_init__(self):
        a, b = sorted((self.first, self.second))
        object.__setattr__(self, "first", a)
        object.__setattr__(self, "second", b)

    @property
    def columns(self):
        return (self.first, self.second)

    def partials(self):
        both = F.col(self.first).isNotNull() & F.col(self.second).isNotNull()
        x, y = (selected(F.when(both, number(c)), self.where) for c in self.columns)
        n = F.count(x)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return {"m": F.struct(n.alias("n"), zero(F.avg(x)).alias("xa"), zero(F.avg(y)).alias("ya"), zero(F.covar_pop(x, y) * n).alias("ck"), zero(F.var_pop(x) * n).alias("xm"), zero(F.var_pop(y) * n).alias("ym"))}

    def merges(self):
        def merge(a, b):
            n, dx, dy = a["n"] + b["n"], b["xa"] - a["xa"], b["ya"] - a["ya"]
            w = a["n"] * b["n"] / n
            return F.struct(n.alias("n"), (a["xa"] + dx * b["n"] / n).alias("xa"), (a["ya"] + dy * b["n"] / n).alias("ya"), (a["ck"] + b["ck"] + dx * dy * w).alias("ck"), (a["xm"] + b["xm"] + dx * dx * w).alias("xm"), (a["ym"] + b["ym"] + dy * dy * w).alias("ym"))

        return {"m": _fold(F.collect_list("m"), merge)}

    def finish(self, row):
        m = row["m"]
        if not m or not m["n"]:
            return None
        spread = math.sqrt(m["xm"] * m["ym"])
        return m["ck"] / spread if spread else float("nan")


@dataclass(frozen=True)
class ApproxCountDistinct(_Single):
    """HyperLogLog with a relative standard deviation of 0.05; the stored partial is a mergeable sketch."""

    needs: ClassVar[str | None] = None

    def partials(self):
        return {"x": F.approx_count_distinct(self.picked(), 0.05)}

    def sketch(self) -> dict[str, Column]:
        return {"sketch": F.hll_sketch_agg(self.picked().cast("string"))}

    def merges(self):
        return {"x": F.hll_sketch_estimate(F.hll_union_agg("sketch"))}

    def merged_sketch(self) -> dict[str, Column]:
        return {"sketch": F.hll_union_agg("sketch")}


@dataclass(frozen=True)
class ApproxQuantile(ScanAnalyzer):
    """{str(q): value} for one or several quantiles; stored as a mergeable KLL sketch."""

    column: str
    quantiles: float | tuple[float, ...]
    relative_error: float = 0.01
    where: str | None = None
    needs: ClassVar[str | None] = "numeric"

    def __post_init__(self):
        q = self.quantiles
        object.__setattr__(self, "quantiles", (float(q),) if isinstance(q, (int, float)) else tuple(float(x) for x in q))

    def precondition(self, schema):
        if not all(0 <= q <= 1 for q in self.quantiles):
            return IllegalParameterError("quantiles must lie in [0, 1]")
        if self.relative_error < 0:
            return IllegalParameterError("relative error must not be negative")
        return super().precondition(schema)

    @property
    def accuracy(self) -> int:
        return min(2_000_000_000, math.ceil(1 / self.relative_error)) if self.relative_error > 0 else 2_000_000_000

    def shared(self) -> tuple:
        """Quantile requests with equal keys are answered by one aggregate."""
        return self.column, self.relative_error, self.where

    def aggregate(self, quantiles: tuple[float, ...]) -> Column:
        x = selected(number(self.column), self.where)
        return F.percentile_approx(x, list(quantiles), self.accuracy)

    def partials(self):
        return {"q": self.aggregate(self.quantiles)}

    def sketch(self) -> dict[str, Column]:
        return {"sketch": F.kll_sketch_agg_double(selected(number(self.column), self.where))}

    def merges(self):
        one = F.kll_merge_agg_double("sketch")
        return {"q": F.array(*[F.kll_sketch_get_quantile_double(one, F.lit(q)) for q in self.quantiles])}

    def merged_sketch(self) -> dict[str, Column]:
        return {"sketch": F.kll_merge_agg_double("sketch")}

    def finish(self, row):
        return None if row["q"] is None else {str(q): float(x) for q, x in zip(self.quantiles, row["q"], strict=True)}


@dataclass(frozen=True)
class DataTypeAnalyzer(ScanAnalyzer):
    """Distribution over the inferred content types of a column's values."""

    column: str
    where: str | None = None

    @property
    def name(self):
        return "DataType"

    def partials(self):
        k = selected(patterns.kind(F.col(self.column)), self.where)
        return {name: F.count_if(k == i) for i, name in enumerate(patterns.KINDS)}

    def finish(self, row):
        total = sum(row[k] for k in patterns.KINDS)
        return Distribution({k: DistributionValue(row[k], row[k] / total if total else 0.0) for k in patterns.KINDS}, len(patterns.KINDS))


def infer_type(d: Distribution) -> str:
    """The type a string column holds."""
    n = {k: v.absolute for k, v in d.values.items()}
    if not any(n[k] for k in patterns.KINDS[1:]):
        return "Unknown"
    if n["String"] or (n["Boolean"] and (n["Integral"] or n["Fractional"])):
        return "String"
    return "Boolean" if n["Boolean"] else "Fractional" if n["Fractional"] else "Integral"


# --- grouping analyzers -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class GroupingAnalyzer(Analyzer):
    """``aggregate``: an aggregate over the frequency table (columns g0.., n) given the number of rows of the data."""

    def aggregate(self, rows: Column) -> Column:
        raise NotImplementedError

    def finish(self, row: dict[str, Any]) -> Any:
        return row["x"]

    @property
    def entity(self):
        return Entity.COLUMN if len(self.columns) == 1 else Entity.MULTICOLUMN


@dataclass(frozen=True)
class _Keys(GroupingAnalyzer):
    column: str | tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "column", tuple(sorted(as_tuple(self.column))))

    def precondition(self, schema):
        return IllegalParameterError("at least one column is needed") if not self.columns else super().precondition(schema)


@dataclass(frozen=True)
class Uniqueness(_Keys):
    def aggregate(self, rows):
        return F.when(rows > 0, F.count_if(F.col("n") == 1) / rows).otherwise(0.0)


@dataclass(frozen=True)
class Distinctness(_Keys):
    def aggregate(self, rows):
        return F.when(rows > 0, F.count_if(F.col("n") >= 1) / rows).otherwise(0.0)


@dataclass(frozen=True)
class UniqueRatio(_Keys):
    def aggregate(self, rows):
        groups = F.count(F.lit(1))
        return F.when(groups > 0, F.count_if(F.col("n") == 1) / groups).otherwise(0.0)


@dataclass(frozen=True)
class Entropy(_Keys):
    def aggregate(self, rows):
        p = F.col("n") / rows
        return -F.sum(F.when(F.col("n") > 0, p * F.log(p)))


@dataclass(frozen=True)
class MutualInformation(GroupingAnalyzer):
    first: str
    second: str

    def __post_init__(self):
        a, b = sorted((self.first, self.second))
        object.__setattr__(self, "first", a)
        object.__setattr__(self, "second", b)

    @property
    def columns(self):
        return (self.first, self.second)

    def value(self, freq: DataFrame, rows: int) -> DataFrame:
        """Marginals are grouped from the joint table and joined back, so a hot value never becomes one window."""
        n = F.lit(float(rows))
        gx = freq.groupBy(F.col("g0").alias("x")).agg(F.sum("n").alias("nx"))
        gy = freq.groupBy(F.col("g1").alias("y")).agg(F.sum("n").alias("ny"))
        joint = freq.join(gx, freq.g0 == gx.x).join(gy, freq.g1 == gy.y)
        return joint.agg(F.sum(F.col("n") / n * F.log((F.col("n") / n) / ((F.col("nx") / n) * (F.col("ny") / n)))).alias("x"))


@dataclass(frozen=True)
class Mode(GroupingAnalyzer):
    """The most frequent value as a string, nulls counted as a value; ties go to the smallest, null last."""

    column: str
    where: str | None = None

    @property
    def entity(self):
        return Entity.COLUMN

    def value(self, df: DataFrame) -> DataFrame:
        data = df if self.where is None else df.where(self.where)
        freq = data.groupBy(F.col(self.column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return freq.orderBy(F.desc("n"), F.asc_nulls_last("v")).limit(1).select(F.col("v").alias("x"))


@dataclass(frozen=True)
class Histogram(GroupingAnalyzer):
    """Frequencies of a column's values as strings; ``binning`` maps a Column to a Column (or is a UDF)."""

    column: str
    binning: Any = None
    max_bins: int = MAX_BINS

    def precondition(self, schema):
        if self.max_bins > MAX_BINS:
            return IllegalParameterError(f"max_bins must not exceed {MAX_BINS}")
        return super().precondition(schema)

    def table(self, df: DataFrame) -> DataFrame:
        c = F.col(self.column)
        c = self.binning(c) if self.binning is not None else c
        return df.select(F.coalesce(c.cast("string"), F.lit(NULL_VALUE)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("absolute"))

    def compute(self, df: DataFrame) -> Metric:
        try:
            table = self.table(df).persist()
            try:
                total = table.agg(F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum("absolute"), F.lit(0)).alias("n")).first()
                top = table.orderBy(F.desc("absolute"), "bin").limit(self.max_bins).collect()
            finally:
                table.unpersist()
        except Exception as e:  # noqa: BLE001 - reported as the metric's error
            return self.failure(e)
        return self.success(Distribution({r.bin: DistributionValue(r.absolute, r.absolute / total.n) for r in top}, total.bins))


# --- analyzers with operators of their own ------------------------------------------------------------------------


@dataclass(frozen=True)
class ComplexAnalyzer(Analyzer):
    def compute(self, df: DataFrame) -> Metric:
        try:
            return self.success(self.run(df))
        except Exception as e:  # noqa: BLE001 - reported as the metric's error
            return self.failure(e if isinstance(e, RuntimeAnalysisError) else RuntimeAnalysisError(f"{type(e).__name__}: {e}"))

    def run(self, df: DataFrame) -> Any:
        raise NotImplementedError

    @property
    def entity(self):
        return Entity.COLUMN if len(self.columns) == 1 else Entity.MULTICOLUMN


@dataclass(frozen=True)
class Outliers(ComplexAnalyzer):
    """Ratio of outliers by one of the models of ``operators.outliers``."""

    column: str | tuple[str, ...]
    model: str
    params: Any = None
    where: str | None = None
    index_col: str = "id"
    needs: ClassVar[str | None] = "numeric"

    def __post_init__(self):
        object.__setattr__(self, "column", as_tuple(self.column))

    def run(self, df):
        from . import outliers

        return outliers.solver(self.model, self.columns, self.params, index_col=self.index_col).ratio(df if self.where is None else df.where(self.where))


@dataclass(frozen=True)
class FunctionalDependency(ComplexAnalyzer):
    cfds: str | tuple[str, ...]
    index_col: str = "id"

    def __post_init__(self):
        object.__setattr__(self, "cfds", as_tuple(self.cfds))

    @property
    def instance(self):
        return ";".join(self.cfds)

    @property
    def entity(self):
        return Entity.DATASET

    def run(self, df):
        from . import dependencies

        return dependencies.violations(df, self.cfds)


@dataclass(frozen=True)
class Entities(ComplexAnalyzer):
    """Number of groups of rows that describe the same entity."""

    column: str | tuple[str, ...]
    index_col: str = "id"

    def __post_init__(self):
        object.__setattr__(self, "column", tuple(sorted(as_tuple(self.column))))

    def run(self, df):
        from . import entities

        return float(entities.resolve(df, self.columns, index_col=self.index_col).select("cluster").distinct().count())


def as_dict(row: Row) -> dict[str, Any]:
    return row.asDict(recursive=True)
