"""Column profiles in three passes: generic statistics, numeric statistics, histograms of low-cardinality columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..metrics import Distribution, DistributionValue
from ..operators import analyzers as a
from .runner import analyze

PERCENTILES = tuple(i / 100 for i in range(1, 101))


@dataclass(frozen=True)
class StandardProfile:
    column: str
    completeness: float
    approx_count_distinct: int
    data_type: str
    is_inferred_type: bool
    type_counts: dict[str, int]
    histogram: Distribution | None = None


@dataclass(frozen=True)
class NumericProfile(StandardProfile):
    minimum: float | None = None
    maximum: float | None = None
    mean: float | None = None
    std_dev: float | None = None
    sum: float | None = None
    approx_percentiles: list[float] = field(default_factory=list)


@dataclass(frozen=True)
class Profiles:
    profiles: dict[str, StandardProfile]
    num_records: int

    def __getitem__(self, column: str) -> StandardProfile:
        return self.profiles[column]

    def to_df(self, spark) -> DataFrame:  # noqa: ANN001
        get = lambda p, k: getattr(p, k, None)
        rows = [(p.column, p.data_type, p.completeness, p.approx_count_distinct, *[get(p, k) for k in ("minimum", "maximum", "mean", "std_dev", "sum")], p.histogram.number_of_bins if p.histogram else None) for p in self.profiles.values()]
        return spark.createDataFrame(rows, "column string, data_type string, completeness double, approx_count_distinct long, minimum double, maximum double, mean double, std_dev double, sum double, histogram_bins long")


def known_type(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Integral"
    if isinstance(t, (T.DecimalType, T.FloatType, T.DoubleType)):
        return "Fractional"
    if isinstance(t, T.BooleanType):
        return "Boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "String"
    return "Unknown"


def profile(df: DataFrame, columns: list[str] | None = None, low_cardinality_threshold: int = 120) -> Profiles:
    columns = list(columns) if columns else df.columns
    strings = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    wanted: list[a.Analyzer] = [a.Size()]
    for c in columns:
        wanted += [a.Completeness(c), *([] if _is_map(df.schema[c].dataType) else [a.ApproxCountDistinct(c)])]
    wanted += [a.DataTypeAnalyzer(c) for c in strings]
    first = analyze(df, wanted).metrics
    kinds = {c: a.infer_type(first[a.DataTypeAnalyzer(c)].value) if c in strings else known_type(df.schema[c].dataType) for c in columns}
    numeric = [c for c in columns if kinds[c] in ("Integral", "Fractional")]
    # content types call "", "-" and "." numbers; try_cast turns them into nulls
    cast = df.select(*[F.col(c).try_cast("double" if kinds[c] == "Fractional" else "long").alias(c) if c in strings else F.col(c) for c in numeric]) if numeric else df
    per = lambda c: [a.Minimum(c), a.Maximum(c), a.Mean(c), a.StandardDeviation(c), a.Sum(c), a.ApproxQuantile(c, PERCENTILES)]
    second = analyze(cast, [x for c in numeric for x in per(c)]).metrics if numeric else {}
    rows = int(first[a.Size()].value)
    distinct = lambda c: int(m.value) if (m := first.get(a.ApproxCountDistinct(c))) is not None and m.is_success else 0
    small = [c for c in columns if kinds[c] != "Unknown" and distinct(c) <= low_cardinality_threshold]
    histograms = histogram_pass(df, small, rows)
    out: dict[str, StandardProfile] = {}
    value = lambda m: m.value if m.is_success else None
    for c in columns:
        counts = {k: v.absolute for k, v in first[a.DataTypeAnalyzer(c)].value.values.items()} if c in strings else {}
        common: dict[str, Any] = dict(column=c, completeness=first[a.Completeness(c)].value, approx_count_distinct=distinct(c), data_type=kinds[c], is_inferred_type=c in strings, type_counts=counts, histogram=histograms.get(c))
        if c in numeric:
            q = value(second[a.ApproxQuantile(c, PERCENTILES)])
            out[c] = NumericProfile(**common, minimum=value(second[a.Minimum(c)]), maximum=value(second[a.Maximum(c)]), mean=value(second[a.Mean(c)]), std_dev=value(second[a.StandardDeviation(c)]), sum=value(second[a.Sum(c)]), approx_percentiles=list(q.values()) if q else [])
        else:
            out[c] = StandardProfile(**common)
    return Profiles(out, rows)


def _is_map(t: T.DataType) -> bool:
    return "map<" in t.simpleString()


def histogram_pass(df: DataFrame, columns: list[str], rows: int) -> dict[str, Distribution]:
    """Exact histograms of all columns from one unpivoted aggregate; only columns of few distinct values are asked for."""
    if not columns:
        return {}
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit(a.NULL_VALUE)).alias("v")) for c in columns]))
    got: dict[str, dict[str, DistributionValue]] = {c: {} for c in columns}
    for r in df.select(cell.alias("x")).groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n")).orderBy("c", F.desc("n"), "v").collect():
        got[r.c][r.v] = DistributionValue(r.n, r.n / rows if rows else 0.0)
    return {c: Distribution(v, len(v)) for c, v in got.items()}


class ProfilerRunBuilder:
    def __init__(self, data: DataFrame) -> None:
        self.data, self.columns, self.threshold = data, None, 120

    def set_specified_columns(self, columns: list[str]) -> ProfilerRunBuilder:
        self.columns = columns
        return self

    def set_low_cardinality_threshold(self, threshold: int) -> ProfilerRunBuilder:
        self.threshold = threshold
        return self

    def run(self) -> Profiles:
        return profile(self.data, self.columns, self.threshold)


class ProfilerSuite:
    @staticmethod
    def on_data(data: DataFrame) -> ProfilerRunBuilder:
        return ProfilerRunBuilder(data)
