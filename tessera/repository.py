"""Metrics repositories, and stored states that are merged instead of read again."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import Distribution, DistributionValue, Entity, Metric, Violation, Violations
from .operators import analyzers as a
from .operators.outliers import Params
from .plans.runner import AnalyzerContext, frequencies, resolved
from .sources import files

# --- serialisation ------------------------------------------------------------------------------------------------

ANALYZERS: dict[str, type[a.Analyzer]] = {c.__name__: c for c in (a.Size, a.Completeness, a.Compliance, a.PatternMatch, a.Minimum, a.Maximum, a.Sum, a.MinLength, a.MaxLength, a.Mean, a.StandardDeviation, a.Correlation, a.ApproxCountDistinct, a.ApproxQuantile, a.DataTypeAnalyzer, a.Uniqueness, a.Distinctness, a.UniqueRatio, a.Entropy, a.MutualInformation, a.Mode, a.Histogram, a.Outliers, a.FunctionalDependency, a.Entities)}


def analyzer_to_json(x: a.Analyzer) -> dict[str, Any]:
    given = {k: getattr(x, k) for k in (f.name for f in fields(x))}
    given = {k: {"__params": v.to_json()} if isinstance(v, Params) else list(v) if isinstance(v, tuple) else v for k, v in given.items()}
    if callable(given.get("binning")):
        raise ValueError("an analyzer with a binning function cannot be stored")
    return {"type": type(x).__name__, **given}


def analyzer_from_json(d: dict[str, Any]) -> a.Analyzer:
    given = {k: Params.from_json(v["__params"]) if isinstance(v, dict) and "__params" in v else tuple(v) if isinstance(v, list) else v for k, v in d.items() if k != "type"}
    return ANALYZERS[d["type"]](**given)


def value_to_json(v: Any) -> Any:
    if isinstance(v, Distribution):
        return {"__distribution": {k: [x.absolute, x.ratio] for k, x in v.values.items()}, "bins": v.number_of_bins}
    if isinstance(v, Violations):
        return {"__violations": [[c, p, at, x.const_vio, x.var_vio] for c, p, at, x in v.flat()]}
    return v


def value_from_json(v: Any) -> Any:
    if isinstance(v, dict) and "__distribution" in v:
        return Distribution({k: DistributionValue(*x) for k, x in v["__distribution"].items()}, v["bins"])
    if isinstance(v, dict) and "__violations" in v:
        out: dict[str, dict[str, dict[str, Violation]]] = {}
        for c, p, at, x, y in v["__violations"]:
            out.setdefault(c, {}).setdefault(p, {})[at] = Violation(x, y)
        return Violations(out)
    return v


def context_to_json(context: AnalyzerContext) -> list[dict[str, Any]]:
    """Successful metrics only."""
    return [{"analyzer": analyzer_to_json(x), "metric": {"name": m.name, "entity": m.entity.value, "instance": m.instance, "value": value_to_json(m.value)}} for x, m in context.metrics.items() if m.is_success and not callable(getattr(x, "binning", None))]


def context_from_json(rows: Iterable[dict[str, Any]]) -> AnalyzerContext:
    out = {}
    for r in rows:
        m = r["metric"]
        out[analyzer_from_json(r["analyzer"])] = Metric(m["name"], Entity(m["entity"]), m["instance"], value_from_json(m["value"]))
    return AnalyzerContext(out)


# --- repositories -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ResultKey:
    data_set_date: int = field(default_factory=lambda: int(time.time() * 1000))
    tags: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def of(date: int, tags: dict[str, str] | None = None) -> ResultKey:
        return ResultKey(date, tuple(sorted((tags or {}).items())))


@dataclass(frozen=True)
class AnalysisResult:
    key: ResultKey
    context: AnalyzerContext


class Loader:
    """Filters of stored results; bounds are inclusive."""

    def __init__(self, results: Iterable[AnalysisResult]) -> None:
        self._results = list(results)
        self._tags: dict[str, str] | None = None
        self._analyzers: set[a.Analyzer] | None = None
        self._after = self._before = None

    def with_tag_values(self, tags: dict[str, str]) -> Loader:
        self._tags = tags
        return self

    def for_analyzers(self, analyzers: Iterable[a.Analyzer]) -> Loader:
        self._analyzers = set(analyzers)
        return self

    def after(self, date: int) -> Loader:
        self._after = date
        return self

    def before(self, date: int) -> Loader:
        self._before = date
        return self

    def get(self) -> list[AnalysisResult]:
        out = []
        for r in self._results:
            tags = dict(r.key.tags)
            if (self._after is not None and r.key.data_set_date < self._after) or (self._before is not None and r.key.data_set_date > self._before):
                continue
            if self._tags is not None and any(tags.get(k) != v for k, v in self._tags.items()):
                continue
            metrics = {x: m for x, m in r.context.metrics.items() if self._analyzers is None or x in self._analyzers}
            out.append(AnalysisResult(r.key, AnalyzerContext(metrics)))
        return out

    def get_success_metrics_as_df(self, spark: SparkSession) -> DataFrame:
        rows = [(r.key.data_set_date, dict(r.key.tags), *flat) for r in self.get() for m in r.context.metrics.values() for flat in m.flatten()]
        return spark.createDataFrame(rows, "data_set_date long, tags map<string,string>, entity string, instance string, name string, value double")


class MetricsRepository:
    def save(self, key: ResultKey, context: AnalyzerContext) -> None:
        raise NotImplementedError

    def results(self) -> list[AnalysisResult]:
        raise NotImplementedError

    def load(self) -> Loader:
        return Loader(self.results())

    def load_by_key(self, key: ResultKey) -> AnalyzerContext:
        for r in self.results():
            if r.key == key:
                return r.context
        return AnalyzerContext()


class MemoryMetricsRepository(MetricsRepository):
    def __init__(self) -> None:
        self._stored: dict[ResultKey, AnalyzerContext] = {}

    def save(self, key, context):
        self._stored[key] = AnalyzerContext({x: m for x, m in context.metrics.items() if m.is_success})

    def results(self):
        return [AnalysisResult(k, c) for k, c in self._stored.items()]


class FileSystemMetricsRepository(MetricsRepository):
    """A JSON line per result; a key saved again replaces its old result.  With a session, files of any store that Spark
    reads; without, local files."""

    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        self.path, self.spark = path, spark

    def _lines(self) -> list[str]:
        if self.spark is None:
            if not os.path.exists(self.path):
                return []
            with open(self.path, encoding="utf-8") as f:
                return [x for x in f.read().split("\n") if x]
        return files.read(self.spark, self.path).splitlines() if files.exists(self.spark, self.path) else []  # one line per saved result

    def save(self, key, context):
        kept = [x for x in self._lines() if _key(json.loads(x)) != key]
        line = json.dumps({"date": key.data_set_date, "tags": dict(key.tags), "results": context_to_json(context)}, sort_keys=True)
        text = "".join(x + "\n" for x in [*kept, line])
        if self.spark is None:
            os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
            with open(self.path + ".new", "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(self.path + ".new", self.path)
            return
        files.write(self.spark, self.path, text, overwrite=True)

    def results(self):
        return [AnalysisResult(_key(d), context_from_json(d["results"])) for d in map(json.loads, self._lines())]


def _key(d: dict[str, Any]) -> ResultKey:
    return ResultKey.of(d["date"], d["tags"])


# --- states -------------------------------------------------------------------------------------------------------


def state_row(df: DataFrame, scans: list[a.ScanAnalyzer]) -> DataFrame:
    """One row with the mergeable partials of all scan analyzers: plain aggregates, or sketches."""
    columns = []
    for i, x in enumerate(scans):
        parts = x.sketch() if hasattr(x, "sketch") else x.partials()
        columns += [c.alias(f"a{i}_{k}") for k, c in parts.items()]
    return df.agg(F.count(F.lit(1)).alias("rows"), *columns)


def merged_row(states: DataFrame, scans: list[a.ScanAnalyzer]) -> DataFrame:
    """The values that ``finish`` takes, m{i}_{name}, from rows of partials.

    A merge speaks of its own partials by name, so each analyzer's are looked up in a struct of that row.
    """
    parts = {i: list(x.sketch() if hasattr(x, "sketch") else x.partials()) for i, x in enumerate(scans)}
    out = None
    for i, x in enumerate(scans):
        own = states.select(*[F.col(f"a{i}_{k}").alias(k) for k in parts[i]])
        one = own.agg(*[c.alias(f"m{i}_{k}") for k, c in x.merges().items()])
        out = one if out is None else out.crossJoin(one)  # one row each
    rows = states.agg(F.sum("rows").alias("rows"))
    return rows if out is None else rows.crossJoin(out)


class StateProvider:
    """Keeps, under a folder, a Parquet row of partials for each batch of data, and frequency tables for grouping
    analyzers; metrics of everything seen come from merging them."""

    def __init__(self, spark: SparkSession, path: str, analyzers: Iterable[a.Analyzer]) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.asked = list(dict.fromkeys(analyzers))
        self.scans = [x for x in self.asked if isinstance(x, a.ScanAnalyzer)]
        self.groups = [x for x in self.asked if isinstance(x, (a.Uniqueness, a.Distinctness, a.UniqueRatio, a.Entropy, a.MutualInformation))]
        if len(self.scans) + len(self.groups) != len(self.asked):
            raise ValueError("only scan and frequency analyzers have mergeable states")
        self.keys = list(dict.fromkeys(x.columns for x in self.groups))

    def _folder(self, i: int) -> str:
        return f"{self.path}/frequencies-{i}"

    def has_state(self) -> bool:
        return files.exists(self.spark, f"{self.path}/scan")

    def persist(self, df: DataFrame, batch: str | int) -> None:
        """Stores the state of one batch; the same batch stored again replaces its old state."""
        bad = resolved(df, self.asked)[1]
        if bad:
            raise next(iter(bad.values())).error  # type: ignore[misc]
        state_row(df, self.scans).write.mode("overwrite").parquet(f"{self.path}/scan/batch={batch}")
        for i, columns in enumerate(self.keys):
            frequencies(df, columns).write.mode("overwrite").parquet(f"{self._folder(i)}/batch={batch}")

    def compute(self) -> AnalyzerContext:
        states = self.spark.read.parquet(f"{self.path}/scan")
        row = merged_row(states, self.scans).first().asDict(recursive=True)
        out = {x: x.finished({k: row[f"m{i}_{k}"] for k in x.merges()}) for i, x in enumerate(self.scans)}
        for i, columns_ in enumerate(self.keys):
            table = self.spark.read.parquet(self._folder(i))
            keys = [f"g{k}" for k in range(len(columns_))]
            table = table.groupBy(*keys).agg(F.sum("n").alias("n"))
            group = [x for x in self.groups if x.columns == columns_]
            for x in group:
                got = x.value(table, row["rows"]) if isinstance(x, a.MutualInformation) else table.agg(x.aggregate(F.lit(row["rows"])).alias("x"))
                out[x] = x.finished({"x": got.first().x})
        return AnalyzerContext({x: out[x] for x in self.asked})
