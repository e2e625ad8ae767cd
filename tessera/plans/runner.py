"""Runs analyzers in as few jobs as possible.

Analyzers whose preconditions fail, or whose expressions do not resolve, become failed metrics first.  Scan analyzers
share one aggregate, in which quantile requests on the same column are merged; the row count that grouping analyzers
divide by is part of it.  Grouping analyzers on the same columns share one frequency table and one aggregate over it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..metrics import Metric, metrics_df
from ..operators.analyzers import Analyzer, ApproxQuantile, ComplexAnalyzer, GroupingAnalyzer, Histogram, Mode, MutualInformation, ScanAnalyzer, as_dict


@dataclass
class AnalyzerContext:
    metrics: dict[Analyzer, Metric] = field(default_factory=dict)

    def metric(self, analyzer: Analyzer) -> Metric | None:
        return self.metrics.get(analyzer)

    def __add__(self, other: AnalyzerContext) -> AnalyzerContext:
        return AnalyzerContext(self.metrics | other.metrics)

    def success_metrics_as_df(self, spark) -> DataFrame:  # noqa: ANN001
        return metrics_df(spark, self.metrics.values())


def resolved(df: DataFrame, analyzers: Iterable[Analyzer]) -> tuple[list[Analyzer], dict[Analyzer, Metric]]:
    """Analyzers that can run, and failed metrics of the others; no job is started."""
    good, bad = [], {}
    for a in dict.fromkeys(analyzers):
        error = a.precondition(df.schema)
        if error is None and isinstance(a, ScanAnalyzer):
            try:
                df.agg(*[c.alias(k) for k, c in a.partials().items()]).schema  # noqa: B018 - resolves the plan
            except Exception as e:  # noqa: BLE001 - reported as the metric's error
                error = e
        if error is None:
            good.append(a)
        else:
            bad[a] = a.failure(error)
    return good, bad


def scan_columns(scans: list[ScanAnalyzer]) -> tuple[list, dict[ScanAnalyzer, dict[str, tuple[str, list[int] | None]]]]:
    """Fused aggregates, and for each analyzer where its partials are in the row."""
    columns, where = [], {}
    wanted: dict[tuple, list[float]] = {}
    for a in scans:
        if isinstance(a, ApproxQuantile):
            wanted.setdefault(a.shared(), []).extend(a.quantiles)
    merged: dict[tuple, tuple[str, list[float]]] = {}
    for i, a in enumerate(scans):
        if isinstance(a, ApproxQuantile):
            if a.shared() not in merged:
                qs = sorted(set(wanted[a.shared()]))
                merged[a.shared()] = (f"q{i}", qs)
                columns.append(a.aggregate(tuple(qs)).alias(f"q{i}"))
            alias, qs = merged[a.shared()]
            where[a] = {"q": (alias, [qs.index(q) for q in a.quantiles])}
            continue
        where[a] = {}
        for k, c in a.partials().items():
            columns.append(c.alias(f"a{i}_{k}"))
            where[a][k] = (f"a{i}_{k}", None)
    return columns, where


def _picked(row: dict, where: dict[str, tuple[str, list[int] | None]]) -> dict:
    out = {}
    for k, (alias, places) in where.items():
        v = row[alias]
        out[k] = v if places is None or v is None else [v[p] for p in places]
    return out


def frequencies(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(g0, g1, .., n) over rows without nulls in the columns."""
    keys = [F.col(c).alias(f"g{i}") for i, c in enumerate(columns)]
    return df.select(*keys).dropna(how="any").groupBy(*[f"g{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"))


def run_scans(df: DataFrame, scans: list[ScanAnalyzer], *, with_rows: bool = False) -> tuple[dict[Analyzer, Metric], int]:
    if not scans and not with_rows:
        return {}, -1
    columns, where = scan_columns(scans)
    try:
        row = as_dict(df.agg(F.count(F.lit(1)).alias("__rows"), *columns).first())
    except Exception as e:  # noqa: BLE001 - reported as the metrics' error
        if len(scans) <= 1:
            return {a: a.failure(e) for a in scans}, df.count() if with_rows else -1
        out, rows = {}, -1  # one bad value must not take the others along
        for a in scans:
            got, n = run_scans(df, [a], with_rows=with_rows and rows < 0)
            out, rows = out | got, max(rows, n)
        return out, rows
    return {a: a.finished(_picked(row, where[a])) for a in scans}, row["__rows"]


def run_groupings(df: DataFrame, analyzers: list[GroupingAnalyzer], rows: int) -> dict[Analyzer, Metric]:
    out: dict[Analyzer, Metric] = {}
    shared: dict[tuple[str, ...], list[GroupingAnalyzer]] = {}
    for a in analyzers:
        if isinstance(a, Histogram):
            out[a] = a.compute(df)
        elif isinstance(a, Mode):
            try:
                got = a.value(df).collect()
                out[a] = a.finished({"x": got[0].x if got else None})
            except Exception as e:  # noqa: BLE001 - reported as the metric's error
                out[a] = a.failure(e)
        else:
            shared.setdefault(a.columns, []).append(a)
    for columns, group in shared.items():
        table = frequencies(df, columns)
        mutual = [a for a in group if isinstance(a, MutualInformation)]
        plain = [a for a in group if a not in mutual]
        if mutual:
            table = table.persist()
        try:
            if plain:
                row = as_dict(table.agg(*[a.aggregate(F.lit(rows)).alias(f"a{i}") for i, a in enumerate(plain)]).first())
                out |= {a: a.finished({"x": row[f"a{i}"]}) for i, a in enumerate(plain)}
            for a in mutual:
                out[a] = a.finished({"x": a.value(table, rows).first().x})
        except Exception as e:  # noqa: BLE001 - reported as the metrics' error
            out |= {a: a.failure(e) for a in group if a not in out}
        finally:
            if mutual:
                table.unpersist()
    return out


def analyze(df: DataFrame, analyzers: Iterable[Analyzer], known: AnalyzerContext | None = None) -> AnalyzerContext:
    """Metrics of all analyzers; those in ``known`` are taken from there."""
    have = known.metrics if known else {}
    asked = list(dict.fromkeys(analyzers))
    good, bad = resolved(df, [a for a in asked if a not in have])
    scans = [a for a in good if isinstance(a, ScanAnalyzer)]
    groupings = [a for a in good if isinstance(a, GroupingAnalyzer)]
    out, rows = run_scans(df, scans, with_rows=any(not isinstance(a, (Histogram, Mode)) for a in groupings))
    out |= run_groupings(df, groupings, rows)
    out |= {a: a.compute(df) for a in good if isinstance(a, ComplexAnalyzer)}
    out |= bad
    return AnalyzerContext({a: have[a] if a in have else out[a] for a in asked})


class AnalysisRunBuilder:
    def __init__(self, data: DataFrame) -> None:
        self.data = data
        self.analyzers: list[Analyzer] = []
        self.repository = self.reuse_key = self.save_key = self.states = self.batch = None
        self.output: tuple[str, bool] | None = None

    def add_analyzer(self, analyzer: Analyzer) -> AnalysisRunBuilder:
        self.analyzers.append(analyzer)
        return self

    def add_analyzers(self, analyzers: Iterable[Analyzer]) -> AnalysisRunBuilder:
        self.analyzers += analyzers
        return self

    def use_repository(self, repository, *, reuse_key=None, save_key=None) -> AnalysisRunBuilder:  # noqa: ANN001
        self.repository, self.reuse_key, self.save_key = repository, reuse_key, save_key
        return self

    def merge_states_with(self, provider, batch: str | int) -> AnalysisRunBuilder:  # noqa: ANN001
        """Stores the data's state as a batch of the provider; metrics the provider can merge cover all its batches."""
        self.states, self.batch = provider, batch
        return self

    def write_results_to(self, path: str, overwrite: bool = False) -> AnalysisRunBuilder:
        """Writes the successful metrics as JSON."""
        self.output = (path, overwrite)
        return self

    def run(self) -> AnalyzerContext:
        known = self.repository.load_by_key(self.reuse_key) if self.repository is not None and self.reuse_key is not None else AnalyzerContext()
        if self.states is not None:
            self.states.persist(self.data, self.batch)
            known = AnalyzerContext(known.metrics | self.states.compute().metrics)
        context = analyze(self.data, self.analyzers, known)
        if self.repository is not None and self.save_key is not None:
            self.repository.save(self.save_key, context)
        if self.output is not None:
            import json

            from ..repository import context_to_json
            from ..sources import files

            files.write(self.data.sparkSession, self.output[0], json.dumps(context_to_json(context), sort_keys=True), overwrite=self.output[1])
        return context


class AnalysisRunner:
    @staticmethod
    def on_data(data: DataFrame) -> AnalysisRunBuilder:
        return AnalysisRunBuilder(data)
