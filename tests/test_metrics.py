import math
import re
import statistics
from collections import Counter

import pytest
from fixtures import PARTS, PARTS_SCHEMA
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.exceptions import EmptyStateError, NoSuchColumnError, WrongTypeError
from tessera.functions import similarity
from tessera.functions.patterns import EMAIL, URL
from tessera.operators import analyzers as a
from tessera.plans.runner import AnalysisRunner, analyze, scan_columns


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame(PARTS, PARTS_SCHEMA).cache()


ID, GRADE, LABEL, STOCK, WIDTH, DELTA, LINK, MAIL = range(8)
N = len(PARTS)


def values(c, where=lambda r: True):
    return [r[c] for r in PARTS if where(r) and r[c] is not None]


def counts(*cs):
    return Counter(tuple(r[c] for c in cs) for r in PARTS if all(r[c] is not None for c in cs))


def entropy(*cs):
    return -sum(n / N * math.log(n / N) for n in counts(*cs).values())


def share(c, pattern):
    return sum(bool(re.search(pattern, x)) for x in values(c)) / N


def once(*cs):
    return sum(n == 1 for n in counts(*cs).values())


_MEDIAN = sorted(values(DELTA))[N // 2 - 1]
_MAD = sorted(abs(x - _MEDIAN) for x in values(DELTA))[N // 2 - 1]
GOLDEN = {
    a.Size(): N, a.Completeness("label"): 1.0, a.Completeness("link"): 6 / 8, a.Completeness(("link", "mail")): 5 / 8,
    a.Sum("delta"): sum(values(DELTA)), a.Mean("delta"): statistics.fmean(values(DELTA)), a.Minimum("delta"): -300, a.Maximum("delta"): 71, a.StandardDeviation("delta"): statistics.pstdev(values(DELTA)),
    a.Mean("width"): statistics.fmean(values(WIDTH)), a.Correlation("delta", "width"): statistics.correlation(values(DELTA), values(WIDTH)), a.Compliance("w", "delta > 0"): 7 / 8,
    a.PatternMatch("link", URL): 5 / 8, a.PatternMatch("mail", EMAIL): 5 / 8, a.PatternMatch("mail", "org$"): share(MAIL, "org$"),
    a.Uniqueness("id"): 6 / 8, a.Distinctness("id"): 7 / 8, a.UniqueRatio("id"): 6 / 7, a.Uniqueness("link"): once(LINK) / N, a.Distinctness("link"): len(counts(LINK)) / N, a.UniqueRatio("link"): once(LINK) / len(counts(LINK)),
    a.Entropy("delta"): entropy(DELTA), a.Entropy("grade"): entropy(GRADE), a.MutualInformation("delta", "width"): entropy(DELTA) + entropy(WIDTH) - entropy(DELTA, WIDTH), a.MutualInformation("grade", "delta"): entropy(GRADE) + entropy(DELTA) - entropy(GRADE, DELTA),
    a.MaxLength("label"): 4, a.MinLength("label"): 1, a.Outliers("delta", "k_sigma"): 1 / 8, a.Outliers("delta", "mad"): sum(abs(x - _MEDIAN) > 1.5 * _MAD for x in values(DELTA)) / N, a.ApproxCountDistinct("id"): 7, a.Size("delta > 0"): 7,
    a.Mean("delta", "grade = 'B'"): statistics.fmean(values(DELTA, lambda r: r[GRADE] == "B")),
}


def test_golden_metrics(parts):
    found = analyze(parts, GOLDEN)
    for x, want in GOLDEN.items():
        assert found.metric(x).is_success, (x, found.metric(x).error)
        assert found.metric(x).value == pytest.approx(want, rel=1e-9), x


def test_mode_types_histogram_quantiles(parts):
    q = a.ApproxQuantile("delta", (0.0, 0.5, 1.0), 1e-6)
    m = analyze(parts, [a.Mode("delta"), a.Mode("link"), a.DataTypeAnalyzer("label"), a.Histogram("link"), q]).metrics
    assert m[a.Mode("delta")].value == "40" and m[a.Mode("link")].value == "http://10.0.0.7/parts"
    d = m[a.DataTypeAnalyzer("label")].value
    assert (d["Integral"].absolute, d["String"].absolute) == (2, 6) and a.infer_type(d) == "String"
    h = m[a.Histogram("link")].value
    assert h.number_of_bins == 6 and h[a.NULL_VALUE].absolute == 2 and h["http://10.0.0.7/parts"].ratio == pytest.approx(2 / 8)
    assert m[q].value == {"0.0": -300, "0.5": _MEDIAN, "1.0": 71}


def test_failures_are_metrics(parts, spark):
    bad = {a.Mean("nope"): NoSuchColumnError, a.Mean("label"): WrongTypeError, a.MaxLength("stock"): WrongTypeError}
    found = analyze(parts, [*bad, a.Size(), a.Compliance("x", "no such + syntax")]).metrics
    for x, kind in bad.items():
        assert isinstance(found[x].error, kind)
    assert found[a.Size()].value == N and not found[a.Compliance("x", "no such + syntax")].is_success
    empty = analyze(parts.limit(0), [a.Mean("stock"), a.Size(), a.Completeness("stock"), a.Uniqueness("id"), a.StandardDeviation("stock"), a.Mode("stock"), a.Entropy("stock")]).metrics
    assert isinstance(empty[a.Mean("stock")].error, EmptyStateError) and empty[a.Size()].value == 0 and empty[a.Completeness("stock")].value == 0 and empty[a.Uniqueness("id")].value == 0
    assert isinstance(empty[a.Mode("stock")].error, EmptyStateError) and not empty[a.StandardDeviation("stock")].is_success


def test_runtime_error_of_one_analyzer_spares_the_others(spark):
    df = spark.createDataFrame([("1",), ("x",)], "s string")
    found = analyze(df, [a.Size(), a.Compliance("bad", "CAST(s AS INT) > 0"), a.Completeness("s")]).metrics
    assert found[a.Size()].value == 2 and found[a.Completeness("s")].value == 1 and not found[a.Compliance("bad", "CAST(s AS INT) > 0")].is_success


def test_quantile_requests_share_an_aggregate_and_scans_one_job(parts):
    scans = [a.ApproxQuantile("stock", 0.5), a.ApproxQuantile("stock", (0.25, 0.5)), a.Mean("stock"), a.ApproxQuantile("width", 0.5)]
    assert len(scan_columns(scans)[0]) == 4
    plan = parts.agg(*scan_columns(scans)[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_analysis_runner_reuses_stored_metrics(parts):
    from tessera.metrics import Entity, Metric
    from tessera.plans.runner import AnalyzerContext
    from tessera.repository import MemoryMetricsRepository, ResultKey

    repo, key = MemoryMetricsRepository(), ResultKey.of(1)
    repo.save(key, AnalyzerContext({a.Size(): Metric("Size", Entity.DATASET, "*", 99.0)}))
    out = AnalysisRunner.on_data(parts).add_analyzers([a.Size(), a.Mean("stock")]).use_repository(repo, reuse_key=key, save_key=ResultKey.of(2)).run()
    assert out.metric(a.Size()).value == 99.0 and len(repo.load_by_key(ResultKey.of(2)).metrics) == 2


@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_moments_equal_python(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    m = analyze(df, [a.StandardDeviation("x"), a.Mean("x")]).metrics
    some = [x for x in xs if x is not None]
    if not some:
        assert not m[a.Mean("x")].is_success
        return
    mean = math.fsum(some) / len(some)
    assert m[a.Mean("x")].value == pytest.approx(mean, abs=1e-6)
    assert m[a.StandardDeviation("x")].value == pytest.approx(math.sqrt(math.fsum((x - mean) ** 2 for x in some) / len(some)), abs=1e-5)


def test_similarities(spark):
    df = spark.createDataFrame([("MARTHA", "MARHTA"), ("a b", "b c"), ("same", "same"), ("", ""), (None, "x"), ("a a b", "a")], "x string, y string")
    get = lambda name: [round(r[0], 4) for r in df.select(similarity.similarity(name, F.col("x"), F.col("y"))).collect()]
    assert get("jaro_winkler")[0] == 0.9611 and get("jaccard")[1] == 0.3333 and get("sorensen_dice")[1] == 0.5
    assert get("normalized_levenshtein")[0] == 0.6667 and get("cosine")[5] == round(2 / math.sqrt(5), 4)
    for name in similarity.NAMES:
        assert get(name)[2] == 1 and get(name)[4] == 0
