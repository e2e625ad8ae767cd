import pytest
from fixtures import PARTS, PARTS_SCHEMA

from tessera import checks as c
from tessera.operators import analyzers as a
from tessera.operators.outliers import KSigmaParams, Params
from tessera.plans.runner import analyze
from tessera.plans.suggest import DEFAULT_RULES, SuggestionSuite
from tessera.plans.profile import ProfilerSuite
from tessera.repository import FileSystemMetricsRepository, MemoryMetricsRepository, ResultKey, StateProvider, analyzer_from_json, analyzer_to_json
from tessera.streaming.incremental import monitor


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame(PARTS, PARTS_SCHEMA).cache()


def test_every_check_method(parts):
    good = (
        c.Check("good").is_complete("id").has_completeness("link", c.greater_than(0.7)).are_complete(["id", "label"]).have_completeness(["link", "mail"], c.less_than(0.7))
        .is_unique("label").is_primary_key(["id", "label"]).has_uniqueness("id", c.less_than(1)).have_uniqueness(["id", "grade"]).has_distinctness("grade", c.less_than(0.4))
        .have_distinctness(["id", "grade"]).has_unique_ratio("id", c.in_range(0.8, 0.9)).have_unique_ratio(["id", "grade"], c.is_one()).has_count_distinct("grade", c.equal_to(3))
        .has_histogram_values("grade", lambda d: d["A"].absolute == 4).has_approx_count_distinct("id", c.equal_to(7)).satisfies_expression("stock > 0").is_positive("stock").is_non_negative("stock")
        .is_greater_than("stock", 8).is_greater_than_or_equal_to("stock", 9).is_less_than("stock", 41).is_less_than_or_equal_to("stock", 40).is_in_range("stock", 9, 40, True, True)
        .is_contained_in("grade", ["A", "B", "C"]).has_data_type("stock", "integral").has_data_type("label", "numeric", c.equal_to(0.25)).matches_pattern("grade", "A|B|C").begins_with("link", "http", c.equal_to(0.375))
        .ends_with("mail", "org", c.equal_to(0.375)).contains_str("mail", "mill", c.greater_than(0.3)).contains_url("link", c.equal_to(0.625)).contains_email("mail", c.equal_to(0.625))
        .satisfies_fd("label@stock#_&_").has_size(c.equal_to(8)).has_max("delta", c.equal_to(71)).has_min("delta", c.is_negative()).has_mean("delta", c.equal_to(9.125)).has_mode("delta", c.equal_to(40))
        .has_sum("delta", c.is_positive()).has_standard_deviation("delta", c.in_range(117, 118)).has_approx_quantile("delta", 0.5, c.equal_to(47)).has_entropy("grade", c.in_range(0.97, 0.98))
        .has_mutual_information("grade", "delta", c.in_range(0.79, 0.81)).has_correlation("delta", "width", c.is_negative()).has_max_length("label", c.equal_to(4)).has_min_length("label", c.equal_to(1))
        .has_outliers("delta", "k_sigma", assertion=c.in_range(0, 0.2)).has_outliers("stock", "k_sigma", KSigmaParams(9.0)).has_entities("label", c.is_zero(), "id")
    )
    out = c.DetectionSuite.on_data(parts).add_check(good).run()
    wrong = [(r.constraint, r.message) for r in out.check_results[0].constraint_results if r.status is not c.ConstraintStatus.SUCCESS]
    assert not wrong and out.status is c.CheckStatus.SUCCESS


def test_failures_reach_the_run(parts):
    bad = c.Check("bad").is_complete("link").is_unique("id").has_mean("label", c.is_one()).has_max("stock", lambda v: v.nope).has_mode("grade", c.greater_than(1)).satisfies_fd("grade@stock#_&_")
    out = c.DetectionSuite.on_data(parts).add_checks([c.Check("fine").has_size(c.is_positive()), bad]).run()
    assert out.status is c.CheckStatus.FAILURE and [r.status for r in out.check_results] == [c.CheckStatus.SUCCESS, c.CheckStatus.FAILURE]
    assert all(r.status is c.ConstraintStatus.FAILURE and r.message for r in out.check_results[1].constraint_results)
    rows = out.assertion_results_as_df().collect()
    assert len(rows) == 7 and out.success_metrics_as_df().where("name = 'Size'").first().value == "8.0"
    assert c.Check("a").constraints is not c.Check("b").constraints


def test_profile_and_suggestions(parts, spark):
    p = ProfilerSuite.on_data(parts).set_low_cardinality_threshold(10).run()
    assert p.num_records == 8 and p["label"].data_type == "String" and p["stock"].data_type == "Integral" and p["stock"].mean == pytest.approx(192 / 8)
    assert p["grade"].histogram["A"].absolute == 4 and len(p["stock"].approx_percentiles) == 100 and p.to_df(spark).count() == 8
    texts = spark.createDataFrame([("1",), ("2.5",), (None,), ("",)], "s string")
    q = ProfilerSuite.on_data(texts).run()["s"]
    assert q.data_type == "Fractional" and q.minimum == 1 and q.maximum == 2.5 and q.type_counts["Unknown"] == 1
    out = SuggestionSuite.on_data(parts).add_constraint_rules(DEFAULT_RULES).run()
    codes = {(s.column, s.rule) for s in out.suggestions}
    assert {("id", "CompleteRule"), ("link", "RetainCompletenessRule"), ("stock", "NonNegativeNumbersRule"), ("label", "ApproximatelyUniqueRule")} <= codes
    assert ("delta", "NonNegativeNumbersRule") not in codes and out.suggestion_df().columns == ["column", "description", "code"]
    big = spark.range(400).selectExpr("id", "CAST(id % 3 AS STRING) AS k")
    split = SuggestionSuite.on_data(big).add_constraint_rules(DEFAULT_RULES).set_test_set_ratio(0.5).set_random_seed(20).run()
    assert split.verification is not None and split.verification.status is c.CheckStatus.SUCCESS


def test_repositories(parts, spark, tmp_path):
    wanted = [a.Size(), a.Mean("stock"), a.ApproxQuantile("stock", (0.25, 0.5)), a.DataTypeAnalyzer("label"), a.FunctionalDependency("grade@stock#_&_"), a.Outliers("delta", "k_sigma", KSigmaParams(2.0)), a.Mean("nope")]
    context = analyze(parts, wanted)
    for repo in (MemoryMetricsRepository(), FileSystemMetricsRepository(str(tmp_path / "x" / "m.json")), FileSystemMetricsRepository(str(tmp_path / "y.json"), spark)):
        assert repo.load_by_key(ResultKey.of(5)).metrics == {}
        for date, tags in ((1, {"a": "x"}), (2, {"a": "y"}), (3, {"a": "x"}), (3, {"a": "x"})):
            repo.save(ResultKey.of(date, tags), context)
        back = repo.load_by_key(ResultKey.of(2, {"a": "y"}))
        assert back.metrics == {x: m for x, m in context.metrics.items() if m.is_success}
        assert [r.key.data_set_date for r in repo.load().get()] == [1, 2, 3]
        assert [r.key.data_set_date for r in repo.load().with_tag_values({"a": "x"}).after(1).before(2).get()] == [1]
        some = repo.load().for_analyzers([a.Size()]).get_success_metrics_as_df(spark)
        assert some.count() == 3 and {r.value for r in some.collect()} == {8.0}
        assert repo.load().get_success_metrics_as_df(spark).where("name = 'ApproxQuantile.0.5'").count() == 3
    for x in wanted:
        assert analyzer_from_json(analyzer_to_json(x)) == x
    assert Params.from_json(KSigmaParams(3.0).to_json()) == KSigmaParams(3.0)


STATEFUL = [a.Size(), a.Completeness("link"), a.Mean("delta"), a.Sum("stock"), a.Minimum("stock"), a.Maximum("stock"), a.StandardDeviation("delta"), a.Correlation("delta", "width"), a.MaxLength("label"), a.DataTypeAnalyzer("label"), a.ApproxCountDistinct("id"), a.ApproxQuantile("stock", 0.5), a.Compliance("w", "delta > 0"), a.Uniqueness("id"), a.Distinctness("id"), a.UniqueRatio("id"), a.Entropy("grade"), a.MutualInformation("grade", "delta")]


def test_merged_states_equal_the_whole(parts, spark, tmp_path):
    store = StateProvider(spark, str(tmp_path / "s"), STATEFUL)
    assert not store.has_state()
    for k, cond in enumerate(["stock < 20", "stock >= 20 AND stock < 30", "stock >= 30", "stock > 99"]):
        store.persist(parts.where(cond), k)
    store.persist(parts.where("stock < 20"), 0)  # again: replaced, not added
    assert store.has_state()
    whole, merged = analyze(parts, STATEFUL).metrics, store.compute().metrics
    for x in STATEFUL:
        assert merged[x].value == pytest.approx(whole[x].value) if not hasattr(whole[x].value, "values") or isinstance(whole[x].value, dict) else merged[x].value == whole[x].value, x


def test_runs_merge_states_write_results_and_feed_repairs(parts, spark, tmp_path):
    import json

    from tessera.operators.repair import Clean, RepairSuite
    from tessera.plans.runner import AnalysisRunner
    from tessera.sources import files

    wanted = [a.Size(), a.Mean("stock"), a.Maximum("stock")]
    store = StateProvider(spark, str(tmp_path / "s"), wanted)
    out = str(tmp_path / "o" / "r.json")
    for k, part in enumerate(("stock < 20", "stock >= 20")):
        context = AnalysisRunner.on_data(parts.where(part)).add_analyzers([*wanted, a.MinLength("label")]).merge_states_with(store, k).write_results_to(out, overwrite=True).run()
    assert context.metric(a.Size()).value == 8 and context.metric(a.MinLength("label")).value == 1
    assert len(json.loads(files.read(spark, out))) == 4
    with pytest.raises(FileExistsError):
        files.write(spark, out, "x")
    assert files.rename(spark, out, out + "2") and files.delete(spark, out + "2") and not files.exists(spark, out)
    fixed = RepairSuite.on_data(parts.where("stock < 20")).load_state_with(store).add_clean(Clean("m").replace_by_exp("stock", "stock = 9", "max")).run()
    assert sorted(r.stock for r in fixed.collect()) == [14, 14, 40]


def test_stream_is_verified_batch_by_batch(parts, spark, tmp_path):
    source = str(tmp_path / "in")
    parts.repartition(3).write.parquet(source)
    seen = []
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(source)
    store = StateProvider(spark, str(tmp_path / "st"), [a.Size(), a.Mean("delta")])
    q = monitor(stream, store, checkpoint=str(tmp_path / "ck"), checks=[c.Check("n").has_size(c.equal_to(8))], on_result=lambda i, ctx, res: seen.append((i, ctx.metric(a.Size()).value, ctx.metric(a.Mean("delta")).value, res.status)))
    q.awaitTermination(120)
    assert seen[-1][1:] == (8.0, 9.125, c.CheckStatus.SUCCESS) and len(seen) >= 2
