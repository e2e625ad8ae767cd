import numpy as np
import pytest
from fixtures import DELIVERIES, DELIVERIES_SCHEMA, PARTS, PARTS_SCHEMA, POINTS
from pyspark.sql import functions as F

from tessera.exceptions import IllegalParameterError, InconsistentDependenciesError, TransformError
from tessera.metrics import Violation
from tessera.operators import dependencies, entities, impute, outliers
from tessera.operators.graph import components
from tessera.operators.repair import Clean, RepairSuite, Way
from tessera.sources import io, session


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame(PARTS, PARTS_SCHEMA).cache()


@pytest.fixture(scope="module")
def deliveries(spark):
    return spark.createDataFrame(DELIVERIES, DELIVERIES_SCHEMA).cache()


def run(df, *cleans):
    return RepairSuite.on_data(df).add_cleans(cleans).run()


def ids(df):
    return sorted(r.id for r in df.collect())


FILTERS = [
    (lambda x: x.drop_null("link"), lambda r: r.link is not None), (lambda x: x.filter_by_exp("delta > 50"), lambda r: r.delta > 50), (lambda x: x.drop_by_exp("delta > 0"), lambda r: r.delta <= 0),
    (lambda x: x.filter_positive("delta"), lambda r: r.delta > 0), (lambda x: x.filter_non_negative("delta"), lambda r: r.delta >= 0), (lambda x: x.filter_by_lower_bound("stock", 27, False), lambda r: r.stock > 27),
    (lambda x: x.filter_by_upper_bound("stock", 14, True), lambda r: r.stock <= 14), (lambda x: x.filter_by_range("stock", 14, True, 27, True), lambda r: 14 <= r.stock <= 27), (lambda x: x.drop_by_range("stock", 14, True, 27, True), lambda r: not 14 <= r.stock <= 27),
    (lambda x: x.filter_by_values("grade", ["A"]), lambda r: r.grade == "A"), (lambda x: x.drop_by_values("label", ["407", "Q"]), lambda r: r.label not in ("407", "Q")), (lambda x: x.filter_by_data_type("label", "integral"), lambda r: r.label.isdigit()),
    (lambda x: x.drop_by_data_type("label", "numeric"), lambda r: not r.label.isdigit()), (lambda x: x.filter_by_pattern("label", "^V"), lambda r: r.label[0] == "V"), (lambda x: x.drop_by_pattern("label", "7"), lambda r: "7" not in r.label),
    (lambda x: x.filter_by_begin("link", "http"), lambda r: (r.link or "").startswith("http")), (lambda x: x.drop_by_begin("link", "http"), lambda r: r.link is not None and not r.link.startswith("http")), (lambda x: x.filter_by_end("mail", "net"), lambda r: (r.mail or "").endswith("net")),
    (lambda x: x.drop_by_end("mail", "org"), lambda r: r.mail is not None and not r.mail.endswith("org")), (lambda x: x.filter_by_sub_str("mail", "mill"), lambda r: "mill" in (r.mail or "")), (lambda x: x.drop_by_sub_str("mail", "mill"), lambda r: r.mail is not None and "mill" not in r.mail),
    (lambda x: x.filter_url("link"), lambda r: r.id in (1, 2, 4, 5) or (r.id == 6 and r.link is not None)), (lambda x: x.filter_email("mail"), lambda r: "@" in (r.mail or "")),
]


@pytest.mark.parametrize("k", range(len(FILTERS)))
def test_filters(parts, k):
    make, keeps = FILTERS[k]
    assert ids(run(parts, make(Clean("f")))) == sorted(r.id for r in parts.collect() if keeps(r))


def test_replacements_first_match_wins_and_read_the_old_row(parts):
    clean = (
        Clean("r").replace_negative("delta", Way.MAX).replace_by_range("delta", None, False, 45, False, "fixed", 45).replace_by_values("grade", ["A"], "fixed", "a").replace_by_excluded_values("grade", ["B", "C"], "fixed", "never")
        .replace_by_data_type("label", "integral", "fixed", "num").replace_by_sub_pattern("label", "[0-9]", "#").fill_null("link", "mode").replace_non_email("mail", "fixed", "x").replace_by_exp("stock", "delta < 0", "max").extract_by_sub_pattern("link", "[a-z]+")
    )
    out = {(r.id, r.width): r for r in run(parts, clean).collect()}
    assert out[(1, 52)].grade == "a" and out[(1, 52)].label == "num" and out[(5, 55)].label == "VX##" and out[(2, 47)].grade == "B"
    assert out[(3, 60)].delta == 71 and out[(3, 60)].stock == 40 and out[(1, 52)].delta == 45 and out[(6, 58)].link == "http://10.0.0.7/parts" and out[(5, 55)].link == "see"
    assert out[(4, 49)].mail is None and out[(5, 55)].mail == "x" and run(parts, clean).schema == parts.schema


def test_statistics_come_from_unfiltered_rows_and_kinds_run_in_order(parts):
    out = run(parts, Clean("x").fill_null("stock", "max").filter_by_exp("stock < 20").replace_by_exp("stock", "stock = 9", "max"))
    assert sorted(r.stock for r in out.collect()) == [14, 14, 40]


@pytest.mark.parametrize("way", ["forward", "backward"])
def test_ordered_fill_across_partitions(spark, way):
    rng = np.random.default_rng(4)
    xs = [None if rng.random() < 0.7 else int(i) for i in range(300)]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(xs)], "id long, v long, __h string").repartition(5)
    got = [r.v for r in run(df, Clean("c").fill_null("v", way)).orderBy("id").collect()]
    want, seq = [], xs if way == "forward" else xs[::-1]
    last = None
    for x in seq:
        want.append(x if x is not None else last)
        last = x if x is not None else last
    assert got == (want if way == "forward" else want[::-1])


def test_moving_average_across_partitions(spark):
    rng = np.random.default_rng(5)
    for n, radius in ((200, 5), (7, 30), (90, 25)):
        xs = [None if rng.random() < 0.2 else float(x) for x in rng.normal(0, 10, n)]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, v double").repartition(3)
        from tessera.operators.ordered import moving_average

        got = [r.m for r in moving_average(df, "v", "id", radius, "m").orderBy("id").collect()]
        for i, g in enumerate(got):
            near = [x for x in xs[max(0, i - radius) : i + radius + 1] if x is not None]
            assert (g is None) == (not near) and (g is None or g == pytest.approx(sum(near) / len(near)))


def test_duplicates(parts):
    keep = lambda how: {r.id: r.stock for r in run(parts, Clean("d").drop_duplicates("id", how, "stock")).collect()}
    assert keep("first")[6] == 9 and keep("last")[6] == 22 and len(keep("first")) == 7
    assert run(parts, Clean("d").drop_duplicates(["grade"])).count() == 3


def test_repairs_fail_early(parts):
    for bad in (Clean("x").drop_null("nope"), Clean("x").fill_null("label", "mean"), Clean("x").filter_positive("label"), Clean("x").fill_null("stock", "fixed"), Clean("x").fill_null("stock", "nonsense", 1), Clean("x").replace_by_sub_pattern("stock", "a", "b")):
        with pytest.raises(TransformError):
            run(parts, bad)


# --- dependencies -------------------------------------------------------------------------------------------------

DEPENDENCIES = ["depot,lane@gate#_,_&_", "gate@crew,size#_&_,_", "depot@crew#south&red#north&_", "lane,size@gate,crew#10,_&_,red#_,L&G1,_", "crew@size#_&_"]


def plain_violations(cfd):
    """(constant, variable) violations for each pattern and right-hand column, by comparing all pairs."""
    head, *patterns = cfd.split("#")
    lhs, rhs = (x.split(",") for x in head.split("@"))
    at = {n.split()[0]: i for i, n in enumerate(DELIVERIES_SCHEMA.split(", "))}
    show = lambda r, c: None if r[at[c]] is None else str(r[at[c]])
    out = []
    for p in patterns:
        left, right = (x.split(",") for x in p.split("&"))
        rows = [r for r in DELIVERIES if all(v in ("_", show(r, c)) for c, v in zip(lhs, left, strict=True))]
        found = []
        for c, v in zip(rhs, right, strict=True):
            pairs = [(x, y) for i, x in enumerate(rows) for y in rows[:i] if all(show(x, k) == show(y, k) for k in lhs) and show(x, c) != show(y, c)]
            found.append((0, len(pairs)) if v == "_" else (sum(show(r, c) != v for r in rows), 0))
        out.append(found)
    return out


@pytest.mark.parametrize("cfd", DEPENDENCIES)
def test_violations(deliveries, cfd):
    found = dependencies.violations(deliveries, cfd)
    (patterns,) = found.values.values()
    assert [[(v.const_vio, v.var_vio) for v in p.values()] for p in patterns.values()] == plain_violations(cfd)


def test_nulls_are_values_of_the_right_hand_side(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("a", "y"), (None, "z"), (None, "w")], "k string, v string")
    v = dependencies.violations(df, "k@v#_&_").values["k@v"]["_&_"]["v"]
    assert v == Violation(0, 5 + 1)


def test_dependency_repair_ends_without_violations(deliveries):
    rules = ["depot,lane@gate#north,20&G9#_,_&_"]
    fixed = run(deliveries, Clean("fd").repair_by_fd(rules, priorities=[2.0]).repair_by_fd("gate@depot#_&_"))
    assert not dependencies.violations(fixed, [*rules, "gate@depot#_&_"]).any()
    assert fixed.schema == deliveries.schema and fixed.count() == len(DELIVERIES)
    by = {r.id: r.gate for r in fixed.collect()}
    assert by[4] == by[5] == "G9" and by[3] == "G1" and by[8] == "G5"


def test_bad_dependencies():
    with pytest.raises(InconsistentDependenciesError):
        dependencies.parse_all(["A@B#1&2", "A@B#1&3"])
    with pytest.raises(IllegalParameterError):
        dependencies.parse("A,B@C#1&2")


# --- outliers -----------------------------------------------------------------------------------------------------


def test_univariate_outliers(parts):
    s = lambda name, **p: outliers.solver(name, "delta", outliers.PARAMS[name](**p))
    out = lambda x: sorted(r.delta for r in x.predict(parts).where(outliers.FLAG).collect())
    xs = sorted(r[5] for r in PARTS)
    mean, sd, median = np.mean(xs), np.std(xs), xs[3]
    mad = sorted(abs(x - median) for x in xs)[3]
    assert out(s("k_sigma")) == [x for x in xs if abs(x - mean) > 1.5 * sd] == [-300] and out(s("mad")) == [x for x in xs if abs(x - median) > 1.5 * mad] and out(s("tukey")) == [-300]
    assert s("k_sigma").bounds(parts) == pytest.approx((mean - 1.5 * sd, mean + 1.5 * sd)) and s("mad").bounds(parts) == (median - 1.5 * mad, median + 1.5 * mad)
    assert sorted(r.delta for r in s("mad").replace(parts, (1,)).collect()) == sorted(1 if abs(x - median) > 1.5 * mad else x for x in xs)
    assert s("k_sigma").remove(parts).count() == 7 and s("k_sigma").detect(parts) == 1
    assert outliers.solver("sma", "delta", outliers.SMAParams(1.0, 2)).ratio(parts) > 0


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([*POINTS, (99, None, 5)], "id long, x int, y int").cache()


@pytest.mark.parametrize(("model", "params"), [
    ("kmeans", outliers.KMeansParams(k=3, min_cluster=2)), ("gmm", outliers.GMMParams(k=2, deviation=1.5)), ("dbscan", outliers.DBSCANParams(3.0, 3)), ("lof", outliers.LOFParams(2, 0.08)),
    ("iforest", outliers.IForestParams(contamination=0.08)), ("pca", outliers.PCAParams(k=2, contamination=0.08)), ("autoencoder", outliers.AutoEncoderParams(contamination=0.08, hidden_size=2)),
])
def test_multivariate_models_find_the_odd_point(points, model, params):
    s = outliers.solver(model, ("x", "y"), params)
    flags = {r.id: r[outliers.FLAG] for r in s.predict(points).collect()}
    assert len(flags) == 15 and flags[99] is None
    if model not in ("autoencoder", "gmm", "kmeans"):
        assert flags[7] is True and sum(bool(x) for x in flags.values()) <= 2
    kept = s.remove(points)
    assert kept.columns == points.columns and kept.count() == 14 - sum(bool(x) for x in flags.values())
    assert s.replace(points, (0, 0)).count() == 15


def test_dbscan_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = np.round(np.concatenate([rng.normal(0, 0.4, (60, 2)), rng.normal(4, 0.5, (60, 2)), rng.uniform(-3, 8, (40, 2)), np.repeat([[9.0, 9.0]], 6, 0), [[-9, -9.0]]]), 2)
    eps, least = 0.5, 5
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2)) <= eps
    core = d.sum(1) >= least
    label = np.where(core, np.arange(len(pts)), -1)
    for _ in range(len(pts)):
        label = np.array([min(label[j] for j in np.flatnonzero(d[i] & core)) if core[i] else -1 for i in range(len(pts))])
    border = [bool((d[i] & core).any()) for i in range(len(pts))]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    got = outliers.solver("dbscan", ("x", "y"), outliers.DBSCANParams(eps, least)).labels(df).collect()
    by = {(r.x0, r.x1): r["__cluster"] for r in got}
    mine = [by[tuple(p)] for p in pts]
    assert [m == -1 for m in mine] == [not b for b in border]
    groups = lambda lab: {frozenset(np.flatnonzero((np.array(lab) == v) & core).tolist()) for v in set(np.array(lab)[core].tolist())}
    assert groups(mine) == groups(label)


def test_lof_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    pts, k = np.round(rng.normal(0, 1, (70, 2)), 3), 5
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, axis=1)[:, :k]
    kd = d[np.arange(70), nn[:, -1]]
    lrd = np.array([k / sum(max(d[i, j], kd[j]) for j in nn[i]) for i in range(70)])
    want = np.array([lrd[nn[i]].mean() / lrd[i] for i in range(70)])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double")
    got = {(r.x0, r.x1): r["__lof"] for r in outliers.solver("lof", ("x", "y"), outliers.LOFParams(k, block=16)).scores(df).collect()}
    assert [got[tuple(p)] for p in pts] == pytest.approx(want.tolist())


def test_isolation_paths(spark):
    assert outliers.path_constant(2) == 1 and outliers.path_constant(1) == 0 and outliers.path_constant(256) == pytest.approx(10.2448, abs=1e-3)
    x = np.array([[0.0], [1.0], [100.0]])
    rows = spark.createDataFrame([(float(v), 1 << k) for k, (v,) in enumerate(x)], "x0 double, h long")
    nodes, n = outliers.grow_forest(rows, 1, outliers.IForestParams(num_trees=3))
    assert len(nodes) == 3 and n == 3
    for tree in nodes:
        assert tree[0][4] == 3 and outliers.path_lengths(np.array(tree), x).sum() == pytest.approx(5, abs=0.01)  # one alone after one split, two after two


def test_a_forest_grows_from_every_row(spark):
    """Beyond any sample: each tree's root counts all rows, and its leaves too."""
    df = spark.range(6000).selectExpr("CAST(id % 977 AS DOUBLE) AS x0", "CAST(id % 89 AS DOUBLE) AS x1", "id * 7919 AS h").repartition(4)
    nodes, n = outliers.grow_forest(df, 2, outliers.IForestParams(num_trees=4, max_depth=6))
    assert n == 6000
    for tree in nodes:
        assert tree[0][4] == 6000 and sum(node[4] for node in tree if node[0] < 0) == 6000


@pytest.mark.parametrize(("model", "columns"), [("k_sigma", ("x",)), ("tukey", ("x",)), ("mad", ("x",)), ("kmeans", ("x", "y")), ("gmm", ("x", "y")), ("iforest", ("x", "y")), ("pca", ("x", "y")), ("autoencoder", ("x", "y"))])
def test_fitted_models_judge_other_rows(points, model, columns):
    params = outliers.PARAMS[model](**({"k": 2} if model == "pca" else {}), **({"num_epochs": 3} if model == "autoencoder" else {}))
    s = outliers.solver(model, columns, params)
    fitted = s.fit(points)
    few = points.where("id IN (1, 7, 99)")
    whole = {r.id: r[outliers.FLAG] for r in s.predict(points).collect()}
    assert {r.id: r[outliers.FLAG] for r in fitted.predict(few).collect()} == {k: whole[k] for k in (1, 7, 99)}
    assert fitted.detect(few) == sum(bool(whole[k]) for k in (1, 7, 99)) and fitted.remove(few).columns == points.columns
    with pytest.raises(IllegalParameterError):
        outliers.solver("lof", ("x", "y")).fit(points)


# --- entities, imputation, graph, io ------------------------------------------------------------------------------


def test_entities(spark):
    rows = [(1, "John A Smith", "Boston"), (2, "john smith", "boston"), (3, "Mary Jones", "Austin"), (4, "mary jones", "Austin TX"), (5, "Unrelated", "Nowhere"), (6, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, city string")
    got = {r.id: r.cluster for r in entities.resolve(df, ("name", "city")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    for how in ({"weight": "chi_square"}, {"comparison": "and"}, {"threshold": "max_div_2"}, {"similarity_type": "jaccard", "similarity_threshold": 0.3}):
        assert {1, 2} <= {r.id for r in entities.resolve(df, ("name", "city"), **how).collect()}
    assert entities.resolve(df.limit(0), ("name",)).count() == 0
    arrays = spark.createDataFrame([(1, ["red fox", "den"]), (2, ["red fox"]), (3, ["whale"])], "id long, words array<string>")
    assert {r.id for r in entities.resolve(arrays, ("words",)).collect()} == {1, 2}


def test_purging_drops_levels_that_cost_more_than_they_hold(spark):
    blocks = [(f"b{i}", p, 2) for i in range(50) for p in (2 * i, 2 * i + 1)] + [("huge", p, 100) for p in range(100)]
    df = spark.createDataFrame(blocks, "block string, pid int, size int")
    assert {r.size for r in entities.purge(df).select("size").distinct().collect()} == {2, 100}
    more = df.unionByName(spark.createDataFrame([(f"m{i}", p, 3) for i in range(60) for p in range(3)], df.schema))
    assert {r.size for r in entities.purge(more).select("size").distinct().collect()} <= {2, 3}
    one = df.where("size = 100")
    assert entities.purge(one).count() == 100


def test_attribute_clusters_keep_tokens_apart(spark):
    rows = [(1, "paris hilton", "rome"), (2, "hilton", "paris"), (3, "london", "paris rome")]
    df = spark.createDataFrame(rows, "id long, name string, city string")
    got = {r.attr: (r.cluster, r.entropy) for r in entities.attribute_clusters(df, ("name", "city"), target_threshold=0.5).collect()}
    assert got["name"][0] != got["city"][0] and got["city"][1] == pytest.approx(np.log(2))
    blocks = entities.token_blocks(df, ("name", "city"), clusters={"name": 0, "city": 1})
    assert {(r.block, r.pid) for r in blocks.collect()} == {("0_hilton", 1), ("0_hilton", 2), ("1_rome", 1), ("1_rome", 3), ("1_paris", 2), ("1_paris", 3)}
    assert len({r.cluster for r in entities.attribute_clusters(df, ("name", "city"), target_threshold=0.2).collect()}) == 1
    assert entities.resolve(df, ("name", "city"), cluster_attributes=True).columns == ["id", "name", "city", "cluster"]


def test_imputation(spark):
    rows = [(1, "a", "x", 1), (2, "a", "x", 1), (3, "b", "y", 2), (4, "a", None, None), (5, "b", "y", None), (6, "zz", "zz", None), (7, None, None, None)]
    df = spark.createDataFrame(rows, "id long, p string, q string, t int")
    got = {r.id: r.t for r in impute.naive_bayes(df, "t", ("p", "q")).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1, 5: 2, 6: None, 7: None}
    assert {r.id: r.t for r in run(df, Clean("i").impute_null("t", ["p"], [2])).collect()}[4] == 2


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5), (3, 1), (20, 19), (19, 18), (18, 17), (17, 16)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {2: 1, 3: 1, 11: 10, 20: 16, 19: 16, 18: 16, 17: 16}


def test_readers_and_writers(spark, parts, tmp_path):
    p = lambda x: str(tmp_path / x)
    io.to_parquet(parts, p("a"))
    io.to_orc(parts, p("b"))
    io.to_json(parts, p("c"))
    io.to_csv(parts, p("d"))
    io.to_text(parts.select("label"), p("e"))
    assert io.from_parquet(p("a")).count() == io.from_orc(p("b")).count() == io.from_json(p("c"), PARTS_SCHEMA).where("delta is not null").count() == io.from_csv(p("d")).count() == io.from_text(p("e")).count() == 8
    assert io.from_csv(p("d"), PARTS_SCHEMA).schema["stock"].dataType.simpleString() == "bigint"
    assert io.to_pandas(io.from_pandas(parts.toPandas().head(3))).shape == (3, 8)
    spark.sql("CREATE DATABASE IF NOT EXISTS tessera_test")
    io.to_hive(parts, "tessera_test", "parts")
    assert io.from_hive("tessera_test", "parts").count() == 8
    spark.sql("DROP DATABASE tessera_test CASCADE")
    assert session.session() is not None
