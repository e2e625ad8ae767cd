"""Registered queries of the data-quality engine, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checks as c
from ..metrics import Distribution
from ..operators import analyzers as a
from ..operators import dependencies, entities, impute, outliers
from ..operators.repair import Clean, RepairSuite
from . import profile as profiles
from . import suggest
from .runner import analyze, frequencies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def metric_rows(spark: SparkSession, df: DataFrame, analyzers: list[a.Analyzer], digits: int = 6) -> DataFrame:
    """(name, instance, value) of the metrics, numbers rounded."""
    found = analyze(df, analyzers)
    rows = []
    for m in found.metrics.values():
        if m.error is not None:
            raise m.error
        rows += [(name, instance, round(v, digits)) for _, instance, name, v in m.flatten()]
    return spark.createDataFrame(rows, "name string, instance string, value double")


def union_sql(rows: list[tuple[str, str, str]], source: str, digits: int = 6) -> str:
    """One SELECT for (name, instance, expression) over a source."""
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS v{i}" for i, (_, _, e) in enumerate(rows))
    parts = " UNION ALL ".join(f"SELECT '{n}' AS name, '{i}' AS instance, round(v{k}, {digits}) AS value FROM t" for k, (n, i, _) in enumerate(rows))
    return f"WITH t AS (SELECT {cols} FROM {source}) {parts}"


# --- scan metrics -------------------------------------------------------------------------------------------------

_NUM = ("l_quantity", "l_extendedprice", "l_discount")
_SCAN = [("Size", "*", "count(*)"), ("Completeness", "l_orderkey", "avg(CASE WHEN l_orderkey IS NOT NULL THEN 1.0 ELSE 0.0 END)")]
for _x in _NUM:
    _SCAN += [("Minimum", _x, f"min({_x})"), ("Maximum", _x, f"max({_x})"), ("Mean", _x, f"avg({_x})"), ("StandardDeviation", _x, f"stddev_pop({_x})")]
_SCAN += [("Sum", "l_quantity", "sum(l_quantity)"), ("Correlation", "l_extendedprice,l_quantity", "corr(l_extendedprice, l_quantity)")]


@register(union_sql(_SCAN, "lineitem"))
def scan_metrics_lineitem(spark, d):  # noqa: ANN001, ANN201
    wanted: list[a.Analyzer] = [a.Size(), a.Completeness("l_orderkey")]
    for x in _NUM:
        wanted += [a.Minimum(x), a.Maximum(x), a.Mean(x), a.StandardDeviation(x)]
    wanted += [a.Sum("l_quantity"), a.Correlation("l_extendedprice", "l_quantity")]
    return metric_rows(spark, table(spark, d, "lineitem"), wanted)


@register(union_sql([("Size", "*", "count_if(o_orderstatus = 'F')"), ("Mean", "o_totalprice", "avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END)"), ("Completeness", "o_custkey,o_x", "sum(CASE WHEN o_orderstatus = 'F' AND o_x IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE / count_if(o_orderstatus = 'F')"), ("Compliance", "cheap", "sum(CASE WHEN o_orderstatus = 'F' AND o_totalprice < 100000 THEN 1 ELSE 0 END)::DOUBLE / count_if(o_orderstatus = 'F')")], "(SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_x FROM orders)"))
def scan_metrics_where(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "orders").withColumn("o_x", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    w = "o_orderstatus = 'F'"
    return metric_rows(spark, df, [a.Size(w), a.Mean("o_totalprice", w), a.Completeness(("o_custkey", "o_x"), w), a.Compliance("cheap", "o_totalprice < 100000", w)])


@register(union_sql([("PatternMatch", "c_name", "avg(CASE WHEN regexp_matches(c_name, '[0-9]+1$') THEN 1.0 ELSE 0.0 END)"), ("MinLength", "c_name", "min(length(c_name))"), ("MaxLength", "c_name", "max(length(c_name))"), ("MaxLength", "c_mktsegment", "max(length(c_mktsegment))")], "customer"))
def string_metrics_customer(spark, d):  # noqa: ANN001, ANN201
    return metric_rows(spark, table(spark, d, "customer"), [a.PatternMatch("c_name", "[0-9]+1$"), a.MinLength("c_name"), a.MaxLength("c_name"), a.MaxLength("c_mktsegment")])


_KIND = "CASE WHEN {0} IS NULL THEN 'Unknown' WHEN regexp_full_match({0}, '(-|\\+)? ?[0-9]*\\.[0-9]*') THEN 'Fractional' WHEN regexp_full_match({0}, '(-|\\+)? ?[0-9]*') THEN 'Integral' WHEN {0} IN ('true', 'false') THEN 'Boolean' ELSE 'String' END"
_MIXED = "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN '-1.5' WHEN 3 THEN 'true' WHEN 4 THEN '1e5' ELSE '' END"


def mixed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    m = F.when(k == 1, F.col("o_orderkey").cast("string")).when(k == 2, "-1.5").when(k == 3, "true").when(k == 4, "1e5").when(k == 5, "")
    return table(spark, d, "orders").select("o_orderkey", m.alias("m"))


@register(f"""WITH k AS (SELECT {_KIND.format('m')} AS k FROM (SELECT {_MIXED} AS m FROM orders)),
t AS (SELECT b.bin, count(k.k) AS absolute FROM (VALUES ('Unknown'), ('Fractional'), ('Integral'), ('Boolean'), ('String')) b(bin) LEFT JOIN k ON k.k = b.bin GROUP BY 1)
SELECT bin, CAST(absolute AS BIGINT) AS absolute, round(absolute / (SELECT count(*)::DOUBLE FROM orders), 6) AS ratio FROM t""")
def data_type_histogram(spark, d):  # noqa: ANN001, ANN201
    return distribution_rows(spark, analyze(mixed(spark, d), [a.DataTypeAnalyzer("m")]).metrics[a.DataTypeAnalyzer("m")].value)


def distribution_rows(spark: SparkSession, dist: Distribution) -> DataFrame:
    return spark.createDataFrame([(k, v.absolute, round(v.ratio, 6)) for k, v in dist.values.items()], "bin string, absolute long, ratio double")


@register(union_sql([(f"ApproxQuantile.{q}", "l_quantity", f"quantile_disc(l_quantity, {q})") for q in (0.25, 0.5, 0.75)], "lineitem"))
def approx_quantile(spark, d):  # noqa: ANN001, ANN201
    """The error is so small that percentiles are exact."""
    return metric_rows(spark, table(spark, d, "lineitem"), [a.ApproxQuantile("l_quantity", (0.25, 0.5, 0.75), 1e-7)])


@register()
def approx_count_distinct(spark, d):  # noqa: ANN001, ANN201
    return metric_rows(spark, table(spark, d, "orders"), [a.ApproxCountDistinct("o_custkey"), a.ApproxCountDistinct("o_orderstatus", "o_totalprice > 1000")])


@register("SELECT 'Mode' AS name, instance, value FROM (SELECT 'p_brand' AS instance, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 1) UNION ALL SELECT 'Mode', instance, value FROM (SELECT 'p_size' AS instance, CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY p_size ORDER BY n DESC, value LIMIT 1)")
def mode_part(spark, d):  # noqa: ANN001, ANN201
    found = analyze(table(spark, d, "part"), [a.Mode("p_brand"), a.Mode("p_size")])
    return spark.createDataFrame([(m.name, m.instance, m.value) for m in found.metrics.values()], "name string, instance string, value string")


# --- grouping metrics ---------------------------------------------------------------------------------------------

_FREQ = "WITH f AS (SELECT {k}, count(*) AS n FROM {t} WHERE {nn} GROUP BY {k}), r AS (SELECT count(*)::DOUBLE AS rows FROM {t})"


@register(_FREQ.format(k="o_custkey", t="orders", nn="o_custkey IS NOT NULL") + " SELECT * FROM (SELECT 'Uniqueness' AS name, 'o_custkey' AS instance, round(count_if(n = 1) / max(rows), 6) AS value FROM f, r UNION ALL SELECT 'Distinctness', 'o_custkey', round(count(*) / max(rows), 6) FROM f, r UNION ALL SELECT 'UniqueRatio', 'o_custkey', round(count_if(n = 1)::DOUBLE / count(*), 6) FROM f UNION ALL SELECT 'Entropy', 'o_custkey', round(-sum(n / rows * ln(n / rows)), 6) FROM f, r)")
def frequency_metrics_orders(spark, d):  # noqa: ANN001, ANN201
    return metric_rows(spark, table(spark, d, "orders"), [a.Uniqueness("o_custkey"), a.Distinctness("o_custkey"), a.UniqueRatio("o_custkey"), a.Entropy("o_custkey")])


_KEYED = "(SELECT l_orderkey, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber END AS line FROM lineitem)"


@register(_FREQ.format(k="l_orderkey, line", t=_KEYED, nn="l_orderkey IS NOT NULL AND line IS NOT NULL") + " SELECT 'Uniqueness' AS name, 'l_orderkey,line' AS instance, round(count_if(n = 1) / max(rows), 6) AS value FROM f, r UNION ALL SELECT 'Distinctness', 'l_orderkey,line', round(count(*) / max(rows), 6) FROM f, r UNION ALL SELECT 'UniqueRatio', 'l_orderkey,line', round(count_if(n = 1)::DOUBLE / count(*), 6) FROM f")
def frequency_metrics_compound_key(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "lineitem").withColumn("line", F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber")))
    key = ("l_orderkey", "line")
    return metric_rows(spark, df, [a.Uniqueness(key), a.Distinctness(key), a.UniqueRatio(key)])


@register("WITH j AS (SELECT l_returnflag x, l_linestatus y, count(*)::DOUBLE n FROM lineitem GROUP BY 1, 2), r AS (SELECT sum(n) t FROM j), m AS (SELECT *, sum(n) OVER (PARTITION BY x) nx, sum(n) OVER (PARTITION BY y) ny FROM j) SELECT 'MutualInformation' AS name, 'l_linestatus,l_returnflag' AS instance, round(sum(n / t * ln((n / t) / ((nx / t) * (ny / t)))), 6) AS value FROM m, r")
def mutual_information(spark, d):  # noqa: ANN001, ANN201
    return metric_rows(spark, table(spark, d, "lineitem"), [a.MutualInformation("l_returnflag", "l_linestatus")])


@register("WITH h AS (SELECT coalesce(CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END, 'NullValue') AS bin, count(*) AS n FROM part GROUP BY 1) SELECT bin, CAST(n AS BIGINT) AS absolute, round(n / (SELECT count(*)::DOUBLE FROM part), 6) AS ratio FROM h ORDER BY n DESC, bin LIMIT 5")
def histogram_top(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "part").withColumn("b", F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand")))
    return distribution_rows(spark, a.Histogram("b", None, 5).compute(df).value)


@register("SELECT CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS VARCHAR) AS bin, CAST(count(*) AS BIGINT) AS absolute, round(count(*) / (SELECT count(*)::DOUBLE FROM orders), 6) AS ratio FROM orders GROUP BY floor(o_totalprice / 50000)")
def histogram_binned(spark, d):  # noqa: ANN001, ANN201
    return distribution_rows(spark, a.Histogram("o_totalprice", lambda x: F.floor(x / 50000)).compute(table(spark, d, "orders")).value)


@register("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def frequency_table(spark, d):  # noqa: ANN001, ANN201
    return frequencies(table(spark, d, "lineitem"), ("l_returnflag", "l_linestatus")).select(F.col("g0").alias("l_returnflag"), F.col("g1").alias("l_linestatus"), "n")


# --- checks -------------------------------------------------------------------------------------------------------


def lineitem_check() -> c.Check:
    return (
        c.Check("lineitem")
        .has_size(c.greater_than(0))
        .is_complete("l_orderkey")
        .is_non_negative("l_discount")
        .is_positive("l_quantity")
        .has_mean("l_quantity", c.in_range(20, 30))
        .has_max("l_discount", c.less_than_or_equal_to(0.05))
        .is_contained_in("l_linestatus", ["O", "F"])
        .is_in_range("l_tax", 0, 0.08, True, True)
        .is_primary_key(["l_orderkey", "l_linenumber"])
        .has_approx_quantile("l_quantity", 0.5, c.in_range(20, 30))
        .satisfies_expression("l_extendedprice > l_quantity")
        .has_count_distinct("l_returnflag", c.equal_to(3))
        .matches_pattern("l_returnflag", "^[ANR]$")
        .satisfies_fd("l_returnflag@l_linestatus#_&_")
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.DetectionSuite.on_data(table(spark, sf_dir, "lineitem")).add_check(lineitem_check()).run().assertion_results_as_df().select("constraint", "status")


@register("""WITH t AS (SELECT count(*) > 0 a, count(l_orderkey) = count(*) b, bool_and(l_discount >= 0) c, bool_and(l_quantity > 0) d, avg(l_quantity) > 20 AND avg(l_quantity) < 30 e, max(l_discount) <= 0.05 f,
bool_and(l_linestatus IN ('O', 'F')) g, bool_and(l_tax >= 0 AND l_tax <= 0.08) h, quantile_disc(l_quantity, 0.5) BETWEEN 20.5 AND 29.5 j, bool_and(l_extendedprice > l_quantity) k, count(DISTINCT l_returnflag) = 3 l, bool_and(regexp_matches(l_returnflag, '^[ANR]$')) m FROM lineitem),
u AS (SELECT bool_and(n = 1) i FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber)), v AS (SELECT bool_and(n = 1) o FROM (SELECT count(DISTINCT l_linestatus) n FROM lineitem GROUP BY l_returnflag)),
s AS (SELECT * FROM t, u, v)
SELECT x.constraint, CASE WHEN ok THEN 'Success' ELSE 'Failure' END AS status FROM s, LATERAL (VALUES ('Size(*)', a), ('Completeness(l_orderkey)', b), ('Compliance(l_discount is non-negative)', c), ('Compliance(l_quantity is positive)', d), ('Mean(l_quantity)', e), ('Maximum(l_discount)', f), ('Compliance(l_linestatus contained in O,F)', g), ('Compliance(l_tax between 0 and 0.08)', h), ('Uniqueness(l_linenumber,l_orderkey)', i), ('ApproxQuantile(l_quantity)', j), ('Compliance(l_extendedprice > l_quantity)', k), ('CountDistinct(l_returnflag)', l), ('PatternMatch(l_returnflag)', m), ('FunctionalDependency(l_returnflag@l_linestatus#_&_)', o)) x("constraint", ok)""".replace("x.constraint", 'x."constraint"'))
def check_lineitem(spark, d):  # noqa: ANN001, ANN201
    return flagship(spark, d)


def _groups(columns: str, pick: str) -> str:
    return f"(SELECT {pick} FROM (SELECT count(*) AS n FROM h WHERE {' AND '.join(c + ' IS NOT NULL' for c in columns.split(', '))} GROUP BY {columns}), (SELECT count(*)::DOUBLE AS rows FROM h))"


def _entropy(columns: str) -> str:
    return _groups(columns, "-sum(n / rows * ln(n / rows))")


_BOTH = ["c_nationkey", "c_mktsegment"]
#: A constraint by the check's method, and the same by SQL over the table h.
_METHODS = [
    (lambda k: k.has_completeness("bal", c.greater_than(0.85)), "(SELECT count(bal)::DOUBLE / count(*) > 0.85 FROM h)"),
    (lambda k: k.are_complete(["c_custkey", "c_nationkey"]), "(SELECT bool_and(c_custkey IS NOT NULL AND c_nationkey IS NOT NULL) FROM h)"),
    (lambda k: k.have_completeness(["bal", "name"], c.in_range(0.6, 0.65)), "(SELECT count_if(bal IS NOT NULL AND name IS NOT NULL)::DOUBLE / count(*) BETWEEN 0.6 AND 0.65 FROM h)"),
    (lambda k: k.is_unique("c_custkey"), f"{_groups('c_custkey', 'max(n)')} = 1"),
    (lambda k: k.has_uniqueness("name", c.greater_than(0.9)), f"{_groups('name', 'count_if(n = 1) / max(rows)')} > 0.9"),
    (lambda k: k.have_uniqueness(_BOTH, c.is_zero()), f"{_groups('c_nationkey, c_mktsegment', 'count_if(n = 1)')} = 0"),
    (lambda k: k.has_distinctness("c_nationkey", c.less_than(0.05)), f"{_groups('c_nationkey', 'count(*) / max(rows)')} < 0.05"),
    (lambda k: k.have_distinctness(_BOTH, c.less_than(0.05)), f"{_groups('c_nationkey, c_mktsegment', 'count(*) / max(rows)')} < 0.05"),
    (lambda k: k.has_unique_ratio("name", c.is_one()), f"{_groups('name', 'count_if(n = 1)::DOUBLE / count(*)')} = 1"),
    (lambda k: k.have_unique_ratio(_BOTH, c.greater_than(0.5)), f"{_groups('c_nationkey, c_mktsegment', 'count_if(n = 1)::DOUBLE / count(*)')} > 0.5"),
    (lambda k: k.has_histogram_values("c_mktsegment", lambda d: d["BUILDING"].absolute > 290), "(SELECT count_if(c_mktsegment = 'BUILDING') > 290 FROM h)"),
    (lambda k: k.has_approx_count_distinct("c_nationkey", c.in_range(20, 30)), "(SELECT count(DISTINCT c_nationkey) BETWEEN 20 AND 30 FROM h)"),
    (lambda k: k.is_greater_than("c_custkey", 0), "(SELECT bool_and(c_custkey > 0) FROM h)"),
    (lambda k: k.is_greater_than_or_equal_to("c_custkey", 0), "(SELECT bool_and(c_custkey >= 0) FROM h)"),
    (lambda k: k.is_less_than("c_nationkey", 25), "(SELECT bool_and(c_nationkey < 25) FROM h)"),
    (lambda k: k.is_less_than_or_equal_to("c_nationkey", 23), "(SELECT bool_and(c_nationkey <= 23) FROM h)"),
    (lambda k: k.is_positive("c_nationkey"), "(SELECT bool_and(coalesce(c_nationkey, 0) > 0) FROM h)"),
    (lambda k: k.is_non_negative("c_nationkey"), "(SELECT bool_and(coalesce(c_nationkey, 0) >= 0) FROM h)"),
    (lambda k: k.has_data_type("name", "string"), "(SELECT bool_and(name IS NULL OR NOT regexp_full_match(name, '(-|\\+)? ?[0-9]*\\.?[0-9]*|true|false')) FROM h)"),
    (lambda k: k.begins_with("name", "Customer", c.greater_than(0.75)), "(SELECT count_if(name LIKE 'Customer%')::DOUBLE / count(*) > 0.75 FROM h)"),
    (lambda k: k.ends_with("name", "7", c.greater_than(0.11)), "(SELECT count_if(name LIKE '%7')::DOUBLE / count(*) > 0.11 FROM h)"),
    (lambda k: k.contains_str("name", "#00", c.less_than(0.75)), "(SELECT count_if(name LIKE '%#00%')::DOUBLE / count(*) < 0.75 FROM h)"),
    (lambda k: k.contains_url("name", c.is_zero()), "(SELECT count_if(name LIKE '%://%') = 0 FROM h)"),
    (lambda k: k.contains_email("name", c.is_positive()), "(SELECT count_if(name LIKE '%@%') > 0 FROM h)"),
    (lambda k: k.has_min("bal", c.is_negative()), "(SELECT min(bal) < 0 FROM h)"),
    (lambda k: k.has_sum("c_nationkey", c.greater_than(17000)), "(SELECT sum(c_nationkey) > 17000 FROM h)"),
    (lambda k: k.has_mode("c_nationkey", c.in_range(5, 25)), "(SELECT c_nationkey BETWEEN 5 AND 25 FROM h GROUP BY c_nationkey ORDER BY count(*) DESC, CAST(c_nationkey AS VARCHAR) LIMIT 1)"),
    (lambda k: k.has_standard_deviation("bal", c.in_range(3000, 3300)), "(SELECT stddev_pop(bal) BETWEEN 3000 AND 3300 FROM h)"),
    (lambda k: k.has_entropy("c_mktsegment", c.greater_than(1.6)), f"{_entropy('c_mktsegment')} > 1.6"),
    (lambda k: k.has_mutual_information("c_mktsegment", "c_nationkey", c.greater_than(0.02)), f"{_entropy('c_mktsegment')} + {_entropy('c_nationkey')} - {_entropy('c_nationkey, c_mktsegment')} > 0.02"),
    (lambda k: k.has_correlation("c_custkey", "c_nationkey", c.greater_than(0)), "(SELECT corr(c_custkey, c_nationkey) > 0 FROM h)"),
    (lambda k: k.has_max_length("name", c.equal_to(18)), "(SELECT max(length(name)) = 18 FROM h)"),
    (lambda k: k.has_min_length("c_mktsegment", c.equal_to(8)), "(SELECT min(length(c_mktsegment)) = 8 FROM h)"),
    (lambda k: k.has_outliers("bal", "k_sigma", assertion=c.greater_than(0.1)), "(SELECT count_if(abs(bal - m) > 1.5 * s)::DOUBLE / count(bal) > 0.1 FROM h, (SELECT avg(bal) m, stddev_pop(bal) s FROM h))"),
]


def customer_check() -> c.Check:
    check = c.Check("customer")
    for add, _ in _METHODS:
        add(check)
    return check


def _told(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- repairs ------------------------------------------------------------------------------------------------------

_HOLES = "(SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name FROM customer)"


def holes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.when(key % 7 != 0, F.col("c_acctbal")).alias("bal"), F.when(key % 5 != 0, F.col("c_name")).alias("name"))


@register(f"WITH h AS {_HOLES} " + " UNION ALL ".join(f"SELECT {_told(str(x))} AS \"constraint\", CASE WHEN {sql} THEN 'Success' ELSE 'Failure' END AS status" for x, (_, sql) in zip(customer_check().constraints, _METHODS, strict=True)))
def check_customer(spark, d):  # noqa: ANN001, ANN201
    """Every method that ``check_lineitem`` leaves out, but entities."""
    return c.DetectionSuite.on_data(holes(spark, d)).add_check(customer_check()).run().assertion_results_as_df().select("constraint", "status")


def cleaned(df: DataFrame, clean: Clean) -> DataFrame:
    return RepairSuite.on_data(df).add_clean(clean).run()


@register(f"SELECT * FROM {_HOLES} WHERE bal IS NOT NULL AND bal >= 0 AND bal <= 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT regexp_matches(name, '9$') AND c_nationkey <> 3")
def filters_customer(spark, d):  # noqa: ANN001, ANN201
    return cleaned(holes(spark, d), Clean("f").drop_null("bal").filter_by_range("bal", 0, True, 5000, True).filter_by_values("c_mktsegment", ["BUILDING", "MACHINERY"]).drop_by_end("name", "9").filter_by_exp("c_nationkey <> 3"))


@register(f"SELECT * FROM {_HOLES} WHERE NOT (bal > 1000 AND bal <= 3000) AND c_mktsegment NOT IN ('BUILDING') AND NOT (c_nationkey = 7) AND regexp_matches(name, '^Cust') AND regexp_matches(CAST(c_custkey AS VARCHAR), '^(-|\\+)? ?[0-9]*$')")
def droppers_customer(spark, d):  # noqa: ANN001, ANN201
    return cleaned(holes(spark, d), Clean("d").drop_by_range("bal", 1000, False, 3000, True).drop_by_values("c_mktsegment", ["BUILDING"]).drop_by_exp("c_nationkey = 7").filter_by_begin("name", "Cust").filter_by_data_type("c_custkey", "integral"))


@register("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_acctbal <= 8000 AND c_nationkey >= 3 AND c_nationkey < 20")
def filters_bounds(spark, d):  # noqa: ANN001, ANN201
    clean = Clean("b").filter_positive("c_acctbal").filter_by_upper_bound("c_acctbal", 8000, True).filter_by_lower_bound("c_nationkey", 3, True).filter_by_upper_bound("c_nationkey", 20, False).filter_non_negative("c_nationkey")
    return cleaned(table(spark, d, "customer"), clean).select("c_custkey", "c_acctbal")


_CONTACT = "CASE page_id % 4 WHEN 0 THEN 'mail me@site' || page_id || '.com now' WHEN 1 THEN url WHEN 2 THEN NULL ELSE 'plain ' || page_id END"


def contacts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    c = F.when(k % 4 == 0, F.concat(F.lit("mail me@site"), k.cast("string"), F.lit(".com now"))).when(k % 4 == 1, F.col("url")).when(k % 4 == 3, F.concat(F.lit("plain "), k.cast("string")))
    return table(spark, d, "pages").select("page_id", "url", c.alias("contact"))


@register(f"SELECT page_id, 'url' AS kind FROM (SELECT page_id, {_CONTACT} AS c FROM pages) WHERE regexp_matches(c, '(http(s?)|ftp|file)://[-A-Za-z0-9+&@#/%?=~_|!:,.;]+[-A-Za-z0-9+&@#/%=~_|]') UNION ALL SELECT page_id, 'email' FROM (SELECT page_id, {_CONTACT} AS c FROM pages) WHERE regexp_matches(c, '([A-Za-z0-9_.-])+@([A-Za-z0-9_.-])+\\.([A-Za-z]{{2,4}})') UNION ALL SELECT page_id, 'rest' FROM (SELECT page_id, {_CONTACT} AS c FROM pages) WHERE NOT contains(c, 'http') AND NOT starts_with(c, 'mail') AND NOT ends_with(c, '7')")
def filters_strings(spark, d):  # noqa: ANN001, ANN201
    df = contacts(spark, d)
    kept = {"url": Clean("u").filter_url("contact"), "email": Clean("e").filter_email("contact"), "rest": Clean("r").drop_by_sub_str("contact", "http").drop_by_begin("contact", "mail").drop_by_end("contact", "7")}
    parts = [cleaned(df, c).select("page_id", F.lit(k).alias("kind")) for k, c in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(f"SELECT o_orderkey, 'numeric' AS kind FROM (SELECT o_orderkey, {_MIXED} AS m FROM orders) WHERE {_KIND.format('m')} IN ('Integral', 'Fractional') UNION ALL SELECT o_orderkey, 'not integral' FROM (SELECT o_orderkey, {_MIXED} AS m FROM orders) WHERE {_KIND.format('m')} IN ('Fractional', 'Boolean', 'String') UNION ALL SELECT o_orderkey, 'null' FROM (SELECT o_orderkey, {_MIXED} AS m FROM orders) WHERE m IS NULL")
def filters_data_types(spark, d):  # noqa: ANN001, ANN201
    df = mixed(spark, d)
    kept = {"numeric": Clean("n").filter_by_data_type("m", "numeric"), "not integral": Clean("i").drop_by_data_type("m", "integral"), "null": Clean("0").filter_by_data_type("m", "null")}
    parts = [cleaned(df, c).select("o_orderkey", F.lit(k).alias("kind")) for k, c in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(f"SELECT o_orderkey, CASE WHEN {_KIND.format('m')} = 'Boolean' THEN 'bool' WHEN NOT ({_KIND.format('m')} IN ('Integral', 'Fractional')) THEN 'text' ELSE m END AS m FROM (SELECT o_orderkey, {_MIXED} AS m FROM orders)".replace("WHEN NOT (", "WHEN m IS NOT NULL AND NOT ("))
def replacers_data_types(spark, d):  # noqa: ANN001, ANN201
    return cleaned(mixed(spark, d), Clean("t").replace_by_data_type("m", "boolean", "fixed", "bool").replace_by_excluded_data_type("m", "numeric", "fixed", "text")).select("o_orderkey", "m")


@register(f"SELECT page_id, CASE WHEN c IS NULL THEN NULL WHEN NOT regexp_matches(c, '([A-Za-z0-9_.-])+@([A-Za-z0-9_.-])+\\.([A-Za-z]{{2,4}})') THEN 'none' ELSE regexp_extract(c, '[a-z]+@[a-z0-9]+', 0) END AS c FROM (SELECT page_id, {_CONTACT} AS c FROM pages)")
def replacers_email(spark, d):  # noqa: ANN001, ANN201
    return cleaned(contacts(spark, d), Clean("e").replace_non_email("contact", "fixed", "none").extract_by_sub_pattern("contact", "[a-z]+@[a-z0-9]+")).select("page_id", F.col("contact").alias("c"))


@register("SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN (SELECT avg(c_acctbal) FROM customer) WHEN c_nationkey = 5 THEN (SELECT max(c_acctbal) FROM customer) ELSE c_acctbal END, 6) AS c_acctbal, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'OTHER' WHEN regexp_matches(c_mktsegment, 'ING$') THEN 'B' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def replacers_statistics(spark, d):  # noqa: ANN001, ANN201
    clean = Clean("s").replace_negative("c_acctbal", "mean").replace_by_exp("c_acctbal", "c_nationkey = 5", "max").replace_by_excluded_values("c_mktsegment", ["BUILDING", "MACHINERY"], "fixed", "OTHER").replace_by_pattern("c_mktsegment", "ING$", "fixed", "B")
    return cleaned(table(spark, d, "customer"), clean).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")


def _fill(way: str, expr: str):  # noqa: ANN202
    sql = f"SELECT c_custkey, round(coalesce(bal, {expr if way == 'fixed' else f'(SELECT {expr} FROM {_HOLES})'}), 6) AS bal FROM {_HOLES}"

    def f(spark, d):  # noqa: ANN001, ANN202
        return cleaned(holes(spark, d), Clean(way).fill_null("bal", way, -1.0)).select("c_custkey", F.round("bal", 6).alias("bal"))

    f.__name__ = f"fill_null_{way}"
    register(sql)(f)


for _w, _e in {"fixed": "-1.0", "mean": "avg(bal)", "max": "max(bal)", "min": "min(bal)"}.items():
    _fill(_w, _e)


@register(f"SELECT c_custkey, coalesce(bal, (SELECT quantile_disc(bal, 0.5) FROM {_HOLES})) IS NOT NULL AS filled, coalesce(name, (SELECT name FROM {_HOLES} WHERE name IS NOT NULL GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)) AS name FROM {_HOLES}")
def fill_null_median_mode(spark, d):  # noqa: ANN001, ANN201
    """The median is approximate, so that only its presence is compared."""
    out = cleaned(holes(spark, d), Clean("m").fill_null("bal", "median").fill_null("name", "mode"))
    return out.select("c_custkey", F.col("bal").isNotNull().alias("filled"), "name")


_EV = "(SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 OR event_id % 9 IN (1, 2, 3) THEN NULL ELSE value END AS v FROM events)"


def event_holes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.when(~((k % 4 == 0) | (k % 9).isin(1, 2, 3)), F.col("value")).alias("v"))


def _carry(way: str, window: str):  # noqa: ANN202
    sql = f"SELECT event_id, coalesce(v, {window}) AS v FROM {_EV}"

    def f(spark, d):  # noqa: ANN001, ANN202
        return cleaned(event_holes(spark, d), Clean(way, index_col="event_id").fill_null("v", way)).select("event_id", "v")

    f.__name__ = f"fill_null_{way}"
    register(sql)(f)


_carry("forward", "last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
_carry("backward", "first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")


@register("SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 1.0 WHEN c_acctbal > 9000 THEN 9000.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment IN ('BUILDING') THEN 'B' WHEN NOT regexp_matches(c_mktsegment, '^[A-M]') THEN 'other' ELSE regexp_replace(c_mktsegment, '[AEIOU]', '_', 'g') END AS c_mktsegment, regexp_extract(c_name, '[0-9]+', 0) AS c_name FROM customer")
def replacers_customer(spark, d):  # noqa: ANN001, ANN201
    clean = Clean("r").replace_non_positive("c_acctbal", "fixed", 1.0).replace_by_range("c_acctbal", 9000, False, None, False, "fixed", 9000.0).replace_by_values("c_mktsegment", ["BUILDING"], "fixed", "B").replace_by_excluded_pattern("c_mktsegment", "^[A-M]", "fixed", "other").replace_by_sub_pattern("c_mktsegment", "[AEIOU]", "_").extract_by_sub_pattern("c_name", "[0-9]+")
    return cleaned(table(spark, d, "customer"), clean).select("c_custkey", "c_acctbal", "c_mktsegment", "c_name")


@register("SELECT page_id, CASE WHEN regexp_matches(url, '(http(s?)|ftp|file)://[-A-Za-z0-9+&@#/%?=~_|!:,.;]+[-A-Za-z0-9+&@#/%=~_|]') THEN url ELSE 'none' END AS url FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'no url' ELSE url END AS url FROM pages)")
def replace_non_url(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "no url").otherwise(F.col("url")).alias("url"))
    return cleaned(df, Clean("u").replace_non_url("url", "fixed", "none"))


def _keep(which: str, order: str):  # noqa: ANN202
    def f(spark, d):  # noqa: ANN001, ANN202
        return cleaned(table(spark, d, "events"), Clean(which).drop_duplicates("user_id", which, "event_id")).select("user_id", "event_id", "event_type")

    f.__name__ = f"dedup_{which}"
    register(f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id {order}) AS r FROM events) WHERE r = 1")(f)


_keep("first", "ASC")
_keep("last", "DESC")


@register("SELECT DISTINCT event_type FROM events")
def dedup_default(spark, d):  # noqa: ANN001, ANN201
    return cleaned(table(spark, d, "events"), Clean("any").drop_duplicates("event_type")).select("event_type")


# --- dependencies -------------------------------------------------------------------------------------------------


def _pairs(lhs: str, rhs: str, where: str = "TRUE") -> str:
    return f"(SELECT CAST(coalesce(sum((n * n - sq) / 2), 0) AS BIGINT) FROM (SELECT sum(k) AS n, sum(k * k) AS sq FROM (SELECT {lhs}, {rhs}, CAST(count(*) AS HUGEINT) AS k FROM part WHERE {where} GROUP BY {lhs}, {rhs}) GROUP BY {lhs}))"


_CFDS = ("p_brand@p_type,p_size#_&_,_", "p_size@p_type#7&STANDARD#_&_", "p_brand,p_size@p_type#_,3&_")


@register(f"SELECT 0 AS cfd_idx, 0 AS pat_idx, 'p_type' AS attr, CAST(0 AS BIGINT) AS const_vio, {_pairs('p_brand', 'p_type')} AS var_vio UNION ALL SELECT 0, 0, 'p_size', 0, {_pairs('p_brand', 'p_size')} UNION ALL SELECT 1, 0, 'p_type', (SELECT count(*) FROM part WHERE p_size = 7 AND p_type IS DISTINCT FROM 'STANDARD'), 0 UNION ALL SELECT 1, 1, 'p_type', 0, {_pairs('p_size', 'p_type')} UNION ALL SELECT 2, 0, 'p_type', 0, {_pairs('p_brand, p_size', 'p_type', 'p_size = 3')}")
def fd_violations(spark, d):  # noqa: ANN001, ANN201
    return dependencies.violation_table(table(spark, d, "part"), dependencies.parse_all(_CFDS))


@register("WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), b AS (SELECT p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM n) WHERE r = 1) SELECT p_partkey, p_brand, b.p_type FROM part JOIN b USING (p_brand)")
def fd_repair(spark, d):  # noqa: ANN001, ANN201
    return cleaned(table(spark, d, "part"), Clean("fd").repair_by_fd("p_brand@p_type#_&_", "p_partkey")).select("p_partkey", "p_brand", "p_type")


@register("SELECT p_partkey, p_size, CASE WHEN p_size = 7 THEN 'STANDARD' WHEN p_size = 8 THEN 'ECONOMY' ELSE p_type END AS p_type FROM part")
def fd_repair_constants(spark, d):  # noqa: ANN001, ANN201
    return cleaned(table(spark, d, "part"), Clean("c").repair_by_fd("p_size@p_type#7&STANDARD#8&ECONOMY", "p_partkey")).select("p_partkey", "p_size", "p_type")


# --- outliers -----------------------------------------------------------------------------------------------------


@register("WITH s AS (SELECT avg(l_extendedprice) m, stddev_pop(l_extendedprice) s FROM lineitem) SELECT l_orderkey, l_linenumber FROM lineitem, s WHERE l_extendedprice BETWEEN m - 1.5 * s AND m + 1.5 * s")
def outliers_k_sigma(spark, d):  # noqa: ANN001, ANN201
    return outliers.solver("k_sigma", "l_extendedprice").remove(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber")


def _exact(q: float) -> str:
    return f"quantile_disc(c_acctbal, {q})"


@register(f"WITH s AS (SELECT {_exact(0.25)} a, {_exact(0.75)} b FROM customer) SELECT c_custkey FROM customer, s WHERE c_acctbal BETWEEN a - 0.4 * (b - a) AND b + 0.4 * (b - a)")
def outliers_tukey(spark, d):  # noqa: ANN001, ANN201
    return outliers.solver("tukey", "c_acctbal", outliers.TukeyTestParams(0.4, 1e-7)).remove(table(spark, d, "customer")).select("c_custkey")


@register(f"WITH m AS (SELECT {_exact(0.5)} m FROM customer), s AS (SELECT m, quantile_disc(abs(c_acctbal - m), 0.5) d FROM customer, m GROUP BY m) SELECT c_custkey, CASE WHEN c_acctbal < m - 1.5 * d OR c_acctbal > m + 1.5 * d THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer, s")
def outliers_mad_replaced(spark, d):  # noqa: ANN001, ANN201
    return outliers.solver("mad", "c_acctbal", outliers.MADParams(1.5, 1e-7)).replace(table(spark, d, "customer"), (0.0,)).select("c_custkey", "c_acctbal")


@register("WITH s AS (SELECT stddev_pop(value) s FROM events), m AS (SELECT event_id, value, avg(value) OVER (ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) ma FROM events) SELECT event_id FROM m, s WHERE abs(ma - value) > 1.5 * s")
def outliers_sma(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "events")
    return outliers.solver("sma", "value", index_col="event_id").predict(df).where(outliers.FLAG).select("event_id")


@register("SELECT round(avg(CASE WHEN c_acctbal < m - 1.5 * s OR c_acctbal > m + 1.5 * s THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM customer, (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) s FROM customer)")
def outlier_ratio(spark, d):  # noqa: ANN001, ANN201
    m = a.Outliers("c_acctbal", "k_sigma").compute(table(spark, d, "customer"))
    return spark.createDataFrame([(round(m.value, 6),)], "ratio double")


def _model(name: str, columns: tuple[str, ...], params: outliers.Params | None = None):  # noqa: ANN202
    def f(spark, d):  # noqa: ANN001, ANN202
        return outliers.solver(name, columns, params, index_col="p_partkey").predict(table(spark, d, "part")).select("p_partkey", F.col(outliers.FLAG).alias("outlier"))

    f.__name__ = f"outliers_{name}"
    register()(f)


_model("kmeans", ("p_size", "p_retailprice"))
_model("gmm", ("p_size", "p_retailprice"))
_model("lof", ("p_size", "p_retailprice"))
_model("iforest", ("p_size", "p_retailprice"))
_model("pca", ("p_size", "p_retailprice"), outliers.PCAParams(k=2))
_model("autoencoder", ("p_size", "p_retailprice"))



@register("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) x, p_retailprice y FROM part),
c AS (SELECT a.p_partkey FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0 GROUP BY a.p_partkey HAVING count(*) >= 4),
near AS (SELECT DISTINCT a.p_partkey FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0 JOIN c ON c.p_partkey = b.p_partkey)
SELECT p_partkey, p_partkey NOT IN (SELECT p_partkey FROM near) AS outlier FROM p""")
def outliers_dbscan(spark, d):  # noqa: ANN001, ANN201
    out = outliers.solver("dbscan", ("p_size", "p_retailprice"), outliers.DBSCANParams(2.0, 4)).predict(table(spark, d, "part"))
    return out.select("p_partkey", F.col(outliers.FLAG).alias("outlier"))


@register(f"""WITH q AS (SELECT {_exact(0.25)} a, {_exact(0.5)} m, {_exact(0.75)} b FROM customer), e AS (SELECT quantile_disc(abs(c_acctbal - m), 0.5) d FROM customer, q)
SELECT 'tukey' AS model, round(avg(CASE WHEN c_acctbal < a - 0.3 * (b - a) OR c_acctbal > b + 0.3 * (b - a) THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM customer, q
UNION ALL SELECT 'mad', round(avg(CASE WHEN c_acctbal < m - 1.5 * d OR c_acctbal > m + 1.5 * d THEN 1.0 ELSE 0.0 END), 6) FROM customer, q, e
UNION ALL SELECT 'sma', round(avg(CASE WHEN abs(ma - c_acctbal) > 1.5 * s THEN 1.0 ELSE 0.0 END), 6) FROM (SELECT c_acctbal, avg(c_acctbal) OVER (ORDER BY c_custkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) ma FROM customer), (SELECT stddev_pop(c_acctbal) s FROM customer)""")
def outlier_ratios(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "customer")
    of = {"tukey": outliers.TukeyTestParams(0.3, 1e-7), "mad": outliers.MADParams(1.5, 1e-7), "sma": outliers.SMAParams(1.5, 3)}
    rows = [(m, round(outliers.solver(m, "c_acctbal", p, index_col="c_custkey").ratio(df), 6)) for m, p in of.items()]
    return spark.createDataFrame(rows, "model string, ratio double")


# --- imputation, entities -----------------------------------------------------------------------------------------

_HOLED = "(SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS p_type FROM part)"


@register(f"""WITH t AS (SELECT p_partkey, CAST(p_brand AS VARCHAR) a, CAST(p_size AS VARCHAR) b, p_type FROM {_HOLED}), nv AS (SELECT p_type v, count(*)::DOUBLE nv FROM t WHERE p_type IS NOT NULL GROUP BY 1),
sa AS (SELECT a x, p_type v, count(*) n FROM t WHERE p_type IS NOT NULL GROUP BY 1, 2), sb AS (SELECT b x, p_type v, count(*) n FROM t WHERE p_type IS NOT NULL GROUP BY 1, 2),
h AS (SELECT p_partkey, a, b, a IN (SELECT x FROM sa) ua, b IN (SELECT x FROM sb) ub FROM t WHERE p_type IS NULL),
s AS (SELECT p_partkey, nv.v, ln(nv) + CASE WHEN ua THEN ln(coalesce(sa.n / nv, 1 / nv)) ELSE 0 END + CASE WHEN ub THEN ln(coalesce(sb.n / nv, 1 / nv)) ELSE 0 END score, (sa.n IS NOT NULL)::INT + (sb.n IS NOT NULL)::INT observed, ua OR ub usable FROM h CROSS JOIN nv LEFT JOIN sa ON sa.x = a AND sa.v = nv.v LEFT JOIN sb ON sb.x = b AND sb.v = nv.v),
w AS (SELECT p_partkey, v FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY observed DESC, round(score, 9) DESC, v) r FROM s WHERE usable) WHERE r = 1)
SELECT t.p_partkey, coalesce(t.p_type, w.v) AS p_type FROM t LEFT JOIN w USING (p_partkey)""")
def bayes_impute(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.when(F.col("p_partkey") % 10 != 0, F.col("p_type")).alias("p_type"))
    return impute.naive_bayes(df, "p_type", ("p_brand", "p_size"), index_col="p_partkey").select("p_partkey", "p_type")


@register("WITH t AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]')) AS block FROM (SELECT item_id, regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g') AS text FROM benchmark)), u AS (SELECT * FROM t WHERE block <> ''), s AS (SELECT block, count(*) AS size FROM u GROUP BY 1 HAVING count(*) > 1) SELECT item_id, block, CAST(size AS BIGINT) AS size FROM u JOIN s USING (block)")
def er_token_blocks(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", "[^a-zA-Z0-9 ]", " "))
    return entities.token_blocks(df, ("text",), "item_id").select(F.col("pid").alias("item_id"), "block", "size")


@register("WITH t AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]')) AS block FROM (SELECT item_id, regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g') AS text FROM benchmark)), u AS (SELECT * FROM t WHERE block <> '') SELECT x.item_id AS i, y.item_id AS j, CAST(count(*) AS DOUBLE) AS w FROM u x JOIN u y ON x.block = y.block AND x.item_id < y.item_id GROUP BY 1, 2")
def er_edges(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", "[^a-zA-Z0-9 ]", " "))
    return entities.weighted_edges(entities.token_blocks(df, ("text",), "item_id"))


_PRUNED = """WITH t AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]')) AS block FROM (SELECT item_id, regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g') AS text FROM benchmark)), u AS (SELECT * FROM t WHERE block <> ''),
e AS (SELECT x.item_id AS i, y.item_id AS j, CAST(count(*) AS DOUBLE) AS w FROM u x JOIN u y ON x.block = y.block AND x.item_id < y.item_id GROUP BY 1, 2),
n AS (SELECT p, sum(w) / (count(*) + 1) AS t FROM (SELECT i AS p, w FROM e UNION ALL SELECT j, w FROM e) GROUP BY p)
SELECT i, j, w FROM e JOIN n a ON a.p = i JOIN n b ON b.p = j WHERE w >= a.t AND w >= b.t"""


@register(_PRUNED)
def er_pruned_edges(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", "[^a-zA-Z0-9 ]", " "))
    return entities.prune(entities.weighted_edges(entities.token_blocks(df, ("text",), "item_id")), comparison="and")


@register(_PRUNED.replace("w >= a.t AND w >= b.t", "w >= a.t OR w >= b.t"))
def er_pruned_edges_or(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", "[^a-zA-Z0-9 ]", " "))
    return entities.prune(entities.weighted_edges(entities.token_blocks(df, ("text",), "item_id")), comparison="or")


@register(_PRUNED.replace("sum(w) / (count(*) + 1) AS t", "max(w) / 2 AS t"))
def er_pruned_edges_half_of_most(spark, d):  # noqa: ANN001, ANN201
    df = table(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", "[^a-zA-Z0-9 ]", " "))
    return entities.prune(entities.weighted_edges(entities.token_blocks(df, ("text",), "item_id")), comparison="and", threshold="max_div_2")


@register()
def er_entities(spark, d):  # noqa: ANN001, ANN201
    return entities.resolve(table(spark, d, "benchmark"), ("text",), index_col="item_id").select("item_id", "cluster")


_WORDS_OF = " UNION ALL ".join(f"SELECT '{x}' AS attr, unnest(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]')) AS t FROM part" for x in ("p_name", "p_brand", "p_type"))


@register(f"""WITH c AS (SELECT attr, t, count(*) AS n FROM ({_WORDS_OF}) WHERE t <> '' GROUP BY ALL), s AS (SELECT attr, count(*) AS m FROM c GROUP BY attr),
j AS (SELECT x.attr AS a, y.attr AS b, count(*) AS n FROM c x JOIN c y ON x.t = y.t GROUP BY ALL), l AS (SELECT a, b FROM j JOIN s sa ON sa.attr = a JOIN s sb ON sb.attr = b WHERE n::DOUBLE / (sa.m + sb.m - n) >= 0.3),
k AS (SELECT l1.a AS attr, min(CASE l2.b WHEN 'p_name' THEN 0 WHEN 'p_brand' THEN 1 ELSE 2 END) AS cluster FROM l l1 JOIN l l2 ON l1.b = l2.a GROUP BY 1),
m AS (SELECT cluster, t, sum(n)::DOUBLE AS n FROM c JOIN k USING (attr) GROUP BY ALL), e AS (SELECT cluster, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM m GROUP BY 1)
SELECT attr, cluster, round(entropy, 6) AS entropy FROM k JOIN e USING (cluster)""")
def er_attribute_clusters(spark, d):  # noqa: ANN001, ANN201
    out = entities.attribute_clusters(table(spark, d, "part"), ("p_name", "p_brand", "p_type"), "p_partkey")
    return out.select("attr", "cluster", F.round("entropy", 6).alias("entropy"))


# --- profiles, suggestions, states --------------------------------------------------------------------------------

_PROFILED = [("o_orderkey", "Integral"), ("o_custkey", "Integral"), ("o_totalprice", "Fractional")]


@register(" UNION ALL ".join(f"SELECT '{x}' AS \"column\", '{k}' AS data_type, 1.0::DOUBLE AS completeness, min({x})::DOUBLE AS minimum, max({x})::DOUBLE AS maximum, round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std_dev FROM orders" for x, k in _PROFILED))
def profile_numeric(spark, d):  # noqa: ANN001, ANN201
    p = profiles.profile(table(spark, d, "orders"), [x for x, _ in _PROFILED]).to_df(spark)
    return p.select("column", "data_type", "completeness", "minimum", "maximum", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"))


@register("SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS bin, CAST(count(*) AS BIGINT) AS absolute FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def profile_histograms(spark, d):  # noqa: ANN001, ANN201
    p = profiles.profile(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    rows = [(x, k, v.absolute) for x, prof in p.profiles.items() for k, v in prof.histogram.values.items()]
    return spark.createDataFrame(rows, "column string, bin string, absolute long")


@register()
def profile_full(spark, d):  # noqa: ANN001, ANN201
    return profiles.profile(table(spark, d, "lineitem")).to_df(spark)


@register()
def suggest_constraints(spark, d):  # noqa: ANN001, ANN201
    return suggest.SuggestionSuite.on_data(table(spark, d, "customer")).add_constraint_rules(suggest.DEFAULT_RULES).run().suggestion_df()


@register(union_sql([("Size", "*", "count(*)"), ("Mean", "l_tax", "avg(l_tax)"), ("StandardDeviation", "l_tax", "stddev_pop(l_tax)"), ("Correlation", "l_quantity,l_tax", "corr(l_quantity, l_tax)"), ("Maximum", "l_tax", "max(l_tax)"), ("Uniqueness", "l_partkey", "(SELECT count_if(n = 1) FROM (SELECT count(*) n FROM lineitem GROUP BY l_partkey))::DOUBLE / count(*)")], "lineitem"))
def merged_states(spark, d):  # noqa: ANN001, ANN201
    """States of three parts, stored and merged."""
    import uuid

    from ..operators.graph import checkpoint_dir
    from ..repository import StateProvider

    df = table(spark, d, "lineitem")
    wanted = [a.Size(), a.Mean("l_tax"), a.StandardDeviation("l_tax"), a.Correlation("l_tax", "l_quantity"), a.Maximum("l_tax"), a.Uniqueness("l_partkey")]
    store = StateProvider(spark, f"{checkpoint_dir(spark)}/states-{uuid.uuid4().hex}", wanted)
    for part in range(3):
        store.persist(df.where(F.pmod(F.col("l_orderkey"), F.lit(3)) == part), part)
    rows = [(name, instance, round(v, 6)) for m in store.compute().metrics.values() for _, instance, name, v in m.flatten()]
    return spark.createDataFrame(rows, "name string, instance string, value double")


@register("SELECT 'Size' AS name, '*' AS instance, CAST(count(*) AS DOUBLE) AS value, 'b' AS tag FROM orders UNION ALL SELECT 'Maximum', 'o_totalprice', max(o_totalprice), 'b' FROM orders UNION ALL SELECT 'ApproxQuantile.0.5', 'o_totalprice', quantile_disc(o_totalprice, 0.5), 'b' FROM orders")
def repository_metrics(spark, d):  # noqa: ANN001, ANN201
    """Metrics stored under two keys and read back by tag."""
    import uuid

    from ..operators.graph import checkpoint_dir
    from ..repository import FileSystemMetricsRepository, ResultKey

    repo = FileSystemMetricsRepository(f"{checkpoint_dir(spark)}/metrics-{uuid.uuid4().hex}.json", spark)
    wanted = [a.Size(), a.Maximum("o_totalprice"), a.ApproxQuantile("o_totalprice", 0.5, 1e-7)]
    df = table(spark, d, "orders")
    repo.save(ResultKey.of(1, {"tag": "a"}), analyze(df.where("o_orderstatus = 'F'"), wanted))
    repo.save(ResultKey.of(2, {"tag": "b"}), analyze(df, wanted))
    return repo.load().with_tag_values({"tag": "b"}).after(2).get_success_metrics_as_df(spark).select("name", "instance", "value", F.col("tags")["tag"].alias("tag"))


@register("SELECT f AS format, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) t(f)")
def readers_and_writers(spark, d):  # noqa: ANN001, ANN201
    import uuid

    from ..operators.graph import checkpoint_dir
    from ..sources import io

    df, folder = table(spark, d, "nation"), f"{checkpoint_dir(spark)}/io-{uuid.uuid4().hex}"
    schema = df.schema
    io.to_csv(df, f"{folder}/csv")
    io.to_json(df, f"{folder}/json")
    io.to_orc(df, f"{folder}/orc")
    io.to_parquet(df, f"{folder}/parquet")
    back = {"csv": io.from_csv(f"{folder}/csv", schema, spark=spark), "json": io.from_json(f"{folder}/json", schema, spark=spark), "orc": io.from_orc(f"{folder}/orc", spark=spark), "parquet": io.from_parquet(f"{folder}/parquet", spark=spark)}
    out = None
    for k, x in back.items():
        part = x.select(F.lit(k).alias("format"), *df.columns)
        out = part if out is None else out.unionByName(part)
    return out
