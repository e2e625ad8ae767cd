"""Runs headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time
from pathlib import Path

os.environ.setdefault("OMP_NUM_THREADS", "1")

from pyspark.sql import SparkSession  # noqa: E402

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tessera.operators import analyzers as a  # noqa: E402
from tessera.plans import catalog  # noqa: E402
from tessera.plans.runner import analyze  # noqa: E402

ENGINE = (
    "scan_metrics_lineitem", "frequency_metrics_orders", "frequency_metrics_compound_key", "mutual_information", "check_lineitem", "profile_full", "suggest_constraints", "filters_customer",
    "replacers_customer", "fill_null_mean", "fill_null_forward", "dedup_first", "fd_violations", "fd_repair", "outliers_k_sigma", "outliers_sma", "outliers_kmeans", "bayes_impute", "er_entities", "merged_states",
)


def one_job_each(spark: SparkSession, d: str):  # noqa: ANN201
    """The metrics of scan_metrics_lineitem, a job for each: what fusing them saves."""
    df = catalog.table(spark, d, "lineitem")
    for x in [a.Size(), a.Completeness("l_orderkey"), a.Sum("l_quantity"), a.Correlation("l_extendedprice", "l_quantity"), *[k(c) for c in ("l_quantity", "l_extendedprice", "l_discount") for k in (a.Minimum, a.Maximum, a.Mean, a.StandardDeviation)]]:
        analyze(df, [x])
    return spark.range(1)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: catalog.QUERIES[n] for n in ENGINE} | {"scan_metrics_one_job_each": one_job_each}
    if importlib.util.find_spec("tessera.llm") is not None:
        from tessera.llm import queries as llm

        queries |= llm.QUERIES
    took: dict[str, float] = {}
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for name, query in queries.items():
        began = time.time()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
