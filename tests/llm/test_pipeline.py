"""The pipeline against its operators' definitions, and the oracle SQL on a small table."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import packing
from tessera.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_their_decisions_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(10_000, None, None, None, None), (10_001, "12 34", "en", "s", 5), (10_002, "password=abcdefgh123 in " + "an ordinary sentence of words " * 5, "en", "s", 5), (10_003, "password=abcdefgh123 in " + "an ordinary sentence of words " * 5, "en", "s", 5)], docs.schema
    )
    docs = docs.unionByName(extra)
    items = {r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not {10_000, 10_001} & seen["language_id"].keys() and len(seen["language_id"]) >= 199
    assert 10_002 in seen["near_dedup"] and 10_003 not in seen["near_dedup"]
    low = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
    windows = {" ".join(low(t).split()[i : i + 10]) for t in items for i in range(len(low(t).split()) - 9)}
    for d, t in seen["near_dedup"].items():
        assert (d in seen["decontamination"]) == (not any(w in low(t) for w in windows)), d
    assert seen["secret_scan"].keys() == seen["decontamination"].keys() and "abcdefgh123" not in seen["secret_scan"][10_002]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    ids = packing.word_ids(tokenizer_path("word_bpe_49k.json"))
    want = {d: len(x) + 1 for d, x in zip(seen["secret_scan"], ids([t or "" for t in seen["secret_scan"].values()]), strict=True)}
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r[c] for c in columns)) for r in QUERIES[name](spark, SF).collect()) == want
