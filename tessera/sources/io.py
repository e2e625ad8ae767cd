"""Readers and writers.  Connectors that Spark does not bring are named by their format."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import session

HBASE_FORMAT = "org.apache.hadoop.hbase.spark"
NULL_CELL = "Null"  # what stands for a missing HBase cell


def _spark(spark: SparkSession | None) -> SparkSession:
    return spark or session()


def from_text(path: str, *, spark: SparkSession | None = None) -> DataFrame:
    return _spark(spark).read.text(path)


def from_csv(path: str, schema: T.StructType | str | None = None, sep: str = ",", header: bool = True, infer_schema: bool = True, *, spark: SparkSession | None = None) -> DataFrame:
    return _spark(spark).read.csv(path, schema=schema, sep=sep, header=header, inferSchema=infer_schema if schema is None else None)


def from_orc(path: str, *, spark: SparkSession | None = None) -> DataFrame:
    return _spark(spark).read.orc(path)


def from_json(path: str, schema: T.StructType | str | None = None, *, spark: SparkSession | None = None) -> DataFrame:
    return _spark(spark).read.json(path, schema=schema)


def from_parquet(path: str, *, spark: SparkSession | None = None) -> DataFrame:
    return _spark(spark).read.parquet(path)


def from_pandas(pdf: pd.DataFrame, *, spark: SparkSession | None = None) -> DataFrame:
    return _spark(spark).createDataFrame(pdf)


def from_jdbc(url: str, table: str, properties: dict[str, str] | None = None, *, spark: SparkSession | None = None, partition: dict[str, Any] | None = None) -> DataFrame:
    """``partition``: column, lowerBound, upperBound and numPartitions of a parallel read."""
    return _spark(spark).read.jdbc(url, table, properties=properties or {}, **(partition or {}))


def from_hive(db: str, table: str, *, spark: SparkSession | None = None) -> DataFrame:
    return _spark(spark).table(f"`{db}`.`{table}`")


def from_hbase(table: str, columns: list[str], *, spark: SparkSession | None = None, format: str = HBASE_FORMAT) -> DataFrame:
    """row_key and ``family:column`` columns as strings; needs the connector's jar on the class path."""
    mapping = ", ".join(["row_key STRING :key", *[f"`{c}` STRING {c}" for c in columns]])
    df = _spark(spark).read.format(format).option("hbase.table", table).option("hbase.columns.mapping", mapping).load()
    return df.select("row_key", *[F.coalesce(F.col(f"`{c}`"), F.lit(NULL_CELL)).alias(c) for c in columns])


def to_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).text(path)


def to_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep=sep, header=header)


def to_orc(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).orc(path)


def to_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def to_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def to_pandas(df: DataFrame) -> pd.DataFrame:
    """The whole table in the driver's memory."""
    return df.toPandas()


def to_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", properties: dict[str, str] | None = None) -> None:
    df.write.jdbc(url, table, mode=mode, properties=properties or {})


def to_hive(df: DataFrame, db: str, table: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).saveAsTable(f"`{db}`.`{table}`")


def to_hbase(df: DataFrame, table: str, row_key: str, *, format: str = HBASE_FORMAT) -> None:
    """Columns named ``family:column``; needs the connector's jar on the class path."""
    mapping = ", ".join([f"`{row_key}` STRING :key", *[f"`{c}` STRING {c}" for c in df.columns if c != row_key]])
    df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).write.format(format).option("hbase.table", table).option("hbase.columns.mapping", mapping).mode("append").save()
