"""Small text files in any store that Spark reads."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return bool(fs.exists(p))


def read(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str, *, overwrite: bool = False) -> None:
    """The file appears under its name only when it is whole."""
    fs, p = _open(spark, path)
    if fs.exists(p) and not overwrite:
        raise FileExistsError(path)
    fresh = _open(spark, f"{path}.new")[1]
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(fresh, p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return bool(fs.delete(p, True))


def rename(spark: SparkSession, old: str, new: str) -> bool:
    fs, p = _open(spark, old)
    return bool(fs.rename(p, _open(spark, new)[1]))
