"""Session bootstrap: a caller's session is always used as it is."""

from __future__ import annotations

import configparser

from pyspark.sql import SparkSession

DEFAULTS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def settings(path: str) -> dict[str, str]:
    """The section [spark] of an ini file."""
    parser = configparser.ConfigParser()
    parser.optionxform = str  # type: ignore[assignment,method-assign]
    parser.read(path)
    return dict(parser["spark"]) if parser.has_section("spark") else {}


def session(mode: str = "local", threads: int | str = "*", *, app: str = "tessera", hive: bool = False, conf: dict[str, str] | None = None) -> SparkSession:
    """The active session, or a new one: local with some threads, or on the master that spark-submit or ``mode`` names."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    builder = builder.master(f"local[{threads}]") if mode == "local" else builder.master(mode) if mode else builder
    for k, v in (DEFAULTS | (conf or {})).items():
        builder = builder.config(k, v)
    return (builder.enableHiveSupport() if hive else builder).getOrCreate()


def restart(**how: object) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        active.stop()
    return session(**how)  # type: ignore[arg-type]
