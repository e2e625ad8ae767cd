"""Patterns and content types of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide content types and the URL and e-mail checks.
FRACTIONAL = r"^(-|\+)? ?\d*\.\d*$"
INTEGRAL = r"^(-|\+)? ?\d*$"
BOOLEAN = r"^(true|false)$"
URL = r"(http(s?)|ftp|file)://[-A-Za-z0-9+&@#/%?=~_|!:,.;]+[-A-Za-z0-9+&@#/%=~_|]"
EMAIL = r"([A-Za-z0-9_\-\.])+\@([A-Za-z0-9_\-\.])+\.([A-Za-z]{2,4})"

#: Content type of a string as a number: null, fractional, integral, boolean, other.
KINDS = ("Unknown", "Fractional", "Integral", "Boolean", "String")


def kind(c: Column) -> Column:
    c = c.cast("string")
    return F.when(c.isNull(), 0).when(c.rlike(FRACTIONAL), 1).when(c.rlike(INTEGRAL), 2).when(c.rlike(BOOLEAN), 3).otherwise(4)


def is_type(c: Column, data_type: str) -> Column:
    """Whether a value is of a constrainable type; null where the value is null, except for the type null itself."""
    s = c.cast("string")
    if data_type == "null":
        return c.isNull()
    if data_type == "fractional":
        return s.rlike(FRACTIONAL)
    if data_type == "integral":
        return s.rlike(INTEGRAL)
    if data_type == "boolean":
        return s.rlike(BOOLEAN)
    if data_type == "numeric":
        return s.rlike(FRACTIONAL) | s.rlike(INTEGRAL)
    if data_type == "string":
        return ~(s.rlike(FRACTIONAL) | s.rlike(INTEGRAL) | s.rlike(BOOLEAN))
    raise ValueError(f"unknown data type {data_type!r}")


def matches(c: Column, pattern: str) -> Column:
    """Whether the pattern is found with a non-empty match; nulls do not match."""
    return F.coalesce(F.regexp_extract(c, pattern, 0) != "", F.lit(False))
