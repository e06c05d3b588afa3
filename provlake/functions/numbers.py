"""Tolerant number reading, as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")


def parse_int(c: Column) -> Column:
    """``1_000``, ``1,000`` and ``3.0`` read as integers; at most 19 digits; else null."""
    s = _bare(c)
    digits = F.regexp_replace(F.substring_index(s, ".", 1), "[-+_,]", "")
    ok = s.rlike("^([+-][0-9_,]*|[0-9][0-9_,]*)([.]0*)?$") & F.length(digits).between(1, 19)
    return F.when(ok, F.concat(F.when(s.startswith("-"), "-").otherwise(""), digits).try_cast("bigint"))


def micros(c: Column) -> Column:
    """Decimal or exponent text in millionths, truncated; null when not representable."""
    s = _bare(c)
    d = F.when(s.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("decimal(38,18)"))
    scaled = F.try_multiply(d, F.lit(1_000_000).cast("decimal(7,0)"))
    return F.when(d >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)).try_cast("bigint")


def seconds(c: Column) -> Column:
    return F.call_function("div", micros(c), F.lit(1_000_000))


def percent_decrease(first: Column, last: Column) -> Column:
    """Whole percent from ``first`` to ``last``, truncated toward zero; null for a zero start."""
    a, z = (micros(x).cast("decimal(30,0)") for x in (first, last))
    return F.when(a != 0, F.call_function("div", (a - z) * 100, a))
