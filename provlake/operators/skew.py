"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000_000
BUCKETS = 65_536


def context_join(rows: DataFrame, context: DataFrame, key: str, size: str, spread: str,
                 rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Left join of many ``rows`` per key with one ``context`` row per key.

    ``context[size]`` counts the rows of a key.  Keys above ``rows_per_salt`` are
    split over several salts.  Other keys keep the single salt 0.  Whether the list
    of split keys is broadcast is left to Catalyst.
    """
    salts = F.ceil(F.col(size) / F.lit(rows_per_salt)).cast("int")
    hot = context.where(F.col(size) > rows_per_salt).select(key, salts.alias("_n"))
    left = (rows.join(hot, key, "left")
            .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_n")).cast("int"), F.lit(0)))
            .drop("_n"))
    right = context.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def crowded(rows: DataFrame, key: str, rows_per_task: int = ROWS_PER_SALT) -> DataFrame:
    """Buckets of keys with more than ``rows_per_task`` rows, at most 65,536 of them; counting moves no more than these."""
    return rows.groupBy(_bucket(key).alias("_bucket")).count().where(F.col("count") > rows_per_task).select("_bucket")


def apart(rows: DataFrame, key: str, crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that can meet on one task, and rows of keys in crowded buckets, which cannot.

    The buckets are a short list, so they are broadcast; where there are none, the second part is known to be empty before it runs.
    """
    cut, crowd = rows.withColumn("_bucket", _bucket(key)), F.broadcast(crowd)
    return cut.join(crowd, "_bucket", "left_anti").drop("_bucket"), cut.join(crowd, "_bucket", "left_semi").drop("_bucket")
