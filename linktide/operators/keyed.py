"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` (one row per key).

    Adaptive execution can split a skewed partition of the left side only if
    both sides come straight out of a shuffle. A right side that was aggregated
    by the key would skip its shuffle, so the join also matches on a hash of the
    key, which no earlier partitioning covers. A right side that turns out small
    is broadcast at run time under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    on = list(on)
    tag = F.xxhash64(*on)
    joined = left.withColumn("__tag", tag).join(right.withColumn("__tag", tag), [*on, "__tag"], how)
    return joined.drop("__tag")


def attach_totals(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """Add per-key aggregates to every row: pre-aggregated, then joined back."""
    return attach(df, df.groupBy(*by).agg(*aggregates), by)


def attach_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row."""
    return df.join(F.broadcast(scalars))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in which x / 0 is 0."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def safe_log(x: Column) -> Column:
    """Natural logarithm in which log of zero or less is 0."""
    return F.when(x > 0, F.log(x)).otherwise(F.lit(0.0))
