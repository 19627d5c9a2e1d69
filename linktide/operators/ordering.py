"""Order-dependent operators without a single-task window.

Rows are range-partitioned on their order, the partition number is frozen by a
checkpoint, each partition is scanned on its own, and only the totals of the
partitions (at most one row per partition boundary) travel between them. A key
that holds most of the rows is therefore spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linktide.session import settle

SLICE = "__slice"


def sliced(df: DataFrame, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Range-partition by ``by`` then ``order_by`` and freeze the partition number."""
    keys = [F.col(c) for c in (*by, *order_by)]
    return settle(df.repartitionByRange(*keys).withColumn(SLICE, F.spark_partition_id()))


def _within(order_by: Sequence[str], by: Sequence[str]):
    return (
        Window.partitionBy(SLICE, *by)
        .orderBy(*[F.col(c) for c in order_by])
        .rowsBetween(Window.unboundedPreceding, 0)
    )


def running_sums(
    df: DataFrame,
    sums: Mapping[str, Column],
    order_by: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums of ``sums`` per ``by`` along ``order_by``.

    ``by + order_by`` must identify a row. The carried-over totals are kept only
    for groups that cross a partition boundary, so that table has fewer rows
    than there are partitions and is safe to broadcast.
    """
    by = list(by)
    valued = df.select("*", *[e.alias(f"__v_{n}") for n, e in sums.items()])
    parts = sliced(valued, order_by, by)
    local = parts.select(
        "*", *[F.sum(f"__v_{n}").over(_within(order_by, by)).alias(f"__r_{n}") for n in sums]
    )
    totals = parts.groupBy(SLICE, *by).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = (
        Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        SLICE,
        *by,
        F.count(F.lit(1)).over(before).alias("__earlier"),
        *[F.sum(f"__t_{n}").over(before).alias(f"__c_{n}") for n in sums],
    ).where("__earlier > 0")
    joined = local.join(F.broadcast(carried), [SLICE, *by], "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"__r_{n}") + F.coalesce(F.col(f"__c_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def numbered(
    df: DataFrame, order_by: Sequence[str], name: str = "position", keep: Sequence[str] | None = None
) -> DataFrame:
    """Dense 0-based position of every row in the global order ``order_by``, with the columns ``keep`` (all).

    Each partition is sorted and counted off before it is frozen, so rows are shuffled once, and only the
    numbers of rows of the partitions before it are added.
    """
    kept = list(df.columns if keep is None else keep)
    keys = [F.col(c) for c in order_by]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = settle(placed.select(*kept, F.monotonically_increasing_id().alias("__at")))
    place = F.shiftright("__at", 33).alias(SLICE)  # the upper bits of the id number the partition
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.groupBy(place).agg(F.count(F.lit(1)).alias("__n")).select(
        SLICE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__earlier"))
    joined = parts.select("*", place).join(F.broadcast(carried), SLICE)
    position = F.col("__earlier") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*kept, position.alias(name))


def floored_walk(
    df: DataFrame,
    increment: Column,
    order_by: Sequence[str],
    by: Sequence[str],
) -> DataFrame:
    """Per ``by``: total of the increments and lowest running total.

    A walk that starts at ``x`` and is floored at zero after every increment
    ends at ``total + max(x, -lowest)``, so these two numbers replace the
    ordered fold; slices of one key combine by addition and minimum.
    """
    by = list(by)
    parts = sliced(df.select(*by, *order_by, increment.alias("__v")), order_by, by)
    local = parts.select(*by, SLICE, "__v", F.sum("__v").over(_within(order_by, by)).alias("__r"))
    chunks = local.groupBy(*by, SLICE).agg(
        F.sum("__v").alias("__t"), F.min("__r").alias("__low")
    )
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.withColumn("__c", F.coalesce(F.sum("__t").over(before), F.lit(0.0)))
    return placed.groupBy(*by).agg(
        F.sum("__t").alias("total"), F.min(F.col("__c") + F.col("__low")).alias("lowest")
    )
