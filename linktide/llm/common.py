"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linktide.session import ensure_checkpoint_dir

#: White space of all text operators: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one slice in :func:`numbered_within`.
SLICE_ROWS = 10_000


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def others(df: DataFrame, *outputs: str) -> list[str]:
    """Columns of ``df`` that keep their place beside ``outputs``, whatever their case."""
    taken = {name.lower() for name in outputs}
    return [c for c in df.columns if c.lower() not in taken]


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column = "text") -> Column:
    """Number of words (runs of anything but white space) as bigint; null has none."""
    return F.size(words_of(column)).cast("bigint")


def words_of(column: str | Column = "text") -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text_of(column), SPACE_CLASS + "+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when the body has lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from 32 bits of an MD5, the same in every SQL engine."""
    joined = F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def numbered_within(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str,
    largest: int,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Gapless positions from 0 inside each group, along a uniform random order.

    ``order[0]`` is a double in [0, 1) that is spread evenly over the rows of a
    group; further columns break ties. A group is cut into slices of about
    ``slice_rows`` rows along that number (``largest`` is the size of the largest
    group), so no task holds a group: slices are counted, their offsets summed,
    and rows numbered inside a slice. Group
    columns are not null. Rows equal in all order columns are interchangeable.
    """
    by = list(by)
    slices = max(1, -(-largest // slice_rows))
    cut = df.withColumn("__slice", F.floor(F.col(order[0]) * slices).cast("int"))
    counts = cut.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    within = Window.partitionBy(*by, "__slice").orderBy(*order)
    placed = cut.withColumn("__row", F.row_number().over(within))
    joined = placed.join(offsets, [*by, "__slice"])
    return joined.select(
        *[F.col(c) for c in df.columns if c != name],
        (F.col("__offset") + F.col("__row") - 1).cast("bigint").alias(name),
    )


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared checkpoint folder and read again, and its path."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete what :func:`written` made."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
