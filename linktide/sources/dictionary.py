"""Content-addressed dictionaries ``(particle, data)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.functions.columns import pair_id


def content_id(data: str | Column) -> Column:
    return F.sha2(F.col(data) if isinstance(data, str) else data, 256)


def content_address(df: DataFrame, data: str = "data") -> DataFrame:
    return df.withColumn("particle", content_id(data))


def verify_dictionary(entries: DataFrame) -> DataFrame:
    """Rows whose non-empty data does not hash to their key."""
    return entries.where((F.length("data") > 0) & (content_id("data") != F.col("particle")))


def lookup(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Data of every key, null where absent or empty."""
    filled = entries.where(F.length("data") > 0).select("particle", "data")
    return keys.join(filled, "particle", "left")


def compose(dictionaries: Sequence[DataFrame], links: DataFrame | None = None) -> DataFrame:
    """(particle, dict_no, pos, data): the first entry per key over ordered dictionaries,
    then the link nodes and pair ids none of them holds (``dict_no`` one past the
    last, no data)."""
    stacked = None
    for number, entries in enumerate(dictionaries):
        part = entries.select("particle", "pos", "data").withColumn("dict_no", F.lit(number))
        stacked = part if stacked is None else stacked.unionByName(part)
    if links is not None:
        seen = links.select(
            F.explode(
                F.array(
                    F.col("src").cast("string"), F.col("dst").cast("string"), pair_id("src", "dst")
                )
            ).alias("particle")
        ).distinct()
        kind = dict(stacked.dtypes)["data"]
        stacked = stacked.unionByName(
            seen.select(
                "particle", F.lit(0).cast("bigint").alias("pos"),
                F.lit(None).cast(kind).alias("data"), F.lit(len(dictionaries)).alias("dict_no"),
            )
        )
    first = stacked.groupBy("particle").agg(F.min(F.struct("dict_no", "pos", "data")).alias("__f"))
    return first.select("particle", "__f.dict_no", "__f.pos", "__f.data")
