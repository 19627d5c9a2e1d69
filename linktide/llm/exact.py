"""Exact duplicates with a separate path for frequent texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linktide.llm.common import SPACES, others, text_of

#: A text held by more than this share of the rows is certainly found by the
#: Misra-Gries summary, which keeps 1 / SUPPORT counters; at most that many
#: winners are broadcast.
SUPPORT = 1 / 4096


def mark_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Every row with ``keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are the same without white space. Of equal texts the
    row with the most code points in the original text stays, then the smallest
    ``doc_id`` (null last); of rows that agree in both (repeated rows) one stays.
    A null text counts as empty, so empty, blank and null texts are one group.

    A Misra-Gries pass names candidates for frequent texts, a second pass counts
    them exactly and finds their winners, whose number ``support`` bounds. They
    are broadcast, and the other rows of their groups are settled map-side. Only
    winners and the rows of rare texts are shuffled.
    """
    given = others(docs, "keep_id", "group_size", "kept", "text_sha256")
    rows = docs.select(
        *given,
        F.sha2(F.translate(text_of(), SPACES, ""), 256).alias("text_sha256"),
        F.struct(
            (-F.char_length(text_of())).alias("shorter"),
            F.isnull("doc_id").alias("nameless"),
            F.col("doc_id").alias("doc_id"),
        ).alias("__place"),
    )
    digests = rows.select("text_sha256", "__place")
    frequent = digests.stat.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256")
    )
    winners = (
        digests.join(F.broadcast(frequent.distinct()), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("__size"), F.min("__place").alias("__first"))
        .where("__size > 1")
    )
    known = rows.join(F.broadcast(winners), "text_sha256", "left")
    settled = F.col("__first").isNotNull() & ~F.col("__place").eqNullSafe(F.col("__first"))
    outputs = lambda keep_id, size, kept: [
        *given,
        keep_id.alias("keep_id"),
        size.cast("bigint").alias("group_size"),
        kept.alias("kept"),
        "text_sha256",
    ]
    removed = known.where(settled).select(
        *outputs(F.col("__first.doc_id"), F.col("__size"), F.lit(False))
    )
    group = Window.partitionBy("text_sha256")
    ordered = group.orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    rest = (
        known.where(~settled)
        .withColumn("__row", F.row_number().over(ordered))
        .withColumn("__keep", F.first("__place").over(ordered))
        .withColumn("__all", F.count(F.lit(1)).over(group))
    )
    rest = rest.select(
        *outputs(F.col("__keep.doc_id"), F.coalesce("__size", "__all"), F.col("__row") == 1)
    )
    return removed.unionByName(rest)


def deduplicate(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with their own columns."""
    return mark_copies(docs, support).where("kept").select(*docs.columns)
