"""Movement of focus over epochs: ``history(epoch, id, focus)``.

An id has one row per epoch, so windows partitioned by id are small and even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linktide.operators.keyed import ratio


def dense_history(history: DataFrame) -> DataFrame:
    """Every id from its first epoch on, with focus 0 where it is absent."""
    epochs = history.select("epoch").distinct().agg(F.sort_array(F.collect_set("epoch")).alias("es"))
    firsts = history.groupBy("id").agg(F.min("epoch").alias("__first"))
    grid = firsts.join(F.broadcast(epochs)).select(
        "id",
        F.explode(F.filter("es", lambda e: e >= F.col("__first"))).alias("epoch"),
    )
    return grid.join(history.select("epoch", "id", "focus"), ["epoch", "id"], "left").select(
        "epoch", "id", F.coalesce("focus", F.lit(0.0)).alias("focus")
    )


def _ordered():
    return Window.partitionBy("id").orderBy("epoch")


def _numbered_epochs(history: DataFrame) -> DataFrame:
    """(epoch, __at), one row per epoch."""
    order = F.row_number().over(Window.orderBy("epoch"))
    return history.select("epoch").distinct().withColumn("__at", order)


def velocity(history: DataFrame) -> DataFrame:
    """Focus less the focus of the epoch before, 0 where that is absent."""
    earlier = F.coalesce(F.lag("focus").over(_ordered()), F.lit(0.0))
    return dense_history(history).withColumn("velocity", F.col("focus") - earlier)


def attention_shift(history: DataFrame) -> DataFrame:
    """1 - cosine of the focus vectors of consecutive epochs.

    Only rows of the history are read: an id that is absent from either epoch
    adds nothing to their product, and each norm is a sum over its own epoch.
    """
    placed = history.join(F.broadcast(_numbered_epochs(history)), "epoch")
    adjacent = F.col("__at") - F.lag("__at").over(_ordered()) == 1
    pairs = placed.withColumn("__both", F.when(adjacent, F.col("focus") * F.lag("focus").over(_ordered())))
    sums = pairs.groupBy("epoch").agg(
        F.coalesce(F.sum("__both"), F.lit(0.0)).alias("dot"),
        F.sqrt(F.sum(F.col("focus") * F.col("focus"))).alias("now"),
    )
    old = F.lag("now").over(Window.orderBy("epoch"))  # one row per epoch
    return sums.withColumn("old", old).where("old > 0").select(
        "epoch", (1 - ratio(F.col("dot"), F.col("now") * F.col("old"))).alias("shift")
    )


def trailing_focus(history: DataFrame, beta: float) -> DataFrame:
    """Exponential mean per id, started at its first focus; with the deviation."""
    seen = F.sort_array(
        F.collect_list(F.struct("epoch", "focus")).over(
            _ordered().rowsBetween(Window.unboundedPreceding, 0)
        )
    )
    mean = F.aggregate(
        seen,
        F.lit(None).cast("double"),
        lambda m, x: F.coalesce(m * (1 - beta) + x["focus"] * beta, x["focus"]),
    )
    out = dense_history(history).withColumn("trailing", mean)
    return out.withColumn("deviation", F.col("focus") - F.col("trailing"))


def dwell(history: DataFrame, k: int) -> DataFrame:
    """For each epoch's top k: how many epochs in a row the id has been there.

    The rank filter lets Spark keep k rows per task before the epoch's window.
    """
    by_focus = Window.partitionBy("epoch").orderBy(F.desc("focus"), "id")
    top = history.withColumn("rank", F.row_number().over(by_focus)).where(F.col("rank") <= k)
    placed = top.join(F.broadcast(_numbered_epochs(history)), "epoch")
    run = F.col("__at") - F.row_number().over(_ordered())
    streaks = placed.withColumn("__run", run)
    within = Window.partitionBy("id", "__run").orderBy("epoch")
    return streaks.select("epoch", "id", "rank", F.row_number().over(within).alias("dwell"))


def excitability_gain(
    history: DataFrame, beta: float, target: float, rate: float, floor: float
) -> DataFrame:
    """Gain of every id after each epoch, started at 1 and clipped at each step."""
    trail = trailing_focus(history, beta)
    seen = F.sort_array(
        F.collect_list(F.struct("epoch", "trailing")).over(
            _ordered().rowsBetween(Window.unboundedPreceding, 0)
        )
    )
    gain = F.aggregate(
        seen,
        F.lit(1.0),
        lambda g, x: F.greatest(
            F.lit(float(floor)), F.least(F.lit(1.0), g + rate * (F.lit(float(target)) - x["trailing"]))
        ),
    )
    return trail.withColumn("gain", gain)
