"""Bonding-surface markets over ``trades(market, ord, side, qty)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.functions.columns import bonding_columns, bonding_scale
from linktide.operators.keyed import attach, ratio
from linktide.operators.ordering import running_sums


def _side(name: str) -> Column:
    return F.when(F.col("side") == name, F.col("qty")).otherwise(F.lit(0.0))


def market_supplies(trades: DataFrame) -> DataFrame:
    return trades.groupBy("market").agg(
        F.sum(_side("YES")).alias("yes"), F.sum(_side("NO")).alias("no")
    )


def market_state(trades: DataFrame, scale: float | DataFrame = 1.0) -> DataFrame:
    """Supplies, prices, cost, reserves and forecast of every market.

    ``scale`` is one constant or a table ``(market, scale)``.
    """
    supplies = market_supplies(trades)
    if isinstance(scale, DataFrame):
        supplies = supplies.join(scale.select("market", "scale"), "market")
    else:
        supplies = supplies.withColumn("scale", F.lit(float(scale)))
    return supplies.select(
        "market", "yes", "no",
        *[c.alias(k) for k, c in bonding_columns("yes", "no", "scale").items()],
    )


def market_scale(openings: DataFrame) -> DataFrame:
    """Scale per market from ``openings(market, deposit, yes, no)``."""
    return openings.select("market", bonding_scale("deposit", "yes", "no").alias("scale"))


def market_path(trades: DataFrame, scale: float = 1.0, order_by: Sequence[str] = ("ord",)) -> DataFrame:
    """Supplies, prices and forecast after every trade."""
    path = running_sums(
        trades, {"yes": _side("YES"), "no": _side("NO")}, list(order_by), ["market"]
    )
    values = bonding_columns("yes", "no", F.lit(float(scale)))
    return path.select(
        *trades.columns, "yes", "no",
        *[values[c].alias(c) for c in ("price_yes", "price_no", "cost", "forecast")],
    )


def settle_markets(states: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Settlement factors and rebalanced reserves for ``outcomes(market, outcome)``."""
    joined = attach(states, outcomes.select("market", "outcome"), ["market"], "inner")
    x, q = F.col("outcome").cast("double"), F.col("forecast")
    yes, no = ratio(x, q), ratio(1 - x, 1 - q)
    return joined.select(
        "market", "outcome", yes.alias("factor_yes"), no.alias("factor_no"),
        (F.col("reserve_yes") * yes).alias("settled_yes"),
        (F.col("reserve_no") * no).alias("settled_no"),
    )
