"""From signed links to effective link weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.functions.columns import clamp
from linktide.operators.keyed import attach, attach_scalars


@dataclass
class Context:
    """Author and market tables of one epoch; each is optional.

    ``karma(neuron, kappa)`` defaults to 1, ``will(neuron, will)`` to 0,
    ``gain(id, gain)`` to 1. With ``tokens(token, rho)`` an amount counts in its
    token's weight, and a token without one makes the job fail. ``prices(src, dst,
    price)`` are the market prices of pairs; a pair without one keeps the price of its
    links, which is 1 by default.
    """

    karma: DataFrame | None = None
    will: DataFrame | None = None
    gain: DataFrame | None = None
    tokens: DataFrame | None = None
    prices: DataFrame | None = None


def drop_self_loops(links: DataFrame) -> DataFrame:
    return links.where(F.col("src") != F.col("dst"))


def active(links: DataFrame) -> DataFrame:
    """Links that take a position; the others only carry weight."""
    return links.where(F.col("valence") != 0)


def apply_token_weights(links: DataFrame, tokens: DataFrame) -> DataFrame:
    """Add ``rho``; a link in a token without a weight makes the job fail.

    The check runs inside the join, so it costs no extra pass over the links.
    """
    joined = attach(links, tokens.select("token", "rho"), ["token"])
    missing = F.raise_error(F.concat(F.lit("no weight for token "), F.col("token")))
    return joined.withColumn(
        "rho", F.when(F.col("rho").isNull(), missing.cast("double")).otherwise(F.col("rho"))
    )


def unknown_tokens(links: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens the links use and the weight table lacks."""
    return links.select("token").distinct().join(tokens, "token", "left_anti")


def author_table(kept: DataFrame, ctx: Context) -> DataFrame:
    """One row per author: link count, will share per link, karma, top attention."""
    authors = kept.groupBy("neuron").agg(
        F.count(F.lit(1)).alias("n_links"), F.max("amount").alias("__top")
    )
    if ctx.will is not None:
        authors = authors.join(ctx.will.select("neuron", "will"), "neuron", "left")
    else:
        authors = authors.withColumn("will", F.lit(0).cast("bigint"))
    if ctx.karma is not None:
        authors = authors.join(ctx.karma.select("neuron", "kappa"), "neuron", "left")
    else:
        authors = authors.withColumn("kappa", F.lit(1.0))
    return authors.select(
        "neuron",
        "n_links",
        F.expr("coalesce(will, 0) div n_links").alias("share"),
        F.coalesce("kappa", F.lit(1.0)).alias("kappa"),
        "__top",
    )


def with_attention(links: DataFrame, will: DataFrame | None = None) -> DataFrame:
    """Add ``share`` (equal part of the author's will) and ``attention``."""
    authors = author_table(links, Context(will=will)).select("neuron", "share")
    return attach(links, authors, ["neuron"]).withColumn(
        "attention", F.col("amount") + F.col("share")
    )


def with_stake(links: DataFrame, ctx: Context = Context()) -> DataFrame:
    """Add share, attention, kappa and stake = attention / largest attention.

    The largest attention is the largest over authors of (top amount + share),
    so it comes from the author table and not from another pass over the links.
    """
    authors = author_table(links, ctx)
    top = authors.agg(F.greatest(F.max(F.col("__top") + F.col("share")), F.lit(1)).alias("__max"))
    joined = attach(links, authors.select("neuron", "share", "kappa"), ["neuron"])
    joined = joined.withColumn("attention", F.col("amount") + F.col("share"))
    return (
        attach_scalars(joined, top)
        .withColumn("stake", F.col("attention") / F.col("__max"))
        .drop("__max")
    )


def _price(links: DataFrame) -> Column:
    return F.col("price") if "price" in links.columns else F.lit(1.0)


def effective_links(links: DataFrame, ctx: Context = Context()) -> DataFrame:
    """Links with weight ``w`` = stake * karma * price; weightless links vanish."""
    kept = drop_self_loops(links)
    if ctx.tokens is not None:
        kept = apply_token_weights(kept, ctx.tokens).withColumn("amount", F.col("amount") * F.col("rho"))
    if ctx.prices is not None:
        priced = attach(kept.withColumn("__own", _price(links)), ctx.prices.select("src", "dst", F.col("price").alias("__market")), ["src", "dst"])
        kept = priced.withColumn("price", F.coalesce("__market", "__own")).drop("__market", "__own")
    price = clamp(_price(kept), 0, 1)
    weighted = with_stake(kept, ctx).withColumn("w", F.col("stake") * F.col("kappa") * price)
    if ctx.gain is not None:
        gains = ctx.gain.select(F.col("id").alias("dst"), "gain")
        weighted = attach(weighted, gains, ["dst"]).withColumn(
            "w", F.col("w") * F.coalesce("gain", F.lit(1.0))
        )
    return weighted.where("w > 0")
