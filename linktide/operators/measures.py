"""Information measures and rankings over a focus table ``phi(id, focus)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linktide.functions.columns import entropy_term
from linktide.operators.focus import FocusParams, Spectrum
from linktide.operators.keyed import attach, attach_scalars, ratio, safe_log


def entropy(phi: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return phi.groupBy(*keys).agg(F.coalesce(F.sum(entropy_term("focus")), F.lit(0.0)).alias("entropy"))


def syntropy(phi: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """sum phi ln(n phi), in one pass: sum phi ln phi + ln(n) * sum phi."""
    n = F.count(F.lit(1)).cast("double")
    total = F.sum(F.when(F.col("focus") > 0, F.col("focus")))
    return phi.groupBy(*keys).agg(
        F.coalesce(safe_log(n) * total - F.sum(entropy_term("focus")), F.lit(0.0)).alias(
            "syntropy"
        )
    )


def rank_of(phi: DataFrame, ids: DataFrame) -> DataFrame:
    """Focus of the asked ids, 0 for an id without one."""
    return ids.join(phi.select("id", "focus"), "id", "left").withColumn(
        "focus", F.coalesce("focus", F.lit(0.0))
    )


def telemetry(phi: DataFrame, spectrum: Spectrum, before: DataFrame | None = None) -> DataFrame:
    """One row: n, syntropy, entropy, spectrum figures and the drift to ``before``."""
    row = phi.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(entropy_term("focus")), F.lit(0.0)).alias("entropy"),
        F.coalesce(F.sum("focus"), F.lit(0.0)).alias("__sum"),
    ).select(
        "n",
        (safe_log(F.col("n").cast("double")) * F.col("__sum") - F.col("entropy")).alias("syntropy"),
        "entropy",
        F.lit(spectrum.lambda_max).alias("lambda_max"),
        F.lit(spectrum.lambda_2).alias("lambda_2"),
        F.lit(spectrum.kappa).alias("kappa"),
        F.lit(spectrum.steps).alias("steps"),
    )
    if before is None:
        return row
    return row.join(F.broadcast(l1_drift(phi, before)))


def l1_drift(phi: DataFrame, before: DataFrame) -> DataFrame:
    old = before.select("id", F.col("focus").alias("__old"))
    zero = F.lit(0.0)
    return phi.join(old, "id", "full").agg(
        F.sum(F.abs(F.coalesce("focus", zero) - F.coalesce("__old", zero))).alias("l1_drift")
    )


def free_energy(
    adj: DataFrame,
    phi: DataFrame,
    diffused: DataFrame,
    heated: DataFrame,
    params: FocusParams = FocusParams(),
) -> DataFrame:
    """Elastic, heat and diffusion terms of the energy ``phi`` minimises.

    phi' L phi is the sum of w (phi_src - phi_dst)^2 over directed pairs, so the
    elastic term needs no matrix. ``diffused(id, x)`` and ``heated(id, x)`` are
    the images of ``phi``.
    """
    here = phi.select("id", "focus")
    edges = attach(
        attach(adj, here.toDF("src", "__p"), ["src"], "inner"), here.toDF("dst", "__q"), ["dst"],
        "inner",
    )
    pull = edges.agg(
        F.sum(F.col("w") * F.pow(F.col("__p") - F.col("__q"), 2)).alias("__quad")
    )
    n = here.agg(F.count(F.lit(1)).alias("__n"))
    joined = (
        attach_scalars(here, n)
        .join(diffused.select("id", F.col("x").alias("__d")), "id")
        .join(heated.select("id", F.col("x").alias("__h")), "id")
    )
    sums = joined.agg(
        F.sum(F.pow(F.col("focus") - 1 / F.col("__n"), 2)).alias("__dev"),
        F.sum(F.pow(F.col("focus") - F.col("__h"), 2)).alias("__smooth"),
        F.sum(
            F.col("focus") * (safe_log(F.col("focus")) - safe_log(F.col("__d")))
        ).alias("__kl"),
    )
    elastic = params.springs * (F.col("__quad") / 2 + params.mu / 2 * F.col("__dev"))
    return pull.join(F.broadcast(sums)).select(
        elastic.alias("elastic"),
        (params.heat / 2 * F.col("__smooth")).alias("smoothness"),
        (params.diffusion * F.col("__kl")).alias("divergence"),
        (
            elastic + params.heat / 2 * F.col("__smooth") + params.diffusion * F.col("__kl")
        ).alias("free_energy"),
    )


def divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """KL divergence of focus table p from q over the nodes both hold."""
    other = q.select("id", F.col("focus").alias("__q"))
    both = p.select("id", "focus").join(other, "id")
    return both.agg(
        F.sum(
            F.when(
                (F.col("focus") > 0) & (F.col("__q") > 0),
                F.col("focus") * F.log(F.col("focus") / F.col("__q")),
            ).otherwise(0.0)
        ).alias("divergence")
    )


def luminosity(phi: DataFrame, sizes: DataFrame) -> DataFrame:
    return phi.join(sizes, "id").select("id", (F.col("size") * F.col("focus")).alias("luminosity"))


def modules(phi: DataFrame, threshold: float) -> DataFrame:
    return phi.where(F.col("focus") > threshold)


def standard_inference(
    links: DataFrame, phi: DataFrame, will: DataFrame, queries: DataFrame
) -> DataFrame:
    """Candidates linked from each query node, scored by focus times concentrated will.

    ``queries(id)`` names the query nodes. The score of candidate P for query Q
    is focus(P) times the sum over links Q -> P of will(author) / links(author).
    """
    authors = links.groupBy("neuron").agg(F.count(F.lit(1)).alias("__n"))
    per_link = authors.join(will.select("neuron", "will"), "neuron", "left").select(
        "neuron", (F.coalesce("will", F.lit(0)) / F.col("__n")).alias("__avg")
    )
    asked = links.join(queries.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    weights = (
        attach(asked.select("neuron", "src", "dst"), per_link, ["neuron"], "inner")
        .groupBy(F.col("src").alias("query"), F.col("dst").alias("id"))
        .agg(F.sum("__avg").alias("weight"))
    )
    return attach(weights, phi.select("id", "focus"), ["id"]).select(
        "query", "id", (F.coalesce("focus", F.lit(0.0)) * F.col("weight")).alias("score")
    )


def pearson(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation, 0 where one side does not vary."""
    flat = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0) | (
        F.coalesce(F.stddev_pop(y), F.lit(0.0)) == 0
    )
    return df.groupBy(*keys).agg(
        F.when(flat, F.lit(0.0)).otherwise(F.corr(x, y)).alias("pearson")
    )


def reconstruction_error(actual: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Relative Frobenius distance of two ``(row, col, value)`` tables; absent is 0."""
    both = actual.select("row", "col", F.col("value").alias("__a")).join(
        rebuilt.select("row", "col", F.col("value").alias("__b")), ["row", "col"], "full"
    )
    a, b = F.coalesce("__a", F.lit(0.0)), F.coalesce("__b", F.lit(0.0))
    return both.agg(
        ratio(F.sqrt(F.sum(F.pow(b - a, 2))), F.sqrt(F.sum(a * a))).alias("relative_error")
    )


def top_focus(phi: DataFrame, k: int, positions: DataFrame | None = None) -> DataFrame:
    """The k nodes of highest focus, with map coordinates when given."""
    best = phi.orderBy(F.desc("focus"), "id").limit(k)
    return best if positions is None else best.join(positions, "id", "left")


def top_shifts(delta: DataFrame, k: int) -> DataFrame:
    return delta.orderBy(F.desc(F.abs("delta")), "id").limit(k)


def resolve_prefix(ids: DataFrame, prefix: str) -> DataFrame:
    """The one id that starts with ``prefix``; none or several make the job fail."""
    found = (
        ids.select(F.col("id").cast("string").alias("id"))
        .where(F.col("id").startswith(prefix))
        .distinct()
        .agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("id"))
    )
    text = F.concat(F.col("__n").cast("string"), F.lit(f" ids start with {prefix}"))
    return found.select(
        F.when(F.col("__n") == 1, F.col("id")).otherwise(F.raise_error(text)).alias("id")
    )
