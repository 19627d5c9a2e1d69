"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.llm.common import others, unit_hash, word_count
from linktide.operators.keyed import attach
from linktide.operators.ordering import numbered, running_sums
from linktide.session import settle

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more often than this.
MOST_REPEATS = 3
#: Equal parts of [0, 1) in which the sizes of a source are summed to find its cut; a power of two.
CUT_PARTS = 4096


def source_rates(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """(``__none, __name, __source_size, __target, __rate``), a row per source.

    A null source is a source of its own and comes last. Targets share the sum
    of all sizes by weight; what exceeds ``most`` times a source goes to the
    others by weight until no target is above. Each round is one aggregate of
    one row; a round caps at least one source, or it is the last.
    """
    totals = settle(sizes.groupBy("__none", "__name").agg(F.sum("size").alias("__source_size")))
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    ranked = numbered(totals, ["__none", "__name"], "__rank")
    ranked = settle(
        ranked.withColumn(
            "__weight", F.element_at(cycle, (F.col("__rank") % len(weights) + 1).cast("int"))
        )
    )
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731 - products outgrow a bigint
    cap = F.col("__source_size") * most
    share, weight, capped = 0, 0, -1
    total = ranked.agg(F.sum("__source_size")).first()[0] or 0
    while True:
        full = F.lit(False) if capped < 0 else (
            wide("__weight") * F.lit(share).cast("decimal(20,0)")
            >= wide("__source_size") * most * F.lit(weight).cast("decimal(18,0)")
        )
        taken, open_weight, now = ranked.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("__weight"))), F.lit(0)),
            F.count(F.when(full, 1)),
        ).first()
        if now == capped or open_weight == 0:
            break
        share, weight, capped = total - taken, open_weight, now
    level = F.lit(share).cast("double") / F.lit(max(weight, 1)).cast("double")
    target = F.least(F.col("__weight").cast("double") * level, cap.cast("double"))
    target = F.when(F.col("__source_size") > 0, target).otherwise(F.lit(0.0))
    return ranked.select("__none", "__name", "__source_size", target.alias("__target")).withColumn(
        "__rate", F.coalesce(F.try_divide("__target", "__source_size"), F.lit(0.0))
    )


def draw_cuts(sizes: DataFrame, rates: DataFrame) -> DataFrame:
    """``rates`` with (``__edge``, ``__cut``): whose draw takes one more copy.

    A source wants ``target - floor(rate) * source_size`` more words. Along its
    draws, documents are taken while the middle of the next one stays within
    them, so the words taken miss the target by half a document (or half of the
    rows that share a draw) at most. Sizes are summed in equal parts of [0, 1);
    only rows of the part where the sum crosses, one in ``CUT_PARTS``, are put in
    order. A draw below ``__edge`` or up to ``__cut`` takes; null takes none.
    """
    keys = ["__none", "__name"]
    open_ = rates.where(F.col("__rate") > F.floor("__rate")).select(
        *keys, (F.col("__target") - F.floor("__rate") * F.col("__source_size")).alias("__more")
    )
    placed = sizes.withColumn("__part", F.floor(F.col("__draw") * CUT_PARTS))
    parts = placed.groupBy(*keys, "__part").agg(F.sum("size").alias("__words"))
    summed = running_sums(parts, {"__upto": F.col("__words")}, ["__part"], keys)
    before = (F.col("__upto") - F.col("__words")).alias("__before")
    edges = settle(
        attach(summed, open_, keys, "inner").select(*keys, "__part", "__more", before)
        .where(F.col("__before") <= F.col("__more"))
        .groupBy(*keys).agg(F.max(F.struct("__part", "__before", "__more")).alias("__last"))
        .select(*keys, F.col("__last.__part").alias("__at"), "__last.__before", "__last.__more")
    )
    near = attach(placed, edges, keys, "inner").where("__part = __at")
    ties = near.groupBy(*keys, "__draw", "__before", "__more").agg(F.sum("size").alias("__words"))
    run = running_sums(ties, {"__upto": F.col("__words")}, ["__draw"], keys)
    middle = (2 * (F.col("__before") + F.col("__upto")) - F.col("__words")).cast("double")
    cuts = run.where(middle <= 2 * F.col("__more")).groupBy(*keys).agg(F.max("__draw").alias("__cut"))
    edge = edges.select(*keys, (F.col("__at") / F.lit(float(CUT_PARTS))).alias("__edge"))
    return rates.join(edge, keys, "left").join(cuts, keys, "left")


def planned_copies(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: str = "mix",
) -> DataFrame:
    """Every row with ``size, source_size, target, copies``.

    ``size`` defaults to the number of words. A document is taken floor(rate)
    times, and once more by a draw, the hash of seed and id (of the text if the
    id is null), so reruns agree, and rows of one id decide alike. A draw takes
    with the fraction of the rate as its probability; the cut that it is held
    against is the fraction measured on the draws themselves (:func:`draw_cuts`),
    so that also small sources meet their targets to half a document. An
    empty document has size 0 and follows the rate of its source; a source
    without any words has target and rate 0. The table of sources is joined
    with a tag that lets adaptive execution split a hot source; texts are not
    shuffled to find the cuts, only sizes and draws.
    """
    given = others(docs, "size", "source_size", "target", "copies")
    measured = docs.select(
        *given,
        (word_count() if size is None else size).alias("size"),
        F.isnull("source").alias("__none"),
        F.coalesce("source", F.lit("")).alias("__name"),
        unit_hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))
        .alias("__draw"),
    )
    sizes = settle(measured.select("__none", "__name", "size", "__draw"))
    rates = settle(draw_cuts(sizes, source_rates(sizes, weights, most)))
    taking = (F.col("__draw") < F.col("__edge")) | F.coalesce(F.col("__draw") <= F.col("__cut"), F.lit(False))
    extra = F.when(taking, 1).otherwise(0)
    return attach(measured, rates, ["__none", "__name"], "inner").select(
        *given,
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.least(F.floor("__rate") + extra, F.lit(most)).cast("bigint").alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: each row as often as it is taken, with its own columns."""
    planned = planned_copies(docs, **options)
    copies = F.sequence(F.lit(1).cast("bigint"), F.col("copies"))
    return planned.where("copies > 0").withColumn("__copy", F.explode(copies)).select(*docs.columns)
