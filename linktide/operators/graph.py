"""Graph tables: adjacency, strengths, transition, index and pair weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linktide.functions.columns import HASHED, clamp, packed_id, pair_id, pair_text, signed_stake, unpacked_id
from linktide.operators.keyed import attach, attach_scalars, ratio
from linktide.operators.ordering import numbered


def adjacency(effective: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Directed weights summed per ordered pair."""
    return effective.groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w"))


def nodes(adj: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every endpoint once."""
    both = adj.select(*keys, F.explode(F.array("src", "dst")).alias("id"))
    return both.distinct()


def node_table(adj: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per node: out-strength, weighted degree, dangling flag; one shuffle."""
    ends = adj.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.col("w").alias("o"), F.col("w").alias("d")),
                F.struct(F.col("dst").alias("id"), F.lit(0.0).alias("o"), F.col("w").alias("d")),
            )
        ).alias("e"),
    )
    return (
        ends.groupBy(*keys, F.col("e.id").alias("id"))
        .agg(F.sum("e.o").alias("out"), F.sum("e.d").alias("degree"))
        .withColumn("dangling", F.col("out") == 0)
    )


def out_strength(adj: DataFrame) -> DataFrame:
    return node_table(adj).select("id", "out", "dangling")


def degree(adj: DataFrame) -> DataFrame:
    return node_table(adj).select("id", "degree")


def transition(adj: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(row=dst, col=src, p): columns sum to one."""
    outs = adj.groupBy(*keys, "src").agg(F.sum("w").alias("out"))
    return attach(adj, outs, [*keys, "src"], "inner").select(
        *keys,
        F.col("dst").alias("row"),
        F.col("src").alias("col"),
        ratio(F.col("w"), F.col("out")).alias("p"),
    )


def symmetrize(adj: DataFrame) -> DataFrame:
    """(row, col, w) with w = A(row, col) + A(col, row)."""
    both = adj.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("row"), F.col("dst").alias("col")),
                F.struct(F.col("dst").alias("row"), F.col("src").alias("col")),
            )
        ).alias("e"),
        "w",
    )
    return both.groupBy("e.row", "e.col").agg(F.sum("w").alias("w"))


def teleport(adj: DataFrame) -> DataFrame:
    """Prior proportional to in plus out weight."""
    table = node_table(adj)
    total = table.agg(F.sum("degree").alias("__total"))
    return attach_scalars(table, total).select(
        "id", ratio(F.col("degree"), F.col("__total")).alias("prior")
    )


def particle_index(
    links: DataFrame, order_by: Sequence[str], seed: DataFrame | None = None
) -> DataFrame:
    """Dense index of nodes and pair ids by first appearance.

    ``seed(pos, id)`` comes first in its own order; then per link the source,
    the target and the pair id. Ids are strings.
    """
    # A pair of numbers is told apart by its text, which is shorter than its id and can be no node's id.
    plain = all(dict(links.dtypes)[c] in ("bigint", "int", "smallint", "tinyint") for c in ("src", "dst")) and seed is None
    pair = F.concat(F.lit(b"\x02"), pair_text("src", "dst").cast("binary")) if plain else packed_id(pair_id("src", "dst"))
    spots = links.select(
        F.struct(*[F.col(c) for c in order_by]).alias("ord"),
        F.posexplode(F.array(packed_id("src"), packed_id("dst"), pair)).alias("slot", "id"),
    )
    first = spots.groupBy("id").agg(F.min(F.struct("ord", "slot")).alias("at"))
    flat = first.select("id", *[F.col(f"at.ord.{c}").alias(c) for c in order_by], F.col("at.slot").alias("slot"))
    order = [*order_by, "slot"]
    if seed is not None:
        heads = seed.groupBy(packed_id("id").alias("id")).agg(
            F.min("pos").cast("bigint").alias("__pos")
        )
        rest = flat.join(heads.select("id"), "id", "left_anti").select(
            "*", F.lit(1).alias("__stage"), F.lit(0).cast("bigint").alias("__pos"))
        flat = rest.unionByName(
            heads.withColumn("__stage", F.lit(0)), allowMissingColumns=True
        )
        order = ["__stage", "__pos", *order]
    return numbered(flat, order, "index", ["id"]).select(unpacked_id("id").alias("id"), "index")


def resolve_edges(links: DataFrame, index: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Links with endpoints and pair id replaced by their indices.

    The long pair ids are met first, as bytes, and not carried on; ends are met by the entries that are as
    long as some end, which leaves out the pairs. The index lies by position, so both sides of each join
    are shuffled and a skewed one can be split.
    """
    named = links.select(
        *carry,
        F.col("src").cast("string").alias("src_id"),
        F.col("dst").cast("string").alias("dst_id"),
        F.unhex(pair_id("src", "dst")).alias("pair"),
        signed_stake("valence", "amount").alias("stake"),
        "valence",
    )
    axons = index.where(F.col("id").rlike(HASHED)).select(F.unhex("id").alias("pair"), F.col("index").alias("axon"))
    named = named.join(axons, "pair").drop("pair")
    lengths = links.select(F.explode(F.array(*[F.length(F.col(c).cast("string")) for c in ("src", "dst")])).alias("__long"))
    ends = index.withColumn("__long", F.length("id")).join(F.broadcast(lengths.distinct()), "__long", "left_semi")
    for key, out in (("src_id", "src"), ("dst_id", "dst")):
        named = named.join(ends.select(F.col("id").alias(key), F.col("index").alias(out)), key)
    return named.select(*carry, "src", "dst", "axon", "stake", "valence")


def positive_adjacency(links: DataFrame) -> DataFrame:
    """Stake summed per pair over affirming links only; self pairs are kept."""
    staked = links.withColumn("stake", signed_stake("valence", "amount")).where("stake > 0")
    return staked.groupBy("src", "dst").agg(F.sum("stake").alias("stake"))


def axon_weights(links: DataFrame) -> DataFrame:
    """Per unordered pair: raw weights both ways and the oriented consensus."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    forward = F.col("src") <= F.col("dst")
    weight = F.col("amount") * (F.col("rho") if "rho" in links.columns else F.lit(1))
    sign = F.when(F.col("src") == F.col("dst"), 0).when(forward, 1).otherwise(-1)
    return links.groupBy(low.alias("low"), high.alias("high")).agg(
        F.sum(F.when(forward, weight).otherwise(0)).alias("weight_forward"),
        F.sum(F.when(forward, 0).otherwise(weight)).alias("weight_backward"),
        F.sum(weight * F.col("valence") * sign).alias("consensus"),
    )


def graded_adjacency(links: DataFrame, karma: DataFrame | None = None) -> DataFrame:
    """Scalar and oriented grade of the effective adjacency per ordered pair."""
    data = links
    if karma is not None:
        data = attach(links, karma.select("neuron", "kappa"), ["neuron"])
    else:
        data = links.withColumn("kappa", F.lit(1.0))
    weight = F.col("amount") * F.coalesce("kappa", F.lit(1.0))
    belief = clamp("price", 0, 1)
    return data.groupBy("src", "dst").agg(
        F.sum(weight * belief).alias("grade0"),
        F.sum(weight * F.abs(2 * belief - 1) * F.signum(F.col("valence").cast("double"))).alias(
            "grade2"
        ),
    )


def token_walk(adj: DataFrame, values: DataFrame) -> DataFrame:
    """Walk probability w * t(dst), normalised per source."""
    valued = attach(
        adj, values.select(F.col("id").alias("dst"), F.col("value").alias("t")), ["dst"], "inner"
    ).select("src", "dst", (F.col("w") * F.col("t")).alias("wt"))
    totals = valued.groupBy("src").agg(F.sum("wt").alias("__sum"))
    return attach(valued, totals, ["src"], "inner").select(
        "src", "dst", ratio(F.col("wt"), F.col("__sum")).alias("p")
    )


def influence(adj: DataFrame, values: DataFrame) -> DataFrame:
    """Share of all value-weighted links that point at a node."""
    arrived = adj.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("w"))
    mass = arrived.join(values.select("id", "value"), "id").select(
        "id", (F.col("w") * F.col("value")).alias("mass")
    )
    total = mass.agg(F.sum("mass").alias("__total"))
    return attach_scalars(mass, total).select(
        "id", ratio(F.col("mass"), F.col("__total")).alias("influence")
    )
