"""Reachability, triangles, components and distance-based scores."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linktide.operators.keyed import attach
from linktide.session import settle

CELL_PAIRS = 200_000  # pairs that meet in one task of a triangle search
SMALL_HUB = 10_000  # pairs of a node that any cell can take
WEDGES = 2_000_000  # wedges that such a task looks up at once
PIECES = 8  # tables of one size that are joined into a larger one


def undirected(adj: DataFrame) -> DataFrame:
    """Distinct unordered pairs a < b."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return adj.where("src != dst").select(low.alias("a"), high.alias("b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("id"), F.col("b").alias("to")),
                F.struct(F.col("b").alias("id"), F.col("a").alias("to")),
            )
        ).alias("e")
    ).select("e.id", "e.to")


def neighborhood(adj: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop) of every node within ``hops`` undirected links of ``seeds(id)``."""
    arcs = settle(both_ways(undirected(adj)))
    found = _Pieces()
    found.add(seeds.select("id", F.lit(0).alias("hop")).limit(0))
    for hop, nodes in itertools.islice(_hops(arcs, seeds.select("id").distinct()), hops + 1):
        found.add(nodes.select("id", F.lit(hop).alias("hop")))
    return found.all()


def domains(arcs: DataFrame, seeds: DataFrame, key: str, hops: int) -> DataFrame:
    """(key, id, hop): nodes within ``hops`` of the ``seeds(key, id)`` of every key, one sweep for all.

    ``arcs(id, to)`` are shared by all keys; only two frontiers are compared a hop.
    """
    found = _Pieces()
    before, now = None, settle(seeds.select(key, "id").distinct())
    for hop in range(hops + 1):
        found.add(now.withColumn("hop", F.lit(hop)))
        if hop == hops:
            break
        reached = attach(arcs, now, ["id"], "inner").select(key, F.col("to").alias("id")).distinct()
        seen = now if before is None else now.union(before)
        before, now = now, settle(reached.join(seen, [key, "id"], "left_anti"))
    return settle(found.all())


def distances(adj: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(source, id, d) for pairs within ``max_hops``, one sweep for all sources.

    The output has one row per reachable pair, so it is sized by the sources.
    """
    arcs = settle(both_ways(undirected(adj)))
    first = sources.select(F.col("id").alias("source"), "id").distinct()
    seen = settle(first.withColumn("d", F.lit(0)))
    for h in range(1, max_hops + 1):
        frontier = seen.where(F.col("d") == h - 1).select("source", "id")
        reached = frontier.join(arcs, "id").select("source", F.col("to").alias("id")).distinct()
        fresh = reached.join(seen.select("source", "id"), ["source", "id"], "left_anti")
        seen = settle(seen.unionByName(fresh.withColumn("d", F.lit(h))))
    return seen.where("d > 0")


def pair_force(adj: DataFrame, phi: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """focus_i * focus_j / d^2 for pairs within ``max_hops`` of the sources."""
    found = distances(adj, sources, max_hops)
    here = phi.select(F.col("id").alias("source"), F.col("focus").alias("__i"))
    there = phi.select("id", F.col("focus").alias("__j"))
    joined = attach(attach(found, here, ["source"], "inner"), there, ["id"], "inner")
    return joined.select(
        "source", "id", "d", (F.col("__i") * F.col("__j") / (F.col("d") * F.col("d"))).alias("force")
    )


def gravity(adj: DataFrame, phi: DataFrame, sources: DataFrame, max_hops: int = 1) -> DataFrame:
    """focus_i times the sum of focus_j / d(i, j)^2 within ``max_hops``."""
    return (
        pair_force(adj, phi, sources, max_hops)
        .groupBy(F.col("source").alias("id"))
        .agg(F.sum("force").alias("gravity"))
    )


def total_gravity(gravities: DataFrame) -> DataFrame:
    return gravities.agg(F.sum("gravity").alias("total_gravity"))


def _oriented(pairs: DataFrame) -> DataFrame:
    """(x, y, dy): every pair from its end of lower degree to the other, whose degree is ``dy``; ids break ties."""
    degrees = both_ways(pairs).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    sized = attach(
        attach(pairs, degrees.toDF("a", "__da"), ["a"], "inner"),
        degrees.toDF("b", "__db"), ["b"], "inner",
    )
    low = F.struct(F.col("__da").alias("deg"), F.col("a").alias("id"))
    high = F.struct(F.col("__db").alias("deg"), F.col("b").alias("id"))
    ends = sized.select(F.least(low, high).alias("x"), F.greatest(low, high).alias("y"))
    return ends.select(F.col("x.id").alias("x"), F.col("y.id").alias("y"), F.col("y.deg").alias("dy"))


def _cube(arcs: DataFrame, sides: int) -> DataFrame:
    """(cell, role, x, y): every arc in the ``3 * sides`` cells where it can close a triangle.

    A triangle u -> v -> w with u -> w belongs to the cell of the hashes of u, v and w; an arc
    knows two of them in each of its three roles and goes to all values of the third.
    """
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(sides)).cast("int")
    all_of = F.sequence(F.lit(0), F.lit(sides - 1))
    cell = lambda i, j, k: ((i * sides) + j) * sides + k
    x, y = hashed("x"), hashed("y")
    placed = [
        F.transform(all_of, lambda k: F.struct(F.lit(0).alias("role"), cell(x, y, k).alias("cell"))),
        F.transform(all_of, lambda k: F.struct(F.lit(1).alias("role"), cell(x, k, y).alias("cell"))),
        F.transform(all_of, lambda k: F.struct(F.lit(2).alias("role"), cell(k, x, y).alias("cell"))),
    ]
    return arcs.select("x", "y", F.explode(F.concat(*placed)).alias("p")).select("p.cell", "p.role", "x", "y")


def _closed(cell: pa.Table) -> pa.Table:
    """Triangles of one cell: per arc u -> v the shorter of two neighbour lists is looked up in the other."""
    role = cell.column("role").to_numpy()
    ids = pa.chunked_array([*cell.column("x").chunks, *cell.column("y").chunks]).combine_chunks()
    coded = ids.dictionary_encode()
    place = coded.indices.to_numpy().astype(np.int64)
    x, y = place[: len(role)], place[len(role) :]
    n = max(1, len(coded.dictionary))

    def codes(r: int) -> np.ndarray:
        return np.sort(x[role == r] * n + y[role == r])

    uv, uw, vw = codes(0), codes(1), codes(2)
    out = []
    if len(uv) and len(uw) and len(vw):
        u, v = uv // n, uv % n
        spans = [(np.searchsorted(c, k * n), np.searchsorted(c, (k + 1) * n)) for c, k in ((uw, u), (vw, v))]
        from_u = spans[0][1] - spans[0][0] <= spans[1][1] - spans[1][0]
        for chosen, (begin, end), listed, other, fixed in ((from_u, spans[0], uw, vw, v), (~from_u, spans[1], vw, uw, u)):
            rows = np.flatnonzero(chosen & (end > begin))
            sizes = (end - begin)[rows]
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(WEDGES, sizes.sum() + WEDGES, WEDGES), "left") + 1
            for part in np.split(np.arange(len(rows)), np.unique(np.minimum(cuts, len(rows)))):
                count = sizes[part]
                of = np.repeat(rows[part], count)
                at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + begin[of]
                w = listed[at] % n
                asked = fixed[of] * n + w
                hit = other[np.minimum(np.searchsorted(other, asked), len(other) - 1)] == asked
                out.append(np.stack([u[of[hit]], v[of[hit]], w[hit]]))
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return pa.table({name: coded.dictionary.take(pa.array(found[i])) for i, name in enumerate("uvw")})


def _by_lists(arcs: DataFrame) -> DataFrame:
    """Triangles by lists of later ends: u sends to each of them, v, the ends that follow v.

    What is shuffled is one id per two ends of a node, which grows with the arcs for given degrees.
    Many nodes may write to a hub, but its own list is short, so the skew is on one side only.
    """
    ends = F.sort_array(F.collect_list(F.struct("dy", "y")))
    lists = settle(arcs.groupBy("x").agg(F.transform(ends, lambda e: e.y).alias("to")))
    asked = (
        lists.where(F.size("to") > 1)
        .select(F.col("x").alias("u"), "to", F.posexplode("to").alias("__at", "v"))
        .where(F.col("__at") < F.size("to") - 1)
        .select("u", "v", F.expr("slice(to, __at + 2, size(to))").alias("rest"))
    )
    known = lists.select(F.col("x").alias("v"), "to").hint("shuffle_hash")
    return attach(asked, known, ["v"], "inner").select("u", "v", F.explode(F.array_intersect("rest", "to")).alias("w"))


def triangles(pairs: DataFrame) -> DataFrame:
    """Every triangle of ``pairs(a, b)`` once, as (u, v, w), degrees not falling.

    Pairs point from the lower-degree end to the higher one. Of two exact ways the one that
    shuffles less is taken: neighbour lists (see ``_by_lists``) or a cube (see ``_by_cube``).
    """
    arcs = settle(_oriented(pairs))
    outs = arcs.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    totals = outs.agg(F.sum("n").alias("arcs"), F.sum(F.expr("n * (n - 1) div 2")).alias("ids")).first()
    total, listed = totals["arcs"] or 0, totals["ids"] or 0
    sides = max(2, math.ceil(math.sqrt(3 * total / CELL_PAIRS)))
    return _by_lists(arcs) if listed + total <= 3 * sides * total else _by_cube(arcs, total, sides, dict(pairs.dtypes)["a"])


def _by_cube(arcs: DataFrame, total: int, sides: int, kind: str) -> DataFrame:
    """Triangles inside the cells of a cube.

    One shuffle deals the arcs to the
    cells (see ``_cube``): of E pairs a cell holds about 3 E / sides^2, and ``sides``
    keeps that near ``CELL_PAIRS``. A cell finds its triangles on its own, and no wedge leaves it.
    A node of more than E / sides^2 pairs would fill cells; a triangle with such nodes
    has one as its last, so all of them are found by joins on the pairs into these nodes (fewer than
    2 sides^2), which are spread by their other ends, and the cube does without those pairs.
    """
    crowded = F.col("dy") > max(SMALL_HUB, total // sides**2)
    cells = _cube(arcs.where(~crowded).select("x", "y"), sides)
    inside = cells.groupBy("cell").applyInArrow(_closed, ", ".join(f"{c} {kind}" for c in "uvw"))
    into = settle(arcs.where(crowded).select("x", "y"))
    if into.isEmpty():
        return inside
    wedges = attach(arcs.select(F.col("x").alias("u"), F.col("y").alias("v")), into.toDF("u", "w"), ["u"], "inner")
    closed = wedges.where("v != w").join(into.toDF("v", "w"), ["v", "w"])
    return inside.unionByName(closed.select("u", "v", "w"))


def triangle_weights(adj: DataFrame) -> DataFrame:
    """(a, b, triangles) for every unordered pair, 0 included."""
    pairs = settle(undirected(adj))
    found = triangles(pairs)
    sides = found.select(
        F.explode(
            F.array(
                F.struct(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")),
                F.struct(F.least("u", "w").alias("a"), F.greatest("u", "w").alias("b")),
                F.struct(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")),
            )
        ).alias("e")
    ).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("triangles"))
    return pairs.join(sides, ["a", "b"], "left").select(
        "a", "b", F.coalesce("triangles", F.lit(0)).alias("triangles")
    )


def orbit_counts(adj: DataFrame) -> DataFrame:
    """Per node: degree, open wedges it centres, triangles it is in."""
    sides = triangle_weights(adj)
    ends = sides.select(F.explode(F.array("a", "b")).alias("id"), "triangles")
    per = ends.groupBy("id").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("triangles").alias("__twice")
    )
    inside = F.expr("__twice div 2")
    return per.select(
        "id", "degree",
        (F.expr("degree * (degree - 1) div 2") - inside).alias("wedges"),
        inside.alias("triangles"),
    )


def ego_nets(pairs: DataFrame) -> DataFrame:
    """(ego, a, b): for each node the pairs inside it and its neighbours.

    A pair lies in the nets of its two ends and of every node that closes a
    triangle over it, so the triangle list gives all of them.
    """
    pairs = settle(pairs.select("a", "b"))
    own = pairs.select(F.explode(F.array("a", "b")).alias("ego"), "a", "b")
    found = triangles(pairs)
    far = found.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("ego"), F.least("v", "w").alias("a"),
                         F.greatest("v", "w").alias("b")),
                F.struct(F.col("v").alias("ego"), F.least("u", "w").alias("a"),
                         F.greatest("u", "w").alias("b")),
                F.struct(F.col("w").alias("ego"), F.least("u", "v").alias("a"),
                         F.greatest("u", "v").alias("b")),
            )
        ).alias("e")
    ).select("e.ego", "e.a", "e.b")
    return own.unionByName(far)


def diameter_lower_bound(adj: DataFrame) -> DataFrame:
    """Eccentricity (at least 1) of the node with most links, ties to the largest id."""
    ends = adj.select(F.explode(F.array("src", "dst")).alias("id"))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("__c"))
    start = counts.agg(F.max(F.struct("__c", "id")).alias("__m")).select(F.col("__m.id").alias("id"))
    arcs = settle(both_ways(undirected(adj)))
    last = -1
    for last, _ in _hops(arcs, start.where("id IS NOT NULL")):
        pass
    return adj.sparkSession.range(1).select(F.lit(max(1, last)).alias("diameter"))


def _hops(arcs: DataFrame, start: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(hop, nodes first reached at that hop with their smallest parent), until none is new.

    A neighbour of hop h lies at hop h - 1, h or h + 1, so only two frontiers are
    compared and nothing that was reached earlier is read again.
    """
    kind = dict(start.dtypes)["id"]
    before = None
    now = settle(start.select("id", F.lit(None).cast(kind).alias("parent")))
    for hop in itertools.count():
        if now.isEmpty():
            return
        yield hop, now
        reached = attach(arcs, now.select("id"), ["id"], "inner")
        found = reached.groupBy(F.col("to").alias("id")).agg(F.min("id").alias("parent"))
        seen = now.select("id") if before is None else now.select("id").union(before.select("id"))
        before, now = now, settle(found.join(seen, "id", "left_anti"))


class _Pieces:
    """A table that grows by pieces; equal sizes are merged, so a row is rewritten log times."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def add(self, piece: DataFrame, level: int = 0) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(piece)
        if len(self.levels[level]) == PIECES:
            merged = settle(functools.reduce(DataFrame.unionByName, self.levels[level]))
            self.levels[level] = []
            self.add(merged, level + 1)

    def all(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [p for level in self.levels for p in level])


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) with the smallest id of the component.

    Alternating star contraction: every node hands its larger neighbours, then
    its smaller ones, to its smallest neighbour, until nothing changes. Rounds
    grow with the logarithm of the graph, not with its diameter.
    """
    start = pairs.where("a != b").select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")
    ).distinct()
    everyone = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    stars, mark = settle(start), None
    while True:
        both = stars.select("v", "m").union(stars.select("m", "v")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("__low")).select(
            "x", F.least("x", "__low").alias("low")
        )
        large = settle(
            attach(both, least, ["x"], "inner")
            .where("y > x")
            .select(F.col("y").alias("v"), F.col("low").alias("m"))
            .distinct()
        )
        lows = large.groupBy("v").agg(F.min("m").alias("low"))
        handed = attach(large, lows, ["v"], "inner")
        small = handed.where("m != low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        small = settle(small.union(lows.select("v", F.col("low").alias("m"))).distinct())
        stars = small
        seal = F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))
        now = tuple(stars.agg(F.count(F.lit(1)), seal).first())
        if now == mark:
            break
        mark = now
    roots = stars.groupBy(F.col("v").alias("id")).agg(F.min("m").alias("__root"))
    return everyone.join(roots, "id", "left").select(
        "id", F.coalesce("__root", "id").alias("component")
    )


def spanning_tree(pairs: DataFrame, root) -> DataFrame:
    """(a, b, in_tree): a breadth-first tree from ``root``, each node keeping its
    smallest parent, and the remaining pairs."""
    arcs = settle(both_ways(pairs))
    spark = pairs.sparkSession
    kind = dict(pairs.dtypes)["a"]
    start = spark.createDataFrame([(root,)], f"id {kind}")
    reached = _Pieces()
    for _, nodes in _hops(arcs, start):
        reached.add(nodes)
    seen = reached.all()
    tree = seen.where("parent IS NOT NULL").select(
        F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"),
        F.lit(True).alias("in_tree"),
    )
    return pairs.join(tree, ["a", "b"], "left").select(
        "a", "b", F.coalesce("in_tree", F.lit(False)).alias("in_tree")
    )
