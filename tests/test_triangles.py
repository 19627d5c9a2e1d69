"""Triangles by a hash cube."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from linktide.operators import neighbourhood as NB


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return {tuple(sorted((a, b, c))) for a, b in edges for c in near[a] & near[b]}


@pytest.mark.parametrize("kind,cell,wedges,hub", [("bigint", 200_000, 2_000_000, 10_000), ("string", 60, 7, 5)])
def test_all_triangles_once(spark, monkeypatch, kind, cell, wedges, hub):
    monkeypatch.setattr(NB, "SMALL_HUB", hub)
    monkeypatch.setattr(NB, "CELL_PAIRS", cell)
    rng = np.random.default_rng(4)
    edges = {tuple(sorted(map(int, e))) for e in rng.integers(0, 40, (260, 2)) if e[0] != e[1]}
    edges |= {(0, i) for i in range(1, 40)} | {(50 + i, 50 + j) for i, j in itertools.combinations(range(8), 2)}
    edges |= {(60, 61), (61, 62)}  # an open wedge
    monkeypatch.setattr(NB, "WEDGES", wedges)
    pairs = spark.createDataFrame(sorted(edges), "a bigint, b bigint").select(*[F.col(c).cast(kind).alias(c) for c in "ab"])
    got = [tuple(sorted(map(int, r))) for r in NB.triangles(pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(edges)
    assert NB.triangles(pairs.limit(0)).count() == 0


def test_a_hub_does_not_fill_a_cell(spark):
    """A star of cliques without the pairs into its hub: the largest cell stays near 3 E / sides^2."""
    cliques = spark.range(60).selectExpr("id AS c").crossJoin(spark.range(10).selectExpr("id AS i")).crossJoin(
        spark.range(10).selectExpr("id AS j")).where("i < j").selectExpr("1 + c * 10 + i AS a", "1 + c * 10 + j AS b")
    star = spark.range(1, 3001).selectExpr("0L AS a", "id AS b")
    arcs, sides = NB._oriented(cliques.unionByName(star)), 5
    assert arcs.where("dy > 1000").count() == 3000
    arcs = arcs.where(f"dy <= {arcs.count() // sides**2}").select("x", "y")
    total = arcs.count()
    loads = [r["count"] for r in NB._cube(arcs, sides).groupBy("cell").count().collect()]
    assert sum(loads) == 3 * sides * total
    assert max(loads) <= 2.2 * 3 * total / sides**2


def test_lists_find_all_triangles_and_ship_less(spark, monkeypatch):
    """At equal degrees the ids that lists ship grow with the pairs; the cube's copies of a pair grow too."""
    rng = np.random.default_rng(7)
    edges = {tuple(sorted(map(int, e))) for e in rng.integers(0, 60, (300, 2)) if e[0] != e[1]} | {(0, i) for i in range(1, 60)}
    pairs = spark.createDataFrame(sorted(edges), "a bigint, b bigint")
    ways = []
    lists, cube = NB._by_lists, NB._by_cube
    monkeypatch.setattr(NB, "_by_lists", lambda arcs: ways.append("lists") or lists(arcs))
    monkeypatch.setattr(NB, "_by_cube", lambda *given: ways.append("cube") or cube(*given))
    for cell, way in ((10, "lists"), (10**9, "cube")):
        monkeypatch.setattr(NB, "CELL_PAIRS", cell)
        for rows in (pairs, pairs.selectExpr("cast(a AS string) AS a", "cast(b AS string) AS b")):
            got = [tuple(sorted(map(int, r))) for r in NB.triangles(rows).collect()]
            assert len(got) == len(set(got)) and set(got) == brute(edges)
        clique = spark.createDataFrame(list(itertools.combinations(range(20), 2)), "a bigint, b bigint")
        assert NB.triangles(clique).count() == 20 * 19 * 18 // 6
        assert way in ways
