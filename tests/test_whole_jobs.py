"""Registered queries run the whole of the job that they name."""

import inspect
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import jobs, registry
from linktide.operators import krylov as K
from linktide.operators.evaluate import retrieval_at_k, retrieval_by_walks
from linktide.operators.focus import FocusParams
from linktide.operators.local import focus_of_additions, seeded_walks, shared_base
from linktide.operators import local as L


class Called(Exception):
    pass


def arguments(monkeypatch, module, name, query, data):
    """What ``query`` gives to the function ``name``, by its parameters."""
    real = inspect.signature(getattr(module, name))

    def record(*args, **kwargs):
        bound = real.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(module, name, record)
    monkeypatch.setattr(registry, "Data", lambda spark, folder: data)
    with pytest.raises(Called) as found:
        registry.QUERIES[query](None, "")
    return found.value.args[0]


@pytest.fixture
def few_links(spark):
    rows = [(1, 2, 2000, "F", 1), (2, 3, 2001, "F", -1), (3, 1, 2001, "F", 1)]
    links = spark.createDataFrame(rows, "src bigint, dst bigint, epoch int, token string, valence int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)], "a bigint, b bigint")
    adjacency = links.select("src", "dst", F.lit(1.0).alias("w"))
    return SimpleNamespace(spark=spark, links=links, edges=edges, adjacency=adjacency)


@pytest.mark.parametrize("query, name", [("impulse", "impulse"), ("propose", "propose")])
def test_impulses_run_to_the_fixed_point(few_links, monkeypatch, query, name):
    assert arguments(monkeypatch, jobs.IM, name, query, few_links)["params"] == FocusParams()


def test_architecture_reads_the_whole_spectrum(few_links, monkeypatch):
    given = arguments(monkeypatch, jobs, "architecture", "architecture", few_links)
    assert (given["spectrum_rank"], given["iterations"], given["gap_steps"]) == (1024, 120, 200)


def test_shares_run_to_the_fixed_point(few_links, monkeypatch):
    given = arguments(monkeypatch, jobs.V, "stage", "shapley_shares", few_links)
    assert given["params"] == FocusParams() and given["hops"] == 2


def test_every_node_with_a_held_out_link_asks(few_links, monkeypatch):
    given = arguments(monkeypatch, jobs.EV, "retrieval_by_walks", "retrieval_at_k", few_links)
    held = [(i, i + 1) for i in range(1, 12)][::5]
    assert {q for q, in given["held_out"].select("query").collect()} == {x for pair in held for x in pair}
    assert "% 100" not in registry.ORACLES["retrieval_at_k"]


def test_best_nodes_are_those_of_whole_walks(spark):
    draw = np.random.default_rng(3)
    ends = {(int(a), int(b)) for a, b in draw.integers(0, 40, (150, 2)) if a != b}
    ends |= {(0, i) for i in range(1, 30)} | {(50 + i, 60) for i in range(6)}  # known ones of a hub, and ties
    pairs = spark.createDataFrame(sorted(ends | {(b, a) for a, b in ends}), "query bigint, id bigint").localCheckpoint()
    adj = pairs.select(F.col("query").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    held = pairs.select("query", ((F.col("id") * 7 + 3) % 40).alias("id")).where("query != id").distinct().localCheckpoint()
    walks = seeded_walks(adj, held.select("query", F.col("query").alias("id")).distinct(), error=0.05)
    every = walks.where("focus > 0").select("query", "id", F.round("focus", 12).alias("score"))
    want = dict(retrieval_at_k(every, held, pairs, 3).collect())
    assert dict(retrieval_by_walks(adj, held, pairs, 3, error=0.05).collect()) == pytest.approx(want)
    cut = seeded_walks(adj, held.select("query", F.col("query").alias("id")).distinct(), error=0.05, best=2)
    assert 0 < cut.count() < walks.count()


def test_parts_in_tasks_as_on_rows(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(draw.integers(0, 25, 90), draw.integers(0, 25, 90), draw.random(90)) if a != b]
    adj = spark.createDataFrame(rows, "src bigint, dst bigint, w double").groupBy("src", "dst").agg(F.sum("w").alias("w")).localCheckpoint()
    phi = adj.groupBy(F.col("src").alias("id")).agg((F.sum("w") / 50).alias("focus")).localCheckpoint()
    added = spark.createDataFrame([("a", 1, 2, 0.5), ("a", 30, 4, 1.0), ("b", 5, 31, 2.0), ("b", 9, 9, 1.0)], "graph string, src bigint, dst bigint, w double")
    base = shared_base(adj, phi)
    one = {(r.graph, r.id): r.focus for r in focus_of_additions(base, added, 1, steps=6).collect()}
    monkeypatch.setattr(L, "PART_ENTRIES", 0)
    many = {(r.graph, r.id): r.focus for r in focus_of_additions(base, added, 1, steps=6).collect()}
    assert one.keys() == many.keys() and one == pytest.approx(many, abs=1e-6)


def test_more_vectors_than_a_block_holds(spark, monkeypatch):
    """A space for many values has blocks of a bounded width and is begun again when it is full."""
    from linktide.operators.spectral import truncated_svd

    draw = np.random.default_rng(4)
    n = 60
    a = draw.random((n, n)) * (draw.random((n, n)) < 0.3)
    links = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    adj = spark.createDataFrame(links, "src bigint, dst bigint, w double")
    phi = spark.createDataFrame([(i, (i + 1) / 1830) for i in range(n)], "id bigint, focus double")
    root = np.sqrt(np.arange(1, n + 1) / 1830)
    want = np.linalg.svd(root[:, None] * a * root, compute_uv=False)
    monkeypatch.setattr(K, "WIDEST", 2)
    monkeypatch.setattr(K, "SPARE", 2)
    monkeypatch.setattr(K, "MOST_VECTORS", 8)
    found = truncated_svd(adj, phi, 12, tolerance=1e-12)
    assert found.sigma == pytest.approx(want[:12], rel=1e-6)
