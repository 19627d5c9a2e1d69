"""Packed cells: the same values as the rows of a graph, without building those rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linktide.operators import packed as P
from linktide.operators.focus import FocusParams, lambda_2, lambda_max, run_focus, spectral_bound, spectrum
from linktide.operators.propagate import entry_table, row_entries
from linktide.operators.rank import pagerank
from linktide.operators.spectral import lambda2_normalized


@pytest.fixture
def many_cells(monkeypatch):
    monkeypatch.setattr(P, "SMALLEST_CELL", 20)
    monkeypatch.setattr(P, "DEALT_LINKS", 7)


def odd_graph(spark, kind="bigint"):
    """Repeated links, self links, a hub, a sink, weights that are null."""
    draw = np.random.default_rng(5)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(draw.integers(0, 40, 160), draw.integers(0, 40, 160), draw.random(160))]
    rows += [(7, i, 0.5) for i in range(40)] + [(i, 90, 1.0) for i in range(3)]
    rows += [(3, 3, 2.0), (95, 96, None), (4, 95, 0.25), (97, 98, None)]
    adj = spark.createDataFrame(rows, "src bigint, dst bigint, w double")
    return adj.select(F.col("src").cast(kind), F.col("dst").cast(kind), "w")


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_spectrum_and_rank_as_by_rows(spark, many_cells, kind):
    adj = odd_graph(spark, kind)
    table, rows = entry_table(adj), row_entries(adj.localCheckpoint())
    assert table.cells().groups > 1 and rows.cells() is None
    top = lambda_max(table, 3)
    assert top == pytest.approx(lambda_max(rows, 3), rel=1e-9)
    assert lambda_2(table, 2 * top, 3) == pytest.approx(lambda_2(rows, 2 * top, 3), rel=1e-9)
    assert lambda2_normalized(adj, 3, table) == pytest.approx(lambda2_normalized(adj, 3, rows), rel=1e-9)
    got, want = (dict(pagerank(adj, steps=2, table=t).collect()) for t in (table, rows))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert table._made is None  # the rows, which are shuffled at every step, were never built
    table.release()
    rows.release()


def test_step_ships_vectors_of_groups(spark, many_cells):
    """What a step ships depends on nodes and groups, not on the number of links."""
    sent = []
    for links in (400, 4000):
        draw = np.random.default_rng(links)
        ends = [(int(a), int(b), 1.0) for a, b in draw.integers(0, 50, (links, 2))] + [(i, (i + 1) % 50, 1.0) for i in range(50)]
        pack = entry_table(spark.createDataFrame(ends, "src bigint, dst bigint, w double")).cells()
        state = pack.state(lambda node: {"x": node["start"]})
        done = pack.step(state, lambda node, own: ([("pull", own["x"])], []), lambda node, own, sums, numbers: {"x": sums[0], "size": np.array([len(s) for s in sums])})
        sent.append((pack.groups, sum(len(own["x"]) for _, (_, own) in done.collect())))
        pack.release()
    assert sent[0] == sent[1]


def test_null_ends_stay_with_rows(spark):
    adj = spark.createDataFrame([(1, 2, 1.0), (2, None, 1.0), (2, 3, 2.0)], "src bigint, dst bigint, w double")
    table = entry_table(adj)
    assert table.cells() is None
    assert lambda_max(table, 2) == pytest.approx(lambda_max(row_entries(adj.localCheckpoint()), 2))
    table.release()


def test_focus_as_by_rows(spark, many_cells):
    adj = odd_graph(spark).where("w IS NOT NULL")
    params = FocusParams(tau=0.02, heat_error=1e-9, krylov_steps=3)
    table, rows = entry_table(adj), row_entries(adj.localCheckpoint())
    some = spark.createDataFrame([(7, 0.5), (3, 0.5), (1000, 9.0)], "id bigint, prior double")
    found = []
    for t in (table, rows):
        top = spectral_bound(t)
        done = run_focus(t, 1, top, params, some.select("id", F.col("prior").alias("x")), some).nodes
        found.append((spectrum(t, params).lambda_max, {r[0]: r[1:] for r in done.select("id", "focus", "heat").collect()}))
    assert found[0][0] == pytest.approx(found[1][0], rel=1e-6)
    assert found[0][1].keys() == found[1][1].keys()
    assert all(found[0][1][k] == pytest.approx(v, abs=1e-9) for k, v in found[1][1].items())
    assert not table.listed  # the rows were never built
    table.release()
    rows.release()
