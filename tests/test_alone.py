"""Graphs of one cell: whole runs in one task give what many cells and rows give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linktide.operators import packed as P
from linktide.operators.focus import FocusParams, diffusion_step, focus, heat_step, run_focus, spectral_bound, springs_step
from linktide.operators.packed import Side, _moved
from linktide.operators.propagate import entry_table, row_entries
from linktide.operators.spectral import spectral_embedding, truncated_svd


def odd_graph(spark):
    """Self links, a hub, a sink, weights that are null."""
    draw = np.random.default_rng(6)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(draw.integers(0, 30, 120), draw.integers(0, 30, 120), draw.random(120))]
    rows += [(7, i, 0.5) for i in range(30)] + [(i, 90, 1.0) for i in range(3)] + [(3, 3, 2.0), (95, 96, None), (4, 95, 0.25)]
    return spark.createDataFrame(rows, "src bigint, dst bigint, w double").localCheckpoint()


def close(got, want, error=1e-9):
    got, want = (dict(df.collect()) for df in (got, want))
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert (got[k] is None) == (x is None) and (x is None or got[k] == pytest.approx(x, abs=error))


def test_sums_of_runs(monkeypatch):
    monkeypatch.setattr(P, "RUN_LINKS", 5)
    draw = np.random.default_rng(1)
    src, dst, w = draw.integers(0, 9, 70), np.sort(draw.integers(0, 9, 70)), draw.random(70)
    x = draw.random((3, 9))
    assert np.allclose(Side(dst, src, w, 9).summed(x), _moved(x, src, dst, w))
    assert np.allclose(Side(dst, src, w, 9).summed(x[0], True), _moved(x[0], src, dst, w * w))
    assert not Side(dst[:0], src[:0], w[:0], 9).summed(x).any()


@pytest.mark.parametrize("step", [diffusion_step, springs_step, heat_step])
def test_single_steps_never_build_rows(spark, step):
    adj = odd_graph(spark)
    phi = spark.createDataFrame([(i, 0.1 * i) for i in range(25)] + [(90, None), (777, 1.0)], "id bigint, x double")
    table, rows = entry_table(adj), row_entries(adj)
    close(step(table, phi).select("id", "x"), step(rows, phi).select("id", "x"))
    assert table._made is None
    table.release()
    rows.release()


def test_focus_runs_in_one_task(spark):
    """All steps of a graph of one cell are a few jobs; there was one for every few steps."""
    adj, params = odd_graph(spark).where("w IS NOT NULL"), FocusParams(epsilon=1e-4)
    rows = row_entries(adj)
    tracker, group = spark.sparkContext.statusTracker(), "alone"
    spark.sparkContext.setJobGroup(group, "focus of one cell")
    done = focus(adj, params)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = run_focus(rows, done.steps, spectral_bound(rows), params)
    close(done.nodes.select("id", "focus"), want.nodes.select("id", "focus"), 1e-7)
    assert done.steps > 5 and jobs < 40
    rows.release()


def test_vectors_as_from_many_cells(spark, monkeypatch):
    adj = odd_graph(spark).where("w IS NOT NULL")
    phi = adj.groupBy(F.col("src").alias("id")).agg((F.sum("w") / 50).alias("focus")).localCheckpoint()
    one = truncated_svd(adj, phi, 5), spectral_embedding(adj, 2).eigenvalues
    monkeypatch.setattr(P, "SMALLEST_CELL", 20)
    many = truncated_svd(adj, phi, 5), spectral_embedding(adj, 2).eigenvalues
    assert one[0].sigma == pytest.approx(many[0].sigma, rel=1e-8) and one[1] == pytest.approx(many[1], abs=1e-6)
    left = [dict(s.left.collect()) for s in (one[0], many[0])]
    assert left[0].keys() == left[1].keys()
    assert all(np.allclose(left[0][k], left[1][k], atol=1e-5) for k in left[1])
