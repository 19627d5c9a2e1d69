import pytest
from graphs import DEMO, DEMO_FOCUS, fan, fed_cycle, laplacian_values, reference_focus, two_cliques
from pyspark.sql import functions as F

from linktide.operators.focus import (
    FocusParams,
    focus,
    heat_series,
    heat_step,
    krylov_ends,
    lambda_2,
    lambda_max,
    run_focus,
    spectral_bound,
    step_count,
)
from linktide.operators.graph import adjacency
from linktide.operators.impulse import impulse
from linktide.operators.measures import telemetry
from linktide.operators.propagate import entry_table
from linktide.operators.spectral import spectral_embedding
from linktide.operators.weights import Context, effective_links


def graph(links, ctx=Context()):
    return adjacency(effective_links(links, ctx))


def values(result):
    return {r["id"]: r["focus"] for r in result.nodes.collect()}


def test_demo_graph_matches_published_figures(spark, make_links):
    done = focus(graph(make_links(DEMO)))
    assert {k: round(v, 6) for k, v in values(done).items()} == DEMO_FOCUS
    row = telemetry(done.nodes, done.spectrum).first()
    assert round(row["syntropy"], 4) == 0.0484
    assert round(row["entropy"], 4) == 1.3379
    assert round(row["kappa"], 3) == 0.412
    assert round(row["lambda_2"], 3) == 0.604
    assert (row["n"], row["steps"]) == (4, 16)


def test_demo_impulse_matches_published_figures(make_links):
    found = impulse(make_links(DEMO), make_links([(2, 1, 8000, 2)]))
    row = found.summary.first()
    assert round(row["directed"], 6) == 0.072235
    assert round(row["norm_l1"], 6) == 0.324732
    assert row["discovery"] == 0
    assert abs(row["delta_j"] - row["entropy_drop"]) < 1e-9


@pytest.mark.parametrize("params", [FocusParams(tau=0.3), FocusParams(tau=2.0).stepwise_heat()])
def test_steps_agree_with_dense_matrices(spark, make_links, params):
    links = [*DEMO, (5, 1, 40), (2, 6, 10), (7, 7, 90)]
    adj = graph(make_links(links))
    rows = [tuple(r) for r in adj.select("src", "dst", "w").collect()]
    table = entry_table(adj)
    got = values(run_focus(table, 3, spectral_bound(table), params))
    want = reference_focus(rows, params, 3)
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_heat_series_is_exact():
    import numpy as np

    x = np.linspace(-1, 1, 401)
    for s in (0.0, 1e-6, 0.3, 7.0, 500.0, 30_000.0):
        series = heat_series(s)
        for error in (1e-4, 1e-8, 1e-12):
            d = series.degree(error, 1.0)
            found = np.polynomial.chebyshev.chebval(x, series.coefficients[: d + 1])
            assert np.abs(found - np.exp(-s * (x + 1))).max() < error + 1e-12


def test_step_count_is_the_smallest():
    for kappa in (0.0, 0.1, 0.412, 0.5, 0.999):
        for epsilon in (1e-2, 1e-6, 0.25):
            t = step_count(kappa, epsilon, 500)
            assert kappa**t <= epsilon or t == 500
            assert t == 1 or kappa ** (t - 1) > epsilon
    assert step_count(1.0, 1e-6, 500) == 500


def test_heat_is_right_on_many_separate_hubs(spark):
    """The Krylov end of such a spectrum is too low; the heat map must not rely on it."""
    import numpy as np

    sizes = [150 + 5 * i for i in range(30)]
    rows, want, begin = [], {}, 0
    for m in sizes:
        hub, leaves = begin, range(begin + 1, begin + m + 1)
        rows += [(leaf, hub, 1.0) for leaf in leaves]
        x = np.array([1.0 + i % 3 for i in range(m + 1)])
        lap = np.diag([m, *[1.0] * m])
        lap[0, 1:] = lap[1:, 0] = -1
        values_, vectors = np.linalg.eigh(lap)
        want.update(zip([hub, *leaves], vectors @ (np.exp(-values_) * (vectors.T @ x))))
        begin += m + 1
    adj = spark.createDataFrame(rows, "src bigint, dst bigint, w double")
    first = {n: 0 for n in want}
    begin = 0
    for m in sizes:
        first.update({begin + i: 1.0 + i % 3 for i in range(m + 1)})
        begin += m + 1
    phi = spark.createDataFrame(list(first.items()), "id bigint, x double")
    table = entry_table(adj)
    got = {r["id"]: r["x"] for r in heat_step(table, phi).collect()}
    assert max(abs(got[n] - want[n]) for n in want) < 1e-5


def test_hub_parts_give_the_same_focus(spark, make_links):
    links = [(i, 0, 100 + i) for i in range(1, 40)] + [(0, i, 50) for i in range(1, 40, 3)]
    adj = graph(make_links(links))
    whole, parts = entry_table(adj), entry_table(adj, hub=4)
    assert parts.salted and not whole.salted
    params = FocusParams(tau=0.5)
    one, two = (values(run_focus(t, 3, spectral_bound(t), params)) for t in (whole, parts))
    assert max(abs(one[k] - two[k]) for k in one) < 1e-12


def test_many_graphs_run_side_by_side(spark, make_links):
    adj = graph(make_links(DEMO))
    both = adj.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("g"), "src", "dst", "w")
    both = both.where("g = 'a' OR src < 4")
    params = FocusParams(epsilon=1e-3)
    done = focus(both, params, keys=["g"]).nodes
    for g, cut in (("a", adj), ("b", adj.where("src < 4"))):
        alone = values(focus(cut, params))
        got = {r["id"]: r["focus"] for r in done.where(F.col("g") == g).collect()}
        assert max(abs(alone[k] - got[k]) for k in alone) < 1e-6


def test_spectrum_by_krylov_and_power_steps(spark, make_links):
    edges = two_cliques(4, 160)
    want = laplacian_values(edges)
    table = entry_table(graph(make_links(edges)))
    top, gap = krylov_ends(table, 8)
    assert abs(top - want[-1]) < 1e-6 and abs(gap - want[1]) < 1e-6
    assert abs(lambda_max(table, 60) - top) < 1e-6
    assert abs(lambda_2(table, top, 120) - gap) < 1e-6


def test_a_fed_node_leads_its_cycle(make_links):
    done = focus(graph(make_links(fed_cycle(5, [90, 30, 150]))), FocusParams(epsilon=1e-3))
    got = values(done)
    assert abs(sum(got.values()) - 1) < 1e-12
    assert max(got, key=got.get) == 0 and 0 < done.spectrum.kappa < 1


@pytest.mark.parametrize(
    "links,ctx",
    [
        (fan(3), {"karma": (501, 2.5)}),
        ([(*e, 1.0 if e[1] == 1 else 0.4) if e[1] < 4 else e for e in fan(3)], {}),
        (fan(3), {"will": (501, 700)}),
    ],
)
def test_author_and_market_signals_lift_a_node(spark, make_links, links, ctx):
    tables = Context(
        karma=spark.createDataFrame([ctx["karma"]], "neuron bigint, kappa double") if "karma" in ctx else None,
        will=spark.createDataFrame([ctx["will"]], "neuron bigint, will bigint") if "will" in ctx else None,
    )
    got = values(focus(graph(make_links(links), tables), FocusParams(), steps=3))
    assert got[1] > max(got[2], got[3]) + 1e-6 and abs(got[2] - got[3]) < 1e-12


def test_equal_branches_stay_equal(make_links):
    got = values(focus(graph(make_links(fan(4))), steps=3))
    assert max(got[i] for i in range(1, 5)) - min(got[i] for i in range(1, 5)) < 1e-12


def test_degenerate_graphs(make_links):
    assert focus(graph(make_links([(1, 1, 100)]))).nodes.count() == 0
    doubted = graph(make_links([(7, 8, 100, 1, 0.0), (1, 2, 100)]))
    assert sorted(values(focus(doubted, steps=2))) == [1, 2]
    assert sorted(values(focus(graph(make_links([(1, 2, 0), (2, 3, 50)])), steps=2))) == [2, 3]


def test_scale_of_all_stakes_does_not_matter(make_links):
    small = [(1, 2, 1000), (2, 3, 500), (4, 1, 3000)]
    big = [(a, b, w * 10**12) for a, b, w in small]
    one, two = (values(focus(graph(make_links(x)), steps=3)) for x in (small, big))
    assert max(abs(one[k] - two[k]) for k in one) < 1e-12


def test_discovery_of_new_nodes(make_links):
    base = [(1, 2, 100), (2, 3, 100), (3, 1, 100)]
    fast = FocusParams(epsilon=1e-2)
    row = impulse(make_links(base), make_links([(1, 9, 200)]), params=fast).summary.first()
    assert row["discovery"] > 0
    assert abs(row["delta_j"] - row["entropy_drop"] - row["discovery"]) < 1e-9
    first = impulse(make_links(base).where("false"), make_links(base), params=fast)
    assert first.summary.first()["discovery"] == 0
    assert abs(first.delta.agg(F.sum("delta")).first()[0] - 1) < 1e-9


def test_embedding_splits_two_cliques(spark, make_links):
    edges = two_cliques(4, 10)
    found = spectral_embedding(graph(make_links(edges)), 2)
    side = {r["id"]: r["coords"][0] > 0 for r in found.coordinates.collect()}
    assert len({side[i] for i in side if i < 100}) == len({side[i] for i in side if i > 100}) == 1
    assert side[1] != side[101]
    want = laplacian_values(edges)
    assert abs(found.eigenvalues[0] - want[1]) < 1e-6
    assert len(spectral_embedding(graph(make_links(edges)), 50).eigenvalues) == 7


def test_a_step_costs_one_shuffle(spark):
    from linktide.operators.focus import laplacian
    from linktide.operators.propagate import planned_for
    from linktide.session import settle

    rows = spark.range(60_000).select(
        (F.col("id") % 500).alias("src"), (F.col("id") * 7 % 503).alias("dst"), F.lit(1.0).alias("w")
    )
    table = entry_table(adjacency(rows))
    assert table.width > 1
    with planned_for(table):
        state = settle(table.per_node(x=F.lit(1.0)))
        for _ in range(3):
            state = table.step(state, {"x": laplacian(F.col("x"))})
        plan = state._jdf.queryExecution().executedPlan().toString().splitlines()
    sums = [x for x in plan if "Exchange hashpartitioning(to#" in x and f", {table.width})" in x]
    assert len(sums) == 3
    assert sum("ShuffledHashJoin" in x for x in plan) == 3
