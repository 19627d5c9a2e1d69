import math

import numpy as np
import pytest
from graphs import DEMO, KARATE
from pyspark.sql import functions as F

from linktide.operators.evaluate import (
    average_precision,
    connectivity_sweep,
    non_edges,
    retrieval_at_k,
    roc_auc,
    split_edges,
    superadditivity,
)
from linktide.operators.focus import FocusParams, focus
from linktide.operators.graph import adjacency
from linktide.operators.keyed import attach
from linktide.operators.local import local_focus, personalized_focus
from linktide.operators.measures import free_energy, resolve_prefix
from linktide.operators.neighbourhood import (
    components,
    distances,
    gravity,
    neighborhood,
    spanning_tree,
    total_gravity,
    triangle_weights,
)
from linktide.operators.ordering import floored_walk, numbered, running_sums
from linktide.operators.spectral import embedding_matrix, truncated_svd
from linktide.operators.truth import accumulate, bts_scores
from linktide.operators.value import coalition_values, conserve, shapley
from linktide.operators.weights import apply_token_weights, effective_links
from linktide.plans.compile import compile_tables


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a bigint, b bigint")


def test_karate_club_matches_published_figures(spark):
    ordered = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(KARATE)], "i int, a bigint, b bigint")
    marked = split_edges(ordered, ["i"])
    train, test = (marked.where(c).select("a", "b") for c in ("NOT held_out", "held_out"))
    everyone = pairs(spark, [(a, b) for a in range(34) for b in range(a + 1, 34)])
    negatives = non_edges(everyone, pairs(spark, KARATE))
    assert (test.count(), negatives.count()) == (16, 483)
    nodes = spark.range(34)
    row = superadditivity(train, test, negatives, nodes, FocusParams(epsilon=1e-5)).first()
    assert [round(row[c], 3) for c in ("auc", "best_auc", "mean_auc")] == [0.725, 0.589, 0.511]
    assert [round(row[c], 4) for c in ("ap", "mean_ap", "best_ap")] == [0.1201, 0.0509, 0.2115]
    assert round(row["syntropy"], 4) == 0.0837


def test_connectivity_sweep_keeps_all_nodes(spark):
    ring = [(i, (i + 1) % 5) for i in range(5)] + [(0, 2)]
    ring = [(min(e), max(e)) for e in ring]
    fast = FocusParams(epsilon=0.2, krylov_steps=4, tau=0.2)
    out = connectivity_sweep(
        pairs(spark, ring), pairs(spark, [(1, 3)]), pairs(spark, [(1, 4)]), 0,
        quarters=(0, 4), params=fast,
    ).orderBy("quarter").collect()
    assert out[0]["lambda_2"] <= out[1]["lambda_2"] + 1e-9
    marked = {tuple(r)[:2]: r["in_tree"] for r in spanning_tree(pairs(spark, ring), 0).collect()}
    assert sum(marked.values()) == 4 and len(marked) == 6


def test_ranking_metrics_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(float(s), bool(p)) for s, p in zip(rng.integers(0, 9, 300), rng.random(300) < 0.3)]
    scored = spark.createDataFrame(rows, "score double, positive boolean")
    pos = [s for s, p in rows if p]
    neg = [s for s, p in rows if not p]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(roc_auc(scored).first()[0] - wins) < 1e-12
    want = sum(
        pos.count(s) / len(pos) * sum(p >= s for p in pos) / sum(r[0] >= s for r in rows)
        for s in set(pos)
    )
    assert abs(average_precision(scored).first()[0] - want) < 1e-12
    one_sided = scored.where("positive")
    assert roc_auc(one_sided).first()[0] == 0.5


def test_retrieval_precision(spark):
    near = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.1), (5, 2, 0.3)], "query int, id int, score double")
    held = spark.createDataFrame([(1, 3), (9, 1)], "query int, id int")
    known = spark.createDataFrame([(1, 2)], "query int, id int")
    got = {r["query"]: r["precision"] for r in retrieval_at_k(near, held, known, 2).collect()}
    assert got == {1: 0.5, 9: 0.0}


def test_ordered_operators_with_one_hot_key(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, float(v)) for i, v in enumerate(rng.normal(size=900))]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    want, run, walk = {}, {}, {}
    for k, i, v in rows:
        run[k] = run.get(k, 0.0) + v
        want[i] = run[k]
        walk[k] = max(0.0, walk.get(k, 1.0) + v)
    sums = {r["i"]: r["s"] for r in running_sums(df, {"s": F.col("v")}, ["i"], ["k"]).collect()}
    assert max(abs(sums[i] - want[i]) for i in want) < 1e-9
    order = {r["i"]: r["position"] for r in numbered(df, ["i"]).collect()}
    assert order == {i: i for i in range(900)}
    folded = floored_walk(df, F.col("v"), ["i"], ["k"]).collect()
    got = {r["k"]: r["total"] + max(1.0, -r["lowest"]) for r in folded}
    assert max(abs(got[k] - walk[k]) for k in walk) < 1e-9


def test_attach_lets_a_skewed_side_be_split(spark):
    left = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x")
    )
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        joined = attach(left, right, ["k"])
        joined.select(F.max("x"), F.sum("n")).collect()
        out = joined.groupBy("x").agg(F.sum("n"))
        out.collect()
        assert "skew" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_truth_scores_of_copiers_and_dissenters(spark):
    def scores(rows):
        data = [(1, i, n, b, p) for i, (n, b, p) in enumerate(rows)]
        return bts_scores(spark.createDataFrame(data, "question_id int, ord int, neuron int, belief double, prediction double"))

    assert all(abs(r["score"]) < 0.01 for r in scores([(i, 0.7, 0.7) for i in range(4)]).collect())
    crowd = scores([(1, 0.8, 0.8), (2, 0.8, 0.8), (3, 0.8, 0.8), (4, 0.15, 0.8)])
    got = {r["neuron"]: r["kappa"] for r in accumulate(crowd, 1.0).collect()}
    assert got[4] > got[1]
    assert scores([(1, 0.9, 0.2)]).first()["score"] == 0


def test_components_and_distances(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (200, 200)]
    got = {r["id"]: r["component"] for r in components(pairs(spark, chain)).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[i] for i in (100, 101, 102)} == {100} and got[200] == 200
    adj = pairs(spark, [(1, 2), (2, 3), (3, 4)]).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w"))
    phi = spark.createDataFrame([(1, 0.4), (2, 0.3), (3, 0.2), (4, 0.1)], "id bigint, focus double")
    near = distances(adj, phi.select("id"), 2).collect()
    assert {(r["source"], r["id"]): r["d"] for r in near}[(1, 3)] == 2 and len(near) == 10
    pulls = gravity(adj, phi, phi.select("id"), 3)
    assert abs(pulls.where("id = 1").first()["gravity"] - 0.4 * (0.3 + 0.2 / 4 + 0.1 / 9)) < 1e-12
    assert abs(total_gravity(pulls).first()[0] - pulls.toPandas()["gravity"].sum()) < 1e-12


def test_triangles_against_brute_force(spark):
    edges = set(KARATE)
    adj = pairs(spark, KARATE).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w"))
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(34)}
    got = {(r["a"], r["b"]): r["triangles"] for r in triangle_weights(adj).collect()}
    assert got == {(a, b): len(near[a] & near[b]) for a, b in edges}


def test_singular_values(spark):
    m = np.array([[2.0, 1, 0], [1, 2, 0], [0, 0, 3]])
    rows = [(i, j, float(m[i, j])) for i in range(3) for j in range(3) if m[i, j]]
    adj = spark.createDataFrame(rows, "src bigint, dst bigint, w double")
    ones = spark.createDataFrame([(i, 1.0) for i in range(3)], "id bigint, focus double")
    svd = truncated_svd(adj, ones, 3)
    assert np.allclose(svd.sigma, [3, 3, 1], atol=1e-6)
    u = np.array([r["u"] for r in svd.left.orderBy("id").collect()])
    v = np.array([r["v"] for r in svd.right.orderBy("id").collect()])
    assert np.allclose(u @ np.diag(svd.sigma) @ v.T, m, atol=1e-6)
    e = np.array([r["e"] for r in embedding_matrix(svd, 5).orderBy("id").collect()])
    assert e.shape == (3, 5) and np.allclose(e[:, 3:], 0)


def test_compile_of_the_demo_graph(spark, make_links):
    links = make_links(DEMO).withColumn("block", F.col("ord") + 10)
    out = compile_tables(links, iterations=40)
    shape = out.shape
    assert (shape.particles, shape.width, shape.heads, shape.layers) == (9, 64, 1, 4)
    assert shape.parameters() == 268168
    names = {r["tensor"] for r in out.tensors.select("tensor").distinct().collect()}
    assert len(names) == 17
    assert out.fidelity.agg(F.min("pearson")).first()[0] >= 0.7
    head = out.heads.collect()
    assert [r["dialect"] for r in head] == ["bottom"]


def test_shapley_shares_add_up(spark, make_links):
    base = make_links([(1, 2, 100), (2, 3, 100), (3, 1, 100)])
    batch = make_links([(1, 3, 900), (2, 3, 500)]).withColumn("player", F.col("dst") * 10 + F.col("src"))
    fast = FocusParams(epsilon=0.2, tau=0.05, krylov_steps=4, heat_error=1e-4)
    shares = shapley(base, batch, params=fast)
    sampled = shapley(base, batch, samples=6, seed=1, params=fast, most=6)
    total = shares.agg(F.sum("share")).first()[0]
    everyone = spark.createDataFrame([("all", "31"), ("all", "32")], "coalition string, player string")
    whole = coalition_values(base, batch, everyone, params=fast).first()["value"]
    assert abs(total - whole) < 1e-9
    assert abs(sampled.agg(F.sum("share")).first()[0] - whole) < 1e-9
    clipped = conserve(shares, whole / 2).agg(F.sum("share")).first()[0]
    assert abs(clipped - whole / 2) < 1e-9


def test_local_and_seeded_focus(spark, make_links):
    adj = adjacency(effective_links(make_links(DEMO)))
    base = focus(adj, steps=4).nodes
    seeds = spark.createDataFrame([(4,)], "id bigint")
    lifted = personalized_focus(adj, seeds, base, 0.5, steps=2).nodes
    one, two = ({r["id"]: r["focus"] for r in x.collect()} for x in (base, lifted))
    assert two[4] > one[4]
    strange = spark.createDataFrame([(4,), (99,)], "id bigint")
    again = personalized_focus(adj, strange, base, 0.5, steps=2).nodes
    assert {r["id"]: r["focus"] for r in again.collect()} == pytest.approx(two, abs=1e-12)


def test_breadth_first_search_goes_to_the_end(spark):
    chain = [(i, i + 1) for i in range(20)] + [(0, 30), (2, 4), (30, 31)]
    marked = spanning_tree(pairs(spark, chain), 0).collect()
    assert {(r["a"], r["b"]) for r in marked if not r["in_tree"]} == {(3, 4)}
    adj = pairs(spark, chain).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w"))
    start = spark.createDataFrame([(31,)], "id bigint")
    near = {r["id"]: r["hop"] for r in neighborhood(adj, start, 4).collect()}
    assert near == {31: 0, 30: 1, 0: 2, 1: 3, 2: 4}


def test_crowd_reference_needs_karma(spark):
    from linktide.operators.truth import crowd_reference

    rows = [(1, n, n, b, b, 1, 1.0) for n, b in ((1, 0.2), (2, 0.4), (3, 0.9))]
    reports = spark.createDataFrame(
        rows, "question_id bigint, ord bigint, neuron bigint, belief double, prediction double, valence int, stake double"
    )
    karma = spark.createDataFrame([(3, 0.0), (2, 2.0)], "neuron bigint, kappa double")
    assert {r["neuron"] for r in crowd_reference(reports).collect()} == {1, 2, 3}
    assert {r["neuron"] for r in crowd_reference(reports, karma=karma).collect()} == {1, 2}


def test_local_focus_moves_only_what_an_edit_moves(spark):
    ring = [(i, i % 12 + 1, 1.0) for i in range(1, 13)] + [(1, 7, 0.5), (4, 10, 0.5)]
    frame = lambda rows: spark.createDataFrame(rows, "src bigint, dst bigint, w double")
    params = FocusParams(tau=0.1)
    before = frame(ring)
    base = focus(before, params, steps=24).nodes.select("id", "focus")
    old = {r["id"]: r["focus"] for r in base.collect()}
    same = {r["id"]: r["focus"] for r in local_focus(before, before, base, 2, params).collect()}
    assert same == old
    after = frame([*ring, (2, 3, 3.0)])
    full = {r["id"]: r["focus"] for r in focus(after, params, steps=10, start=base.withColumnRenamed("focus", "x")).nodes.collect()}
    errors = []
    for hops in (1, 6):  # six hops are the whole ring
        got = {r["id"]: r["focus"] for r in local_focus(before, after, base, hops, params, steps=10).collect()}
        errors.append(sum(abs(got[i] - full[i]) for i in full))
    assert errors[1] < errors[0] < sum(abs(old[i] - full[i]) for i in full)
    assert errors[1] < 1e-4
    gone = local_focus(before, frame([r for r in ring if 5 not in r[:2]]), base, 1, params, steps=4)
    left = {r["id"]: r["focus"] for r in gone.collect()}
    assert left[5] < old[5] and sum(left.values()) < 1.05


def test_free_energy_terms(spark):
    adj = spark.createDataFrame([(1, 2, 2.0)], "src bigint, dst bigint, w double")
    phi = spark.createDataFrame([(1, 0.75), (2, 0.25)], "id bigint, focus double")
    same = phi.withColumnRenamed("focus", "x")
    row = free_energy(adj, phi, same, same).first()
    assert math.isclose(row["elastic"], 0.3 * (2 * 0.25 / 2 + 0.5 * 2 * 0.0625))
    assert row["smoothness"] == 0 and row["divergence"] == 0


def test_bad_input_fails(spark, make_links):
    links = make_links(DEMO).withColumn("token", F.lit("X"))
    tokens = spark.createDataFrame([("Y", 1.0)], "token string, rho double")
    with pytest.raises(Exception, match="no weight for token"):
        apply_token_weights(links, tokens).collect()
    ids = spark.createDataFrame([("ab",), ("ac",)], "id string")
    with pytest.raises(Exception, match="ids start with"):
        resolve_prefix(ids, "a").collect()
    assert resolve_prefix(ids, "ab").first()[0] == "ab"
