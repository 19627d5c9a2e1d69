"""Iterated operators; the SQL side runs the same recurrences as recursive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, r
from linktide.functions import columns as C
from linktide.operators import neighbourhood as NB
from linktide.operators.focus import (
    FocusParams,
    diffusion_step,
    focus,
    heat_step,
    lambda_2,
    lambda_max,
    run_focus,
    springs_step,
)
from linktide.operators.propagate import entry_table, spmv
from linktide.operators.rank import pagerank
from linktide.operators.spectral import effective_dim, lambda2_normalized

GRAPH = """
adj AS MATERIALIZED (SELECT src, dst, w FROM adjacency),
sym AS MATERIALIZED (SELECT i, j, sum(w) AS w FROM (SELECT src AS i, dst AS j, w FROM adj UNION ALL SELECT dst, src, w FROM adj) GROUP BY i, j),
node AS MATERIALIZED (SELECT id, sum(o) AS out, sum(w) AS deg, sum(o) = 0 AS dangling FROM
  (SELECT src AS id, w AS o, w FROM adj UNION ALL SELECT dst, 0.0, w FROM adj) GROUP BY id),
size AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n, sum(deg) AS mass FROM node),
walk AS MATERIALIZED (SELECT src, dst, w / out AS t FROM adj JOIN node ON src = id)
"""


#: The start of the power iterations, as in ``focus.start_value``.
TURN = "id * CAST(0.6180339887498949 AS DOUBLE)"
SPREAD = f"({TURN} - floor({TURN}) + 0.5)"


def top_bound(d):
    """Twice the largest degree: a bound on the largest eigenvalue that SQL can state."""
    ends = d.adjacency.select(F.explode(F.array("src", "dst")).alias("id"), "w")
    return 2 * ends.groupBy("id").agg(F.sum("w").alias("s")).agg(F.max("s")).first()[0]


@query("sparse_product", "SELECT src AS id, round(sum(w * focus), 9) AS y FROM adjacency JOIN phi ON dst = id GROUP BY src", "adjacency phi")
def _(d):
    entries = d.adjacency.select(F.col("src").alias("row"), F.col("dst").alias("col"), "w")
    return spmv(entries, d.phi.select("id", F.col("focus").alias("x"))).select("id", r("y"))


DIFFUSED = """diff AS MATERIALIZED (SELECT node.id, 0.15 * deg / mass + 0.85 * (lost * deg / mass + coalesce(tx, 0)) AS x FROM node
  CROSS JOIN size CROSS JOIN (SELECT coalesce(sum(focus), 0) AS lost FROM phi JOIN node USING (id) WHERE dangling)
  LEFT JOIN (SELECT dst AS id, sum(t * focus) AS tx FROM walk JOIN phi ON src = phi.id GROUP BY dst) m ON m.id = node.id)"""


@query("diffusion_step", f"WITH {GRAPH}, {DIFFUSED} SELECT id, round(x, 9) AS x FROM diff", "adjacency phi")
def _(d):
    table = entry_table(d.adjacency)
    return diffusion_step(table, d.phi.withColumnRenamed("focus", "x")).select("id", r("x"))


@query("springs_step", f"""WITH {GRAPH} SELECT node.id, round((1 / n + wx) / (1 + deg), 9) AS x FROM node CROSS JOIN size
JOIN (SELECT i AS id, sum(w * focus) AS wx FROM sym JOIN phi ON j = phi.id GROUP BY i) m ON m.id = node.id""", "adjacency phi")
def _(d):
    table = entry_table(d.adjacency)
    return springs_step(table, d.phi.withColumnRenamed("focus", "x")).select("id", r("x"))


def heat_sql(name: str, start: str, tau: float, degree: int) -> str:
    """Chebyshev recurrence for exp(-tau L) of ``start(id, x)`` on [0, 2 max degree]."""
    return f"""
{name}_c AS MATERIALIZED (SELECT k, (CASE WHEN k = 0 THEN 1 ELSE 2 END) / 400.0 * list_sum(list_transform(range(400),
    lambda q: exp(-s * (cos(pi() * (q + 0.5) / 400) + 1)) * cos(k * pi() * (q + 0.5) / 400))) AS c
  FROM range({degree + 1}) t(k), (SELECT {tau} * max(deg) AS s FROM node)),
{name}_h AS MATERIALIZED (SELECT i, j, -w / m AS h FROM sym, (SELECT max(deg) AS m FROM node) UNION ALL
  SELECT id, id, deg / m - 1 FROM node, (SELECT max(deg) AS m FROM node)),
{name}_r AS (SELECT 0 AS k, id, CAST(0 AS DOUBLE) AS prev, x AS cur FROM {start}
  UNION ALL SELECT st.k + 1, st.id, st.cur, (CASE WHEN st.k = 0 THEN 1 ELSE 2 END) * p.y - (CASE WHEN st.k = 0 THEN 0 ELSE 1 END) * st.prev
  FROM {name}_r st JOIN (SELECT h.i AS id, sum(h.h * q.cur) AS y FROM {name}_h h JOIN {name}_r q ON h.j = q.id GROUP BY h.i) p ON p.id = st.id
  WHERE st.k < {degree}),
{name} AS MATERIALIZED (SELECT id, sum(c * cur) AS x FROM {name}_r r JOIN {name}_c c ON r.k = c.k GROUP BY id)"""


@query("heat_step", f"WITH {GRAPH}, st AS MATERIALIZED (SELECT id, focus AS x FROM phi JOIN node USING (id)), {heat_sql('heat', 'st', 0.05, 24)} SELECT id, round(x, 9) AS x FROM heat", "adjacency phi", recursive=True)
def _(d):
    params = FocusParams(tau=0.05, heat_error=1e-12)
    table = entry_table(d.adjacency)
    return heat_step(table, d.phi.withColumnRenamed("focus", "x"), top_bound(d), params).select("id", r("x"))


def blend_sql(name: str, before: str, tau: float = 0.02, degree: int = 20) -> str:
    """One focus step from ``before(id, x)`` to ``name(id, x)``."""
    return f"""{heat_sql(name + '_heat', before, tau, degree)},
{name}_raw AS MATERIALIZED (SELECT node.id, 0.5 * (0.15 * deg / mass + 0.85 * (lost * deg / mass + coalesce(tx, 0)))
   + 0.3 * (1 / n + wx) / (1 + deg) + 0.2 * he.x AS x FROM node CROSS JOIN size
  CROSS JOIN (SELECT coalesce(sum(x), 0) AS lost FROM {before} JOIN node USING (id) WHERE dangling)
  LEFT JOIN (SELECT dst AS id, sum(t * x) AS tx FROM walk JOIN {before} b ON src = b.id GROUP BY dst) m ON m.id = node.id
  JOIN (SELECT i AS id, sum(w * x) AS wx FROM sym JOIN {before} b ON j = b.id GROUP BY i) s ON s.id = node.id
  JOIN {name}_heat he ON he.id = node.id),
{name} AS MATERIALIZED (SELECT id, x / (SELECT sum(x) FROM {name}_raw) AS x FROM {name}_raw)"""


@query("focus_three_steps", f"""WITH {GRAPH}, f0 AS MATERIALIZED (SELECT id, 1 / n AS x FROM node, size),
{blend_sql('f1', 'f0')}, {blend_sql('f2', 'f1')}, {blend_sql('f3', 'f2')} SELECT id, round(x, 9) AS focus FROM f3""", "adjacency", recursive=True)
def _(d):
    params = FocusParams(tau=0.02, heat_error=1e-12)
    return run_focus(entry_table(d.adjacency), 3, top_bound(d), params).nodes.select("id", r("focus"))


@query("contraction_and_steps", """
WITH k AS (SELECT id, 0.5 * 0.15 + 0.3 * focus * 1000 / (focus * 1000 + 1) + 0.2 * exp(-focus * 1000) AS kappa FROM phi)
SELECT id, round(kappa, 9) AS kappa, CAST(least(500, ceil(ln(1e-6) / ln(kappa))) AS INTEGER) AS steps FROM k""", "phi")
def _(d):
    p = FocusParams()
    scaled = d.phi.withColumn("l", F.col("focus") * 1000)
    out = scaled.withColumn("kappa", C.contraction("l", "l", p))
    return out.select("id", r("kappa"), C.steps_to("kappa", 1e-6, 500).alias("steps"))


def power_sql(steps: int, image: str, start: str) -> str:
    return f"""
it AS (SELECT 0 AS k, id, x, CAST(0 AS DOUBLE) AS quotient FROM ({start})
  UNION ALL SELECT k + 1, id, y / max(abs(y)) OVER (), sum(x * y) OVER () / sum(x * x) OVER () FROM (
    SELECT a.k, a.id, a.x, {image} AS y FROM it a JOIN node ON node.id = a.id
    JOIN (SELECT i AS id, sum(w * x) AS wx FROM sym JOIN it ON j = it.id GROUP BY i) m ON m.id = a.id
    WHERE a.k < {steps}))"""


@query("lambda_max", f"""WITH {GRAPH}, {power_sql(17, 'deg * a.x - wx', f'SELECT id, {SPREAD} AS x FROM node')}
SELECT round(max(quotient), 6) AS lambda_max FROM it WHERE k = 17""", "adjacency", recursive=True)
def _(d):
    value = lambda_max(entry_table(d.adjacency), 17)
    return d.spark.createDataFrame([(round(value, 6),)], "lambda_max double")


@query("lambda_2", f"""WITH {GRAPH}, top AS MATERIALIZED (SELECT 2 * max(deg) AS t FROM node),
{power_sql(17, '(SELECT t FROM top) * a.x - (deg * a.x - wx)', f'SELECT id, {SPREAD} - (SELECT avg({SPREAD}) FROM node) AS x FROM node')}
SELECT round(greatest(0, (SELECT t FROM top) - max(quotient)), 6) AS lambda_2 FROM it WHERE k = 17""", "adjacency", recursive=True)
def _(d):
    value = lambda_2(entry_table(d.adjacency), top_bound(d), 17)
    return d.spark.createDataFrame([(round(value, 6),)], "lambda_2 double")


@query("normalized_gap", f"""WITH {GRAPH},
start AS MATERIALIZED (SELECT id, {SPREAD} - sqrt(deg) * (SELECT sum({SPREAD} * sqrt(deg)) / sum(deg) FROM node) AS x FROM node),
ns AS MATERIALIZED (SELECT i, j, w / sqrt(a.deg * b.deg) AS w FROM sym JOIN node a ON i = a.id JOIN node b ON j = b.id),
it AS (SELECT 0 AS k, id, x, CAST(0 AS DOUBLE) AS quotient FROM start
  UNION ALL SELECT k + 1, id, y, sum(x * y) OVER () / sum(x * x) OVER () FROM (
    SELECT a.k, a.id, a.x, y FROM it a JOIN (SELECT i AS id, sum(w * x) AS y FROM ns JOIN it ON j = it.id GROUP BY i) m ON m.id = a.id WHERE a.k < 17))
SELECT round(greatest(0, 1 - max(quotient)), 6) AS lambda_2 FROM it WHERE k = 17""", "adjacency", recursive=True)
def _(d):
    value = lambda2_normalized(d.adjacency, 17)
    return d.spark.createDataFrame([(round(value, 6),)], "lambda_2 double")


@query("pagerank", f"""WITH {GRAPH}, pr AS (SELECT 0 AS k, id, 1 / n AS x, n FROM node, size
  UNION ALL SELECT k + 1, a.id, 0.85 * (coalesce(tx, 0) + lost / n) + 0.15 / n, n FROM pr a
  LEFT JOIN (SELECT dst AS id, sum(t * x) AS tx FROM walk JOIN pr ON src = pr.id GROUP BY dst) m ON m.id = a.id
  CROSS JOIN (SELECT coalesce(sum(CASE WHEN dangling THEN x END), 0) AS lost FROM pr JOIN node ON pr.id = node.id) WHERE k < 10)
SELECT id, round(x, 9) AS focus FROM pr WHERE k = 10""", "adjacency", recursive=True)
def _(d):
    return pagerank(d.adjacency, steps=10).select("id", r("focus"))


@query("effective_dimension", "SELECT CAST(ceil(exp(-sum(focus * ln(focus)))) AS INTEGER) AS effective_dim FROM phi", "phi")
def _(d):
    return effective_dim(d.phi.select(F.col("focus").alias("sigma")))


BFS = """arcs AS MATERIALIZED (SELECT a AS id, b AS t FROM edges UNION ALL SELECT b, a FROM edges),
bfs AS (SELECT id, 0 AS hop FROM start UNION SELECT t, hop + 1 FROM bfs JOIN arcs USING (id) WHERE hop < {hops})"""


@query("diameter_lower_bound", """WITH ends AS (SELECT id, count(*) AS c FROM (SELECT src AS id FROM adjacency UNION ALL SELECT dst FROM adjacency) GROUP BY id),
start AS (SELECT id FROM ends ORDER BY c DESC, id DESC LIMIT 1), """ + BFS.format(hops=6) + """
SELECT CAST(max(h) AS INTEGER) AS diameter FROM (SELECT id, min(hop) AS h FROM bfs GROUP BY id)""", "adjacency edges", recursive=True)
def _(d):
    return NB.diameter_lower_bound(d.adjacency)


@query("neighborhood", "WITH start AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity = 50 AND l_tax = 0 AND l_discount = 0), "
       + BFS.format(hops=2) + " SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM bfs GROUP BY id", "edges", recursive=True)
def _(d):
    seeds = d.table("lineitem").where(
        "l_quantity = 50 AND l_tax = 0 AND l_discount = 0"
    ).select(F.col("l_partkey").alias("id"))
    return NB.neighborhood(d.adjacency, seeds, 2)


@query("components", """
WITH pairs AS (SELECT c_custkey AS a, -1 - c_nationkey AS b FROM customer UNION SELECT 1000000000 + s_suppkey, -1 - s_nationkey FROM supplier)
SELECT id, min(b) OVER (PARTITION BY g) AS component FROM (
  SELECT a AS id, b AS g, b FROM pairs UNION ALL SELECT DISTINCT b, b, b FROM pairs)""")
def _(d):
    one = d.table("customer").select(F.col("c_custkey").alias("a"), (-1 - F.col("c_nationkey")).cast("bigint").alias("b"))
    two = d.table("supplier").select((1000000000 + F.col("s_suppkey")).alias("a"), (-1 - F.col("s_nationkey")).cast("bigint").alias("b"))
    return NB.components(one.unionByName(two))


TRI = """tri AS MATERIALIZED (SELECT x.a AS u, x.b AS v, y.b AS w FROM edges x JOIN edges y ON x.b = y.a JOIN edges z ON z.a = x.a AND z.b = y.b)"""
SIDES = "sides AS (SELECT u AS a, v AS b FROM tri UNION ALL SELECT u, w FROM tri UNION ALL SELECT v, w FROM tri)"


@query("triangle_weights", f"WITH {TRI}, {SIDES} SELECT e.a, e.b, count(s.a) AS triangles FROM edges e LEFT JOIN sides s ON e.a = s.a AND e.b = s.b GROUP BY 1, 2", "edges")
def _(d):
    return NB.triangle_weights(d.adjacency)


@query("orbit_counts", f"""WITH {TRI}, deg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges) GROUP BY id),
t AS (SELECT id, count(*) AS triangles FROM (SELECT u AS id FROM tri UNION ALL SELECT v FROM tri UNION ALL SELECT w FROM tri) GROUP BY id)
SELECT deg.id, degree, degree * (degree - 1) // 2 - coalesce(triangles, 0) AS wedges, coalesce(triangles, 0) AS triangles FROM deg LEFT JOIN t ON deg.id = t.id""", "edges")
def _(d):
    return NB.orbit_counts(d.adjacency)


@query("ego_nets", f"""WITH {TRI}
  SELECT a AS ego, a, b FROM edges UNION ALL SELECT b, a, b FROM edges UNION ALL
  SELECT u, least(v, w), greatest(v, w) FROM tri UNION ALL SELECT v, least(u, w), greatest(u, w) FROM tri UNION ALL
  SELECT w, least(u, v), greatest(u, v) FROM tri""", "edges")
def _(d):
    return NB.ego_nets(d.edges)


STEPS = 15  # what the contraction coefficient asks for on these links


@query("focus_full", f"""WITH {GRAPH}, f0 AS MATERIALIZED (SELECT id, 1 / n AS x FROM node, size),
{", ".join(blend_sql(f"f{t + 1}", f"f{t}", 1.0, 96) for t in range(STEPS))} SELECT id, round(x, 8) AS focus FROM f{STEPS}""", "adjacency", recursive=True)
def _(d):
    return focus(d.adjacency, FocusParams(heat_error=1e-12), steps=STEPS).nodes.select("id", r("focus", 8))
