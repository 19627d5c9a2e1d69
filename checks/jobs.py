"""Whole jobs: impulses, local runs, spectra, projections, streams and sinks.

The iterated ones use few steps and a small heat time, which keeps the run over
all links short; their exact values are tested on small graphs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.iterative import BFS
from checks.registry import query, r
from checks.scores import LABELLED, labelled
from linktide.operators import dialect as DI
from linktide.operators import evaluate as EV
from linktide.operators import impulse as IM
from linktide.operators import measures as M
from linktide.operators import projections as PR
from linktide.operators import value as V
from linktide.operators.focus import FocusParams, diffusion_step, focus, heat_step
from linktide.operators.local import local_focus, personalized_focus
from linktide.operators.propagate import entry_table
from linktide.operators.spectral import embedding_matrix, spectral_embedding, truncated_svd
from linktide.plans.compile import architecture
from linktide.session import ensure_checkpoint_dir, settle
from linktide.sources import link_records as RECORDS
from linktide.sources import tables as TB
from linktide.streaming import epochs as ST

SHORT = FocusParams(tau=0.02, epsilon=0.2, krylov_steps=8, heat_error=1e-6)


def scratch(d) -> str:
    """A fresh folder next to the checkpoints, which all executors share."""
    ensure_checkpoint_dir(d.spark)
    return f"{d.spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


@query("telemetry")
def _(d):
    done = focus(d.adjacency, SHORT)
    return M.telemetry(done.nodes, done.spectrum, d.phi)


@query("free_energy")
def _(d):
    adj, phi = d.adjacency, d.phi
    table = entry_table(adj)
    x = phi.withColumnRenamed("focus", "x")
    top = 2 * table.entries.agg(F.max("degree")).first()[0]
    params = FocusParams(tau=0.02)
    return M.free_energy(adj, phi, diffusion_step(table, x), heat_step(table, x, top, params), params)


@query("impulse")
def _(d):
    links = d.links
    return IM.impulse(links.where("epoch < 2001"), links.where("epoch = 2001")).summary


@query("propose")
def _(d):
    links = d.links
    return IM.propose(links.where("epoch < 2001"), links.where("epoch = 2001"))


@query("shapley_shares", """
WITH claims AS (SELECT DISTINCT token AS cluster, valence AS player FROM links WHERE epoch = 2001 AND src <> dst)
SELECT cluster, count(*) AS players, true AS whole FROM claims GROUP BY cluster""", "links")
def _(d):
    # A cluster's shares must sum to the value of all its players.
    links, base = d.links, d.links.where("epoch < 2001")
    batch = links.where("epoch = 2001 AND src <> dst").select(
        "*", F.col("valence").cast("string").alias("player"), F.col("token").alias("cluster"))
    ground = V.stage(base, batch)
    sums = V.shapley(base, batch, ground=ground).groupBy("cluster").agg(
        F.count("player").alias("players"), F.sum("share").alias("share"))
    everyone = batch.select("cluster", F.lit("all").alias("coalition"), "player").distinct()
    worth = ground.values(everyone).select("cluster", "value")
    return sums.join(worth, "cluster").select(
        "cluster", "players", (F.abs(F.col("share") - F.col("value")) < 1e-5).alias("whole"))  # two runs, heat cut at 1e-8


@query("personalized_focus")
def _(d):
    seeds = d.table("lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("id"))
    return personalized_focus(d.adjacency, seeds, d.phi, 0.5, SHORT).nodes.select("id", "focus")


@query("local_focus")
def _(d):
    lines = d.table("lineitem").where("l_quantity = 50 AND l_tax = 0 AND l_discount = 0")
    before = d.adjacency
    after = before.join(lines.select(F.col("l_partkey").alias("src")).distinct(), "src", "left_anti")
    return local_focus(before, after, d.phi, 1, SHORT).select("id", "focus")


@query("spectral_embedding")
def _(d):
    return spectral_embedding(d.adjacency, 2).coordinates


#: The rank of the registered factors, and the residual they must keep to, against the largest value.
RANK, RESIDUAL = 64, 1e-3


@query("truncated_svd", f"""
SELECT range::INT AS c, true AS exact, true AS ordered, round(mass, 9) AS mass
FROM range({RANK}), (SELECT sum(w * w * p.focus * q.focus) AS mass FROM adjacency JOIN phi p ON src = p.id JOIN phi q ON dst = q.id)""",
       "links adjacency phi")
def _(d):
    svd = truncated_svd(d.adjacency, d.phi, RANK, tolerance=1e-7)
    top, rows = svd.sigma[0], []
    for c, (s, e) in enumerate(zip(svd.sigma, svd.residual)):
        rows.append((c, e <= RESIDUAL * top, s <= svd.sigma[max(0, c - 1)], svd.mass))
    return d.spark.createDataFrame(rows, "c int, exact boolean, ordered boolean, mass double").withColumn("mass", r("mass"))


@query("embedding_matrix")
def _(d):
    return embedding_matrix(truncated_svd(d.adjacency, d.phi, RANK, tolerance=1e-7), RANK)


@query("architecture")
def _(d):
    adj = d.adjacency
    nodes = adj.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    shape, _, table = architecture(adj, nodes, 5)
    table.release()
    return shape.row(d.spark)


# Projections of a two-column node table; relations are the labelled pairs.
VEC = f"""{LABELLED},
rel AS MATERIALIZED (SELECT head, src, dst, sum(stake) / (SELECT max(stake) FROM assigned) AS w FROM assigned WHERE stake > 0 GROUP BY 1, 2, 3),
vec AS MATERIALIZED (SELECT id, focus * 1000 AS x, sqrt(focus) AS y FROM (SELECT 'n' || CAST(id AS VARCHAR) AS id, focus FROM phi)),
one AS MATERIALIZED (SELECT head, src AS id, sum(w * x) AS x, sum(w * y) AS y FROM rel JOIN vec ON dst = id GROUP BY 1, 2),
two AS MATERIALIZED (SELECT rel.head, src AS id, sum(w * x) AS x, sum(w * y) AS y FROM rel JOIN one ON dst = id AND rel.head = one.head GROUP BY 1, 2)
"""


def relation(d):
    return DI.dialect_adjacency(DI.assign_dialects(labelled(d)))


def vectors(d):
    return d.phi.select(
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"),
        F.array(F.col("focus") * 1000, F.sqrt("focus")).alias("e"), "focus")


@query("apply_power", f"WITH {VEC} SELECT head, id, round(x, 8) AS x, round(y, 8) AS y FROM two", "links phi")
def _(d):
    out = PR.apply_power(relation(d), vectors(d), 2)
    return out.select("head", "id", r(F.col("e")[0], 8).alias("x"), r(F.col("e")[1], 8).alias("y"))


@query("bilinear_projection", f"""WITH {VEC}
SELECT head, 0 AS i, round(sum(v.x * t.x), 7) AS a, round(sum(v.x * t.y), 7) AS b FROM two t JOIN vec v USING (id) GROUP BY head
UNION ALL SELECT head, 1, round(sum(v.y * t.x), 7), round(sum(v.y * t.y), 7) FROM two t JOIN vec v USING (id) GROUP BY head""", "links phi")
def _(d):
    out = PR.project(relation(d), vectors(d), 2)
    return out.select("head", "i", r(F.col("values")[0], 7).alias("a"), r(F.col("values")[1], 7).alias("b"))


@query("value_projection", f"""WITH {VEC}, o AS (SELECT id, sum(x) AS x, sum(y) AS y FROM one GROUP BY id),
h AS (SELECT o.x * v.x / 1000 AS wx, o.y * v.x / 1000 AS wy, v.x, v.y FROM o JOIN vec v USING (id))
SELECT 0 AS head, 0 AS i, round(sum(x * wx), 8) AS a, round(sum(x * wy), 8) AS b FROM h
UNION ALL SELECT 0, 1, round(sum(y * wx), 8), round(sum(y * wy), 8) FROM h""", "links phi")
def _(d):
    v = vectors(d)
    merged = relation(d).groupBy(F.lit(0).alias("head"), "src", "dst").agg(F.sum("w").alias("w"))
    out = PR.value_projection(merged, v.select("id", "e"), v.select("id", "focus"), 2)
    return out.select("head", "i", r(F.col("values")[0], 8).alias("a"), r(F.col("values")[1], 8).alias("b"))


@query("head_fidelity")
def _(d):
    p = settle(PR.project(relation(d), vectors(d), 1).withColumn("power", F.lit(1)))  # read twice
    return PR.check_heads(PR.qk_factors(p, 2, 2000), p)


@query("ego_focus")
def _(d):
    return EV.ego_focus(d.edges, SHORT)


#: Rounds after which every seeded walk of the query below is within its error.
PUSH_ROUNDS, PUSH_ERROR = 24, 0.05


def push_sql() -> str:
    """The rounds of the residual push, one after the other, and the walks they give."""
    parts = []
    for i in range(PUSH_ROUNDS):
        parts.append(f"""
m{i} AS MATERIALIZED (SELECT query, id, r, l > {PUSH_ERROR} AND r >= {PUSH_ERROR} / n AS moves FROM
  (SELECT *, sum(r) OVER (PARTITION BY query) AS l, count(*) OVER (PARTITION BY query) AS n FROM r{i})),
r{i + 1} AS MATERIALIZED (SELECT query, id, sum(r) AS r FROM (
  SELECT query, id, r FROM m{i} WHERE NOT moves
  UNION ALL SELECT query, dst, 0.85 * r * p FROM m{i} JOIN walk ON src = id WHERE moves
  UNION ALL SELECT s.query, s.id, s.r * b.r FROM r0 s JOIN
    (SELECT query, sum(0.85 * r) AS r FROM m{i} WHERE moves AND id NOT IN (SELECT src FROM walk) GROUP BY query) b USING (query))
  GROUP BY query, id)""")
    gains = " UNION ALL ".join(f"SELECT query, id, 0.15 * r AS x FROM m{i} WHERE moves" for i in range(PUSH_ROUNDS))
    return ",".join(parts) + f""",
walks AS MATERIALIZED (SELECT query, id, round(sum(x), 12) AS score FROM ({gains}) GROUP BY query, id)"""


@query("retrieval_at_k", f"""
WITH marked AS (SELECT a, b, (row_number() OVER (ORDER BY a, b) - 1) % 5 = 0 AS held FROM edges),
dir AS (SELECT a AS query, b AS id, held FROM marked UNION ALL SELECT b, a, held FROM marked),
walk AS MATERIALIZED (SELECT query AS src, id AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY query) AS p FROM dir WHERE NOT held),
r0 AS MATERIALIZED (SELECT DISTINCT query, query AS id, 1.0::DOUBLE AS r FROM dir WHERE held AND query IN (SELECT src FROM walk)), {push_sql()},
best AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rk
  FROM walks ANTI JOIN (SELECT query, id FROM dir WHERE NOT held) k ON walks.query = k.query AND walks.id = k.id WHERE query <> id),
hits AS (SELECT dir.query, count(*) AS h FROM best JOIN dir ON held AND best.query = dir.query AND best.id = dir.id WHERE rk <= 10 GROUP BY 1)
SELECT DISTINCT dir.query, round(coalesce(h, 0) / 10.0, 9) AS precision FROM dir LEFT JOIN hits ON dir.query = hits.query
WHERE held""", "links edges")
def _(d):
    # A search: every node with a held-out link asks, all nodes answer.
    turn = lambda df, a, b: df.select(F.col("a").alias(a), F.col("b").alias(b)).union(df.select("b", "a"))
    marked = EV.split_edges(d.edges, ["a", "b"])
    held, known = (turn(marked.where(c), "query", "id") for c in ("held_out", "NOT held_out"))
    adj = known.select(F.col("query").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    return EV.retrieval_by_walks(adj, held, known, 10, error=PUSH_ERROR)


@query("sampled_negatives", """
SELECT count(*) AS pairs, count(*) AS different, 0::BIGINT AS linked, 0::BIGINT AS turned FROM edges""", "edges")
def _(d):
    # As many pairs without a link as there are links.
    edges = d.edges
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id"))
    found = EV.sampled_non_edges(nodes, edges, edges.count())
    hit = found.join(edges.withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return hit.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("a", "b").alias("different"),
                   F.count("hit").alias("linked"), F.count_if(F.col("a") >= F.col("b")).alias("turned"))


@query("spanning_tree", """WITH start AS (SELECT min(a) AS id FROM edges), """ + BFS.format(hops=16) + """,
lvl AS MATERIALIZED (SELECT id, min(hop) AS h FROM bfs GROUP BY id),
par AS (SELECT arcs.t AS id, min(arcs.id) AS parent FROM arcs JOIN lvl p ON arcs.id = p.id JOIN lvl c ON arcs.t = c.id AND c.h = p.h + 1 GROUP BY 1)
SELECT a, b, EXISTS (SELECT 1 FROM par WHERE least(id, parent) = a AND greatest(id, parent) = b) AS in_tree FROM edges""", "edges", recursive=True)
def _(d):
    from linktide.operators.neighbourhood import spanning_tree
    edges = d.edges
    root = edges.agg(F.min("a")).first()[0]
    return spanning_tree(edges, root)


@query("links_scan", "SELECT epoch AS block, neuron, src, dst, token, amount, valence, price FROM links", "links")
def _(d):
    path = f"{scratch(d)}/links"
    wide = T.StructType([*TB.LINKS.fields, T.StructField("price", T.DoubleType())])
    d.links.withColumn("block", F.col("epoch")).select(
        *[F.col(f.name).cast(f.dataType) for f in wide.fields]).write.parquet(path)
    whole = [F.col(c).cast("bigint").alias(c) for c in ("neuron", "src", "dst", "amount")]
    return TB.read_links(d.spark, path, schema=wide).select(
        F.col("block").cast("int").alias("block"), *whole, "token", F.col("valence").cast("int").alias("valence"), "price")


@query("context_scan",
       "SELECT coalesce(k.neuron, w.neuron) AS neuron, kappa, will FROM karma k "
       "FULL JOIN will w ON k.neuron = w.neuron", "karma will")
def _(d):
    path = scratch(d)
    for name, value in (("karma", "kappa"), ("will", "will")):  # epoch 2 holds other values
        rows = getattr(d, name)
        both = rows.withColumn("epoch", F.lit(1)).unionByName(
            rows.withColumn(value, F.col(value) * 2).withColumn("epoch", F.lit(2)))
        both.write.partitionBy("epoch").parquet(f"{path}/{name}")
    ctx = TB.read_context(d.spark, path, 1)
    return ctx.karma.join(ctx.will, "neuron", "full")


@query("focus_table", "SELECT epoch, id, round(focus, 9) AS focus FROM history", "history")
def _(d):
    path = scratch(d)
    TB.write_focus(d.history, path)
    return TB.read_focus(d.spark, path).select("epoch", "id", r("focus"))


@query("link_records", """
SELECT sha256(CAST(neuron AS VARCHAR)) AS neuron, sha256(CAST(src AS VARCHAR)) AS src, sha256(CAST(dst AS VARCHAR)) AS dst,
       CASE token WHEN 'F' THEN 1 ELSE 2 END AS token, amount, valence, epoch AS block FROM links""", "links")
def _(d):
    RECORDS.register(d.spark)
    path = scratch(d)
    ids = [F.sha2(F.col(c).cast("string"), 256).alias(c) for c in ("neuron", "src", "dst")]
    d.links.select(
        *ids, F.when(F.col("token") == "F", 1).otherwise(2).cast("bigint").alias("token"), F.col("amount").cast("decimal(38,0)").alias("amount"),
        F.col("valence").cast("tinyint").alias("valence"), F.col("epoch").cast("bigint").alias("block"),
    ).sortWithinPartitions("block").write.format("link_records").mode("append").save(path)
    load = lambda **options: d.spark.read.format("link_records").options(**options).load(path)
    early, late = load(maxBlock=1995), load(minBlock=1996, tokens="1")
    rows = early.unionByName(late).unionByName(load(minBlock=1996, tokens="2"))
    return rows.withColumn("amount", F.col("amount").cast("bigint")).withColumn("valence", F.col("valence").cast("int"))


@query("tensor_table", "SELECT id AS row, greatest(-32768, least(32767, round(focus * 100000 * 256))) / 256.0 AS value FROM phi", "phi")
def _(d):
    path = scratch(d)
    rows = d.phi.select(
        F.lit(0).alias("tensor_no"), F.lit("focus").alias("tensor"), F.col("id").alias("row"),
        F.array(F.col("focus") * 100000).alias("values"), F.lit("u16").alias("encoding"))
    TB.write_tensors(rows, path)
    return TB.read_tensors(d.spark, path).select("row", F.col("values")[0].alias("value"))


def events_stream(d):
    events = d.table("events")
    return d.spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d.folder)


@query("karma_stream", """
WITH f AS (SELECT user_id AS neuron, list((value - 20) / 10 ORDER BY event_id) AS xs FROM events GROUP BY user_id)
SELECT neuron, round(list_reduce(list_prepend(1.0, xs), lambda k, x: greatest(0, k + 0.5 * x)), 6) AS kappa FROM f""")
def _(d):
    path = scratch(d)
    scores = events_stream(d).select(
        F.col("user_id").alias("neuron"), F.col("event_id").alias("ord"), ((F.col("value") - 20) / 10).alias("score"))
    run = ST.karma_stream(scores, path, 0.5, checkpoint=f"{path}/offsets")
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return ST.read_karma(d.spark, path).select("neuron", r("kappa", 6))


@query("epoch_stream", """
WITH stamped AS (SELECT *, CASE WHEN price = 1 THEN 6 ELSE epoch - 1995 END AS e FROM links),
kept AS (SELECT * FROM stamped WHERE src <> dst)
SELECT p.e AS epoch, count(DISTINCT (neuron, src, dst)) AS pairs, round(sum(amount * greatest(0, least(1, price))) / 1e9, 6) AS weighted,
       (SELECT count(*) FROM stamped WHERE price = 1 AND epoch < 2001) AS late,
       (SELECT count(DISTINCT id) FROM (SELECT src AS id, e FROM kept WHERE price > 0 UNION ALL SELECT dst, e FROM kept WHERE price > 0) n WHERE n.e <= p.e) AS nodes
FROM (SELECT DISTINCT e FROM stamped) p JOIN kept k ON k.e <= p.e GROUP BY p.e""", "links")
def _(d):
    # Links of full price arrive after all others, so those of closed epochs are late. SHORT: see the README.
    path = scratch(d)
    links = d.links.select("neuron", "src", "dst", "amount", "price", (F.col("epoch") - 1995).cast("bigint").alias("block"))
    for part in ("price <> 1", "price = 1"):
        links.where(part).write.mode("append").parquet(f"{path}/in")
        stream = d.spark.readStream.schema(links.schema).parquet(f"{path}/in")
        ST.run_epochs(stream, path, 1, params=SHORT, steps=1, checkpoint=f"{path}/offsets").awaitTermination()
    ST.finish_epochs(d.spark, path, params=SHORT, steps=1)
    late = d.spark.read.parquet(f"{path}/progress").agg(F.sum("late").alias("late"))
    nodes = TB.read_focus(d.spark, f"{path}/focus").groupBy("epoch").agg(F.count(F.lit(1)).alias("nodes"))
    pairs = d.spark.read.parquet(f"{path}/pairs").groupBy("epoch").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.sum("weighted") / 1e9, 6).alias("weighted"))
    return pairs.join(nodes, "epoch").join(F.broadcast(late))
