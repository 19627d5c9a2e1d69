"""Measures, impulses, value, truth, markets, dialects, evaluation and dynamics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, r
from linktide.functions import columns as C
from linktide.operators import dialect as DI
from linktide.operators import dynamics as DY
from linktide.operators import evaluate as EV
from linktide.operators import impulse as IM
from linktide.operators import market as MK
from linktide.operators import measures as M
from linktide.operators import neighbourhood as NB
from linktide.operators import truth as T
from linktide.operators import value as V


@query("syntropy", "SELECT round(sum(CASE WHEN focus > 0 THEN focus * ln((SELECT count(*) FROM phi) * focus) ELSE 0 END), 9) AS syntropy FROM phi", "phi")
def _(d):
    return M.syntropy(d.phi).select(r("syntropy"))


@query("entropy", "SELECT round(-sum(CASE WHEN focus > 0 THEN focus * ln(focus) ELSE 0 END), 9) AS entropy FROM phi", "phi")
def _(d):
    return M.entropy(d.phi).select(r("entropy"))


@query("rank_lookup", "SELECT c_custkey AS id, round(coalesce(focus, 0), 9) AS focus FROM customer LEFT JOIN phi ON c_custkey = id", "phi")
def _(d):
    return M.rank_of(d.phi, d.table("customer").select(F.col("c_custkey").alias("id"))).select("id", r("focus"))


@query("l1_drift", "SELECT round(sum(abs(coalesce(p.focus, 0) - coalesce(b.focus, 0))), 9) AS l1_drift FROM phi p FULL JOIN phi_before b ON p.id = b.id", "phi phi_before")
def _(d):
    return M.l1_drift(d.phi, d.phi_before).select(r("l1_drift"))


@query("alignment_divergence", """
WITH a AS (SELECT id, sum(amount) AS s FROM (SELECT src AS id, amount FROM links WHERE neuron % 2 = 0 UNION ALL SELECT dst, amount FROM links WHERE neuron % 2 = 0) GROUP BY id),
b AS (SELECT id, sum(amount) AS s FROM (SELECT src AS id, amount FROM links WHERE neuron % 2 = 1 UNION ALL SELECT dst, amount FROM links WHERE neuron % 2 = 1) GROUP BY id),
p AS (SELECT id, s / (SELECT sum(s) FROM a) AS f FROM a), q AS (SELECT id, s / (SELECT sum(s) FROM b) AS g FROM b)
SELECT round(sum(f * ln(f / g)), 9) AS divergence FROM p JOIN q ON p.id = q.id""", "links")
def _(d):
    ends = d.links.select(F.explode(F.array("src", "dst")).alias("id"), "neuron", "amount")

    def share(kind: int):
        part = ends.where(F.col("neuron") % 2 == kind).groupBy("id").agg(F.sum("amount").alias("s"))
        total = part.agg(F.sum("s").alias("t"))
        return part.join(F.broadcast(total)).select("id", (F.col("s") / F.col("t")).alias("focus"))

    return M.divergence(share(0), share(1)).select(r("divergence"))


@query("gravity", """
SELECT p.id, round(p.focus * sum(q.focus), 9) AS gravity FROM phi p
JOIN (SELECT a AS id, b AS t FROM edges UNION ALL SELECT b, a FROM edges) e ON p.id = e.id
JOIN phi q ON q.id = e.t GROUP BY p.id, p.focus""", "phi edges")
def _(d):
    phi = d.phi
    return NB.gravity(d.adjacency, phi, phi.select("id"), 1).select("id", r("gravity"))


@query("luminosity", "SELECT n.id, round(size * focus, 9) AS luminosity FROM node_values n JOIN phi p ON n.id = p.id", "node_values phi")
def _(d):
    return M.luminosity(d.phi, d.node_values.select("id", "size")).select("id", r("luminosity"))


@query("modules", "SELECT id, round(focus, 9) AS focus FROM phi WHERE focus > 0.0005", "phi")
def _(d):
    return M.modules(d.phi, 0.0005).select("id", r("focus"))


@query("standard_inference", """
WITH per AS (SELECT c.neuron, coalesce(w.will, 0) / n AS avg_will FROM (SELECT neuron, count(*) AS n FROM links GROUP BY neuron) c LEFT JOIN will w ON c.neuron = w.neuron),
weights AS (SELECT src AS query, dst AS id, sum(avg_will) AS w FROM links l JOIN per p ON l.neuron = p.neuron GROUP BY 1, 2)
SELECT query, w.id, round(coalesce(focus, 0) * w, 6) AS score FROM weights w LEFT JOIN phi p ON p.id = w.id""", "links will phi")
def _(d):
    queries = d.links.select(F.col("src").alias("id"))
    return M.standard_inference(d.links, d.phi, d.will, queries).select("query", "id", r("score", 6))


@query("pearson", "SELECT l_suppkey, round(CASE WHEN coalesce(stddev_pop(l_quantity), 0) = 0 OR coalesce(stddev_pop(l_extendedprice), 0) = 0 THEN 0 ELSE corr(l_quantity, l_extendedprice) END, 9) AS pearson FROM lineitem GROUP BY l_suppkey")
def _(d):
    return M.pearson(d.table("lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"]).select("l_suppkey", r("pearson"))


@query("reconstruction_error", """
WITH a AS (SELECT src, dst, sum(amount) AS v FROM links GROUP BY 1, 2),
b AS (SELECT src, dst, sum(amount) AS v FROM links WHERE epoch < 2001 GROUP BY 1, 2)
SELECT round(sqrt(sum(pow(coalesce(b.v, 0) - coalesce(a.v, 0), 2))) / sqrt(sum(pow(coalesce(a.v, 0), 2))), 9) AS relative_error
FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst""", "links")
def _(d):
    def table(links):
        return links.groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg(
            F.sum("amount").cast("double").alias("value"))
    return M.reconstruction_error(table(d.links), table(d.links.where("epoch < 2001"))).select(r("relative_error"))


@query("top_focus", "SELECT id, round(focus, 9) AS focus FROM phi ORDER BY phi.focus DESC, id LIMIT 20", "phi")
def _(d):
    return M.top_focus(d.phi, 20).select("id", r("focus"))


DELTA = """
WITH d AS (SELECT p.id, p.focus, p.focus - coalesce(b.focus, 0) AS delta FROM phi p LEFT JOIN phi_before b ON p.id = b.id) """


@query("shift_delta", DELTA + "SELECT id, round(delta, 9) AS delta FROM d WHERE abs(delta) >= 0.00001", "phi phi_before")
def _(d):
    return IM.shift(d.phi_before, d.phi, 0.00001).select("id", r("delta"))


@query("top_shifts", DELTA + "SELECT id, round(delta, 9) AS delta FROM d ORDER BY abs(d.delta) DESC, id LIMIT 20", "phi phi_before")
def _(d):
    return M.top_shifts(IM.shift(d.phi_before, d.phi), 20).select("id", r("delta"))


@query("shift_summary", DELTA + """,
s0 AS (SELECT count(*) AS n, -sum(focus * ln(focus)) AS h FROM phi_before WHERE focus > 0),
s1 AS (SELECT count(*) AS n, -sum(focus * ln(focus)) AS h FROM phi WHERE focus > 0),
j AS (SELECT (ln(s1.n) - s1.h) - (ln(s0.n) - s0.h) AS dj, s0.h - s1.h AS drop, ln(s1.n / s0.n) AS found FROM s0, s1)
SELECT round((SELECT sum(abs(delta)) FROM d), 9) AS norm_l1, round(dj, 9) AS delta_j, round(greatest(dj, 0), 9) AS directed,
       round(drop, 9) AS entropy_drop, round(found, 9) AS discovery FROM j""", "phi phi_before")
def _(d):
    return IM.shift_summary(d.phi_before, d.phi).select(
        *[r(c) for c in ("norm_l1", "delta_j", "directed", "entropy_drop", "discovery")])


@query("union_links", "SELECT neuron, CAST(count(*) AS BIGINT) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM "
       "(SELECT neuron, amount FROM links UNION ALL SELECT neuron, amount FROM links WHERE epoch = 2001) GROUP BY neuron", "links")
def _(d):
    both = IM.union_links(d.links, d.links.where("epoch = 2001"))
    return both.groupBy("neuron").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("focus_from_deltas", DELTA + "SELECT id, round(sum(v), 9) AS focus FROM (SELECT id, focus AS v FROM phi_before UNION ALL SELECT id, delta FROM d) GROUP BY id", "phi phi_before")
def _(d):
    return IM.focus_from_deltas(d.phi_before, IM.shift(d.phi_before, d.phi)).select("id", r("focus"))


SHARES = "shares AS (SELECT neuron, sum(amount * price) / 1e9 AS share FROM links GROUP BY neuron)"


def shares(d):
    return d.links.groupBy("neuron").agg((F.sum(F.col("amount") * F.col("price")) / 1e9).alias("share"))


@query("conservation_clip", f"WITH {SHARES} SELECT neuron, round(share * CASE WHEN t > 100 THEN 100 / t ELSE 1 END, 9) AS share FROM shares, (SELECT sum(share) AS t FROM shares)", "links")
def _(d):
    return V.conserve(shares(d), 100.0).select("neuron", r("share"))


@query("claim_clusters", """
SELECT c_custkey AS claim, min(c_custkey) OVER (PARTITION BY c_nationkey) AS cluster
FROM customer WHERE abs(c_acctbal) / 10000 >= 0.1""")
def _(d):
    deltas = d.table("customer").select(
        F.col("c_custkey").alias("claim"), F.col("c_nationkey").alias("id"), (F.col("c_acctbal") / 10000).alias("delta"))
    return V.claim_clusters(deltas, 0.1)


@query("reward_equation", f"""
WITH {SHARES}, work AS (SELECT neuron, count(*) AS w FROM links GROUP BY neuron),
fees AS (SELECT o_custkey AS neuron, sum(o_totalprice) AS fee FROM orders GROUP BY 1),
risk AS (SELECT l.neuron, sum(amount * coalesce(kappa, 1.0)) AS r FROM links l LEFT JOIN karma k ON l.neuron = k.neuron WHERE valence <> 0 GROUP BY 1),
who AS (SELECT neuron FROM shares UNION SELECT neuron FROM work UNION SELECT neuron FROM fees UNION SELECT neuron FROM risk),
x AS (SELECT who.neuron, coalesce(share, 0) AS mint, 1000 * coalesce(w, 0) / (SELECT sum(w) FROM work) AS subsidy,
  0.8 * (1 - 0.1) * coalesce(fee, 0) AS service, 500 * coalesce(r, 0) / (SELECT sum(r) FROM risk) AS stake_yield
  FROM who LEFT JOIN shares s ON who.neuron = s.neuron LEFT JOIN work w ON who.neuron = w.neuron
  LEFT JOIN fees f ON who.neuron = f.neuron LEFT JOIN risk k ON who.neuron = k.neuron)
SELECT neuron, round(mint, 4) AS mint, round(subsidy, 4) AS subsidy, round(service, 2) AS service,
       round(stake_yield, 4) AS stake_yield, round(mint + subsidy + service + stake_yield, 2) AS reward FROM x""", "links karma")
def _(d):
    links = d.links
    stakes = links.where("valence != 0").join(d.karma, "neuron", "left").select(
        "neuron", F.col("amount").alias("stake"), F.coalesce("kappa", F.lit(1.0)).alias("kappa"))
    out = V.reward(
        shares(d), links.select("neuron", F.lit(1).alias("work")),
        d.table("orders").select(F.col("o_custkey").alias("neuron"), F.col("o_totalprice").alias("fee")),
        stakes, 1000.0, 500.0, 0.8, 0.1)
    return out.select("neuron", *[r(c, 4) for c in ("mint", "subsidy", "stake_yield")], r("service", 2), r("reward", 2))


@query("supply_split", """
SELECT o_orderkey, round(o_totalprice * (1 - pow(q, 0.5)), 6) AS work_pool, round(o_totalprice * pow(q, 0.5), 6) AS stake_pool,
       round(0.02 * o_totalprice + (1 - 0.3) * (1 - 0.1) * o_custkey, 6) AS budget,
       round(0.02 - o_custkey * 0.1 / o_totalprice, 9) AS net_inflation
FROM (SELECT *, (o_orderkey % 100) / 100.0 AS q FROM orders)""")
def _(d):
    share = (F.col("o_orderkey") % 100) / 100.0
    split = C.supply_split("o_totalprice", share, 0.5)
    floor = F.lit(0.02)
    return d.table("orders").select(
        "o_orderkey", r(split["work_pool"], 6).alias("work_pool"), r(split["stake_pool"], 6).alias("stake_pool"),
        r(C.gross_budget(floor, "o_totalprice", "o_custkey", 0.3, 0.1), 6).alias("budget"),
        r(C.net_inflation(floor, "o_totalprice", "o_custkey", 0.1)).alias("net_inflation"))


@query("annuity", """
WITH v AS (SELECT id AS link, epoch, focus - coalesce(lag(focus) OVER (PARTITION BY id ORDER BY epoch), 0) AS delta FROM history)
SELECT link, epoch, round(sum(delta / (epoch - 1990)) OVER (PARTITION BY link ORDER BY epoch), 9) AS annuity FROM v""", "history")
def _(d):
    from pyspark.sql import Window
    over = Window.partitionBy("id").orderBy("epoch")
    history = d.history
    deltas = history.select(
        F.col("id").alias("link"), "epoch",
        (F.col("focus") - F.coalesce(F.lag("focus").over(over), F.lit(0.0))).alias("delta"))
    weights = history.select("epoch").distinct().withColumn("weight", 1.0 / (F.col("epoch") - 1990))
    return V.annuity(deltas, weights).select("link", "epoch", r("annuity"))


@query("hybrid_reward", f"WITH {SHARES} SELECT neuron, round(0.3 * share + 0.7 * sqrt(share), 9) AS reward FROM shares", "links")
def _(d):
    return shares(d).select("neuron", r(C.blended_reward("share", F.sqrt("share"), 0.3)).alias("reward"))


# Truth scoring.
CL = "least(1 - 1e-6, greatest(1e-6, {}))"
B, P = CL.format("belief"), CL.format("prediction")
KL = "({0} * ln({0} / {1}) + (1 - {0}) * ln((1 - {0}) / (1 - {1})))"
LOO = f"""
logs AS (SELECT *, ln({B}) AS ly, ln(1 - {B}) AS ln_, ln({P}) AS my, ln(1 - {P}) AS mn, count(*) OVER q AS n,
  sum(ln({B})) OVER q AS sy, sum(ln(1 - {B})) OVER q AS sn, sum(ln({P})) OVER q AS ty, sum(ln(1 - {P})) OVER q AS tn
  FROM reports WINDOW q AS (PARTITION BY question_id)),
g AS (SELECT *, exp((sy - ly) / (n - 1)) AS gy, exp((sn - ln_) / (n - 1)) AS gn, exp((ty - my) / (n - 1)) AS hy,
  exp((tn - mn) / (n - 1)) AS hn FROM logs WHERE n > 1),
loo AS (SELECT question_id, neuron, belief, prediction, gy / (gy + gn) AS pbar, hy / (hy + hn) AS mbar FROM g
  UNION ALL SELECT question_id, neuron, belief, prediction, 0.5, 0.5 FROM logs WHERE n = 1)
"""
SCORE = f"""{LOO},
scored AS (SELECT question_id, neuron, {KL.format(B, CL.format('mbar'))} - {KL.format(B, CL.format('pbar'))}
  - {KL.format(CL.format('pbar'), P)} AS score FROM loo)
"""


@query("probability_columns", f"SELECT question_id, neuron, round({B}, 9) AS clamped, round({KL.format(B, P)}, 9) AS divergence FROM reports", "reports")
def _(d):
    return d.reports.select("question_id", "neuron", r(C.clamp_probability("belief")).alias("clamped"),
                            r(C.binary_kl("belief", "prediction")).alias("divergence"))


@query("geometric_means", f"""
WITH m AS (SELECT question_id, exp(avg(ln({B}))) AS by_, exp(avg(ln(1 - {B}))) AS bn, exp(avg(ln({P}))) AS my, exp(avg(ln(1 - {P}))) AS mn, count(*) AS reports FROM reports GROUP BY 1)
SELECT question_id, round(by_ / (by_ + bn), 9) AS belief_mean, round(my / (my + mn), 9) AS prediction_mean, reports FROM m""", "reports")
def _(d):
    return T.geo_means(d.reports).select("question_id", r("belief_mean"), r("prediction_mean"), "reports")


@query("leave_one_out_means", f"WITH {LOO} SELECT question_id, neuron, round(pbar, 9) AS belief_others, round(mbar, 9) AS prediction_others FROM loo", "reports")
def _(d):
    return T.loo_means(d.reports).select("question_id", "neuron", r("belief_others"), r("prediction_others"))


@query("truth_scores", f"WITH {SCORE} SELECT question_id, neuron, round(score, 9) AS score FROM scored", "reports")
def _(d):
    return T.bts_scores(d.reports).select("question_id", "neuron", r("score"))


@query("karma_step", f"WITH {SCORE} SELECT question_id, s.neuron, round(greatest(0, coalesce(kappa, 1.0) + 2 * score), 9) AS kappa FROM scored s LEFT JOIN karma k ON s.neuron = k.neuron", "reports karma")
def _(d):
    scores = T.bts_scores(d.reports).join(d.karma, "neuron", "left")
    return scores.select("question_id", "neuron", r(C.karma_step(F.coalesce("kappa", F.lit(1.0)), "score", 2.0)).alias("kappa"))


@query("karma_accumulate", f"""
WITH {SCORE}, folded AS (SELECT s.neuron, list(score ORDER BY question_id) AS xs, any_value(coalesce(kappa, 1.0)) AS k0
  FROM scored s LEFT JOIN karma k ON s.neuron = k.neuron GROUP BY s.neuron)
SELECT neuron, round(list_reduce(list_prepend(k0, xs), lambda k, x: greatest(0, k + 2 * x)), 8) AS kappa FROM folded""", "reports karma")
def _(d):
    return T.accumulate(T.bts_scores(d.reports), 2.0, d.karma, ["question_id"]).select("neuron", r("kappa", 8))


@query("surprise", f"WITH {SCORE} SELECT question_id, neuron, round(least(1, greatest(0, score / 0.5)), 9) AS surprise FROM scored", "reports")
def _(d):
    return T.bts_scores(d.reports).select("question_id", "neuron", r(C.surprise("score", 0.5)).alias("surprise"))


@query("crowd_reference", f"""
WITH e AS (SELECT *, sqrt(stake) AS w FROM reports WHERE valence <> 0),
s AS (SELECT *, count(*) OVER q AS n, sum(w) OVER q - w AS rest,
  sum(w * ln({B})) OVER q - w * ln({B}) AS sy, sum(w * ln(1 - {B})) OVER q - w * ln(1 - {B}) AS sn,
  sum(w * ln({P})) OVER q - w * ln({P}) AS ty, sum(w * ln(1 - {P})) OVER q - w * ln(1 - {P}) AS tn
  FROM e WINDOW q AS (PARTITION BY question_id)),
g AS (SELECT question_id, neuron, n, exp(sy / rest) AS a, exp(sn / rest) AS b, exp(ty / rest) AS c, exp(tn / rest) AS d_ FROM s)
SELECT question_id, neuron, round(CASE WHEN n < 2 THEN 0.5 ELSE a / (a + b) END, 9) AS belief_others,
       round(CASE WHEN n < 2 THEN 0.5 ELSE c / (c + d_) END, 9) AS prediction_others FROM g""", "reports")
def _(d):
    reports = d.reports.withColumn("ord", F.lit(0))
    return T.crowd_reference(reports, weighting="sqrt").select(
        "question_id", "neuron", r("belief_others"), r("prediction_others"))


@query("surprisingly_popular", f"""
WITH m AS (SELECT question_id, exp(avg(ln({B}))) AS by_, exp(avg(ln(1 - {B}))) AS bn, exp(avg(ln({P}))) AS my, exp(avg(ln(1 - {P}))) AS mn FROM reports GROUP BY 1),
g AS (SELECT question_id, by_ / (by_ + bn) - my / (my + mn) AS gap FROM m)
SELECT question_id, round(gap, 9) AS divergence, CASE WHEN gap > 0 THEN 'yes' WHEN gap < 0 THEN 'no' ELSE 'none' END AS answer FROM g""", "reports")
def _(d):
    return T.surprisingly_popular(d.reports).select("question_id", r("divergence"), "answer")


@query("stake_redistribution", f"""
WITH {SCORE}, x AS (SELECT s.question_id, s.neuron, greatest(score, 0) AS up, stake * least(1, greatest(-score, 0)) AS due
  FROM scored s JOIN reports r ON s.question_id = r.question_id AND s.neuron = r.neuron)
SELECT question_id, neuron, round(CASE WHEN sum(up) OVER q > 0 THEN sum(due) OVER q * up / sum(up) OVER q - due ELSE 0 END, 6) AS transfer
FROM x WINDOW q AS (PARTITION BY question_id)""", "reports")
def _(d):
    return T.redistribute(T.bts_scores(d.reports)).select("question_id", "neuron", r("transfer", 6))


# Markets.
SUPPLY = "s AS (SELECT market, sum(CASE WHEN side = 'YES' THEN qty ELSE 0 END) AS y, sum(CASE WHEN side = 'NO' THEN qty ELSE 0 END) AS n FROM trades GROUP BY market)"
Z = "coalesce({0} / nullif({1}, 0), 0)"


@query("market_state", f"""
WITH {SUPPLY}, t AS (SELECT *, sqrt(y * y + n * n) AS h FROM s)
SELECT market, round({Z.format('2 * y', 'h')}, 9) AS price_yes, round({Z.format('2 * n', 'h')}, 9) AS price_no, round(2 * h, 6) AS cost,
  round({Z.format('2 * y * y', 'h')}, 6) AS reserve_yes, round({Z.format('2 * n * n', 'h')}, 6) AS reserve_no,
  round({Z.format('y * y', '(y * y + n * n)')}, 9) AS forecast FROM t""", "trades")
def _(d):
    return MK.market_state(d.trades, 2.0).select(
        "market", r("price_yes"), r("price_no"), r("cost", 6), r("reserve_yes", 6), r("reserve_no", 6), r("forecast"))


@query("market_scale", f"WITH {SUPPLY} SELECT market, round({Z.format('100.0', 'sqrt(y * y + n * n)')}, 9) AS scale FROM s", "trades")
def _(d):
    openings = MK.market_supplies(d.trades).withColumn("deposit", F.lit(100.0))
    return MK.market_scale(openings).select("market", r("scale"))


@query("market_path", f"""
WITH p AS (SELECT market, ord, sum(CASE WHEN side = 'YES' THEN qty ELSE 0 END) OVER m AS y, sum(CASE WHEN side = 'NO' THEN qty ELSE 0 END) OVER m AS n
  FROM trades WINDOW m AS (PARTITION BY market ORDER BY ord))
SELECT market, ord, round(y, 6) AS yes, round(n, 6) AS no, round({Z.format('y', 'sqrt(y * y + n * n)')}, 9) AS price_yes,
  round({Z.format('y * y', '(y * y + n * n)')}, 9) AS forecast FROM p""", "trades")
def _(d):
    return MK.market_path(d.trades).select("market", "ord", r("yes", 6), r("no", 6), r("price_yes"), r("forecast"))


@query("market_settlement", f"""
WITH {SUPPLY}, t AS (SELECT market, market % 2 AS x, {Z.format('y * y', '(y * y + n * n)')} AS q,
  {Z.format('y * y', 'sqrt(y * y + n * n)')} AS ry, {Z.format('n * n', 'sqrt(y * y + n * n)')} AS rn FROM s)
SELECT market, round({Z.format('x', 'q')}, 6) AS factor_yes, round({Z.format('(1 - x)', '(1 - q)')}, 6) AS factor_no,
  round(ry * {Z.format('x', 'q')}, 6) AS settled_yes, round(rn * {Z.format('(1 - x)', '(1 - q)')}, 6) AS settled_no FROM t""", "trades")
def _(d):
    states = MK.market_state(d.trades)
    outcomes = states.select("market", (F.col("market") % 2).alias("outcome"))
    return MK.settle_markets(states, outcomes).select(
        "market", *[r(c, 6) for c in ("factor_yes", "factor_no", "settled_yes", "settled_no")])


@query("epistemic_signal", """
SELECT question_id, neuron, CASE WHEN prediction <= 0.1 THEN 'uncertain' WHEN abs(belief - prediction) <= 0.0525 THEN 'aligned'
  WHEN belief > prediction THEN 'private' ELSE 'herding' END AS class FROM reports""", "reports")
def _(d):
    return d.reports.select("question_id", "neuron", C.epistemic_class("belief", "prediction", 0.0525).alias("class"))


# Dialects: a supplier labels the pair of every line it ships.
LABELLED = """
pairs AS (SELECT 'n' || CAST(src AS VARCHAR) AS src, 'n' || CAST(dst AS VARCHAR) AS dst,
   'p' || CAST(src AS VARCHAR) || '-' || CAST(dst AS VARCHAR) AS axon,
   CASE valence WHEN 1 THEN amount WHEN -1 THEN -amount ELSE 0 END AS stake, l_suppkey FROM links),
e AS (SELECT src, dst, axon, stake FROM pairs UNION ALL
   SELECT 's' || CAST(l_suppkey AS VARCHAR), axon, 's' || CAST(l_suppkey AS VARCHAR) || axon, stake FROM pairs),
lab AS (SELECT e.src, e.dst, e.stake FROM e SEMI JOIN (SELECT DISTINCT axon FROM e) o ON e.dst = o.axon),
lw AS (SELECT src, dst, sum(stake) AS w FROM lab GROUP BY 1, 2),
sc AS (SELECT src, sum(w) AS usage, count(*) AS coverage, greatest(sum(w), 0) * log2(1 + count(*)) AS score FROM lw GROUP BY 1),
reg AS (SELECT src AS dialect, score, row_number() OVER (ORDER BY score DESC, src) - 1 AS head FROM sc
   WHERE (SELECT max(score) FROM sc) > 0 AND score >= 1e-3 * (SELECT max(score) FROM sc)),
best AS (SELECT dst AS axon, arg_max(head, struct_pack(w := w, h := -head)) AS head FROM lw JOIN reg ON lw.src = reg.dialect GROUP BY 1),
assigned AS (SELECT e.*, coalesce(best.head, (SELECT count(*) FROM reg)) AS head FROM e LEFT JOIN best ON e.axon = best.axon)
"""


def labelled(d):
    links = d.links
    name = F.concat(F.lit("n"), F.col("src").cast("string"))
    to = F.concat(F.lit("n"), F.col("dst").cast("string"))
    axon = F.concat(F.lit("p"), F.col("src").cast("string"), F.lit("-"), F.col("dst").cast("string"))
    who = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    stake = C.signed_stake("valence", "amount").alias("stake")
    plain = F.struct(name.alias("src"), to.alias("dst"), axon.alias("axon"), stake)
    label = F.struct(who.alias("src"), axon.alias("dst"), F.concat(who, axon).alias("axon"), stake)
    return links.select(F.explode(F.array(plain, label)).alias("e")).select("e.*")


@query("label_edges", f"WITH {LABELLED} SELECT src, dst, stake FROM lab", "links")
def _(d):
    return DI.label_edges(labelled(d)).select("src", "dst", "stake")


@query("dialect_scores", f"WITH {LABELLED} SELECT src AS labeller, CAST(usage AS BIGINT) AS usage, coverage, round(score, 3) AS score FROM sc", "links")
def _(d):
    return DI.dialect_scores(labelled(d)).select("labeller", "usage", "coverage", r("score", 3))


@query("registered_dialects", f"WITH {LABELLED} SELECT dialect, round(score, 3) AS score, head FROM reg UNION ALL SELECT 'bottom', 0, (SELECT count(*) FROM reg)", "links")
def _(d):
    return DI.register_dialects(labelled(d)).select("dialect", r("score", 3), "head")


@query("assigned_dialects", f"WITH {LABELLED} SELECT src, dst, axon, stake, head FROM assigned", "links")
def _(d):
    return DI.assign_dialects(labelled(d)).select("src", "dst", "axon", "stake", "head")


@query("dialect_stats", f"WITH {LABELLED} SELECT head, count(*) AS edges, CAST(sum(greatest(stake, 0)) AS BIGINT) AS stake FROM assigned GROUP BY head", "links")
def _(d):
    return DI.dialect_stats(DI.assign_dialects(labelled(d)))


@query("dialect_adjacency", f"WITH {LABELLED} SELECT head, src, dst, round(sum(stake) / (SELECT max(stake) FROM assigned), 9) AS w FROM assigned WHERE stake > 0 GROUP BY 1, 2, 3", "links")
def _(d):
    return DI.dialect_adjacency(DI.assign_dialects(labelled(d))).select("head", "src", "dst", r("w"))


# Evaluation.
@query("split_edges", "SELECT a, b, (row_number() OVER (ORDER BY a, b) - 1) % 5 = 0 AS held_out FROM edges", "edges")
def _(d):
    return EV.split_edges(d.edges, ["a", "b"])


CAND = """
cand AS (SELECT DISTINCT least(l_partkey, l_suppkey * 20 + l_linenumber % 7 + 8) AS a,
  greatest(l_partkey, l_suppkey * 20 + l_linenumber % 7 + 8) AS b FROM lineitem
  WHERE l_partkey <> l_suppkey * 20 + l_linenumber % 7 + 8),
neg AS (SELECT a, b FROM cand ANTI JOIN edges USING (a, b)),
scored AS (SELECT coalesce(p.focus, 0) * coalesce(q.focus, 0) AS score, positive FROM
  (SELECT a, b, true AS positive FROM edges UNION ALL SELECT a, b, false FROM neg) e
  LEFT JOIN phi p ON e.a = p.id LEFT JOIN phi q ON e.b = q.id)
"""


def candidates(d):
    other = F.col("l_suppkey") * 20 + F.col("l_linenumber") % 7 + 8
    return d.table("lineitem").select(F.col("l_partkey").alias("a"), other.alias("b"))


def labelled_pairs(d):
    edges = d.edges
    negatives = EV.non_edges(candidates(d), edges).withColumn("positive", F.lit(False))
    both = edges.withColumn("positive", F.lit(True)).unionByName(negatives)
    return EV.affinity(both, d.phi)


@query("non_edges", f"WITH {CAND} SELECT a, b FROM neg", "links edges phi")
def _(d):
    return EV.non_edges(candidates(d), d.edges)


@query("affinity", "SELECT a, b, round(coalesce(p.focus, 0) * coalesce(q.focus, 0) * 1e6, 9) AS score FROM edges LEFT JOIN phi p ON a = p.id LEFT JOIN phi q ON b = q.id", "links edges phi")
def _(d):
    return EV.affinity(d.edges, d.phi).select("a", "b", r(F.col("score") * 1e6).alias("score"))


@query("roc_auc", f"""
WITH {CAND}, k AS (SELECT positive, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored)
SELECT round((sum(CASE WHEN positive THEN rk END) - count_if(positive) * (count_if(positive) + 1) / 2.0)
  / (count_if(positive) * count_if(NOT positive)), 9) AS auc FROM k""", "links edges phi")
def _(d):
    return EV.roc_auc(labelled_pairs(d)).select(r("auc"))


@query("average_precision", f"""
WITH {CAND}, lv AS (SELECT score, count_if(positive) AS p, count(*) AS c FROM scored GROUP BY score),
cu AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS al FROM lv)
SELECT round(sum(p * tp / al) / sum(p), 9) AS ap FROM cu""", "links edges phi")
def _(d):
    return EV.average_precision(labelled_pairs(d)).select(r("ap"))


# Dynamics.
DENSE = """
es AS (SELECT DISTINCT epoch FROM history), f AS (SELECT id, min(epoch) AS m FROM history GROUP BY id),
dense AS (SELECT e.epoch, f.id, coalesce(h.focus, 0) AS focus FROM f JOIN es e ON e.epoch >= f.m
  LEFT JOIN history h ON h.epoch = e.epoch AND h.id = f.id),
v AS (SELECT *, coalesce(lag(focus) OVER (PARTITION BY id ORDER BY epoch), 0) AS old,
  list(focus) OVER (PARTITION BY id ORDER BY epoch) AS fs FROM dense),
tr AS (SELECT *, list_reduce(fs, lambda m, x: 0.7 * m + 0.3 * x) AS trail FROM v),
gl AS (SELECT *, list(trail) OVER (PARTITION BY id ORDER BY epoch) AS ts FROM tr)
"""


@query("velocity", f"WITH {DENSE} SELECT epoch, id, round(focus - old, 9) AS velocity FROM v", "history")
def _(d):
    return DY.velocity(d.history).select("epoch", "id", r("velocity"))


@query("attention_shift", f"""WITH {DENSE}, s AS (SELECT epoch, sum(focus * old) AS d_, sqrt(sum(focus * focus)) AS a, sqrt(sum(old * old)) AS b FROM v GROUP BY epoch)
SELECT epoch, round(1 - d_ / (a * b), 9) AS shift FROM s WHERE b > 0""", "history")
def _(d):
    return DY.attention_shift(d.history).select("epoch", r("shift"))


@query("trailing_focus", f"WITH {DENSE} SELECT epoch, id, round(trail, 9) AS trailing, round(focus - trail, 9) AS deviation FROM tr", "history")
def _(d):
    return DY.trailing_focus(d.history, 0.3).select("epoch", "id", r("trailing"), r("deviation"))


@query("dwell", """
WITH t AS (SELECT epoch, id, row_number() OVER (PARTITION BY epoch ORDER BY focus DESC, id) AS rank FROM history),
k AS (SELECT *, dense_rank() OVER (ORDER BY epoch) AS pl FROM t QUALIFY rank <= 200),
g AS (SELECT *, pl - row_number() OVER (PARTITION BY id ORDER BY epoch) AS run FROM k)
SELECT epoch, id, rank, row_number() OVER (PARTITION BY id, run ORDER BY epoch) AS dwell FROM g""", "history")
def _(d):
    return DY.dwell(d.history, 200)


@query("excitability_gain", f"WITH {DENSE} SELECT epoch, id, round(list_reduce(list_prepend(1.0, ts), lambda g, x: greatest(0.2, least(1.0, g + 400 * (0.0005 - x)))), 9) AS gain FROM gl", "history")
def _(d):
    return DY.excitability_gain(d.history, 0.3, 0.0005, 400.0, 0.2).select("epoch", "id", r("gain"))
