"""Sources, filters, weights and graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, r
from linktide.functions import columns as C
from linktide.operators import graph as G
from linktide.operators import weights as W
from linktide.plans.derived import ORDER
from linktide.sources import dictionary as D

EFFECTIVE = """
kept AS (SELECT * FROM links WHERE src <> dst),
counts AS (SELECT neuron, count(*) AS n FROM kept GROUP BY neuron),
staked AS (
  SELECT k.*, k.amount + coalesce(w.will, 0) // c.n AS attention, coalesce(ka.kappa, 1.0) AS kappa,
         coalesce(w.will, 0) // c.n AS share
  FROM kept k JOIN counts c ON k.neuron = c.neuron
  LEFT JOIN will w ON k.neuron = w.neuron LEFT JOIN karma ka ON k.neuron = ka.neuron),
top AS (SELECT greatest(max(attention), 1) AS m FROM staked),
eff AS (
  SELECT * FROM (SELECT s.*, CAST(attention AS DOUBLE) / m AS stake,
         CAST(attention AS DOUBLE) / m * kappa * least(1, greatest(0, price)) AS w
         FROM staked s, top) WHERE w > 0)
"""
ALL = "links karma will"


def context(d):
    return W.Context(karma=d.karma, will=d.will)


def effective(d):
    return W.effective_links(d.links, context(d))


@query("content_address", "SELECT doc_id AS pos, sha256(text) AS particle FROM documents")
def _(d):
    return D.content_address(d.dictionary).select("pos", "particle")


@query("dictionary_verify",
       "SELECT doc_id AS pos FROM documents WHERE length(text) > 0 AND sha256(text) <> "
       "CASE WHEN doc_id % 7 = 0 THEN sha256(lang) ELSE sha256(text) END")
def _(d):
    docs = d.table("documents")
    key = F.when(F.col("doc_id") % 7 == 0, D.content_id("lang")).otherwise(D.content_id("text"))
    entries = docs.select(F.col("doc_id").alias("pos"), F.col("text").alias("data"), key.alias("particle"))
    return D.verify_dictionary(entries).select("pos")


@query("dictionary_lookup",
       "SELECT l.doc_id, length(d.text) AS chars FROM labels l "
       "LEFT JOIN documents d ON d.doc_id = l.doc_id AND length(d.text) > 0")
def _(d):
    entries = d.table("documents").select(F.col("doc_id").alias("particle"), F.col("text").alias("data"))
    keys = d.table("labels").select(F.col("doc_id").alias("particle"))
    return D.lookup(keys, entries).select(
        F.col("particle").alias("doc_id"), F.length("data").cast("bigint").alias("chars")
    )


@query("dictionary_compose", """
WITH hashed AS (SELECT doc_id AS pos, sha256(text) AS particle, source, lang FROM documents),
stacked AS (SELECT particle, pos, 0 AS dict_no FROM hashed WHERE lang = 'en'
            UNION ALL SELECT particle, pos, 1 FROM hashed
            UNION ALL SELECT DISTINCT p, 0, 2 FROM (
              SELECT CAST(src AS VARCHAR) AS p FROM links UNION ALL SELECT CAST(dst AS VARCHAR) FROM links
              UNION ALL SELECT sha256(CAST(src AS VARCHAR) || '|' || CAST(dst AS VARCHAR)) FROM links)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY particle ORDER BY dict_no, pos) AS rn FROM stacked)
SELECT particle, dict_no, pos FROM ranked WHERE rn = 1""", "links")
def _(d):
    docs = d.table("documents").select(
        F.col("doc_id").alias("pos"), D.content_id("text").alias("particle"),
        F.col("text").alias("data"), "lang",
    )
    return D.compose([docs.where("lang = 'en'"), docs], d.links).select("particle", "dict_no", "pos")


@query("drop_self_loops", "SELECT count(*) AS kept, CAST(sum(amount) AS BIGINT) AS amount FROM links WHERE src <> dst", "links")
def _(d):
    return W.drop_self_loops(d.links).agg(F.count("*").alias("kept"), F.sum("amount").alias("amount"))


@query("attention", f"WITH {EFFECTIVE} SELECT neuron, src, dst, amount, share, attention FROM staked", ALL)
def _(d):
    return W.with_attention(W.drop_self_loops(d.links), d.will).select(
        "neuron", "src", "dst", "amount", "share", "attention")


@query("normalized_stake", f"WITH {EFFECTIVE} SELECT neuron, src, dst, amount, "
       "round(CAST(attention AS DOUBLE) / m, 9) AS stake FROM staked, top", ALL)
def _(d):
    return W.with_stake(W.drop_self_loops(d.links), context(d)).select(
        "neuron", "src", "dst", "amount", r("stake"))


@query("effective_links", f"WITH {EFFECTIVE} SELECT neuron, src, dst, round(w, 9) AS w FROM eff", ALL)
def _(d):
    return effective(d).select("neuron", "src", "dst", r("w"))


@query("signed_stake", "SELECT src, dst, CASE valence WHEN 1 THEN amount WHEN -1 THEN -amount ELSE 0 END AS stake FROM links", "links")
def _(d):
    return d.links.select("src", "dst", C.signed_stake("valence", "amount").alias("stake"))


@query("effective_links_by_token", """
WITH kept AS (SELECT l.*, amount * rho AS scaled FROM links l JOIN token_weights t ON l.token = t.token WHERE src <> dst),
counted AS (SELECT neuron, count(*) AS n FROM kept GROUP BY neuron),
priced AS (SELECT k.neuron, k.src, k.dst, scaled + coalesce(will, 0) // n AS attention, coalesce(kappa, 1) AS kappa,
                  CASE WHEN k.src < k.dst THEN greatest(0, least(1, k.price)) ELSE 0.5 END AS price
           FROM kept k JOIN counted USING (neuron) LEFT JOIN will USING (neuron) LEFT JOIN karma USING (neuron))
SELECT neuron, src, dst, round(attention / (SELECT max(attention) FROM priced) * kappa * price, 9) AS w FROM priced
WHERE attention * kappa * price > 0""", "links karma will token_weights")
def _(d):
    ctx = context(d)
    ctx.tokens = d.token_weights
    ctx.prices = d.links.where("src > dst").select("src", "dst", F.lit(0.5).alias("price")).distinct()
    return W.effective_links(d.links, ctx).select("neuron", "src", "dst", r("w"))


@query("token_weights", "SELECT src, dst, l.token, amount * rho AS weighted FROM links l JOIN token_weights t ON l.token = t.token", "links token_weights")
def _(d):
    return W.apply_token_weights(d.links, d.token_weights).select(
        "src", "dst", "token", (F.col("amount") * F.col("rho")).alias("weighted"))


@query("market_inhibition", "SELECT src, dst, round(amount * (1 - 0.6 * (1 - least(1, greatest(0, price)))), 4) AS inhibited, "
       "round(amount * least(1, greatest(0, price)), 4) AS priced FROM links", "links")
def _(d):
    return d.links.select(
        "src", "dst", r(C.inhibited("amount", 1 - F.col("price"), 0.6), 4).alias("inhibited"),
        r(C.price_weighted("amount", "price"), 4).alias("priced"))


@query("active_links", "SELECT neuron, CAST(sum(amount) AS BIGINT) AS active FROM links WHERE valence <> 0 GROUP BY neuron", "links")
def _(d):
    return W.active(d.links).groupBy("neuron").agg(F.sum("amount").alias("active"))


@query("prefix_resolve", """
WITH n AS (SELECT DISTINCT sha256(CAST(src AS VARCHAR) || '|' || CAST(dst AS VARCHAR)) AS id FROM links),
first AS (SELECT min(id) AS m FROM n)
SELECT id FROM n, first WHERE starts_with(id, substr(m, 1, 24))""", "links")
def _(d):
    from linktide.operators.measures import resolve_prefix
    ids = d.links.select(C.pair_id("src", "dst").alias("id"))
    prefix = ids.agg(F.min("id")).first()[0][:24]
    return resolve_prefix(ids, prefix)


@query("pair_ids", "SELECT DISTINCT src, dst, sha256(CAST(src AS VARCHAR) || '|' || CAST(dst AS VARCHAR)) AS axon FROM links", "links")
def _(d):
    return d.links.select("src", "dst", C.pair_id("src", "dst").alias("axon")).distinct()


@query("quantize", """
WITH codes AS (SELECT src, dst, price, amount / 1000.0 AS big FROM links)
SELECT src, dst, CAST(greatest(-32768, least(32767, round(big * 256))) AS INTEGER) AS small_code,
       CAST(greatest(-2147483648, least(2147483647, round(price * 65536))) AS INTEGER) AS wide_code,
       greatest(-2147483648, least(2147483647, round(price * 65536))) / 65536.0 AS back FROM codes""", "links")
def _(d):
    big = F.array(F.col("amount").cast("double") / 1000.0)
    price = F.array("price")
    wide = C.quantize(price, "u32")
    return d.links.select(
        "src", "dst", C.quantize(big, "u16")[0].alias("small_code"), wide[0].alias("wide_code"),
        C.dequantize(wide, "u32")[0].alias("back"))


ADJ = f"WITH {EFFECTIVE}, adj AS (SELECT src, dst, sum(w) AS w FROM eff GROUP BY src, dst) "


@query("adjacency", ADJ + "SELECT src, dst, round(w, 9) AS w FROM adj", ALL)
def _(d):
    return G.adjacency(effective(d)).select("src", "dst", r("w"))


NODES = """, node AS (SELECT id, sum(o) AS out, sum(w) AS degree FROM (
  SELECT src AS id, w AS o, w FROM adj UNION ALL SELECT dst, 0.0, w FROM adj) GROUP BY id) """


@query("out_strength", ADJ + NODES + "SELECT id, round(out, 9) AS out, out = 0 AS dangling FROM node", ALL)
def _(d):
    return G.out_strength(G.adjacency(effective(d))).select("id", r("out"), "dangling")


@query("transition", ADJ + "SELECT dst AS row, a.src AS col, round(w / o, 9) AS p FROM adj a JOIN "
       "(SELECT src, sum(w) AS o FROM adj GROUP BY src) s ON a.src = s.src", ALL)
def _(d):
    return G.transition(G.adjacency(effective(d))).select("row", "col", r("p"))


@query("symmetric_weights", ADJ + "SELECT row, col, round(sum(w), 9) AS w FROM (SELECT src AS row, dst AS col, w FROM adj "
       "UNION ALL SELECT dst, src, w FROM adj) GROUP BY row, col", ALL)
def _(d):
    return G.symmetrize(G.adjacency(effective(d))).select("row", "col", r("w"))


@query("degree", ADJ + NODES + "SELECT id, round(degree, 9) AS degree FROM node", ALL)
def _(d):
    return G.degree(G.adjacency(effective(d))).select("id", r("degree"))


@query("teleport_prior", ADJ + NODES + "SELECT id, round(degree / (SELECT sum(degree) FROM node), 9) AS prior FROM node", ALL)
def _(d):
    return G.teleport(G.adjacency(effective(d))).select("id", r("prior"))


SPOTS = """
ordered AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
            l_extendedprice, l_shipdate) AS o FROM links),
spots AS (SELECT o, 0 AS slot, CAST(src AS VARCHAR) AS id FROM ordered
  UNION ALL SELECT o, 1, CAST(dst AS VARCHAR) FROM ordered
  UNION ALL SELECT o, 2, sha256(CAST(src AS VARCHAR) || '|' || CAST(dst AS VARCHAR)) FROM ordered),
firsts AS (SELECT id, min(o * 3 + slot) AS f FROM spots GROUP BY id),
idx AS (SELECT id, row_number() OVER (ORDER BY f) - 1 AS index FROM firsts)
"""


@query("particle_index", f"WITH {SPOTS} SELECT id, index FROM idx", "links")
def _(d):
    return G.particle_index(d.links, ORDER)


@query("resolved_edges", f"""WITH {SPOTS}
SELECT a.index AS src, b.index AS dst, c.index AS axon,
       CASE valence WHEN 1 THEN amount WHEN -1 THEN -amount ELSE 0 END AS stake, valence
FROM links l JOIN idx a ON a.id = CAST(l.src AS VARCHAR) JOIN idx b ON b.id = CAST(l.dst AS VARCHAR)
JOIN idx c ON c.id = sha256(CAST(l.src AS VARCHAR) || '|' || CAST(l.dst AS VARCHAR))""", "links")
def _(d):
    return G.resolve_edges(d.links, G.particle_index(d.links, ORDER))


@query("positive_adjacency", "SELECT src, dst, CAST(sum(amount) AS BIGINT) AS stake FROM links WHERE valence = 1 AND amount > 0 GROUP BY src, dst", "links")
def _(d):
    return G.positive_adjacency(d.links)


@query("axon_weights", """
SELECT least(src, dst) AS low, greatest(src, dst) AS high,
       sum(CASE WHEN src <= dst THEN amount * rho ELSE 0 END) AS weight_forward,
       sum(CASE WHEN src <= dst THEN 0 ELSE amount * rho END) AS weight_backward,
       sum(amount * rho * valence * CASE WHEN src = dst THEN 0 WHEN src < dst THEN 1 ELSE -1 END) AS consensus
FROM links l JOIN token_weights t ON l.token = t.token GROUP BY 1, 2""", "links token_weights")
def _(d):
    return G.axon_weights(W.apply_token_weights(d.links, d.token_weights))


@query("graded_adjacency", """
SELECT src, dst, round(sum(amount * coalesce(kappa, 1.0) * least(1, greatest(0, price))), 3) AS grade0,
       round(sum(amount * coalesce(kappa, 1.0) * abs(2 * least(1, greatest(0, price)) - 1) * sign(valence)), 3) AS grade2
FROM links l LEFT JOIN karma k ON l.neuron = k.neuron GROUP BY src, dst""", "links karma")
def _(d):
    return G.graded_adjacency(d.links, d.karma).select("src", "dst", r("grade0", 3), r("grade2", 3))


WALK = "SELECT src, dst, w * value AS wt FROM adjacency JOIN node_values ON dst = id"


@query("token_walk", f"WITH v AS ({WALK}) SELECT src, dst, round(wt / sum(wt) OVER (PARTITION BY src), 9) AS p FROM v", "adjacency node_values")
def _(d):
    return G.token_walk(d.adjacency, d.node_values).select("src", "dst", r("p"))


@query("influence", f"WITH v AS ({WALK}) SELECT dst AS id, round(sum(wt) / (SELECT sum(wt) FROM v), 9) AS influence FROM v GROUP BY dst", "adjacency node_values")
def _(d):
    return G.influence(d.adjacency, d.node_values).select("id", r("influence"))
