"""Merkle manifest of a dataset: leaves, group subtrees, root, proofs and their check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.llm.common import others
from linktide.operators.keyed import attach
from linktide.operators.ordering import numbered
from linktide.session import settle

ARITY = 8


def leaf_of(columns: Sequence[str], changed: Mapping[str, Column] | None = None) -> Column:
    """SHA-256 (hex) of the fields in order, each ``-`` if null, else bytes ``:`` value.

    ``changed`` replaces the value of some columns.
    """
    parts = []
    for name in columns:
        value = (changed or {}).get(name, F.col(name)).cast("string")
        size = F.octet_length(value).cast("string")
        parts.append(F.coalesce(F.concat(size, F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _hex(column: str | Column) -> Column:
    return F.lower(F.hex(column))


def _joined(digests: Column) -> Column:
    """Hex texts of an array of digests, one after the other."""
    return F.array_join(F.transform(digests, _hex), "")


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes of one level, each with the digests of its run, its own included.

    A node computes the index at every slot offset of its run (offset 0 is itself)
    and an equijoin fetches the node there: the runs of ``nodes(tree, at, n, digest)``
    are read by keys that are all distinct, so no key is hot.
    """
    first = F.col("at") - F.col("at") % arity
    places = F.transform(
        F.sequence(F.lit(0), F.lit(arity - 1)), lambda k: first + (F.col("at") % arity + k) % arity
    )
    asked = nodes.select(
        "tree", "at", "n", F.explode(F.filter(places, lambda p: p < F.col("n"))).alias("place")
    )
    there = nodes.select("tree", F.col("at").alias("place"), "digest")
    met = asked.join(there, ["tree", "place"])
    run = F.sort_array(F.collect_list(F.struct("place", "digest")))
    return met.groupBy("tree", "at", "n").agg(run.alias("run")).select(
        "tree", "at", "n", F.transform("run", lambda s: s["digest"]).alias("run")
    )


def _parents(runs: DataFrame, arity: int) -> DataFrame:
    """The next level: the first node of every run emits the digest of the run."""
    return runs.where(F.col("at") % arity == 0).select(
        "tree",
        F.expr(f"at div {arity}").alias("at"),
        F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
        F.unhex(F.sha2(_joined(F.col("run")), 256)).alias("digest"),
    )


def _climb(nodes: DataFrame, largest: int, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs of every level with an open tree, and the nodes of every level, tops last."""
    levels, runs = [nodes], []
    while largest > 1:
        runs.append(settle(_runs(levels[-1].where("n > 1"), arity)))
        levels.append(_parents(runs[-1], arity))
        largest = -(-largest // arity)
    return runs, levels


def _descend(
    runs: list[DataFrame], levels: list[DataFrame], tops: DataFrame, arity: int, rows: DataFrame
) -> DataFrame:
    """``rows(tree, at, ...)`` of the first level with what ``tops(tree, at, path, ...)`` say of
    the last node of their tree.

    A path gains the slot and the run of a level at its front. Rows meet their run
    before they meet the path of the node above, so long paths are only shuffled once
    per run.
    """
    known = [c for c in tops.columns if c not in ("tree", "at", "path")]
    more = [c for c in rows.columns if c not in ("tree", "at", "n")]
    below = None
    for level in range(len(levels) - 1, -1, -1):
        kept = more if level == 0 else []
        ended = (rows if level == 0 else levels[level]).where("n = 1").select("tree", "at", *kept)
        ended = ended.join(tops, ["tree", "at"]).select("tree", "at", "path", *known, *kept)
        if below is not None:
            step = F.struct((F.col("at") % arity).cast("int").alias("slot"), F.col("run"))
            here = runs[level].select("tree", "at", F.array(step).alias("piece"))
            if level == 0:
                here = here.join(rows.select("tree", "at", *more), ["tree", "at"])
            here = here.withColumn("up", F.expr(f"at div {arity}"))
            over = below.withColumnRenamed("at", "up")
            ended = ended.unionByName(
                here.join(over, ["tree", "up"]).select(
                    "tree", "at", F.concat("piece", "path").alias("path"), *known, *kept
                )
            )
        below = ended
    return below


def _sides(path: Column) -> Column:
    """Hex texts to the left and to the right of every step of a path."""
    return F.transform(
        path,
        lambda s: F.struct(
            _joined(F.slice(s["run"], F.lit(1), s["slot"])).alias("left"),
            _joined(F.slice(s["run"], s["slot"] + 2, F.size(s["run"]))).alias("right"),
        ),
    )


def manifest(
    leaves: DataFrame, by: str = "lang", order: str = "doc_id", arity: int = ARITY
) -> DataFrame:
    """Every row of ``leaves`` with ``subroot, root, path``.

    ``leaves`` has a column ``leaf`` (hex digest). Per value of ``by`` (null is a
    group of its own) leaves ascend by ``order`` (null first, then by digest, so
    that repeated ids have one order; equal rows are interchangeable). While a tree
    has several nodes, every ``arity`` consecutive ones become the digest of their
    hex texts, also a last run of one. What remains is the subroot (a lone leaf is
    its own). Subroots, ordered by group with null first, give the root likewise.
    ``path`` lists per level, from the leaf through the subroot to the root, the
    joined hex texts of the siblings to the left and to the right. An empty table
    gives an empty result.

    A level is one equijoin of nodes with the computed indices of their siblings and
    one grouping, so every level shuffles an eighth of the one before; paths come
    down by one join a level. Nothing is collected but the size of the largest tree.
    """
    given = others(leaves, "subroot", "root", "path")
    leaves = settle(leaves.select(
        F.struct(*given).alias("row"), F.col(order).alias("__order"), F.unhex("leaf").alias("__digest"),
        F.col(by).alias("__by")))
    placed = settle(numbered(leaves, ["__by", "__order", "__digest"], "__number"))
    groups = placed.groupBy("__by").agg(F.min("__number").alias("__start"), F.count(F.lit(1)).alias("__n"))
    groups = settle(numbered(groups, ["__start"], "__tree"))
    starts = groups.select(F.coalesce("__by", F.lit("")).alias("__key"), F.isnull("__by").alias("__none"),
                           "__start", "__n", "__tree")
    keyed = placed.select("*", F.coalesce("__by", F.lit("")).alias("__key"), F.isnull("__by").alias("__none"))
    placed = settle(
        attach(keyed, starts, ["__key", "__none"], "inner").select(
            "row", "__digest", F.col("__tree").alias("tree"), (F.col("__number") - F.col("__start")).alias("at"),
            F.col("__n").alias("n"))
    )
    trees, largest = groups.agg(F.count(F.lit(1)), F.max("__n")).first()
    nodes = placed.select("tree", "at", "n", F.col("__digest").alias("digest"))
    runs, levels = _climb(nodes, largest or 0, arity)

    subroots = levels[-1].where("n = 1").select("tree", "digest")
    for level in levels[:-1]:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "digest"))
    subroots = settle(subroots)
    tops = subroots.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("bigint").alias("n"),
        "digest")
    top_runs, top_levels = _climb(tops, trees, arity)
    root = top_levels[-1].where("n = 1").select(
        "tree", "at", F.expr("cast(array() AS array<struct<slot: int, run: array<binary>>>)").alias("path"),
        _hex("digest").alias("root"))
    down = _descend(top_runs, top_levels, root, arity, tops.select("tree", "at", "n"))
    down = down.select(F.col("at").alias("tree"), F.lit(0).cast("bigint").alias("at"), "path", "root")
    down = settle(down.join(subroots.select("tree", _hex("digest").alias("subroot")), "tree"))
    found = _descend(runs, levels, down, arity, placed.drop("__digest"))
    return found.select("row.*", "subroot", "root", _sides(F.col("path")).alias("path"))


def proof_digest(path: str | Column = "path") -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    pieces = F.transform(path, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(pieces, ""), 256)


def folded(leaf: str | Column, path: str | Column = "path") -> Column:
    """The root that a leaf and a path of siblings lead to."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(
        path, start, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256)
    )
