"""Dense index and resolved links: what is shuffled, and ids that are content ids themselves."""

import hashlib

from pyspark.sql import functions as F

from linktide.operators.graph import particle_index, resolve_edges
from linktide.operators.ordering import numbered


def digest(a, b):
    return hashlib.sha256(f"{a}|{b}".encode()).hexdigest()


def indexed(rows, seed=()):
    """By hand: the seed, then source, target and pair of every link in order."""
    found = {}
    for i in [*seed, *[i for a, b, _, _, _ in rows for i in (a, b, digest(a, b))]]:
        found.setdefault(str(i), len(found))
    return found


def check(spark, rows, kind, seed=None):
    links = spark.createDataFrame(rows, f"src {kind}, dst {kind}, ord int, amount bigint, valence int")
    given = None if seed is None else spark.createDataFrame(list(enumerate(seed)), "pos int, id string")
    index = particle_index(links.repartition(3), ["ord"], given)
    want = indexed(rows, seed or ())
    assert dict(index.collect()) == want
    found = resolve_edges(links, index, ["ord"]).collect()
    assert sorted((r.ord, r.src, r.dst, r.axon) for r in found) == sorted(
        (o, want[str(a)], want[str(b)], want[digest(a, b)]) for a, b, o, _, _ in rows)


def test_numbers_and_texts(spark):
    check(spark, [(3, 4, 0, 5, 1), (4, 3, 1, 5, -1), (3, 4, 2, 1, 0), (7, 7, 3, 2, 1)], "bigint")
    inner = digest("a", "b")
    texts = [("a", "b", 0, 5, 1), (inner, "é", 1, 5, 1), (inner.upper(), "", 2, 5, 1), ("a|b", "c", 3, 1, 1), ("a", "b|c", 4, 1, 1)]
    check(spark, texts, "string")
    check(spark, texts, "string", ["z", inner, "c"])


def test_numbering_has_no_window_over_the_rows(spark):
    rows = spark.range(0, 1000, 1, 5).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("x"))
    out = numbered(rows, ["k"])
    assert sorted((r.k, r.position) for r in out.collect()) == [(i, i) for i in range(1000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "partitionBy" not in plan and plan.count("Window") <= 1 and "row_number" not in plan
    # the rows themselves are below no window: their side of the last join is read as it was frozen
    scans = [line for line in plan.splitlines() if "LogicalRDD" in line]
    assert len(scans) == 2
    assert numbered(rows, ["k"], "n", ["x"]).columns == ["x", "n"]
