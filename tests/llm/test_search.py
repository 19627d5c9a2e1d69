"""Ranked search and linked vectors against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linktide.llm import quantised, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute_ranks(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    size, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 100 - 50 + 50 * c.total() * size // length
            score = sum(
                math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) & c.keys()
            )
            if score:
                scored.append((-score, d is None, d or 0))
        for i, (score, none, d) in enumerate(sorted(scored)[:k]):
            out.append((item, i + 1, None if none else d, -score))
    return Counter(out)


@pytest.mark.parametrize("seed,batch,k,most", [(0, 10_000, 50, 200_000), (1, 37, 5, 40), (2, 11, 50, 200_000)])
def test_ranked_search(spark, monkeypatch, seed, batch, k, most):
    monkeypatch.setattr(ranked, "WAVE", 3)
    monkeypatch.setattr(ranked, "PASS_TERMS", most)
    monkeypatch.setattr(ranked, "CHUNK_BYTES", 2000)
    rng = random.Random(seed)
    words = ["The", "of", "Éclair", "straße", "\U0001f600x", "a1", "İ"] + [f"w{i}" for i in range(60)]
    heavy = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return "".join(w + rng.choice([" ", "-", "\n", "\x00", "_", ".."]) for w in rng.choices(words, heavy, k=n))

    docs = [(i, text(rng.choice([0, 1, 5, 40]))) for i in range(400)]
    docs += [(7, docs[7][1])] * 3 + [(None, "the of w3")] * 2 + [(900, None), (901, ""), (902, " .. "), (903, text(9000))]
    docs += [(1000 + i, "w5 w6 the") for i in range(60)]  # a large tie
    items = [(i, text(rng.choice([1, 8, 30]))) for i in range(25)]
    items += [(3, "w1 w2"), (None, "of"), (77, None), (78, "??"), (79, "nowhere"), (80, "the")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("Score", F.lit(1))
        got = ranked.search(d.repartition(3), spark.createDataFrame(items, "item_id int, text string"), k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == brute_ranks(docs, items, k)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranked_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranked.search(none, items).count() == 0
    assert ranked.search(some, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked.search(some, items).collect()] == [(1, 1, 1)]


def test_pair_bounds_skip_more_than_single_ones():
    """Two frequent terms that never meet: together they reach what one reaches."""
    table = pa.table({
        "block": [0] * 4, "a": pa.array([-1, 0, 1, 2], pa.int32()), "b": pa.array([-1] * 4, pa.int32()),
        "top": [0, 10, 10, 15], "docs": pa.array([[], [0, 1], [2, 3], [4]], pa.list_(pa.int32())),
        "impacts": pa.array([[5, 6, 7, 8, 9], [10, 9], [10, 9], [15]], pa.list_(pa.int64())),
    })
    block = ranked._Block(table)
    assert block.best([(0, 1), (2, -1)], 1, 26)[0].size == 0  # 10 + 15 < 26 <= 10 + 10 + 15
    slots, scores = block.best([(0, 1), (2, -1)], 1, 15)
    assert (slots.tolist(), scores.tolist()) == ([4], [15])


def brute_links(rows):
    def fine(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if fine(v, lab) else None
            for _, v, lab in rows]
    up, links = list(range(n)), [0] * n

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    up[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    out = [(rows[i][0], links[i], low.get(find(i)), rows[i][0] == low.get(find(i))) for i in range(n)]
    return sorted(out, key=str)


def vectors(seed, width=12):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (1, 2, 3):
        for _ in range(60):
            v = rng.normal(size=width)
            for _ in range(rng.integers(1, 4)):
                rows.append((v + rng.normal(size=width) * rng.choice([0.02, 0.2]), label))
        chain = rng.normal(size=width)
        for i in range(12):  # neighbours link, ends do not
            rows.append((chain + i * 0.5 * np.eye(width)[0], label))
    hot = rng.normal(size=width)
    rows += [(hot + rng.normal(size=width) * 0.05, 1) for _ in range(150)]  # a dense group
    rows += [(hot, 1)] * 80 + [(hot * 3, 1)] * 5  # copies, and the same direction
    rows = [(i + 1000, [float(x) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    rng.shuffle(rows)
    one = [1.0] * width
    return rows + [
        (1, None, 1), (2, [], 1), (3, [0.0] * width, 1), (4, [float("nan")] + one[1:], 1), (5, [float("inf")] + one[1:], 1),
        (6, [None] + one[1:], 1), (7, one, None), (8, one, 2), (9, one[:-1], 2), (10, one[:-1], 2), (8, one, 2), (None, one, 2),
        (11, [-0.0, 1.0] + [0.0] * (width - 2), 3), (12, [0.0, 1.0] + [0.0] * (width - 2), 3), (13, [1e-30] * width, 3),
        (14, [1e30] * width, 3), (None, [5.0] + [0.0] * (width - 1), 2),
    ]


@pytest.mark.parametrize("options", [{}, {"lists": 6, "chunk": 40, "sample": 30}, {"lists": 1, "chunk": 100_000}])
def test_linked_vectors(spark, options):
    rows = vectors(len(options))
    rows = [(i, v, lab) for i, v, lab in ((i if i is None else int(i), v, lab if lab is None else int(lab)) for i, v, lab in rows)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = quantised.linked_vectors(df.withColumn("Kept", F.lit("mine")).withColumn("key", F.lit(1)), **options)
    assert got.columns == ["vec_id", "embedding", "label", "key", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=str) == brute_links(rows)


def test_linked_vectors_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert quantised.linked_vectors(none).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(tuple(r)[3:] for r in quantised.linked_vectors(odd).collect()) == [(0, 1, True), (0, 2, True)]


def test_recall_on_the_given_vectors(spark):
    """Every pair of a full comparison is found, for a sample much smaller than the table."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in df.collect()]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    want = dict(zip((r[0] for r in rows), (near.sum(1) - 1).tolist()))
    got = quantised.linked_vectors(df, sample=200, lists=16)
    assert {r.vec_id: r.n_links for r in got.collect()} == want
