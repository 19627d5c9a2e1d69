"""Mixing, shards, packing and url rules on small tables."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linktide.llm import mixing, packing, sharding, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [
        (i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), "en",
         rng.choice(["hot"] * 6 + ["b", "\U0001f600", "z", "\uffff", None]), 0)
        for i in range(n)
    ]
    rows += [(None, "no id here", None, "b", None), (5, None, "en", None, 1), (5, None, "en", None, 1),
             (9, "", "en", "blank", 0), (10, "x " * 30_000, "en", "b", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Reshare the excess until no target is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / open_ for s in names}
        over = {s for s in names if s not in capped and target[s] >= most * sizes[s]}
        if not over or len(over) + len(capped) == len(names):
            return {s: t if sizes[s] else 0.0 for s, t in target.items()}
        capped |= over


def test_mixing(spark):
    docs = corpus(spark, 3000)
    rows = mixing.planned_copies(docs).collect()
    assert len(rows) == 3005
    sizes = Counter()
    for r in rows:
        assert r.size == len((r.text or "").split())
        sizes[r.source] += r.size
    want = brute_targets({**sizes})
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= min(3, int(rate) + 1)
        taken[r.source] += r.copies * r.size
    longest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    for s in sizes:  # rows without an id share the draw of their text
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
    again = {(r.doc_id, r.text): r.copies for r in mixing.planned_copies(docs.orderBy("text")).collect()}
    assert all(again[r.doc_id, r.text] == r.copies for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in rows)


def test_mixing_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], SCHEMA)
    assert [(r.size, r.target, r.copies) for r in mixing.planned_copies(blank).collect()] == [(0, 0.0, 0)] * 2
    clash = corpus(spark, 20).withColumn("target", F.lit("mine")).withColumn("Rate", F.lit(1))
    assert mixing.planned_copies(clash).columns.count("target") == 1


def test_shards(spark):
    docs = corpus(spark, 1000).repartition(7)
    out = sharding.uniform_shards(docs, 40)
    rows = out.collect()
    assert len(rows) == 1005
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(40):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sizes[shard]))
    value = lambda r: (str(r.doc_id), str(r.text), str(r.source))
    assert Counter(map(value, rows)) == Counter(map(value, docs.collect()))
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, rows))


def test_shards_edges(spark):
    assert sharding.uniform_shards(spark.createDataFrame([], SCHEMA), 5).count() == 0
    few = spark.createDataFrame([(1, "a", 7)], "doc_id bigint, text string, slot int")
    rows = sharding.uniform_shards(few, 40).collect()
    assert len(rows) == 1 and rows[0].slot == 0 and rows[0].shard == 0
    same = spark.range(900).select(F.lit(1).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert sorted(Counter(r.shard for r in sharding.uniform_shards(same, 9).collect()).values()) == [100] * 9


def test_matrix_rows_add_up_and_are_uniform():
    counts = np.array([50, 0, 120, 30, 7, 93])
    before = np.concatenate([[0], np.cumsum(counts)])
    sizes = sharding.shard_sizes(300, 7)
    total = np.zeros((6, 7))
    for seed in range(400):
        matrix = np.stack([sharding.matrix_row(before, i, sizes, seed) for i in range(6)])
        assert (matrix.sum(axis=1) == counts).all() and (matrix.sum(axis=0) == sizes).all()
        total += matrix
    expected = np.outer(counts, sizes) / 300
    assert np.abs(total / 400 - expected).max() < 0.6


def test_large_hypergeometric():
    rng = np.random.Generator(np.random.PCG64(1))
    good, bad, sample = 3 * 10**9, 5 * 10**9, 10**9
    draws = np.array([sharding.hypergeometric(rng, good, bad, sample) for _ in range(200)], dtype=float)
    share = good / (good + bad)
    sd = (sample * share * (1 - share) * (good + bad - sample) / (good + bad - 1)) ** 0.5
    assert abs(draws.mean() - sample * share) < 5 * sd / 200**0.5
    assert 0.7 < draws.std() / sd < 1.3
    assert sharding.hypergeometric(rng, 2 * 10**9, 0, 5) == 5
    assert sharding.hypergeometric(rng, 0, 2 * 10**9, 5) == 0


def padding(lengths, edges):
    return sum(min(e for e in edges if e >= x) - x for x in lengths)


def test_bucket_edges_are_optimal():
    rng = random.Random(2)
    for _ in range(40):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
        kinds = sorted(set(lengths))
        counts = [lengths.count(k) for k in kinds]
        for k in (1, 2, 3):
            edges = packing.bucket_edges(kinds, counts, [a * b for a, b in zip(kinds, counts)], k)
            assert edges[-1] == kinds[-1] and len(edges) <= k
            best = min(
                padding(lengths, [*some, kinds[-1]])
                for n in range(k)
                for some in itertools.combinations(kinds[:-1], n)
            )
            assert padding(lengths, edges) == best


def test_packing(spark):
    docs = corpus(spark, 900)
    rows = packing.pack(docs, buckets=5, budget=64).collect()
    assert len(rows) == 905
    batches = {}
    for r in rows:
        assert r.n_tokens == len((r.text or "").split()) <= r.bucket_length
        batches.setdefault((r.bucket, r.batch), []).append(r)
    last = Counter()
    for (bucket, batch), members in batches.items():
        length = members[0].bucket_length
        assert len(members) * length <= 64 or len(members) == 1
        assert sorted(m.slot for m in members) == list(range(len(members)))
        last[bucket] = max(last[bucket], batch)
    for (bucket, batch), members in batches.items():  # only the last batch of a bucket may have room
        if batch < last[bucket]:
            assert len(members) == max(1, 64 // max(1, members[0].bucket_length))
    value = lambda r: (str(r.doc_id), str(r.text))
    assert Counter(map(value, rows)) == Counter(map(value, docs.collect()))
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_bins_are_bounded(spark):
    lengths = spark.range(0, 4_000_000, 997).select(F.col("id").alias("n_tokens"))
    bins = packing.histogram(lengths, exact=64).orderBy("step").collect()
    assert len(bins) < 64 * 20
    assert sum(b["rows"] for b in bins) == lengths.count()
    assert all(a["longest"] < b["longest"] for a, b in zip(bins, bins[1:]))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("org", "/fr/x", "block")]


def brute_verdict(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = "".join(itertools.takewhile(lambda c: c not in "/?#", rest))
    path = "".join(itertools.takewhile(lambda c: c not in "?#", rest[len(host) :]))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h) + len(p), len(h), v == "block", h + p, v)
        for h, p, v in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_url_rules(spark):
    hosts = ["net", "a.net", "Example.NET", "www.example.net", "notexample.com", "x.example.com", "org", "fr.org", "ÄB.org",
             "a.net:80", "", "..net", "net.", "x" * 5000 + ".net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/", "/fr/x/y", "/fr/", "?q=/en/", "#/de/", "/EN/", "/en/ä\n b"]
    urls = [f"{s}{h}{p}" for s in ("http://", "x://") for h in hosts for p in paths]
    urls += [None, "", "no scheme.net/", "://net/", "http://a.net/?u=http://b.org/fr/", "http://net/\n", "a\nb://net/"]
    rows = [(i, u, "mine") for i, u in enumerate(urls + urls[:40] * 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge_urls(pages, rules)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(r.url), r.url
    assert got.count() == len(rows)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_crc_is_of_utf8(spark):
    row = spark.createDataFrame([("é\n",)], "text string").select(F.crc32("text").alias("c")).first()
    assert row.c == zlib.crc32("é\n".encode())
