"""Near copies at Jaccard 0.8 of five-word shingles against brute force."""

import random
from collections import defaultdict

import pytest

from linktide.llm import shingles, simhash

SCHEMA = "doc_id bigint, text string, lang string"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def sample(seed):
    """Copies with single words replaced, from near-equal to well below the bound."""
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 300))]
        rows.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = "new"
            rows.append(" ".join(copy).replace("w1", "W1"))
    rows += ["", None, " \n", "one", "One", "one two"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("chunk", [1024, 2])
def test_against_brute_force(spark, chunk):
    rows = sample(chunk)
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)
    want, groups = defaultdict(set), defaultdict(set)
    for (i, _), c in zip(rows, brute(rows)):
        want[c].add(i)
    for r in shingles.near_duplicates(docs, chunk=chunk).collect():
        groups[r.root].add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    if chunk == 1024:
        stay = shingles.one_of_each(docs)
        assert stay.columns == docs.columns
        assert sorted(r.doc_id for r in stay.collect()) == sorted(min(g) for g in want.values())


def test_stage_links_what_four_bits_do_not(spark):
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for i in range(20):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        copy = list(base)
        for at in rng.sample(range(5, 195, 10), 4):
            copy[at] = "new"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        assert len(grams(rows[-1][1]) & grams(rows[-2][1])) / len(grams(rows[-1][1]) | grams(rows[-2][1])) >= 0.8
    prints = [simhash.simhash(t.encode()) for _, t in rows]
    assert sum((a ^ b).bit_count() > 4 for a, b in zip(prints[::2], prints[1::2])) > 5
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == list(range(0, 40, 2))


def test_repeated_ids_and_missing_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (7, a + " end"), (5, b), (3, b + " end"), (None, a), (3, b + " end")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)
    stay = sorted((str(r.doc_id), r.text) for r in shingles.one_of_each(docs).collect())
    assert stay == sorted([("5", a), ("3", b + " end"), ("None", a)])


def test_pipeline_links_fingerprints_too(spark):
    """Pairs within four bits of SimHash are near copies, whatever their shingles; groups of both kinds grow together."""
    import corpus_pipeline

    near = lambda a, b: (simhash.simhash(a.encode()) ^ simhash.simhash(b.encode())).bit_count()
    base, tail = "one two three four five six seven ", " ".join(f"t{i}" for i in range(40))
    long, turned, short = base * 400 + " ".join(f"s{i}" for i in range(40)), base * 400 + tail, base * 2 + tail
    assert near(long, turned) <= simhash.DISTANCE < near(turned, short) and near(long, short) > simhash.DISTANCE
    sets = [grams(t) for t in (long, turned, short)]
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1]) and sets[1] == sets[2]
    rows = [(1, long), (2, turned), (3, short), (4, "something else entirely"), (5, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == {1, 4, 5, None}
