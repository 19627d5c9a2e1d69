"""Exact and near copies against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from linktide.llm import exact, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACES = " \t\n\x0b\f\r"


def make(spark, rows, schema=SCHEMA):
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, schema)


def plain(text):
    return "".join(c for c in text or "" if c not in SPACES)


def test_exact_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["a b", "ab", " a\tb\n", "", None, " \n", "é x", "éx", "long " * 9000, "long  " * 9000, "a b"]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(None, "ab"), (7, "ab"), (7, "ab"), (None, None)]
    got = exact.mark_copies(make(spark, rows), support=1 / 8).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in got:
        groups[plain(r.text)].append(r)
    for members in groups.values():
        best = min((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in members)
        assert [r.kept for r in members].count(True) == 1
        stay = next(r for r in members if r.kept)
        assert (-len(stay.text or ""), stay.doc_id is None, stay.doc_id or 0) == best
        assert {r.keep_id for r in members} == {stay.doc_id}
        assert {r.group_size for r in members} == {len(members)}
        assert len({r.text_sha256 for r in members}) == 1
    assert len({r.text_sha256 for r in got}) == len(groups)


def test_exact_hot_group_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"),
        F.lit("mine").alias("kept"), F.lit(1).alias("Other"),
    )
    marked = exact.mark_copies(docs, support=1 / 64)
    assert marked.columns.count("kept") == 1 and dict(marked.dtypes)["kept"] == "boolean"
    assert marked.where("kept").count() == 2001
    assert marked.where("group_size = 1000 and keep_id = 0").count() == 1000
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    kept = exact.deduplicate(docs.drop("kept"))
    assert kept.columns == ["doc_id", "text", "Other"] and kept.count() == 2001


def test_empty_tables(spark):
    none = make(spark, [])
    assert exact.mark_copies(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).columns == none.columns


def brute_print(text):
    words = [w for w in _split(text or "") if w]
    lower = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not lower:
        return 0
    grams = [" ".join(lower[i : i + 4]) for i in range(max(1, len(lower) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    word, out = "", []
    for c in text:
        if c in SPACES:
            out.append(word)
            word = ""
        else:
            word += c
    return [*out, word]


def test_fingerprints(spark):
    rng = random.Random(5)
    vocab = ["Alpha", "béta", "GAMMA", "Ünder", "x y", "delta.", "\x1c"]
    for n in (0, 1, 3, 4, 5, 50):
        text = rng.choice(SPACES).join(rng.choice(vocab) for _ in range(n))
        assert simhash.simhash(text.encode()) == brute_print(text)
    assert simhash.simhash(None) == 0
    long = " ".join(rng.choice(vocab) for _ in range(70_000))
    assert simhash.simhash(long.encode()) == brute_print(long)


def brute_classes(prints):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("chunk", [65_536, 20])
def test_links_lose_nothing(spark, chunk):
    rng = random.Random(chunk)
    prints = [rng.getrandbits(64) for _ in range(120)]
    for center in prints[:4]:  # a chain, and dense groups around a center
        here = center
        for _ in range(60):
            here ^= sum(1 << b for b in rng.sample(range(64), 4))
            prints.append(here)
            prints.append(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = brute_classes(prints)
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id bigint, fp bigint")
    got = {r.fp & (1 << 64) - 1: r.component_id for r in simhash.near_classes(df, chunk=chunk).collect()}
    least = defaultdict(lambda: 10**9)
    for i, p in enumerate(prints):
        least[want[p]] = min(least[want[p]], i)
    assert got == {p: least[want[p]] for p in set(prints)}


def test_masks_cover_all_pairs():
    rng = random.Random(1)
    for rows in (3, 1 << 20, 1 << 30):
        masks = simhash.block_masks(rows)
        assert min(m.bit_count() for m in masks) >= rows.bit_length()
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << i for i in rng.sample(range(64), 4))
            assert any(a & m == b & m for m in masks)


def test_near_duplicates_of_documents(spark):
    rng = random.Random(9)
    base = " ".join(rng.choice(["one", "two", "three", "four", "five", "six"]) + str(rng.randint(0, 99)) for _ in range(400))
    other = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(300))
    rows = [(5, base), (2, base.upper()), (9, base + " end"), (4, other), (None, other), (1, None), (3, ""), (8, " \n")]
    docs = make(spark, rows)
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert Counter(found) == Counter(
        [(5, 2), (2, 2), (9, 2), (4, 4), (None, 4), (1, 1), (3, 1), (8, 1)]
    )
    stay = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(map(str, stay)) == ["1", "2", "4", "None"]
    again = simhash.one_of_each(make(spark, [*rows, (2, base.upper()), (2, base.upper())]))
    assert [r.doc_id for r in again.collect()].count(2) == 1 and again.columns == docs.columns


def test_forest_joins_what_pairs_join():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 10, 300).astype(np.int64)
    prints = np.unique(prints * 3)
    left, right = simhash._forest(prints, 2)
    root = {int(p): int(p) for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(left, right):
        root[find(a)] = find(b)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if int(a ^ b).bit_count() <= 2:
                assert find(int(a)) == find(int(b))
