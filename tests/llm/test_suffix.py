"""Repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linktide.llm import suffix

SCHEMA = "doc_id bigint, text string, lang string"


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = [True] * length
        runs = [i for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1])]
        out.append((sum(covered), len(runs), bytes(b for b, c in zip(t, covered) if not c)))
    return out


def check(spark, rows, length, **options):
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)
    got = suffix.remove_repeats(docs, length, **options).collect()
    want = brute([(t or "").encode() for _, t in rows], length)
    as_rows = lambda i, t, w: (str(i), t, w[0], w[1], hashlib.sha256(w[2]).hexdigest())
    have = Counter(
        as_rows(r.doc_id, r.text, (sum(s["end"] - s["begin"] for s in r.spans), len(r.spans), bytes(r.kept)))
        for r in got
    )
    assert have == Counter(as_rows(i, t, w) for (i, t), w in zip(rows, want))


def sample(seed, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 120))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            parts += [p[a : len(p) - rng.randint(0, 10)], "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"crowd": 0}), (3, {"support": 1 / 20})])
def test_against_brute_force(spark, seed, options):
    rows = sample(seed) + [
        (100, None), (101, ""), (102, "a" * 300), (103, "ab" * 100), (None, "ab" * 100), (None, "null id " * 9),
        (7, "x" + sample(9)[3][1]), (7, "y" + sample(9)[3][1]), (7, "y" + sample(9)[3][1]),
    ]
    check(spark, rows, 24, gram=8, **options)


@pytest.mark.parametrize("crowd", [40, 60, 79, 80, 100])
def test_hot_gram_takes_one_path(spark, monkeypatch, crowd):
    """Windows around one gram that only two texts share; the salts of the gram differ in size."""
    import pyarrow as pa

    monkeypatch.setattr(suffix, "SALTS", 8)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    sides = [(word(8), word(8)) for _ in range(40)]

    def texts(gram):
        return [word(25) + a + gram + b + word(25) for a, b in sides for _ in range(2)]

    def hits(gram, made):
        columns = [pa.array(range(len(made))), pa.array([0] * len(made), pa.int32()), pa.array([t.encode() for t in made])]
        found = suffix._scan(iter([pa.RecordBatch.from_arrays(columns, ["id", "tag", "text"])]), 24, 8)
        return sum(made[r["id"]][r["at"] : r["at"] + 8] == gram for b in found for r in b.to_pylist())

    made = max(((hits(g, t), t) for g in (word(8) for _ in range(60)) for t in [texts(g)]), key=lambda x: x[0])
    assert made[0] >= 75
    check(spark, list(enumerate(made[1])), 24, gram=8, support=1 / 40, crowd=crowd)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 64)
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefgh") for _ in range(900))
    import numpy as np

    def anchors(text):
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2], pa.int32()), pa.array([text])], ["id", "tag", "text"])
        return [r for b in suffix._scan(iter([batch]), 24, 8) for r in b.to_pylist()]

    rows = anchors(body.encode())
    starts = np.concatenate([np.arange(r["at"] - r["back"], r["at"] + r["ahead"] - 24 + 1) for r in rows])
    assert sorted(starts.tolist()) == list(range(900 - 24 + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), max_size=40))
def test_deep_shallow_sorts(strings):
    for shallow in (0, 8, 24):
        order = suffix.deep_shallow(strings, list(range(len(strings))), shallow) if strings else []
        assert [strings[i] for i in order] == sorted(strings)
        assert sorted(order) == list(range(len(strings)))


def test_common_prefix():
    rng = random.Random(8)
    for _ in range(200):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        b = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert suffix._common(a, b) == n


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, kept string, spans int, id int")
    out = suffix.remove_repeats(docs)
    assert out.count() == 0 and sorted(out.columns) == ["doc_id", "id", "kept", "spans", "text"]
    docs = spark.createDataFrame([(1, "q" * 400, 5, "a"), (2, "short", 6, "b")], "doc_id bigint, text string, id int, kg string")
    out = {r.doc_id: r for r in suffix.remove_repeats(docs).collect()}
    assert bytes(out[1].kept) == b"" and bytes(out[2].kept) == b"short" and out[2].id == 6
