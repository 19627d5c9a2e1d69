"""The manifest against a tree built by hand."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from linktide.llm import merkle
from linktide.llm.queries import LEAF, QUERIES, op13_merkle_manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def digest(row, text):
    return H("".join(field(v) for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(level, arity=8):
    """Root of a list of digests and per position its (left, right) siblings upwards."""
    paths, spots = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, at in enumerate(spots):
            start = at - at % arity
            paths[i].append(("".join(level[start:at]), "".join(level[at + 1 : start + arity])))
            spots[i] = at // arity
        level = [H("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0], paths


def brute(rows):
    if not rows:
        return []
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    subs, found = [], []
    for lang in langs:
        group = sorted(by[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, digest(r, r.text)))
        sub, paths = tree([digest(r, r.text) for r in group])
        subs.append((sub, group, paths))
    root, tops = tree([s[0] for s in subs])
    for (sub, group, paths), top in zip(subs, tops):
        for r, path in zip(group, paths):
            path = path + top
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = digest(r, text)
            for left, right in path:
                fold = H(left + fold + right)
            found.append((r.doc_id, digest(r, r.text), sub, root, H("".join(a + b for a, b in path)), fold, fold == root))
    return sorted(found, key=str)


def judged(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in op13_merkle_manifest(spark, str(folder)).collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_manifest_is_the_tree(spark, tmp_path, seed):
    rng = random.Random(seed)
    langs = ["en"] * 9 + [f"l{i}" for i in range(11)] + [None, "", "é", "\U0001f600", "￿"]
    rows = [(i, rng.choice(["Ab c", "xyz", "É Z", "", None, "LONG " * 9000]), rng.choice(langs), rng.choice(["s", None, ""]),
             rng.choice([None, 3, -7])) for i in range(650)]
    rows += [(None, "No ID", "en", None, 1)] * 2 + [(7, "A", "en", "s", 1), (7, "A", "en", "s", 1), (7, "b", "en", "s", 1)]
    spark_rows = spark.createDataFrame(rows, SCHEMA).collect()
    got = judged(spark, rows, tmp_path / "t")
    assert got == brute(spark_rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_small_trees(spark, tmp_path, n):
    """No rows, a lone leaf, full runs, and a last run of one."""
    rows = [(i, "Text", "en", "s", 1) for i in range(n)]
    assert judged(spark, rows, tmp_path / "t") == brute(spark.createDataFrame(rows, SCHEMA).collect())


def test_binary_tree_and_clashing_columns(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else None) for i in range(37)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    leaves = docs.select("*", merkle.leaf_of(["doc_id", "text"]).alias("leaf"), F.lit("mine").alias("ROOT"), F.lit(1).alias("tree"),
                         F.lit(2).alias("at"), F.lit("x").alias("run"), F.lit("y").alias("row"))
    out = merkle.manifest(leaves, arity=2)
    assert out.columns == ["doc_id", "text", "lang", "leaf", "tree", "at", "run", "row", "subroot", "root", "path"]
    for r in out.collect():
        fold = r.leaf
        for step in r.path:
            assert (step.left == "") != (step.right == "") or step.left == step.right == ""
            fold = H(step.left + fold + step.right)
        assert fold == r.root


def test_registered():
    assert "op13_merkle_manifest" in QUERIES and LEAF[0] == "doc_id"
