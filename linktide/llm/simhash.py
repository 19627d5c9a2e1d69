"""Near-duplicates by SimHash fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linktide.operators.keyed import attach
from linktide.operators.neighbourhood import components
from linktide.session import settle

#: Words of a shingle, seed of its hash, differing bits of a link.
SHINGLE = 4
SEED = 42
DISTANCE = 4
BITS = 64
#: Fingerprints that one task compares with each other at most; larger buckets
#: are compared in pairs of chunks.
CHUNK = 65_536


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text; A-Z are lower-cased, a text without words gives 0."""
    words = (text or b"").lower().split()  # bytes methods: ASCII letters and white space only
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for begin in range(0, last, CHUNK):
        end = min(last, begin + CHUNK)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(begin, end)),
            dtype=np.dtype("<u8"),
            count=end - begin,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def fingerprint(text: str | Column = "text") -> Column:
    """Fingerprint of every whole text as bigint (the same 64 bits, signed)."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        prints = np.fromiter((simhash(t) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(prints.view(np.int64))

    return of((F.col(text) if isinstance(text, str) else text).cast("binary"))


def block_masks(rows: int, distance: int = DISTANCE) -> list[int]:
    """Masks such that two fingerprints within ``distance`` agree under one of them.

    The bits are split into ``m`` blocks. At most ``distance`` blocks differ, so
    some ``m - distance`` blocks agree. ``m`` is the smallest for which a key has
    at least as many bits as are needed to number the fingerprints, so chance
    agreements stay in proportion to the input.
    """
    needed = max(1, rows).bit_length()
    for blocks in range(distance + 1, BITS + 1):
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        spans = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
        masks = [sum(kept) for kept in combinations(spans, blocks - distance)]
        if min(m.bit_count() for m in masks) >= needed:
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _forest(prints: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Stars (root, member) that join what links within ``distance`` join.

    A breadth-first search that compares a fingerprint only with those not yet
    reached: linear where a group is dense, and no link is missed.
    """
    if len(prints) <= 12:
        values = [int(p) & ((1 << BITS) - 1) for p in prints]
        left, right = [], []
        for i, a in enumerate(values):
            for j in range(i):
                if (a ^ values[j]).bit_count() <= distance:
                    left.append(int(prints[j]))
                    right.append(int(prints[i]))
        return left, right
    open_, left, right = prints, [], []
    while len(open_):
        root, queue, open_ = open_[0], [open_[0]], open_[1:]
        while queue and len(open_):
            near = np.bitwise_count((open_ ^ queue.pop()).view(np.uint64)) <= distance
            if near.any():
                found = open_[near]
                queue.extend(found)
                left.extend([int(root)] * len(found))
                right.extend(found.tolist())
                open_ = open_[~near]
    return left, right


def _link_runs(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links inside each run of equal (mask, key, cell) of sorted rows."""
    carry = None
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(table: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        for begin, end in zip(cuts[:-1], cuts[1:]):
            if end - begin > 1:
                a, b = _forest(table[begin:end, 3], distance)
                left += a
                right += b
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if carry is not None and len(carry):
            rows = np.concatenate([carry, rows])
        if not len(rows):
            continue
        starts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        cuts = np.concatenate([[0], starts])
        carry = rows[cuts[-1] :]
        if len(cuts) > 1:
            yield linked(rows, cuts)
    if carry is not None and len(carry):
        yield linked(carry, np.array([0, len(carry)]))


def links(prints: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """(a, b): stars that connect the distinct fingerprints ``fp`` within ``distance``.

    Every fingerprint goes to one bucket per mask; a window counts the bucket,
    buckets of one are dropped, and buckets above ``chunk`` are dealt out as
    pairs of chunks, so that a task never holds more than two chunks of one.
    """
    prints = settle(prints.select("fp").where("fp is not null").distinct())
    masks = block_masks(prints.count(), distance)
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for i, m in enumerate(masks)
        ]
    )
    bucket = Window.partitionBy("mask", "key")
    shared = (
        prints.select("fp", F.explode(keys).alias("__k"))
        .select("__k.mask", "__k.key", "fp")
        .withColumn("n", F.count(F.lit(1)).over(bucket))
        .where("n > 1")
    )
    chunks = F.ceil(F.col("n") / F.lit(chunk))
    own = F.pmod(F.xxhash64("fp"), chunks)
    cells = F.when(F.col("n") <= chunk, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), chunks - 1),
            lambda j: F.least(own, j) * chunks + F.greatest(own, j),
        )
    )
    dealt = (
        shared.select("mask", "key", F.explode(cells).alias("cell"), "fp")
        .repartition("mask", "key", "cell")
        .sortWithinPartitions("mask", "key", "cell", "fp")
    )
    return dealt.mapInArrow(lambda it: _link_runs(it, distance), "a bigint, b bigint").distinct()


def near_classes(prints: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """(fp, component_id): smallest ``doc_id`` reachable over links; prints has (doc_id, fp)."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("__least"))
    roots = components(links(prints, distance, chunk)).toDF("fp", "__root")
    placed = settle(least.join(roots, "fp", "left").withColumn("__root", F.coalesce("__root", "fp")))
    lowest = placed.groupBy("__root").agg(F.min("__least").alias("component_id"))
    return attach(placed.select("fp", "__root"), lowest, ["__root"], "inner").select("fp", "component_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), a row per row, written down once so that texts are read once."""
    return settle(docs.select("doc_id", fingerprint().alias("fp")))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id), a row per row of ``docs``.

    Fingerprints of equal texts are equal; texts without words share fingerprint
    0 and are linked like any other. A null ``doc_id`` never names a component:
    a component of such rows alone has a null id.
    """
    prints = fingerprints(docs)
    return attach(prints, near_classes(prints, distance), ["fp"], "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The document that names each component, with its own columns.

    Rows without ``doc_id`` stay; of repeated rows with one ``doc_id`` one stays.
    """
    found = near_duplicates(docs, distance)
    losers = found.where("doc_id != component_id").select("doc_id").distinct()
    left = docs.join(losers, "doc_id", "left_anti")
    spread = F.when(F.isnull("doc_id"), F.xxhash64("text"))  # the join has dealt rows by doc_id already
    first = Window.partitionBy("doc_id", spread).orderBy("text")
    numbered = left.withColumn("__row", F.row_number().over(first))
    return numbered.where("__row = 1 or doc_id is null").select(*docs.columns)
