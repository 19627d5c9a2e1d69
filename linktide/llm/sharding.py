"""Uniform shuffle into shards of exact sizes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linktide.llm.common import numbered_within, others
from linktide.session import settle

SEED = 20_240_601
#: numpy draws hypergeometric numbers from populations below this.
NUMPY_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One exact hypergeometric number for a population of any size."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    share = good / (good + bad)
    spread = (sample * share * (1 - share) * (good + bad - sample) / (good + bad - 1)) ** 0.5
    middle = min(max(int((sample + 1) * (good + 1) / (good + bad + 2)), low), high)
    # beyond 40 standard deviations the mass is under the resolution of a double
    first, last = max(low, middle - int(40 * spread) - 40), min(high, middle + int(40 * spread) + 40)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def _share_out(rng: np.random.Generator, room: np.ndarray, rows: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of ``rows`` go to each shard with ``room``."""
    out, left = np.zeros_like(room), int(room.sum())
    for j, r in enumerate(room.tolist()):
        left -= r
        out[j] = hypergeometric(rng, r, left, rows) if rows else 0
        rows -= int(out[j])
    return out


def matrix_row(before: Sequence[int], index: int, room: np.ndarray, seed: int) -> np.ndarray:
    """Row ``index`` of the communication matrix: rows of that partition for each shard.

    ``before`` holds the rows in front of each partition, and the total. The
    matrix is drawn down a binary tree of partitions whose nodes have seeds of
    their own. A task draws the nodes on its path only, all tasks agree, and the
    rows add up to the shard sizes without a matrix anywhere.
    """
    low, high = 0, len(before) - 1
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = _share_out(rng, room, int(before[middle] - before[low]))
        low, high, room = (low, middle, left) if index < middle else (middle, high, room - left)
    return room


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one row at most."""
    return np.array([rows // shards + (i < rows % shards) for i in range(shards)], dtype=np.int64)


def uniform_shards(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Every row with ``shard`` and ``slot`` (gapless from 0 inside the shard).

    All assignments with shard sizes at most one row apart are equally likely.
    The input is written down first, so a lost executor recomputes the same
    partitions. Only row counts of partitions reach the driver. Each task draws
    its row of the matrix, permutes the targets over its rows, and gives each
    row a random place; the exchange then permutes inside the shard by place.
    Values of the rows play no part: nulls and repeated rows are as any other.
    """
    given = others(docs, "shard", "slot")
    fixed = settle(docs.select(*given))
    parts = fixed.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect()
    counts = np.zeros(max([r["part"] for r in parts], default=0) + 1, dtype=np.int64)
    for r in parts:
        counts[r["part"]] = r["count"]
    before = np.concatenate([[0], np.cumsum(counts)])
    sizes = shard_sizes(int(before[-1]), shards)
    fields = [*fixed.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("__place", T.DoubleType())]
    tagged = fixed.withColumn("__part", F.spark_partition_id())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets, begin = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = batch.columns[:-1]
            if targets is None:
                index = batch.column(batch.num_columns - 1)[0].as_py()
                row = matrix_row(before, index, sizes, seed)
                rng = np.random.Generator(np.random.PCG64([seed, index]))
                targets = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), row))
            end = begin + batch.num_rows
            columns += [pa.array(targets[begin:end]), pa.array(rng.random(batch.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "shard", "__place"])
            begin = end

    placed = tagged.mapInArrow(assign, T.StructType(fields))
    ties = [c for c, kind in placed.dtypes if kind in ("bigint", "int", "string") and c in given]
    out = numbered_within(placed, ["shard"], ["__place", *ties], "slot", int(sizes.max()))
    return out.select(*given, "shard", "slot")
