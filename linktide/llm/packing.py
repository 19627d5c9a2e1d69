"""Packing documents into batches by optimal length buckets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.llm.common import let, numbered_within, others, unit_hash, word_count

#: Length buckets, padded tokens of a batch.
BUCKETS = 16
BUDGET = 16_384
#: Lengths up to this are told apart; each doubling above has as many steps.
EXACT = 4_096


def _step(length: Column, exact: int) -> Column:
    """Bin of a length: itself up to ``exact``, then ``exact`` equal steps a doubling."""
    octave = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double") / exact)), F.lit(-1)) + 1
    width = F.pow(F.lit(2.0), F.greatest(octave - 1, F.lit(0))).cast("bigint")
    return F.when(length <= exact, length).otherwise(F.ceil(length / width) * width)


def histogram(lengths: DataFrame, exact: int = EXACT) -> DataFrame:
    """(step, rows, total, longest): bounded in size at any number of rows."""
    return lengths.groupBy(_step(F.col("n_tokens"), exact).alias("step")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("longest")
    )


def bucket_edges(longest: Sequence[int], rows: Sequence[int], totals: Sequence[int], buckets: int = BUCKETS) -> list[int]:
    """Upper edges of at most ``buckets`` buckets with the least padding.

    Padding of a bucket over bins i+1..j is longest[j] * rows - tokens. For a
    fixed number of buckets the best split moves up with j, so a layer is filled
    by divide and conquer in D log D steps. The bins come sorted by length.
    """
    edge = np.asarray(longest, dtype=np.float64)
    n = np.concatenate([[0.0], np.cumsum(rows, dtype=np.float64)])
    tokens = np.concatenate([[0.0], np.cumsum(totals, dtype=np.float64)])
    size = len(edge)
    if not size:
        return []
    best = np.full(size + 1, np.inf)
    best[0] = 0.0
    choices = []
    for _ in range(min(buckets, size)):
        layer, choice = best.copy(), np.arange(size + 1)
        stack = [(1, size, 0, size - 1)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            j = (low + high) // 2
            splits = np.arange(first, min(last, j - 1) + 1)
            cost = best[splits] + edge[j - 1] * (n[j] - n[splits]) - (tokens[j] - tokens[splits])
            at = int(np.argmin(cost))
            if cost[at] < layer[j]:
                layer[j], choice[j] = cost[at], splits[at]
            at = int(splits[at])
            stack += [(low, j - 1, first, at), (j + 1, high, at, last)]
        best = layer
        choices.append(choice)
    edges, j = [], size
    for choice in reversed(choices):
        if j and choice[j] < j:
            edges.append(int(edge[j - 1]))
            j = int(choice[j])
    return edges[::-1]


def pack(
    docs: DataFrame,
    length: Column | None = None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    exact: int = EXACT,
    seed: str = "pack",
) -> DataFrame:
    """Every row with ``n_tokens, bucket, bucket_length, batch, slot``.

    ``length`` defaults to the number of words. Bucket edges minimise the padding
    over the histogram of all lengths. Inside a bucket the rows are put in a
    hash-seeded order and cut into batches of max(1, budget / bucket_length)
    rows, so a batch padded to ``bucket_length`` keeps to the budget; a longer
    document has a batch of its own. Empty and null texts have length 0. Each
    row is packed exactly once; repeated rows are interchangeable.
    """
    given = others(docs, "n_tokens", "bucket", "bucket_length", "batch", "slot")
    measured = docs.select(*given, (word_count() if length is None else length).alias("n_tokens"))
    bins = histogram(measured.select("n_tokens"), exact).orderBy("longest").collect()
    edges = bucket_edges(
        [r["longest"] for r in bins], [r["rows"] for r in bins], [r["total"] for r in bins], buckets
    )
    upper = F.array(*[F.lit(e).cast("bigint") for e in edges]) if edges else F.array().cast("array<bigint>")
    # the length is bound once: inside the lambda it would be counted again for each edge
    bucket = let(F.col("n_tokens"), lambda n: F.size(F.filter(upper, lambda e: e < n)))
    of_bucket = [0] * (len(edges) + 1)
    for r in bins:
        of_bucket[int(np.searchsorted(edges, r["longest"]))] += r["rows"]
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    body = F.xxhash64("text").cast("string") if "text" in given else F.lit("")
    placed = measured.select(
        *given,
        "n_tokens",
        bucket.alias("bucket"),
        F.get(upper, bucket).alias("bucket_length"),
        unit_hash(F.lit(seed), name, body).alias("__place"),
    )
    ties = [c for c in ("doc_id", "text") if c in given]
    numbered = numbered_within(placed, ["bucket"], ["__place", *ties], "__at", max(of_bucket))
    rows = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))))
    return numbered.select(
        *given,
        "n_tokens",
        "bucket",
        "bucket_length",
        F.floor(F.col("__at") / rows).alias("batch"),
        (F.col("__at") % rows).cast("int").alias("slot"),
    )
