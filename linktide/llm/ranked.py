"""Ranked lexical search: MaxScore over an index with pair intersection lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linktide.llm.common import discard, text_of, written
from linktide.session import settle

#: Bytes of text that are cut into terms at once.
CHUNK_BYTES = 2_000_000
#: Item terms of one pass; more items are searched in further passes.
PASS_TERMS = 200_000
#: One block in so many is searched first, to learn scores that the best must reach.
WAVE = 32
#: Pair lists of an item whose best documents are scored first in a block.
SEED_PAIRS = 4

_BYTES = np.arange(256)
IS_TERM = (
    (_BYTES >= 0x80)
    | ((_BYTES >= ord("0")) & (_BYTES <= ord("9")))
    | ((_BYTES >= ord("A")) & (_BYTES <= ord("Z")))
    | ((_BYTES >= ord("a")) & (_BYTES <= ord("z")))
)
LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)


def terms_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    """The terms of whole texts, some rows at a time: (first row, rows, row of each term, terms).

    Terms are the longest runs of ASCII letters and digits and of all characters
    beyond ASCII, with A-Z lower-cased. In UTF-8 these are runs of bytes.
    """
    _, starts, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(starts, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    ends = ends.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK_BYTES, "right")) - 1)
        piece = data[ends[row] : ends[stop]]
        edges = ends[row : stop + 1] - ends[row]
        inside = IS_TERM[piece]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = edges[:-1][edges[:-1] < edges[1:]]
        begins[heads] = inside[heads]
        spots = np.flatnonzero(begins)
        # without the bytes between terms, a term ends where the next one begins
        kept = LOWER[piece[inside]]
        offsets = np.append((np.cumsum(inside, dtype=np.int64) - inside)[spots], len(kept)).astype(np.int32)
        terms = pa.StringArray.from_buffers(len(spots), pa.py_buffer(offsets), pa.py_buffer(kept))
        yield row, stop - row, np.searchsorted(edges, spots, "right") - 1, terms
        row = stop


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, rows, of, terms in terms_of(batch.column(1)):
            words = [sorted(set(terms.take(pa.array(np.flatnonzero(of == i))).to_pylist())) for i in range(rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, rows), pa.array(words, pa.list_(pa.string()))], ["item_id", "terms"])


def _ragged(bounds: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Row bounds and values of a list column."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    bounds = whole.offsets.to_numpy()
    return bounds - bounds[0], whole.flatten().to_numpy(zero_copy_only=False)


def _counted(vocabulary: list[str]):
    """Per document: number of terms, and the item terms in it with their counts."""
    known = pa.array(vocabulary, pa.string())
    width = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, rows, of, terms in terms_of(batch.column(1)):
                place = pc.index_in(terms, value_set=known).fill_null(-1).to_numpy()
                hit = place >= 0
                found, times = np.unique(of[hit] * width + place[hit], return_counts=True)
                bounds = np.searchsorted(found, np.arange(rows + 1) * width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, rows),
                        pa.array(np.bincount(of, minlength=rows).astype(np.int64)),
                        _ragged(bounds, (found % width).astype(np.int32), pa.int32()),
                        _ragged(bounds, times.astype(np.int64), pa.int64()),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return count


def _length_part(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """20 * (50 + 50 * n * docs div length), exact beyond 64 bits."""
    if len(n) and int(n.max()) * 50 * docs >= 2**63:
        n = np.array([int(x) * 50 * docs // length for x in n], np.int64)
    else:
        n = n * (50 * docs) // length
    return 20 * (50 + n)


def _indexed(weights: np.ndarray, pairs: np.ndarray, docs: int, length: int):
    """Lists of a block of documents: one per term, one per pair of terms.

    A list holds slots and impacts in order of the slot, and the largest impact. The
    list of a pair holds the documents with both terms and their joint impact. The
    row (-1, -1) holds the document ids.
    """
    partner: dict[int, list[int]] = {}
    for a, b in pairs.tolist():
        partner.setdefault(a, []).append(b)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            block = (part << 32) + number
            n = batch.column(1).to_numpy()
            bounds, terms = _lists(batch.column(2))
            _, times = _lists(batch.column(3))
            slots = np.repeat(np.arange(len(n), dtype=np.int32), np.diff(bounds))
            impact = weights[terms] * (1_000_000_000 * times // (1000 * times + _length_part(n, docs, length)[slots]))
            order = np.argsort(terms, kind="stable")
            terms, slots, impact = terms[order], slots[order], impact[order]
            names, first = np.unique(terms, return_index=True)
            last = np.append(first[1:], len(terms))
            span = {int(t): (int(i), int(j)) for t, i, j in zip(names, first, last)}
            keys, docs_of, values = [], [], []
            for a, (i, j) in span.items():
                keys.append((a, -1, int(impact[i:j].max())))
                docs_of.append(slots[i:j])
                values.append(impact[i:j])
            joint = np.full(len(n), -1, np.int64)
            for a, others in partner.items():
                if a not in span:
                    continue
                i, j = span[a]
                joint[slots[i:j]] = impact[i:j]
                for b in others:
                    if b in span:
                        i2, j2 = span[b]
                        mine = joint[slots[i2:j2]]
                        both = mine >= 0
                        if both.any():
                            sums = mine[both] + impact[i2:j2][both]
                            keys.append((a, b, int(sums.max())))
                            docs_of.append(slots[i2:j2][both])
                            values.append(sums)
                joint[slots[i:j]] = -1
            sizes = np.cumsum([0, *map(len, docs_of)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * len(keys), pa.int64()),
                    *[pa.array([k[c] for k in keys], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64()))],
                    _ragged(sizes, np.concatenate([np.zeros(0, np.int32), *docs_of]), pa.int32()),
                    _ragged(sizes, np.concatenate([np.zeros(0, np.int64), *values]), pa.int64()),
                ],
                ["block", "a", "b", "top", "docs", "impacts"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([-1], pa.int32()),
                 pa.array([0], pa.int64()), pa.array([[]], pa.list_(pa.int32())),
                 pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), batch.column(0).cast(pa.int64()))],
                ["block", "a", "b", "top", "docs", "impacts"],
            )

    return build


class _Block:
    """The lists of one block, and the search of one item in it."""

    def __init__(self, table: pa.Table):
        a, b = (table.column(c).to_numpy() for c in ("a", "b"))
        tops = table.column("top").to_numpy()
        bounds, slots = _lists(table.column("docs"))
        spans, impacts = _lists(table.column("impacts"))
        self.lists, self.tops, self.size = {}, {}, 0
        for x, y, top, i, j, k, m in zip(a.tolist(), b.tolist(), tops.tolist(), bounds[:-1].tolist(),
                                         bounds[1:].tolist(), spans[:-1].tolist(), spans[1:].tolist()):
            if x < 0:
                self.size, self.ids = m - k, table.column("impacts").take(
                    pa.array(np.flatnonzero(a < 0))).combine_chunks().flatten()
            else:
                self.lists[x, y] = slots[i:j], impacts[k:m]
                self.tops[x, y] = top
        if impacts.dtype != np.int64:  # nulls among the ids
            self.lists = {key: (s, v.astype(np.int64)) for key, (s, v) in self.lists.items()}

    def scores(self, terms: list[int], slots: np.ndarray) -> np.ndarray:
        """Exact scores of some slots."""
        total = np.zeros(len(slots), np.int64)
        for t in terms:
            docs, impacts = self.lists[t, -1]
            at = np.minimum(np.searchsorted(docs, slots), len(docs) - 1)
            total += np.where(docs[at] == slots, impacts[at], 0)
        return total

    def best(self, units: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and scores that hold all of the ``k`` best with a score of ``least`` or more.

        A unit is a term or a pair of terms. The bound of a pair is the largest of
        its joint maximum and its two single maxima: a document has both terms, or
        one. That is never more than the sum of the single maxima.
        """
        bounds, present = [], []
        for a, b in units:
            here = [t for t in (a, b) if (t, -1) in self.tops]
            if here:
                present.append(here)
                joint = self.tops.get((a, b), 0)
                bounds.append(max(joint, *(self.tops[t, -1] for t in here)))
        terms = [t for here in present for t in here]
        none = np.zeros(0, np.int64)
        if sum(bounds) < least or not terms:
            return none, none
        # the best documents of the strongest pairs show early what a result must reach
        strong = sorted((u for u in units if u in self.tops and u[1] >= 0), key=lambda u: -self.tops[u])[:SEED_PAIRS]
        seeds = []
        for u in strong:
            docs, sums = self.lists[u]
            seeds.append(docs if len(docs) <= k else docs[np.argpartition(-sums, k)[:k]])
        if seeds:
            seeds = np.unique(np.concatenate(seeds))
            if len(seeds) >= k:
                least = max(least, int(np.partition(self.scores(terms, seeds), -k)[-k]))
        order = np.argsort(bounds, kind="stable")
        reach = np.cumsum(np.array(bounds, np.int64)[order])
        spare = int(np.searchsorted(reach, least, "left"))  # units that cannot reach it together
        rest = int(reach[spare - 1]) if spare else 0
        total = np.zeros(self.size, np.int64)
        for u in order[spare:]:
            for t in present[u]:
                docs, impacts = self.lists[t, -1]
                total[docs] += impacts
        found = np.flatnonzero(total >= max(1, least - rest))
        for u in order[:spare][::-1]:
            if not len(found):
                break
            for t in present[u]:
                docs, impacts = self.lists[t, -1]
                if len(found) * 8 > len(docs):
                    total[docs] += impacts
                else:
                    at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                    total[found] += np.where(docs[at] == found, impacts[at], 0)
            rest -= bounds[u]
            found = found[total[found] >= max(1, least - rest)]
        return found, total[found]


def _searched(units: list[list[tuple[int, int]]], k: int, least: list[int]):
    def search(table: pa.Table) -> pa.Table:
        block = _Block(table)
        ids = block.ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        items, slots, scores = [], [], []
        for item, mine in enumerate(units):
            found, score = block.best(mine, k, least[item])
            if len(found) > k:
                top = np.lexsort((ids[found], -score))[:k]
                found, score = found[top], score[top]
            items.append(np.full(len(found), item, np.int32))
            slots.append(found)
            scores.append(score)
        slots = np.concatenate([np.zeros(0, np.int64), *slots])
        return pa.table({
            "item": pa.array(np.concatenate([np.zeros(0, np.int32), *items]), pa.int32()),
            "doc_id": block.ids.take(pa.array(slots)),
            "score": pa.array(np.concatenate([np.zeros(0, np.int64), *scores]), pa.int64()),
        })

    return search


def _paired(words: list[int], df: dict[int, int]) -> list[tuple[int, int]]:
    """Terms of an item by falling document count, two by two; a last one stays alone."""
    order = sorted(words, key=lambda t: (-df.get(t, 0), t))
    two = [tuple(sorted(order[i : i + 2])) for i in range(0, len(order) - 1, 2)]
    return two + ([(order[-1], -1)] if len(order) % 2 else [])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item.

    ``docs(doc_id, text)``, ``items(item_id, text)``; other columns are not read. The
    score of a document is the sum of ``w * q`` over the terms of the item (once
    each): ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, ``q = 1e9 tf div (1000 tf +
    20 m)``, ``m = 50 + 50 n N div L``. Every row is a document and an item of its
    own, so repeated ids are ranked side by side; equal scores go by ascending
    ``doc_id``, null last. Null and empty texts have no term: such an item has no
    row, such a document is in no result. Without documents or items there is no row.

    The index is split by document: a block (one Arrow batch of documents) holds a
    list per item term and, for pairs of terms that an item names together,
    the intersection with its joint maximum impact. Blocks are searched
    independently by MaxScore; the bound of a set of terms adds up pair bounds. One block in
    ``WAVE`` is searched before the others, and the score its k-th document reaches
    is a floor for all blocks. A task holds one block, and passes on at most ``k``
    documents of an item. What the items need (terms, pairs, floors) goes to
    every task; items with more than ``PASS_TERMS`` terms are searched in passes.
    """
    kind = dict(items.dtypes)["item_id"]
    asked = settle(items.select("item_id", text_of().alias("text")).mapInArrow(
        _items, f"item_id {kind}, terms array<string>"))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-total // PASS_TERMS))
    result = None
    for number in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("terms"), F.lit(passes)) == number)
        found = _pass(docs, mine, k)
        result = found if result is None else result.unionByName(found)
    return result


def _pass(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    item_kind, doc_kind = dict(asked.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    rows = asked.collect()  # at most about PASS_TERMS terms
    vocabulary = sorted({t for r in rows for t in r.terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    counted, counts_path = written(
        docs.select("doc_id", text_of().alias("text")).mapInArrow(
            _counted(vocabulary), f"doc_id {doc_kind}, n bigint, terms array<int>, tfs array<bigint>"),
        "counted")
    some = counted.where("n > 0")
    size, length = some.agg(F.count(F.lit(1)), F.sum("n")).first()
    length = int(length or 1)
    df = {r[0]: r[1] for r in some.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weights = np.array(
        [math.floor(1000 * math.log((2 * size + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    units = [_paired([number[t] for t in r.terms], df) for r in rows]
    pairs = np.array(sorted({u for unit in units for u in unit if u[1] >= 0}), np.int64).reshape(-1, 2)
    index, index_path = written(
        some.select("doc_id", "n", "terms", "tfs").mapInArrow(
            _indexed(weights, pairs, size, length),
            "block bigint, a int, b int, top bigint, docs array<int>, impacts array<bigint>"),
        "ranked")
    discard(spark, counts_path)
    schema = f"item int, doc_id {doc_kind}, score bigint"

    def run(blocks: DataFrame, least: list[int]) -> DataFrame:
        return _ranked(blocks.groupBy("block").applyInArrow(_searched(units, k, least), schema), k)

    wave = run(index.where(F.pmod(F.xxhash64("block"), F.lit(WAVE)) == 0), [1] * len(rows))
    floors = {r[0]: r[1] for r in wave.where(F.col("rank") == k).select("item", "score").collect()}
    best = settle(run(index, [floors.get(i, 1) for i in range(len(rows))]))
    discard(spark, index_path)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {item_kind}")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
