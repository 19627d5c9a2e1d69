"""Removal of repeated byte strings by a sparse, distributed suffix array.

A window of 200 bytes is repeated if the same 200 bytes start anywhere else.
Sorting every suffix of the corpus would shuffle each byte 200 times, so only
suffixes at anchors are sorted:

* Every window has an anchor, the leftmost smallest ``GRAM``-byte string inside
  it (by hash). Equal windows have equal anchors at equal places, so windows are
  compared only where anchors start with the same gram: Spark's shuffle on the
  gram is the first, shallow character of the sort.
* A *context* is the union of the windows of one anchor. Contexts found twice
  are repeated as a whole and need no bytes.
* The rest, mostly the ends of repeated passages, are ordered by deep-shallow
  sorting of the text right of the anchor and of the text left of it: multikey
  quicksort on 8-byte characters down to ``SHALLOW`` bytes, then blind tries.
  The common prefixes of neighbours tell which windows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linktide.llm.common import discard, others, text_of, written
from linktide.operators.keyed import attach

#: Bytes of a repeated string, and of an anchor's gram.
LENGTH = 200
GRAM = 48
#: Bytes of texts that a task looks at together; longer texts are read in pieces.
PIECE = 1 << 19
#: Depth of the multikey quicksort, and bytes of one of its characters.
SHALLOW = 24
CHARACTER = 8
#: Contexts of one gram that are sorted in one task; more are compared by digest.
CROWD = 100_000
#: Contexts that are ordered together.
GROUP_ROWS = 20_000
#: Contexts and grams above this share of all anchors are settled map-side or salted.
SUPPORT = 1 / 4096
SALTS = 64

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    up = np.full(size, _BASE, dtype=np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of the ``gram`` bytes from each place."""
    up, down = _powers(PIECE + 2 * LENGTH + 2)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _anchors(data: np.ndarray, spans: list[tuple[int, int]], length: int, gram: int):
    """(gram hash, place, first start, last start, span) of each anchor of the spans in ``data``."""
    hashes = _gram_hashes(data, gram)
    keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    smallest = _sliding_minimum(keyed, length - gram + 1)
    counts = np.array([end - begin - length + 1 for begin, end in spans])
    owner = np.repeat(np.arange(len(spans)), counts)
    shift = np.array([b for b, _ in spans]) - np.concatenate([[0], np.cumsum(counts)[:-1]])
    starts = np.arange(counts.sum()) + shift[owner]
    places = (smallest[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([first[1:], [len(places)]]) - 1
    at = places[first]
    return hashes[at], at, starts[first], starts[last], owner[first]


_ANCHOR = pa.schema(
    [("kg", pa.int64()), ("ctx", pa.int64()), ("id", pa.int64()), ("tag", pa.int32()),
     ("at", pa.int32()), ("back", pa.int16()), ("ahead", pa.int16())]
)


def _scan(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Anchors of every text: (id, tag, text) in, one row an anchor out."""
    def emit(pieces: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        whole = b"".join(p[3] for p in pieces)
        ends = np.cumsum([len(p[3]) for p in pieces])
        begins = ends - [len(p[3]) for p in pieces]
        kg, at, lo, hi, own = _anchors(
            np.frombuffer(whole, dtype=np.uint8), list(zip(begins.tolist(), ends.tolist())), length, gram
        )
        digest = xxhash.xxh3_64_intdigest
        ctx = np.array(
            [digest(whole[a : b + length], x - a) for a, b, x in zip(lo.tolist(), hi.tolist(), at.tolist())],
            dtype=np.uint64,
        )
        offset = np.array([p[2] for p in pieces]) - begins
        columns = [
            kg.view(np.int64), ctx.view(np.int64), np.array([p[0] for p in pieces])[own],
            np.array([p[1] for p in pieces], dtype=np.int32)[own], (at + offset[own]).astype(np.int32),
            (at - lo).astype(np.int16), (hi + length - at).astype(np.int16),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ANCHOR)

    held, size = [], 0
    for batch in batches:
        for id_, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            for begin in range(0, max(1, len(text) - length + 1), PIECE):
                piece = text[begin : begin + PIECE + length - 1]
                if len(piece) < length:
                    continue
                if held and size + len(piece) > PIECE + length - 1:
                    yield emit(held)
                    held, size = [], 0
                held.append((id_, tag, begin, piece))
                size += len(piece)
    if held:
        yield emit(held)


def _common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, high = known, most - 1
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _blind_trie(strings: list[bytes], members: list[int], depth: int) -> list[int]:
    """``members`` in order of their strings, which share their first ``depth`` bytes.

    Inner nodes are [branching depth, {byte or -1 for the end: child}], leaves
    lists of members with one string. A string goes down blindly to some leaf,
    the common prefix with that leaf tells where it leaves the path.
    """
    root = None
    for m in members:
        s = strings[m]
        if root is None:
            root = [m]
            continue
        node = root
        while isinstance(node, tuple):
            at = node[0]
            child = node[1].get(s[at] if at < len(s) else -1)
            node = child if child is not None else next(iter(node[1].values()))
        other = strings[node[0]]
        split = _common(s, other, depth)
        if split == len(s) == len(other):
            node.append(m)
            continue
        parent, key, node = None, None, root
        while isinstance(node, tuple) and node[0] < split:
            parent, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        mine = s[split] if split < len(s) else -1
        if isinstance(node, tuple) and node[0] == split:
            node[1][mine] = [m]
        else:
            theirs = other[split] if split < len(other) else -1
            fork = (split, {theirs: node, mine: [m]})
            if parent is None:
                root = fork
            else:
                parent[1][key] = fork
    order, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            order.extend(node)
    return order


def deep_shallow(strings: list[bytes], members: list[int], shallow: int = SHALLOW) -> list[int]:
    """``members`` in the order of their strings."""
    order, stack = [], [(members, 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) == 1:
            order.append(part[0])
        elif depth >= shallow:
            order.extend(_blind_trie(strings, part, depth))
        else:
            end = depth + CHARACTER
            keys = [strings[m][depth:end] for m in part]
            pivot = keys[len(keys) // 2]
            equal = [m for m, k in zip(part, keys) if k == pivot]
            more = [m for m, k in zip(part, keys) if k > pivot]
            less = [m for m, k in zip(part, keys) if k < pivot]
            if more:
                stack.append((more, depth))
            if len(pivot) < CHARACTER:  # these strings end here, all alike
                stack.extend(([m], end) for m in equal)
            else:
                stack.append((equal, end))
            if less:
                stack.append((less, depth))
    return order


def _classes(strings: list[bytes], groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Order of all strings group by group, and the common prefix with the one before (-1: new group)."""
    order, shared = [], []
    for members in groups:
        own = deep_shallow(strings, members)
        shared.append(-1)
        shared.extend(_common(strings[a], strings[b]) for a, b in zip(own, own[1:]))
        order.extend(own)
    return np.array(order), np.array(shared)


def repeated_starts(contexts: list[bytes], backs: np.ndarray, groups: list[list[int]], length: int, gram: int):
    """(nearest, farthest) start before the anchor, in bytes, of each context's repeated windows; -1: none.

    A window that starts ``d`` bytes before the anchor is repeated if another
    context of the group has the same ``d`` bytes to the left and the same
    ``length - d`` bytes from the anchor on: equal classes in both orders.
    """
    size = len(contexts)
    right = [c[b:] for c, b in zip(contexts, backs)]
    left = [c[:b][::-1] for c, b in zip(contexts, backs)]
    right_order, right_shared = _classes(right, groups)
    left_order, left_shared = _classes(left, groups)
    ahead = np.array([len(r) for r in right])
    nearest, farthest = np.full(size, -1), np.full(size, -1)
    right_class, left_class = np.empty(size, dtype=np.int64), np.empty(size, dtype=np.int64)
    for d in range(length - gram + 1):
        takes_part = (backs >= d) & (ahead >= length - d)
        if takes_part.sum() < 2:
            continue
        right_class[right_order] = np.cumsum(right_shared < length - d)
        left_class[left_order] = np.cumsum(left_shared < d)
        who = np.flatnonzero(takes_part)
        key = right_class[who] * (size + 1) + left_class[who]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = who[count[at] > 1]
        farthest[hit] = d
        nearest[hit] = np.where(nearest[hit] < 0, d, nearest[hit])
    return nearest, farthest


_SPAN = pa.schema([("id", pa.int64()), ("tag", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())])


def _spans(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (np.int64, np.int32, np.int32, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds)], schema=_SPAN)


def _order_groups(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans of single contexts: rows (kg, id, tag, at, back, single, context) sorted by kg."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        groups, last = [], None
        for i, r in enumerate(rows):
            if r[0] != last:
                groups.append([])
                last = r[0]
            groups[-1].append(i)
        groups = [g for g in groups if len(g) > 1]
        chosen = [i for g in groups for i in g]
        place = {i: n for n, i in enumerate(chosen)}
        rows = [rows[i] for i in chosen]
        near, far = repeated_starts(
            [r[6] for r in rows], np.array([r[4] for r in rows], dtype=np.int64),
            [[place[i] for i in g] for g in groups], length, gram,
        )
        single = np.array([r[5] for r in rows], dtype=bool)
        hit = single & (near >= 0)
        at = np.array([r[3] for r in rows], dtype=np.int64)
        ids, tags = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2))
        return _spans([ids[hit], tags[hit], (at - far)[hit], (at - near + length)[hit]])

    held: list[tuple] = []
    for batch in batches:
        fresh = list(zip(*(c.to_pylist() for c in batch.columns)))
        held.extend(fresh)
        if len(held) >= GROUP_ROWS and held[0][0] != held[-1][0]:
            last = held[-1][0]
            cut = next(i for i in range(len(held) - 1, -1, -1) if held[i][0] != last) + 1
            yield solve(held[:cut])
            held = held[cut:]
    if held:
        yield solve(held)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted contexts: (id, tag, text, wanted) in, one row a context out."""
    schema = pa.schema(
        [("kg", pa.int64()), ("id", pa.int64()), ("tag", pa.int32()), ("at", pa.int32()), ("back", pa.int16()),
         ("single", pa.bool_()), ("crowded", pa.bool_()), ("context", pa.binary())]
    )
    for batch in batches:
        out: list[tuple] = []
        for id_, tag, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for w in wanted:
                begin, end = w["at"] - w["back"], w["at"] + w["ahead"]
                out.append((w["kg"], id_, tag, w["at"], w["back"], w["single"], w["crowded"], text[begin:end]))
        columns = list(zip(*out)) if out else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _window_digests(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A 128-bit digest for each window of a context: (high, low, id, tag, begin, single)."""
    schema = pa.schema(
        [("high", pa.int64()), ("low", pa.int64()), ("id", pa.int64()), ("tag", pa.int32()), ("begin", pa.int32()),
         ("single", pa.bool_())]
    )
    for batch in batches:
        out: list[tuple] = []
        for _, id_, tag, at, back, single, context in zip(*(c.to_pylist() for c in batch.columns)):
            for begin in range(len(context) - length + 1):
                d = xxhash.xxh3_128_digest(context[begin : begin + length], back - begin)
                out.append((
                    int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True),
                    id_, tag, at - back + begin, single,
                ))
        columns = list(zip(*out)) if out else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with ``__id`` and ``__tag``, which tell apart texts also where ``doc_id`` is null or repeated."""
    mark = F.xxhash64(text_of())
    return docs.select(
        "*",
        F.coalesce(F.col("doc_id").cast("bigint"), mark).alias("__id"),
        mark.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("__tag"),
    )


def _repeated_spans(docs: DataFrame, length: int, gram: int, crowd: int, support: float) -> DataFrame:
    """(__id, __tag, spans): repeated spans of each text that has any, not yet merged."""
    spark = docs.sparkSession
    keyed = _keyed(docs.select("doc_id", "text")).select("__id", "__tag", text_of().cast("binary").alias("text"))
    long_enough = keyed.where(F.octet_length("text") >= length)
    names = "kg bigint, ctx bigint, id bigint, tag int, at int, back smallint, ahead smallint"
    anchors, anchor_path = written(long_enough.mapInArrow(lambda it: _scan(it, length, gram), names), "anchors")
    anchors = anchors.withColumn("pair", F.xxhash64("kg", "ctx"))

    candidates = anchors.stat.freqItems(["pair"], support).select(F.explode("pair_freqItems").alias("pair"))
    first = F.min(F.struct("kg", "ctx", "id", "tag", "at", "back", "ahead")).alias("first")
    winners, _ = written(
        anchors.join(F.broadcast(candidates.distinct()), "pair")
        .groupBy("pair").agg(F.count(F.lit(1)).alias("rows"), first).where("rows > 1"),
        "frequent",
    )
    frequent = F.broadcast(winners.select("pair"))  # at most 1 / support rows
    sure = anchors.join(frequent, "pair", "left_semi").select(
        "id", "tag", (F.col("at") - F.col("back")).alias("begin"), (F.col("at") + F.col("ahead")).alias("end")
    )
    rest = anchors.join(frequent, "pair", "left_anti").drop("pair").withColumn("times", F.lit(1))
    rest = rest.unionByName(winners.select("first.*").withColumn("times", F.lit(2)))
    crowds = rest.stat.freqItems(["kg"], support).select(F.explode("kg_freqItems").alias("kg")).distinct()
    kinds = rest.join(F.broadcast(crowds), "kg").select("kg", "ctx").distinct().groupBy("kg").agg(F.count(F.lit(1)).alias("hot"))
    hot, _ = written(kinds, "hot")  # contexts over all salts, so that a whole gram takes one path
    hot = F.broadcast(hot)
    salted = rest.join(hot, "kg", "left").withColumn(
        "salt", F.when(F.col("hot").isNotNull(), F.pmod("ctx", F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    )
    same = Window.partitionBy("kg", "salt", "ctx")
    grams = Window.partitionBy("kg", "salt")
    ranked = same.orderBy("id", "tag", "at")
    counted = (
        salted.withColumn("row", F.row_number().over(ranked))
        .withColumn("times", F.sum("times").over(same))
        .withColumn("kinds", F.sum(F.when(F.col("row") == 1, 1).otherwise(0)).over(grams))
        .withColumn("alone", F.max(F.col("times") == 1).over(grams))
    )
    several = F.col("hot").isNotNull() | ((F.col("kinds") > 1) & F.col("alone"))
    crowded = F.coalesce("hot", "kinds") > crowd
    marks, _ = written(
        counted.select(
            "id", "tag", "at", "back", "ahead", "kg",
            (F.col("times") > 1).alias("repeated"),
            (several & (F.col("row") == 1)).alias("wanted"),
            (F.col("times") == 1).alias("single"),
            crowded.alias("crowded"),
        ).where("repeated or wanted"),
        "marks",
    )
    sure, _ = written(sure, "sure")
    discard(spark, anchor_path)

    wanted = marks.where("wanted").groupBy("id", "tag").agg(
        F.collect_set(F.struct("kg", "at", "back", "ahead", "single", "crowded")).alias("wanted")
    )
    one = long_enough.select(F.col("__id").alias("id"), F.col("__tag").alias("tag"), "text")
    fetched = attach(one, wanted, ["id", "tag"], "inner").select("id", "tag", "text", "wanted")
    contexts, _ = written(
        fetched.mapInArrow(
            _contexts,
            "kg bigint, id bigint, tag int, at int, back smallint, single boolean, crowded boolean, context binary",
        ).distinct(),
        "contexts",
    )
    columns = ["kg", "id", "tag", "at", "back", "single", "context"]
    ordered = (
        contexts.where("not crowded").select(*columns).repartition("kg").sortWithinPartitions("kg")
        .mapInArrow(lambda it: _order_groups(it, length, gram), "id bigint, tag int, begin int, end int")
    )
    digests = contexts.where("crowded").select(*columns).mapInArrow(
        lambda it: _window_digests(it, length, gram),
        "high bigint, low bigint, id bigint, tag int, begin int, single boolean",
    )
    twice = digests.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    matched = attach(digests.where("single"), twice, ["high", "low"], "inner").select(
        "id", "tag", "begin", (F.col("begin") + length).alias("end")
    )
    begin, end = (F.col("at") - F.col("back")).alias("begin"), (F.col("at") + F.col("ahead")).alias("end")
    found = sure.unionByName(marks.where("repeated").select("id", "tag", begin, end))
    found = found.unionByName(ordered).unionByName(matched)
    return found.groupBy(F.col("id").alias("__id"), F.col("tag").alias("__tag")).agg(
        F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("__found")
    )


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in ((s["begin"], s["end"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, support: float = SUPPORT
) -> DataFrame:
    """Every row with ``spans`` (begin, end of each maximal removed run) and ``kept`` (remaining bytes).

    Texts count as UTF-8 bytes, null as empty; texts under ``length`` bytes have
    nothing removed. Rows that repeat a text of ``length`` bytes or more lose it
    all, as its windows start elsewhere too. Ids may be null or repeated.
    """
    if not 8 <= gram <= length:
        raise ValueError("gram must be between 8 and length")
    given = others(docs, "spans", "kept")
    found = _repeated_spans(docs, length, gram, crowd, support)
    rows = attach(_keyed(docs.select(*given)), found, ["__id", "__tag"], "left")

    @F.pandas_udf("spans array<struct<begin:int,end:int>>, kept binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        runs, kept = [], []
        for text, own in zip(texts, spans):
            merged = _merged(own) if own is not None else []
            edges = [0, *[x for run in merged for x in run], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else text)
            runs.append([{"begin": b, "end": e} for b, e in merged])
        return pd.DataFrame({"spans": runs, "kept": kept})

    done = rows.withColumn("__cut", cut(text_of().cast("binary"), F.col("__found")))
    return done.select(*given, "__cut.spans", "__cut.kept")
