"""One graph as packed cells: a step ships vectors of node groups instead of rows.

Nodes are dealt to groups by a hash of their id and keep a place in the group's sorted
ids. The links between two groups are one cell, which holds the places of both ends and the
weights; cells are cached, one a partition. A step ships the vectors of a group to its cells,
multiplies there and ships the partial sums back, so it moves a few numbers per node and
group, whatever the number of links. A hub's links are spread over all cells of its group.

A graph that is one cell needs no steps between tasks: a whole run is one task (see ``alone``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from linktide.operators.graph import node_table
from linktide.session import ensure_checkpoint_dir, sweep

#: Links of a cell.
CELL_LINKS = 4_000_000
#: Links below which another cell is not worth its task and the shuffles of every step.
SMALLEST_CELL = CELL_LINKS
#: Links that a task sorts by cell at a time.
DEALT_LINKS = 500_000
#: Bytes of vectors that a run in one task may hold.
HELD_BYTES = 512 << 20
#: Links that a held pack sums at a time.
RUN_LINKS = 65_536
#: Steps between two checkpoints of the state.
STEPS_PER_PLAN = 8
#: Rows of a batch that leaves a state.
BATCH_ROWS = 50_000

Arrays = dict[str, np.ndarray]


def seat(key: int) -> int:
    """Groups and cells are numbered, and each number is a partition."""
    return key


def cell_of(low, high):
    """Number of the cell of groups ``low <= high``."""
    return (high * (high + 1) / 2).cast("int") + low if isinstance(high, Column) else high * (high + 1) // 2 + low


def _moved(x: np.ndarray, source: np.ndarray, target: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums at the targets of w x, of one vector or of each row of a block."""
    if x.ndim == 1:
        return np.bincount(target, w * x[source], len(x))
    return np.stack([np.bincount(target, w * row[source], len(row)) for row in x])


def _spread(name: str, x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sums over links that ``Packed.step`` names."""
    if name == "back":
        return _moved(x, dst, src, w)
    y = _moved(x, src, dst, w * w if name == "square" else w)
    return y + _moved(x, dst, src, w) if name == "pull" else y


def _stored(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _loaded(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _whole(column) -> pa.Array:
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _numbers(column) -> np.ndarray:
    """Doubles, null as nan."""
    return _whole(column).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


def known(x: np.ndarray) -> np.ndarray:
    """Null counts as nothing in a sum."""
    return np.where(np.isnan(x), 0.0, x)


def divided(a, b: np.ndarray) -> np.ndarray:
    """Division in which x / 0, and anything with null, is 0."""
    with np.errstate(all="ignore"):
        return np.where(np.isnan(a) | np.isnan(b) | (b == 0), 0.0, a / b)


@dataclass
class Packed:
    """``nodes`` holds per group the node arrays degree, out, dangling and those of ``extra``.

    A state is an RDD of (group, arrays by name) that lies as ``nodes`` does.
    """

    spark: SparkSession
    groups: int
    n: int
    links: int
    mass: float
    top: float
    kind: str
    nodes: RDD
    cells: RDD
    kept: list[RDD]

    def release(self) -> None:
        for rdd in [self.nodes, self.cells, *self.kept]:
            rdd.unpersist()

    def state(self, make: Callable[[Arrays], Arrays]) -> RDD:
        """A state of what ``make`` gives for the node arrays of a group."""
        return self.nodes.mapPartitions(
            lambda items: [(g, ("own", make(node))) for g, (_, node) in items], preservesPartitioning=True)

    def over(self, state: RDD, make: Callable[[Arrays, Arrays], Arrays]) -> RDD:
        """The state of ``make(node arrays, state arrays)``."""

        def run(items):
            node, own = _met(items)[:2]
            return [(g, ("own", make(node[g], own[g]))) for g in own]

        return self.nodes.union(state).mapPartitions(run, preservesPartitioning=True)

    def totals(self, state: RDD, of: Callable[[Arrays, Arrays], np.ndarray]) -> np.ndarray:
        """``of`` per group, as rows; a few numbers per group reach the driver."""

        def run(items):
            node, own = _met(items)[:2]
            return [(g, of(node[g], own[g])) for g in own]

        rows = self.nodes.union(state).mapPartitions(run).collect()
        return np.array([row for _, row in sorted(rows, key=lambda kv: kv[0])])

    def step(
        self, state: RDD, send: Callable[[Arrays, Arrays], tuple[list, list]],
        receive: Callable[[Arrays, Arrays, list, np.ndarray], Arrays],
    ) -> RDD:
        """The next state.

        ``send(node, state)`` gives vectors, or blocks with a row per vector, each ("walk", x) for the sum
        over links from a node of w x, ("square", x) of w w x, ("back", x) for that over links to a
        node, or ("pull", x) for that over links in both directions, and numbers to be summed over all
        groups. ``receive(node, state, sums, numbers)`` gets them.
        """
        groups = self.groups

        def ship(items):
            node, own = _met(items)[:2]
            for g in own:
                vectors, notes = send(node[g], own[g])
                vectors = [(name, known(x)) for name, x in vectors]
                for other in range(groups):
                    yield cell_of(min(g, other), max(g, other)), ("sent", g, vectors, np.array(notes, dtype=float))

        def multiply(items):
            cell, sent = None, {}
            for _, value in items:
                if value[0] == "sent":
                    sent[value[1]] = value[2:]
                else:
                    cell = value
            _, low, high, src, dst, w = cell
            ends = [low] if low == high else [low, high]
            cut, out = sent[low][0][0][1].shape[-1] if sent[low][0] else 0, []
            for at, (name, _) in enumerate(sent[low][0]):
                x = np.concatenate([sent[g][0][at][1] for g in ends], axis=-1)
                out.append(_spread(name, x, src, dst, w))
            yield low, ("sum", high, [y[..., :cut] for y in out], sent[high][1])
            if low != high:
                yield high, ("sum", low, [y[..., cut:] for y in out], sent[low][1])

        def update(items):
            node, own, sums = _met(items)
            done = []
            for g in own:
                parts = [sums[g][other] for other in sorted(sums[g])]  # in one order, so that reruns agree
                vectors = [np.sum(some, axis=0) for some in zip(*(p[0] for p in parts))]
                done.append((g, ("own", receive(node[g], own[g], vectors, np.sum([p[1] for p in parts], axis=0)))))
            return done

        both = self.nodes.union(state)
        count = groups * (groups + 1) // 2
        shipped = both.mapPartitions(ship).partitionBy(count, seat)
        partial = self.cells.union(shipped).mapPartitions(multiply).partitionBy(groups, seat)
        made = both.union(partial).mapPartitions(update, preservesPartitioning=True)
        return self.keep(made)

    def joined(self, state: RDD, values: DataFrame, name: str) -> RDD:
        """The state with ``values(id, name)`` in place of its array of that name, 0 where there is none."""
        groups = self.groups
        group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g")
        placed = values.where("id IS NOT NULL").select(group, F.col("id").cast(self.kind).alias("id"), F.col(name).cast("double").alias("v"))

        def gather(rows: pa.Table) -> pa.Table:
            data = _stored(rows.select(["id", "v"]).sort_by([("id", "ascending"), ("v", "ascending")]))
            return pa.table({"g": rows.column("g").slice(0, 1), "data": pa.array([data], pa.binary())})

        given = placed.groupBy("g").applyInArrow(gather, "g int, data binary").rdd.map(
            lambda row: (row["g"], ("sum", 0, bytes(row["data"])))).partitionBy(groups, seat)

        def place(items):
            node, own, sums = _met(items)
            done = []
            for g in own:
                ids = _whole(_loaded(node[g]["ids"]).column("id"))
                x = np.zeros(len(ids))
                if g in sums:
                    rows = _loaded(sums[g][0][0])
                    at = pc.index_in(_whole(rows.column("id")), value_set=ids).fill_null(-1).to_numpy()
                    here = at >= 0
                    np.add.at(x, at[here], known(_numbers(rows.column("v")))[here])
                done.append((g, ("own", {**own[g], name: x})))
            return done

        return self.nodes.union(state).union(given).mapPartitions(place, preservesPartitioning=True)

    def keep(self, state: RDD) -> RDD:
        """Cached until the next ``settle``, as the next two stages read it."""
        self.kept.append(state.persist(StorageLevel.MEMORY_AND_DISK))
        return state

    def settle(self, state: RDD) -> RDD:
        """Written to the checkpoint folder; what was kept on the way is let go."""
        ensure_checkpoint_dir(self.spark)
        sweep(self.spark)
        state = state.mapPartitions(list, preservesPartitioning=True)  # one that no job has read can be checkpointed
        state.persist(StorageLevel.MEMORY_AND_DISK)
        state.checkpoint()
        state.count()
        for rdd in self.kept:
            rdd.unpersist()
        self.kept = [state]
        return state

    def alone(self, run: Callable, given: RDD | None = None, size: int = 0) -> tuple:
        """What ``run(pack, given)`` returns: (few values, state or None).

        ``run`` is driver code on this interface. The run of a graph of one cell is one task, with a ``Held``
        pack beside its arrays, unless it holds more bytes, ``size``, than a task should.
        """
        if self.groups > 1 or size > HELD_BYTES:
            return run(self, given)
        facts = {c: getattr(self, c) for c in ("groups", "n", "links", "mass", "top", "kind")}
        parts = self.nodes.union(self.cells)

        def task(items):
            pack, begun = held(list(items), facts)
            values, done = run(pack, begun)
            return [(0, ("own", done.items[0][1][1] if done is not None else {}, values))]

        made = (parts if given is None else parts.union(given)).mapPartitions(task, preservesPartitioning=True)
        made = self.settle(made)
        values = made.map(lambda item: item[1][2]).first()
        return values, made.mapPartitions(lambda items: [(g, value[:2]) for g, value in items], preservesPartitioning=True)

    def table(self, state: RDD, of: Callable[[Arrays, Arrays], Arrays], names: list[str], blocks: bool = False) -> DataFrame:
        """(id, names...) as doubles, null for nan; of ``blocks`` as arrays with a number per vector."""
        kind = self.kind

        def column(x: np.ndarray) -> pa.Array:
            if not blocks:
                return pa.array(x, from_pandas=True)
            bounds = np.arange(x.shape[1] + 1, dtype=np.int64) * len(x)
            return pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(np.ascontiguousarray(x.T).ravel())).cast(pa.list_(pa.float64()))

        def pack(items):
            node, own = _met(items)[:2]
            for g in own:
                columns, ids = of(node[g], own[g]), _loaded(node[g]["ids"]).column("id")
                for begin in range(0, len(ids), BATCH_ROWS):
                    end = begin + BATCH_ROWS
                    rows = pa.table({"id": ids[begin:end], **{c: column(columns[c][..., begin:end]) for c in names}})
                    yield (bytearray(_stored(rows)),)

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0):
                    yield from _loaded(data.as_py()).to_batches()

        packs = self.nodes.union(state).mapPartitions(pack)
        schema = ", ".join([f"id {kind}", *(f"{c} {'array<double>' if blocks else 'double'}" for c in names)])
        return self.spark.createDataFrame(packs, "data binary").mapInArrow(unpack, schema)


class Held:
    """What a task holds, with the calls of an RDD that packs and blocks use; each runs at once."""

    def __init__(self, items):
        self.items = list(items)

    def union(self, other: "Held") -> "Held":
        return Held([*self.items, *other.items])

    def mapPartitions(self, run: Callable, preservesPartitioning: bool = True) -> "Held":
        return Held(run(self.items))

    def collect(self) -> list:
        return self.items

    def first(self):
        return self.items[0]

    def unpersist(self) -> None:
        """Goes with its last reader."""


class Side:
    """The links by the end that they are summed at, in runs that stay in the processor's cache."""

    def __init__(self, target: np.ndarray, source: np.ndarray, w: np.ndarray, n: int):
        self.n, self.source, self.w = n, source.astype(np.intp), w
        heads = np.flatnonzero(np.append(True, np.diff(target) != 0)[: len(target)])
        self.runs, begin, cuts = [], 0, np.append(heads, len(target))
        while begin < len(heads):
            end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + RUN_LINKS, "right")) - 1)
            self.runs.append((int(cuts[begin]), int(cuts[end]), heads[begin:end] - heads[begin], target[heads[begin:end]].astype(np.intp)))
            begin = end
        self.buffer = np.empty(max((b - a for a, b, _, _ in self.runs), default=0))

    def summed(self, x: np.ndarray, square: bool = False) -> np.ndarray:
        """``_moved`` to this end."""
        if x.ndim == 1:
            return self.summed(x[None], square)[0]
        y = np.zeros((len(x), self.n))
        for a, b, heads, rows in self.runs:
            source, w, moved = self.source[a:b], self.w[a:b], self.buffer[: b - a]
            w = w * w if square else w
            for at, row in enumerate(x):
                np.take(row, source, out=moved, mode="clip")
                np.multiply(moved, w, out=moved)
                y[at, rows] = np.add.reduceat(moved, heads)
        return y


class HeldPacked(Packed):
    """A graph of one cell inside a task: a step is two sums over its links."""

    def __init__(self, node: Arrays, cell: tuple, facts: dict):
        super().__init__(None, nodes=Held([(0, ("node", node))]), cells=Held([]), kept=[], **facts)
        self.node, (self.at_src, self.at_dst, self.w) = node, cell
        self._in = self._out = None

    @property
    def arriving(self) -> Side:
        if self._in is None:
            self._in = Side(self.at_dst, self.at_src, self.w, len(self.node["degree"]))
        return self._in

    @property
    def leaving(self) -> Side:
        if self._out is None:
            order = np.argsort(self.at_src, kind="stable")
            self._out = Side(self.at_src[order], self.at_dst[order], self.w[order], len(self.node["degree"]))
        return self._out

    def step(self, state, send, receive):
        own = state.items[0][1][1]
        vectors, notes = send(self.node, own)
        sums = []
        for name, x in vectors:
            x = known(x)
            y = self.leaving.summed(x) if name == "back" else self.arriving.summed(x, name == "square")
            sums.append(y + self.leaving.summed(x) if name == "pull" else y)
        return Held([(0, ("own", receive(self.node, own, sums, np.array(notes, dtype=float))))])

    def keep(self, state):
        return state

    def settle(self, state):
        return state

    def alone(self, run, given=None, size=0):
        return run(self, given)


def held(items: list, facts: dict) -> tuple[HeldPacked, Held | None]:
    """The pack of the node arrays and the cell of a task, and the state among its records."""
    node, own = _met([item for item in items if item[1][0] != "cell"])[:2]
    cell = next(value for _, value in items if value[0] == "cell")
    return HeldPacked(node[0], cell[3:], facts), Held([(0, ("own", own[0]))]) if own else None


def _met(items) -> tuple[dict, dict, dict]:
    """The node arrays, states and partial sums of the groups of a partition."""
    node, own, sums = {}, {}, {}
    for g, value in items:
        if value[0] == "node":
            node[g] = value[1]
        elif value[0] == "own":
            own[g] = value[1]
        else:
            sums.setdefault(g, {})[value[1]] = value[2:]
    return node, own, sums


def packed(adj: DataFrame, extra: dict[str, Column], nodes: DataFrame | None = None) -> Packed | None:
    """Cells of ``adj(src, dst, w)``, materialised already; None if an id is null.

    ``extra`` are more numbers of a node, by its ``id``; ``nodes(id)`` adds nodes that have no link.
    """
    spark, kind = adj.sparkSession, dict(adj.dtypes)["src"]
    if dict(adj.dtypes)["dst"] != kind:
        return None
    sweep(spark)
    row = adj.agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("open")).first()
    links = row["links"]
    if not links or row["open"]:
        return None
    wanted = max(links / CELL_LINKS, min(spark.sparkContext.defaultParallelism, links / SMALLEST_CELL), 1)
    groups = math.ceil((math.sqrt(1 + 8 * wanted) - 1) / 2)
    count = groups * (groups + 1) // 2
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")

    names = ["degree", "out", "dangling", *extra]
    table = node_table(adj)
    if nodes is not None:
        if nodes.where("id IS NULL").limit(1).count():
            return None
        lonely = nodes.select("id").join(table, "id", "left_anti")
        table = table.unionByName(lonely.select("id", F.lit(0.0).alias("out"), F.lit(0.0).alias("degree"), F.lit(True).alias("dangling")))
    listed = table.select(
        group("id").alias("g"), "id", "degree", "out", F.coalesce("dangling", F.lit(False)).cast("double").alias("dangling"),
        *[c.cast("double").alias(name) for name, c in extra.items()])

    def gather(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids = pa.table({"id": rows.column("id")})
        data = {name: [_numbers(rows.column(name)).tobytes()] for name in names}
        return pa.table({"g": rows.column("g").slice(0, 1), "ids": pa.array([_stored(ids)], pa.binary()), **{k: pa.array(v, pa.binary()) for k, v in data.items()}})

    def opened(row) -> tuple[int, tuple]:
        arrays = {name: np.frombuffer(bytes(row[name])) for name in names}
        return row["g"], ("node", {"ids": bytes(row["ids"]), **arrays})

    fields = ", ".join(["g int", "ids binary", *(f"{name} binary" for name in names)])
    given = listed.groupBy("g").applyInArrow(gather, fields).rdd.map(opened)
    id_type = to_arrow_type(adj.schema["src"].dataType)
    empty = {"ids": _stored(pa.table({"id": pa.array([], id_type)})), **{name: np.zeros(0) for name in names}}

    def every(g: int, items):
        """A group without a node has empty arrays."""
        return list(items) or [(g, ("node", empty))]

    seated = given.partitionBy(groups, seat).mapPartitionsWithIndex(every, preservesPartitioning=True)
    seated = seated.persist(StorageLevel.MEMORY_AND_DISK)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += len(batch)
            if rows >= DEALT_LINKS:
                yield from dealt(waiting)
                waiting, rows = [], 0
        if rows:
            yield from dealt(waiting)

    def dealt(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        cell = rows.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        rows = rows.select(["src", "dst", "w"]).take(pa.array(order)).combine_chunks()
        heads = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0))
        for begin, end in zip(heads, [*heads[1:], len(order)]):
            data = pa.array([_stored(rows.slice(begin, end - begin))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([cell[order[begin]]], pa.int32()), data], ["cell", "data"])

    a, b = group("src"), group("dst")
    placed = adj.select(cell_of(F.least(a, b), F.greatest(a, b)).alias("cell"), "src", "dst", F.col("w").cast("double").alias("w"))
    chunks = placed.mapInArrow(deal, "cell int, data binary").rdd.map(lambda row: (row["cell"], ("links", bytes(row["data"]))))

    none = pa.table({"src": pa.array([], id_type), "dst": pa.array([], id_type), "w": pa.array([], pa.float64())})

    def ship_ids(item):
        g, (_, node) = item
        for other in range(groups):
            yield cell_of(min(g, other), max(g, other)), ("ids", g, node["ids"])

    def build(items):
        chunks, ids, cell = [], {}, None
        for cell, value in items:
            if value[0] == "ids":
                ids[value[1]] = _loaded(value[2]).column("id")
            else:
                chunks.append(value[1])
        low, high = min(ids), max(ids)
        lists = [_whole(ids[g]) for g in sorted(ids)]
        both = pa.concat_arrays(lists)
        rows = pa.concat_tables([none, *[_loaded(data).cast(none.schema) for data in sorted(chunks)]])  # in one order, so that a cell made again is the same
        src, dst = (pc.index_in(_whole(rows.column(c)), value_set=both).to_numpy().astype(np.int32) for c in ("src", "dst"))
        w = known(_numbers(rows.column("w")))
        order = np.lexsort((src, dst))
        src, dst, w = src[order], dst[order], w[order]
        heads = np.flatnonzero(np.append(True, (np.diff(src) != 0) | (np.diff(dst) != 0))[: len(src)])
        if len(heads) < len(src):  # a link that comes twice is one of their sum
            src, dst, w = src[heads], dst[heads], np.add.reduceat(w, heads)
        yield cell, ("cell", low, high, src, dst, w)

    listing = seated.flatMap(ship_ids).partitionBy(count, seat)
    cells = chunks.partitionBy(count, seat).union(listing).mapPartitions(build, preservesPartitioning=True)
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    cells.count()
    found = Packed(spark, groups, 0, links, 0.0, 0.0, kind, seated, cells, [])
    rows = found.totals(found.state(lambda node: {}), lambda node, own: np.array(
        [len(node["degree"]), known(node["degree"]).sum(), np.nanmax(node["degree"], initial=-np.inf)]))
    found.n, found.mass, found.top = int(rows[:, 0].sum()), float(rows[:, 1].sum()), float(rows[:, 2].max())
    return found
