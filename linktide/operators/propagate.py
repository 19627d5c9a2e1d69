"""Sparse matrix times vector as one join and one aggregation.

The matrix is a cached table of entries, hash-partitioned by column id; every
node also has one *self* entry that holds its static attributes and carries
state across a step. A step joins the state to the entries on the column id and
sums per row id. The sums leave the aggregation partitioned by id, which is what
the next join needs, so each step costs exactly one shuffle of partial sums, and
a chain of steps is one linear plan that reads the previous state once.

A column with very many entries is divided into salted parts; its state row is
copied to each part after the aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linktide.operators.graph import node_table
from linktide.operators.keyed import attach, ratio
from linktide.operators.packed import Packed, packed
from linktide.session import settle

ENTRIES_PER_TASK = 2_000_000
SMALLEST_TASK = 25_000
STEPS_PER_PLAN = 8


@contextmanager
def planned_for(table: "EntryTable") -> Iterator[None]:
    """Plan the enclosed steps with the table's number of shuffle partitions.

    The entries already have a balanced layout that every step's aggregation
    lines up with, so adaptive re-planning is switched off for the loop, and
    generated classes lose their stage number so that the identical code of
    successive steps is compiled once. With many graphs of which one is large,
    the joins of per-graph values need adaptive skew handling, so it stays on.
    """
    spark = table.spark
    wanted = {
        "spark.sql.shuffle.partitions": str(table.width),
        "spark.sql.adaptive.enabled": str(table.uneven).lower(),
        "spark.sql.codegen.useIdInClassName": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def own(value: Column) -> Column:
    """Sum that carries a value of the node itself through a step."""
    return F.sum(F.when(F.col("self"), value))


def static(name: str) -> Column:
    """Static node attribute, read from the self entry."""
    return F.max(F.when(F.col("self"), F.col(name)))


def arriving(coefficient: str, value: Column) -> Column:
    """Sum over entries of coefficient times the sender's value."""
    return F.sum(F.col(coefficient) * value)


@dataclass
class EntryTable:
    """Entries (id -> to) of one graph, or of many graphs told apart by ``keys``."""

    entries: DataFrame
    keys: tuple[str, ...]
    width: int
    salted: bool
    n: int
    uneven: bool = False
    cached: list[DataFrame] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def step(self, state: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
        """Next state: one row per node with the given aggregates."""
        on = [*self.keys, "id"]
        aggregates = [e.alias(n) for n, e in sums.items()]
        if self.salted:
            state = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
            state = state.drop("copies")
            on.append("salt")
            aggregates.append(static("copies_of").alias("copies"))
        # The build side holds at most ENTRIES_PER_TASK nodes per partition.
        joined = self.entries.join(state.hint("shuffle_hash"), on)
        return joined.groupBy(*self.keys, F.col("to").alias("id")).agg(*aggregates)

    def per_node(self, **columns: Column) -> DataFrame:
        """A state built from the self entries."""
        extra = [F.col("copies_of").alias("copies")] if self.salted else []
        return self.entries.where("self").select(
            *self.keys, "id", *[c.alias(n) for n, c in columns.items()], *extra
        )

    def state_of(self, values: DataFrame, **columns: Column) -> DataFrame:
        """A state from a value table; nodes it lacks get nulls, so coalesce."""
        base = self.per_node()
        joined = base.join(values, [*self.keys, "id"], "left")
        extra = ["copies"] if self.salted else []
        return joined.select(*self.keys, "id", *[c.alias(n) for n, c in columns.items()], *extra)

    def settle(self, state: DataFrame) -> DataFrame:
        return settle(state)

    def derive(self, **columns: Column) -> "EntryTable":
        """The same cached entries with more coefficient columns, computed as they are read."""
        entries = self.entries.select("*", *[c.alias(n) for n, c in columns.items()])
        return EntryTable(entries, self.keys, self.width, self.salted, self.n, self.uneven, self.cached)

    def with_static(self, values: DataFrame, columns: list[str]) -> "EntryTable":
        """Entries whose rows also hold per-graph values (many-graph tables only)."""
        wider = attach(self.entries, values.select(*self.keys, *columns), list(self.keys))
        order = [*self.keys, "id"] + (["salt"] if self.salted else [])
        wider = wider.repartition(self.width, *order)
        wider = wider.persist(StorageLevel.MEMORY_AND_DISK)
        return EntryTable(
            wider, self.keys, self.width, self.salted, self.n, self.uneven,
            [*self.cached, wider],
        )

    @property
    def listed(self) -> bool:
        """Whether the rows are there already."""
        return True

    def cells(self) -> Packed | None:
        """The graph as packed cells, if it is one graph that can be."""
        return None

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()

    def release_beyond(self, base: "EntryTable") -> None:
        """Release what was cached since ``base``."""
        for df in self.cached[len(base.cached) :]:
            df.unpersist()


def start_value(id_type: str) -> Column:
    """Fixed start in [0.5, 1.5), spread by the golden ratio and decided by the id alone."""
    integral = id_type in ("bigint", "int", "smallint", "tinyint")
    turn = (F.col("id") if integral else F.xxhash64("id") % 1_000_003).cast("double") * 0.6180339887498949
    return turn - F.floor(turn) + 0.5


class GraphTable(EntryTable):
    """One graph, as entries and as packed cells; each is made when it is first asked for."""

    keys = ()

    def __init__(self, adj: DataFrame, nodes: DataFrame | None):
        self._adj, self._nodes = settle(adj), nodes
        self._made: EntryTable | None = None
        self._cells: Packed | None = None
        self._packs = True

    @property
    def spark(self) -> SparkSession:
        return self._adj.sparkSession

    @property
    def id_type(self) -> str:
        return dict(self._adj.dtypes)["src"]

    @property
    def listed(self) -> bool:
        return self._made is not None

    def __getattr__(self, name: str):
        if name not in ("entries", "width", "salted", "n", "cached"):
            raise AttributeError(name)
        if name == "n" and self._made is None and self._cells is not None:
            return self._cells.n
        if self._made is None:
            self._made = row_entries(self._adj, (), None, self._nodes)
        return getattr(self._made, name)

    def cells(self) -> Packed | None:
        if self._packs and self._cells is None:
            self._cells = packed(self._adj, {"start": start_value(self.id_type)}, self._nodes)
            self._packs = self._cells is not None
        return self._cells

    def release(self) -> None:
        if self._made is not None:
            self._made.release()
        if self._cells is not None:
            self._cells.release()


def entry_table(
    adj: DataFrame,
    keys: tuple[str, ...] = (),
    hub: int | None = None,
    nodes: DataFrame | None = None,
) -> EntryTable:
    """The table of ``adj(src, dst, w)``; see ``row_entries`` for its rows."""
    if keys or hub is not None:
        return row_entries(adj, keys, hub, nodes)
    return GraphTable(adj, nodes)


def row_entries(
    adj: DataFrame,
    keys: tuple[str, ...] = (),
    hub: int | None = None,
    nodes: DataFrame | None = None,
) -> EntryTable:
    """Build the cached entries of ``adj(src, dst, w)``.

    ``nodes(id)`` adds nodes that have no link.

    Columns: ``t`` transition weight, ``s`` symmetric weight, ``a`` the weight
    of id -> to and ``b`` that of to -> id; on self entries ``degree``,
    ``prior``, ``dangling``, ``out``, ``size``.
    """
    keys = tuple(keys)
    if keys or hub is not None:
        adj = settle(adj)
    table = node_table(adj, keys)
    if nodes is not None:
        lonely = nodes.select(*keys, "id").join(table, [*keys, "id"], "left_anti").select(
            *keys, "id", F.lit(0.0).alias("out"), F.lit(0.0).alias("degree"),
            F.lit(True).alias("dangling"),
        )
        table = settle(table.unionByName(lonely))
    outs = adj.groupBy(*keys, "src").agg(F.sum("w").alias("__out"))
    walk = attach(adj, outs, [*keys, "src"])
    zero, loop = F.lit(0.0), F.col("src") == F.col("dst")

    def entry(source: str, target: str, t: Column, s: Column, a: Column, b: Column) -> Column:
        named = {"id": F.col(source), "to": F.col(target), "t": t, "s": s, "a": a, "b": b}
        return F.struct(*[c.alias(n) for n, c in named.items()])

    w = F.col("w")
    forward = entry("src", "dst", ratio(w, F.col("__out")), F.when(loop, 2 * w).otherwise(w), w, F.when(loop, w).otherwise(zero))
    back = entry("dst", "src", zero, w, zero, w)
    both = F.when(F.col("src") != F.col("dst"), F.array(forward, back)).otherwise(F.array(forward))
    pieces = walk.select(*keys, F.explode(both).alias("__e")).select(*keys, "__e.*")
    links = pieces.groupBy(*keys, "id", "to").agg(
        *[F.sum(c).alias(c) for c in ("t", "s", "a", "b")]
    )
    links = settle(links)
    mass = table.groupBy(*keys).agg(F.sum("degree").alias("__mass"), F.count("id").alias("size"))
    if keys:
        mass = settle(mass)
        table = attach(table, mass, keys)
    else:
        table = table.join(F.broadcast(mass))
    selves = table.select(
        *keys,
        "id",
        F.col("id").alias("to"),
        *[F.lit(0.0).alias(c) for c in ("t", "s", "a", "b")],
        F.lit(True).alias("self"),
        "degree",
        ratio(F.col("degree"), F.col("__mass")).alias("prior"),
        "dangling",
        "out",
        "size",
    )
    return laid_out(links, selves, keys, hub, table.count() if nodes is not None else None)


def laid_out(
    links: DataFrame, selves: DataFrame, keys: tuple[str, ...], hub: int | None = None, n: int | None = None
) -> EntryTable:
    """The cached table of ``links(id, to, ...)`` and of ``selves``, one row per node.

    ``links`` is materialised already. A column with too many links is dealt to salted parts.
    """
    spark = links.sparkSession
    counts = links.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("c"))
    top = counts.agg(F.sum("c").alias("e"), F.max("c").alias("m"), F.count("c").alias("n")).first()
    total, biggest, n = top["e"] or 0, top["m"] or 0, top["n"] if n is None else n
    width = max(
        1,
        min(spark.sparkContext.defaultParallelism, -(-total // SMALLEST_TASK)),
        -(-total // ENTRIES_PER_TASK),
    )
    chunk = hub or max(ENTRIES_PER_TASK // 4, -(-total // (4 * width)))
    salted = biggest > chunk
    uneven = False
    if keys:
        sizes = selves.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        largest = sizes.agg(F.max("c")).first()[0] or 0
        uneven = largest > max(SMALLEST_TASK, 2 * n // width)
    order = [*keys, "id"]
    if salted:
        copies = counts.select(*keys, "id", F.ceil(F.col("c") / chunk).cast("int").alias("k"))
        hot = copies.where("k > 1")  # fewer rows than total / chunk
        links = links.join(F.broadcast(hot), order, "left").select(
            *links.columns,
            F.pmod(F.xxhash64("to"), F.coalesce("k", F.lit(1))).cast("int").alias("salt"),
        )
        selves = selves.join(F.broadcast(hot), order, "left").select(
            *selves.columns,
            F.lit(0).alias("salt"),
            F.coalesce("k", F.lit(1)).alias("copies_of"),
        )
        order.append("salt")
    merged = links.withColumn("self", F.lit(False)).unionByName(selves, allowMissingColumns=True)
    placed = merged.repartition(width, *order)
    placed = placed.persist(StorageLevel.MEMORY_AND_DISK)
    return EntryTable(placed, keys, width, salted, n, uneven, [placed])


def spmv(entries: DataFrame, vector: DataFrame) -> DataFrame:
    """y = A x for ``entries(row, col, w)`` and ``vector(id, x)``."""
    joined = entries.join(vector.withColumnRenamed("id", "col"), "col")
    return joined.groupBy(F.col("row").alias("id")).agg(
        F.sum(F.col("w") * F.col("x")).alias("y")
    )
