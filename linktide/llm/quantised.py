"""Near-duplicate vectors: product quantisation over coarse lists, exact cosine at the end."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.llm.common import others
from linktide.operators.keyed import attach
from linktide.operators.neighbourhood import components
from linktide.session import settle

COSINE = 0.98
#: Distinct vectors that fit the quantiser, those of the smallest hashes.
SAMPLE = 4096
#: Coarse lists for up to LIST_BASE distinct vectors; twice as many for four times the vectors.
LISTS, LIST_BASE, MOST_LISTS = 8, 50_000, 1024
#: Dimensions of a subspace, codes of a subspace.
SUBSPACE, CODES = 8, 64
#: Rows of a list that meet in one task.
CHUNK = 2048
#: Queries that are compared at once in a task.
STRIP = 256
#: Lists above CHUNK that may be broadcast (their sizes, a few bytes each).
HOT_ROWS = 200_000
#: Slack for single-precision table look-ups.
SLACK = 1e-3


@dataclass
class Quantiser:
    """Coarse centroids and, per subspace, the code vectors of residuals."""

    coarse: np.ndarray  # lists x width
    books: np.ndarray  # subspaces x codes x SUBSPACE

    @property
    def width(self) -> int:
        return self.coarse.shape[1]

    def unit(self, vectors) -> np.ndarray:
        """Rows of length one in double precision, filled up with zeros to the common width."""
        bounds = vectors.offsets.to_numpy()
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.diff(bounds)
        out = np.zeros((len(sizes), self.width))
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(values)) - np.repeat(bounds[:-1] - bounds[0], sizes)] = values
        return _unit(out)

    def parts(self, residual: np.ndarray) -> np.ndarray:
        """Residuals cut into subspaces: subspaces x rows x SUBSPACE."""
        count = len(self.books)
        padded = np.zeros((len(residual), count * SUBSPACE))
        padded[:, : self.width] = residual
        return padded.reshape(len(residual), count, SUBSPACE).transpose(1, 0, 2)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x subspaces) and the distance to what they decode to."""
        codes, lost = [], np.zeros(len(residual))
        for part, book in zip(self.parts(residual), self.books):
            apart = _apart(part, book)
            code = apart.argmin(1)
            codes.append(code.astype(np.uint8))
            lost += ((part - book[code]) ** 2).sum(1)
        return np.stack(codes, 1), np.sqrt(lost)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distance of every query part to every code: subspaces x rows x codes."""
        return np.stack([_apart(p, b) for p, b in zip(self.parts(residual), self.books)]).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _apart(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows x centres."""
    return np.maximum((rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1), 0)


def _means(rows: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly taken rows; an empty centre stays where it is."""
    centres = rows[np.arange(count) * len(rows) // count].copy()
    for _ in range(rounds):
        own = _apart(rows, centres).argmin(1)
        for c in range(count):
            mine = rows[own == c]
            if len(mine):
                centres[c] = mine.mean(0)
    return centres


def fit(vectors: list[list[float]], width: int, lists: int) -> Quantiser:
    """A quantiser from a bounded sample; needs one vector at least."""
    rows = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        rows[i, : len(v)] = v
    rows = _unit(rows)
    coarse = _means(rows, lists)
    residual = rows - coarse[_apart(rows, coarse).argmin(1)]
    empty = Quantiser(coarse, np.zeros((-(-width // SUBSPACE), 1, SUBSPACE)))
    return Quantiser(coarse, np.stack([_means(p, CODES) for p in empty.parts(residual)]))


def _near_lists(model: Quantiser, unit: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Own list of every row, and whether it must look into a list of a higher number.

    A vector within ``radius`` of x is in list c only if x is within ``radius`` of
    the plane halfway between c and the own centre of x. So these probes suffice.
    """
    apart = _apart(unit, model.coarse)
    own = apart.argmin(1)
    gaps = np.sqrt(_apart(model.coarse, model.coarse))[own]
    beyond = apart - apart[np.arange(len(own)), own][:, None] <= 2 * (radius + 1e-6) * gaps + 1e-9
    return own, beyond & (np.arange(len(model.coarse)) > own[:, None])


def _visits(model: Quantiser, radius: float, whole: bool):
    """A row per list a vector belongs to or must look into, with codes if ``whole``."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = model.unit(batch.column(batch.schema.get_field_index("vec")))
            own, more = _near_lists(model, unit, radius)
            more[np.arange(len(own)), own] = True
            row, to = np.nonzero(more)
            member = to == own[row]
            taken = batch.take(pa.array(row))
            columns = [taken.column(0), taken.column(1), pa.array(to.astype(np.int32))]
            names = ["label", "dim", "list"]
            if whole:
                codes, lost = model.encode(unit - model.coarse[own])
                columns += [taken.column(c) for c in (2, 3, 4)]
                columns += [pa.array(member), pa.array([c.tobytes() for c in codes[row]], pa.binary()), pa.array(lost[row])]
                names += ["key", "size", "vec", "member", "code", "lost"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return visit


class _Sets:
    """Union-find over the rows of a task; a set is named by its smallest row."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.up[rows]
        while (self.up[found] != found).any():
            found = self.up[found]
        self.up[rows] = found
        return found

    def merge(self, rows: np.ndarray) -> None:
        roots = np.unique(self.roots(rows))
        self.up[roots] = roots[0]


def _compared(model: Quantiser, cosine: float, radius: float):
    """Links inside a cell: per linked row its number of links and the row that names its set."""

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks().sort_by("key")
        get = lambda name: cell.column(name).to_numpy()
        member, half, size, lost = get("member"), get("half"), get("size"), get("lost")
        unit = model.unit(cell.column("vec").combine_chunks())
        centre = model.coarse[int(cell.column("list")[0].as_py())]
        codes = np.frombuffer(b"".join(cell.column("code").to_pylist()), np.uint8).reshape(len(unit), -1)
        sets, links = _Sets(len(unit)), np.zeros(len(unit), np.int64)

        def meet(queries: np.ndarray, index: np.ndarray, mutual: bool) -> None:
            """``mutual``: every pair of two members comes up in both orders."""
            for start in range(0, len(queries) if len(index) else 0, STRIP):
                q = queries[start : start + STRIP]
                table = model.tables(unit[q] - centre)
                apart = np.zeros((len(q), len(index)), np.float32)
                for part in range(len(table)):
                    apart += table[part][:, codes[index, part]]
                near = apart <= (radius + lost[index] + SLACK).astype(np.float32) ** 2
                near &= q[:, None] != index[None, :]
                some = np.flatnonzero(near.any(0))
                linked = near[:, some] & (unit[q] @ unit[index[some]].T >= cosine)
                for i in np.flatnonzero(linked.any(1)):
                    met = index[some[linked[i]]]
                    links[q[i]] += size[met].sum()
                    if not (mutual and member[q[i]]):
                        links[met] += size[q[i]]
                    sets.merge(np.append(met, q[i]))

        rows = np.arange(len(unit))
        if cell.column("i")[0] == cell.column("j")[0]:
            meet(rows, rows[member], True)
        else:
            meet(rows[half == 1], rows[member & (half == 0)], False)
            meet(rows[~member & (half == 0)], rows[member & (half == 1)], False)
        out = np.flatnonzero(links)
        keys = cell.column("key").combine_chunks()
        return pa.table({"key": keys.take(pa.array(out)), "links": pa.array(links[out]),
                         "root": keys.take(pa.array(sets.roots(out)))})

    return compare


def _usable(vec: Column, label: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def linked_vectors(
    vectors: DataFrame,
    name: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    lists: int | None = None,
    chunk: int = CHUNK,
    sample: int = SAMPLE,
) -> DataFrame:
    """Every row with ``n_links, component_id, kept``.

    Two rows link if their labels are equal and not null, their vectors have one
    length and their cosine in double precision is at least ``cosine``. A vector
    that is null, empty, zero or holds a null or non-finite component links with
    nothing. ``component_id`` is the smallest id reachable over links (null ids
    do not count), ``kept`` whether it is the row's own; repeated rows link with each
    other like any two rows. An empty table gives an empty result.

    Equal vectors of a label are one row with a count from here on, so a group of
    copies costs one row per map task. The quantiser is fitted on ``sample`` distinct vectors.
    A vector is indexed in the list of its nearest centre, as codes of its residual
    per subspace, with the distance that the codes lose. It looks into every list that
    can hold a neighbour (of two lists, only from the lower number), where table
    look-ups give its distance to each decoded row; rows nearer than the radius plus
    their lost distance are compared exactly. No link is lost, whatever the quantiser. A list
    of more than ``chunk`` rows is dealt out, and pairs of chunks meet; a task passes on
    counts and one edge a row to the row that names its set, never pairs.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    given = others(vectors, "n_links", "component_id", "kept")
    hashed = lambda seed: F.hex(F.xxhash64(F.lit(seed), F.col(label), F.col(vector)))
    key = F.when(
        _usable(F.col(vector), F.col(label)),
        F.concat(F.lpad(hashed(1), 16, "0"), F.lpad(hashed(2), 16, "0")),
    )
    rows = vectors.select(
        *given, key.alias("__key"), F.col(label).alias("__label"), F.col(vector).alias("__vec"), F.col(name).alias("__id")
    )
    distinct = settle(
        rows.where("__key IS NOT NULL").groupBy("__key").agg(
            F.first("__label").alias("label"), F.first("__vec").alias("vec"),
            F.count(F.lit(1)).alias("size"), F.min("__id").alias("first"))
        .select("label", F.size("vec").alias("dim"), F.col("__key").alias("key"), "size", "vec", "first")
    )
    count, width = distinct.agg(F.count(F.lit(1)), F.max("dim")).first()
    blank = rows.select(*given, F.lit(0).cast("bigint").alias("n_links"), F.col("__id").alias("component_id"),
                        F.lit(True).alias("kept"))
    if not count:
        return blank
    if lists is None:
        lists = min(MOST_LISTS, LISTS * 2 ** max(0, int(math.log(count / LIST_BASE, 4))))
    chosen = [r[0] for r in distinct.orderBy("key").select("vec").limit(sample).collect()]
    model = fit(chosen, width, min(lists, len(chosen)))
    places, kind = ["label", "dim", "list"], dict(distinct.dtypes)
    table = distinct.select("label", "dim", "key", "size", "vec")
    place = f"label {kind['label']}, dim int, list int"
    held = table.mapInArrow(_visits(model, radius, False), place).groupBy(*places).agg(
        F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    hot = settle(held.where("chunks > 1"))
    visits = table.mapInArrow(
        _visits(model, radius, True),
        f"{place}, key string, size bigint, vec {kind['vec']}, member boolean, code binary, lost double")
    if hot.limit(HOT_ROWS + 1).count() <= HOT_ROWS:
        dealt = visits.join(F.broadcast(hot), places, "left")
    else:
        dealt = attach(visits, hot, places)
    chunks = F.coalesce("chunks", F.lit(1))
    mine = F.pmod(F.xxhash64("key"), chunks).cast("int")
    dealt = dealt.withColumn("mine", mine).select(
        *visits.columns, "mine", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    cells = dealt.select(
        *visits.columns, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        (F.col("mine") > F.col("other")).cast("int").alias("half"))
    met = settle(
        cells.groupBy(*places, "i", "j").applyInArrow(_compared(model, cosine, radius), "key string, links bigint, root string"))
    named = components(met.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = named.select(F.col("id").alias("key"), F.col("component").alias("set"))
    links = met.groupBy("key").agg(F.sum("links").alias("links"))
    known = distinct.select("key", "size", "first").join(links, "key", "left").join(named, "key", "left")
    known = settle(known.select("key", "first", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                F.coalesce("set", "key").alias("set")))
    smallest = known.groupBy("set").agg(F.min("first").alias("component_id"))
    known = attach(known, smallest, ["set"]).select(F.col("key").alias("__key"), "n_links", "component_id")
    joined = attach(rows.where("__key IS NOT NULL").select(*given, "__key", "__id"), known, ["__key"])
    done = joined.select(*given, "n_links", "component_id",
                         F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))
    single = rows.where("__key IS NULL").select(
        *given, F.lit(0).cast("bigint").alias("n_links"), F.col("__id").alias("component_id"), F.lit(True).alias("kept"))
    return done.unionByName(single)
