"""Near-duplicates by the Jaccard similarity of their word shingles.

MinHash bands propose, exact sets decide: every band of ``ROWS`` minima is a
bucket, and inside a bucket the whole shingle sets are compared, so no pair
below the similarity is linked. A pair at similarity ``s`` shares no bucket with
probability ``(1 - s ** ROWS) ** BANDS``: 6e-5 at 0.8, 3e-8 at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linktide.llm import simhash
from linktide.llm.common import text_of
from linktide.operators.keyed import attach
from linktide.operators.neighbourhood import components
from linktide.session import settle

#: Words of a shingle, and similarity of a link.
SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: Minima of a bucket key, and keys of a text.
ROWS = 6
BANDS = 32
#: Sets of a bucket that one task compares at most; larger buckets are compared
#: in pairs of chunks.
CHUNK = 1024
#: Shingles that are hashed together, and bytes of sets handed on together.
PIECE = 256
FLUSH = 8 << 20

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one UTF-8 text.

    A-Z are lower-cased; a shorter text is one shingle, a text without words has none.
    """
    words = (text or b"").lower().split()  # bytes methods: ASCII letters and white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    last = max(1, len(words) - shingle + 1)
    hashes = (xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(last))
    return np.unique(np.fromiter(hashes, dtype=np.uint64, count=last))


def band_keys(grams: np.ndarray) -> np.ndarray:
    """Bucket keys of a set, one a band; none for the empty set."""
    if not len(grams):
        return np.zeros(0, dtype=np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for begin in range(0, len(grams), PIECE):
        part = grams[begin : begin + PIECE, None]
        np.minimum(least, (part * _FACTORS + _OFFSETS).min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    digests = (xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in bands)
    return np.fromiter(digests, dtype=np.uint64, count=BANDS).view(np.int64)


def _name(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).view(np.int64)) if len(grams) else 0


def described(shingle: int) -> Column:
    """(fp, bands) of every whole text: the name of its shingle set, and its bucket keys."""

    @F.pandas_udf("fp bigint, bands array<bigint>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, shingle) for t in texts]
        return pd.DataFrame({"fp": [_name(s) for s in sets], "bands": [band_keys(s) for s in sets]})

    return of(text_of().cast("binary"))


def similar(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Stars (root, member) that join what pairs of ``similarity`` join.

    A breadth-first search that compares a set only with those not yet reached.
    """
    sizes = np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [at[e - n : e] for e, n in zip(ends, sizes)]
    owner = np.repeat(np.arange(len(sets)), sizes)
    open_, stars = np.ones(len(sets), dtype=bool), []
    mark = np.zeros(int(at.max()) + 1, dtype=bool)
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue and open_.any():
            q = queue.pop()
            mark[own[q]] = True
            common = np.bincount(owner[mark[at]], minlength=len(sets))
            mark[own[q]] = False
            near = open_ & (common >= similarity * (sizes + sizes[q] - common) - 1e-9)
            if near.any():
                found = np.flatnonzero(near).tolist()
                queue.extend(found)
                stars.extend((root, f) for f in found)
                open_ &= ~near
                stay = open_[owner]
                at, owner = at[stay], owner[stay]
    return stars


_SETS = pa.schema(
    [("band", pa.int32()), ("key", pa.int64()), ("cell", pa.int64()), ("fp", pa.int64()), ("grams", pa.binary())]
)
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _dealt(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket a text is wanted in, with its whole set: (text, fp, buckets) in."""
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in _SETS]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SETS)], schema=_SETS)

    for batch in batches:
        out, held = [], 0
        for text, fp, buckets in zip(*(c.to_pylist() for c in batch.columns)):
            grams = shingle_set(text, shingle).tobytes()
            for b in buckets:
                out.append((b["band"], b["key"], b["cell"], fp, grams))
                held += len(grams)
                if held > FLUSH:
                    yield batch_of(out)
                    out, held = [], 0
        yield batch_of(out)


def _link_runs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links inside each run of equal (band, key, cell) of sorted rows."""

    def linked(prints: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        stars = similar(sets, similarity) if len(sets) > 1 else []
        a, b = ([prints[s[side]] for s in stars] for side in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)

    last, prints, sets = None, [], []
    for batch in batches:
        for band, key, cell, fp, grams in zip(*(c.to_pylist() for c in batch.columns)):
            if (band, key, cell) != last:
                if len(sets) > 1:
                    yield linked(prints, sets)
                last, prints, sets = (band, key, cell), [], []
            if not prints or prints[-1] != fp:  # repeated rows of one text
                prints.append(fp)
                sets.append(np.frombuffer(grams, dtype=np.uint64))
    yield linked(prints, sets)


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def links(
    docs: DataFrame, marked: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, chunk: int = CHUNK
) -> DataFrame:
    """(a, b): stars that connect the sets ``fp`` of at least ``similarity``.

    ``marked`` is (row, fp, bands). Buckets of one set are dropped, and of buckets
    with the same members one stays, so a pair of copies is compared once. Only
    sets of the remaining buckets are shuffled; buckets above ``chunk`` are dealt
    out as pairs of chunks.
    """
    one = marked.groupBy("fp").agg(F.min(F.struct("row", "bands")).alias("__one")).select("fp", "__one.*")
    posted = one.select("fp", "row", F.posexplode("bands").alias("band", "key"))
    buckets = posted.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("fp").alias("__x"), F.bit_xor(F.xxhash64("fp")).alias("__y")
    )
    kept = (
        buckets.where("n > 1").groupBy("n", "__x", "__y").agg(F.min(F.struct("band", "key")).alias("__b"))
        .select("__b.band", "__b.key", "n")
    )
    chunks = F.ceil(F.col("n") / F.lit(chunk))
    own = F.pmod(F.xxhash64("fp"), chunks)
    cells = F.when(F.col("n") <= chunk, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), chunks - 1),
            lambda j: F.least(own, j) * chunks + F.greatest(own, j),
        )
    )
    wanted = (
        attach(posted, kept, ["band", "key"], "inner")
        .select("row", "fp", "band", "key", F.explode(cells).alias("cell"))
        .groupBy("row", "fp").agg(F.collect_list(F.struct("band", "key", "cell")).alias("buckets"))
    )
    texts = docs.select(_row_key().alias("row"), text_of().cast("binary").alias("text"))
    sets = attach(texts, wanted, ["row"], "inner").select("text", "fp", "buckets").mapInArrow(
        lambda it: _dealt(it, shingle), "band int, key bigint, cell bigint, fp bigint, grams binary"
    )
    runs = sets.repartition("band", "key", "cell").sortWithinPartitions("band", "key", "cell", "fp")
    return runs.mapInArrow(lambda it: _link_runs(it, similarity), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, row, fp, root), a row per row of ``docs``: ``root`` tells components apart.

    ``row`` is a hash of id and text. Equal sets are one component, so are all texts without words.
    """
    made = docs.select("doc_id", _row_key().alias("row"), described(shingle).alias("__d"))
    marked = settle(made.select("doc_id", "row", "__d.fp", "__d.bands"))
    stars = settle(links(docs, marked, similarity, shingle, chunk))  # read twice, dealt once
    roots = components(stars).toDF("fp", "root")
    return attach(marked.select("doc_id", "row", "fp"), roots, ["fp"]).withColumn("root", F.coalesce("root", "fp"))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component of ``found`` (doc_id, row, root) the row of smallest id, with its own columns.

    Rows without ``doc_id`` stay.
    """
    found = settle(found.where("doc_id is not null"))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("__first"))
    losers = found.select("row").distinct().join(first.select("__first.row"), "row", "left_anti")
    left = docs.withColumn("__key", _row_key()).join(losers.withColumnRenamed("row", "__key"), "__key", "left_anti")
    again = Window.partitionBy("__key").orderBy("doc_id")  # rows of equal id and text
    numbered = left.withColumn("__row", F.row_number().over(again))
    return numbered.where("__row = 1 or doc_id is null").select(*docs.columns)


def with_fingerprints(docs: DataFrame, found: DataFrame, distance: int = simhash.DISTANCE) -> DataFrame:
    """(doc_id, row, root): ``found`` (doc_id, row, fp, root) joined further by SimHash links.

    Texts whose fingerprints differ in at most ``distance`` bits are one component too, so are
    components that share a member. Only groups of more than one are searched for shared members.
    """
    prints = settle(docs.select(_row_key().alias("row"), simhash.fingerprint().alias("print")).distinct())
    near = components(simhash.links(prints.select(F.col("print").alias("fp")), distance)).toDF("print", "__near")
    alike = attach(prints, near, ["print"]).select("row", F.coalesce("__near", "print").alias("near"))
    rows = settle(attach(found.select("doc_id", "row", "root"), alike, ["row"]))
    pairs = settle(rows.select("root", "near").distinct())
    several = lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(c)
    shared = pairs.join(several("near"), "near", "left_semi")
    joined = shared.unionByName(pairs.join(several("root"), "root", "left_semi")).distinct()
    named = lambda c: F.concat(F.lit(f"{c} "), F.col(c).cast("string"))
    whole = components(joined.select(named("near").alias("a"), named("root").alias("b"))).toDF("__name", "__whole")
    placed = attach(rows.withColumn("__name", named("root")), whole, ["__name"])
    return placed.select("doc_id", "row", F.coalesce("__whole", "__name").alias("root"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, distance: int | None = None) -> DataFrame:
    """One document of each component of near-duplicates, the one of smallest id.

    With ``distance`` SimHash fingerprints that differ in at most as many bits are links as well.
    """
    found = near_duplicates(docs, similarity, shingle)
    if distance is not None:
        found = with_fingerprints(docs, found, distance)
    return first_of_each(docs, found)
