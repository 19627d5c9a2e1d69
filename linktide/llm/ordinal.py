"""Ordinal quality classifier on hashed text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.llm.common import others

#: Hash space of the features, labelled rows used for fitting at most, and the
#: documents of the sample in which a feature must occur to get a weight.
FEATURES = 1 << 20
SAMPLE = 12_288
LEAST_DOCUMENTS = 4
#: Steps, step size and penalty of the fit.
STEPS = 200
RATE = 0.1
PENALTY = 1e-4
#: Lengths of word beginnings that are features, and how many distinct words of
#: a text must share one for it to count again.
PREFIXES = (4, 5, 6, 7, 8, 9)
SHARED_BY = (2, 4)
#: Features that a property of the whole text counts for, against hundreds of words.
SHAPE_COPIES = 8
#: A document is selected if P(grade >= GOOD) reaches TAIL.
GOOD = 2
TAIL = 0.5

_OUTER = ".,;:!?\"'()[]{}*$%&#|<>"
_SPREAD = 0x9E3779B1


def _hashed(names: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(n) for n in names), dtype=np.uint64, count=len(names))


def text_features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text.

    Words (lower-cased, outer punctuation off), beginnings of distinct words and
    how many share them, and the shape of the text in steps: shares of symbols,
    capitals and digits, distinct words, mean word length. An empty or null text
    has shape features only.
    """
    raw = text or ""
    words = raw.split()
    kinds = set(raw.lower().split())
    found = {w.strip(_OUTER) for w in kinds}
    starts: Counter[str] = Counter()
    for n in PREFIXES:
        starts.update([w[:n] for w in found if len(w) > n])
    starts.update(["\0" + w[len(w.rstrip(_OUTER)) :] for w in kinds])  # signs at the end of a word
    data = raw.encode("utf-8", "replace")
    solid = max(1, len(data.translate(None, b" \t\n\x0b\f\r")))
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    marks = len(data) - len(data.translate(None, b"#*$%&|<>!"))
    step = lambda x, n: f"{min(n, int(n * x))}"
    size = len(words)
    shape = [
        "\0marks " + step(marks / solid, 20),
        "\0capitals " + step(capitals / solid, 10),
        "\0digits " + step(digits / solid, 10),
        "\0kinds " + step(len(kinds) / max(1, size), 10) + f" {min(6, int(np.log10(size + 1) * 2))}",
        f"\0length {min(20, solid // max(1, size))}",
    ]
    shape = [f"{name} {i}" for name in shape for i in range(SHAPE_COPIES)]
    begun = _hashed(["^" + p for p in starts])
    times = np.fromiter(starts.values(), dtype=np.int64, count=len(starts))
    shared = [begun[times >= n] * np.uint64(_SPREAD) + np.uint64(n) for n in SHARED_BY]
    hashes = np.concatenate([_hashed([*found, *shape]), begun, *shared])
    return np.unique((hashes ^ (hashes >> np.uint64(20))) % np.uint64(FEATURES)).astype(np.int32)


@dataclass(frozen=True)
class Ordinal:
    """P(grade <= j) = 1 / (1 + exp(score - threshold_j)), one score for all grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def cumulative(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -50, 50)))

    def score(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum() / np.sqrt(max(1, len(features))) * SCALE)


#: Scores grow with the square root of the number of features at most.
SCALE = 4.0


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, n_grades: int, least: int = LEAST_DOCUMENTS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, thresholds) of greatest penalised likelihood (Adam, full batch).

    Thresholds are ordered by construction: the first is free, the gaps are
    exponentials. Features in fewer than ``least`` rows get no weight.
    """
    counts = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64), minlength=FEATURES)
    used = np.flatnonzero(counts >= least)
    place = np.full(FEATURES, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    kept = [place[r][place[r] >= 0] for r in rows]
    scale = np.array([SCALE / np.sqrt(max(1, len(r))) for r in rows])
    index = np.concatenate([*kept, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(rows)), [len(k) for k in kept]).astype(np.int32)
    share = np.bincount(grades, minlength=n_grades) + 1.0
    start = np.cumsum(share)[:-1] / share.sum()
    cuts = np.log(start / (1 - start))
    free = np.concatenate([[cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))])
    x = np.concatenate([np.zeros(len(used)), free])
    m, v = np.zeros_like(x), np.zeros_like(x)
    weight = (share.sum() / (n_grades * share))[grades]
    weight = np.sqrt(weight / weight.mean())
    n = max(1, len(rows))
    for t in range(1, STEPS + 1):
        w, gaps = x[: len(used)], np.exp(x[len(used) + 1 :])
        theta = x[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(owner, weights=w[index], minlength=len(rows)) * scale
        cdf = 1 / (1 + np.exp(np.clip(s[:, None] - theta[None, :], -50, 50)))
        padded = np.concatenate([np.zeros((len(rows), 1)), cdf, np.ones((len(rows), 1))], axis=1)
        at = np.arange(len(rows))
        p = np.maximum(padded[at, grades + 1] - padded[at, grades], 1e-12)
        slope = padded * (1 - padded)  # d cdf / d theta
        upper, lower = slope[at, grades + 1] / p, slope[at, grades] / p
        ds = (upper - lower) * weight / n  # of the loss by the score
        g_theta = np.zeros(n_grades - 1)
        inner = grades < n_grades - 1
        np.add.at(g_theta, grades[inner], -(upper * weight / n)[inner])
        np.add.at(g_theta, grades[grades > 0] - 1, (lower * weight / n)[grades > 0])
        above = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([
            np.bincount(index, weights=(ds * scale)[owner], minlength=len(used)) + PENALTY * w,
            [above[0]],
            above[1:] * gaps,
        ])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(x[len(used) + 1 :])
    return used, x[: len(used)], x[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good; the worst of repeated labels.

    Rows without ``doc_id`` and rows that say neither are left out.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rows = labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null")
    return rows.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample: int = SAMPLE) -> Ordinal | None:
    """Fit on at most ``sample`` rated documents, chosen by the hash of their id.

    ``ratings`` is (doc_id, grade). The bound makes the chosen ids safe to
    broadcast and the fit fit one task; only the weights of features that occur,
    at most ``FEATURES`` numbers, reach the driver. None if nothing is rated.
    """
    spark = docs.sparkSession
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text", "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "grade": batch["grade"],
                "features": [text_features(t) for t in batch["text"]],
            })

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        found = fit_ordinal([np.asarray(r) for r in rows["features"]], rows["grade"].to_numpy(np.int64), n_grades)
        return pd.DataFrame({"features": [found[0]], "weights": [found[1]], "thresholds": [found[2]]})

    made = texts.mapInPandas(features, "doc_id bigint, grade int, features array<int>")
    model = (
        made.groupBy(F.lit("all").alias("__fit")).applyInPandas(fit, "features array<bigint>, weights array<double>, thresholds array<double>")
    ).collect()
    if not model:
        return None
    weights = np.zeros(FEATURES, dtype=np.float32)
    weights[np.array(model[0]["features"], dtype=np.int64)] = model[0]["weights"]
    return Ordinal(weights, np.array(model[0]["thresholds"]))


def rate(docs: DataFrame, model: Ordinal | None, text: str | Column = "text", good: int = GOOD) -> DataFrame:
    """Every row with ``expected_grade`` and ``tail``, P(grade >= ``good``).

    Without a model (no rated document) both are null. Texts are read whole, map-side.
    """
    given = others(docs, "expected_grade", "tail")
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(*given, none.alias("expected_grade"), none.alias("tail"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        scores = np.array([own.score(text_features(t)) for t in texts])
        below = own.cumulative(scores)
        return pd.DataFrame({"expected_grade": (1 - below).sum(axis=1), "tail": 1 - below[:, good - 1]})

    rows = docs.select(*given, judged(text).alias("__rated"))
    return rows.select(*given, "__rated.expected_grade", "__rated.tail")


def select_good(docs: DataFrame, labels: DataFrame, tail: float = TAIL) -> DataFrame:
    """The documents whose tail probability reaches ``tail``; all if nothing is rated."""
    rated = rate(docs, train(docs, graded(labels)))
    return rated.where(F.coalesce(F.col("tail") >= tail, F.lit(True))).select(*docs.columns)
