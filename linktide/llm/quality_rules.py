"""Quality rules whose cutoffs limit false rejections with proven confidence."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.llm.common import SPACES, let, others, text_of, words_of
from linktide.operators.keyed import attach

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Share of good documents that the rules together may reject in a stratum, and
#: the chance that this promise fails in any stratum.
RISK = 0.05
FAILURE = 0.05
#: Candidate cutoffs, from lenient to strict; a document is rejected above.
CUTOFFS: dict[str, Sequence[float]] = {
    "symbol_share": (1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05),
    "repeated_line_share": (0.7, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeated_word_share": (0.18, 0.15, 0.12, 0.1, 0.07, 0.05),
    "long_words": (20.0, 15.0, 12.0, 10.0, 9.0, 8.0),
    "short_words": (-1.5, -2.0, -2.5, -3.0, -3.5),
}


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a window of ``window`` words that is found twice or more.

    Windows are compared by a 64-bit hash inside the text: sorted with their
    places, so equal windows are neighbours; n log n steps for n words.
    """
    one = F.lit(1)

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda s: let(F.sort_array(F.transform(twice(s), lambda x: x["i"])), spread))

    def twice(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, i: same(x, i + one) | same(x, i - one))

    def spread(at: Column) -> Column:
        step = lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + one) - x, F.lit(window)))
        return F.aggregate(F.transform(at, step), F.lit(0), lambda a, b: a + b)

    return let(words, lambda w: F.when(F.size(w) > window, count(w)).otherwise(F.lit(0)))


def measures() -> dict[str, Column]:
    """The counts of a whole text, as bigint columns by name."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    counts = {
        "n_words": F.size(words_of()),
        "word_chars": F.char_length(F.translate(text, SPACES, "")),
        "n_symbols": F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")),
        "n_lines": let(lines, F.size),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_window_words(words_of()),
    }
    return {name: c.cast("bigint").alias(name) for name, c in counts.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def scores() -> dict[str, Column]:
    """Score of each rule from the measures; high is bad, 0 if there is nothing to divide by."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    length = ratio("word_chars", "n_words")
    return {
        "symbol_share": ratio("n_symbols", "n_words"),
        "repeated_line_share": ratio("n_dup_lines", "n_lines"),
        "repeated_word_share": ratio("n_repeat_words", "n_words"),
        "long_words": length,
        "short_words": -length,
    }


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up, exact to about 1e-13 for x >= 1."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    shifted = F.ln(x)
    for i in range(1, 8):
        shifted = shifted + F.ln(x + float(i))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - shifted


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(Binomial(n, share) <= k), exact to rounding for k below the mean, else 1.

    Terms are added from k down; they shrink, and 40 standard deviations below
    they are nothing to a double, so the work grows with sqrt(n) only.
    """
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
        + k * math.log(share) + (n - k) * math.log1p(-share)
    )
    steps = F.least(k, F.ceil(F.sqrt(n * share)) * 40 + 200).cast("int")
    odds = (1 - share) / share

    def add(state: Column, j: Column) -> Column:
        i = k - j.cast("double") + 1  # term i becomes term i - 1
        term = state["term"] * i / (n - i + 1) * odds
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    below = F.when(steps < 1, F.lit(1.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, add, lambda s: s["sum"])
    )
    return F.when(k < n * share, top * below).otherwise(F.lit(1.0))


def safe_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    stratum: str,
    cutoffs: Mapping[str, Sequence[float]] = CUTOFFS,
    risk: float = RISK,
    failure: float = FAILURE,
) -> DataFrame:
    """(``stratum``, a column per rule): the strictest safe cutoff, null if none is.

    ``labels`` (doc_id, quality) is the holdout: documents of quality 1 that pass
    the base rules are good. A cutoff is safe in a stratum if the exact binomial
    test rejects "this rule refuses at least risk / rules of the good documents":
    P(Bin(n, risk / rules) <= refused) <= failure / (rules * strata). Bonferroni
    covers rules and strata; along one rule the refused only grow, so testing
    from lenient to strict up to the first unsafe cutoff needs no correction.
    """
    graded = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    good = measured.join(graded, "doc_id").where((F.col("__quality") == 1) & ~base_failed())
    value = scores()
    counted = good.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("__n"),
        *[
            F.count(F.when(value[rule] > cut, 1)).alias(f"__{rule}_{i}")
            for rule, cuts in cutoffs.items()
            for i, cut in enumerate(cuts)
        ],
    )
    each = failure / (len(cutoffs) * max(1, measured.select(stratum).distinct().count()))
    share = risk / len(cutoffs)

    def strictest(rule: str, cuts: Sequence[float]) -> Column:
        safe = [binomial_tail(F.col(f"__{rule}_{i}"), F.col("__n"), share) <= each for i in range(len(cuts))]
        return F.least(*[F.when(ok, F.lit(float(cut))) for ok, cut in zip(safe, cuts)]).alias(rule)

    return counted.select(stratum, *[strictest(rule, cuts) for rule, cuts in cutoffs.items()])


def judge(
    measured: DataFrame, labels: DataFrame, stratum: str, cutoffs: Mapping[str, Sequence[float]] = CUTOFFS, **promise
) -> DataFrame:
    """Every row of ``measured`` with ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules and no rule with a safe cutoff
    of its stratum scores it above. Strata are not null. Without enough labels in
    a stratum no cutoff is safe, and only the base rules reject.
    """
    limits = safe_cutoffs(measured, labels, stratum, cutoffs, **promise)
    given = others(measured, "base_failed", "kept")
    named = limits.select(stratum, *[F.col(r).alias(f"__limit_{r}") for r in cutoffs])
    rows = attach(measured.select(*given), named, [stratum], "left")
    above = F.lit(False)
    for rule, value in scores().items():
        if rule in cutoffs:
            above = above | F.coalesce(value > F.col(f"__limit_{rule}"), F.lit(False))
    return rows.select(*given, base_failed().alias("base_failed"), (~base_failed() & ~above).alias("kept"))
