"""Focus: blended diffusion, spring and heat steps iterated to a fixed point."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.functions.columns import contraction, steps_to
from linktide.operators.bundled import Bundle, bundled, over_bundles
from linktide.operators.keyed import attach, ratio
from linktide.operators.packed import Packed, divided, known
from linktide.operators.propagate import (
    STEPS_PER_PLAN,
    EntryTable,
    arriving,
    entry_table,
    own,
    planned_for,
    start_value,
    static,
)
from linktide.session import settle


@dataclass(frozen=True)
class FocusParams:
    """Blend weights, teleport, spring and heat constants, stop rule.

    ``heat_degree`` is the polynomial degree per heat sub-step and
    ``heat_span`` the largest exponent a sub-step covers; None picks one
    sub-step of a degree that is accurate for the whole exponent. The two ends
    of the spectrum come from ``krylov_steps`` steps of one Krylov space, or,
    when that is None, from ``power_steps`` and ``gap_steps`` power steps.
    """

    diffusion: float = 0.5
    springs: float = 0.3
    heat: float = 0.2
    alpha: float = 0.15
    mu: float = 1.0
    tau: float = 1.0
    epsilon: float = 1e-6
    step_cap: int = 500
    power_steps: int = 60
    gap_steps: int = 120
    krylov_steps: int | None = 24
    heat_degree: int | None = None
    heat_span: float | None = None
    heat_error: float = 1e-8

    def stepwise_heat(self) -> "FocusParams":
        """Degree 8 on sub-steps that each cover an exponent of at most 2."""
        return replace(self, heat_degree=8, heat_span=2.0)


LARGEST_CHANGE = 2.0  # L1 distance of two distributions


@dataclass(frozen=True)
class HeatSeries:
    """Chebyshev series of exp(-s (x + 1)) on [-1, 1].

    ``rest[d]`` is the sum of the absolute coefficients beyond degree ``d``.
    """

    coefficients: list[float]
    rest: list[float]

    def degree(self, error: float, size: float = LARGEST_CHANGE) -> int:
        """Lowest degree, two at least, that smooths a vector of L1 norm ``size`` to ``error``."""
        size = min(size, LARGEST_CHANGE)
        fits = (d for d, rest in enumerate(self.rest) if d >= 2 and rest * size < error)
        return next(fits, len(self.coefficients) - 1)


def heat_series(s: float) -> HeatSeries:
    """All coefficients that a double can hold.

    They are (2 - [k = 0]) (-1)^k e^-s I_k(s). The ratios I_k / I_(k-1) come from
    the downward recurrence, which is stable, and the sum of all terms fixes the
    scale. Time grows with the square root of ``s``.
    """
    order = 40 + math.ceil(40 * math.sqrt(max(s, 0.0)))
    ratios = [0.0] * (order + 1)
    for k in range(order - 1, 0, -1):
        ratios[k] = s / (2 * k + s * ratios[k + 1])
    bessel = np.cumprod([1.0, *ratios[1:order]])
    size = np.where(np.arange(order) > 0, 2.0, 1.0) * bessel / (2 * bessel.sum() - bessel[0])
    tail = np.cumsum(size[::-1])[::-1]
    return HeatSeries((size * (-1.0) ** np.arange(order)).tolist(), [*tail[1:].tolist(), 0.0])


def heat_pieces(bound: float, params: FocusParams) -> tuple[int, HeatSeries, int]:
    """(sub-steps, series of one, degree) of the heat map for a spectrum within [0, bound]."""
    s = params.tau * bound / 2
    stepwise = params.heat_span is not None and params.heat_degree is not None
    pieces = max(1, math.ceil(s / params.heat_span)) if stepwise else 1
    series = heat_series(s / pieces)
    return pieces, series, params.heat_degree if stepwise else series.degree(params.heat_error)


def heat_coefficient_column(s: Column, degree: int) -> Column:
    """The first coefficients as an array column, for many graphs at once."""

    @F.pandas_udf("array<double>")
    def first(values: pd.Series) -> pd.Series:
        rows = [(heat_series(v).coefficients + [0.0] * (degree + 1))[: degree + 1] for v in values]
        return pd.Series(rows, dtype=object)

    return first(s)


def _per_graph(table: EntryTable, state: DataFrame, *aggregates: Column) -> DataFrame | dict:
    """Aggregates over the nodes of each graph: values for one graph, a table for many."""
    if table.keys:
        return state.groupBy(*table.keys).agg(*aggregates)
    return state.agg(*aggregates).first().asDict()


def _with(table: EntryTable, state: DataFrame, values: DataFrame | dict) -> DataFrame:
    if table.keys:
        return attach(state, values, table.keys, "inner")
    return state.select("*", *[F.lit(v).alias(k) for k, v in values.items()])


def _drop(state: DataFrame, values: DataFrame | dict, table: EntryTable) -> DataFrame:
    names = values.keys() if isinstance(values, dict) else set(values.columns) - set(table.keys)
    return state.drop(*names)


def laplacian(value: Column) -> Column:
    """(L x) at the receiving node."""
    return F.sum(
        F.when(F.col("self"), F.col("degree") * value).otherwise(-F.col("s") * value)
    )


def _power(table: EntryTable, state: DataFrame, shift: Column | None, steps: int, centre: bool):
    """Power iteration on L, or on shift - L; returns per-graph Rayleigh quotients.

    Scaling (and centring) only guards the range of the numbers, so it is done
    once per plan and not once per step; the quotient is taken at the last step.
    """
    spread = [F.max(F.abs("x")).alias("__m"), F.avg("x").alias("__a")]

    def normal(s: DataFrame) -> DataFrame:
        values = _per_graph(table, s, *spread)
        s = _with(table, s, values)
        mean = F.col("__a") if centre else F.lit(0.0)
        s = s.withColumn("x", F.col("x") - mean)
        return _drop(s.withColumn("x", ratio(F.col("x"), F.col("__m"))), values, table)

    def apply(s: DataFrame, keep: bool) -> DataFrame:
        image = laplacian(F.col("x"))
        if shift is not None:
            image = F.sum(
                F.when(F.col("self"), (shift - F.col("degree")) * F.col("x")).otherwise(
                    F.col("s") * F.col("x")
                )
            )
        sums = {"y": image}
        if keep:
            sums["x"] = own(F.col("x"))
        out = table.step(s, sums)
        return out if keep else out.withColumnRenamed("y", "x")

    state = table.settle(normal(state))
    done = 0
    while done < steps - 1:
        for _ in range(min(STEPS_PER_PLAN, steps - 1 - done)):
            state = apply(state, keep=False)
            done += 1
        state = table.settle(normal(table.settle(state)))
    last = apply(state, keep=True)
    return _per_graph(
        table,
        last,
        (F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("quotient"),
    )


def _packed_power(pack: Packed, shift: float | None, steps: int, centre: bool) -> float | None:
    """``_power`` on packed cells."""
    return pack.alone(lambda pack, _: (_power_of(pack, shift, steps, centre), None))[0]


def _power_of(pack: Packed, shift: float | None, steps: int, centre: bool) -> float | None:
    def normal(state):
        rows = pack.totals(state, lambda node, own: np.array([
            np.abs(known(own["x"])).max(initial=0.0), known(own["x"]).sum(), (~np.isnan(own["x"])).sum()]))
        largest, total, count = rows[:, 0].max(), rows[:, 1].sum(), rows[:, 2].sum()
        mean = total / count if centre and count else 0.0
        return pack.over(state, lambda node, own: {"x": divided(own["x"] - mean, largest)})

    def send(node, own):
        return [("pull", own["x"])], []

    def image(node, own, sums, numbers):
        here = node["degree"] if shift is None else shift - node["degree"]
        far = -sums[0] if shift is None else sums[0]
        return {"x": np.where(np.isnan(here), np.nan, here * known(own["x"]) + far)}

    state = normal(pack.state(lambda node: {"x": node["start"]}))
    done = 0
    while done < steps - 1:
        for _ in range(min(STEPS_PER_PLAN, steps - 1 - done)):
            state = pack.step(state, send, image)
            done += 1
        state = normal(pack.settle(state))
    last = pack.step(state, send, lambda node, own, sums, numbers: {"x": own["x"], "y": image(node, own, sums, numbers)["x"]})
    rows = pack.totals(last, lambda node, own: np.array([known(own["x"] * own["y"]).sum(), known(own["x"] ** 2).sum()]))
    above, below = rows.sum(axis=0)
    return float(above / below) if below else None


def lambda_max(table: EntryTable, steps: int = 60):
    """Largest Laplacian eigenvalue: a float, or a table for many graphs."""
    pack = table.cells()
    if pack is not None:
        return _packed_power(pack, None, steps, centre=False) or 0.0
    start = table.per_node(x=start_value(dict(table.entries.dtypes)["id"]))
    with planned_for(table):
        found = _power(table, start, None, steps, centre=False)
        if table.keys:
            return found.select(*table.keys, F.coalesce("quotient", F.lit(0.0)).alias("lambda_max"))
        return found["quotient"] or 0.0


def lambda_2(table: EntryTable, top, steps: int = 120):
    """Smallest non-trivial Laplacian eigenvalue, floored at zero."""
    pack = table.cells()
    if pack is not None:
        if pack.n < 2:
            return 0.0
        return max(0.0, top - (_packed_power(pack, top, steps, centre=True) or 0.0))
    start = table.per_node(x=start_value(dict(table.entries.dtypes)["id"]))
    with planned_for(table):
        if table.keys:
            wide = table.with_static(top, ["lambda_max"])
            mu = _power(wide, start, F.col("lambda_max"), steps, centre=True)
            return mu.join(top, list(table.keys)).select(
                *table.keys,
                F.greatest(
                    F.lit(0.0), F.col("lambda_max") - F.coalesce("quotient", F.lit(0.0))
                ).alias("lambda_2"),
            )
        if table.n < 2:
            return 0.0
        mu = _power(table, start, F.lit(top), steps, centre=True)
        return max(0.0, top - (mu["quotient"] or 0.0))


def _ritz_ends(moments: np.ndarray, steps: int) -> tuple[float, float]:
    """Smallest and largest Ritz value in [-1, 1] from Chebyshev moments."""
    if not moments[0] > 0:
        return -1.0, -1.0
    i = np.arange(steps)
    total, gap = i[:, None] + i[None, :], np.abs(i[:, None] - i[None, :])
    gram = (moments[total] + moments[gap]) / 2
    up = (moments[total + 1] + moments[np.abs(gap + 1)]) / 4
    down = (moments[np.abs(total - 1)] + moments[np.abs(gap - 1)]) / 4
    image = up + down
    values, vectors = np.linalg.eigh(gram)
    kept = values > 1e-11 * values.max()
    basis = vectors[:, kept] / np.sqrt(values[kept])
    ritz = np.linalg.eigvalsh(basis.T @ ((image + image.T) / 2) @ basis)
    return float(ritz[0]), float(ritz[-1])


def krylov_ends(table: EntryTable, steps: int = 24):
    """(lambda_max, lambda_2) from one Krylov space off the constant vector.

    The vectors T_k(x) v of a Chebyshev recurrence are never kept: their inner
    products follow from two consecutive ones, and those fix the projected
    eigenproblem, which has ``steps`` rows.
    """
    keys = list(table.keys)
    pack = table.cells()
    if pack is not None:
        return _packed_ends(pack, steps)
    top = spectral_bound(table)
    start = table.per_node(x=start_value(dict(table.entries.dtypes)["id"]))
    mean = _per_graph(table, start, F.avg("x").alias("__a"), F.count("x").alias("__n"))
    state = _drop(
        _with(table, start, mean).withColumn("x", F.col("x") - F.col("__a")), mean, table
    )
    if keys:
        wide = with_heat_entries(table.with_static(table.settle(top), ["bound"]), F.col("bound"))
    else:
        wide = with_heat_entries(table, F.lit(top))
    image = arriving("h", F.col("cur"))
    state = table.settle(state.select("*", F.col("x").alias("cur")).drop("x"))
    found = None
    done = 0
    while done < steps:
        count = min(STEPS_PER_PLAN, steps - done)
        names: list[str] = []
        for j in range(count):
            sums = {c: own(F.col(c)) for c in names}
            if done + j == 0:
                sums.update(nxt=image, prev=own(F.col("cur")))
            else:
                sums.update(
                    nxt=F.sum(2 * F.col("h") * F.col("cur")) - own(F.col("prev")),
                    prev=own(F.col("cur")),
                )
            sums[f"c{j}"] = own(F.col("cur"))
            names.append(f"c{j}")
            state = wide.step(state, sums).withColumnRenamed("nxt", "cur")
        state = table.settle(state)
        chain = [F.col(c) for c in names] + [F.col("cur")]
        dots = []
        for j in range(count):
            dots.append(F.sum(chain[j] * chain[j]).alias(f"m{2 * (done + j)}"))
            dots.append(F.sum(chain[j] * chain[j + 1]).alias(f"m{2 * (done + j) + 1}"))
        part = _per_graph(table, state, *dots)
        if keys:
            part = table.settle(part)
            found = part if found is None else found.join(part, keys)
        else:
            found = {**(found or {}), **part}
        state = state.drop(*names)
        done += count
    wide.release_beyond(table)

    if not keys:
        low, high = _ritz_ends(_unfolded(np.array([found[f"m{i}"] or 0.0 for i in range(2 * steps)])), steps)
        half = top / 2
        return half * (1 + high), max(0.0, half * (1 + low))

    @F.pandas_udf("struct<low double, high double>")
    def ends(raw: pd.Series) -> pd.DataFrame:
        pairs = [_ritz_ends(_unfolded(np.array(m, dtype=float)), steps) for m in raw]
        return pd.DataFrame(pairs, columns=["low", "high"])

    solved = found.select(*keys, ends(F.array(*[f"m{i}" for i in range(2 * steps)])).alias("e"))
    half = F.col("bound") / 2
    return solved.join(top, keys).select(
        *keys,
        (half * (1 + F.col("e.high"))).alias("lambda_max"),
        F.greatest(F.lit(0.0), half * (1 + F.col("e.low"))).alias("lambda_2"),
    )


def _unfolded(raw: np.ndarray) -> np.ndarray:
    """Chebyshev moments from the inner products of consecutive vectors."""
    out = 2 * raw
    out[0::2] -= raw[0]
    out[1::2] -= raw[1]
    out[0], out[1] = raw[0], raw[1]
    return out


def _packed_ends(pack: Packed, steps: int) -> tuple[float, float]:
    """``krylov_ends`` on packed cells."""
    return pack.alone(lambda pack, _: (_ends_of(pack, steps), None))[0]


def _ends_of(pack: Packed, steps: int) -> tuple[float, float]:
    top = 2 * pack.top if math.isfinite(pack.top) else 0.0
    begun = pack.state(lambda node: {"cur": node["start"], "prev": np.zeros(len(node["start"]))})
    rows = pack.totals(begun, lambda node, own: np.array([known(own["cur"]).sum(), (~np.isnan(own["cur"])).sum()]))
    total, count = rows.sum(axis=0)
    mean = total / count if count else 0.0
    state = pack.over(begun, lambda node, own: {
        "cur": own["cur"] - mean, "prev": own["prev"], "dots": np.zeros(0)})

    def send(node, own):
        return [("pull", own["cur"])], []

    def receive(node, own, sums, numbers):
        cur, image = own["cur"], heat_image(node, own["cur"], sums[0], top)
        fresh = 2 * image - own["prev"] if len(own["dots"]) else image
        dots = [known(cur * cur).sum(), known(cur * fresh).sum()]
        return {"cur": fresh, "prev": cur, "dots": np.append(own["dots"], dots)}

    for t in range(steps):
        state = pack.step(state, send, receive)
        if t % STEPS_PER_PLAN == STEPS_PER_PLAN - 1 and t < steps - 1:
            state = pack.settle(state)
    moments = pack.totals(state, lambda node, own: own["dots"]).sum(axis=0)
    low, high = _ritz_ends(_unfolded(moments), steps)
    return top / 2 * (1 + high), max(0.0, top / 2 * (1 + low))


def heat_image(node: dict, x: np.ndarray, pull: np.ndarray, top: float) -> np.ndarray:
    """(2L/top - 1) x at the nodes of a group, given the sums over links."""
    two = 2 / top if top else 0.0
    return (two * node["degree"] - 1) * x - two * pull


@dataclass
class Spectrum:
    lambda_max: float
    lambda_2: float
    kappa: float
    steps: int


def kappa_of(lmax: float, l2: float, p: FocusParams) -> float:
    spring = lmax / (lmax + p.mu) if lmax + p.mu else 0.0
    return p.diffusion * p.alpha + p.springs * spring + p.heat * math.exp(-p.tau * l2)


def step_count(kappa: float, epsilon: float, cap: int) -> int:
    """Smallest number of steps after which ``kappa`` to its power is at most ``epsilon``."""
    if kappa >= 1:
        return cap
    if kappa <= 0:
        return min(cap, 1)
    about = math.ceil(math.log(epsilon) / math.log(kappa))
    return min(cap, next(t for t in range(max(0, about - 1), about + 3) if kappa**t <= epsilon))


def spectral_bound(table: EntryTable):
    """Twice the largest degree, which no Laplacian eigenvalue exceeds: a float, or (keys, bound)."""
    pack = None if table.listed else table.cells()
    if pack is not None:
        return 2 * pack.top if math.isfinite(pack.top) else 0.0
    found = _per_graph(table, table.entries.where("self"), (2 * F.max("degree")).alias("bound"))
    return found if table.keys else found["bound"] or 0.0


def spectrum(table: EntryTable, params: FocusParams = FocusParams()) -> Spectrum:
    pack = table.cells()
    if params.krylov_steps and pack is not None:
        top, gap = _packed_ends(pack, params.krylov_steps)
    elif params.krylov_steps:
        with planned_for(table):
            top, gap = krylov_ends(table, params.krylov_steps)
    else:
        top = lambda_max(table, params.power_steps)
        gap = lambda_2(table, top, params.gap_steps)
    kappa = kappa_of(top, gap, params)
    return Spectrum(top, gap, kappa, step_count(kappa, params.epsilon, params.step_cap))


@dataclass
class Focus:
    """``nodes(id, focus, diffusion, springs, heat)`` and what was run.

    ``spectra`` replaces ``spectrum`` for a many-graph run. A spectrum that the run did not need is
    computed when it is first read.
    """

    nodes: DataFrame
    found: Spectrum | Callable[[], Spectrum] | None
    steps: int
    spectra: DataFrame | None = None

    @property
    def spectrum(self) -> Spectrum | None:
        if callable(self.found):
            self.found = self.found()
        return self.found


def diffusion_step(table: EntryTable, phi: DataFrame, alpha: float = 0.15) -> DataFrame:
    """alpha*u + (1-alpha)*(dangling mass * u + T phi) for ``phi(id, x)``."""
    pack = table.cells()
    if pack is not None:
        return _packed_step(pack, phi, lambda pack, state: _diffused(pack, state, alpha))
    state = table.state_of(phi, x=F.coalesce("x", F.lit(0.0)))
    out = table.step(
        state,
        {
            "walk": arriving("t", F.col("x")),
            "x": own(F.col("x")),
            "prior": static("prior"),
            "dangling": static("dangling"),
        },
    )
    lost = out.agg(F.sum(F.when(F.col("dangling"), F.col("x")).otherwise(0.0)).alias("__lost"))
    return out.join(F.broadcast(lost)).select(
        "id",
        (
            alpha * F.col("prior")
            + (1 - alpha) * (F.col("__lost") * F.col("prior") + F.col("walk"))
        ).alias("x"),
    )


def springs_step(table: EntryTable, phi: DataFrame, mu: float = 1.0) -> DataFrame:
    """(mu/n + W phi) / (mu + degree)."""
    pack = table.cells()
    if pack is not None:
        return _packed_step(pack, phi, lambda pack, state: _sprung(pack, state, mu))
    state = table.state_of(phi, x=F.coalesce("x", F.lit(0.0)))
    out = table.step(
        state,
        {
            "pull": arriving("s", F.col("x")),
            "degree": static("degree"),
            "size": static("size"),
        },
    )
    return out.select(
        "id", ratio(mu / F.col("size") + F.col("pull"), mu + F.col("degree")).alias("x")
    )


def heat_step(
    table: EntryTable, phi: DataFrame, top: float | None = None, params: FocusParams = FocusParams()
) -> DataFrame:
    """exp(-tau L) phi by Chebyshev sub-steps; the identity when ``top`` is 0.

    ``top`` must not be below the largest eigenvalue: a Ritz value is not enough,
    a series of high degree explodes just outside its interval.
    """
    pack = table.cells()
    if pack is not None:
        bound = float(spectral_bound(table) if top is None else top)
        return _packed_step(pack, phi, lambda pack, state: _heated(pack, state, bound, params))
    top = spectral_bound(table) if top is None else top
    state = table.state_of(phi, v=F.coalesce("x", F.lit(0.0)))
    if top == 0:
        return state.select("id", F.col("v").alias("x"))
    pieces, series, degree = heat_pieces(top, params)
    wide = with_heat_entries(table, F.lit(top))
    runner = _Chain(wide)
    state = state.withColumnRenamed("v", "acc")
    coefficients = F.array(*map(F.lit, series.coefficients[: degree + 1]))
    for _ in range(pieces):
        state = _smooth(runner, state, coefficients, degree, {}, {})
    return state.select("id", F.col("acc").alias("x"))


def _packed_step(pack: Packed, phi: DataFrame, run: Callable) -> DataFrame:
    """(id, x): a step of ``phi(id, x)`` on packed cells, where a node without a value has 0."""
    state = pack.settle(pack.joined(pack.state(lambda node: {}), phi.select("id", "x"), "x"))
    _, done = pack.alone(lambda pack, state: (None, run(pack, state)), state)
    return settle(pack.table(done, lambda node, own: {"x": own["x"]}, ["x"]))


def _diffused(pack: Packed, state, alpha: float):
    mass = np.float64(pack.mass)

    def send(node, own):
        return [("walk", divided(own["x"], node["out"]))], [(node["dangling"] * own["x"]).sum()]

    def receive(node, own, sums, numbers):
        prior = divided(node["degree"], mass)
        return {"x": alpha * prior + (1 - alpha) * (numbers[0] * prior + sums[0])}

    return pack.step(state, send, receive)


def _sprung(pack: Packed, state, mu: float):
    size = pack.n
    return pack.step(
        state, lambda node, own: ([("pull", own["x"])], []),
        lambda node, own, sums, numbers: {"x": divided(mu / size + sums[0], mu + node["degree"])})


def _heated(pack: Packed, state, top: float, params: FocusParams):
    if top == 0:
        return state
    pieces, series, degree = heat_pieces(top, params)

    def send(node, own):
        return [("pull", own["x"])], []

    def receive(node, own, sums, begun):
        return begun(own["x"], heat_image(node, own["x"], sums[0], top))

    done = heat_steps(pack, state, (send, receive), series, pieces, degree, top, ())
    return pack.over(done, lambda node, own: {"x": own["acc"]})


def with_heat_entries(table: EntryTable, top: Column) -> EntryTable:
    """Add ``h``, the entries of 2L/top - I, computed as they are read."""
    two = ratio(F.lit(2.0), top)
    return table.derive(
        h=F.when(F.col("self"), two * F.col("degree") - 1).otherwise(-two * F.col("s"))
    )


class _Chain:
    """Runs steps and settles the state every STEPS_PER_PLAN of them."""

    def __init__(self, table: EntryTable):
        self.table = table
        self.pending = 0

    def step(self, state: DataFrame, sums: dict[str, Column]) -> DataFrame:
        if self.pending >= STEPS_PER_PLAN:
            state = self.table.settle(state)
            self.pending = 0
        self.pending += 1
        return self.table.step(state, sums)


def _smooth(
    runner: _Chain,
    state: DataFrame,
    coefficients: Column,
    degree: int,
    carry: dict[str, Column],
    last: dict[str, Column],
    first: dict[str, Column] | None = None,
    source: str = "acc",
) -> DataFrame:
    """acc := sum_k c_k T_k(source), one step per degree.

    The index of the polynomial travels in the state, so that every step of the
    recurrence is the same code. The image is the only sum over entries, so it alone fills the
    rows that are shuffled; what a node keeps for itself is null in all but its own. ``first`` replaces ``carry`` in the first step
    and ``last`` joins it in the last one.
    """
    v, h, cur, prev = F.col(source), F.col("h"), F.col("cur"), F.col("prev")
    state = runner.step(
        state,
        {
            **(carry if first is None else first),
            "prev": own(v),
            "cur": F.sum(h * v),
            "acc": own(F.element_at(coefficients, 1) * v) + own(F.element_at(coefficients, 2)) * F.sum(h * v),
            "k": own(F.lit(3)).cast("int"),
        },
    )
    c = F.element_at(coefficients, F.col("k"))
    for k in range(2, degree + 1):
        sums = {
            **carry,
            "prev": own(cur),
            "cur": F.sum(2 * h * cur) - own(prev),
            "acc": own(F.col("acc")) + own(c) * (F.sum(2 * h * cur) - own(prev)),
            "k": own(F.col("k") + 1).cast("int"),
        }
        if k == degree:
            sums.update(last)
        state = runner.step(state, sums)
    return state


FACTS = ["lambda_max", "lambda_2", "kappa", "steps", "bound"]


def _bundled_facts(made: Bundle, params: FocusParams) -> dict[str, np.ndarray]:
    """``spectra`` of the graphs of a bundle."""
    steps, middle = params.krylov_steps, divided(made.sums(made.begin), made.size)
    cur, prev, moments = made.begin - middle[made.graph], None, []
    for k in range(steps):
        image = made.heat_image(cur)
        fresh = image if prev is None else 2 * image - prev
        moments += [made.sums(cur * cur), made.sums(cur * fresh)]
        cur, prev = fresh, cur
    ends = np.array([_ritz_ends(_unfolded(m), steps) for m in np.array(moments).T])
    half = made.bound / 2
    top, gap = half * (1 + ends[:, 1]), np.maximum(0.0, half * (1 + ends[:, 0]))
    kappa = [kappa_of(float(t), float(g), params) for t, g in zip(top, gap)]
    counts = [step_count(k, params.epsilon, params.step_cap) for k in kappa]
    return {"lambda_max": top, "lambda_2": gap, "kappa": np.array(kappa), "steps": np.array(counts, float), "bound": made.bound}


def _bundled_run(made: Bundle, params: FocusParams, total: int, widest: float) -> dict[str, np.ndarray]:
    """``run_focus`` for the graphs of a bundle: every graph stops at its own count.

    The heat map has the same sub-steps and degree in all graphs, those of the widest spectrum.
    """
    pieces, series, degree = heat_pieces(widest, params)
    widths, which = np.unique(made.bound, return_inverse=True)
    rows = [(heat_series(b * params.tau / 2 / pieces).coefficients + [0.0] * (degree + 2))[: max(2, degree + 1)] for b in widths]
    table, which = np.array(rows).T, which[made.graph]
    limit, size = made.facts["steps"], made.size[made.graph]
    prior = divided(made.degree, made.sums(made.degree)[made.graph])
    dangling = made.out == 0
    raw, before = 1 / size, np.zeros(made.n)
    heated = diffusion = springs = before

    def normalised(raw):
        whole = made.sums(raw)
        return divided(raw, whole[made.graph]), divided(made.sums(np.where(dangling, raw, 0.0)), whole)

    # A graph that has stopped does not move; a step later its parts have settled too.
    for t in range(min(total, int(limit.max()) + 1)):
        v, lost = normalised(raw)
        diffusion = params.alpha * prior + (1 - params.alpha) * (lost[made.graph] * prior + made.walk(v))
        springs = divided(params.mu / size + made.pull(v), params.mu + made.degree)
        acc = v - before
        for _ in range(pieces):
            prev, cur = acc, made.heat_image(acc)
            acc = table[0][which] * prev + table[1][which] * cur
            for k in range(2, degree + 1):
                prev, cur = cur, 2 * made.heat_image(cur) - prev
                acc = acc + table[k][which] * cur
        heated = heated + acc
        blend = params.diffusion * diffusion + params.springs * springs + params.heat * heated
        raw, before = np.where((t < limit)[made.graph], blend, v), v
    return {"focus": normalised(raw)[0], "diffusion": diffusion, "springs": springs, "heat": heated}


def _bundled_focus(bundles: DataFrame, adj: DataFrame, keys: Sequence[str], params: FocusParams) -> Focus:
    most = bundles.agg(F.max("steps").alias("steps"), F.max("bound").alias("bound")).first()
    total, widest = int(most["steps"]), float(most["bound"])
    names = ["focus", "diffusion", "springs", "heat"]
    nodes = over_bundles(bundles, adj, keys, lambda made: _bundled_run(made, params, total, widest), names, nodes=True)
    found = over_bundles(bundles, adj, keys, lambda made: made.facts, FACTS[:4], nodes=False)
    return Focus(nodes, None, total, found.withColumn("steps", F.col("steps").cast("int")))


def _beside(one: Focus, two: Focus) -> Focus:
    """Runs of different graphs as one."""
    return Focus(one.nodes.unionByName(two.nodes), None, max(one.steps, two.steps), one.spectra.unionByName(two.spectra))


@dataclass
class Part:
    """A part of a graph: self entries with ``held`` keep their value, others gain ``offset``.

    ``lost`` is the dangling mass elsewhere. ``scale`` is the sum over the whole
    graph after a step, in which the part had ``total``; None runs a bare step.
    For a many-graph table ``graphs(keys, lost, scale, total)`` holds them per graph,
    and ``scale`` only tells (by None) that the step is bare.
    """

    lost: float = 0.0
    scale: float | None = None
    total: float = 0.0
    graphs: DataFrame | None = None


def run_focus(
    table: EntryTable,
    steps: int | DataFrame,
    top,
    params: FocusParams = FocusParams(),
    start: DataFrame | None = None,
    prior: DataFrame | None = None,
    tolerance: float | None = None,
    part: Part | None = None,
) -> Focus:
    """Iterate the blended step from the uniform vector or from ``start(id, x)``.

    ``prior(id, prior)`` replaces the teleport distribution. ``steps`` and
    ``top``, an upper bound of the spectrum, are numbers for one graph; for a
    many-graph table they are tables ``(keys, steps)`` and ``(keys, bound)``,
    each graph stops at its own step count, and all graphs advance together.

    ``part`` says that the table is a part of a graph (see ``local_focus``).
    """
    pack = table.cells() if part is None else None
    if pack is not None:
        return _packed_focus(pack, steps, float(top), params, start, prior, tolerance)
    with planned_for(table):
        return _run_focus(table, steps, top, params, start, prior, tolerance, part)


def _packed_focus(pack: Packed, steps, top, params, start, prior, tolerance) -> Focus:
    """``run_focus`` of one graph on packed cells."""
    size, mass = pack.n, np.float64(pack.mass)
    state = pack.state(lambda node: {
        "raw": np.full(len(node["out"]), 1 / size), "prior": divided(node["degree"], mass),
        **{c: np.zeros(len(node["out"])) for c in ("before", "heated", "diffusion", "springs")}})
    if start is not None:
        state = pack.joined(state, start.select("id", F.col("x").alias("raw")), "raw")
    if prior is not None:
        state = pack.joined(state, prior.select("id", "prior"), "prior")
    used, ready = pack.alone(lambda pack, state: _focus_of(pack, state, steps, top, params, tolerance), pack.settle(state))
    names = ["focus", "diffusion", "springs", "heat"]
    nodes = pack.table(ready, lambda node, own: {
        "focus": own["v"], "diffusion": own["diffusion"], "springs": own["springs"], "heat": own["heated"]}, names)
    return Focus(settle(nodes), None, used)


def heat_steps(pack: Packed, state, first: tuple, series: HeatSeries, pieces: int, degree: int, top: float, carried: Sequence[str]):
    """The state whose ``acc`` is the heat map of a vector, a step per degree; ``carried`` arrays come along.

    ``first`` has the send and receive of the first step, where the latter is also given ``begun(x, image)``,
    the arrays of the recurrence for the vector x and its image.
    """
    c = series.coefficients[: degree + 1]
    c = c + [0.0] * max(0, 2 - len(c))
    first_send, first_receive = first

    def begun(x, image):
        return {"prev": x, "cur": image, "acc": c[0] * x + c[1] * image}

    def send(node, own):
        return [("pull", own["cur"])], []

    def again_send(node, own):
        return [("pull", own["acc"])], []

    def again(node, own, sums, numbers):
        return {**{k: own[k] for k in carried}, **begun(own["acc"], heat_image(node, own["acc"], sums[0], top))}

    def later(k):
        def receive(node, own, sums, numbers):
            fresh = 2 * heat_image(node, own["cur"], sums[0], top) - own["prev"]
            return {**{n: own[n] for n in carried}, "prev": own["cur"], "cur": fresh, "acc": own["acc"] + c[k] * fresh}
        return receive

    done = 0
    for piece in range(pieces):
        for k in range(1, degree + 1):
            if done and done % STEPS_PER_PLAN == 0:
                state = pack.settle(state)
            done += 1
            if k > 1:
                state = pack.step(state, send, later(k))
            elif piece:
                state = pack.step(state, again_send, again)
            else:
                state = pack.step(state, first_send, lambda node, own, sums, numbers: first_receive(node, own, sums, begun))
    return state


def _focus_of(pack: Packed, state, steps: int, top: float, params: FocusParams, tolerance: float | None) -> tuple:
    """(steps used, last state) of ``_packed_focus``."""
    pieces, series, degree = heat_pieces(top, params)
    size = pack.n
    carried = ("v", "heated", "diffusion", "springs", "prior")

    def normalised(state):
        rows = pack.totals(state, lambda node, own: np.array([known(own["raw"]).sum(), known(node["dangling"] * own["raw"]).sum()]))
        total, lost = rows.sum(axis=0)
        lost = lost / total if total else 0.0
        ready = pack.over(state, lambda node, own: {
            **{c: own[c] for c in ("before", *carried[1:])}, "v": divided(own["raw"], total)})
        return ready, lost

    def first_send(node, own):
        moved = own["v"] - own["before"]
        return [("walk", divided(own["v"], node["out"])), ("pull", own["v"]), ("pull", moved)], []

    def smoothed(state, degree, lost):
        """The sums of a step: of links at once, of heat by a step per degree."""

        def first(node, own, sums, begun):
            moved = own["v"] - own["before"]
            diffusion = params.alpha * own["prior"] + (1 - params.alpha) * (lost * own["prior"] + sums[0])
            springs = divided(params.mu / size + sums[1], params.mu + node["degree"])
            return {"v": own["v"], "heated": own["heated"], "prior": own["prior"], "diffusion": diffusion, "springs": springs,
                    **begun(moved, heat_image(node, moved, sums[2], top))}

        return heat_steps(pack, state, (first_send, first), series, pieces, degree, top, carried)

    def blended(node, own):
        heated = own["heated"] + own["acc"]
        raw = params.diffusion * own["diffusion"] + params.springs * own["springs"] + params.heat * heated
        return {"raw": raw, "before": own["v"], "heated": heated, **{c: own[c] for c in ("diffusion", "springs", "prior")}}

    used = 0
    ready, lost = normalised(state)
    for t in range(steps):
        drift = 1.0
        if params.heat_degree is None or tolerance is not None:
            drift = float(pack.totals(ready, lambda node, own: np.array([np.abs(own["v"] - own["before"]).sum()])).sum())
            if t and tolerance is not None and drift < tolerance:
                break
        if params.heat_degree is None:
            degree = series.degree(params.heat_error, drift)
        state = pack.settle(pack.over(smoothed(ready, degree, lost), blended))
        ready, lost = normalised(state)
        used = t + 1
    return used, ready


def _run_focus(table, steps, top, params, start, prior, tolerance, part) -> Focus:
    keys = list(table.keys)
    given_table, fixed = table, ["held", "offset"] if part else []
    if prior is not None:
        given = prior.select(*keys, "id", F.col("prior").alias("__p"))
        swapped = table.entries.join(given, [*keys, "id"], "left").withColumn(
            "prior", F.when(F.col("self"), F.coalesce("__p", F.lit(0.0)))
        )
        table = replace_entries(table, swapped.drop("__p"))
    if keys:
        limits = steps.join(top, keys)
        most = limits.agg(F.max("steps").alias("t"), F.max("bound").alias("b")).first()
        total_steps, widest = most["t"] or 0, most["b"] or 0.0
        pieces, series, degree = heat_pieces(widest, params)
        column = heat_coefficient_column(F.col("bound") * (params.tau / 2 / pieces), degree)
        limits = table.settle(limits.withColumn("coef", column))
        wide = with_heat_entries(
            table.with_static(limits, ["bound", "steps", "coef"]), F.col("bound")
        )
        coefficients = F.col("coef")
    else:
        total_steps, widest = steps, float(top)
        pieces, series, degree = heat_pieces(widest, params)
        coefficients = F.array(*map(F.lit, series.coefficients[: degree + 1]))
        wide = with_heat_entries(table, F.lit(widest))

    copies = ["copies"] if table.salted else []
    if start is not None:
        state = table.state_of(start, raw=F.coalesce("x", F.lit(0.0)))
        flags = table.entries.where("self").select(*keys, "id", "dangling", *fixed)
        state = state.join(flags, [*keys, "id"])
    else:
        state = table.per_node(raw=ratio(F.lit(1.0), F.col("size")), dangling=F.col("dangling"))
    zeros = [F.lit(0.0).alias(c) for c in ("before", "heated", "diffusion", "springs")]
    state = state.select("*", *zeros)

    own_columns = ("v", "heated", "diffusion", "springs")
    carry = {c: own(F.col(c)) for c in own_columns}
    spread = own(F.col("lost") * F.col("prior")) + F.sum(F.col("t") * F.col("v"))
    first = {
        "v": own(F.col("v")),
        "heated": own(F.col("heated")),
        "diffusion": params.alpha * own(F.col("prior")) + (1 - params.alpha) * spread,
        "springs": ratio(
            params.mu / own(F.col("size")) + F.sum(F.col("s") * F.col("v")),
            params.mu + own(F.col("degree")),
        ),
    }
    last = {"dangling": static("dangling")}
    if keys:
        last["limit"] = static("steps")
    last.update({c: static(c) for c in fixed})
    used = 0
    for t in range(total_steps):
        state = _spliced(table, state, part, t > 0) if part else _normalised(table, state)
        drift = 1.0
        if params.heat_degree is None or tolerance is not None:
            drift = state.agg(F.sum(F.abs(F.col("v") - F.col("before")))).first()[0] or 0.0
            if t and tolerance is not None and drift < tolerance:
                break
        # The heat map is linear: only the change since the last step is smoothed,
        # and a smaller change needs a lower degree for the same error.
        if params.heat_degree is None:
            degree = series.degree(params.heat_error, drift)
        state = state.select(
            *keys, "id", "v", "heated", "diffusion", "springs", "lost",
            (F.col("v") - F.col("before")).alias("moved"), *copies,
        )
        runner = _Chain(wide)
        for piece in range(pieces):
            state = _smooth(
                runner, state, coefficients, degree, carry, last,
                first if piece == 0 else None, "moved" if piece == 0 else "acc",
            )
        heated = F.col("heated") + F.col("acc")
        blend = (
            params.diffusion * F.col("diffusion")
            + params.springs * F.col("springs")
            + params.heat * heated
        )
        if keys:
            blend = F.when(F.lit(t) < F.col("limit"), blend).otherwise(F.col("v"))
        state = table.settle(
            state.select(
                *keys, "id", blend.alias("raw"), "dangling", F.col("v").alias("before"),
                heated.alias("heated"), "diffusion", "springs", *copies, *fixed,
            )
        )
        used = t + 1
    result = state
    if "v" not in state.columns:
        result = _spliced(table, state, part, used > 0) if part else _normalised(table, state)
    wide.release_beyond(given_table)
    columns = [F.col("v").alias("focus"), "diffusion", "springs", F.col("heated").alias("heat")]
    return Focus(result.select(*keys, "id", *columns), None, used)


def _spliced(table: EntryTable, state: DataFrame, part: Part, stepped: bool) -> DataFrame:
    """As ``_normalised`` for a part: held nodes keep their value, the rest is scaled as the
    whole graph would be, whose sum has changed by what the sum of the part has."""
    inner, dangling = ~F.col("held"), F.col("dangling") & ~F.col("held")
    sums = _per_graph(
        table, state, F.sum(F.when(inner, F.col("raw"))).alias("__now"),
        F.sum(F.when(dangling, F.col("raw"))).alias("__raw"),
        F.sum(F.when(dangling, F.col("offset"))).alias("__extra"),
    )
    if part.graphs is not None:
        sums = sums.join(part.graphs.toDF(*table.keys, "__out", "__scale", "__total"), list(table.keys))
    else:
        sums |= {"__out": part.lost, "__scale": part.scale, "__total": part.total}
    ready, zero = _with(table, state, sums), F.lit(0.0)
    scale, share = F.lit(1.0), zero
    if stepped and part.scale is not None:
        scale, share = F.col("__scale") + F.coalesce("__now", zero) - F.col("__total"), F.lit(1.0)
    lost = F.col("__out") + F.coalesce("__raw", zero) / scale + share * F.coalesce("__extra", zero)
    v = F.when(F.col("held"), F.col("before") if stepped else F.col("raw")).otherwise(
        F.col("raw") / scale + share * F.col("offset")
    )
    ready = ready.withColumn("v", v).withColumn("lost", lost)
    return _drop(ready.drop("raw", "dangling", "held", "offset"), sums, table)


def _normalised(table: EntryTable, state: DataFrame) -> DataFrame:
    """v = raw / sum of raw, and ``lost`` = the part of v on dangling nodes."""
    sums = _per_graph(
        table,
        state,
        F.sum("raw").alias("__sum"),
        F.sum(F.when(F.col("dangling"), F.col("raw")).otherwise(0.0)).alias("__lost"),
    )
    ready = _with(table, state, sums)
    ready = ready.select(
        "*",
        ratio(F.col("raw"), F.col("__sum")).alias("v"),
        ratio(F.col("__lost"), F.col("__sum")).alias("lost"),
    )
    return ready.drop("__sum", "__lost", "raw", "dangling")


def replace_entries(table: EntryTable, entries: DataFrame) -> EntryTable:
    order = [*table.keys, "id"] + (["salt"] if table.salted else [])
    placed = entries.repartition(table.width, *order).persist()
    return EntryTable(
        placed, table.keys, table.width, table.salted, table.n, table.uneven,
        [*table.cached, placed],
    )


def focus(
    adj: DataFrame,
    params: FocusParams = FocusParams(),
    keys: Sequence[str] = (),
    steps: int | None = None,
    start: DataFrame | None = None,
    prior: DataFrame | None = None,
    tolerance: float | None = None,
) -> Focus:
    """Focus of ``adj(src, dst, w)``; with ``keys``, of many graphs side by side.

    ``steps`` fixes the step count; otherwise each graph runs the count its
    contraction coefficient asks for.
    """
    keys = tuple(keys)
    if keys and params.krylov_steps and steps is None and start is None and prior is None and tolerance is None:
        few, large = bundled(adj, keys, start_value, lambda made: _bundled_facts(made, params), FACTS)
        if few is not None:
            done = _bundled_focus(few, adj, keys, params)
            return done if large is None else _beside(done, _focus(large, params, keys))
    return _focus(adj, params, keys, steps, start, prior, tolerance)


def _focus(adj, params, keys, steps=None, start=None, prior=None, tolerance=None) -> Focus:
    table = entry_table(adj, keys)
    if table.cells() is None and table.n == 0:
        fields = [f"{k} {t}" for k, t in adj.dtypes if k in keys]
        fields.append(f"id {dict(adj.dtypes)['src']}")
        fields += [f"{c} double" for c in ("focus", "diffusion", "springs", "heat")]
        empty = adj.sparkSession.createDataFrame([], ", ".join(fields))
        return Focus(empty, Spectrum(0.0, 0.0, 0.0, 0), 0)
    if keys:
        found = spectra(table, params)
        counts = found.select(
            *keys, (F.col("steps") if steps is None else F.lit(steps)).alias("steps")
        )
        done = run_focus(table, counts, table.settle(spectral_bound(table)), params, start, prior)
        done.spectra = found
    else:
        found = spectrum(table, params) if steps is None else None
        done = run_focus(
            table, found.steps if steps is None else steps, spectral_bound(table), params, start,
            prior, tolerance,
        )
        done.found = found or (lambda: _spectrum_of(adj, params))
    table.release()
    return done


def _spectrum_of(adj: DataFrame, params: FocusParams) -> Spectrum:
    table = entry_table(adj)
    found = spectrum(table, params)
    table.release()
    return found


def spectra(table: EntryTable, params: FocusParams = FocusParams()) -> DataFrame:
    """(keys, lambda_max, lambda_2, kappa, steps) of every graph in the table."""
    if params.krylov_steps:
        with planned_for(table):
            found = krylov_ends(table, params.krylov_steps)
    else:
        tops = table.settle(lambda_max(table, params.power_steps))
        gaps = lambda_2(table, tops, params.gap_steps)
        found = tops.join(gaps, list(table.keys))
    found = found.withColumn("kappa", contraction("lambda_max", "lambda_2", params))
    return table.settle(
        found.withColumn("steps", steps_to("kappa", params.epsilon, params.step_cap))
    )
