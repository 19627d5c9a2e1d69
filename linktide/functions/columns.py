"""Column expressions: one row in, one value out, all inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from linktide.operators.keyed import ratio, safe_log

# Fixed values of the probability clamp and the two tensor encodings.
PROBABILITY_MARGIN = 1e-6
ENCODINGS = {"u16": (256, 32767, -32768), "u32": (65536, 2147483647, -2147483648)}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _col(x)))


def clamp_probability(p) -> Column:
    return clamp(p, PROBABILITY_MARGIN, 1 - PROBABILITY_MARGIN)


def binary_kl(a, b) -> Column:
    """Divergence in nats of the yes/no distribution ``a`` from ``b``."""
    p, q = clamp_probability(a), clamp_probability(b)
    return p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))


def signed_stake(valence, amount, token_weight=1) -> Column:
    """+amount, 0 or -amount by valence, scaled by the token weight."""
    weight = F.lit(token_weight) if isinstance(token_weight, (int, float)) else _col(token_weight)
    scaled = _col(amount) * weight
    return F.when(_col(valence) == 1, scaled).when(_col(valence) == -1, -scaled).otherwise(
        F.lit(0)
    )


def inhibited(weight, disbelief, strength: float) -> Column:
    """Weight reduced by market disbelief: w * (1 - strength * m)."""
    return _col(weight) * (1 - F.lit(float(strength)) * clamp(disbelief, 0, 1))


def price_weighted(stake, price) -> Column:
    return _col(stake) * clamp(price, 0, 1)


def karma_step(karma, score, rate: float) -> Column:
    return F.greatest(F.lit(0.0), _col(karma) + F.lit(float(rate)) * _col(score))


def surprise(score, scale: float) -> Column:
    """Score over scale, clipped to [0, 1]; 0 for a scale that is not positive."""
    if scale <= 0:
        return F.lit(0.0)
    return clamp(_col(score) / F.lit(float(scale)), 0, 1)


def pair_id(src, dst) -> Column:
    """Content id of the ordered pair (src, dst)."""
    return F.sha2(pair_text(src, dst), 256)


def pair_text(src, dst) -> Column:
    return F.concat(_col(src).cast("string"), F.lit("|"), _col(dst).cast("string"))


HASHED = "^[0-9a-f]{64}$"


def packed_id(c) -> Column:
    """An id as bytes: a content id takes 33 instead of 64, and different ids stay different."""
    whole = _col(c).cast("string")
    return F.when(whole.rlike(HASHED), F.concat(F.lit(b"\x01"), F.unhex(whole))).otherwise(
        F.concat(F.lit(b"\x00"), whole.cast("binary")))


def unpacked_id(c: str) -> Column:
    """The id of ``packed_id``, or that of the pair whose text comes after a 2."""
    kind, rest = F.expr(f"substring({c}, 1, 1)"), F.expr(f"substring({c}, 2)")
    return F.when(kind == F.lit(b"\x00"), rest.cast("string")).when(
        kind == F.lit(b"\x02"), F.sha2(rest, 256)).otherwise(F.lower(F.hex(rest)))


def quantize(values, encoding: str = "u16") -> Column:
    scale, high, low = ENCODINGS[encoding]
    return F.transform(
        _col(values),
        lambda x: F.greatest(F.lit(low), F.least(F.lit(high), F.round(x * scale))).cast("int"),
    )


def dequantize(values, encoding: str = "u16") -> Column:
    return F.transform(_col(values), lambda x: x / F.lit(float(ENCODINGS[encoding][0])))


def bonding_norm(yes, no) -> Column:
    return F.sqrt(_col(yes) * _col(yes) + _col(no) * _col(no))


def bonding_scale(deposit, yes, no) -> Column:
    """The constant a deposit fixes for a market that opens at (yes, no)."""
    return ratio(_col(deposit), bonding_norm(yes, no))


def bonding_columns(yes, no, scale) -> dict[str, Column]:
    """Prices, cost, reserves and forecast of a market at supplies (yes, no)."""
    y, n, s = _col(yes), _col(no), _col(scale)
    norm = bonding_norm(y, n)
    reserve_yes, reserve_no = ratio(s * y * y, norm), ratio(s * n * n, norm)
    return {
        "price_yes": ratio(s * y, norm),
        "price_no": ratio(s * n, norm),
        "cost": s * norm,
        "reserve_yes": reserve_yes,
        "reserve_no": reserve_no,
        "forecast": ratio(y * y, y * y + n * n),
    }


def epistemic_class(price, meta, tolerance: float = 0.05, floor: float = 0.1) -> Column:
    """Agreement class of a market price and the crowd's forecast of that price."""
    p, m = _col(price), _col(meta)
    return (
        F.when(m <= floor, "uncertain")
        .when(F.abs(p - m) <= tolerance, "aligned")
        .when(p > m, "private")
        .otherwise("herding")
    )


def supply_split(budget, staked_share, exponent: float) -> dict[str, Column]:
    share = F.pow(_col(staked_share), F.lit(float(exponent)))
    return {"work_pool": _col(budget) * (1 - share), "stake_pool": _col(budget) * share}


def gross_budget(floor, supply, fees, service_rate: float, burn_rate: float) -> Column:
    kept = (1 - service_rate) * (1 - burn_rate)
    return _col(floor) * _col(supply) + F.lit(kept) * _col(fees)


def net_inflation(floor, supply, fees, burn_rate: float) -> Column:
    return _col(floor) - ratio(_col(fees) * F.lit(float(burn_rate)), _col(supply))


def blended_reward(local_value, shapley_value, weight: float) -> Column:
    return weight * _col(local_value) + (1 - weight) * _col(shapley_value)


def contraction(lambda_max, lambda_2, params) -> Column:
    """Contraction coefficient of the blended step."""
    top = _col(lambda_max)
    return (
        F.lit(params.diffusion * params.alpha)
        + params.springs * ratio(top, top + params.mu)
        + params.heat * F.exp(-params.tau * _col(lambda_2))
    )


def steps_to(kappa, epsilon: float, cap: int) -> Column:
    """Smallest T with kappa^T <= epsilon, at most ``cap``."""
    k = _col(kappa)
    guess = F.ceil(F.lit(math.log(epsilon)) / F.log(k))
    exact = (
        F.when(F.pow(k, guess - 1) <= epsilon, guess - 1)
        .when(F.pow(k, guess) > epsilon, guess + 1)
        .otherwise(guess)
    )
    return (
        F.when(k >= 1, F.lit(cap))
        .when(k <= 0, F.lit(1))
        .otherwise(F.least(F.lit(cap), exact))
        .cast("int")
    )


def entropy_term(phi) -> Column:
    return -_col(phi) * safe_log(_col(phi))
