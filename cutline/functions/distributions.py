"""The two distribution families, scored in closed form from stored parameters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline import constants as K
from cutline.functions.normal import SQRT2, erfc, erfc_array, normal_ppf, ppf_array


# --- zero-inflated log-normal ------------------------------------------------


def zil_mean(p_zero: Column, mu: Column, sigma: Column) -> Column:
    return (F.lit(1.0) - p_zero) * F.exp(mu + sigma * sigma / 2.0)


def zil_at_least(p_zero: Column, mu: Column, sigma: Column, threshold: Column) -> Column:
    """P(X >= threshold); NULL where the parameters cannot be a distribution."""
    t = threshold.cast("double")
    z = (F.log(F.when(t > 0, t)) - mu) / F.when(sigma > 0, sigma)
    tail = (F.lit(1.0) - p_zero) * F.lit(0.5) * erfc(z / SQRT2)
    usable = (sigma > 0) & p_zero.between(0.0, 1.0) & mu.isNotNull() & ~F.isnan(mu)
    return F.when(usable, F.when(t <= 0, F.lit(1.0)).otherwise(tail))


def zil_quantiles(p_zero: Column, mu: Column, sigma: Column, grid: tuple[float, ...] = K.QUANTILE_GRID) -> Column:
    """Array of quantiles, one per grid point."""
    share = F.lit(1.0) - p_zero

    def at(q: Column) -> Column:
        inner = (q - p_zero) / F.when(share > 0, share)
        return F.when(p_zero >= q, F.lit(0.0)).otherwise(F.exp(mu + sigma * normal_ppf(inner)))

    return F.transform(F.lit(list(grid)), at)


# --- negative binomial -------------------------------------------------------


def nb_fit(mean: Column, variance: Column) -> dict[str, Column]:
    """Method of moments with the dispersion held above the mean."""
    m = F.when(mean > 0, mean)
    v = F.greatest(variance, m * K.COUNT_MIN_DISPERSION)
    return {"r": m * m / (v - m), "p": m / v}


def nb_mean(r: Column, p: Column) -> Column:
    return r * (F.lit(1.0) - p) / F.when(p > 0, p)


#: Beyond these a row isn't walked count by count; nor is a threshold or quantile over ``_FAR``.
_LOG_ZERO, _FAR = -600.0, 5_000.0
_HALF_LOG_2PI = 0.5 * np.log(2 * np.pi)


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """What Stirling's formula lacks of the logarithm of the gamma function."""
    out, large = np.empty(len(z)), z >= 10
    x = 1 / z[large] ** 2
    out[large] = (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x * (1 / 1680 - x * (1 / 1188 - x * 691 / 360360))))) / z[large]
    small = z[~large]
    out[~large] = np.array([math.lgamma(v) for v in small]) - ((small - 0.5) * np.log(small) - small + _HALF_LOG_2PI)
    return out


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, evaluated forwards."""
    h, live = np.ones(len(a)), np.arange(len(a))
    c, d = np.ones(len(a)), 1 / (1 - (a + b) * x / (a + 1))
    h, m = d.copy(), 0
    while len(live):
        m += 1
        u, v, w = a[live], b[live], x[live]
        step = m * (v - m) * w / ((u + 2 * m - 1) * (u + 2 * m))
        dd, cc = 1 / (1 + step * d[live]), 1 + step / c[live]
        h[live] *= dd * cc
        step = -(u + m) * (u + v + m) * w / ((u + 2 * m) * (u + 2 * m + 1))
        dd, cc = 1 / (1 + step * dd), 1 + step / cc
        d[live], c[live] = dd, cc
        h[live] *= dd * cc
        live = live[np.abs(dd * cc - 1) > 1e-15]
    return h


def nb_upper(r: np.ndarray, p: np.ndarray, k: np.ndarray) -> np.ndarray:
    """P(X >= k) for whole k by the regularised incomplete beta function: some square root of k steps, for parameters of any size."""
    out = np.where(k <= 0, 1.0, 0.0)
    rows = np.flatnonzero((k > 0) & (p < 1))
    if not len(rows):
        return out
    a, b, y = k[rows].astype(float), r[rows], p[rows]
    x = 1 - y
    gap = b * x - a * y
    front = np.exp(a * np.log1p(gap / a) + b * np.log1p(-gap / b) + 0.5 * np.log(a / (a + b) * b) - _HALF_LOG_2PI
                   + _stirling_rest(a + b) - _stirling_rest(a) - _stirling_rest(b))
    low = x < (a + 1) / (a + b + 2)
    value = np.empty(len(rows))
    value[low] = front[low] * _fraction(a[low], b[low], x[low]) / a[low]
    value[~low] = 1 - front[~low] * _fraction(b[~low], a[~low], y[~low]) / b[~low]
    out[rows] = np.clip(value, 0.0, 1.0)
    return out


def _searched(r: np.ndarray, p: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Quantiles (rows by grid) by bisection of :func:`nb_upper`."""
    rr, pp, q = np.repeat(r, len(grid)), np.repeat(p, len(grid)), np.tile(grid, len(r))
    below = lambda rows, k: 1 - nb_upper(rr[rows], pp[rows], k + 1)
    high = np.maximum(1.0, np.ceil(rr * (1 - pp) / pp + 10 * np.sqrt(rr * (1 - pp)) / pp))
    rows = np.arange(len(rr))
    while len(rows):
        rows = rows[below(rows, high[rows]) < q[rows] - 1e-15]
        high[rows] *= 2
    low = np.full(len(rr), -1.0)
    rows = np.arange(len(rr))
    while len(rows):
        middle = np.floor((low[rows] + high[rows]) / 2)
        reached = below(rows, middle) >= q[rows] - 1e-15
        high[rows[reached]], low[rows[~reached]] = middle[reached], middle[~reached]
        rows = rows[high[rows] - low[rows] > 1]
    return high.reshape(len(r), len(grid))


def _first_masses(r: float, p: float, cap: int) -> np.ndarray:
    """P(X = 0..cap) from sums of logarithms."""
    k = np.arange(1, cap + 1, dtype=float)
    return np.exp(np.append(0.0, np.cumsum(np.log((r + k - 1) / k) + np.log1p(-p))) + r * np.log(p)) if p < 1 else np.append(1.0, np.zeros(cap))


def _split(rr: np.ndarray, pp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of small counts, and the other usable rows."""
    usable = (rr > 0) & (pp > 0) & (pp <= 1) & np.isfinite(rr)
    with np.errstate(all="ignore"):
        far = usable & ((rr * np.log(pp) < _LOG_ZERO) | (rr * (1 - pp) / pp + 12 * np.sqrt(rr * (1 - pp)) / pp > _FAR))
    return np.flatnonzero(usable & ~far), np.flatnonzero(far)


def _numbers(values: pd.Series | pa.Array) -> np.ndarray:
    """A batch as doubles, NaN for NULL."""
    if isinstance(values, pa.Array):
        return values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.to_numpy("float64", na_value=np.nan)


_TABLE_SCHEMA = T.StructType([
    T.StructField("pmf", T.ArrayType(T.DoubleType())),
    T.StructField("quantiles", T.ArrayType(T.DoubleType())),
])


@F.pandas_udf(_TABLE_SCHEMA)
def nb_table(r: pd.Series, p: pd.Series, cap: pd.Series) -> pd.DataFrame:
    """PMF 0..cap and grid quantiles of a batch of count distributions; NULL for a row that is no distribution.

    Small counts run the recurrence across all rows of like cap at once, and leave
    it as they reach the last quantile; for large ones quantiles are bisected and
    masses come from logarithms.
    """
    pmf, ends, quantiles, counted = _tables(_numbers(r), _numbers(p), cap.fillna(0).to_numpy("int64"))
    split = lambda parts: pd.Series([x if c else None for x, c in zip(parts, counted)], dtype=object)
    return pd.DataFrame({"pmf": split(np.split(pmf, ends[1:-1]) if len(counted) else []), "quantiles": split(quantiles)})


def _tables(rr: np.ndarray, pp: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """PMFs of a batch behind one another and where each ends, grid quantiles (rows by grid), and which rows are a distribution."""
    near, far = _split(rr, pp)
    grid = np.array(K.QUANTILE_GRID)
    counted = np.zeros(len(rr), bool)
    counted[near] = counted[far] = True
    ends = np.append(0, np.cumsum(np.where(counted, caps + 1, 0)))
    out_pmf, out_q = np.empty(ends[-1]), np.full((len(rr), len(grid)), np.nan)
    for width in np.unique(caps[near]):
        rows = near[caps[near] == width]
        pmf, out_q[rows] = _walked(rr[rows], pp[rows], int(width) + 1, grid)
        out_pmf[ends[rows][:, None] + np.arange(width + 1)] = pmf
    out_q[far] = _searched(rr[far], pp[far], grid)
    for row in far:
        out_pmf[ends[row] : ends[row + 1]] = _first_masses(rr[row], pp[row], int(caps[row]))
    return out_pmf, ends, out_q, counted


def _walked(shape: np.ndarray, p: np.ndarray, width: int, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fail, mass = 1.0 - p, p**shape
    pmf = np.empty((len(shape), width))
    pmf[:, 0] = mass
    quantiles = np.where(mass[:, None] >= grid, 0.0, np.nan)
    reached, live, k = mass.copy(), np.arange(len(shape)), 0
    while k + 1 < width or len(live):
        k += 1
        rows = slice(None) if k < width else live
        mass[rows] = mass[rows] * (shape[rows] + k - 1.0) / k * fail[rows]
        if k < width:
            pmf[:, k] = mass
        reached[live] += mass[live]
        quantiles[live] = np.where((reached[live][:, None] >= grid) & np.isnan(quantiles[live]), float(k), quantiles[live])
        live = live[np.isnan(quantiles[live][:, -1])]
        if k >= _FAR and len(live):  # a long tail
            quantiles[live], live = _searched(shape[live], p[live], grid), live[:0]
    return pmf, quantiles


@F.pandas_udf(T.DoubleType())
def _nb_tail(r: pd.Series, p: pd.Series, threshold: pd.Series) -> pd.Series:
    """P(X >= threshold) of a batch: near thresholds by as many terms as they ask for, others by the incomplete beta function."""
    return pd.Series(_tails(_numbers(r), _numbers(p), _numbers(threshold)))


def _tails(rr: np.ndarray, pp: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    near, far = _split(rr, pp)
    k = np.ceil(threshold)
    out = np.full(len(rr), np.nan)
    near = near[~np.isnan(k[near])]
    far = np.concatenate([far[~np.isnan(k[far])], near[k[near] > _FAR]])
    near = near[k[near] <= _FAR]
    out[near] = 1.0
    order = near[np.argsort(-k[near], kind="stable")]
    order = order[k[order] > 0]
    mass, shape, fail, last = pp[order] ** rr[order], rr[order], 1.0 - pp[order], k[order]
    below, step, n = mass.copy(), 1, int((last > 1).sum())
    while n:  # the rows whose threshold lies beyond this count come first
        mass[:n] = mass[:n] * (shape[:n] + step - 1.0) / step * fail[:n]
        below[:n] += mass[:n]
        step += 1
        n = int(np.searchsorted(-last, -step))
    out[order] = np.clip(1.0 - below, 0.0, 1.0)
    out[far] = nb_upper(rr[far], pp[far], k[far])
    return out


_SCORE_SCHEMA = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("pmf", "quantiles", "probabilities")])


def _lists(values: np.ndarray, ends: np.ndarray, known: np.ndarray) -> pa.Array:
    """Arrays behind one another as a list column, NULL where not ``known``."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64(), from_pandas=True), mask=pa.array(~known))


def _smooth(family: pa.Array, z: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which rows of a batch are zero-inflated log-normal."""
    with np.errstate(all="ignore"):
        continuous = pc.fill_null(pc.equal(family, K.CONTINUOUS), False).to_numpy(zero_copy_only=False)
        return continuous & (s > 0) & (z >= 0) & (z <= 1) & ~np.isnan(m)


def _shapes(family: pa.Array, z: np.ndarray, m: np.ndarray, s: np.ndarray, rr: np.ndarray, pp: np.ndarray, cap: pa.Array) -> list[pa.Array]:
    """PMF (counts only) and grid quantiles of a batch."""
    n, grid = len(family), np.array(K.QUANTILE_GRID)
    pmf, pmf_ends, quantiles, counted = _tables(rr, pp, cap.fill_null(0).to_numpy(zero_copy_only=False).astype("int64"))
    smooth = _smooth(family, z, m, s)
    with np.errstate(all="ignore"):
        which = np.flatnonzero(smooth)
        inner = (grid[None, :] - z[which, None]) / np.where(z[which] < 1, 1 - z[which], np.nan)[:, None]
        quantiles[which] = np.where(z[which, None] >= grid, 0.0, np.exp(m[which, None] + s[which, None] * ppf_array(inner.ravel()).reshape(inner.shape)))
    return [_lists(pmf, pmf_ends, counted & ~smooth), _lists(quantiles.ravel(), np.arange(n + 1) * len(grid), counted | smooth)]


def _all_tails(family: pa.Array, z: np.ndarray, m: np.ndarray, s: np.ndarray, rr: np.ndarray, pp: np.ndarray, thresholds: pa.Array) -> pa.Array:
    """P(X >= t) of each threshold of a batch."""
    sizes = thresholds.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    flat, owner = _numbers(thresholds.flatten()), np.repeat(np.arange(len(family)), sizes)
    tails = _tails(rr[owner], pp[owner], flat)
    smooth = _smooth(family, z, m, s)
    near, far = _split(rr, pp)
    known = smooth.copy()
    known[near] = known[far] = True
    with np.errstate(all="ignore"):
        rows = smooth[owner]
        own, t = owner[rows], flat[rows]
        score = (np.log(np.where(t > 0, t, np.nan)) - m[own]) / s[own]
        tails[rows] = np.where(t <= 0, 1.0, (1 - z[own]) * 0.5 * erfc_array(score / SQRT2))
    return _lists(tails, np.append(0, np.cumsum(sizes)), known)


@F.arrow_udf(_SCORE_SCHEMA)
def score_table(
    family: pa.Array, p_zero: pa.Array, mu: pa.Array, sigma: pa.Array, r: pa.Array, p: pa.Array, cap: pa.Array, thresholds: pa.Array
) -> pa.Array:
    """All that is read off a batch of distributions in one pass: PMF (counts only), grid quantiles, P(X >= t) of each threshold.

    NULL for a row of no family or with parameters that are no distribution. Results stay flat: no row is an object of its own.
    """
    batch = (family, *(_numbers(x) for x in (p_zero, mu, sigma, r, p)))
    return pa.StructArray.from_arrays([*_shapes(*batch, cap), _all_tails(*batch, thresholds)], names=["pmf", "quantiles", "probabilities"])


@F.arrow_udf(T.StructType(_SCORE_SCHEMA.fields[:2]))
def shape_table(family: pa.Array, p_zero: pa.Array, mu: pa.Array, sigma: pa.Array, r: pa.Array, p: pa.Array, cap: pa.Array) -> pa.Array:
    """The PMF and quantiles of :func:`score_table`, for who doesn't read its probabilities."""
    return pa.StructArray.from_arrays(_shapes(family, *(_numbers(x) for x in (p_zero, mu, sigma, r, p)), cap), names=["pmf", "quantiles"])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def tail_table(family: pa.Array, p_zero: pa.Array, mu: pa.Array, sigma: pa.Array, r: pa.Array, p: pa.Array, thresholds: pa.Array) -> pa.Array:
    """The probabilities of :func:`score_table`, for who reads nothing else."""
    return _all_tails(family, *(_numbers(x) for x in (p_zero, mu, sigma, r, p)), thresholds)


def nb_pmf(r: Column, p: Column, cap: Column) -> Column:
    """P(X = k) for k = 0..cap."""
    return nb_table(r, p, cap)["pmf"]


def nb_quantiles(r: Column, p: Column) -> Column:
    """Array of quantiles, one per grid point, however far past a stored PMF they lie."""
    return nb_table(r, p, F.lit(0))["quantiles"]


def nb_at_least(r: Column, p: Column, threshold: Column) -> Column:
    """P(X >= threshold), exact past any stored PMF; NULL where the parameters cannot be a distribution."""
    return _nb_tail(r, p, threshold.cast("double"))


def mass_sum(pmf: Column) -> Column:
    return F.aggregate(pmf, F.lit(0.0), lambda a, x: a + x)


def nb_tail_mass(pmf: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - mass_sum(pmf))


# --- any stored projection ---------------------------------------------------


def at_least(kind: Column, params: Column, threshold: Column) -> Column:
    """P(X >= threshold) from stored parameters; NULL for an unknown kind.

    ``params`` is a struct with p_zero, mu, sigma, r and p, NULL where the
    family does not use them.
    """
    return F.when(
        kind == K.KIND_ZIL, zil_at_least(params["p_zero"], params["mu"], params["sigma"], threshold)
    ).when(kind == K.KIND_NB, nb_at_least(params["r"], params["p"], threshold))


def shrink(sample: Column, n_eff: Column, prior: Column, k0: float = K.K0) -> Column:
    return (n_eff * sample + F.lit(k0) * prior) / (n_eff + k0)


def prior_weight(n_eff: Column, k0: float = K.K0) -> Column:
    return F.lit(k0) / (n_eff + k0)


def relative_width(family: Column, projected: Column, low: Column, high: Column) -> Column:
    cont, count = K.CONFIDENCE_BANDS[K.CONTINUOUS], K.CONFIDENCE_BANDS[K.COUNT]
    base = F.when(
        family == K.CONTINUOUS, F.greatest(projected, F.lit(cont["floor"])) + cont["offset"]
    ).otherwise(F.greatest(projected, F.lit(count["floor"])) + count["offset"])
    return (high - low) / base


def confidence(family: Column, n_eff: Column, width: Column) -> Column:
    cont, count = K.CONFIDENCE_BANDS[K.CONTINUOUS], K.CONFIDENCE_BANDS[K.COUNT]
    w_low = F.when(family == K.CONTINUOUS, cont["w_low"]).otherwise(count["w_low"])
    w_high = F.when(family == K.CONTINUOUS, cont["w_high"]).otherwise(count["w_high"])
    return (
        F.when(n_eff < K.MIN_HISTORY_FOR_MEDIUM, "low")
        .when(width > w_low, "low")
        .when((n_eff >= K.N_FOR_HIGH) & (width <= w_high), "high")
        .otherwise("medium")
    )


def actual_percentile(kind: Column, params: Column, actual: Column) -> Column:
    return F.bround(F.lit(1.0) - at_least(kind, params, actual + 1e-9), 4)
