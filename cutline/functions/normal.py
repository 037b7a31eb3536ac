"""Normal CDF and its inverse as Column expressions.

Spark has neither. The CDF uses Cody's rational Chebyshev approximations of
erf/erfc (Math. Comp. 23, 1969); the inverse is Wichura's AS 241 (PPND16). Both
are good to about 1e-15, stay inside code generation, and need no Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody erf, |x| <= 0.46875 (numerator, denominator; x^2 ascending).
ERF_NUM = (3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02,
           3.16112374387056560e00, 1.85777706184603153e-1)
ERF_DEN = (2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02,
           2.36012909523441209e01, 1.0)
# Cody erfc, 0.46875 < x <= 4 (x ascending).
ERFC_NUM = (1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03,
            8.81952221241769090e02, 2.98635138197400131e02, 6.61191906371416295e01,
            8.88314979438837594e00, 5.64188496988670089e-1, 2.15311535474403846e-8)
ERFC_DEN = (1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03,
            3.29079923573345963e03, 1.62138957456669019e03, 5.37181101862009858e02,
            1.17693950891312499e02, 1.57449261107098347e01, 1.0)
# Cody erfc tail, x > 4 (1/x^2 ascending).
TAIL_NUM = (6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1,
            3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2)
TAIL_DEN = (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1,
            1.87295284992346725e00, 2.56852019228982242e00, 1.0)
INV_SQRT_PI = 5.6418958354775628695e-1
SQRT2 = 1.4142135623730951

# AS 241 PPND16 central, middle and tail ratios (ascending).
PPND_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
          1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
          3.3430575583588128105e4, 2.5090809287301226727e3)
PPND_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
          2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
          5.2264952788528545610e3)
PPND_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
          3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
          2.27238449892691845833e-2, 7.74545014278341407640e-4)
PPND_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
          1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
          1.05075007164441684324e-9)
PPND_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
          2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
          2.71155556874348757815e-5, 2.01033439929228813265e-7)
PPND_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
          2.04426310338993978564e-15)


def _poly(x: Column, ascending: tuple[float, ...]) -> Column:
    out = F.lit(float(ascending[-1]))
    for coefficient in reversed(ascending[:-1]):
        out = out * x + float(coefficient)
    return out


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once, however often ``v`` is used.

    Written out inline, nested rational functions repeat their argument at every
    coefficient and outgrow a generated method; a bound lambda variable does not.
    """
    return F.transform(F.array(value), body)[0]


def _erfc_of(x: Column) -> Column:
    def upper(y: Column) -> Column:
        def tail(inverse: Column) -> Column:
            ratio = _poly(inverse, TAIL_NUM) / _poly(inverse, TAIL_DEN)
            return F.exp(-y * y) * (F.lit(INV_SQRT_PI) - inverse * ratio) / y

        middle = F.exp(-y * y) * _poly(y, ERFC_NUM) / _poly(y, ERFC_DEN)
        far = let(F.lit(1.0) / (y * y), tail)
        return F.when(y <= 4.0, middle).when(y <= 27.0, far).otherwise(0.0)

    small = let(x * x, lambda x2: F.lit(1.0) - x * _poly(x2, ERF_NUM) / _poly(x2, ERF_DEN))
    signed = let(F.abs(x), upper)
    return F.when(F.abs(x) <= 0.46875, small).otherwise(F.when(x < 0, F.lit(2.0) - signed).otherwise(signed))


def erfc(x: Column) -> Column:
    return let(x, _erfc_of)


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * erfc(-z / SQRT2)


def _ppf_of(p: Column) -> Column:
    def central(q: Column) -> Column:
        return let(F.lit(0.180625) - q * q, lambda r: q * _poly(r, PPND_A) / _poly(r, PPND_B))

    def outer(r: Column) -> Column:
        near = let(r - 1.6, lambda v: _poly(v, PPND_C) / _poly(v, PPND_D))
        far = let(r - 5.0, lambda v: _poly(v, PPND_E) / _poly(v, PPND_F))
        return F.when(r <= 5.0, near).otherwise(far)

    size = let(F.sqrt(-F.log(F.least(p, F.lit(1.0) - p))), outer)
    return (
        F.when(~((p > 0.0) & (p < 1.0)), F.lit(None).cast("double"))
        .when(F.abs(p - 0.5) <= 0.425, let(p - 0.5, central))
        .when(p < 0.5, -size)
        .otherwise(size)
    )


def normal_ppf(p: Column) -> Column:
    """Inverse of :func:`normal_cdf` on (0, 1); NULL outside it."""
    return let(p, _ppf_of)


# --- the same over arrays, for what is scored in Arrow batches ---------------


def _ratio(x: np.ndarray, above: tuple[float, ...], below: tuple[float, ...]) -> np.ndarray:
    return np.polynomial.polynomial.polyval(x, above) / np.polynomial.polynomial.polyval(x, below)


def erfc_array(x: np.ndarray) -> np.ndarray:
    y = np.abs(x)
    out = np.zeros(len(x))
    small, middle, far = y <= 0.46875, (y > 0.46875) & (y <= 4), (y > 4) & (y <= 27)
    out[small] = 1 - x[small] * _ratio(x[small] ** 2, ERF_NUM, ERF_DEN)
    v = y[middle]
    out[middle] = np.exp(-v * v) * _ratio(v, ERFC_NUM, ERFC_DEN)
    v = y[far]
    inverse = 1 / (v * v)
    out[far] = np.exp(-v * v) * (INV_SQRT_PI - inverse * _ratio(inverse, TAIL_NUM, TAIL_DEN)) / v
    turned = ~small & (x < 0)
    out[turned] = 2 - out[turned]
    out[np.isnan(x)] = np.nan
    return out


def ppf_array(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal CDF on (0, 1); NaN outside it."""
    out = np.full(len(p), np.nan)
    q = p - 0.5
    inside = (p > 0) & (p < 1)
    central = inside & (np.abs(q) <= 0.425)
    v = q[central]
    out[central] = v * _ratio(0.180625 - v * v, PPND_A, PPND_B)
    outer = np.flatnonzero(inside & ~central)
    r = np.sqrt(-np.log(np.minimum(p[outer], 1 - p[outer])))
    near = r <= 5
    size = np.empty(len(r))
    size[near], size[~near] = _ratio(r[near] - 1.6, PPND_C, PPND_D), _ratio(r[~near] - 5.0, PPND_E, PPND_F)
    out[outer] = np.where(q[outer] < 0, -size, size)
    return out
