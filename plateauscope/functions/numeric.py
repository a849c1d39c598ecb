"""Column expressions for probabilities, seeded draws and orderings.

Everything here is a pure ``Column``: it stays inside whole-stage codegen and
gives the same value on every partition layout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's coefficients of the inverse normal distribution.
NORM_INV_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
              1.38357751867269e2, -3.066479806614716e1, 2.506628277459239)
NORM_INV_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2,
              6.680131188771972e1, -1.328068155288572e1)
NORM_INV_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838,
              -2.549732539343734, 4.374664141464968, 2.938163982698783)
NORM_INV_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996,
              3.754408661907416)
NORM_INV_TAIL = 0.02425

# Abramowitz and Stegun 26.2.17.
NORM_CDF_P = 0.2316419
NORM_CDF_DENSITY = 0.3989422804014327
NORM_CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

EULER_GAMMA = 0.5772156649015329


def _poly(x: Column, coefficients, tail: Column | None = None) -> Column:
    """Horner form, highest power first; ``tail`` is an extra constant term."""
    terms = [F.lit(c) for c in coefficients] + ([tail] if tail is not None else [])
    return reduce(lambda acc, c: acc * x + c, terms)


def norm_inv(p: Column) -> Column:
    """Inverse of the standard normal distribution; NULL outside (0, 1)."""
    one = F.lit(1.0)
    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    q = p - 0.5
    r = q * q
    tail = lambda z: _poly(z, NORM_INV_C) / _poly(z, NORM_INV_D, one)
    return (
        F.when((p > 0) & (p < NORM_INV_TAIL), tail(low))
        .when((p > 1 - NORM_INV_TAIL) & (p < 1), -tail(high))
        .when((p > 0) & (p < 1), _poly(r, NORM_INV_A) * q / _poly(r, NORM_INV_B, one))
    )


def norm_cdf(z: Column) -> Column:
    t = 1 / (1 + NORM_CDF_P * F.abs(z))
    series = _poly(t, tuple(reversed(NORM_CDF_B)), F.lit(0.0))
    upper = NORM_CDF_DENSITY * F.exp(-z * z / 2) * series
    return F.when(z > 0, 1 - upper).otherwise(upper)


def expected_max_z(n: Column) -> Column:
    """Expected maximum of ``n`` standard normals."""
    g = EULER_GAMMA
    n = n.cast("double")
    return F.when(
        n > 1, (1 - g) * norm_inv(1 - 1 / n) + g * norm_inv(1 - 1 / (n * F.e())))


def expected_maximum(mu: Column, sigma: Column, n: Column) -> Column:
    return mu + sigma * expected_max_z(n)


def max_quantile_z(n: Column, p: float = 0.95) -> Column:
    """Quantile ``p`` of the maximum of ``n`` standard normals, from the tail."""
    n = n.cast("double")
    return F.when(n >= 1, -norm_inv(-F.expm1(F.ln(F.lit(p)) / n)))


def chi2_survival_even(x: Column, dof: int) -> Column:
    """P(chi-square > x) for an even number of degrees of freedom."""
    half = x / 2
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, dof // 2):
        term = term * half / i
        total = total + term
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.exp(-half) * total)


# --------------------------------------------------------------------------
# Seeded draws
# --------------------------------------------------------------------------
# Fixed values of the counter-based generator: the n-th draw depends on the
# seed and on n alone, so a draw never depends on partitioning or on order.
DRAW_STEP = 0x6D2B79F5
WORD = 4294967296


def uniform(seed: Column | int, n: Column | int) -> Column:
    """Uniform draw in [0, 1) number ``n`` (from 1) of the stream ``seed``.

    The nested ``transform`` calls name each intermediate word once, so the
    expression stays short however large the plan around it grows.
    """
    seed = F.lit(seed) if isinstance(seed, int) else seed
    n = F.lit(n) if isinstance(n, int) else n
    state = F.pmod(seed.cast("long") + F.pmod(n.cast("long"), F.lit(WORD)) * DRAW_STEP,
                   F.lit(WORD))

    def step(word: Column, fn) -> Column:
        return F.transform(F.array(word), fn)[0]

    def shifted(w: Column, bits: int) -> Column:
        return F.shiftrightunsigned(w, bits)

    def mul(a: Column, b: Column) -> Column:
        low = b.bitwiseAND(65535)
        high = shifted(b, 16)
        return (a * low + (a.bitwiseAND(65535) * high).bitwiseAND(65535) * 65536
                ).bitwiseAND(4294967295)

    first = step(state, lambda s: mul(s.bitwiseXOR(shifted(s, 15)), s.bitwiseOR(F.lit(1))))
    second = step(first, lambda t: F.pmod(
        t + mul(t.bitwiseXOR(shifted(t, 7)), t.bitwiseOR(F.lit(61))), F.lit(WORD)
    ).bitwiseXOR(t))
    last = step(second, lambda t: t.bitwiseXOR(shifted(t, 14)))
    return last.cast("double") / float(WORD)


# --------------------------------------------------------------------------
# Order buckets
# --------------------------------------------------------------------------
OCTAVE_STEPS = 256


def order_bucket(x: Column) -> Column:
    """Monotone integer bucket of a double: ``OCTAVE_STEPS`` per power of two.

    The bucket depends on the value alone, needs no sample and no range, and
    follows the scale of the data. It lets a global order inside one very large
    group be built from many small sorts. A rounded-up logarithm at a power of
    two lands on the neighbouring index, so the order is never broken.
    """
    x = x.cast("double")
    size = F.abs(x)
    octave = F.floor(F.log2(size))
    cell = octave * OCTAVE_STEPS + F.floor(size / F.pow(F.lit(2.0), octave) * OCTAVE_STEPS)
    shifted = cell + 1100 * OCTAVE_STEPS
    return (F.when(x == 0, F.lit(0))
            .when(x > 0, shifted)
            .otherwise(-shifted).cast("long"))


# --------------------------------------------------------------------------
# Statistics of a short array (neighbour lists, replicate lists)
# --------------------------------------------------------------------------

def sorted_quantile(arr: Column, q: float) -> Column:
    """Linear interpolation at (n-1)q of a sorted array."""
    n = F.size(arr)
    pos = (n - 1) * F.lit(float(q))
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    low, high = F.get(arr, lo), F.get(arr, hi)
    return F.when(n > 0, low + (high - low) * (pos - lo))


def floor_quantile(arr: Column, q: float) -> Column:
    """Element at floor(q n), the convention of the simulation tables."""
    n = F.size(arr)
    at = F.least(n - 1, F.greatest(F.lit(0), F.floor(n * F.lit(float(q))).cast("int")))
    return F.when(n > 0, F.get(arr, at))
