"""The normal distribution as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's rational approximation of the normal quantile, which
# is within 1.15e-9 of the true value, relative to it. Highest power first.
_MIDDLE_TOP = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
_MIDDLE_BOTTOM = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
_TAIL_TOP = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
_TAIL_BOTTOM = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
_TAIL_FROM = 0.02425
# Hart's rational approximation of the upper tail, for |x| < 7.07.
_HART_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_HART_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner's rule, highest power first."""
    return reduce(lambda sum_, c: sum_ * x + c, coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """The value below which a standard normal number lies with probability `p`.

    Infinite at 0 and 1, null outside.
    """
    q = p - 0.5
    middle = q * polynomial(q * q, _MIDDLE_TOP) / polynomial(q * q, _MIDDLE_BOTTOM)
    low = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(low))
    tail = polynomial(t, _TAIL_TOP) / polynomial(t, _TAIL_BOTTOM)
    return (
        F.when(low < 0, None)
        .when(p == 0, F.lit(float("-inf")))
        .when(p == 1, F.lit(float("inf")))
        .when(low >= _TAIL_FROM, middle)
        .otherwise(F.signum(0.5 - p) * tail)
    )


def normal_upper_tail(z: Column) -> Column:
    """The probability that a standard normal number is above `z`."""
    x = F.abs(z)
    density = F.exp(-x * x / 2)
    near = density * polynomial(x, _HART_TOP) / polynomial(x, _HART_BOTTOM)
    fraction = reduce(lambda f, k: x + k / f, (4.0, 3.0, 2.0, 1.0), x + 0.65)
    far = density / fraction / 2.506628274631
    tail = F.when(x < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, tail).otherwise(1 - tail)
