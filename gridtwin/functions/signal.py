"""Signal-detection arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Acklam's rational approximation of the
# inverse normal distribution function, and the edge of its lower tail.
CENTRE_TOP = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
              1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
CENTRE_BOTTOM = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
                 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
               3.754408661907416e+00, 1.0)
TAIL_EDGE = 0.02425


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        value = value * x + F.lit(coefficient)
    return value


def probit(p: Column) -> Column:
    """Inverse of the standard normal distribution function, null outside (0, 1)."""
    def tail(probability: Column) -> Column:
        x = F.sqrt(-2.0 * F.ln(probability))
        return _polynomial(TAIL_TOP, x) / _polynomial(TAIL_BOTTOM, x)

    offset = p - 0.5
    square = offset * offset
    centre = offset * _polynomial(CENTRE_TOP, square) / _polynomial(CENTRE_BOTTOM, square)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < TAIL_EDGE, tail(p))
        .when(p > 1 - TAIL_EDGE, -tail(1 - p))
        .otherwise(centre)
    )


def corrected_rate(events: Column, trials: Column) -> Column:
    """Log-linear rate, which is never 0 or 1."""
    return (events + 0.5) / (trials + 1)


def sensitivity(hits: Column, positives: Column, false_alarms: Column, negatives: Column) -> Column:
    """d': null unless both classes were answered."""
    return F.when(
        (positives > 0) & (negatives > 0),
        probit(corrected_rate(hits, positives)) - probit(corrected_rate(false_alarms, negatives)),
    )
