"""Small column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Round half towards +infinity, the rule the expected results follow."""
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def safe_div(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, or ``default`` where b is zero."""
    d = F.when(b == 0, F.lit(default).cast("double")).otherwise(a / b)
    return d


def log_growth(gain: Column) -> Column:
    """ln of a growth factor; minus infinity for a total loss, so that sums over it compound to zero."""
    return F.when(gain <= 0, F.lit(float("-inf"))).otherwise(F.ln(gain))


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose bound ``x`` exceeds, from the highest bound down."""
    out = None
    for bound, label in steps:
        out = F.when(x > bound, label) if out is None else out.when(x > bound, label)
    return out.otherwise(otherwise)


def signed(side: Column, volume: Column) -> Column:
    return F.when(side == "buy", volume).otherwise(-volume)


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF by the Abramowitz-Stegun 7.1.26 error function."""
    # Coefficients of the published approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / F.lit(2.0 ** 0.5)
    t = 1.0 / (1.0 + p * z)
    poly = ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t
    erf = 1.0 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(2.5066282746310002)


def sample_sd(n: Column, s1: Column, s2: Column) -> Column:
    """Sample deviation from power sums, 0 below two rows."""
    var = (s2 - s1 * s1 / n) / (n - 1)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
