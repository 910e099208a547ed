"""Scalar column builders with explicit NULL rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HORIZON_DAYS = {"1M": 21, "2M": 42, "3M": 63, "6M": 126, "9M": 189, "12M": 252}


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounding that engines agree on: a shift moves exact halves away from the tie."""
    return F.round(x + 1e-9, digits)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamp; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def linear_scale(x: Column, low: float, high: float) -> Column:
    return clip((x - low) / (high - low))


def row_mean(*cols: Column) -> Column:
    """Mean of the columns that are not NULL; NULL if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, n)


def centred_score(x: Column, span: float) -> Column:
    """0.5 plus x over twice the span, clamped; NULL counts as neutral."""
    return F.coalesce(clip(F.lit(0.5) + x / (2 * span)), F.lit(0.5))


def zfill(x: Column, width: int) -> Column:
    """Pad with zeros; longer strings stay whole (lpad would cut them)."""
    return F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational approximation of erf (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def weighted(weights: dict[str, float], default: float = 0.5) -> Column:
    """Sum of weight * clip(column), missing values at the default."""
    return reduce(lambda a, b: a + b, [F.lit(w) * clip(F.coalesce(F.col(c), F.lit(default))) for c, w in weights.items()])


def rule_array(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order; a NULL condition does not hold."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]), lambda x: x.isNotNull())


def horizon_days(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in HORIZON_DAYS.items() for x in kv])[name]


def nearest_horizon(days: Column) -> Column:
    """The horizon whose days are nearest; the shorter of two equally near ones."""
    nearest = F.array_min(F.array(*[F.struct(F.abs(days - d).alias("off"), F.lit(d).alias("d"), F.lit(n).alias("name")) for n, d in HORIZON_DAYS.items()]))
    return nearest["name"]
