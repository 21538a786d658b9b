"""Payoffs on a row's assets, and laws sampled by inverse transform."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of(assets: Column) -> Column:
    return F.aggregate(assets, F.lit(0.0), lambda a, s: a + s) / F.size(assets)


def basket_call(assets: Column, strike: float) -> Column:
    return F.greatest(mean_of(assets) - strike, F.lit(0.0))


def basket_put(assets: Column, strike: float) -> Column:
    return F.greatest(F.lit(strike) - mean_of(assets), F.lit(0.0))


def exponential_sample(uniform: Column, rate: float) -> Column:
    return -F.log1p(-uniform) / rate


def exponential_cdf(t: Column, rate: float) -> Column:
    return 1.0 - F.exp(-rate * t)


def exponential_pdf(t: Column, rate: float) -> Column:
    return rate * F.exp(-rate * t)


def basket_call_slope(assets: Column, strike: float) -> Column:
    """Gradient of the basket call: 1 / d in each asset where the mean is above the strike."""
    return F.transform(assets, lambda s: F.when(mean_of(assets) > strike, 1.0 / F.size(assets)).otherwise(F.lit(0.0)))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by a published rational approximation, errors below 1e-7 (26.2.17)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(x))
    poly = F.lit(0.0)
    #: fixed values of the approximation, highest power first
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + c) * t
    upper = F.exp(-x * x / 2) * (1.0 / math.sqrt(2 * math.pi)) * poly
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)


def black_scholes(spot: Column, strike: float, rate: float, sigma: float, horizon: float, call: bool = True) -> Column:
    """Closed-form price of a European call or put."""
    width = sigma * math.sqrt(horizon)
    d1 = (F.log(spot / strike) + (rate + sigma * sigma / 2) * horizon) / width
    way = 1.0 if call else -1.0
    return way * (spot * normal_cdf(way * d1) - strike * math.exp(-rate * horizon) * normal_cdf(way * (d1 - width)))


EPS = 2.0**-52
#: Margin of the strict comparisons, in units of EPS
MARGIN = 1e3


def almost_equal(a: Column, b: Column, ulps: float = 10) -> Column:
    return F.abs(a - b) <= EPS * F.greatest(F.abs(a + b), F.lit(1e-300)) * ulps


def lesser_or_equal(a: Column, b: Column, ulps: float = 10) -> Column:
    return (a < b) | almost_equal(a, b, ulps)


def strictly_lesser(a: Column, b: Column) -> Column:
    return a + F.greatest(F.abs(a), F.lit(1.0)) * MARGIN * EPS < b


def round_int_above(x: Column) -> Column:
    """Truncation after inflating by the margin: a number just below an integer counts as it."""
    return (x * (1 + MARGIN * EPS)).cast("long")
