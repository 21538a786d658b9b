"""Nested Monte Carlo for semilinear and fully nonlinear parabolic equations.

-u_t - mu.Du - 1/2 tr(sigma sigma' D2u) = f(t, x, u, Du, D2u) with u(T) = g, by
random switching times: the source is evaluated at the next time, where u and its
derivatives are themselves means over fewer particles.  Root particles are rows of
a DataFrame; their trees are arrays, a level being one vectorised step; gradients
and Hessians come from Malliavin weights with antithetic points.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from halyard.control.regressors import list_array
from halyard.sources.noise import normals, uniforms


@dataclass(frozen=True)
class Exponential:
    rate: float

    def sample(self, u: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
        return -np.log(u) / self.rate

    def pdf(self, t):
        return self.rate * np.exp(-self.rate * t)

    def cdf(self, t):
        return -np.expm1(-self.rate * t)


@dataclass(frozen=True)
class Gamma:
    """Gamma law of a shape and a scale; numbers come from a generator of each row's own."""

    shape: float
    scale: float

    def sample(self, u: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
        """By inversion: the distribution function, halved down; a function of u alone."""
        low, high = np.zeros(len(u)), np.full(len(u), self.scale * (self.shape + 40 * math.sqrt(self.shape) + 40))
        for _ in range(60):
            middle = (low + high) / 2
            below = self.cdf(middle) < u
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        return (low + high) / 2

    def pdf(self, t):
        t = np.maximum(np.asarray(t, float), 1e-300)
        return np.exp((self.shape - 1) * np.log(t / self.scale) - t / self.scale - math.lgamma(self.shape)) / self.scale

    def cdf(self, t):
        """The regularised lower incomplete gamma function by its series, which converges for every argument."""
        z = np.asarray(t, float) / self.scale
        term = np.where(z > 0, np.exp(self.shape * np.log(np.maximum(z, 1e-300)) - z - math.lgamma(self.shape + 1)), 0.0)
        total, k = term.copy(), 1
        while k < 5000 and np.any(term > 1e-16 * np.maximum(total, 1e-300)):
            term = term * z / (self.shape + k)
            total, k = total + term, k + 1
        return np.minimum(total, 1.0)


@dataclass(frozen=True)
class Equation:
    """mu(t, x) [row, d], sigma(t, x) [row, d, d], f(t, x, u, du, d2u) [row], g(x) [row], all vectorised.

    ``order`` is the highest derivative that f reads.  For constant coefficients
    or linear ones an exact step(t, x, dt, w) may replace the Euler step.
    """

    mu: Callable
    sigma: Callable
    f: Callable
    g: Callable
    horizon: float
    law: object
    order: int = 0
    exact: Callable | None = None


def _move(e: Equation, t, x, dt, z):
    """(end points, sigma) of a step with normal numbers z [row, d]."""
    sigma = e.sigma(t, x)
    if e.exact is not None:
        return e.exact(t, x, dt, np.sqrt(dt)[:, None] * z), sigma
    return x + e.mu(t, x) * dt[:, None] + np.sqrt(dt)[:, None] * np.einsum("rij,rj->ri", sigma, z), sigma


def estimate(e: Equation, t: np.ndarray, x: np.ndarray, sizes: list[int], seed: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u [row], du [row, d], d2u [row, d, d]): means of sizes[0] particles from each (t, x), nested with the rest.

    A particle that switches before the horizon gives f / pdf there, one that
    does not gives g / (1 - cdf); at the deepest level f reads g for u.  Antithetic
    points, and for second derivatives the frozen one, are in each term.
    """
    n, d, m = len(x), x.shape[1], sizes[0]
    rows = np.repeat(np.arange(n), m)
    ids = keys[rows] * np.int64(m) + np.tile(np.arange(m), n)
    left = np.maximum(e.horizon - t, 1e-20)[rows]
    tau = e.law.sample(uniforms(seed, ids, len(sizes), 101), ids, seed)
    dt = np.maximum(np.minimum(tau, left), 1e-20)
    over = tau >= left - 1e-12
    z = normals(seed, ids, len(sizes), d)
    t0, x0 = t[rows], x[rows]
    weight = np.where(over, 1 / np.maximum(1 - e.law.cdf(dt), 1e-300), 1 / np.maximum(e.law.pdf(dt), 1e-300))

    def term(way):
        end, sigma = _move(e, t0, x0, dt, way * z)
        out = np.empty(len(rows))
        out[over] = e.g(end[over])
        k = np.nonzero(~over)[0]
        if len(k):
            if len(sizes) > 1:
                u, du, d2u = estimate(e, (t0 + dt)[k], end[k], sizes[1:], seed + 7919, ids[k] * 3 + int(way) + 1)
            else:
                u, du, d2u = e.g(end[k]), np.zeros((len(k), d)), np.zeros((len(k), d, d))
                if e.order:
                    h = 1e-4
                    step = np.eye(d) * h
                    du = np.stack([(e.g(end[k] + s) - e.g(end[k] - s)) / (2 * h) for s in step], 1)
                    if e.order > 1:
                        d2u = np.stack([np.stack([(e.g(end[k] + a + b) - e.g(end[k] + a - b) - e.g(end[k] - a + b) + e.g(end[k] - a - b)) / (4 * h * h) for b in step], 1) for a in step], 1)
            out[k] = e.f((t0 + dt)[k], end[k], u, du, d2u)
        return out * weight, sigma

    mean = lambda v: np.add.reduceat(v, np.arange(0, len(rows), m), axis=0) / m
    plus, sigma = term(1)
    if not e.order:
        return mean(plus), np.zeros((n, d)), np.zeros((n, d, d))
    minus, _ = term(-1)
    u = mean((plus + minus) / 2)
    inverse = np.linalg.inv(sigma).transpose(0, 2, 1)
    first = np.einsum("rij,rj->ri", inverse, z) / np.sqrt(dt)[:, None]
    du = mean((plus - minus)[:, None] / 2 * first)
    d2u = np.zeros((n, d, d))
    if e.order > 1:
        frozen, _ = term(0)
        second = np.einsum("rij,rjk,rlk->ril", inverse, z[:, :, None] * z[:, None, :] - np.eye(d), inverse) / dt[:, None, None]
        d2u = mean(((plus + minus - 2 * frozen) / 2)[:, None, None] * second)
    return u, du, d2u


def solve(spark: SparkSession, e: Equation, x0: list[float], sizes: list[int], seed: int = 1, block: int = 64) -> dict:
    """value, its standard error, gradient and packed lower Hessian at (0, x0) from sizes[0] root particles.

    Tasks take root particles in blocks of ``block`` and sum; nothing but sums
    comes back.  More than 6 levels with gradients, or 5 with Hessians, are refused.
    """
    if len(sizes) > (99, 6, 5)[e.order]:
        raise ValueError("too many levels for derivatives of this order")
    d = len(x0)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), block):
                keys = ids[at : at + block]
                u, du, d2u = estimate(e, np.zeros(len(keys)), np.tile(np.array(x0, float), (len(keys), 1)), [1, *sizes[1:]], seed, keys)
                low = d2u[:, *np.tril_indices(d)]
                sums = np.concatenate([[len(keys), u.sum(), (u * u).sum()], du.sum(0), low.sum(0)])
                yield pa.RecordBatch.from_arrays([list_array(sums[None])], names=["s"])

    wide = 3 + d + d * (d + 1) // 2
    got = spark.range(sizes[0]).mapInArrow(run, "s array<double>").agg(*[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(wide)]).first()
    n, total, square = got[0], got[1], got[2]
    return {"value": total / n, "error": math.sqrt(max(0.0, square / n - (total / n) ** 2) / n), "gradient": [v / n for v in got[3 : 3 + d]], "hessian": [v / n for v in got[3 + d :]]}
