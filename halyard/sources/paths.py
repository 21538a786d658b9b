"""Simulators: sources of particles, as DataFrames and as arrays inside tasks.

A simulator is a small object that gives the states of any rows at any step:
``start(ids)`` and ``move(state, ids, step)``.  States are recomputed where they
are needed from the rows' ids, so no path is ever shuffled; ``paths`` and
``particles`` are the DataFrames for whoever wants them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from halyard.sources.noise import normals, uniforms

#: Rows that a task simulates at a time
ROWS = 16384


@dataclass(frozen=True)
class Simulator:
    """Steps 0 to ``steps`` over ``horizon``; subclasses give dimension, start and move."""

    steps: int
    horizon: float
    rate: float = 0.0
    seed: int = 1

    @property
    def dt(self) -> float:
        return self.horizon / self.steps

    @property
    def discount(self) -> float:
        """One step's discount factor."""
        return math.exp(-self.rate * self.dt)

    def dimension(self) -> int:
        raise NotImplementedError

    def noise(self) -> int:
        """Normal numbers of a step."""
        return self.dimension()

    def start(self, ids: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def move(self, state: np.ndarray, ids: np.ndarray, step: int) -> np.ndarray:
        """States at step + 1 from those at ``step``."""
        raise NotImplementedError

    def draws(self, ids: np.ndarray, step: int) -> np.ndarray:
        return normals(self.seed, ids, step, self.noise())

    def states(self, ids: np.ndarray, step: int) -> np.ndarray:
        """[id, factor] at one step."""
        state = self.start(ids)
        for k in range(step):
            state = self.move(state, ids, k)
        return state

    def path(self, ids: np.ndarray) -> np.ndarray:
        """[id, step, factor]."""
        out = [self.start(ids)]
        for k in range(self.steps):
            out.append(self.move(out[-1], ids, k))
        return np.stack(out, 1)


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.column(0).slice(at, ROWS).to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def particles(spark: SparkSession, simulator: Simulator, sims: int, step: int) -> DataFrame:
    """(sim_id, x array): the states of one step."""

    def run(batches):
        for ids in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(simulator.states(ids, step))], names=["sim_id", "x"])

    return spark.range(sims).mapInArrow(run, "sim_id long, x array<double>")


def paths(spark: SparkSession, simulator: Simulator, sims: int) -> DataFrame:
    """(step, sim_id, x array): all steps, a row for each step of each simulation."""

    def run(batches):
        for ids in _blocks(batches):
            state = simulator.start(ids)
            for k in range(simulator.steps + 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k), pa.int32()), pa.array(ids, pa.int64()), _lists(state)], names=["step", "sim_id", "x"])
                if k < simulator.steps:
                    state = simulator.move(state, ids, k)

    return spark.range(sims).mapInArrow(run, "step int, sim_id long, x array<double>")


@dataclass(frozen=True)
class BlackScholes(Simulator):
    """Correlated geometric Brownian assets."""

    s0: tuple[float, ...] = (1.0,)
    sigma: tuple[float, ...] = (0.2,)
    mu: tuple[float, ...] = (0.05,)
    correlation: tuple[tuple[float, ...], ...] | None = None

    def dimension(self):
        return len(self.s0)

    def start(self, ids):
        return np.tile(np.array(self.s0), (len(ids), 1))

    def move(self, state, ids, step):
        z = self.draws(ids, step)
        if self.correlation is not None:
            z = z @ np.linalg.cholesky(np.array(self.correlation)).T
        s = np.array(self.sigma)
        return state * np.exp((np.array(self.mu) - s * s / 2) * self.dt + s * math.sqrt(self.dt) * z)


@dataclass(frozen=True)
class MeanReverting(Simulator):
    """Exact steps of independent mean-reverting factors that start at zero; spot() puts them on a curve."""

    sigma: tuple[float, ...] = (0.94,)
    reversion: tuple[float, ...] = (0.29,)
    curve: tuple[float, ...] | None = None

    def dimension(self):
        return len(self.sigma)

    def start(self, ids):
        return np.zeros((len(ids), self.dimension()))

    def _variance(self, t: float) -> np.ndarray:
        a, s = np.array(self.reversion), np.array(self.sigma)
        return s * s * -np.expm1(-2 * a * t) / (2 * a)

    def move(self, state, ids, step):
        return state * np.exp(-np.array(self.reversion) * self.dt) + np.sqrt(self._variance(self.dt)) * self.draws(ids, step)

    def spot(self, state: np.ndarray, step: int) -> np.ndarray:
        """curve(step) * exp(sum of factors - half their variance): its mean is the curve."""
        level = 1.0 if self.curve is None else self.curve[step]
        return level * np.exp(state.sum(1) - self._variance(step * self.dt).sum() / 2)


@dataclass(frozen=True)
class TwoAssets(MeanReverting):
    """One correlated mean-reverting factor for each of several assets, each on its own curve."""

    rho: float = 0.0
    curves: tuple[tuple[float, ...], ...] = ()

    def move(self, state, ids, step):
        z = self.draws(ids, step)
        z[:, 1] = self.rho * z[:, 0] + math.sqrt(1 - self.rho**2) * z[:, 1]
        return state * np.exp(-np.array(self.reversion) * self.dt) + np.sqrt(self._variance(self.dt)) * z

    def spots(self, state: np.ndarray, step: int) -> np.ndarray:
        level = np.array([c[step] for c in self.curves]) if self.curves else 1.0
        return level * np.exp(state - self._variance(step * self.dt) / 2)


@dataclass(frozen=True)
class Autoregressive(Simulator):
    """Mean-reverting AR(1) around ``mean``: reversion None gives independent draws, AR(0)."""

    mean: float = 50.0
    first: float = 50.0
    reversion: float | None = 5.0
    sigma: float = 1.0

    def dimension(self):
        return 1

    def start(self, ids):
        return np.full((len(ids), 1), self.first)

    def move(self, state, ids, step):
        z = self.draws(ids, step)
        if self.reversion is None:
            return self.mean + self.sigma * z
        keep = math.exp(-self.reversion * self.dt)
        noise = self.sigma * math.sqrt(-math.expm1(-2 * self.reversion * self.dt) / (2 * self.reversion))
        return self.mean + (state - self.mean) * keep + noise * z


@dataclass(frozen=True)
class MarketMinimal(Simulator):
    """The minimal market model's index: a squared Bessel process of dimension four under a growing clock.

    The state is the index and the four Brownian coordinates whose squares it sums.
    """

    alpha0: float = 21.36
    eta: float = 0.0542
    first: float = 100.0

    def dimension(self):
        return 5

    def noise(self):
        return 4

    def _clock(self, t: float) -> float:
        return self.alpha0 / (4 * self.eta) * math.expm1(self.eta * t)

    def start(self, ids):
        w = np.full((len(ids), 4), math.sqrt(self.first / 4))
        return np.concatenate([np.full((len(ids), 1), self.first), w], 1)

    def move(self, state, ids, step):
        t = step * self.dt
        w = state[:, 1:] + math.sqrt(self._clock(t + self.dt) - self._clock(t)) * self.draws(ids, step)
        return np.concatenate([(w * w).sum(1, keepdims=True), w], 1)


@dataclass(frozen=True)
class NormalInverseGaussian(Simulator):
    """exp of a normal-inverse-Gaussian process: Brownian motion with drift beta under an inverse Gaussian clock."""

    alpha: float = 2.0
    beta: float = -0.5
    delta: float = 0.06
    mu: float = 0.07
    first: float = 1.0

    def dimension(self):
        return 1

    def noise(self):
        return 2

    def start(self, ids):
        return np.full((len(ids), 1), self.first)

    def move(self, state, ids, step):
        z = self.draws(ids, step)
        scale, gamma = self.delta * self.dt, math.sqrt(self.alpha**2 - self.beta**2)
        # inverse Gaussian numbers by the transformation with two roots
        mean, shape = scale / gamma, scale * scale
        y = z[:, 0] ** 2
        x = mean + mean * mean * y / (2 * shape) - mean / (2 * shape) * np.sqrt(4 * mean * shape * y + (mean * y) ** 2)
        clock = np.where(uniforms(self.seed, ids, step, 99) <= mean / (mean + x), x, mean * mean / x)
        return state * np.exp(self.mu * self.dt + self.beta * clock + np.sqrt(clock) * z[:, 1])[:, None]


@dataclass(frozen=True)
class GaussianSamples(Simulator):
    """Independent standard normal draws at each date, ``samples`` of them for a particle."""

    factors: int = 1
    samples: int = 1

    def dimension(self):
        return self.factors

    def start(self, ids):
        return np.zeros((len(ids), self.factors))

    def move(self, state, ids, step):
        return self.draws(ids, step)

    def sample(self, ids: np.ndarray, step: int, k: int) -> np.ndarray:
        """The k-th sample of each particle at a date."""
        return normals(self.seed + 1, np.asarray(ids) * self.samples + k, step, self.factors)


@dataclass(frozen=True)
class MultiStage:
    """A simulator whose steps each hold several deterministic periods."""

    inner: Simulator
    periods: int = 1

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(object.__getattribute__(self, "inner"), name)
