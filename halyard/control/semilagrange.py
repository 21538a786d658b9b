"""Semi-Lagrangian steps for Hamilton-Jacobi-Bellman equations on grids.

A step averages interpolated values at the points a controlled diffusion may
reach.  Grid points are dealt over the cluster, the value array, bounded by the
grid, goes to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from halyard.control.regressors import MOST_BYTES, list_array
from halyard.sources.noise import normals
from halyard.sources.paths import ROWS


def expected(grid, values: np.ndarray, x: np.ndarray, drift: np.ndarray, sigma: np.ndarray, dt: float, reweigh: bool = True, evaluate: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(value [row], ok [row]) after dt from x [row, d] with drift [row, d] and sigma [row, d, m].

    Each Brownian column j sends two legs to x + drift dt +/- sigma_j sqrt(m dt).
    A leg that leaves the domain is cut at the border in its first violated
    coordinate, and the two legs are weighted so that their mean stays; a drift
    that leaves it alone is truncated.  Without ``reweigh`` such rows are not ok.
    """
    low, high = np.array(grid.extremes).T if hasattr(grid, "extremes") else (grid.low, grid.low + grid.size)
    read = evaluate or (lambda p: grid.interpolate(values, p))
    m = sigma.shape[2]
    centre = x + drift * dt
    total, ok = np.zeros(len(x)), np.ones(len(x), bool)
    for j in range(m):
        leg = sigma[:, :, j] * np.sqrt(m * dt)
        inside = lambda p: ((p >= low - 1e-12) & (p <= high + 1e-12)).all(1)
        if not reweigh:
            ok &= inside(centre + leg) & inside(centre - leg)
        safe = np.clip(centre, low, high)
        room = lambda way: np.where(leg * way > 1e-300, (high - safe) / np.where(leg * way > 1e-300, leg * way, 1), np.where(leg * way < -1e-300, (safe - low) / np.where(leg * way < -1e-300, -leg * way, 1), np.inf)).min(1)
        a, b = np.clip(room(1), 0, 1), np.clip(room(-1), 0, 1)
        # lengths a and b of the legs, weights b / (a + b) and a / (a + b): the mean is kept; variance by mixing with the centre
        short = a + b < 1e-14
        wa = np.where(short, 0.5, b / np.where(short, 1, a + b))
        got = wa * read(safe + a[:, None] * leg) + (1 - wa) * read(safe - b[:, None] * leg)
        total += got
    return total / m, ok


class SLOptimizer:
    """What a user writes: optimize(x [row, d], expectations, t, regime values) -> (value [row, regime], control [row, control])."""

    regimes = 1
    controls = 0
    reweigh = True

    def optimize(self, x: np.ndarray, expectation: Callable, t: float):
        """expectation(regime, drift, sigma) -> (value, ok) over the coming time step."""
        raise NotImplementedError

    def needs_boundary(self, x: np.ndarray) -> np.ndarray:
        """Rows whose value is the boundary function's; none by default."""
        return np.zeros(len(x), bool)


def initial_values(grid, initial: Callable, regimes: int = 1) -> np.ndarray:
    """[regime, point]"""
    return np.stack([initial(r, grid.points) for r in range(regimes)])


def step(spark: SparkSession, grid, values: np.ndarray, optimizer: SLOptimizer, t: float, dt: float, boundary: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One time step over the whole grid: (values [regime, point], controls [control, point]); boundary(regime, x, t)."""
    if values.nbytes > MOST_BYTES:
        raise ValueError("the grid is too large to send to every task")
    shared, size = spark.sparkContext.broadcast(values), values.shape[1]

    def run(batches):
        values = shared.value
        surplus = [grid.hierarchize(v) for v in values] if hasattr(grid, "hierarchize") else None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(at, ROWS).to_numpy(zero_copy_only=False)
                x = grid.points[ids]

                def expectation(regime, drift, sigma, x=x):
                    read = None if surplus is None else lambda p: grid.evaluate(surplus[regime], p)
                    return expected(grid, values[regime], x, drift, sigma, dt, optimizer.reweigh, read)

                v, u = optimizer.optimize(x, expectation, t)
                if boundary is not None:
                    edge = optimizer.needs_boundary(x)
                    if edge.any():
                        v[edge] = np.stack([boundary(r, x[edge], t) for r in range(optimizer.regimes)], 1)
                        if u is not None:
                            u[edge] = 0.0
                out = v if u is None else np.concatenate([v, u], 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_array(out)], names=["point_id", "v"])

    got = spark.range(size).mapInArrow(run, "point_id long, v array<double>").toArrow()
    flat = got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
    out = np.empty_like(flat)
    out[got["point_id"].to_numpy()] = flat
    return np.ascontiguousarray(out[:, : optimizer.regimes].T), np.ascontiguousarray(out[:, optimizer.regimes :].T)


def solve_sl(spark: SparkSession, grid, optimizer: SLOptimizer, initial: Callable, horizon: float, steps: int, boundary: Callable | None = None, archive=None) -> np.ndarray:
    """Time steps from the initial condition: values [regime, point] at the horizon."""
    values, dt = initial_values(grid, initial, optimizer.regimes), horizon / steps
    for k in range(steps):
        values, controls = step(spark, grid, values, optimizer, k * dt, dt, (lambda r, x, t: boundary(r, x, t + dt)) if boundary else None)
        if archive is not None:
            archive.put("sl-value", k, array=values)
            archive.put("sl-control", k, array=controls)
    return values


def simulate_sl(spark: SparkSession, grid, controls: list[np.ndarray], dynamics: Callable, x0: list[float], sims: int, dt: float, final: Callable, seed: int = 1) -> DataFrame:
    """(sim_id, gain, x): forward with Gaussian increments; controls[k] [control, point] are interpolated at each row.

    dynamics(x, u, step) -> (drift [row, d], sigma [row, d, m], gain [row]).
    """
    shared = spark.sparkContext.broadcast(controls)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(at, ROWS).to_numpy(zero_copy_only=False)
                x, gain = np.tile(np.array(x0, float), (len(ids), 1)), np.zeros(len(ids))
                for k, held in enumerate(shared.value):
                    u = grid.interpolate(held.T, grid.truncate(x)) if held.size else np.zeros((len(x), 0))
                    drift, sigma, more = dynamics(x, u, k)
                    gain += more
                    x = x + drift * dt + np.sqrt(dt) * np.einsum("rdm,rm->rd", sigma, normals(seed, ids, k, sigma.shape[2]))
                gain += final(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gain), list_array(x)], names=["sim_id", "gain", "x"])

    return spark.range(sims).mapInArrow(run, "sim_id long, gain double, x array<double>")
