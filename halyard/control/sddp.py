"""Stochastic dual dynamic programming: cuts backward, visited states forward.

Cuts and states live in an archive as tables that are appended to.  A backward
date joins states with the particles of their cell, solves one small linear
programme for each state, particle and sample inside the tasks, and aggregates
values and slopes into a cut by cell; nothing but cuts comes back.  With trees the
regression is an expectation over edges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from halyard.control.regressors import Mean, _by_cell, _emit, _summed, list_array, matrix_of, solve
from halyard.sources.paths import ROWS

#: States closer than this in every coordinate are one state
TINY = 1e-9
BIG = 1e30


def linear_programme(c: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(x, value, duals) of min c.x with a x = b and low <= x <= high; small and dense; bounds may be infinite.

    The bounded simplex method in two phases with Bland's rule; duals are the
    value's derivatives by b.  Raises if there is no solution.
    """
    a, b, c = np.asarray(a, float), np.asarray(b, float), np.asarray(c, float)
    m, n = a.shape
    start = np.where(np.isfinite(low), low, np.where(np.isfinite(high), high, 0.0))
    sign = np.where(b - a @ start >= 0, 1.0, -1.0)
    full = np.concatenate([a, np.diag(sign)], 1)
    lo, hi = np.concatenate([low, np.zeros(m)]), np.concatenate([high, np.full(m, np.inf)])
    x = np.concatenate([start, np.abs(b - a @ start)])
    base = list(range(n, n + m))
    for phase in (0, 1):
        cost = np.concatenate([np.zeros(n), np.ones(m)]) if phase == 0 else np.concatenate([c, np.zeros(m)])
        if phase == 1:
            hi[n:] = 0.0
        for _ in range(50 * (n + m)):
            inverse = np.linalg.inv(full[:, base])
            y = cost[base] @ inverse
            reduced = cost - y @ full
            free = np.ones(n + m, bool)
            free[base] = False
            if phase == 1:
                free[n:] = False
            up, down = free & (reduced < -1e-9) & (x < hi - 1e-12), free & (reduced > 1e-9) & (x > lo + 1e-12)
            able = np.nonzero(up | down)[0]
            if not len(able):
                break
            j = int(able[0])
            way = 1.0 if up[j] else -1.0
            d = -inverse @ full[:, j] * way
            room, leave = (hi[j] - lo[j]), -1
            for i, k in enumerate(base):
                t = (hi[k] - x[k]) / d[i] if d[i] > 1e-12 else (lo[k] - x[k]) / d[i] if d[i] < -1e-12 else np.inf
                if t < room - 1e-12 or (t <= room and leave >= 0 and k < base[leave]):
                    room, leave = max(t, 0.0), i
            if not np.isfinite(room):
                raise ValueError("the linear programme is unbounded")
            x[j] += way * room
            x[base] += d * room
            if leave >= 0:
                base[leave] = j
        if phase == 0 and x[n:].sum() > 1e-7 * max(1.0, np.abs(b).max(initial=0.0)):
            raise ValueError("the linear programme has no solution")
    y = np.linalg.solve(full[:, base].T, np.concatenate([c, np.zeros(m)])[base])
    return x[:n], float(c @ x[:n]), y


def distinct_states(states: np.ndarray, tiny: float = TINY) -> np.ndarray:
    """States without those within ``tiny`` of an earlier one in every coordinate, in order."""
    kept: list[np.ndarray] = []
    held = np.zeros((0, states.shape[1]))
    for s in states:
        if not len(held) or not (np.abs(held - s) <= tiny).all(1).any():
            kept.append(s)
            held = np.array(kept)
    return held


class Cuts:
    """Cuts of one date: for each cell, coefficients [cut, basis, (intercept, slopes)]; none at the final date."""

    def __init__(self, regressor: Mean, size: int):
        self.regressor, self.size = regressor, size
        self.held: list[np.ndarray] = [np.zeros((0, regressor.wide, 1 + size)) for _ in range(regressor.cells_)]

    def add(self, cell: int, coefficients: np.ndarray) -> None:
        self.held[cell] = np.concatenate([self.held[cell], coefficients[None]])

    def at(self, x: np.ndarray) -> list[np.ndarray]:
        """For each row its cuts [cut, (intercept, slopes)] at x."""
        p = self.regressor.basis(x)
        return [np.einsum("k,ckj->cj", row, self.held[c]) for row, c in zip(p, self.regressor.cells(x))]


class SDDPOptimizer:
    """What a user writes; a problem of costs, minimised."""

    size = 1

    def backward(self, cuts: np.ndarray, state: np.ndarray, x: np.ndarray, sample: np.ndarray, step: int) -> tuple[float, np.ndarray]:
        """(value, slopes by state) of one step's programme with theta over the cuts [cut, (intercept, slopes)]."""
        raise NotImplementedError

    def forward(self, cuts: np.ndarray, state: np.ndarray, x: np.ndarray, sample: np.ndarray, step: int) -> tuple[np.ndarray, float]:
        """(next state, cost of the step alone)."""
        raise NotImplementedError

    def admissible(self, step: int) -> np.ndarray:
        raise NotImplementedError


def _cut_store(steps: int, regressors: list[Mean], size: int) -> list[Cuts]:
    return [Cuts(regressors[t], size) for t in range(steps + 1)]


def backward(spark: SparkSession, simulator, sims: int, samples: int, optimizer: SDDPOptimizer, stores: list[Cuts], states: list[np.ndarray], sample: Callable) -> None:
    """Adds one cut per state and cell to every date, last to first.

    The programme of date t + 1 is solved at its visited states for all particles
    and samples; value - slope . state and the slopes are regressed on the
    particles of date t, so the cuts of t hold conditional expectations.
    """
    for t in reversed(range(simulator.steps)):
        fit, asked = stores[t].regressor, states[t + 1]
        pairs = [(i, j) for i in range(fit.wide) for j in range(i, fit.wide)]
        shared = spark.sparkContext.broadcast((stores[t + 1], asked))

        def run(batches, t=t, fit=fit, pairs=pairs, shared=shared):
            store, asked = shared.value
            total: dict[int, list] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    ids = batch.column(0).slice(at, 256).to_numpy(zero_copy_only=False)
                    before = simulator.states(ids, t)
                    got = np.zeros((len(ids), len(asked), 1 + optimizer.size))
                    for k in range(samples):
                        x, noise = sample(simulator, before, ids, t, k)
                        for r, cuts in enumerate(store.at(x)):
                            for s, state in enumerate(asked):
                                value, slope = optimizer.backward(cuts, state, x[r], noise[r], t + 1)
                                got[r, s, 0] += (value - slope @ state) / samples
                                got[r, s, 1:] += slope / samples
                    p = fit.basis(before)
                    columns = [(p[:, i] * p[:, j])[:, None] for i, j in pairs]
                    _by_cell(fit.cells(before), np.concatenate([*columns, (p[:, :, None] * got.reshape(len(ids), 1, -1)).reshape(len(ids), -1)], 1), total)
            if total:
                yield _emit(total)

        for cell, (_, sums) in _summed(spark.range(sims).mapInArrow(run, "cell long, n long, sums array<double>")).items():
            gram = np.zeros((fit.wide, fit.wide))
            for (i, j), v in zip(pairs, sums):
                gram[i, j] = gram[j, i] = v
            found = solve(gram, sums[len(pairs) :].reshape(fit.wide, -1)).reshape(fit.wide, len(asked), -1)
            for s in range(len(asked)):
                stores[t].add(cell, found[:, s])


def forward(spark: SparkSession, simulator, sims: int, optimizer: SDDPOptimizer, stores: list[Cuts], first: np.ndarray, sample: Callable, keep: bool = True) -> tuple[float, float, list[np.ndarray]]:
    """(mean cost, its standard error, visited states by date); with ``keep`` the distinct states come back."""
    shared = spark.sparkContext.broadcast(stores)
    steps, size = simulator.steps, optimizer.size

    def run(batches):
        stores = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(at, 256).to_numpy(zero_copy_only=False)
                state, cost, x = np.tile(first, (len(ids), 1)), np.zeros(len(ids)), simulator.start(ids)
                seen = [state]
                noise = np.zeros((len(ids), 1))
                for t in range(steps + 1):
                    after = np.empty_like(state)
                    for r, cuts in enumerate(stores[t].at(x) if t < steps else [np.zeros((0, 1 + size))] * len(ids)):
                        after[r], c = optimizer.forward(cuts, state[r], x[r], noise[r], t)
                        cost[r] += c
                    state = after
                    if t < steps:
                        seen.append(state)
                        x, noise = sample(simulator, x, ids, t, 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cost), list_array(np.concatenate(seen, 1))], names=["sim_id", "cost", "seen"])

    rows = spark.range(sims).mapInArrow(run, "sim_id long, cost double, seen array<double>")
    got = (rows if keep else rows.select("cost")).toArrow()  # a row for each forward path, which the caller counts
    cost = got["cost"].to_numpy()
    error = float(cost.std() / np.sqrt(max(1, len(cost))))
    if not keep:
        return float(cost.mean()), error, []
    seen = matrix_of(got["seen"]).reshape(len(cost), steps + 1, size)
    return float(cost.mean()), error, [distinct_states(seen[:, t]) for t in range(steps + 1)]


def next_particle(simulator, x, ids, t, k):
    """The simulator's own next state; its noise is not told apart."""
    after = simulator.move(x, ids * 1009 + k + 1, t)
    return after, after


def solve_sddp(spark: SparkSession, simulator, optimizer: SDDPOptimizer, first: list[float], regressors: Callable[[int], Mean], sims: int = 64, samples: int = 10, forward_sims: int = 8, check_sims: int = 200, accuracy: float = 0.01, iterations: int = 20, check_every: int = 1, sample: Callable = next_particle, archive=None) -> dict:
    """Alternates backward and forward passes until the gap between the bounds is within ``accuracy`` or crosses zero.

    regressors(step): a prepared regressor of the particles of a date; the first
    date has the mean.
    """
    state = np.array(first, float)
    stores = _cut_store(simulator.steps, [Mean() if t == 0 else regressors(t) for t in range(simulator.steps + 1)], optimizer.size)
    states = [np.atleast_2d(optimizer.admissible(t)) for t in range(simulator.steps + 1)]
    out, last = {"lower": np.nan, "upper": np.nan, "iterations": 0}, None
    for k in range(iterations):
        backward(spark, simulator, sims, samples, optimizer, stores, states, sample)
        x0 = simulator.start(np.array([0]))
        lower = optimizer.backward(stores[0].at(x0)[0], state, x0[0], np.zeros(1), 0)[0]
        _, _, seen = forward(spark, simulator, forward_sims, optimizer, stores, state, sample)
        states = [distinct_states(s) for s in seen]
        if archive is not None:
            archive.put("sddp-cuts", k, thing=[c.held for c in stores])
            archive.put("sddp-states", k, thing=states)
        out = {**out, "lower": lower, "iterations": k + 1}
        if k % check_every == 0 or k == iterations - 1:
            upper, error, _ = forward(spark, simulator, check_sims, optimizer, stores, state, sample, keep=False)
            out.update(upper=upper, error=error)
            gap = (upper - lower) / max(1e-12, abs(upper))
            if abs(gap) <= accuracy or (last is not None and gap * last < 0):
                break
            last = gap
    return out


class Reservoirs(SDDPOptimizer):
    """Storages with inflow that serve a demand; what they do not serve is bought at the spot price.

    demand(step), price(step), inflow(step, x, noise) [size].
    """

    def __init__(self, size: int, rate: float, demand: Callable, price: Callable, inflow: Callable, high: float = np.inf, start: float = 0.0):
        self.size, self.rate, self.demand, self.price, self.inflow, self.high, self.level = size, rate, demand, price, inflow, high, start

    def _solve(self, cuts, state, x, noise, step):
        n, k = self.size, len(cuts)
        # draws out, next levels, bought, theta, slack of each cut
        wide = 2 * n + 2 + k
        c, a, b = np.zeros(wide), np.zeros((n + 1 + k, wide)), np.zeros(n + 1 + k)
        c[2 * n], c[2 * n + 1] = self.price(step), 1.0
        low, high = np.zeros(wide), np.full(wide, np.inf)
        high[:n], high[n : 2 * n] = self.rate, self.high
        low[2 * n + 1] = -np.inf if k else 0.0
        high[2 * n + 1] = np.inf if k else 0.0
        for s in range(n):
            a[s, s] = a[s, n + s] = 1.0
        b[:n] = state + self.inflow(step, x, noise)
        a[n, :n], a[n, 2 * n], b[n] = 1.0, 1.0, self.demand(step)
        for j, cut in enumerate(cuts):
            a[n + 1 + j, n : 2 * n], a[n + 1 + j, 2 * n + 1], a[n + 1 + j, 2 * n + 2 + j], b[n + 1 + j] = -cut[1:], 1.0, -1.0, cut[0]
        return (*linear_programme(c, a, b, low, high), c)

    def backward(self, cuts, state, x, noise, step):
        _, value, dual, _ = self._solve(cuts, state, x, noise, step)
        return value, dual[: self.size]

    def forward(self, cuts, state, x, noise, step):
        found, _, _, c = self._solve(cuts, state, x, noise, step)
        return found[self.size : 2 * self.size], float(c[2 * self.size] * found[2 * self.size])

    def admissible(self, step):
        return np.full((1, self.size), self.level)
