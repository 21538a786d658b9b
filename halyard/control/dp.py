"""Dynamic programming with regression: backward over the steps, then forward.

Values are one row per simulation, (sim_id, v array): all regimes and grid points
of that simulation.  A backward step fits the conditional expectation of v by one
aggregation, sends the coefficients to the tasks and maps the rows: the user's
optimiser sees whole batches as arrays.  States come from the simulator by id, so
no step joins or shuffles rows.  The forward pass is a single map over ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.control.archive import Archive
from halyard.control.grids import Grid, SparseGrid
from halyard.control.regressors import Mean, list_array, matrix_of
from halyard.session import cut, discard
from halyard.sources.paths import ROWS


@dataclass
class Continuation:
    """Regressed values of the grid's points: the value expected at any stock, given x."""

    regressor: Mean
    coefficients: np.ndarray  # [cell, basis, point]
    grid: Grid | SparseGrid

    def all_points(self, x: np.ndarray) -> np.ndarray:
        return self.regressor.value(x, self.coefficients)

    def at(self, x: np.ndarray, stock: np.ndarray) -> np.ndarray:
        """[row]: at one stock for all rows, or at a stock for each row."""
        stock = np.atleast_2d(stock)
        if isinstance(self.grid, SparseGrid):
            held = self.all_points(x)
            shape = self.grid.matrix(stock)
            return (held * shape).sum(1)
        numbers, weights = self.grid.weights(stock)
        p, cells = self.regressor.basis(x), self.regressor.cells(x)
        if len(stock) == 1:
            mixed = self.coefficients[:, :, numbers[0]] @ weights[0]
            return (p * mixed[cells]).sum(1)
        out = np.zeros(len(x))
        for k in range(numbers.shape[1]):
            out += weights[:, k] * (p * self.coefficients[cells, :, numbers[:, k]]).sum(1)
        return out


@dataclass
class Known:
    """Values already known for each row of a batch, in place of an expectation."""

    values: np.ndarray  # [row, point]
    grid: Grid

    def all_points(self, x):
        return self.values

    def at(self, x, stock):
        numbers, weights = self.grid.weights(np.broadcast_to(np.atleast_2d(stock), (len(x), self.grid.dimension)) if len(np.atleast_2d(stock)) == 1 else stock)
        return (np.take_along_axis(self.values, numbers, 1) * weights).sum(1)


@dataclass
class CutContinuation(Continuation):
    """Regressed cuts: coefficients are those of value and slopes, [cell, basis, (1 + d) * point]."""

    def cuts(self, x: np.ndarray) -> np.ndarray:
        """[row, point, (intercept, slopes)]"""
        got = self.regressor.value(x, self.coefficients).reshape(len(x), 1 + self.grid.dimension, -1).transpose(0, 2, 1).copy()
        got[:, :, 0] -= (got[:, :, 1:] * self.grid.points[None]).sum(2)
        return got

    def at(self, x, stock):
        got = self.cuts(x)
        return (got[:, :, 0] + np.einsum("rpd,rd->rp", got[:, :, 1:], np.broadcast_to(np.atleast_2d(stock), (len(x), self.grid.dimension)))).min(1)


class Optimizer:
    """What a user writes.  Rows come as arrays; ``step`` is the date's number."""

    regimes = 1
    controls = 0
    #: Periods inside one stochastic step, and regimes that exist inside it only
    periods = 1
    inner_regimes = 0

    def optimize(self, grid, stock: np.ndarray, continuation: list, x: np.ndarray, step: int, period: int = 0):
        """(values [row, regime], controls [row, control]) at one grid point."""
        raise NotImplementedError

    def simulate(self, continuation: list, regime: np.ndarray, stock: np.ndarray, x: np.ndarray, step: int, period: int = 0):
        """(regime, stock, gain) after the step, the gain not discounted."""
        raise NotImplementedError

    def simulate_control(self, controls: list, regime: np.ndarray, stock: np.ndarray, x: np.ndarray, step: int):
        """The same from stored controls, each a Continuation of the control on the grid."""
        raise NotImplementedError

    def cone(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The box of stocks that may be reached from a box; all values are at hand in each task, so the engine needs none."""
        return low, high


def _grid_at(grid, step: int):
    return grid(step) if callable(grid) else grid


def _with_states(values: DataFrame, simulator, step: int) -> DataFrame:
    """Adds x, the states at a step, to rows (sim_id, v)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(simulator.states(ids, step)), batch.column(1)], names=["sim_id", "x", "v"])

    return values.mapInArrow(run, "sim_id long, x array<double>, v array<double>")


def final_values(spark: SparkSession, simulator, sims: int, grid, final: Callable, regimes: int = 1) -> DataFrame:
    """(sim_id, v): final(regime, stock [point, d], x [row, k]) -> [row, point] for every regime, at the last step."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(at, ROWS).to_numpy(zero_copy_only=False)
                x = simulator.states(ids, simulator.steps)
                v = [np.broadcast_to(final(r, grid.points, x), (len(ids), len(grid.points))) for r in range(regimes)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_array(np.concatenate(v, 1))], names=["sim_id", "v"])

    return spark.range(sims).mapInArrow(run, "sim_id long, v array<double>")


def final_cuts(spark: SparkSession, simulator, sims: int, grid, final: Callable) -> DataFrame:
    """(sim_id, v): final(stock, x) -> ([row, point] values, [row, d, point] slopes)."""

    def flat(_, stock, x):
        value, slopes = final(stock, x)
        return np.concatenate([np.broadcast_to(value, (len(x), len(stock)))[:, None], np.broadcast_to(slopes, (len(x), stock.shape[1], len(stock)))], 1).reshape(len(x), -1)

    class Wide:
        points = grid.points

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(at, ROWS).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_array(flat(0, Wide.points, simulator.states(ids, simulator.steps)))], names=["sim_id", "v"])

    return spark.range(sims).mapInArrow(run, "sim_id long, v array<double>")


def transition(values: DataFrame, simulator, step: int, regressor: Mean, optimizer: Optimizer, grid, next_grid, archive: Archive | None = None, cuts: bool = False, project: bool = False) -> DataFrame:
    """One backward step: (sim_id, v) at step + 1 to (sim_id, v) at ``step``.

    The expectation of the discounted v given the states of ``step`` is fitted
    and handed to the optimiser at every point of the grid; with ``project`` the
    values themselves are fitted to the states of step + 1 instead and the
    optimiser takes its own expectation of that function.
    """
    at = step + 1 if project else step
    rows = _with_states(values, simulator, at)
    regressor.prepare(rows)
    coefficients = regressor.coefficients(rows) * simulator.discount
    total = optimizer.regimes
    if cuts:
        held = [CutContinuation(regressor, coefficients, next_grid)]
    else:
        held = [Continuation(regressor, c, next_grid) for c in np.split(coefficients, total, 2)]
    if archive is not None:
        archive.put("continuation", step, array=coefficients, thing=(regressor, next_grid))
    shared = values.sparkSession.sparkContext.broadcast(held)
    kept = archive is not None and optimizer.controls > 0

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                x = simulator.states(ids, step)
                now, controls, own = shared.value, None, next_grid
                for period in reversed(range(optimizer.periods)):
                    goal = grid if period == 0 else own
                    got = [optimizer.optimize(goal, stock, now, x, step, period) for stock in goal.points]
                    v = np.stack([g[0].reshape(len(x), -1) for g in got], 2)  # [row, regime or cut, point]
                    controls = np.stack([g[1] for g in got], 2) if optimizer.controls else None
                    if period:
                        now = [Known(np.ascontiguousarray(v[:, r]), goal) for r in range(v.shape[1])]
                v = v[:, : total * (1 + (cuts and grid.dimension))].reshape(len(x), -1)
                columns = [part.column(0), list_array(v)]
                if kept:
                    columns.append(list_array(controls.reshape(len(x), -1)))
                yield pa.RecordBatch.from_arrays(columns, names=["sim_id", "v", "u"][: len(columns)])

    out = cut(values.mapInArrow(run, "sim_id long, v array<double>" + ", u array<double>" * kept), "values")
    if kept:
        # controls are kept as functions of the state, regressed like the values
        spread = _with_states(out.select("sim_id", F.col("u").alias("v")), simulator, step)
        archive.put("control", step, array=regressor.coefficients(spread) if not project else Mean().coefficients(spread), thing=(regressor if not project else Mean(), grid))
    return out.select("sim_id", "v")


def solve(spark: SparkSession, simulator, sims: int, grid, regressor: Callable[[int], Mean], optimizer: Optimizer, final: Callable, archive: Archive | None = None, cuts: bool = False, project: bool = False, bellman: bool = False) -> np.ndarray:
    """Backward pass; the mean over simulations of the values at date 0: [regime (or cut row), point].

    ``grid`` may be a function of the step; ``regressor(step)`` gives a fresh
    regressor, and step 0 has the plain mean.
    """
    last = _grid_at(grid, simulator.steps)
    values = final_cuts(spark, simulator, sims, last, final) if cuts else final_values(spark, simulator, sims, last, final, optimizer.regimes)
    held = None
    for step in reversed(range(simulator.steps)):
        now, after = _grid_at(grid, step), _grid_at(grid, step + 1)
        fit = regressor(step + project) if step + project > 0 else Mean()
        values = transition(values, simulator, step, fit, optimizer, now, after, archive, cuts, project)
        if bellman and archive is not None:
            archive.put("bellman", step, array=Mean().coefficients(_with_states(values, simulator, step))[0, 0])
        if held is not None:
            discard(held)
        held = values
    means = mean_values(values)
    return means.reshape(-1, len(_grid_at(grid, 0).points))


def mean_values(values: DataFrame) -> np.ndarray:
    """The mean of every entry of v, summed in the tasks."""

    def run(batches):
        total, n = None, 0
        for batch in batches:
            v = matrix_of(batch.column(0))
            if len(v):
                total, n = (v.sum(0) if total is None else total + v.sum(0)), n + len(v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([n], pa.int64()), list_array(total[None])], names=["cell", "n", "sums"])

    from halyard.control.regressors import _summed

    n, sums = _summed(values.select("v").mapInArrow(run, "cell long, n long, sums array<double>"))[0]
    return sums / n


def simulate(spark: SparkSession, simulator, sims: int, optimizer: Optimizer, archive: Archive, stock: list[float], final: Callable, regime: int = 0, by_control: bool = False, cuts: bool = False) -> DataFrame:
    """(sim_id, gain, regime, stock array): the forward pass from stored continuations or controls, in one map.

    ``gain`` is discounted to date 0 and holds the final value.
    """
    kind = "control" if by_control else "continuation"
    held = []
    for step in range(simulator.steps):
        got, (fit, grid) = archive.array(kind, step), archive.thing(kind, step)
        if cuts:
            held.append([CutContinuation(fit, got, grid)])
        else:
            n = optimizer.controls if by_control else optimizer.regimes
            held.append([Continuation(fit, c, grid) for c in np.split(got, n, 2)])
    shared = spark.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(at, ROWS).to_numpy(zero_copy_only=False)
                x, own = simulator.start(ids), np.tile(np.array(stock, float), (len(ids), 1))
                mode, gain = np.full(len(ids), regime), np.zeros(len(ids))
                for step in range(simulator.steps):
                    for period in range(optimizer.periods):
                        if by_control:
                            mode, own, more = optimizer.simulate_control(shared.value[step], mode, own, x, step)
                        else:
                            mode, own, more = optimizer.simulate(shared.value[step], mode, own, x, step, period)
                        gain += more * simulator.discount**step
                    x = simulator.move(x, ids, step)
                # the final value of each row's own regime and stock
                end = np.array([final(int(r), own[k : k + 1], x[k : k + 1])[0, 0] for k, r in enumerate(mode)]) if not cuts else np.array([final(own[k : k + 1], x[k : k + 1])[0][0, 0] for k in range(len(ids))])
                gain += end * simulator.discount**simulator.steps
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gain), pa.array(mode.astype(np.int32)), list_array(own)], names=["sim_id", "gain", "regime", "stock"])

    return spark.range(sims).mapInArrow(run, "sim_id long, gain double, regime int, stock array<double>")


class SwitchOptimizer:
    """Integer states for each regime and no interpolation."""

    grids: list = []

    def optimize(self, regime: int, state: np.ndarray, continuation: list[np.ndarray], x: np.ndarray, step: int) -> np.ndarray:
        """[row]: value at an integer state; continuation[r] is [row, point of regime r]."""
        raise NotImplementedError

    def simulate(self, regime: int, state: np.ndarray, continuation: list[np.ndarray], x: np.ndarray, step: int):
        """(regime, state [row, d], gain) of rows that share a regime, each with its own state."""
        raise NotImplementedError


def solve_switch(spark: SparkSession, simulator, sims: int, regressor: Callable[[int], Mean], optimizer: SwitchOptimizer, archive: Archive | None = None) -> list[np.ndarray]:
    """Backward pass over integer grids, zero at the end; mean values at date 0 by regime."""
    sizes = [g.size for g in optimizer.grids]
    edges = np.cumsum(sizes)[:-1]

    def nothing(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(np.zeros((batch.num_rows, sum(sizes))))], names=["sim_id", "v"])

    values, held = spark.range(sims).mapInArrow(nothing, "sim_id long, v array<double>"), None
    for step in reversed(range(simulator.steps)):
        rows = _with_states(values, simulator, step)
        fit = (regressor(step) if step else Mean()).prepare(rows)
        coefficients = fit.coefficients(rows) * simulator.discount
        if archive is not None:
            archive.put("switch", step, array=coefficients, thing=fit)
        shared = spark.sparkContext.broadcast((fit, coefficients))

        def run(batches, step=step, shared=shared):
            fit, coefficients = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    x = simulator.states(part.column(0).to_numpy(zero_copy_only=False), step)
                    after = np.split(fit.value(x, coefficients), edges, 1)
                    v = [optimizer.optimize(r, s.astype(int), after, x, step) for r, g in enumerate(optimizer.grids) for s in g.points]
                    yield pa.RecordBatch.from_arrays([part.column(0), list_array(np.stack(v, 1))], names=["sim_id", "v"])

        values = cut(values.mapInArrow(run, "sim_id long, v array<double>"), "values")
        if held is not None:
            discard(held)
        held = values
    return np.split(mean_values(values), edges)


def simulate_switch(spark: SparkSession, simulator, sims: int, optimizer: SwitchOptimizer, archive: Archive, regime: int, state: list[int]) -> DataFrame:
    """(sim_id, gain): forward from the stored expectations of solve_switch()."""
    edges = np.cumsum([g.size for g in optimizer.grids])[:-1]
    shared = spark.sparkContext.broadcast([(archive.thing("switch", t), archive.array("switch", t)) for t in range(simulator.steps)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(at, ROWS).to_numpy(zero_copy_only=False)
                x, own, mode, gain = simulator.start(ids), np.tile(np.array(state), (len(ids), 1)), np.full(len(ids), regime), np.zeros(len(ids))
                for step in range(simulator.steps):
                    fit, coefficients = shared.value[step]
                    after = np.split(fit.value(x, coefficients), edges, 1)
                    new_mode, new_own = mode.copy(), own.copy()
                    for r in np.unique(mode).tolist():
                        k = mode == r
                        m, s, g = optimizer.simulate(r, own[k], [a[k] for a in after], x[k], step)
                        new_mode[k], new_own[k] = m, s
                        gain[k] += g * simulator.discount**step
                    mode, own = new_mode, new_own
                    x = simulator.move(x, ids, step)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gain)], names=["sim_id", "gain"])

    return spark.range(sims).mapInArrow(run, "sim_id long, gain double")


def american(spark: SparkSession, simulator, sims: int, payoff: Callable[[np.ndarray], np.ndarray], regressor: Callable[[int], Mean], fit: Callable | None = None) -> float:
    """Price of a claim that may be exercised at every step, by regression on realised cash.

    Cash is replaced by the payoff where the fitted expectation is below it.
    ``fit(regressor, coefficients)`` may change the fit, as convexification does.
    """

    def last(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(at, ROWS).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_array(payoff(simulator.states(ids, simulator.steps))[:, None])], names=["sim_id", "v"])

    values, held = spark.range(sims).mapInArrow(last, "sim_id long, v array<double>"), None
    for step in reversed(range(1, simulator.steps)):
        rows = _with_states(values, simulator, step)
        own = regressor(step).prepare(rows)
        coefficients = own.coefficients(rows) * simulator.discount
        if fit is not None:
            coefficients = fit(own, coefficients)
        shared = spark.sparkContext.broadcast((own, coefficients))

        def run(batches, shared=shared):
            own, coefficients = shared.value
            for batch in batches:
                x, cash = matrix_of(batch.column(1)), matrix_of(batch.column(2))[:, 0] * simulator.discount
                now = payoff(x)
                keep = own.value(x, coefficients)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), list_array(np.where(keep < now, now, cash)[:, None])], names=["sim_id", "v"])

        values = cut(rows.mapInArrow(run, "sim_id long, v array<double>"), "cash")
        if held is not None:
            discard(held)
        held = values
    price = float(mean_values(values)[0]) * simulator.discount
    return max(price, float(payoff(simulator.start(np.array([0])))[0]))

