"""Conditional expectations given a state: distributed fits, evaluated inside tasks.

A regressor is fitted in two parts.  ``prepare`` learns the partition of the
states (or nothing, for global bases) from a DataFrame (sim_id, x array); what it
keeps is bounded by the mesh.  ``coefficients`` then aggregates moments: tasks
sum their own rows, a cell's sums meet in one row each, and small systems are
solved by cell.  The result, [cell, basis, value], is bounded by mesh times grid,
checked against MOST_BYTES, and sent to the tasks that need it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from numpy.polynomial import chebyshev, hermite_e
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.control.grids import SparseGrid

#: Coefficients that may be brought together and sent to every task
MOST_BYTES = 1 << 28
#: Bins of a histogram pass, and rows of a bin that are brought to the driver
BINS, FEW_ROWS = 1024, 4096


def matrix_of(column) -> np.ndarray:
    """[row, k] of an Arrow list column whose lists are equally long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def list_array(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _summed(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """(cell, n, sums array) added up by cell; a row a cell comes to the driver."""

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"cell": table["cell"][:1], "n": pa.array([int(np.sum(table["n"].to_numpy()))], pa.int64()), "sums": list_array(matrix_of(table["sums"]).sum(0, keepdims=True))})

    got = rows.groupBy("cell").applyInArrow(add, "cell long, n long, sums array<double>").toArrow()
    return {int(c): (int(n), s) for c, n, s in zip(got["cell"].to_pylist(), got["n"].to_pylist(), matrix_of(got["sums"]))}


def _emit(total: dict[int, list]) -> pa.RecordBatch:
    cells = sorted(total)
    return pa.RecordBatch.from_arrays(
        [pa.array(cells, pa.int64()), pa.array([int(total[c][0]) for c in cells], pa.int64()), list_array(np.array([total[c][1] for c in cells]))], names=["cell", "n", "sums"]
    )


def _by_cell(cells: np.ndarray, columns: np.ndarray, total: dict[int, list]) -> None:
    """Adds the columns' sums of each cell to ``total``."""
    order = np.argsort(cells, kind="stable")
    found, first, count = np.unique(cells[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(columns[order], first, axis=0) if len(cells) else columns[:0]
    for c, n, s in zip(found.tolist(), count.tolist(), sums):
        if c in total:
            total[c][0] += n
            total[c][1] += s
        else:
            total[c] = [n, s.copy()]


def order_statistics(rows: DataFrame, ranks: dict[int, list[int]], n_bins: int = BINS, few: int = FEW_ROWS) -> dict[tuple[int, int], float]:
    """Exact values of given ranks (from 0) in each cell of rows(cell long, v double).

    Histograms, summed in the tasks first, narrow each rank down to a bin with
    few rows, and those come to the driver: no sort, no shuffle of rows.
    """
    ends = rows.groupBy("cell").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    span = {r["cell"]: (r["lo"], r["hi"]) for r in ends}
    todo = {(c, k): (*span[c], k) for c, ks in ranks.items() for k in ks if c in span}
    out: dict[tuple[int, int], float] = {}
    while todo:
        bins: dict[int, list[tuple[float, float]]] = {}
        for (c, _), (lo, hi, _) in todo.items():
            if (lo, hi) not in bins.setdefault(c, []):
                bins[c].append((lo, hi))

        def count(batches, bins=bins):
            total: dict = {}
            for batch in batches:
                cell, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                for c, ranges in bins.items():
                    own = v[cell == c]
                    for k, (lo, hi) in enumerate(ranges):
                        held = own[(own >= lo) & (own <= hi)]
                        at = _bin(held, lo, hi, n_bins)
                        h = total.setdefault((c, k), np.zeros(n_bins, np.int64))
                        h += np.bincount(at, minlength=n_bins)
            keys = [(c, k, b, int(h[b])) for (c, k), h in total.items() for b in np.nonzero(h)[0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in keys], pa.int64()) for j in range(4)], names=["c", "k", "b", "n"])

        hist: dict = {}
        for r in rows.select("cell", "v").mapInArrow(count, "c long, k long, b long, n long").groupBy("c", "k", "b").agg(F.sum("n").alias("n")).collect():
            hist.setdefault((r["c"], r["k"]), np.zeros(n_bins, np.int64))[r["b"]] = r["n"]
        near, wanted = {}, {}
        for (c, rank), (lo, hi, k) in todo.items():
            h = hist[c, bins[c].index((lo, hi))]
            upto = np.cumsum(h)
            b = int(np.searchsorted(upto, k, "right"))
            wide = (hi - lo) / n_bins
            left, n = k - int(upto[b] - h[b]), int(h[b])
            if n <= few or not wide or lo + b * wide >= lo + (b + 1) * wide:
                wanted[c, rank] = (lo, hi, b, left)
            else:
                near[c, rank] = (lo + b * wide, lo + (b + 1) * wide, None, lo, hi, b, k)
        if wanted:
            asked = sorted({(c, lo, hi, b) for (c, _), (lo, hi, b, _) in wanted.items()})

            def fetch(batches, asked=asked):
                for batch in batches:
                    cell, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                    for j, (c, lo, hi, b) in enumerate(asked):
                        own = v[(cell == c) & (v >= lo) & (v <= hi)]
                        own = own[_bin(own, lo, hi, n_bins) == b]
                        if len(own):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), j), pa.int64()), pa.array(own)], names=["j", "v"])

            # equal values of a bin that can't be split any further need no more than their count
            got = rows.select("cell", "v").mapInArrow(fetch, "j long, v double").groupBy("j", "v").count().toArrow()
            j, v, n = (got[k].to_numpy() for k in ("j", "v", "count"))
            for (c, rank), (lo, hi, b, left) in wanted.items():
                own = j == asked.index((c, lo, hi, b))
                order = np.argsort(v[own])
                out[c, rank] = float(v[own][order][np.searchsorted(np.cumsum(n[own][order]), left, "right")])
        todo = {}
        for key, (a, z, _, lo, hi, b, k) in near.items():
            h = hist[key[0], bins[key[0]].index((lo, hi))]
            # the range is taken a little wide; its rank is counted anew from the rows below it
            below = rows.where((F.col("cell") == key[0]) & (F.col("v") < a) & (F.col("v") >= lo)).count()
            todo[key] = (a, z, k - below)
    return out


def _bin(v: np.ndarray, lo: float, hi: float, n: int) -> np.ndarray:
    return np.clip(((v - lo) * (n / (hi - lo))).astype(np.int64), 0, n - 1) if hi > lo else np.zeros(len(v), np.int64)


class Mean:
    """The plain mean: what a state at date zero, the same for all rows, has for an expectation."""

    cells_, wide = 1, 1

    def prepare(self, states: DataFrame) -> "Mean":
        return self

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x), np.int64)

    def basis(self, x: np.ndarray) -> np.ndarray:
        return np.ones((len(x), 1))

    def coefficients(self, rows: DataFrame) -> np.ndarray:
        """[cell, basis, value] from rows(x array, v array): the least squares fit of every entry of v."""
        pairs = list(itertools.combinations_with_replacement(range(self.wide), 2))

        def moments(batches):
            total: dict[int, list] = {}
            for batch in batches:
                x, v = matrix_of(batch.column(0)), matrix_of(batch.column(1))
                p = self.basis(x)
                columns = [p[:, i] * p[:, j] for i, j in pairs]
                _by_cell(self.cells(x), np.concatenate([np.stack(columns, 1), (p[:, :, None] * v[:, None, :]).reshape(len(x), -1)], 1), total)
            if total:
                yield _emit(total)

        found = _summed(rows.select("x", "v").mapInArrow(moments, "cell long, n long, sums array<double>"))
        if not found:
            return np.zeros((self.cells_, self.wide, 0))
        values = (len(next(iter(found.values()))[1]) - len(pairs)) // self.wide
        if self.cells_ * self.wide * values * 8 > MOST_BYTES:
            raise ValueError(f"{self.cells_} cells of {self.wide} functions for {values} values are too many to send to every task")
        out = np.zeros((self.cells_, self.wide, values))
        for c, (_, sums) in found.items():
            gram = np.zeros((self.wide, self.wide))
            for (i, j), s in zip(pairs, sums):
                gram[i, j] = gram[j, i] = s
            out[c] = solve(gram, sums[len(pairs) :].reshape(self.wide, values))
        return out

    def value(self, x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
        """[row, value]"""
        return np.einsum("rk,rkv->rv", self.basis(x), coefficients[self.cells(x)])

    def fitted(self, rows: DataFrame) -> DataFrame:
        """rows(.., x array, v array) with fit array: the expectation of every entry of v given x."""
        shared, names = rows.sparkSession.sparkContext.broadcast(self.coefficients(rows)), rows.columns

        def run(batches):
            for batch in batches:
                fit = self.value(matrix_of(batch.column(names.index("x"))), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, list_array(fit)], names=[*names, "fit"])

        return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", fit array<double>")


def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Normal equations; pivots below a relative tolerance count as zero, so singular systems have the solution of least norm."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    u, s, vt = np.linalg.svd(gram / np.outer(scale, scale))
    keep = s > s[0] * 1e-12 if s[0] > 0 else np.zeros(len(s), bool)
    inverse = (vt[keep].T / s[keep]) @ u[:, keep].T
    return (inverse @ (right / scale[:, None])) / scale[:, None]


class _Rotated(Mean):
    """Optional principal axes: states are centred, turned and scaled to unit variance."""

    rotate = False

    def _learn_axes(self, states: DataFrame) -> None:
        self.centre, self.turn = 0.0, None

        def run(batches):
            total: dict[int, list] = {}
            for batch in batches:
                x = matrix_of(batch.column(0))
                _by_cell(np.zeros(len(x), np.int64), np.concatenate([x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)], 1), total)
            if total:
                yield _emit(total)

        found = _summed(states.select("x").mapInArrow(run, "cell long, n long, sums array<double>"))
        if not found:
            return
        n, sums = found[0]
        d = int((np.sqrt(1 + 4 * len(sums)) - 1) / 2)
        mean = sums[:d] / n
        cov = sums[d:].reshape(d, d) / n - np.outer(mean, mean)
        self.spread = np.sqrt(np.maximum(np.diag(cov), 1e-300))
        self.centre = mean
        if self.rotate:
            w, v = np.linalg.eigh(cov)
            self.turn = v / np.sqrt(np.maximum(w, 1e-300))

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x if self.turn is None else (x - self.centre) @ self.turn

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.turn if self.turn is not None else (x - self.centre) / self.spread


class Local(_Rotated):
    """Constant (degree 0) or linear (1) fits in nested cells of equal mass, the last coordinate split first."""

    def __init__(self, meshes: list[int], degree: int = 1, rotate: bool = False):
        self.meshes, self.degree, self.rotate = list(meshes), degree, rotate
        self.cells_, self.wide = int(np.prod(meshes)), 1 + degree * len(meshes)

    def prepare(self, states: DataFrame) -> "Local":
        self._learn_axes(states)
        self.bounds: list[np.ndarray] = []
        for d in reversed(range(len(self.meshes))):

            def split(batches, d=d):
                for batch in batches:
                    x = self.turned(matrix_of(batch.column(0)))
                    yield pa.RecordBatch.from_arrays([pa.array(self._partial(x), pa.int64()), pa.array(np.ascontiguousarray(x[:, d]))], names=["cell", "v"])

            rows, k = states.select("x").mapInArrow(split, "cell long, v double"), self.meshes[d]
            counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
            starts = {c: [j * (n // k) + min(j, n % k) for j in range(1, k)] for c, n in counts.items()}
            found = order_statistics(rows, {c: [min(r, counts[c] - 1) for r in rs] for c, rs in starts.items()}) if k > 1 else {}
            so_far = int(np.prod(self.meshes[d + 1 :]))
            bounds = np.full((so_far, k - 1), np.inf)
            for c, rs in starts.items():
                bounds[c] = [found[c, min(r, counts[c] - 1)] for r in rs]
            self.bounds.append(bounds)
        return self

    def _partial(self, x: np.ndarray) -> np.ndarray:
        """Cells by the coordinates split so far."""
        cell = np.zeros(len(x), np.int64)
        for k, bounds in enumerate(self.bounds):
            d = len(self.meshes) - 1 - k
            cell = cell * self.meshes[d] + (x[:, d : d + 1] >= bounds[cell]).sum(1)
        return cell

    def cells(self, x):
        return self._partial(self.turned(x))

    def basis(self, x):
        one = np.ones((len(x), 1))
        return np.concatenate([one, self.scaled(x)], 1) if self.degree else one


class SameSize(_Rotated):
    """Constant or linear fits in cells of equal width; states outside go to the outer cells."""

    def __init__(self, low: list[float], step: list[float], n: list[int], degree: int = 1):
        self.low, self.step, self.n, self.degree = np.array(low), np.array(step), np.array(n), degree
        self.cells_, self.wide = int(np.prod(n)), 1 + degree * len(n)

    def prepare(self, states):
        self._learn_axes(states)
        return self

    def cells(self, x):
        at = np.clip(np.floor((x - self.low) / self.step), 0, self.n - 1).astype(np.int64)
        return at @ np.concatenate([[1], np.cumprod(self.n)[:-1]])

    basis = Local.basis


class KMeans(_Rotated):
    """Constant or linear fits around centres found by Lloyd's steps; a step is one aggregation."""

    def __init__(self, meshes: list[int], degree: int = 1, rotate: bool = False, sweeps: int = 12):
        self.degree, self.rotate, self.sweeps = degree, rotate, sweeps
        self.cells_, self.wide = int(np.prod(meshes)), 1 + degree * len(meshes)

    def prepare(self, states):
        self._learn_axes(states)
        # the rows of the smallest hashes start as centres
        first = states.orderBy(F.xxhash64("sim_id"), "sim_id").limit(self.cells_).select("x").toArrow()
        self.centres = self.scaled(matrix_of(first["x"]))
        for _ in range(self.sweeps):

            def run(batches):
                total: dict[int, list] = {}
                for batch in batches:
                    x = matrix_of(batch.column(0))
                    _by_cell(self.cells(x), self.scaled(x), total)
                if total:
                    yield _emit(total)

            found = _summed(states.select("x").mapInArrow(run, "cell long, n long, sums array<double>"))
            before = self.centres.copy()
            for c, (n, s) in found.items():
                self.centres[c] = s / n
            if np.allclose(before, self.centres, atol=1e-4):
                break
        return self

    def cells(self, x):
        z = self.scaled(x)
        out = np.empty(len(z), np.int64)
        for at in range(0, len(z), 8192):
            part = z[at : at + 8192]
            out[at : at + 8192] = ((part[:, None, :] - self.centres[None]) ** 2).sum(2).argmin(1)
        return out

    basis = Local.basis


class DiscreteLast(_Rotated):
    """The last coordinate takes the values 0 to n - 1: for each of them cells of equal mass in the others."""

    def __init__(self, meshes: list[int], n: int, degree: int = 1):
        self.n, self.degree = n, degree
        self.parts = [Local(meshes, degree) for _ in range(n)]
        self.each = int(np.prod(meshes))
        self.cells_, self.wide = n * self.each, 1 + degree * len(meshes)

    def prepare(self, states):
        for k, part in enumerate(self.parts):
            own = states.where(F.round(F.element_at("x", -1)) == k).select("sim_id", F.slice("x", 1, F.size("x") - 1).alias("x"))
            part.prepare(own)
        self._learn_axes(states.select(F.slice("x", 1, F.size("x") - 1).alias("x")))
        return self

    def cells(self, x):
        last = np.clip(np.rint(x[:, -1]), 0, self.n - 1).astype(np.int64)
        out = np.zeros(len(x), np.int64)
        for k, part in enumerate(self.parts):
            own = last == k
            out[own] = k * self.each + part.cells(x[own, :-1])
        return out

    def basis(self, x):
        return Local.basis(self, x[:, :-1])


def powers(degree: int, dimension: int, truncation: str = "total", q: float = 0.5) -> list[tuple[int, ...]]:
    """Exponents of a multivariate basis: of total degree, of each degree ("product"), or hyperbolic in the q-norm."""
    every = itertools.product(range(degree + 1), repeat=dimension)
    if truncation == "product":
        return list(every)
    if truncation == "hyperbolic":
        return [p for p in every if sum(k**q for k in p) ** (1 / q) <= degree + 1e-9]
    return [p for p in every if sum(p) <= degree]


_VANDER = {"canonical": lambda t, n: np.vander(t, n + 1, increasing=True), "hermite": hermite_e.hermevander, "tchebychev": chebyshev.chebvander}
_SLOPE = {"canonical": np.polynomial.polynomial.polyder, "hermite": hermite_e.hermeder, "tchebychev": chebyshev.chebder}


class Global(_Rotated):
    """Least squares on a polynomial basis of the scaled (or turned) states."""

    def __init__(self, family: str, degree: int, dimension: int, rotate: bool = False, truncation: str = "total"):
        self.family, self.degree, self.rotate = family, degree, rotate
        self.powers = powers(degree, dimension, truncation)
        self.cells_, self.wide = 1, len(self.powers)

    def prepare(self, states):
        self._learn_axes(states)
        return self

    def basis(self, x):
        tables = [_VANDER[self.family](t, self.degree) for t in self.scaled(x).T]
        return np.stack([np.prod([t[:, k] for t, k in zip(tables, p)], 0) for p in self.powers], 1)

    def slope(self, x: np.ndarray, coefficients: np.ndarray, d: int) -> np.ndarray:
        """Derivative of the fit along a coordinate (states not turned)."""
        z, out = self.scaled(x), np.zeros((len(x), coefficients.shape[2]))
        tables = [_VANDER[self.family](t, self.degree) for t in z.T]
        for p, c in zip(self.powers, coefficients[0]):
            one = np.zeros(self.degree + 1)
            one[p[d]] = 1
            lower = _SLOPE[self.family](one)
            own = _VANDER[self.family](z[:, d], len(lower) - 1) @ lower
            rest = np.prod([t[:, k] for j, (t, k) in enumerate(zip(tables, p)) if j != d], 0) if len(p) > 1 else 1.0
            out += (own * rest)[:, None] * c[None, :]
        return out / self.spread[d]


class Sparse(_Rotated):
    """Least squares on the functions of a sparse grid over the box of the states."""

    def __init__(self, level: int, weight: list[float], degree: int = 1, rotate: bool = False):
        self.level, self.weight, self.degree, self.rotate = level, weight, degree, rotate
        self.cells_ = 1

    def prepare(self, states):
        self._learn_axes(states)

        def run(batches):
            for batch in batches:
                z = self.turned(matrix_of(batch.column(0)))
                if len(z):
                    for k, row in enumerate((z.min(0), -z.max(0))):
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(row), pa.int64()), pa.array(np.arange(len(row)), pa.int64()), pa.array(row)], names=["k", "d", "v"])

        ends = {(r["k"], r["d"]): r["v"] for r in states.select("x").mapInArrow(run, "k long, d long, v double").groupBy("k", "d").agg(F.min("v").alias("v")).collect()}
        d = len(self.weight)
        low, high = np.array([ends[0, j] for j in range(d)]), -np.array([ends[1, j] for j in range(d)])
        self.grid = SparseGrid(list(low), list(np.maximum(high - low, 1e-12)), self.level, self.weight, self.degree)
        self.wide = len(self.grid.nodes)
        return self

    def basis(self, x):
        return self.grid.matrix(self.turned(x))


def convex_slopes(coefficients: np.ndarray, edges: np.ndarray, counts: np.ndarray, sweeps: int = 5) -> np.ndarray:
    """Makes a one-dimensional piecewise affine fit convex: slopes in ascending cells are pooled until they rise.

    coefficients: [cell, (intercept, slope)]; edges: between the cells.  Pools
    keep the weighted mean slope; intercepts then join the pieces, and the mean
    of the fit over all rows, taken at the cells' middles, is kept.  This is a
    projection of our own choice.
    """
    out = coefficients.astype(float).copy()
    middle = np.concatenate([[edges[0]], (edges[1:] + edges[:-1]) / 2, [edges[-1]]]) if len(edges) else np.zeros(1)
    for _ in range(sweeps):
        before = out[:, 0] + out[:, 1] * middle
        pools: list[list] = []
        for s, n in zip(out[:, 1], counts):
            pools.append([s * n, n, 1])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        slopes = np.concatenate([np.full(k, s / n) for s, n, k in pools])
        level = np.concatenate([[0.0], np.cumsum((slopes[:-1] - slopes[1:]) * edges)])
        shift = np.average(before - (level + slopes * middle), weights=counts)
        done = np.allclose(out[:, 1], slopes)
        out = np.stack([level + shift, slopes], 1)
        if done:
            break
    return out
