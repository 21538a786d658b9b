"""Grids of stocks and their interpolators, as arrays: what a task needs of them.

A grid's points are numbered with the first coordinate running fastest.  Every
grid has ``points``, ``inside``, ``truncate`` and ``weights``: the point numbers
and weights of an interpolation, so values of any trailing shape are combined by
one gather and one sum.  ``points_table`` spreads a grid over a cluster.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 1e-10


class Grid:
    """A tensor grid: one ascending mesh for each coordinate."""

    def __init__(self, meshes: list[np.ndarray]):
        self.meshes = [np.asarray(m, float) for m in meshes]
        self.shape = tuple(len(m) for m in self.meshes)
        self.size = int(np.prod(self.shape))

    @property
    def dimension(self) -> int:
        return len(self.meshes)

    @functools.cached_property
    def points(self) -> np.ndarray:
        return np.stack([m[i] for m, i in zip(self.meshes, self.indices())], 1)

    def indices(self, first: int = 0, last: int | None = None) -> tuple[np.ndarray, ...]:
        """Coordinates' indices of the points from ``first`` to before ``last``."""
        return np.unravel_index(np.arange(first, self.size if last is None else last), self.shape, order="F")

    def part(self, rank: int, parts: int) -> range:
        """The contiguous block of points that falls to one of several parts, earlier parts holding the remainder."""
        each, more = divmod(self.size, parts)
        start = rank * each + min(rank, more)
        return range(start, start + each + (rank < more))

    def sub(self, first: list[int], past: list[int]) -> "Grid":
        """The slice of index ranges [first, past)."""
        return Grid([m[a:b] for m, a, b in zip(self.meshes, first, past)])

    @property
    def extremes(self) -> list[tuple[float, float]]:
        return [(float(m[0]), float(m[-1])) for m in self.meshes]

    def inside(self, x: np.ndarray, strict: bool = False) -> np.ndarray:
        low, high = np.array(self.extremes).T
        gap = EPS * np.maximum(1.0, np.abs(high - low))
        return ((x > low + gap) & (x < high - gap)).all(1) if strict else ((x >= low - gap) & (x <= high + gap)).all(1)

    def truncate(self, x: np.ndarray) -> np.ndarray:
        low, high = np.array(self.extremes).T
        return np.clip(x, low, high)

    def cell(self, x: np.ndarray) -> np.ndarray:
        """Lower corner's index in each coordinate; a point on a mesh value is in the cell above, at the end in the last."""
        return np.stack([np.clip(np.searchsorted(m, x[:, d] + EPS * max(1.0, abs(m[-1])), "right") - 1, 0, max(0, len(m) - 2)) for d, m in enumerate(self.meshes)], 1)

    def weights(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point numbers, weights), each [row, corner]: multilinear, constant beyond the box."""
        at = self.cell(x)
        numbers, weights, wide = np.zeros((len(x), 1), np.int64), np.ones((len(x), 1)), 1
        for d, m in enumerate(self.meshes):
            if len(m) == 1:
                continue
            low, high = m[at[:, d]], m[at[:, d] + 1]
            share = np.clip((x[:, d] - low) / (high - low), 0, 1)[:, None]
            numbers = np.concatenate([numbers + wide * at[:, d : d + 1], numbers + wide * (at[:, d : d + 1] + 1)], 1)
            weights = np.concatenate([weights * (1 - share), weights * share], 1)
            wide *= len(m)
        return numbers, weights

    def interpolate(self, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        """values[point, ...] at x[row, coordinate]."""
        numbers, weights = self.weights(x)
        return np.einsum("rc,rc...->r...", weights, values[numbers])

    def points_table(self, spark: SparkSession) -> DataFrame:
        """(point_id, coord array), generated where it is used."""
        coords, wide = [], 1
        for m in self.meshes:
            mesh = F.array(*[F.lit(float(v)) for v in m])
            coords.append(F.get(mesh, ((F.col("point_id") / F.lit(wide)).cast("long") % len(m)).cast("int")))
            wide *= len(m)
        return spark.range(self.size).withColumnRenamed("id", "point_id").withColumn("coord", F.array(*coords))


def regular(low: list[float], step: list[float], n: list[int]) -> Grid:
    return Grid([lo + h * np.arange(k + 1) for lo, h, k in zip(low, step, n)])


def general(meshes: list[list[float]]) -> Grid:
    return Grid([np.array(m) for m in meshes])


class IntegerGrid(Grid):
    """A lattice of integers, for states that are never interpolated."""

    def __init__(self, low: list[int], n: list[int]):
        super().__init__([np.arange(a, a + k + 1) for a, k in zip(low, n)])
        self.low = np.array(low)

    def number(self, state: np.ndarray) -> np.ndarray:
        """Point numbers of integer states."""
        out, wide = np.zeros(len(state), np.int64), 1
        for d, k in enumerate(self.shape):
            out, wide = out + wide * (state[:, d] - self.low[d]), wide * k
        return out


def lobatto(degree: int) -> np.ndarray:
    """Gauss-Legendre-Lobatto points on [-1, 1]: the ends and the eigenvalues of a Jacobi matrix."""
    if degree == 1:
        return np.array([-1.0, 1.0])
    k = np.arange(1, degree - 1)
    off = np.sqrt(k * (k + 2) / ((2 * k + 1) * (2 * k + 3)))
    return np.concatenate([[-1.0], np.linalg.eigvalsh(np.diag(off, 1) + np.diag(off, -1)) if degree > 2 else [0.0], [1.0]])


class LegendreGrid(Grid):
    """Regular cells, each with the Lobatto points of a degree in every coordinate."""

    def __init__(self, low: list[float], step: list[float], n: list[int], degree: list[int]):
        self.low, self.step, self.n, self.degree = (np.array(v) for v in (low, step, n, degree))
        meshes = []
        for lo, h, k, p in zip(low, step, n, degree):
            inner = (lobatto(p)[:-1] + 1) / 2 * h
            meshes.append(np.append((lo + h * np.arange(k)[:, None] + inner[None, :]).ravel(), lo + h * k))
        super().__init__(meshes)

    def sub_cells(self, first: list[int], past: list[int]) -> "LegendreGrid":
        f, p = np.array(first), np.array(past)
        return LegendreGrid(list(self.low + f * self.step), list(self.step), list(p - f), list(self.degree))

    def _local(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        cell = np.clip(np.floor((x - self.low) / self.step + 1e-12), 0, self.n - 1).astype(int)
        t = np.clip(2 * (x - self.low - cell * self.step) / self.step - 1, -1, 1)
        shares = []
        for d, p in enumerate(self.degree):
            z = lobatto(p)
            # Lagrange weights at the local coordinate
            gaps = t[:, d : d + 1] - z[None, :]
            shares.append(np.stack([np.prod(np.delete(gaps, j, 1), 1) / np.prod(z[j] - np.delete(z, j)) for j in range(p + 1)], 1))
        return cell, shares

    def weights(self, x):
        cell, shares = self._local(x)
        numbers, weights, wide = np.zeros((len(x), 1), np.int64), np.ones((len(x), 1)), 1
        for d, p in enumerate(self.degree):
            here = cell[:, d : d + 1] * p + np.arange(p + 1)[None, :]
            numbers = (numbers[:, None, :] + wide * here[:, :, None]).reshape(len(x), -1)
            weights = (shares[d][:, :, None] * weights[:, None, :]).reshape(len(x), -1)
            wide *= self.shape[d]
        return numbers, weights

    def interpolate(self, values, x, clamp: bool = False):
        """``clamp`` bounds the result by the cell's own values, as the spectral form does."""
        numbers, weights = self.weights(x)
        held = values[numbers]
        out = np.einsum("rc,rc...->r...", weights, held)
        return np.clip(out, held.min(1), held.max(1)) if clamp else out


# --- sparse grids -----------------------------------------------------------


def level_sets(dimension: int, most: int, weight: list[float], boundary: bool = True, full: bool = False) -> list[tuple[int, ...]]:
    """Admissible levels (from 1): weighted sum bounded by ``most``, or each level on its own for the full set."""
    room = most if boundary else most + dimension - 1
    tops = [int(room / w) for w in weight]
    if full:
        return [ls for ls in itertools.product(*[range(1, t + 1) for t in tops]) if all(lv * w <= most for lv, w in zip(ls, weight))]
    return [ls for ls in itertools.product(*[range(1, t + 1) for t in tops]) if sum(lv * w for lv, w in zip(ls, weight)) <= room]


def nodes_of(level: int, boundary: bool) -> list[float]:
    """Places in [0, 1] of a level's nodes: the centre (and ends) at level 1, odd multiples of 2^-level beyond."""
    if level == 1:
        return [0.0, 0.5, 1.0] if boundary else [0.5]
    return [(2 * k + 1) / 2**level for k in range(2 ** (level - 1))]


def father(place: float, level: int) -> tuple[float, int]:
    """The direct father of a node: the neighbour that belongs to the level before."""
    h = 2.0**-level
    k = round(place / h)
    up = k + 1 if (k + 1) // 2 % 2 else k - 1
    return up * h, level - 1


def ancestors(place: float, level: int) -> tuple[float, float]:
    """The nodes of lower levels (or ends) next to a node on either side."""
    return place - 2.0**-level, place + 2.0**-level


def basis(x: np.ndarray, place: float, level: int, degree: int, boundary: bool) -> np.ndarray:
    """Value of a node's one-dimensional basis function."""
    h = 2.0**-level
    if boundary and level == 1:
        linear = {0.0: np.maximum(0, 1 - 2 * x), 0.5: np.maximum(0, 1 - 2 * np.abs(x - 0.5)), 1.0: np.maximum(0, 2 * x - 1)}[place]
        return np.where(np.abs(2 * (x - 0.5)) <= 1, 1 - (2 * (x - 0.5)) ** 2, 0.0) if degree > 1 and place == 0.5 else linear
    if not boundary:
        if level == 1:
            return np.ones_like(x)
        # the outermost nodes extrapolate in a line
        if place < 1.5 * h:
            return np.maximum(0.0, 2 - x / h)
        if place > 1 - 1.5 * h:
            return np.maximum(0.0, 2 - (1 - x) / h)
    t = (x - place) / h
    body = np.maximum(0, 1 - np.abs(t))
    if degree == 1 or (degree == 3 and level < 2):
        return body
    bowl = np.where(np.abs(t) < 1, (1 + t) * (1 - t), 0.0)
    if degree == 2 or level <= 2:
        return bowl
    k = round(place / h)
    left = k % 4 == 1
    return np.where(np.abs(t) < 1, (t * t - 1) * (t - 3) / 3 if left else (1 - t * t) * (t + 3) / 3, 0.0)


class SparseGrid:
    """Hierarchical nodes of a set of levels on a box; degree 1, 2 or 3; with or without nodes on the boundary.

    Without them the outermost functions extrapolate.  Surpluses are found level
    by level: what the nodes of smaller levels leave of the value, which is the
    dimension-by-dimension transform for a set that holds all smaller levels.
    """

    def __init__(self, low: list[float], size: list[float], most: int, weight: list[float], degree: int = 1, boundary: bool = True, levels: list[tuple[int, ...]] | None = None):
        self.low, self.size, self.weight, self.degree, self.boundary, self.most = np.array(low), np.array(size), list(weight), degree, boundary, most
        self.levels = sorted(levels if levels is not None else level_sets(len(low), most, weight, boundary), key=lambda ls: (sum(ls), ls))
        self._build()

    def _build(self) -> None:
        self.nodes: list[tuple[tuple[int, ...], tuple[float, ...]]] = []
        for ls in self.levels:
            for places in itertools.product(*[nodes_of(lv, self.boundary) for lv in ls]):
                self.nodes.append((ls, places))
        self.number = {n: k for k, n in enumerate(self.nodes)}

    @property
    def points(self) -> np.ndarray:
        return self.low + self.size * np.array([p for _, p in self.nodes]).reshape(-1, len(self.low))

    def at_level(self, ls: tuple[int, ...]) -> np.ndarray:
        """Numbers of one level's points."""
        return np.array([k for k, (own, _) in enumerate(self.nodes) if own == ls], np.int64)

    def matrix(self, x: np.ndarray) -> np.ndarray:
        """[row, node]: basis values."""
        u = (np.asarray(x, float) - self.low) / self.size
        if self.boundary:
            u = np.clip(u, 0, 1)
        out = np.ones((len(u), len(self.nodes)))
        known: dict = {}
        for k, (ls, places) in enumerate(self.nodes):
            for d, (lv, p) in enumerate(zip(ls, places)):
                if (d, lv, p) not in known:
                    known[d, lv, p] = basis(u[:, d], p, lv, self.degree, self.boundary)
                out[:, k] *= known[d, lv, p]
        return out

    def hierarchize(self, values: np.ndarray) -> np.ndarray:
        """Nodal values to surpluses; trailing axes are carried along."""
        return np.linalg.solve(self.matrix(self.points), np.asarray(values, float))

    def hierarchize_level(self, values: np.ndarray, surplus: np.ndarray, ls: tuple[int, ...]) -> np.ndarray:
        """Surpluses of one level's points, those of the smaller levels known (others zero)."""
        at = self.at_level(ls)
        below = np.array([all(a <= b for a, b in zip(own, ls)) and own != ls for own, _ in self.nodes])
        rows = self.matrix(self.points[at])
        return np.linalg.solve(rows[:, at], np.asarray(values)[at] - rows[:, below] @ surplus[below])

    def dehierarchize(self, surplus: np.ndarray) -> np.ndarray:
        return self.matrix(self.points) @ surplus

    def evaluate(self, surplus: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.matrix(x) @ surplus

    def interpolate(self, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.evaluate(self.hierarchize(values), x)

    def inside(self, x: np.ndarray, strict: bool = False) -> np.ndarray:
        if not self.boundary:
            return np.ones(len(x), bool)
        u = (x - self.low) / self.size
        return ((u > EPS) & (u < 1 - EPS)).all(1) if strict else ((u >= -EPS) & (u <= 1 + EPS)).all(1)

    def truncate(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x, self.low, self.low + self.size)

    def _errors(self, surplus: np.ndarray, phi) -> dict[tuple[int, ...], float]:
        return {ls: float(phi(surplus[self.at_level(ls)])) for ls in self.levels}

    def _fathers(self, ls):
        return [tuple(v - (d == k) for d, v in enumerate(ls)) for k in range(len(ls)) if ls[k] > 1]

    def refine(self, precision: float, f, phi=lambda s: np.abs(s).max(initial=0.0), total=max, most_levels: int = 400) -> tuple["SparseGrid", np.ndarray]:
        """The active level of the largest error is retired and its children, whose fathers are all old, join, until total(errors) < precision."""
        grid, old = self, set()
        values = f(grid.points)
        surplus = grid.hierarchize(values)
        children = lambda ls: [tuple(v + (d == k) for d, v in enumerate(ls)) for k in range(len(ls))]
        old = {ls for ls in grid.levels if all(c in grid.levels for c in children(ls))}
        while len(grid.levels) < most_levels:
            errors = {ls: e for ls, e in grid._errors(surplus, phi).items() if ls not in old}
            if not errors or total(errors.values()) < precision:
                break
            worst = max(errors, key=lambda ls: (errors[ls], ls))
            old.add(worst)
            new = [c for c in children(worst) if c not in grid.levels and all(p in old for p in grid._fathers(c))]
            if new:
                grid = SparseGrid(list(self.low), list(self.size), self.most, self.weight, self.degree, self.boundary, [*grid.levels, *new])
                surplus = grid.hierarchize(f(grid.points))
        return grid, surplus

    def coarsen(self, precision: float, surplus: np.ndarray, phi=lambda s: np.abs(s).max(initial=0.0)) -> tuple["SparseGrid", np.ndarray]:
        """Active levels (no child left) of the smallest error below precision go, one after the other; points are numbered anew."""
        levels, errors = set(self.levels), self._errors(surplus, phi)
        while len(levels) > 1:
            active = [ls for ls in levels if not any(tuple(v + (d == k) for d, v in enumerate(ls)) in levels for k in range(len(ls)))]
            able = [ls for ls in active if errors[ls] < precision]
            if not able:
                break
            levels.remove(min(able, key=lambda ls: (errors[ls], ls)))
        out = SparseGrid(list(self.low), list(self.size), self.most, self.weight, self.degree, self.boundary, list(levels))
        return out, surplus[[self.number[n] for n in out.nodes]]


def step_mean(knots: np.ndarray, values: np.ndarray, a: float, b: float) -> float:
    """Mean over [a, b] of the step function that holds values[k] from knots[k] on."""
    if not b > a:
        return float(values[max(0, np.searchsorted(knots, a, "right") - 1)])
    edges = np.concatenate([[a], knots[(knots > a) & (knots < b)], [b]])
    held = values[np.maximum(0, np.searchsorted(knots, edges[:-1], "right") - 1)]
    return float((held * np.diff(edges)).sum() / (b - a))


def prime_factors(n: int) -> list[int]:
    out, k = [], 2
    while n > 1:
        while n % k == 0:
            out.append(k)
            n //= k
        k += 1 if k * k <= n else max(1, n - k)
    return out


def cone_parts(grid: Grid, split: list[bool], parts: int) -> list[int]:
    """Parts of each coordinate whose product is ``parts``: the largest prime factors go to the longest coordinates that may be split."""
    out, left = [1] * grid.dimension, [float(n) if ok else 0.0 for n, ok in zip(grid.shape, split)]
    for p in sorted(prime_factors(parts), reverse=True):
        d = max(range(grid.dimension), key=lambda k: left[k])
        if left[d] > 0:
            out[d], left[d] = out[d] * p, left[d] / p
    return out

