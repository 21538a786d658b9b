"""Regular grids: points, cells and multilinear interpolation."""

from __future__ import annotations

import functools
import itertools
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.session import cut

#: Points of a grid whose values go to every task
MOST_POINTS = 1 << 20


@dataclass(frozen=True)
class RegularGrid:
    low: tuple[float, ...]
    step: tuple[float, ...]
    n: tuple[int, ...]

    def inside(self, xs: list[Column], eps: float = 1e-10) -> Column:
        out = F.lit(True)
        for x, lo, h, n in zip(xs, self.low, self.step, self.n):
            out = out & (x >= lo - eps) & (x <= lo + h * n + eps)
        return out

    def truncate(self, xs: list[Column]) -> list[Column]:
        return [F.greatest(F.lit(lo), F.least(F.lit(lo + h * n), x)) for x, lo, h, n in zip(xs, self.low, self.step, self.n)]

    def cells(self, xs: list[Column]) -> list[Column]:
        """Index of the cell's lower corner, clamped to the grid."""
        return [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - lo) / h + 1e-12))).cast("int") for x, lo, h, n in zip(xs, self.low, self.step, self.n)]

    def point_no(self, index: list[Column]) -> Column:
        out, wide = F.lit(0), 1
        for i, n in zip(index, self.n):
            out, wide = out + i * wide, wide * (n + 1)
        return out.cast("long")

    def corners(self, xs: list[Column]) -> Column:
        """Array of (point_id, weight): the 2^d corners of the cell around a point truncated to the grid."""
        xs = self.truncate(xs)
        cells = self.cells(xs)
        share = [(x - lo) / h - c for x, lo, h, c in zip(xs, self.low, self.step, cells)]
        out = []
        for bits in itertools.product((0, 1), repeat=len(cells)):
            weight = F.lit(1.0)
            for b, s in zip(bits, share):
                weight = weight * (s if b else 1.0 - s)
            out.append(F.struct(self.point_no([c + b for c, b in zip(cells, bits)]).alias("point_id"), weight.alias("weight")))
        return F.array(*out)

    @property
    def size(self) -> int:
        return math.prod(n + 1 for n in self.n)

    def strictly_inside(self, xs: list[Column], eps: float = 1e-10) -> Column:
        out = F.lit(True)
        for x, lo, h, n in zip(xs, self.low, self.step, self.n):
            out = out & (x > lo + eps) & (x < lo + h * n - eps)
        return out

    def sub(self, first: list[int], past: list[int]) -> "RegularGrid":
        """The slice of index ranges [first, past)."""
        low = tuple(lo + a * h for lo, h, a in zip(self.low, self.step, first))
        return RegularGrid(low, self.step, tuple(b - a - 1 for a, b in zip(first, past)))

    def interpolate(self, values: DataFrame, queries: DataFrame, xs: list[str], key: str) -> DataFrame:
        """(key, value), a row for each query row: values (point_id, value) at every point of the grid.

        Keys may repeat; a null coordinate gives a null value.  Up to MOST_POINTS
        points the values go to the tasks as one array and nothing is shuffled;
        beyond, rows are numbered and their corners joined.
        """
        corners = self.corners([F.col(x).cast("double") for x in xs])
        known = functools.reduce(operator.and_, [F.col(x).isNotNull() for x in xs])
        if self.size <= MOST_POINTS:
            listed = values.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("point_id", "value"))), lambda v: v["value"]).alias("grid_values"))  # size entries, checked
            value = F.aggregate(corners, F.lit(0.0), lambda a, c: a + c["weight"] * F.get("grid_values", c["point_id"].cast("int")))
            return queries.select(key, *[x for x in xs if x != key]).join(F.broadcast(listed), F.lit(True), "left").select(key, F.when(known, value).alias("value"))
        rows = cut(queries.select(F.monotonically_increasing_id().alias("row_no"), F.col(key).alias("row_key"), F.when(known, corners).alias("corners")), "corners")
        spread = rows.select("row_no", F.inline("corners")).join(values, "point_id").groupBy("row_no").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
        return rows.join(spread, "row_no", "left").select(F.col("row_key").alias(key), "value")
