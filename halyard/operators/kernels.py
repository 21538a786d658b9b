"""Laplacian kernel sums on a grid in time linear in the rows."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators.cdf import first_knot


def laplacian_on_grid(df: DataFrame, knots: dict[str, list[float]], y: str, h: list[float]) -> DataFrame:
    """(k0, k1, ..., weight, fit): kernel sum and weighted mean of y at every grid point.

    The kernel is the product of exp(-|x - z| / h).  It factors through the knot
    next to a row, so rows are summed at the knots beside them, once for each
    combination of sides, and the sums decay from knot to knot on a table of the
    grid's size.  Rows with a null are left out.
    """
    names = [f"k{d}" for d in range(len(knots))]
    rows = df.select(*[F.col(x).cast("double").alias(f"x{d}") for d, x in enumerate(knots)], F.col(y).cast("double").alias("y")).dropna()
    grids = [np.array(z, float) for z in knots.values()]
    listed = [F.array(*[F.lit(float(v)) for v in z]) for z in grids]
    for d in range(len(names)):
        rows = rows.withColumn(f"p{d}", first_knot(f"x{d}", grids[d]))
    ways = []
    for sides in itertools.product((0, 1), repeat=len(names)):
        # side 0: to knots at or above the row; side 1: to knots below it
        at = [F.col(f"p{d}") - s for d, s in enumerate(sides)]
        weight = F.lit(1.0)
        for d, p in enumerate(at):
            weight = weight * F.exp(-F.abs(F.get(listed[d], p) - F.col(f"x{d}")) / F.lit(float(h[d])))
        ways.append(F.struct(*[F.lit(s).alias(f"s{d}") for d, s in enumerate(sides)], *[p.alias(n) for n, p in zip(names, at)], weight.alias("w")))
    keys = [*[f"s{d}" for d in range(len(names))], *names]
    sums = rows.select("y", F.inline(F.array(*ways))).where("w is not null").groupBy(*keys).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).collect()  # 2^d times the grid at most
    table = np.zeros((*[2] * len(names), *[len(z) for z in grids], 2))
    for r in sums:
        table[tuple(r[k] for k in keys)] = r["w"], r["wy"]
    for d, z in enumerate(grids):
        decay = np.exp(-np.diff(z) / h[d])
        # the first axis is this coordinate's side, and its knots are here once that is gone
        axis = len(names) - 1
        up, down = np.moveaxis(table[0], axis, 0).copy(), np.moveaxis(table[1], axis, 0).copy()
        for k in range(1, len(z)):
            up[k] += up[k - 1] * decay[k - 1]
            down[-k - 1] += down[-k] * decay[-k]
        table = np.moveaxis(up + down, 0, axis)
    points = [(*index, float(table[index][0]), float(table[index][1] / table[index][0]) if table[index][0] else None) for index in np.ndindex(*[len(z) for z in grids])]
    return df.sparkSession.createDataFrame(points, ", ".join(f"{n} int" for n in names) + ", weight double, fit double")
