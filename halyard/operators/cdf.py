"""Weighted empirical distribution functions on grids and on the sample itself."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.operators.ranks import with_rank


def first_knot(x: str, zs: list[float]):
    return F.size(F.filter(F.array(*[F.lit(float(z)) for z in zs]), lambda z: z < F.col(x)))


def cdf_on_grid(df: DataFrame, knots: dict[str, list[float]], y: str) -> DataFrame:
    """(k0, k1, ..., f): f = sum of y over rows at or below the knot in every coordinate, over all rows.

    Rows fall to the first knot at or above them (rows beyond the last count in
    the total alone), the occupied knots are summed, and prefix sums run over one
    coordinate after the other on a table no larger than the grid.
    """
    spark, names = df.sparkSession, [f"k{d}" for d in range(len(knots))]
    total = df.count()
    place = [first_knot(x, zs) for x, zs in knots.items()]
    inside = functools.reduce(operator.and_, [(F.col(n) < len(zs)) for n, zs in zip(names, knots.values())])
    kept = df.dropna(subset=list(knots))
    sums = kept.select(*[p.alias(n) for n, p in zip(names, place)], F.col(y).alias("v")).where(inside).groupBy(*names).agg(F.sum("v").alias("v"))
    grid = functools.reduce(lambda a, b: a.join(b), [spark.range(len(zs)).select(F.col("id").cast("int").alias(n)) for n, zs in zip(names, knots.values())])
    out = grid.join(sums, names, "left").na.fill(0.0, ["v"])
    for n in names:
        others = [m for m in names if m != n]
        out = out.withColumn("v", F.sum("v").over(Window.partitionBy(*(others or [F.lit(0)])).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*names, (F.col("v") / max(1, total)).alias("f"))


def cdf_on_sample(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Adds f: the sum of y over rows with x at or below this row's x, over the number of rows."""
    ranked = with_rank(df.where(F.col(x).isNotNull()), [x, tie], value=y)
    last = ranked.groupBy(x).agg(F.max_by("prefix", "rank0").alias("upto"))
    return ranked.drop("prefix", "rank0").join(last, x).withColumn("f", F.col("upto") / F.col("n_rows")).drop("upto", "n_rows")
