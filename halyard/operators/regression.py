"""Conditional expectations: fits in cells or on a global basis.

A fit is one aggregation of moments (partial sums before the shuffle, a row per
cell after it); small systems are solved per cell, and fitted values come from
an equi-join with the coefficients.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.polynomials import basis


def local_constant(df: DataFrame, y: str, cell: str = "cell") -> DataFrame:
    """(cell, n, fit): the mean of y per cell; null y are left out."""
    return df.groupBy(cell).agg(F.count(y).alias("n"), F.avg(y).alias("fit"))


def _solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares that stays defined on singular systems."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    return np.linalg.lstsq(gram / np.outer(scale, scale), right / scale, rcond=1e-12)[0] / scale


def local_linear(df: DataFrame, xs: list[str], y: str, cell: str = "cell") -> DataFrame:
    """(cell, n, coef): y ~ coef[0] + coef[1] x1 + ... per cell.

    One coordinate stays in the JVM by regr_slope; more go through the cells'
    normal equations, a row per cell.  A cell whose system is singular gets the
    solution of least norm; with one coordinate it gets its mean.
    """
    if len(xs) == 1:
        x = F.col(xs[0])
        fit = df.where(F.col(y).isNotNull() & x.isNotNull()).groupBy(cell).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
        return fit.select(cell, "n", F.array(F.coalesce("a", "m"), F.when(F.col("a").isNull(), 0.0).otherwise(F.col("b"))).alias("coef"))
    kept = df.dropna(subset=[*xs, y])
    centre = kept.groupBy(cell).agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{k}") for k, x in enumerate(xs)])
    near = kept.join(centre.withColumnRenamed(cell, "c_cell"), F.col(cell) == F.col("c_cell"))
    cols = [F.lit(1.0), *[F.col(x) - F.col(f"m{k}") for k, x in enumerate(xs)]]
    pairs = list(itertools.combinations_with_replacement(range(len(cols)), 2))
    sums = near.groupBy(cell).agg(F.first("n").alias("n"), F.array(*[F.first(f"m{k}") for k in range(len(xs))]).alias("m"), F.array(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).alias("g"), F.array(*[F.sum(c * F.col(y)) for c in cols]).alias("r"))

    wide = len(cols)

    def solve(frames):
        for f in frames:
            out = []
            for g, r, m in zip(f["g"], f["r"], f["m"]):
                gram = np.zeros((wide, wide))
                for (i, j), v in zip(pairs, g):
                    gram[i, j] = gram[j, i] = v
                b = _solve(gram, np.asarray(r))
                b[0] -= b[1:] @ np.asarray(m)
                out.append(b.tolist())
            yield f[[cell, "n"]].assign(coef=out)

    kind = df.schema[cell].dataType.simpleString()
    return sums.mapInPandas(solve, f"{cell} {kind}, n long, coef array<double>")


def fitted(df: DataFrame, fit: DataFrame, xs: list[str], cell: str = "cell") -> DataFrame:
    """Adds fit, the value of the cell's affine function at each row."""
    value = F.col("coef")[0]
    for k, x in enumerate(xs):
        value = value + F.col("coef")[k + 1] * F.col(x)
    return df.join(fit.select(cell, "coef"), cell).withColumn("fit", value).drop("coef")


def global_fit(df: DataFrame, xs: list[str], y: str, family: str, degree: int) -> list[tuple[tuple[int, ...], float]]:
    """Coefficients of a total-degree polynomial basis; one aggregation gives the whole system."""
    powers = [p for p in itertools.product(range(degree + 1), repeat=len(xs)) if sum(p) <= degree]
    terms = []
    for p in powers:
        t = F.lit(1.0)
        for x, d in zip(xs, p):
            t = t * basis(family, d, F.col(x))
        terms.append(t)
    pairs = list(itertools.combinations_with_replacement(range(len(terms)), 2))
    row = df.dropna(subset=[*xs, y]).agg(*[F.sum(terms[i] * terms[j]) for i, j in pairs], *[F.sum(t * F.col(y)) for t in terms]).first()
    gram = np.zeros((len(terms), len(terms)))
    for (i, j), v in zip(pairs, row):
        gram[i, j] = gram[j, i] = v or 0.0
    right = np.array([v or 0.0 for v in row[len(pairs) :]])
    return list(zip(powers, _solve(gram, right).tolist()))


def global_value(coefs: list[tuple[tuple[int, ...], float]], xs: list[str], family: str):
    """The fitted polynomial as a Column."""
    out = F.lit(0.0)
    for p, c in coefs:
        t = F.lit(c)
        for x, d in zip(xs, p):
            t = t * basis(family, d, F.col(x))
        out = out + t
    return out
