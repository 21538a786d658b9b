import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import dominance


@pytest.fixture(scope="module")
def sample(spark):
    """Two coordinates of thousands of widths, some of equal value, and a y."""
    rng = np.random.default_rng(4)
    n = 400
    a = np.sort(np.r_[rng.uniform(0, 1000, n // 2), rng.uniform(90_000, 91_000, n // 2)])
    b = np.round(rng.uniform(0, 300, n), 0)
    a[5] = a[6] = a[7]
    y = rng.normal(5, 2, n)
    df = spark.createDataFrame(list(zip(range(n), a.tolist(), b.tolist(), y.tolist())), "id int, a double, b double, y double").repartition(5)
    return df, a, b, y


def test_kernel_density_over_wide_ranges_and_equal_values(sample):
    df, a, b, _ = sample
    got = {r["id"]: r["density"] for r in dominance.laplacian_density(df, ["a", "b"], [20.0, 15.0], "id").collect()}
    w = np.exp(-abs(a[:, None] - a) / 20 - abs(b[:, None] - b) / 15).sum(1) / (4 * len(a) * 20 * 15)
    np.testing.assert_allclose([got[k] for k in range(len(a))], w, rtol=1e-11)


@pytest.mark.parametrize("linear", [False, True])
@pytest.mark.parametrize("xs", [["a"], ["a", "b"]])
def test_kernel_regressions_over_wide_ranges(sample, xs, linear):
    df, a, b, y = sample
    x, h = np.stack([a, b], 1)[:, : len(xs)], [20.0, 15.0][: len(xs)]
    got = {r["id"]: r["fit"] for r in dominance.laplacian_regression(df, xs, "y", h, "id", linear=linear).collect()}
    for k in range(0, len(a), 7):
        apart = x - x[k]
        w = np.sqrt(np.exp(-(abs(apart) / h).sum(1)))[:, None]
        terms = np.c_[np.ones(len(a)), apart / h] if linear else np.ones((len(a), 1))
        fit = np.linalg.lstsq(terms * w, y * w[:, 0], rcond=None)[0][0]
        assert got[k] == pytest.approx(fit, abs=1e-8)


def test_kernel_sums_of_no_rows(spark):
    df = spark.range(0).select("id", F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(1.0).alias("y"))
    assert dominance.laplacian_density(df, ["a", "b"], [1.0, 1.0], "id").collect() == []
    assert dominance.laplacian_regression(df, ["a"], "y", [1.0], "id", linear=True).collect() == []
