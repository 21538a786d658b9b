import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions import payoffs
from halyard.functions.polynomials import coefficients
from halyard.operators import cdf, dominance, grids, kernels, lookups, ranks, regression, stopping
from halyard.sources import paths


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (400, 2))
    x[:20] = x[20:40]  # ties
    return x, x[:, 0] * 2 - x[:, 1] + rng.normal(0, 0.1, 400)


@pytest.fixture(scope="module")
def frame(spark, sample):
    x, y = sample
    return spark.createDataFrame([(k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y double").repartition(5)


def test_polynomials():
    assert coefficients("hermite", 4) == [3, 0, -6, 0, 1]
    assert coefficients("tchebychev", 3, 1) == [-3, 0, 12]
    assert coefficients("legendre", 2) == pytest.approx([-0.5, 0, 1.5])


def test_cells_have_equal_counts(frame):
    counts = [r["count"] for r in ranks.equal_mass(frame, {"a": 7, "b": 3}, "id").groupBy("cell").count().collect()]
    assert len(counts) == 21 and max(counts) - min(counts) <= 2 and sum(counts) == 400


def test_ranks_of_an_empty_table(frame):
    assert ranks.equal_mass(frame.limit(0), {"a": 3}, "id").count() == 0


def test_local_linear_matches_least_squares(frame, sample):
    celled = ranks.equal_mass(frame, {"a": 3}, "id")
    for fit in regression.local_linear(celled, ["a", "b"], "y").collect():
        ids = [r["id"] for r in celled.where(F.col("cell") == fit["cell"]).collect()]
        x, y = sample[0][ids], sample[1][ids]
        want = np.linalg.lstsq(np.c_[np.ones(len(ids)), x], y, rcond=None)[0]
        assert np.allclose(fit["coef"], want)


def test_global_fit_matches_least_squares(frame, sample):
    found = regression.global_fit(frame, ["a", "b"], "y", "tchebychev", 2)
    terms = [np.ones(400), *[None] * 0]
    value = {0: lambda t: np.ones_like(t), 1: lambda t: t, 2: lambda t: 2 * t * t - 1}
    terms = np.stack([value[p](sample[0][:, 0]) * value[q](sample[0][:, 1]) for (p, q), _ in found], 1)
    assert np.allclose([c for _, c in found], np.linalg.lstsq(terms, sample[1], rcond=None)[0])


def test_cdf_matches_brute_force(frame, sample):
    x, y = sample
    knots = {"a": [-0.5, 0.0, 0.9], "b": [-0.2, 0.6]}
    for r in cdf.cdf_on_grid(frame, knots, "y").collect():
        inside = (x[:, 0] <= knots["a"][r["k0"]]) & (x[:, 1] <= knots["b"][r["k1"]])
        assert r["f"] == pytest.approx(y[inside].sum() / 400)
    for r in cdf.cdf_on_sample(frame, "a", "y", "id").collect():
        assert r["f"] == pytest.approx(y[x[:, 0] <= x[r["id"], 0]].sum() / 400)


def test_interpolation_is_exact_on_bilinear_functions(spark, frame, sample):
    grid = grids.RegularGrid((-1.0, -1.0), (0.5, 0.25), (4, 8))
    rows = [(i + 5 * j, (1 + (-1 + 0.5 * i)) * (2 - (-1 + 0.25 * j))) for i in range(5) for j in range(9)]
    values = spark.createDataFrame(rows, "point_id long, value double")
    for r in grid.interpolate(values, frame, ["a", "b"], "id").collect():
        a, b = sample[0][r["id"]]
        assert r["value"] == pytest.approx((1 + a) * (2 - b))


def test_american_put(spark):
    made = paths.paths(spark, paths.BlackScholes(10, 1.0), 40_000).groupBy("sim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "x"))), lambda r: r["x"][0]).alias("s"))
    price = stopping.american(made, lambda x: F.greatest(1.0 - x, F.lit(0.0)), 10, 0.05, 1.0, 16)
    assert price == pytest.approx(0.06031, rel=0.03)


def test_payoffs(spark):
    row = spark.range(1).select(payoffs.basket_put(F.array(F.lit(1.0), F.lit(2.0)), 2.0), payoffs.exponential_cdf(F.lit(1.0), 2.0)).first()
    assert row[0] == 0.5 and row[1] == pytest.approx(1 - math.exp(-2))


def test_dominance_with_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(rng.integers(0, 6)), float(rng.integers(0, 6)), int(rng.integers(1, 9))) for k in range(90)]
    df = spark.createDataFrame([*rows, (90, None, 1.0, 5)], "id long, x double, y double, w long")
    found = {r["id"]: r["s"] for r in dominance.dominated(df, "x", "y", "w", "id").collect()}
    assert found == {i: sum(v for _, a, b, v in rows if a < x and b < y) for i, x, y, _ in rows}


def test_laplacian_grid_sums_reach_beyond_the_outer_knots(spark):
    rows = [(-3.0, 0.5, 2.0), (1.0, 9.0, 1.0), (0.2, 0.0, 4.0), (None, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    zs = {"a": [0.0, 1.0, 2.5], "b": [0.0, 1.0]}
    for r in kernels.laplacian_on_grid(df, zs, "y", [0.5, 2.0]).collect():
        w = [np.exp(-abs(a - zs["a"][r["k0"]]) / 0.5 - abs(b - zs["b"][r["k1"]]) / 2) for a, b, _ in rows[:3]]
        assert np.isclose(r["weight"], sum(w)) and np.isclose(r["fit"], np.dot(w, [2, 1, 4]) / sum(w))


def test_nearest_in_several_passes_keeps_the_lowest_id(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 4.9), (3, 9.0)], "id long, x double")
    centres = spark.createDataFrame([(7, 1.0), (3, -1.0), (5, 5.0), (6, 5.0), (9, 20.0)], "c long, x double")
    found = {r["id"]: r["nearest"] for r in lookups.nearest(points, centres, ["x"], "id", "c", per_pass=2).collect()}
    assert found == {1: 3, 2: 5, 3: 5}


def test_step_function_before_on_and_after_its_knots(spark):
    knots = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (4.0, 5.0)], "t double, v double")
    asked = spark.createDataFrame([(1, -2.0, 2.0), (2, 1.0, 1.0), (3, 0.5, 6.0)], "id long, a double, b double")
    found = {r["id"]: r["v"] for r in lookups.step_lookup(knots, asked.select("id", F.col("a").alias("t")), "t", "id").collect()}
    assert found == {1: 1.0, 2: 3.0, 3: 1.0}
    means = {r["id"]: r["mean"] for r in lookups.step_mean(knots, asked, "t", "v", "a", "b", "id").collect()}
    assert means[2] == 3.0 and np.isclose(means[1], (3 + 3) / 4) and np.isclose(means[3], (0.5 + 9 + 10) / 5.5)


def test_whole_cut_table_at_particles(spark):
    from halyard.operators import cuts
    from halyard.plans.geometry import all_cuts_at_particles

    sf_dir = "/root/testdata/sf0.01"
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal").collect()
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal").collect()
    want = {}
    for c in customers:
        values = [float(s["s_acctbal"]) / 1000 + 0.01 * s["s_suppkey"] * (float(c["c_acctbal"]) / 10 - s["s_suppkey"]) for s in suppliers if s["s_nationkey"] == c["c_nationkey"]]
        if values:
            want[c["c_custkey"]] = max(values)
    got = {r["id"]: r["value"] for r in all_cuts_at_particles(spark, sf_dir).collect()}
    assert len(got) == len(want) == len(customers)
    assert all(abs(got[k] - v) < 1e-4 for k, v in want.items())
    rng = np.random.default_rng(3)
    lines = [(k, k % 2, float(s), float(a)) for k, (s, a) in enumerate(zip(rng.integers(-20, 20, 3000) / 4, rng.normal(0, 30, 3000)))]
    kept = cuts.hull(spark.createDataFrame(lines, "k long, mesh long, s double, a0 double"), "mesh", "s", "k").collect()
    for mesh in (0, 1):
        top = lambda x, rows: max(a + s * x for s, a in rows)
        every, hull = [x[2:] for x in lines if x[1] == mesh], [(r["s"], r["a0"]) for r in kept if r["mesh"] == mesh]
        assert len(hull) < 41 and all(abs(top(x, every) - top(x, hull)) < 1e-9 for x in np.linspace(-100, 100, 401))
