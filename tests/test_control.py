import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.control import branching, dp, grids, models, regressors, sddp, semilagrange, treedp
from halyard.control.archive import Archive
from halyard.operators import cuts, dominance, grids as table_grids, lookups
from halyard.sources import noise, paths, trees


def test_noise_depends_on_its_coordinates_alone(spark):
    z = np.stack([noise.normals(3, np.arange(20_000), t, 2) for t in range(3)], 1).reshape(20_000, 6)
    assert abs(np.corrcoef(z.T) - np.eye(6)).max() < 0.03 and abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    one = paths.paths(spark, paths.BlackScholes(3, 1.0, seed=4), 100)
    many = paths.paths(spark, paths.BlackScholes(3, 1.0, seed=4), 100).repartition(7)
    key = lambda df: sorted((r["step"], r["sim_id"], r["x"][0]) for r in df.collect())
    assert key(one) == key(many)


def test_simulators_have_their_moments():
    ids = np.arange(60_000)
    bs = paths.BlackScholes(4, 1.0, s0=(1.0, 2.0), sigma=(0.2, 0.3), mu=(0.05, 0.0), correlation=((1.0, 0.6), (0.6, 1.0)))
    end = bs.states(ids, 4)
    assert np.allclose(end.mean(0), [math.exp(0.05), 2.0], rtol=0.01) and abs(np.corrcoef(np.log(end).T)[0, 1] - 0.6) < 0.02
    assert np.allclose(bs.path(ids[:10])[:, 4], bs.states(ids[:10], 4))
    ou = paths.MeanReverting(5, 1.0, sigma=(0.94, 0.3), reversion=(0.29, 2.0), curve=(50.0,) * 6)
    assert abs(ou.spot(ou.states(ids, 5), 5).mean() - 50) < 1 and np.allclose(ou.states(ids, 5).var(0), ou._variance(1.0), rtol=0.03)
    two = paths.TwoAssets(2, 1.0, sigma=(0.2, 0.4), reversion=(0.5, 0.1), rho=0.8, curves=((1.0,) * 3, (2.0,) * 3))
    assert np.allclose(two.spots(two.states(ids, 2), 2).mean(0), [1, 2], rtol=0.01)
    ar = paths.Autoregressive(10, 1.0, mean=50.0, first=40.0, reversion=5.0, sigma=3.0)
    assert abs(ar.states(ids, 10).mean() - (50 - 10 * math.exp(-5))) < 0.05
    assert abs(paths.Autoregressive(2, 1.0, mean=5.0, reversion=None).states(ids, 1).mean() - 5) < 0.02
    mmm = paths.MarketMinimal(4, 1.0)
    assert abs(mmm.states(ids, 4)[:, 0].mean() - (100 + 4 * mmm._clock(1.0))) < 1
    nig = paths.NormalInverseGaussian(2, 1.0)
    gamma = math.sqrt(4 - 0.25)
    want = 0.07 + 0.06 * (gamma - math.sqrt(4 - 0.5**2 + 0.0)) + 0.06 * -0.5 / gamma
    assert abs(np.log(nig.states(ids, 2)).mean() - want) < 0.01
    assert paths.MultiStage(bs, 3).dt == bs.dt and paths.GaussianSamples(2, 1.0, samples=3).sample(ids, 1, 2).shape == (60_000, 1)


def test_grids_of_every_kind():
    rng = np.random.default_rng(1)
    x = rng.uniform(-0.2, 2.2, (200, 2))
    f = lambda p: (1 + p[:, 0]) * (2 - p[:, 1])
    for grid in (grids.regular([0, 0], [0.5, 0.25], [4, 8]), grids.general([[0, 0.3, 1.7, 2], [0, 1.1, 2]])):
        assert np.allclose(grid.interpolate(f(grid.points), x), f(grid.truncate(x)))
        assert (grid.inside(grid.points)).all() and not grid.inside(np.array([[2.1, 0.0]])).any() and not grid.inside(grid.points[:1], strict=True).any()
        assert sorted(k for r in range(3) for k in grid.part(r, 3)) == list(range(grid.size))
    sub = grids.regular([0, 0], [0.5, 0.25], [4, 8]).sub([1, 2], [3, 5])
    assert sub.extremes == [(0.5, 1.0), (0.5, 1.0)] and sub.size == 6
    lattice = grids.IntegerGrid([0, -1], [3, 2])
    assert (lattice.number(lattice.points.astype(int)) == np.arange(12)).all()
    inside = np.clip(x, 0, 2)
    for p in (1, 2, 3, 5, 7):
        grid = grids.LegendreGrid([0.0, 0.0], [1.0, 1.0], [2, 2], [p, p])
        g = lambda q: q[:, 0] ** p + q[:, 1] ** p * q[:, 0]  # noqa: E731, B023
        assert np.allclose(grid.interpolate(g(grid.points), inside), g(inside))
        clamped = grid.interpolate(g(grid.points), inside, clamp=True)
        assert clamped.min() >= g(grid.points).min() - 1e-12
    assert grids.prime_factors(360) == [2, 2, 2, 3, 3, 5] and np.prod(grids.cone_parts(grid, [True, True], 12)) == 12
    assert grids.step_mean(np.array([0.0, 1.0, 4.0]), np.array([1.0, 3.0, 5.0]), 0.5, 6.0) == pytest.approx((0.5 + 9 + 10) / 5.5)
    assert grids.father(3 / 8, 3) == (0.25, 2) and grids.ancestors(3 / 8, 3) == (0.25, 0.5)


@pytest.mark.parametrize("boundary", [True, False])
@pytest.mark.parametrize("degree", [1, 2, 3])
def test_sparse_grids(boundary, degree):
    f = lambda p: np.sin(p[:, 0]) * np.exp(-p[:, 1])
    x = np.random.default_rng(2).uniform(0.2, 1.8, (100, 2))
    grid = grids.SparseGrid([0, 0], [2, 2], 6, [1, 1], degree, boundary)
    surplus = grid.hierarchize(f(grid.points))
    assert np.allclose(grid.dehierarchize(surplus), f(grid.points)) and abs(grid.evaluate(surplus, x) - f(x)).max() < 2e-3
    level = grid.levels[len(grid.levels) // 2]
    assert np.allclose(grid.hierarchize_level(f(grid.points), surplus, level), surplus[grid.at_level(level)])
    if boundary:
        fine, s = grids.SparseGrid([0, 0], [2, 2], 2, [1, 1], degree).refine(1e-3, f)
        assert abs(fine.evaluate(s, x) - f(x)).max() < 5e-3
        coarse, c = fine.coarsen(1e-2, s)
        assert len(coarse.nodes) < len(fine.nodes) and abs(coarse.evaluate(c, x) - f(x)).max() < 0.1


def test_regressions_in_two_dimensions(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 2))
    f = lambda t: (1 + 0.1 * t) ** 2 + t + 2
    true = f(x[:, 0]) * f(x[:, 1])
    rows = [(k, a.tolist(), [float(v)]) for k, (a, v) in enumerate(zip(x, true + rng.normal(0, 0.1, 3000)))]
    df = spark.createDataFrame(rows, "sim_id long, x array<double>, v array<double>").repartition(4).cache()
    kinds = [(regressors.Local([4, 4], 1, rotate=True), 0.05), (regressors.KMeans([4, 4]), 0.05), (regressors.Global("tchebychev", 3, 2), 0.02), (regressors.Global("canonical", 2, 2, truncation="product"), 0.02), (regressors.Sparse(4, [1, 1]), 0.03)]
    for fit, most in kinds:
        fit.prepare(df)
        c = fit.coefficients(df)
        assert np.sqrt(((fit.value(x, c)[:, 0] - true) ** 2).mean()) < most, fit
        assert len(np.unique(fit.cells(x))) == fit.cells_
    assert regressors.Mean().value(x, regressors.Mean().coefficients(df))[0, 0] == pytest.approx(np.mean([r[2] for r in rows]))
    two = spark.createDataFrame([(k, [float(a[0]), float(k % 2)], [float(a[0] * (1 + k % 2))]) for k, a in enumerate(x)], df.schema)
    last = regressors.DiscreteLast([3], 2).prepare(two)
    at = np.array([[0.5, 0.0], [0.5, 1.0]])
    assert np.allclose(last.value(at, last.coefficients(two))[:, 0], [0.5, 1.0])
    assert len(regressors.powers(3, 2)) == 10 and len(regressors.powers(3, 2, "product")) == 16 and len(regressors.powers(3, 2, "hyperbolic")) < 10
    whole = regressors.convex_slopes(np.array([[0.0, 1.0], [0.0, -1.0], [0.0, 2.0]]), np.array([1.0, 2.0]), np.array([1, 1, 1]))
    assert (np.diff(whole[:, 1]) >= 0).all()


def test_order_statistics_narrow_down(spark):
    v = np.round(np.random.default_rng(4).normal(0, 1, 900), 2)
    df = spark.createDataFrame([(k % 2, float(a)) for k, a in enumerate(v)], "cell long, v double")
    got = regressors.order_statistics(df, {0: [0, 100, 449], 1: [225]}, n_bins=8, few=5)
    assert got == {(c, r): sorted(v[c::2])[r] for c, r in [(0, 0), (0, 100), (0, 449), (1, 225)]}


def test_american_put_within_the_published_tolerance(spark):
    put = lambda x: np.maximum(1 - x.mean(1), 0)
    price = dp.american(spark, paths.BlackScholes(10, 1.0, 0.05, seed=3), 200_000, put, lambda step: regressors.Local([16]))
    assert price == pytest.approx(0.06031, rel=0.005)


def test_swing_optimised_and_simulated(spark, tmp_path):
    call, sim = (lambda x: np.maximum(x[:, 0] - 1, 0)), paths.BlackScholes(6, 1.0, 0.05, seed=5)
    final = lambda r, s, x: np.where(s[None, :, 0] < 3, call(x)[:, None], 0.0)
    archive, model = Archive(spark, f"file://{tmp_path}/a", one_file=True), models.Swing(call, 3)
    value = dp.solve(spark, sim, 20_000, grids.regular([0], [1], [3]), lambda step: regressors.Local([8]), model, final, archive, bellman=True)
    assert archive.steps("bellman") == list(range(6))
    for by_control in (False, True):
        got = dp.simulate(spark, paths.BlackScholes(6, 1.0, 0.05, seed=9), 20_000, model, archive, [0.0], final, by_control=by_control).agg(F.avg("gain")).first()[0]
        assert got == pytest.approx(value[0, 0], rel=0.02)


def test_storage_by_grid_and_by_cuts_agree(spark):
    sim = paths.MeanReverting(4, 1.0, 0.0, 2, sigma=(0.5,), reversion=(0.3,), curve=tuple(50 + 20 * math.sin(2 * k) for k in range(5)))
    spot = lambda x, step: sim.spot(x, step)
    grid = grids.regular([0.0], [10.0], [4])
    plain = dp.solve(spark, sim, 4000, grid, lambda s: regressors.Local([4]), models.Storage(spot, 0.0, 40.0, 20.0, 20.0), lambda r, s, x: np.zeros((len(x), len(s))))
    cut = dp.solve(spark, sim, 4000, grid, lambda s: regressors.Local([4]), models.StorageCut(spot, 0.0, 40.0, 20.0, 20.0), lambda s, x: (np.zeros((1, 1)), np.zeros((1, 1, 1))), cuts=True)
    assert plain[0, 2] > 100 and cut[0, 2] == pytest.approx(plain[0, 2], rel=0.05)


def test_lake_and_switching_costs_and_plants(spark, tmp_path):
    flow = paths.Autoregressive(4, 1.0, 0.0, 3, mean=50.0, first=50.0, reversion=5.0, sigma=20.0)
    lake, none = models.Lake(lambda step: 1.0 + step, 300.0, 100.0), (lambda r, s, x: np.zeros((len(x), len(s))))
    archive = Archive(spark, f"file://{tmp_path}/l")
    value = dp.solve(spark, flow, 3000, grids.regular([0.0], [50.0], [6]), lambda s: regressors.Local([3]), lake, none, archive)
    got = dp.simulate(spark, flow, 3000, lake, archive, [100.0], none).agg(F.avg("gain")).first()[0]
    assert got == pytest.approx(value[0, 2], rel=0.03)
    margin = lambda x, step: x[:, 0] - 50
    plant, kept = models.Thermal(margin, 2, 2, 4.0), Archive(spark, f"file://{tmp_path}/t")
    on, off = dp.solve_switch(spark, flow, 3000, lambda s: regressors.Local([4]), plant, kept)
    got = dp.simulate_switch(spark, flow, 3000, plant, kept, 0, [1]).agg(F.avg("gain")).first()[0]
    assert got == pytest.approx(on[1], abs=0.05 * abs(on[1]) + 0.5) and off[1] <= on[1] + 1e-9


def test_trees(spark, tmp_path):
    tree = trees.trinomial(0.94, 0.29, 20, 0.05)
    law = np.ones(1)
    for src, dst, prob in tree.edges:
        after = np.zeros(dst.max() + 1)
        np.add.at(after, dst, law[src] * prob)
        law = after
    end = tree.nodes[-1][:, 0]
    assert abs(law @ end) < 1e-9 and law @ end**2 == pytest.approx(0.94**2 * (1 - math.exp(-0.58)) / 0.58, rel=1e-6)
    tree.save(spark, f"file://{tmp_path}/tree")
    back = trees.Tree.load(spark, f"file://{tmp_path}/tree", 0.05)
    assert np.allclose(back.nodes[-1], tree.nodes[-1]) and np.allclose(back.expected(3, back.nodes[4]), tree.expected(3, tree.nodes[4]))
    walked = tree.walk(np.arange(20_000))
    assert tree.nodes[-1][walked[:, -1], 0].std() == pytest.approx(math.sqrt(law @ end**2), rel=0.03)
    pay = lambda n, t: np.maximum(50 - 50 * np.exp(0.2 * n[:, 0] - 0.02 * t / 50), 0)
    flat = trees.trinomial(1.0, 1e-6, 50, 1 / 50)
    every, few = treedp.american_tree(flat, pay, math.exp(-0.001)), treedp.american_tree(flat.thinned(list(range(0, 51, 5))), lambda n, t: pay(n, 5 * t), math.exp(-0.005))
    assert few < every < few * 1.01
    grid, price = grids.regular([0.0], [1.0], [2]), (lambda nodes: 1 + nodes[:, 0] ** 2)

    def optimize(grid, stock, now, nodes, number, t):
        stay = now.at(number, stock)
        sell = now.at(number, stock - 1) + price(nodes) if stock[0] >= 1 else np.full(len(nodes), -1e30)
        return np.maximum(stay, sell), (sell > stay).astype(float)

    def step(now, own, nodes, number, t):
        sell = (own[:, 0] >= 1) & (now.at(number, np.maximum(own - 1, 0)) + price(nodes) > now.at(number, own))
        return own - sell[:, None], np.where(sell, price(nodes), 0.0)

    value, held, controls = treedp.solve_tree(tree, grid, optimize, lambda s, n: np.zeros((len(n), len(s))))
    got = treedp.simulate_tree(spark, tree, 8000, step, held, [2.0], lambda s, n: np.zeros(len(n))).agg(F.avg("gain")).first()[0]
    assert got == pytest.approx(value[0, 2], rel=0.02) and len(controls) == tree.steps
    shifted = treedp.TreeCuts(np.array([[[5.0, 2.0]], [[1.0, 0.0]]]), grids.regular([3.0], [1.0], [0])).cuts(np.array([0, 1]))
    assert shifted[:, 0, 0].tolist() == [-1.0, 1.0]


def test_semi_lagrangian_heat_equation(spark):
    class Heat(semilagrange.SLOptimizer):
        def optimize(self, x, expectation, t):
            return expectation(0, np.zeros_like(x), np.ones((len(x), 1, 1)))[0][:, None], None

    grid = grids.regular([0.0], [math.pi / 100], [100])
    v = semilagrange.solve_sl(spark, grid, Heat(), lambda r, x: np.sin(x[:, 0]), 0.5, 8)
    assert abs(v[0] - np.sin(grid.points[:, 0]) * math.exp(-0.25)).max() < 0.006
    still = lambda x, u, k: (np.ones_like(x), np.zeros((len(x), 1, 1)), np.zeros(len(x)))
    assert semilagrange.simulate_sl(spark, grid, [np.zeros((0, 101))] * 4, still, [0.0], 10, 0.25, lambda x: x[:, 0]).agg(F.avg("gain")).first()[0] == pytest.approx(1.0)


def test_branching_against_a_known_solution(spark):
    for order, sizes, most in ((0, [3000, 10, 4], 0.03), (1, [3000, 6, 3], 0.05)):
        e = branching.Equation(lambda t, x: 0 * x, lambda t, x: np.tile(0.3 * np.eye(x.shape[1]), (len(x), 1, 1)), lambda t, x, u, du, d2u: 0.2 * u, lambda x: np.cos(x.sum(1)), 1.0, branching.Exponential(0.4), order)
        got = branching.solve(spark, e, [0.3, 0.2], sizes)
        assert got["value"] == pytest.approx(math.cos(0.5) * math.exp(0.11), abs=most)
        if order:
            assert got["gradient"] == pytest.approx([-math.sin(0.5) * math.exp(0.11)] * 2, abs=0.08)
    with pytest.raises(ValueError):
        branching.solve(spark, e, [0.0, 0.0], [2] * 7)
    law = branching.Gamma(0.5, 2.0)
    assert np.allclose(law.cdf(law.sample(np.array([0.1, 0.9]), None, 0)), [0.1, 0.9])


def test_linear_programmes_and_sddp(spark):
    x, value, dual = sddp.linear_programme(np.array([1.0, 2, 0]), np.array([[1.0, 1, -1]]), np.array([3.0]), np.zeros(3), np.array([2.0, np.inf, np.inf]))
    assert x[:2].tolist() == [2, 1] and value == 4 and dual.tolist() == [2]
    with pytest.raises(ValueError):
        sddp.linear_programme(np.ones(1), np.ones((1, 1)), np.array([5.0]), np.zeros(1), np.ones(1))
    assert len(sddp.distinct_states(np.array([[0.0], [1e-12], [1.0]]))) == 2
    sim = paths.Autoregressive(4, 4.0, 0.0, 3, mean=1.0, first=1.0, reversion=1.0, sigma=0.3)
    model = sddp.Reservoirs(1, 2.0, lambda s: 3.0, lambda s: 1.0 + 0.5 * math.sin(s), lambda s, x, z: np.array([max(0.0, x[0])]), start=2.0)
    got = sddp.solve_sddp(spark, sim, model, [2.0], lambda s: regressors.Mean(), 16, 3, 4, 60, accuracy=0.03, iterations=4)
    assert got["lower"] == pytest.approx(got["upper"], rel=0.06)


def test_mended_operators_keep_every_row(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 1.5), (2, None), (3, 9.0)], "id long, x double")
    grid = table_grids.RegularGrid((0.0,), (1.0,), (2,))
    values = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 20.0)], "point_id long, value double")
    want = [(1, 5.0), (1, 15.0), (2, None), (3, 20.0)]
    assert sorted((r["id"], r["value"]) for r in grid.interpolate(values, rows, ["x"], "id").collect() if r["value"] is not None) == [want[0], want[1], want[3]]
    centres = spark.createDataFrame([(k, float(k)) for k in range(9)], "c long, x double")
    for per_pass in (100, 4):
        got = lookups.nearest(rows, centres, ["x"], "id", "c", per_pass).collect()
        assert sorted((r["id"], -1 if r["nearest"] is None else r["nearest"]) for r in got) == [(1, 0), (1, 1), (2, -1), (3, 8)]
    lines = spark.createDataFrame([(0, 1.0, 0.0), (0, -1.0, 1.0)], "mesh long, s double, a0 double")
    parts = spark.createDataFrame([(1, 0, 0.2), (2, 5, 0.2)], "id long, mesh long, x double")
    assert sorted((r["id"], r["value"]) for r in cuts.upper_envelope(parts, lines, "mesh", ["x"], ["s"], "id").collect()) == [(1, 0.8), (2, None)]
    states = spark.createDataFrame([(0, 1.0), (0, 1.0 + 1e-12), (0, 2.0), (1, 1.0)], "mesh long, x double")
    assert cuts.distinct_within(states, ["mesh"], ["x"], 1e-9).count() == 3


def test_dominance_in_four_dimensions(spark):
    p = np.random.default_rng(8).normal(size=(60, 4))
    df = spark.createDataFrame([(k, *map(float, r), 1) for k, r in enumerate(p)], "id long, a double, b double, c double, d double, w long")
    got = {r["id"]: r["s"] for r in dominance.dominated(df, ["a", "b", "c", "d"]).collect()}
    assert got == {k: int((p < r).all(1).sum()) for k, r in enumerate(p)}
