"""Control, regressions in several dimensions, sums under kernels and simulators, with the same in SQL."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from halyard.control import branching, dp, grids, models, regressors, semilagrange
from halyard.control.regressors import matrix_of
from halyard.functions import payoffs
from halyard.operators import dominance
from halyard.plans.queries import L_CTE, _lines, _round, _table, query
from halyard.sources import paths, trees
from halyard.sources.noise import uniform_sql

#: Orders with two coordinates in which no two are equal
U_CTE = "u AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) / 1000 + o_orderkey * 1e-7::DOUBLE AS a, CAST(o_orderkey AS DOUBLE) AS b, CAST(o_custkey AS DOUBLE) / 100 AS y FROM orders)"


def _points(spark, sf_dir):
    d = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return d.select(key.alias("id"), (F.col("o_totalprice").cast("double") / 1000 + key * 1e-7).alias("a"), key.cast("double").alias("b"), (F.col("o_custkey").cast("double") / 100).alias("y"))


def _states(spark, sf_dir):
    return _points(spark, sf_dir).select(F.col("id").alias("sim_id"), F.array("a", "b").alias("x"), F.array("y").alias("v"))


def _fit(regressor, spark, sf_dir):
    rows = _states(spark, sf_dir)
    return regressor.prepare(rows).fitted(rows).select(F.col("sim_id").alias("id"), _round(F.col("fit")[0], 4).alias("fit"))


_CELLS = f"{U_CTE}, m AS (SELECT *, ntile(3) OVER (ORDER BY b) AS cb FROM u), n AS (SELECT *, ntile(4) OVER (PARTITION BY cb ORDER BY a) AS ca FROM m)"
_PLANE = """c AS (SELECT {keys}, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS "by" FROM n GROUP BY {keys}),
p AS (SELECT *, (ay * bb - "by" * ab) / (aa * bb - ab * ab) AS pa, ("by" * aa - ay * ab) / (aa * bb - ab * ab) AS pb FROM c)
SELECT id, round(my + pa * (a - ma) + pb * (b - mb), 4) AS fit FROM n JOIN p USING ({keys})"""


@query(f"WITH {_CELLS} SELECT id, round(avg(y) OVER (PARTITION BY ca, cb), 4) AS fit FROM n")
def local_constant_2d(spark, sf_dir):
    return _fit(regressors.Local([4, 3], 0), spark, sf_dir)


@query(f"WITH {_CELLS}, " + _PLANE.format(keys="ca, cb"))
def local_linear_2d(spark, sf_dir):
    return _fit(regressors.Local([4, 3], 1), spark, sf_dir)


@query(f"WITH {U_CTE}, n AS (SELECT *, greatest(0, least(3, floor((a - 50) / 80))) AS ca FROM u), " + _PLANE.format(keys="ca"))
def same_size_linear_2d(spark, sf_dir):
    return _fit(regressors.SameSize([50.0, 0.0], [80.0, 1e9], [4, 1], 1), spark, sf_dir)


@query(f"WITH {U_CTE}, n AS (SELECT *, 0 AS k FROM u), " + _PLANE.format(keys="k"))
def global_plane(spark, sf_dir):
    return _fit(regressors.Global("hermite", 1, 2), spark, sf_dir)


C_CTE = "c AS (SELECT c_custkey AS id, CAST(c_custkey AS DOUBLE) AS a, CAST(c_acctbal AS DOUBLE) + c_custkey * 1e-4::DOUBLE AS b, c_nationkey AS n, CAST(c_nationkey AS DOUBLE) AS y FROM customer)"


def _customers(spark, sf_dir):
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(key.alias("id"), key.cast("double").alias("a"), (F.col("c_acctbal").cast("double") + key * 1e-4).alias("b"), F.col("c_nationkey").alias("n"), F.col("c_nationkey").cast("double").alias("y"))


@query(f"WITH {C_CTE} SELECT l.id, CAST(coalesce(sum(r.id), 0) AS BIGINT) AS s FROM c l LEFT JOIN c r ON r.a < l.a AND r.b < l.b AND r.n < l.n GROUP BY l.id")
def dominance_sums_3d(spark, sf_dir):
    return dominance.dominated(_customers(spark, sf_dir).withColumn("w", F.col("id")), ["n", "a", "b"], None, "w", "id")


@query(f"WITH {C_CTE} SELECT l.id, round((coalesce(sum(CASE WHEN r.a < l.a AND r.b < l.b THEN r.n END), 0) + any_value(l.n)) / (SELECT count(*) FROM c), 9) AS f FROM c l, c r GROUP BY l.id")
def cdf_on_sample_2d(spark, sf_dir):
    return dominance.cdf_of_sample(_customers(spark, sf_dir), ["a", "b"], "n", "id").withColumn("f", _round("f", 9))


@query(f"WITH {C_CTE} SELECT l.id, round(1e6::DOUBLE * sum(exp(-abs(l.a - r.a) / 200.0::DOUBLE - abs(l.b - r.b) / 1000.0::DOUBLE)) / (4 * 200.0::DOUBLE * 1000.0::DOUBLE * count(*)), 6) AS density FROM c l, c r GROUP BY l.id")
def laplacian_density(spark, sf_dir):
    got = dominance.laplacian_density(_customers(spark, sf_dir), ["a", "b"], [200.0, 1000.0], "id")
    return got.select("id", _round(F.col("density") * 1e6, 6).alias("density"))


@query(f"WITH {C_CTE}, k AS (SELECT l.id, exp(-abs(l.a - r.a) / 150.0::DOUBLE) AS w, r.y FROM c l, c r) SELECT id, round(sum(w * y) / sum(w), 6) AS fit FROM k GROUP BY id")
def laplacian_constant_regression(spark, sf_dir):
    return dominance.laplacian_regression(_customers(spark, sf_dir), ["a"], "y", [150.0], "id").withColumn("fit", _round("fit", 6))


@query(f"""WITH {C_CTE}, k AS (SELECT l.id, exp(-abs(l.a - r.a) / 150.0::DOUBLE) AS w, r.a - l.a AS d, r.y FROM c l, c r),
s AS (SELECT id, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1 FROM k GROUP BY id)
SELECT id, round((t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1), 5) AS fit FROM s""")
def laplacian_linear_regression(spark, sf_dir):
    return dominance.laplacian_regression(_customers(spark, sf_dir), ["a"], "y", [150.0], "id", linear=True).withColumn("fit", _round("fit", 5))


def _upper(z: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    poly = "0.0::DOUBLE"
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = f"(({poly} + {c}::DOUBLE) * {t})"
    upper = f"(exp(-{z} * {z} / 2) * {1 / math.sqrt(2 * math.pi)!r}::DOUBLE * {poly})"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {upper} ELSE {upper} END)"


@query(
    "WITH s AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) / 1000 AS s FROM orders), d AS (SELECT *, (ln(s / 150.0::DOUBLE) + 0.07::DOUBLE) / 0.2::DOUBLE AS d1 FROM s), e AS (SELECT *, d1 - 0.2::DOUBLE AS d2, -d1 AS m1, 0.2::DOUBLE - d1 AS m2 FROM d) "
    f"SELECT id, round(s * {_upper('d1')} - 150.0::DOUBLE * exp(-0.05::DOUBLE) * {_upper('d2')}, 5) AS call, round(150.0::DOUBLE * exp(-0.05::DOUBLE) * {_upper('m2')} - s * {_upper('m1')}, 5) AS put FROM e"
)
def black_scholes_prices(spark, sf_dir):
    s = F.col("o_totalprice").cast("double") / 1000
    price = lambda call: _round(payoffs.black_scholes(s, 150.0, 0.05, 0.2, 1.0, call))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), price(True).alias("call"), price(False).alias("put"))


@query("SELECT o_orderkey AS id, round(1 - exp(-q) * (1 + q), 9) AS cdf, round(q * exp(-q) / 2, 9) AS pdf FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 200000 AS q FROM orders)")
def gamma_law(spark, sf_dir):
    law = branching.Gamma(2.0, 2.0)

    def run(batches):
        for b in batches:
            t = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(law.cdf(t)), pa.array(law.pdf(t))], names=["id", "cdf", "pdf"])

    d = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("double") / 100000).alias("t"))
    return d.mapInArrow(run, "id long, cdf double, pdf double").select("id", _round("cdf", 9).alias("cdf"), _round("pdf", 9).alias("pdf"))


_U0, _U1 = uniform_sql(7, "range", "{t}", 0), uniform_sql(7, "range", "{t}", 1)
_Z = f"sqrt(-2 * ln({_U0})) * cos(2 * pi() * {_U1})"


@query(f"""WITH z AS (SELECT range AS sim_id, {_Z.format(t=0)} AS z0, {_Z.format(t=1)} AS z1 FROM range(500))
SELECT sim_id, CAST(0 AS INTEGER) AS step, 1.0::DOUBLE AS s FROM z UNION ALL
SELECT sim_id, CAST(1 AS INTEGER), round(exp(0.015::DOUBLE + 0.2::DOUBLE * sqrt(0.5::DOUBLE) * z0), 9) FROM z UNION ALL
SELECT sim_id, CAST(2 AS INTEGER), round(exp(0.03::DOUBLE + 0.2::DOUBLE * sqrt(0.5::DOUBLE) * (z0 + z1)), 9) FROM z""")
def black_scholes_paths(spark, sf_dir):
    return paths.paths(spark, paths.BlackScholes(2, 1.0, 0.05, 7), 500).select("sim_id", "step", _round(F.col("x")[0], 9).alias("s"))


@query(f"""WITH z AS (SELECT range AS sim_id, {_Z.format(t=0)} AS z0, {_Z.format(t=1)} AS z1 FROM range(500)), v AS (SELECT *, 0.94::DOUBLE * sqrt((1 - exp(-0.29::DOUBLE)) / 0.58::DOUBLE) AS w, exp(-0.145::DOUBLE) AS k FROM z)
SELECT sim_id, round(w * z0, 9) AS x1, round(w * z0 * k + w * z1, 9) AS x2 FROM v""")
def mean_reverting_paths(spark, sf_dir):
    rows = paths.paths(spark, paths.MeanReverting(2, 1.0, 0.0, 7), 500)
    return rows.groupBy("sim_id").agg(*[_round(F.max(F.when(F.col("step") == k, F.col("x")[0])), 9).alias(f"x{k}") for k in (1, 2)])


@query(f"""WITH n AS (SELECT range AS sim_id, {uniform_sql(3, 'range', '0', 0)} AS u FROM range(800)) SELECT sim_id, CAST(CASE WHEN u < 0.2::DOUBLE THEN 0 WHEN u < 0.7::DOUBLE THEN 1 ELSE 2 END AS BIGINT) AS node FROM n""")
def tree_node_sampling(spark, sf_dir):
    tree = trees.Tree([np.zeros((1, 1)), np.zeros((3, 1))], [(np.zeros(3, int), np.arange(3), np.array([0.2, 0.5, 0.3]))], 1.0)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tree.walk(b.column(0).to_numpy(zero_copy_only=False), 3)[:, 1])], names=["sim_id", "node"])

    return spark.range(800).mapInArrow(run, "sim_id long, node long")


def _at_points(df, evaluate):
    """(id, value) of evaluate(x [row, d]) on rows (id, x array)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(evaluate(matrix_of(b.column(1))))], names=["id", "value"])

    return df.mapInArrow(run, "id long, value double").withColumn("value", _round("value", 6))


@query(f"""WITH {L_CTE}, k AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE, 3.0::DOUBLE), (1, 4.0, -2.0), (2, 9.0, 10.0), (3, 30.0, 0.5), (4, 45.0, 7.0)) v(i, z, f)),
s AS (SELECT a.z AS z0, b.z AS z1, a.f AS f0, b.f AS f1, a.i FROM k a JOIN k b ON b.i = a.i + 1)
SELECT id, round(CASE WHEN q <= 1 THEN 3.0 WHEN q >= 45 THEN 7.0 ELSE (SELECT f0 + (f1 - f0) * (q - z0) / (z1 - z0) FROM s WHERE q >= z0 AND q < z1) END, 6) AS value FROM l""")
def general_grid_interpolation(spark, sf_dir):
    grid, values = grids.general([[1.0, 4.0, 9.0, 30.0, 45.0]]), np.array([3.0, -2.0, 10.0, 0.5, 7.0])
    return _at_points(_lines(spark, sf_dir).select("id", F.array("q").alias("x")), lambda x: grid.interpolate(values, x))


@query(f"""WITH {L_CTE}, c AS (SELECT id, least(greatest(q, 0), 60) AS q, least(5, floor(least(greatest(q, 0), 60) / 10 + 1e-12)) AS k FROM l), t AS (SELECT id, k, 2 * (q - 10 * k) / 10 - 1 AS t FROM c),
f AS (SELECT id, t, sin(k) AS a, sin(k + 0.5) AS m, sin(k + 1) AS b FROM t) SELECT id, round(a * t * (t - 1) / 2 + m * (1 - t * t) + b * t * (t + 1) / 2, 6) AS value FROM f""")
def legendre_grid_interpolation(spark, sf_dir):
    grid = grids.LegendreGrid([0.0], [10.0], [6], [2])
    values = np.sin(grid.points[:, 0] / 10)
    return _at_points(_lines(spark, sf_dir).select("id", F.array("q").alias("x")), lambda x: grid.interpolate(values, x))


@query(f"""WITH {L_CTE}, c AS (SELECT id, least(greatest(q / 64, 0), 1) * 16 AS u FROM l), d AS (SELECT id, u, least(15, floor(u)) AS k FROM c)
SELECT id, round(exp(k / 16) + (exp((k + 1) / 16) - exp(k / 16)) * (u - k), 6) AS value FROM d""")
def sparse_grid_interpolation(spark, sf_dir):
    grid = grids.SparseGrid([0.0], [64.0], 4, [1.0])
    surplus = grid.hierarchize(np.exp(grid.points[:, 0] / 64))
    return _at_points(_lines(spark, sf_dir).select("id", F.array("q").alias("x")), lambda x: grid.evaluate(surplus, x))


@dataclass(frozen=True)
class _Series(paths.Simulator):
    """States that SQL can write too."""

    def dimension(self):
        return 1

    def start(self, ids):
        return (np.asarray(ids) * 37 % 1000 / 10.0)[:, None]

    def move(self, state, ids, step):
        return state * 0.5 + (np.asarray(ids) * 91 % 700 / 10.0)[:, None]


_SERIES = "x AS (SELECT range AS id, (range * 37 % 1000) / 10.0::DOUBLE AS x0, (range * 37 % 1000) / 10.0::DOUBLE * 0.5 + (range * 91 % 700) / 10.0::DOUBLE AS x1 FROM range(3000))"


@query(f"""WITH {_SERIES}, v AS (SELECT id, x0, x1, greatest(0, least(4, floor(x0 / 20))) AS cell, s FROM x, (SELECT unnest([0.0, 10.0, 20.0, 30.0])::DOUBLE AS s)),
e AS (SELECT *, avg(s * x1 - 0.02::DOUBLE * s * s) OVER (PARTITION BY cell, s) AS k FROM v),
w AS (SELECT a.id, a.s, a.k AS stay, a.x0, u.k AS more, d.k AS less FROM e a LEFT JOIN e u ON u.id = a.id AND u.s = a.s + 10 LEFT JOIN e d ON d.id = a.id AND d.s = a.s - 10)
SELECT id, CAST(s / 10 AS BIGINT) AS point, round(greatest(stay, coalesce(more - 10 * (x0 + 0.35::DOUBLE), -1e30), coalesce(less + 10 * (x0 - 0.35::DOUBLE), -1e30)), 5) AS value FROM w""")
def storage_transition(spark, sf_dir):
    series, grid = _Series(1, 1.0), grids.regular([0.0], [10.0], [3])
    plant = models.Storage(lambda x, step: x[:, 0], 0.0, 30.0, 10.0, 10.0)
    end = dp.final_values(spark, series, 3000, grid, lambda r, s, x: s[None, :, 0] * x - 0.02 * s[None, :, 0] ** 2)
    got = dp.transition(end, series, 0, regressors.SameSize([0.0], [20.0], [5], 0), plant, grid, grid)
    return got.select(F.col("sim_id").alias("id"), F.posexplode("v").alias("point", "value")).select("id", F.col("point").cast("long").alias("point"), _round("value").alias("value"))


@query(f"""WITH {_SERIES}, p AS (SELECT range AS i, range / 50.0::DOUBLE AS z, sin(range / 10.0) AS f FROM range(51)),
s AS (SELECT i, z, least(1.0::DOUBLE, (1 - z) / 0.03::DOUBLE) AS a, least(1.0::DOUBLE, z / 0.03::DOUBLE) AS b FROM p),
l AS (SELECT i, b / (a + b) AS w, (z + a * 0.03::DOUBLE) * 50 AS u FROM s UNION ALL SELECT i, a / (a + b), (z - b * 0.03::DOUBLE) * 50 FROM s),
c AS (SELECT i, w, u, greatest(0, least(49, floor(u + 1e-9))) AS k FROM l)
SELECT CAST(i AS BIGINT) AS point, round(sum(w * ((1 - (u - k)) * a.f + (u - k) * b.f)), 9) AS value FROM c JOIN (SELECT i AS k, f FROM p) a USING (k) JOIN (SELECT i - 1 AS k, f FROM p) b USING (k) GROUP BY i""")
def semi_lagrangian_step(spark, sf_dir):
    grid = grids.regular([0.0], [0.02], [50])

    class Diffusion(semilagrange.SLOptimizer):
        def optimize(self, x, expectation, t):
            return expectation(0, np.zeros_like(x), np.full((len(x), 1, 1), 0.3))[0][:, None], None

    values, _ = semilagrange.step(spark, grid, np.sin(np.arange(51) / 10.0)[None], Diffusion(), 0.0, 0.01)
    return spark.createDataFrame([(k, round(float(v), 9)) for k, v in enumerate(values[0])], "point long, value double")
