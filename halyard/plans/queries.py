"""Each operator on whole driver tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import payoffs, polynomials
from halyard.operators import cdf, grids, ranks, regression, stopping, trees

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, sf_dir) -> DataFrame:
    d = _table(spark, sf_dir, "orders")
    return d.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("x"), (F.col("o_totalprice").cast("double") / 1000).alias("y"))


def _lines(spark, sf_dir) -> DataFrame:
    d = _table(spark, sf_dir, "lineitem")
    return d.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("t"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))


def _round(c, n=5):
    return F.round(c, n)


O_CTE = "o AS (SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS x, CAST(o_totalprice AS DOUBLE) / 1000 AS y FROM orders)"
L_CTE = "l AS (SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t, CAST(l_extendedprice AS DOUBLE) / 1000 AS y FROM lineitem)"


@query(f"WITH {O_CTE} SELECT id, CAST(ntile(7) OVER (ORDER BY x, id) - 1 AS INTEGER) AS cell FROM o")
def equal_mass_cells(spark, sf_dir):
    return ranks.equal_mass(_orders(spark, sf_dir), {"x": 7}, "id").select("id", "cell")


@query(f"""WITH {O_CTE}, a AS (SELECT *, ntile(5) OVER (ORDER BY y, id) - 1 AS c1 FROM o)
SELECT id, CAST(ntile(4) OVER (PARTITION BY c1 ORDER BY x, id) - 1 + 4 * c1 AS INTEGER) AS cell FROM a""")
def equal_mass_cells_2d(spark, sf_dir):
    return ranks.equal_mass(_orders(spark, sf_dir), {"x": 4, "y": 5}, "id").select("id", "cell")


@query(f"""WITH {O_CTE}, a AS (SELECT *, CAST(ntile(5) OVER (ORDER BY y, id) - 1 AS INTEGER) AS cell FROM o)
SELECT cell, count(*) AS n, min(y) AS low, max(y) AS high FROM a GROUP BY cell""")
def cell_bounds(spark, sf_dir):
    d = ranks.equal_mass(_orders(spark, sf_dir), {"y": 5}, "id")
    return d.groupBy("cell").agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))


@query(f"WITH {O_CTE}, a AS (SELECT *, CAST(ntile(16) OVER (ORDER BY x, id) - 1 AS INTEGER) AS cell FROM o) SELECT cell, count(y) AS n, round(avg(y), 5) AS fit FROM a GROUP BY cell")
def local_constant(spark, sf_dir):
    return regression.local_constant(ranks.equal_mass(_orders(spark, sf_dir), {"x": 16}, "id"), "y").withColumn("fit", _round("fit"))


@query(f"""WITH {O_CTE}, a AS (SELECT *, ntile(16) OVER (ORDER BY x, id) AS cell FROM o),
b AS (SELECT cell, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM a GROUP BY cell)
SELECT id, round(b.a + b.b * x, 5) AS fit FROM a JOIN b USING (cell)""")
def local_linear(spark, sf_dir):
    d = ranks.equal_mass(_orders(spark, sf_dir), {"x": 16}, "id")
    return regression.fitted(d, regression.local_linear(d, ["x"], "y"), ["x"]).select("id", _round("fit").alias("fit"))


@query(f"WITH {L_CTE} SELECT CAST(greatest(0, least(9, floor((q - 1.0) / 5.0))) AS INTEGER) AS cell, count(y) AS n, round(avg(y), 5) AS fit FROM l GROUP BY 1")
def same_size_constant(spark, sf_dir):
    return regression.local_constant(_lines(spark, sf_dir).withColumn("cell", ranks.equal_width(F.col("q"), 1.0, 5.0, 10)), "y").withColumn("fit", _round("fit"))


@query(f"""WITH {L_CTE} SELECT CAST(greatest(0, least(9, floor((q - 1.0) / 5.0))) AS INTEGER) AS cell, count(*) AS n,
round(regr_intercept(y, q), 5) AS a, round(regr_slope(y, q), 5) AS b FROM l GROUP BY 1""")
def same_size_linear(spark, sf_dir):
    d = _lines(spark, sf_dir).withColumn("cell", ranks.equal_width(F.col("q"), 1.0, 5.0, 10))
    return regression.local_linear(d, ["q"], "y").select("cell", "n", _round(F.col("coef")[0]).alias("a"), _round(F.col("coef")[1]).alias("b"))


@query(f"""WITH {L_CTE}, m AS (SELECT CAST(floor(t * 100 + 0.5) AS INTEGER) AS cell, count(*) AS n, avg(q) AS mq, avg(d) AS md, avg(y) AS my, covar_pop(q, q) AS qq, covar_pop(d, d) AS dd,
covar_pop(q, d) AS qd, covar_pop(q, y) AS qy, covar_pop(d, y) AS dy FROM l GROUP BY 1),
c AS (SELECT *, (qy * dd - dy * qd) / (qq * dd - qd * qd) AS b1, (dy * qq - qy * qd) / (qq * dd - qd * qd) AS b2 FROM m)
SELECT cell, n, round(my - b1 * mq - b2 * md, 5) AS b0, round(b1, 5) AS b1, round(b2, 5) AS b2 FROM c""")
def discrete_last_dimension(spark, sf_dir):
    d = _lines(spark, sf_dir).withColumn("cell", F.floor(F.col("t") * 100 + 0.5).cast("int"))
    fit = regression.local_linear(d, ["q", "d"], "y")
    return fit.select("cell", "n", *[_round(F.col("coef")[k]).alias(f"b{k}") for k in range(3)])


def _global(family):
    def run(spark, sf_dir):
        d = _orders(spark, sf_dir)
        ends = d.agg(F.min("x"), F.max("x")).first()
        d = d.withColumn("u", (2 * F.col("x") - ends[0] - ends[1]) / (ends[1] - ends[0]))
        coefs = regression.global_fit(d, ["u"], "y", family, 2)
        return d.select("id", _round(regression.global_value(coefs, ["u"], family), 4).alias("fit"))

    return run


_GLOBAL_SQL = f"""WITH {O_CTE}, e AS (SELECT min(x) AS lo, max(x) AS hi FROM o), a AS (SELECT id, y, (2 * x - lo - hi) / (hi - lo) AS u FROM o, e),
m AS (SELECT avg(u) AS m1, avg(u*u) AS m2, avg(y) AS my, covar_pop(u, u) AS a11, covar_pop(u*u, u*u) AS a22, covar_pop(u, u*u) AS a12, covar_pop(u, y) AS r1, covar_pop(u*u, y) AS r2 FROM a),
c AS (SELECT *, (r1 * a22 - r2 * a12) / (a11 * a22 - a12 * a12) AS b1, (r2 * a11 - r1 * a12) / (a11 * a22 - a12 * a12) AS b2 FROM m)
SELECT id, round(my - b1 * m1 - b2 * m2 + b1 * u + b2 * u * u, 4) AS fit FROM a, c"""
for _family in ("canonical", "hermite", "tchebychev"):
    QUERIES[f"global_{_family}"], ORACLE_SQL[f"global_{_family}"] = _global(_family), _GLOBAL_SQL


@query("SELECT o_orderkey AS id, round(u*u*u - 3*u, 6) AS h3, round(3*u*u - 3, 6) AS dh3, round(4*u*u*u - 3*u, 6) AS t3, round((5*u*u*u - 3*u) / 2, 6) AS p3, round(6*u, 6) AS d2c3 FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 100000 AS u FROM orders)")
def polynomial_values(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("double") / 100000).alias("u"))
    p = lambda f, n, k=0: _round(polynomials.basis(f, n, F.col("u"), k), 6)
    return d.select("id", p("hermite", 3).alias("h3"), p("hermite", 3, 1).alias("dh3"), p("tchebychev", 3).alias("t3"), p("legendre", 3).alias("p3"), p("canonical", 3, 2).alias("d2c3"))


@query("""SELECT o_orderkey AS id, round(greatest(0, 1 - abs(t)), 9) AS hat, round(CASE WHEN abs(t) < 1 THEN 1 - t*t ELSE 0 END, 9) AS quad,
round(CASE WHEN abs(t) < 1 THEN (t*t - 1) * (t - 3) / 3 ELSE 0 END, 9) AS cubic_left, round(CASE WHEN abs(t) < 1 THEN (1 - t*t) * (t + 3) / 3 ELSE 0 END, 9) AS cubic_right
FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 100000 - 2 AS t FROM orders)""")
def hierarchical_bases(spark, sf_dir):
    t = F.col("o_totalprice").cast("double") / 100000 - 2
    d = _table(spark, sf_dir, "orders")
    return d.select(F.col("o_orderkey").alias("id"), _round(polynomials.hat(t), 9).alias("hat"), _round(polynomials.quadratic(t), 9).alias("quad"), _round(polynomials.cubic(t, True), 9).alias("cubic_left"), _round(polynomials.cubic(t, False), 9).alias("cubic_right"))


@query("""SELECT l_orderkey * 8 + l_linenumber AS id, round(greatest(0, (q + 40) / 2 - 30), 6) AS call, round(greatest(0, 30 - (q + 40) / 2), 6) AS put, round(1 - exp(-0.1 * q), 6) AS cdf
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q FROM lineitem)""")
def payoff_values(spark, sf_dir):
    assets = F.array(F.col("q"), F.lit(40.0))
    return _lines(spark, sf_dir).select("id", _round(payoffs.basket_call(assets, 30.0), 6).alias("call"), _round(payoffs.basket_put(assets, 30.0), 6).alias("put"), _round(payoffs.exponential_cdf(F.col("q"), 0.1), 6).alias("cdf"))


_KQ, _KD = [5.0, 10.0, 20.0, 35.0, 50.0], [0.015, 0.035, 0.065, 0.095]


@query(f"""WITH {L_CTE}, n AS (SELECT count(*) AS n FROM l), kq AS (SELECT * FROM (VALUES (0, 5.0), (1, 10.0), (2, 20.0), (3, 35.0), (4, 50.0)) v(k0, zq)),
kd AS (SELECT * FROM (VALUES (0, 0.015), (1, 0.035), (2, 0.065), (3, 0.095)) v(k1, zd))
SELECT k0, k1, round(coalesce(sum(l.y), 0) / any_value(n.n), 5) AS f FROM kq CROSS JOIN kd CROSS JOIN n LEFT JOIN l ON l.q <= zq AND l.d <= zd GROUP BY k0, k1""")
def cdf_on_grid(spark, sf_dir):
    return cdf.cdf_on_grid(_lines(spark, sf_dir), {"q": _KQ, "d": _KD}, "y").withColumn("f", _round("f"))


@query("""SELECT o_orderkey AS id, CAST(sum(CAST(round(CAST(o_totalprice AS DOUBLE) * 100) AS BIGINT)) OVER (ORDER BY o_custkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) OVER () AS f FROM orders""")
def cdf_on_sample(spark, sf_dir):
    cents = _orders(spark, sf_dir).withColumn("y", F.round(F.col("y") * 100_000).cast("long"))
    return cdf.cdf_on_sample(cents, "x", "y", "id").select("id", "f")


@query(f"""WITH {L_CTE}, v AS (SELECT i, j, (1 + i) * (2.0 + j * j) AS v FROM range(0, 11) a(i), range(0, 6) b(j)),
p AS (SELECT id, least(greatest(q, 0.0), 50.0) / 5.0 AS a, least(greatest(d, 0.0), 0.1) / 0.02 AS b FROM l),
c AS (SELECT *, greatest(0, least(9, floor(a + 1e-12))) AS i, greatest(0, least(4, floor(b + 1e-12))) AS j, row_number() OVER () AS r FROM p),
s AS (SELECT r, id, c.i + e.i AS i, c.j + f.j AS j, (CASE WHEN e.i = 1 THEN a - c.i ELSE 1 - a + c.i END) * (CASE WHEN f.j = 1 THEN b - c.j ELSE 1 - b + c.j END) AS w FROM c, range(0, 2) e(i), range(0, 2) f(j))
SELECT any_value(id) AS id, round(sum(w * v), 6) AS value FROM s JOIN v ON v.i = s.i AND v.j = s.j GROUP BY r""")
def grid_interpolation(spark, sf_dir):
    grid = grids.RegularGrid((0.0, 0.0), (5.0, 0.02), (10, 5))
    i, j = F.expr("id % 11"), F.expr("id div 11")
    values = spark.range(66).select(F.col("id").alias("point_id"), ((1 + i) * (2.0 + j * j)).alias("value"))
    return grid.interpolate(values, _lines(spark, sf_dir), ["q", "d"], "id").withColumn("value", _round("value", 6))


@query("""WITH e AS (SELECT n_regionkey AS src, c_nationkey AS dst, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
p AS (SELECT src, dst, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY src) AS prob FROM e),
v AS (SELECT c_nationkey AS node, avg(CAST(c_acctbal AS DOUBLE)) AS value FROM customer GROUP BY 1)
SELECT src, round(sum(prob * value), 4) AS value FROM p JOIN v ON dst = node GROUP BY src""")
def tree_expectation(spark, sf_dir):
    from pyspark.sql import Window

    customer, nation = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    counts = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    edges = counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("src")))
    values = customer.groupBy(F.col("c_nationkey").alias("node")).agg(F.avg(F.col("c_acctbal").cast("double")).alias("value"))
    return trees.expected(edges, values).withColumn("value", _round("value", 4))


@query(f"""WITH {O_CTE}, a AS (SELECT *, ntile(8) OVER (ORDER BY x, id) AS cell FROM o),
b AS (SELECT cell, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM a GROUP BY cell),
k AS (SELECT id, x, y, b.a + b.b * x AS keep, greatest(200.0 - x / 10, 0.0) AS now FROM a JOIN b USING (cell))
SELECT id, round(keep, 4) AS keep, round(CASE WHEN now > 0 AND now >= keep THEN now ELSE y END, 6) AS cash FROM k""")
def stopping_step_linear(spark, sf_dir):
    d = _orders(spark, sf_dir)
    payoff = lambda x: F.greatest(200.0 - x / 10, F.lit(0.0))
    return stopping.stop_step(d, "x", "y", payoff, 8, "id").select("id", _round("keep", 4).alias("keep"), _round("y", 6).alias("cash"))


@query("SELECT count(*) AS n, round(avg(v), 4) AS mean, round(sqrt((avg(v * v) - avg(v) * avg(v)) / count(*)), 4) AS std_error FROM (SELECT CAST(o_totalprice AS DOUBLE) / 1000 AS v FROM orders)")
def monte_carlo_mean(spark, sf_dir):
    return _orders(spark, sf_dir).agg(F.count("y").alias("n"), _round(F.avg("y"), 4).alias("mean"), _round(F.stddev_pop("y") / F.sqrt(F.count("y")), 4).alias("std_error"))


__all__ = ["QUERIES", "ORACLE_SQL"]
