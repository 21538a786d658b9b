"""Lookups, neighbours, dominance, kernels and cuts on whole driver tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.operators import cuts, dominance, kernels, lookups
from halyard.plans.queries import L_CTE, _KD, _KQ, _lines, _round, _table, query


def _curve(spark, sf_dir):
    return _table(spark, sf_dir, "part").select((F.col("p_partkey") * 3.0).cast("double").alias("t"), F.col("p_retailprice").cast("double").alias("v"))


@query("""SELECT o.o_orderkey AS id, round(coalesce(k.v, (SELECT arg_min(CAST(p_retailprice AS DOUBLE), p_partkey) FROM part)), 6) AS v
FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS t FROM orders) o
ASOF LEFT JOIN (SELECT p_partkey * 3.0::DOUBLE AS t, CAST(p_retailprice AS DOUBLE) AS v FROM part) k ON o.t >= k.t""")
def step_function_value(spark, sf_dir):
    q = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("t"))
    return lookups.step_lookup(_curve(spark, sf_dir), q, "t", "id").select("id", _round("v", 6).alias("v"))


@query("""WITH k AS (SELECT p_partkey * 3.0::DOUBLE AS t, CAST(p_retailprice AS DOUBLE) AS v FROM part),
s AS (SELECT t, v, lead(t) OVER (ORDER BY t) AS e FROM k),
i AS (SELECT c_custkey AS id, 3.0 + c_nationkey AS a, 3.0 + c_nationkey * 1.5 + c_custkey AS b FROM customer)
SELECT id, round(sum(v * (least(b, coalesce(e, b)) - greatest(a, t))) / any_value(b - a), 4) AS mean
FROM i JOIN s ON t < b AND coalesce(e, b) > a GROUP BY id""")
def step_function_mean(spark, sf_dir):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    intervals = _table(spark, sf_dir, "customer").select(key.alias("id"), (nation + F.lit(3.0)).alias("a"), (nation * 1.5 + key + 3.0).alias("b"))
    return lookups.step_mean(_curve(spark, sf_dir), intervals, "t", "v", "a", "b", "id").withColumn("mean", _round("mean", 4))


@query("""SELECT id, nearest, round(dist2, 6) AS dist2 FROM (
SELECT c_custkey AS id, s_suppkey AS nearest, d AS dist2, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS rk FROM (
SELECT c_custkey, s_suppkey, (a - x) * (a - x) + (b - y) * (b - y) AS d FROM
(SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS a, CAST(c_acctbal AS DOUBLE) / 500 AS b FROM customer),
(SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS x, CAST(s_acctbal AS DOUBLE) / 500 AS y FROM supplier))) WHERE rk = 1""")
def nearest_neighbour(spark, sf_dir):
    place = lambda name, p, key: _table(spark, sf_dir, name).select(F.col(key), F.col(f"{p}_nationkey").cast("double").alias("x"), (F.col(f"{p}_acctbal").cast("double") / 500).alias("y"))
    found = lookups.nearest(place("customer", "c", "c_custkey"), place("supplier", "s", "s_suppkey"), ["x", "y"], "c_custkey", "s_suppkey")
    return found.select(F.col("c_custkey").alias("id"), "nearest", _round("dist2", 6).alias("dist2"))


@query("""WITH c AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x, c_nationkey AS y FROM customer), o AS (SELECT unnest(range(0, 4)) AS orthant)
SELECT a.id, CAST(o.orthant AS INTEGER) AS orthant, CAST(coalesce(sum(b.id), 0) AS BIGINT) AS s
FROM c a CROSS JOIN o LEFT JOIN c b ON (CASE WHEN o.orthant % 2 = 1 THEN b.x > a.x ELSE b.x < a.x END) AND (CASE WHEN o.orthant >= 2 THEN b.y > a.y ELSE b.y < a.y END)
GROUP BY a.id, o.orthant""")
def dominance_sums(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("w"), F.col("c_acctbal").cast("double").alias("x"), F.col("c_nationkey").alias("y"))
    return dominance.all_orthants(d, "x", "y", "w", "id")


@query(f"""WITH {L_CTE}, kq AS (SELECT * FROM (VALUES (0, 5.0), (1, 10.0), (2, 20.0), (3, 35.0), (4, 50.0)) v(k0, zq)),
kd AS (SELECT * FROM (VALUES (0, 0.015), (1, 0.035), (2, 0.065), (3, 0.095)) v(k1, zd)),
w AS (SELECT k0, k1, y, exp(-abs(q - zq::DOUBLE) / 5.0::DOUBLE) * exp(-abs(d - zd::DOUBLE) / 0.02::DOUBLE) AS w FROM kq, kd, l)
SELECT k0, k1, round(sum(w), 4) AS weight, round(sum(w * y) / sum(w), 5) AS fit FROM w GROUP BY k0, k1""")
def laplacian_kernel_on_grid(spark, sf_dir):
    fit = kernels.laplacian_on_grid(_lines(spark, sf_dir), {"q": _KQ, "d": _KD}, "y", [5.0, 0.02])
    return fit.withColumn("weight", _round("weight", 4)).withColumn("fit", _round("fit"))


@query("""WITH c AS (SELECT s_nationkey AS mesh, s_suppkey % 17 / 10.0::DOUBLE AS v, s_suppkey * 0.01::DOUBLE AS s, CAST(s_acctbal AS DOUBLE) / 10 AS a FROM supplier)
SELECT c_custkey AS id, round(max(v - s * a + s * (CAST(c_acctbal AS DOUBLE) / 10)), 5) AS value FROM customer LEFT JOIN (SELECT * FROM c WHERE a BETWEEN 100.0 AND 700.0) k ON mesh = c_nationkey GROUP BY c_custkey""")
def boxed_cuts_at_particles(spark, sf_dir):
    planes = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("mesh"), (F.col("s_suppkey") % 17 / 10.0).alias("v"), (F.col("s_suppkey") * 0.01).alias("s"), (F.col("s_acctbal").cast("double") / 10).alias("a"))
    planes = cuts.in_box(planes.withColumn("a0", cuts.intercept(F.col("v"), [F.col("s")], [F.col("a")])), {"a": (100.0, 700.0)})
    particles = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("mesh"), (F.col("c_acctbal").cast("double") / 10).alias("x"))
    return cuts.upper_envelope(particles, planes, "mesh", ["x"], ["s"], "id").withColumn("value", _round("value"))


@query("""WITH c AS (SELECT s_nationkey AS mesh, CAST(s_acctbal AS DOUBLE) / 1000 AS v, s_suppkey * 0.01::DOUBLE AS s, CAST(s_suppkey AS DOUBLE) AS a FROM supplier)
SELECT c_custkey AS id, round(max(v - s * a + s * (CAST(c_acctbal AS DOUBLE) / 10)), 5) AS value FROM customer JOIN c ON mesh = c_nationkey
GROUP BY 1""")
def all_cuts_at_particles(spark, sf_dir):
    key = F.col("s_suppkey").cast("double")
    planes = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cut"), F.col("s_nationkey").alias("mesh"), (F.col("s_acctbal").cast("double") / 1000).alias("v"), (key * 0.01).alias("s"), key.alias("a"))
    planes = planes.withColumn("a0", cuts.intercept(F.col("v"), [F.col("s")], [F.col("a")]))
    particles = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("mesh"), (F.col("c_acctbal").cast("double") / 10).alias("x"))
    return cuts.envelope_at(particles, planes, "mesh", "x", "s", "id", "cut").withColumn("value", _round("value"))


@query("""SELECT c_nationkey AS mesh, min(CAST(c_acctbal AS DOUBLE)) AS x FROM customer GROUP BY c_nationkey, floor(CAST(c_acctbal AS DOUBLE) / 250.0 + 0.5)""")
def distinct_states(spark, sf_dir):
    states = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("mesh"), F.col("c_acctbal").cast("double").alias("x"))
    return cuts.distinct_states(states, ["mesh"], ["x"], 250.0)
