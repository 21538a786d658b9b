"""As-of lookups on step functions, means over intervals, nearest neighbours."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators.ranks import with_rank
from halyard.session import cut

#: Centres that one pass of nearest() sends to the tasks
CENTRES_PER_PASS = 1 << 20


def step_lookup(knots: DataFrame, queries: DataFrame, t: str, key: str) -> DataFrame:
    """Adds to queries the other columns of the last knot at or before ``t``, or of the first knot.

    Knots have distinct ``t`` and queries distinct keys.  Both sides are ranked together; the number of
    knots up to a row is then an equi-join key, so no range join is needed.
    Queries with a null ``t`` fall before every knot.
    """
    carried = [c for c in knots.columns if c != t]
    k = knots.select(F.lit(1).alias("is_knot"), F.col(t).cast("double").alias("at"), F.lit(None).cast(queries.schema[key].dataType).alias("of"))
    q = queries.select(F.lit(0).alias("is_knot"), F.col(t).cast("double").alias("at"), F.col(key).alias("of"))
    order = k.unionByName(q).withColumn("after", 1 - F.col("is_knot"))
    placed = cut(with_rank(order, ["at", "after", "of"], value="is_knot").select("is_knot", "at", "of", "prefix"), "placed")
    numbered = placed.where("is_knot = 1").select("at", F.col("prefix").alias("no"))
    table = numbered.join(knots.select(F.col(t).cast("double").alias("at"), *carried), "at").drop("at")
    found = placed.where("is_knot = 0").select(F.col("of").alias(key), F.greatest("prefix", F.lit(1)).alias("no"))
    return queries.join(found, key).join(table, "no", "left").drop("no")


def with_integral(knots: DataFrame, t: str, value: str) -> DataFrame:
    """Adds integral: that of the step function from the first knot to this one."""
    ranked = cut(with_rank(knots, [t]), "knots")
    after = ranked.select((F.col("rank0") - 1).alias("rank0"), F.col(t).alias("until"))
    sized = ranked.drop("n_rows").join(after, "rank0", "left").withColumn("area", F.coalesce(F.col(value) * (F.col("until") - F.col(t)), F.lit(0.0)))
    summed = with_rank(sized.drop("rank0", "until"), [t], value="area")
    return summed.withColumn("integral", F.col("prefix") - F.col("area")).drop("area", "prefix", "rank0", "n_rows")


def step_mean(knots: DataFrame, intervals: DataFrame, t: str, value: str, low: str, high: str, key: str) -> DataFrame:
    """(key, mean): the step function's mean over [low, high]; at low = high its value there."""
    area = cut(with_integral(knots, t, value).withColumn("start", F.col(t)), "integral")
    ends = []
    for name, column in (("a", low), ("b", high)):
        got = step_lookup(area, intervals.select(key, F.col(column).alias(t)), t, key)
        ends.append(got.select(key, F.col(t).alias(name), F.col(value).alias(f"v_{name}"), (F.col("integral") + F.col(value) * (F.col(t) - F.col("start"))).alias(f"i_{name}")))
    both = ends[0].join(ends[1], key)
    return both.select(key, F.when(F.col("b") > F.col("a"), (F.col("i_b") - F.col("i_a")) / (F.col("b") - F.col("a"))).otherwise(F.col("v_a")).alias("mean"))


class KDTree:
    """Nearest centres of whole batches: a subtree is visited by the points for which it may hold a nearer centre."""

    LEAF = 16

    def __init__(self, ids: np.ndarray, places: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.places = ids[order], places[order]
        self.root = self._build(np.arange(len(ids)))

    def _build(self, own: np.ndarray):
        if len(own) <= self.LEAF:
            return np.sort(own)
        spread = self.places[own].max(0) - self.places[own].min(0)
        axis = int(spread.argmax())
        if not spread[axis] > 0:
            return np.sort(own)
        order = own[np.argsort(self.places[own, axis], kind="stable")]
        middle = len(order) // 2
        return axis, float(self.places[order[middle], axis]), self._build(order[:middle]), self._build(order[middle:])

    def query(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ids, squared distance): ties go to the lowest id."""
        best, found = np.full(len(x), np.inf), np.full(len(x), len(self.ids))
        todo = [(self.root, np.arange(len(x)), np.zeros(len(x)))]
        while todo:
            node, rows, gap = todo.pop()
            keep = gap <= best[rows]
            rows = rows[keep]
            if not len(rows):
                continue
            if isinstance(node, np.ndarray):
                d = np.zeros((len(rows), len(node)))
                for k in range(x.shape[1]):
                    d += (x[rows, k : k + 1] - self.places[node, k]) ** 2
                at = d.argmin(1)
                near, which = d[np.arange(len(rows)), at], node[at]
                better = (near < best[rows]) | ((near == best[rows]) & (which < found[rows]))
                best[rows[better]], found[rows[better]] = near[better], which[better]
                continue
            axis, at, low, high = node
            side = x[rows, axis] - at
            for child, own in ((high, side < 0), (low, side >= 0)):
                todo.append((child, rows[own], side[own] ** 2))
            for child, own in ((low, side < 0), (high, side >= 0)):
                todo.append((child, rows[own], gap[keep][own] * 0))
        return found, best


def nearest(points: DataFrame, centres: DataFrame, xs: list[str], key: str, centre: str, per_pass: int = CENTRES_PER_PASS) -> DataFrame:
    """(key, nearest, dist2): the centre at the least squared distance, ties to the lowest id.

    A row for each row of points, repeated keys included; a null coordinate, or a
    table without centres, gives nulls; centres with a null are left out.  Trees
    of at most ``per_pass`` centres go to the tasks; with more centres rows are
    numbered, each pass keeps one candidate for each, and the best one stays.
    """
    kind = centres.schema[centre].dataType
    held = centres.select(F.col(centre).cast("long").alias("c_id"), *[F.col(x).cast("double").alias(x) for x in xs]).dropna()
    total = held.count()
    rows = points.select(F.col(key).alias("p_key"), *[F.col(x).cast("double").alias(f"p{k}") for k, x in enumerate(xs)])
    key_kind = points.schema[key].dataType.simpleString()

    def found(rows, part, extra: str):
        got = part.toArrow()  # per_pass rows at most
        tree = rows.sparkSession.sparkContext.broadcast(KDTree(got["c_id"].to_numpy(), np.stack([got[x].to_numpy() for x in xs], 1)))
        n = len(xs)

        def run(batches):
            for batch in batches:
                x = np.stack([batch.column(batch.num_columns - n + k).to_numpy(zero_copy_only=False) for k in range(n)], 1).astype(float)
                ok = ~np.isnan(x).any(1)
                at, dist = np.zeros(len(x), np.int64), np.full(len(x), np.nan)
                at[ok], dist[ok] = tree.value.query(x[ok])
                lead = [batch.column(k) for k in range(batch.num_columns - n)]
                yield pa.RecordBatch.from_arrays([*lead, pa.array(tree.value.ids[at], mask=~ok), pa.array(dist, mask=~ok)], names=[*batch.schema.names[:-n], "nearest", "dist2"])

        return rows.mapInArrow(run, f"{extra}p_key {key_kind}, nearest long, dist2 double")

    if not total:
        return points.select(key, F.lit(None).cast(kind).alias("nearest"), F.lit(None).cast("double").alias("dist2"))
    if total <= per_pass:
        out = found(rows, held, "")
    else:
        numbered = cut(rows.select(F.monotonically_increasing_id().alias("row_no"), "*"), "points")
        ranked = cut(with_rank(held, ["c_id"]), "centres")
        parts = [found(numbered, ranked.where(F.col("rank0").between(k * per_pass, (k + 1) * per_pass - 1)).select("c_id", *xs), "row_no long, ") for k in range(-(-total // per_pass))]
        both = functools.reduce(DataFrame.unionByName, parts)
        best = both.groupBy("row_no").agg(F.first("p_key").alias("p_key"), F.min(F.when(F.col("nearest").isNotNull(), F.struct("dist2", "nearest"))).alias("b"))
        out = best.select("p_key", "b.nearest", "b.dist2")
    return out.select(F.col("p_key").alias(key), F.col("nearest").cast(kind).alias("nearest"), "dist2")
