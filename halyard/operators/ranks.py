"""Global ranks, prefix sums and equal-mass cells without a one-task window.

Rows are dealt into value ranges, sorted and numbered inside their range by the
task that writes them: one shuffle.  The ranges' totals, one row each, carry the
numbers on; nothing but that list of totals is ever in one task.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.session import cut


def _running(schema, value: str):
    """Adds upto, the sum of a column so far in this task, to sorted rows."""
    names = [f.name for f in schema] + ["upto"]
    kind = pa.int64() if isinstance(schema[value].dataType, (T.IntegralType,)) else pa.float64()

    def run(batches):
        before = pa.scalar(0, kind)
        for batch in batches:
            if batch.num_rows:
                sums = pc.add(pc.cumulative_sum(pc.fill_null(batch.column(names.index(value)).cast(kind), pa.scalar(0, kind))), before)
                before = sums[-1]
                yield pa.RecordBatch.from_arrays([*batch.columns, sums], names=names)

    return run, T.StructType([*schema.fields, T.StructField("upto", T.LongType() if kind == pa.int64() else T.DoubleType())])


def with_rank(df: DataFrame, order: list[str], within: list[str] = (), value: str | None = None) -> DataFrame:
    """Adds rank0 (from 0), n_rows and, for a ``value`` column, prefix (sum up to and with the row).

    Ranks run inside each combination of the ``within`` columns, in ascending
    order of the ``order`` columns, nulls first; name an id last to break ties.
    Null values add nothing.  An empty table gives an empty result.
    """
    within = list(within)
    dealt = df.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    dealt = dealt.withColumn("part_no", F.spark_partition_id()).withColumn("in_part", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    if value:
        run, schema = _running(dealt.schema, value)
        dealt = dealt.mapInArrow(run, schema)
    dealt = cut(dealt, "ranges")
    worth = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    start = F.min_by(F.col("upto") - worth, "in_part") if value else F.lit(0)
    totals = dealt.groupBy(*within, "part_no").agg(F.count("*").alias("part_rows"), F.sum(worth).alias("part_sum"), F.min("in_part").alias("part_first"), start.alias("part_start"))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = group.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(c).alias(f"t_{c}") for c in within],
        F.col("part_no").alias("t_part"),
        (F.coalesce(F.sum("part_rows").over(before), F.lit(0)) - F.col("part_first")).alias("rows_before"),
        (F.coalesce(F.sum("part_sum").over(before), F.lit(0)) - F.col("part_start")).alias("sum_before"),
        F.sum("part_rows").over(group).alias("n_rows"),
    )
    match = F.col("part_no") == F.col("t_part")
    for c in within:
        match = match & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    rows = dealt.join(totals, match).withColumn("rank0", F.col("rows_before") + F.col("in_part"))
    if value:
        rows = rows.withColumn("prefix", F.col("sum_before") + F.col("upto"))
    return rows.drop("part_no", "in_part", "upto", "rows_before", "sum_before", *[f"t_{c}" for c in ["part", *within]])


def equal_mass(df: DataFrame, meshes: dict[str, int], tie: str) -> DataFrame:
    """Adds cell: nested buckets of equal counts, the last coordinate split first.

    The first n % k of k buckets hold one row more.  ``cell`` numbers the buckets
    with the first coordinate running fastest.
    """
    within: list[str] = []
    for dim, (x, k) in reversed(list(enumerate(meshes.items()))):
        df = with_rank(df, [x, tie], within)
        q, r = F.expr(f"n_rows div {k}"), F.col("n_rows") % k
        head = r * (q + 1)
        bucket = F.when(F.col("rank0") < head, F.expr(f"rank0 div (n_rows div {k} + 1)")).otherwise(r + F.floor((F.col("rank0") - head) / F.greatest(q, F.lit(1))))
        df = df.withColumn(f"cell_{dim}", bucket.cast("int")).drop("rank0", "n_rows")
        within.append(f"cell_{dim}")
    cell, wide = F.lit(0), 1
    for dim, k in enumerate(meshes.values()):
        cell, wide = cell + F.col(f"cell_{dim}") * wide, wide * k
    return df.withColumn("cell", cell.cast("int")).drop(*within)


def equal_width(x, low: float, step: float, n: int):
    """Bucket of equal width, values outside clamped to the outer ones."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - low) / step))).cast("int")
