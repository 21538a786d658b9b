"""Optimal stopping by regression, backwards over the exercise dates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators.ranks import equal_mass
from halyard.operators.regression import fitted, local_linear
from halyard.session import cut


def stop_step(rows: DataFrame, x: str, cash: str, payoff, cells: int, tie: str, discount: float = 1.0) -> DataFrame:
    """One backward step: adds keep (expected discounted cash given x) and puts the better of both into ``cash``."""
    rows = rows.withColumn(cash, F.col(cash) * discount)
    celled = cut(equal_mass(rows, {x: cells}, tie), "cells")
    known = fitted(celled, local_linear(celled, [x], cash), [x]).withColumnRenamed("fit", "keep")
    now = payoff(F.col(x))
    return known.withColumn(cash, F.when((now > 0) & (now >= F.col("keep")), now).otherwise(F.col(cash)))


def american(paths: DataFrame, payoff, steps: int, rate: float, horizon: float, cells: int) -> float:
    """Price of a claim on paths (sim_id, s array of steps + 1 values) that may be exercised at steps 0 to ``steps``."""
    discount = math.exp(-rate * horizon / steps)
    rows = paths.withColumn("cash", payoff(F.col("s")[steps]))
    for step in range(steps - 1, 0, -1):
        at = rows.withColumn("x", F.col("s")[step])
        rows = cut(stop_step(at, "x", "cash", payoff, cells, "sim_id", discount).select("sim_id", "s", "cash"), "stop")
    row = rows.agg(F.avg("cash").alias("m"), F.first(payoff(F.col("s")[0])).alias("now")).first()
    return max(row["m"] * discount, row["now"])
