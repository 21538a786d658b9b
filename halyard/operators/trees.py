"""Scenario trees as edge tables (step, src, dst, prob)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(src, value): the expectation of (node, value) one step on, given the node src."""
    joined = edges.join(values, F.col("dst") == F.col("node"))
    return joined.groupBy("src").agg(F.sum(F.col("prob") * F.col("value")).alias("value"))
