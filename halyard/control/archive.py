"""Archives: what a backward pass leaves for a forward one, as Parquet by kind and step.

Arrays are stored flat with their shape, objects (grids, regressors, trees of
cuts) as bytes; a table is appended to, a record never rewritten, and a reader
prunes by kind and step.  ``one_file`` writes a record as a single file.
"""

from __future__ import annotations

import io
import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.session import scratch

SCHEMA = "kind string, step int, part int, shape array<int>, value array<double>, object binary"
#: Numbers of an array that one row holds
ROW_NUMBERS = 1 << 20


class Archive:
    def __init__(self, spark: SparkSession, path: str | None = None, one_file: bool = False):
        self.spark, self.path, self.one_file = spark, path or scratch(spark, "archive"), one_file

    def put(self, kind: str, step: int, *, array: np.ndarray | None = None, thing=None) -> None:
        """Appends an array (continuation, Bellman values, controls, cuts, states) or an object."""
        rows = []
        if array is not None:
            flat, shape = np.ascontiguousarray(array, float).ravel(), [int(n) for n in array.shape]
            for k in range(max(1, -(-len(flat) // ROW_NUMBERS))):
                rows.append((kind, step, k, shape, flat[k * ROW_NUMBERS : (k + 1) * ROW_NUMBERS].tolist(), None))
        if thing is not None:
            rows.append((kind, step, -1, None, None, bytearray(pickle.dumps(thing))))
        df = self.spark.createDataFrame(rows, SCHEMA)
        (df.coalesce(1) if self.one_file else df).write.mode("append").partitionBy("kind", "step").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def _rows(self, kind: str, step: int) -> DataFrame:
        return self.table().where((F.col("kind") == kind) & (F.col("step") == step))

    def array(self, kind: str, step: int) -> np.ndarray:
        rows = self._rows(kind, step).where("part >= 0").orderBy("part").collect()
        return np.concatenate([np.array(r["value"], float) for r in rows]).reshape(rows[0]["shape"])

    def thing(self, kind: str, step: int):
        """An object this library wrote; read archives of your own only, as unpickling runs code."""
        return pickle.load(io.BytesIO(self._rows(kind, step).where("part = -1").first()["object"]))

    def steps(self, kind: str) -> list[int]:
        return sorted(r["step"] for r in self.table().where(F.col("kind") == kind).select("step").distinct().collect())


def text_plot(df: DataFrame, path: str) -> None:
    """Columns as white-space-separated text, for plotting programs."""
    df.write.csv(path, sep=" ")
