"""Session helpers: where shared scratch data goes and how lineage is cut."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="halyard-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (single-machine tests) a temporary folder of
    this process is used; a cluster without the setting is refused.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/halyard/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This ends the lineage on storage that outlives any executor, and the plan
    above it starts from a scan with known size.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that deals both sides by key, however small they look.

    Spark takes what a Python function or a generator makes for about as large as
    its input; a join would then collect all of it in the driver to broadcast it.
    """
    return df.hint("merge")


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame | str) -> None:
    """Delete tables that cut() wrote, or paths that scratch() named, once nothing will read them again."""
    spark = SparkSession.getActiveSession()
    for table in tables:
        path = table if isinstance(table, str) else _PATHS.pop(table, None)
        if path and spark:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Delete all that this library left in the shared folder; for the end of a run whose results have been read."""
    remove(spark, f"{shared_folder(spark)}/halyard")
