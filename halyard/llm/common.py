"""Shared pieces of the corpus operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+ is what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than blank, tab, LF, VT, FF and CR."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def lower_words(text: str | None) -> list[bytes]:
    """As words(), with A-Z (and no other letter) put in lower case first."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows each: long texts then never pile up in a worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@functools.lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """A Python worker outlives its tasks: memory that a task has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def per_batch(fn: Callable[[pa.RecordBatch], dict | None], schema: pa.Schema, rows: int = 512):
    """A mapInArrow function from one that turns a small batch into columns."""

    def run(batches):
        for batch in slices(batches, rows):
            columns = fn(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
        give_back()

    return run


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names: whatever else the table
    holds, clashing names included, stays out of the plan."""
    return df.select(*[F.col(f"`{name}`").alias(alias) for alias, name in columns.items()])


def crc32_of_id(column) -> "F.Column":
    """Unsigned crc32 of an id's decimal text."""
    return F.crc32(column.cast("string").cast("binary"))
