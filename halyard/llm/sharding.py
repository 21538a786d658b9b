"""Sharding by a two-pass external shuffle.

A record's shard is decided by its doc_id and the number of shards alone
(highest random weight), so one more shard only takes rows into itself.  Pass
one scatters the records of a shard, by a seeded hash, into buckets that fit in
memory; pass two shuffles each bucket by Fisher-Yates and writes it.  Buckets
follow each other in a shard, so a record's slot is its bucket's offset and its
place in the bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.common import pick, table
from halyard.session import cut, scratch

SHARDS = 8
SEED = 7
BUCKET_BYTES = 32 << 20
#: Buckets a shard has at least, so that small inputs are dealt to many tasks too
LEAST_BUCKETS = 16
#: Beyond so many buckets a task takes several, one after the other
MOST_TASKS = 20_000


def shard_of(doc_id, shards: int) -> "F.Column":
    """The shard whose hash with the id is largest; ties go to the last."""
    ranked = [F.struct(F.xxhash64(doc_id.cast("string"), F.lit(f"shard {s}")), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*ranked))["s"]


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of range(n), the same for the same seed."""
    order, draw = np.arange(n), np.random.Generator(np.random.PCG64(seed)).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draw[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def _shuffled(seed: int):
    def run(rows: pa.Table) -> pa.Table:
        ids, sums = rows["doc_id"].to_pylist(), rows["text_crc32"].to_pylist()
        at = sorted(range(rows.num_rows), key=lambda k: (ids[k] is None, ids[k] or 0, sums[k]))
        shard, bucket = rows["shard"][0].as_py(), rows["bucket"][0].as_py()
        order = np.asarray(at)[fisher_yates(rows.num_rows, [seed, shard, bucket])]
        return rows.take(pa.array(order)).append_column("place", pa.array(np.arange(rows.num_rows), pa.int64()))

    return run


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes Parquet files of (doc_id, text, text_crc32, bucket, place), a folder per shard.

    * a null text stays null and counts no bytes; a null id goes to a shard as
      any other value does;
    * repeated rows are separate records; a bucket grows with rows that repeat
      one id and one text, for the hash can't tell them apart;
    * other columns are not read; an empty table writes no file.
    """
    text = F.col("text")
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text_crc32", F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long"))
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / shards / bucket_bytes))
    scattered = rows.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    names = "doc_id long, text string, text_crc32 long, shard int, bucket int, place long"
    # a task for each bucket, not as many as the session shuffles to: tasks stay as large as a bucket
    scattered = scattered.select(F.col("doc_id").cast("long"), "text", "text_crc32", "shard", "bucket").repartition(min(MOST_TASKS, shards * buckets), "shard", "bucket")
    scattered.groupBy("shard", "bucket").applyInArrow(_shuffled(seed), names).write.partitionBy("shard").parquet(path)


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds each record's slot: the rows of its shard's earlier buckets, and its place."""
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("offset") + F.col("place")).drop("offset")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Written records: doc_id, text, text_crc32, bucket, place and shard."""
    return spark.read.schema("doc_id long, text string, text_crc32 long, bucket int, place long, shard int").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    digests = cut(read_shards(spark, path).select("doc_id", size.alias("size"), crc.alias("text_crc32"), "shard", "bucket", "place"), "shard-digests")
    return with_slots(digests).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"))
