"""Documents to training shards: five stages, each by one operator of halyard.llm.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and, but
for the last, returns the columns of documents.  run() writes each stage's rows
as Parquet in the shared folder and hands the next stage what reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halyard.llm.common import table
from halyard.llm.decontaminate import without_contaminated
from halyard.llm.mixing import mixed_documents
from halyard.llm.quality import Judge, good_documents
from halyard.llm.repair_ids import encode_documents
from halyard.llm.shingles import one_of_each_group
from halyard.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the isolation forest keeps."""
    return good_documents(docs, Judge.fit(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id."""
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; each source's last one in part."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as grammar-compressed shards; their digests, read back."""
    return encode_documents(docs)


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("token_ids", token_ids)]

#: Anchors, forests and byte-pair encoding are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = cut(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
