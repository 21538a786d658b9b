"""Mixing sources to target weights by exact prefix cuts in hash-random order.

Each row gets a hash-random key; within its source, rows stand in key order.
As keys are uniform, equal ranges of the key are equal shares of a source, so
the range sort is dealt by (source, key range): no source, however large, meets
in one task.  Sums per range give each range's prefix, a running sum inside the
range the rest, and the source is cut where its words reach the budget.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.common import WORD, pick, table
from halyard.session import cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "halyard-mix"
#: Random bits of a key: 15 hex digits of an md5
KEY_BITS = 60
RANGES = 256
#: Sources are listed on the driver and joined by broadcast; more are refused.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Each source's share of all words by weight, none above max_epochs times its size.

    Weights repeat in the order of the sources.  What a full source can't take
    is shared by weight among the others; a target is weight * rest / weights
    of those not full, so that equal integers give equal doubles everywhere.
    """
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    rest, left, out = sum(sizes), sum(w), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda k: (max_epochs * sizes[k] / w[k], k))
    for at, k in enumerate(order):
        if w[k] * rest <= max_epochs * sizes[k] * left:
            for j in order[at:]:
                out[j] = float(w[j]) * rest / left
            break
        out[k] = float(max_epochs * sizes[k])
        rest, left = rest - max_epochs * sizes[k], left - w[k]
    return out


def n_words(column) -> "F.Column":
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id, size) -> "F.Column":
    """A uniform key of KEY_BITS bits from the id, or from the size where there is none."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), size.cast("string")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), name).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, ranges: int = RANGES, tie: tuple[str, ...] = ()) -> DataFrame:
    """Adds source_size, target, taken to rows of (doc_id, source, size, ...).

    ``taken`` is how many of the row's words the mix takes, repeats counted:
    whole epochs of the source, then rows in key order up to the exact budget
    (the target without its fraction), the last of them in part.

    * null sources are a source of their own, last in the order of weights;
    * rows of size 0 (null or empty texts) take 0; a source of such rows has
      target 0;
    * rows with equal keys (equal ids, or no id and one size) stand in order of id
      and size, then of the ``tie`` columns; rows equal in all are
      interchangeable, so reruns agree;
    * further columns pass through; an empty table gives an empty result.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    listed = sorted(((r[0], r[1]) for r in sums), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    found = targets([n for _, n in listed], weights, max_epochs)
    schema = "s_source string, s_no int, source_size long, target double"
    sources = rows.sparkSession.createDataFrame([(s, k, n, found[k]) for k, (s, n) in enumerate(listed)], schema)
    # the list of sources is bounded by MAX_SOURCES, checked above
    dealt = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(F.col("s_source"))).drop("s_source")
    dealt = dealt.withColumn("mix_key", mix_key(F.col("doc_id"), F.col("size"))).withColumn("mix_range", (F.col("mix_key") / F.lit(float(1 << KEY_BITS)) * ranges).cast("int"))
    sums = dealt.groupBy("s_no", "mix_range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("s_no").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("s_no").alias("o_no"), F.col("mix_range").alias("o_range"), F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("mix_offset"))
    running = Window.partitionBy("s_no", "mix_range").orderBy("mix_key", "doc_id", "size", *tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("mix_before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    placed = placed.join(offsets, (F.col("s_no") == F.col("o_no")) & (F.col("mix_range") == F.col("o_range")))
    budget, size = F.floor("target"), F.col("source_size")
    epochs = F.when(size > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = F.when(size > 0, budget % size).otherwise(F.lit(0)) - F.col("mix_offset") - F.col("mix_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.withColumn("taken", taken.cast("long")).drop("s_no", "o_no", "o_range", "mix_key", "mix_range", "mix_offset", "mix_before")


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    at, end = 0, 0
    for found in re.finditer(WORD, text):
        if at == n:
            break
        at, end = at + 1, found.end()
    return text[:end]


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that a document is taken.

    Whole epochs repeat the row; a source's last document is cut after the
    words that its budget still has.  Documents of no word are not taken.  Texts
    are not shuffled: a row is taken if it stands at or before its source's last
    row, and those rows, one a source, are sent to all tasks.  Null sources and
    ids, repeated rows and empty tables are as in mix(); columns of any other
    name pass through.
    """
    mine = {c: f"mix_in_{k}" for k, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()], n_words(F.col("`text`")).alias("mix_size"), F.monotonically_increasing_id().alias("mix_row"))
    held = cut(held, "sized")
    slim = held.select(F.col(mine["doc_id"]).alias("doc_id"), F.col(mine["source"]).alias("source"), F.col("mix_size").alias("size"), "mix_row")
    placed = mix(slim, weights, max_epochs, tie=("mix_row",))
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    extra = F.col("taken") - epochs * F.col("size")
    place = lambda key, doc_id, size, row: F.struct(key, F.coalesce(doc_id.cast("long"), F.lit(-(2**63))), size, row)
    at = place(mix_key(F.col("doc_id"), F.col("size")), F.col("doc_id"), F.col("size"), F.col("mix_row"))
    # one row a source, of which there are MAX_SOURCES at most
    last = placed.groupBy(F.col("source").alias("mix_source")).agg(F.first(epochs).alias("mix_epochs"), F.max(F.when(extra > 0, F.struct(at.alias("at"), extra.alias("extra")))).alias("mix_last"))
    last = cut(last, "last-rows")
    rows = held.join(F.broadcast(last), held[mine["source"]].eqNullSafe(F.col("mix_source")))
    own = place(mix_key(F.col(mine["doc_id"]), F.col("mix_size")), F.col(mine["doc_id"]), F.col("mix_size"), F.col("mix_row"))
    more = F.when(own < F.col("mix_last.at"), F.col("mix_size")).when(own == F.col("mix_last.at"), F.col("mix_last.extra")).otherwise(F.lit(0))
    rows = rows.where("mix_size > 0").withColumn("mix_more", F.coalesce(more, F.lit(0)))
    times = F.col("mix_epochs") + (F.col("mix_more") == F.col("mix_size")).cast("long")
    whole = rows.where(times > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))

    @F.pandas_udf("string")
    def start(text: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([first_words(t, k) for t, k in zip(text, n)], dtype=object)

    part = rows.where((F.col("mix_more") > 0) & (F.col("mix_more") < F.col("mix_size"))).withColumn(mine["text"], start(mine["text"], "mix_more"))
    if "n_chars" in mine:
        part = part.withColumn(mine["n_chars"], F.char_length(mine["text"]).cast(docs.schema["n_chars"].dataType))
    both = whole.select(*mine.values()).unionByName(part.select(*mine.values()))
    return both.select(*[F.col(n).alias(c) for c, n in mine.items()])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text")
    rows = cut(docs.select("doc_id", "source", n_words("text").alias("size")), "sizes")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, size, CAST('0x' || substr(md5('halyard-mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || size)), 1, 15) AS BIGINT) AS k
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1 AS no FROM s),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM n),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, no) AS rk FROM w),
p AS (SELECT *, CAST((SELECT sum(source_size) FROM o) - coalesce(sum(3 * source_size) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
             CAST(sum(w) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS lft FROM o),
c AS (SELECT min(rk) AS cut FROM p WHERE w * rest <= 3 * source_size * lft),
t AS (SELECT p.source, p.source_size,
             CASE WHEN p.rk < c.cut THEN CAST(3 * p.source_size AS DOUBLE)
                  ELSE CAST(p.w AS DOUBLE) * q.rest / q.lft END AS target
      FROM p CROSS JOIN c JOIN p AS q ON q.rk = c.cut),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (CAST(floor(target) AS BIGINT) // source_size) * size
            + greatest(0, least(size, CAST(floor(target) AS BIGINT) % source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM r
"""
