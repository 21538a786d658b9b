"""SimHash near-duplicates by anchor-point covering.

Fingerprints are points of the 64-bit Hamming cube.  Of two points at distance
three or less, one of their 32-bit halves differs in one bit at most.  On each
half the anchors are a covering code: the perfect [31,26] Hamming code times
the free 32nd bit, 2^27 anchors of covering radius 1.  A point's *home* is the
anchor within radius 1 of its half; the point is also *replicated* to every
anchor within radius 1 + 1.  If two halves differ in at most one bit, the home
of the one is an anchor of the other, so comparing homes with replicas per
anchor finds every link.

An anchor with many homes would cost the product of its sides.  Points of such
anchors take an exact way whose buckets are bounded by geometry: the home side
writes each key at distance <= 1 of itself (65), the replica side each key at
distance <= 2 (2081).  Two points within distance 3 share such a key, and any
two that share one are within distance 3, so linking each key's smallest home
point to all points of the key finds exactly the links' components.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import lower_words, per_batch, pick, table
from halyard.llm.components import connected_components
from halyard.session import cut, dealt

SEED = 42
MAX_BITS = 3
SHINGLE = 3

_BYTE = np.arange(256, dtype=np.uint32)
#: xor of the positions (1 to 31) of the bits set in a byte of a 32-bit half; bit 31 is free (position 0)
_SYNDROME = [np.bitwise_xor.reduce([((_BYTE >> bit) & 1) * np.uint32((8 * byte + bit + 1) % 32) for bit in range(8)]) for byte in range(4)]
_FLIP = np.array([0] + [1 << p for p in range(31)], np.uint32)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: unsigned 64 bits; 0 for a text without a word.

    A bit is 1 if set in over half the XXH64 values of the word shingles,
    repeats counted.  Fewer words than a shingle give one shingle of them all.
    """
    words = lower_words(text)
    if not words:
        return 0
    parts = [words] if len(words) < shingle else zip(*(words[k:] for k in range(shingle)))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(b" ".join(p), SEED) for p in parts), np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of some uint64 hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per input row, fp the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    run = lambda b: {"doc_id": b.column(0), "fp": _signed([fingerprint(t, shingle) for t in b.column(1).to_pylist()])}
    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(per_batch(run, schema), "doc_id long, fp long")


def nearest_anchor(half: np.ndarray) -> np.ndarray:
    """The code word within distance 1 of each 32-bit half."""
    s = _SYNDROME[0][half & 255] ^ _SYNDROME[1][(half >> 8) & 255] ^ _SYNDROME[2][(half >> 16) & 255] ^ _SYNDROME[3][half >> 24]
    return half ^ _FLIP[s]


def _anchors(reach: int):
    """Home anchors (reach 0), or all anchors within reach of the covering radius (1)."""
    schema = pa.schema([("anchor", pa.int64()), ("fp", pa.int64())])
    steps = np.array([0] + ([1 << p for p in range(32)] if reach else []), np.uint32)

    def run(batch):
        fp, out = batch.column(0).to_numpy(zero_copy_only=False), []
        for side in (0, 1):
            half = ((fp.view(np.uint64) >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            at = np.sort(nearest_anchor(half[:, None] ^ steps[None, :]), axis=1)
            new = np.ones(at.shape, bool)
            new[:, 1:] = at[:, 1:] != at[:, :-1]
            out.append((at[new].astype(np.int64) | np.int64(side << 32), fp[np.nonzero(new)[0]]))
        return {"anchor": np.concatenate([x[0] for x in out]), "fp": np.concatenate([x[1] for x in out])}

    return per_batch(run, schema, 8192)


def _balls(radius: int):
    """All keys within ``radius`` of each fingerprint."""
    masks = np.array([sum(1 << p for p in ps) for k in range(radius + 1) for ps in itertools.combinations(range(64), k)], np.uint64)
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batch):
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        return {"key": (fp.view(np.uint64)[:, None] ^ masks[None, :]).ravel().view(np.int64), "fp": np.repeat(fp, len(masks))}

    return per_batch(run, schema, 256)


def links(points: DataFrame, hot_homes: int = 512) -> DataFrame:
    """(a, b) links between distinct fingerprints (one column, fp).

    Every pair at MAX_BITS or fewer differing bits is linked directly, but for
    points homed at anchors with more than ``hot_homes`` homes, which get links
    with the same components through bounded keys.  A replica meets at most
    ``hot_homes`` homes, so the work is in proportion to the replicas.
    """
    homes, replicas = cut(points.mapInArrow(_anchors(0), "anchor long, fp long"), "homes"), points.mapInArrow(_anchors(1), "anchor long, fp long")
    hot = cut(homes.groupBy("anchor").count().where(F.col("count") > hot_homes).select("anchor"), "hot-anchors")
    any_hot = not hot.isEmpty()
    h = homes.join(hot, "anchor", "left_anti") if any_hot else homes
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    pairs = dealt(h.withColumnRenamed("fp", "a")).join(replicas.withColumnRenamed("fp", "b"), "anchor").where(near).select("a", "b")
    if any_hot:
        at = cut(homes.join(hot, "anchor").select("fp").distinct(), "hot-points")
        around = cut(replicas.join(hot, "anchor").select("fp").distinct(), "near-hot")
        keys = "key long, fp long"
        low = cut(at.mapInArrow(_balls(1), keys).groupBy("key").agg(F.min("fp").alias("a")), "hot-keys")
        for side in (at.mapInArrow(_balls(1), keys), around.mapInArrow(_balls(2), keys)):
            pairs = pairs.unionByName(dealt(side).join(low, "key").where("a != fp").select("a", F.col("fp").alias("b")))
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_homes: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    * texts with no word (null and empty included) have fingerprint zero and are
      linked like any other;
    * equal fingerprints are one point, so exact copies never form pairs;
    * ``component_id`` is the smallest doc_id reachable by links, itself included;
      rows with a null doc_id get the component of their fingerprint, null if no
      row of that component has an id;
    * repeated rows and ids each get their row, other columns are not read, and
      an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    found = cut(connected_components(links(points.select("fp"), hot_homes)), "components")
    of = cut(dealt(points).join(found, points.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("group")), "grouped")
    least = of.groupBy("group").agg(F.min("least").alias("component_id"))
    of = dealt(of).join(least, "group").select("fp", "component_id")
    return dealt(rows).join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
