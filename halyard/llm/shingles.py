"""Near duplicates by Jaccard similarity of word-shingle sets, exact, by prefix filtering.

The SimHash operator goes first: sets whose fingerprints its anchors join are
compared with the first set of their component, which settles most exact and
close copies.  64 bits can't tell a similarity of 0.8 from less, though, so what
they miss is found by prefixes.

Two sets with a Jaccard similarity of t or more share an element among the first
n - ceil(t n) + 1 of each, in any one order of all elements.  So the texts' sets,
equal ones taken once, meet at the shingles of their prefixes, and all links are
found.  The order puts shingles that are common in a sample of the texts last:
which ones it holds changes the work, never the result.

Where many sets meet at a shingle, each is first compared with the smallest, the
largest and the most central of them alone: the one whose prefix is shared with
most others, by the mean of the logarithms of their numbers, which in a group of
edited copies is the text they were made from.  What these links join needs no further comparison.  Only pairs of sets
that are still in different components follow: all of them where few sets meet.
A crowd is dealt anew around its most central set, the pivot: most of its sets
share the pivot's shingles, so they meet again only at shingles that they have
and the pivot has not, or at shingles that the pivot has and both have not
(``around``).  Similar sets still meet, those that only resemble the pivot don't.
Most of these keys are one set's alone; they are left out by a bitmap of the keys
that occur twice (``repeated``), which may let others pass but holds none back.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import lower_words, per_batch, pick
from halyard.llm.components import connected_components
from halyard.llm.simhash import links, majority
from halyard.session import cut, discard

SHINGLE = 5
#: Similarity from which two texts are near duplicates, as a fraction of integers
NUMERATOR, DENOMINATOR = 4, 5
#: The order of shingles: texts sampled for it (so many, or a part of all if that is more), and how many of the commonest, met COMMON times, go last
SAMPLE_DOCS, SAMPLE_PART = 5000, 1 / 16
COMMON, MOST_COMMON = 4, 500_000
#: Bits of a set's parity sketch
PARITY = 1024
#: Sets at a shingle up to which all pairs are compared; larger crowds are dealt anew once, and on (ROUNDS times at most) while they have more pairs than CROWD a row
CROWD, ROUNDS = 16, 4
#: Bits of a key by which keys that occur twice are marked, at most: 8 MB in a worker
MARK_BITS = 26

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, fewer words than a shingle being one."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter(map(digest, words), np.uint64, len(words))
    size = min(shingle, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _A + w[k : len(w) - size + 1 + k]
    h = (h ^ (h >> np.uint64(30))) * _B
    return np.unique(h ^ (h >> np.uint64(31)))


def _ordered(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The elements in the one order of all shingles: common ones last."""
    s, met = common
    if not len(s) or not len(found):
        return found
    at = np.minimum(np.searchsorted(s, found), len(s) - 1)
    return found[np.argsort(np.where(s[at] == found, met[at], 0), kind="stable")]


def _key(found: np.ndarray) -> int:
    """A set's number: signed 64 bits."""
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def needed(n: int) -> int:
    """The least overlap that a set of n shares with any similar one."""
    return -(-NUMERATOR * n // DENOMINATOR)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def parity(found: np.ndarray) -> bytes:
    """A bit per residue: whether an odd number of elements has it.  Two sketches differ in no more bits than their sets in elements."""
    return np.packbits(np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1 > 0).tobytes()


def _common(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted common shingles of a sample of docs(doc_id, text), and how often each was met."""
    schema = pa.schema([("s", pa.int64())])
    run = lambda b: {"s": np.concatenate([np.zeros(0, np.uint64), *[shingle_set(t) for t in b.column(0).to_pylist()]]).view(np.int64)}
    rate = max(SAMPLE_PART, SAMPLE_DOCS / max(1, n_docs))
    drawn = docs.where(F.pmod(F.xxhash64(F.lit("shingles"), "doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, rate) * (1 << 30)))).select("text")
    met = drawn.mapInArrow(per_batch(run, schema), "s long").groupBy("s").count().where(F.col("count") >= COMMON)
    rows = met.orderBy(F.desc("count"), "s").limit(MOST_COMMON).toArrow()
    s, n = rows["s"].to_numpy().view(np.uint64), rows["count"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _prefixes(common):
    """(doc_id, set, n, fp, parity, prefix) of (doc_id, text); fp is the SimHash of the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("parity", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batch):
        out = {"doc_id": batch.column(0), "set": [], "n": [], "fp": [], "parity": [], "prefix": []}
        for text in batch.column(1).to_pylist():
            found = shingle_set(text)
            first = _ordered(found, common.value)
            out["set"].append(_key(found))
            out["n"].append(len(found))
            out["fp"].append(int(np.uint64(majority(found)).view(np.int64)))
            out["parity"].append(parity(found))
            out["prefix"].append(first[: len(found) - needed(len(found)) + 1].view(np.int64) if len(found) else [])
        return out

    return per_batch(run, schema)


def _packed_texts(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, packed): a compressed text of each set in pairs(a, b)."""
    ends = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    ends = cut(ends.join(sets.select("set", "least"), "set"), "ends")
    packed = pa.schema([("set", pa.int64()), ("packed", pa.binary())])

    def pack(batch):
        texts = batch.column(0).to_pylist()
        return {"set": [_key(shingle_set(t)) for t in texts], "packed": [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in texts]}

    texts = docs.join(ends.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    held = texts.mapInArrow(per_batch(pack, packed), "set long, packed binary").join(ends.select("set"), "set", "left_semi").dropDuplicates(["set"])
    held = cut(held, "packed-texts")
    discard(ends)
    return held


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar; docs(doc_id, text) and sets(set, least, n, parity) give their texts.

    Sketches that differ in more bits than similar sets can in elements rule
    most pairs out; the others' texts are compared.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near(batch):
        bits = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, PARITY // 8) for k in (2, 3)]
        apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
        keep = pa.array(apart * (NUMERATOR + DENOMINATOR) <= batch.column(4).to_numpy() * (DENOMINATOR - NUMERATOR), pa.bool_())
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    x, y = (sets.select(F.col("set").alias(c), F.col("parity").alias(f"p{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    pairs = pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "pa", "pb", (F.col("na") + F.col("nb")).alias("n"))
    pairs = cut(pairs.mapInArrow(per_batch(near, schema), "a long, b long"), "pairs")
    held = _packed_texts(pairs, docs, sets)

    def check(batch):
        # a text is unpacked once for pairs that follow each other
        keep, last, x = [], None, None
        for a, p, q in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if a != last or x is None:
                last, x = a, _unpacked(p)
            keep.append(similar(x, _unpacked(q)))
        keep = pa.array(keep, pa.bool_())
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    both = pairs.join(held.select(F.col("set").alias("a"), F.col("packed").alias("x")), "a").join(held.select(F.col("set").alias("b"), F.col("packed").alias("y")), "b")
    out = cut(both.select("a", "b", "x", "y").mapInArrow(per_batch(check, schema), "a long, b long"), "similar")
    discard(pairs, held)
    return out


def _unpacked(packed: bytes) -> np.ndarray:
    return shingle_set(zlib.decompress(packed).decode("utf-8", "surrogatepass"))


def _may(n, at, m, to) -> "F.Column":
    """Whether sets of n and m can be similar if the first element they share stands at ``at`` and ``to``."""
    shared = 1 + F.least(n - at - 1, m - to - 1)
    return (F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR) & (shared * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(set, least, component): each set of shingles, its rows' smallest id and its component's number.

    Texts without a word share the empty set.  Two sets are linked if their
    Jaccard similarity is NUMERATOR / DENOMINATOR or more.  Rows without an id
    are left out.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, docs.count()))
    rows = docs.mapInArrow(_prefixes(common), "doc_id long, set long, n long, fp long, parity binary, prefix array<long>")
    # equal sets have equal prefixes
    sets = cut(rows.groupBy("set").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", "parity", "prefix")]), "sets")
    close = _close(sets)
    here, entry = Window.partitionBy("s"), F.struct("n", "set", "at")
    met = sets.select("set", F.col("n").cast("int").alias("n"), F.size("prefix").alias("size"), F.posexplode("prefix").alias("at", "s")).withColumn("held", F.count("*").over(here))
    met = cut(met.withColumn("low", F.min(entry).over(here)).withColumn("high", F.max(entry).over(here)).where("held > 1"), "meetings")
    part = met.groupBy("set").agg((F.sum(F.log2("held")) / F.first("size")).alias("part"))
    met, bare = cut(met.join(part, "set"), "parts"), met
    discard(bare)
    central = cut(met.groupBy("s").agg(F.max_by(entry, F.struct("part", "set")).alias("central")), "central")
    first = met.join(central, "s").withColumn("l", F.explode(F.array_distinct(F.array("low", "high", "central")))).where((F.col("set") != F.col("l.set")) & _may(F.col("n"), F.col("at"), F.col("l.n"), F.col("l.at")))
    first = first.select(F.least("set", "l.set").alias("a"), F.greatest("set", "l.set").alias("b"))
    one = _verified(first.unionByName(close), docs, sets)
    joined = cut(connected_components(one), "first-components")
    # pairs of different components that meet somewhere else than with a leader
    placed = met.where("held > 2").join(joined.withColumnRenamed("node", "set"), "set", "left")
    placed = cut(placed.select("s", "set", "n", "at", "part", F.coalesce("component", "set").alias("g")), "placed")
    discard(met, central, joined, close)
    pairs, links = _apart(placed, docs, sets, common)
    rest = _verified(pairs, docs, sets).unionByName(links)
    found = cut(connected_components(one.unionByName(rest)), "components")
    out = cut(sets.select("set", "least").join(found.withColumnRenamed("node", "set"), "set", "left").select("set", "least", F.coalesce("component", "set").alias("component")), "groups")
    discard(one, pairs, links, found, sets)
    return out


def around(found: np.ndarray, base: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[bool, np.ndarray, np.ndarray, int]:
    """Whether a set is similar to a pivot, what it has and the pivot has not, what the pivot has and it has not, and how many of these count in full.

    Of two similar sets that are not both similar to the pivot, either the first
    lists share an element, or the second ones share one that counts in full for
    one of the two.  With the pivot's elements last in the order, the first list
    is the prefix: a similar set shares needed(n) elements, and if more than the
    pivot can give, then one of the first n - needed(n) + 1 others.  If not, and no
    such element is shared, let d of the pivot's m elements be missing in a set
    of n.  Similar sets then have NUMERATOR / (NUMERATOR + DENOMINATOR) of their
    sizes' sum in common, all of it the pivot's, which bounds what both miss from
    below: beside a set that is not similar to the pivot (the elements that count
    in full), and beside any (all that are listed, if this one is not similar).
    """
    added, missing = np.setdiff1d(found, base, assume_unique=True), np.setdiff1d(base, found, assume_unique=True)
    n, m, d = len(found), len(base), len(missing)
    both, t = n - len(added), NUMERATOR + DENOMINATOR
    near = DENOMINATOR * both >= NUMERATOR * (n + m - both)
    first = _ordered(added, common)[: n - needed(n) + 1]
    if both < needed(n):
        return near, first, missing[:0], 0
    full = max(0, min(d, d - (t * d + NUMERATOR * (n - m)) // t))
    listed = full if near else max(full, min(d, d + 1 - -(-(t * d + NUMERATOR * n - DENOMINATOR * m) // t)))
    return near, first, _ordered(missing, common)[:listed], full


def _again(common):
    """(set, b, n, g, part, near, keys, at) of (set, b, n, g, part, h, x, y): where a set meets others of its crowd around the pivot b; at is -1 at what doesn't count in full.

    A set that is similar to the pivot takes its component h.
    """
    schema = pa.schema([("set", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("g", pa.int64()), ("part", pa.float64()), ("near", pa.bool_()), ("keys", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

    def run(batch):
        out = {f.name: batch.column(k) if k < 5 else [] for k, f in enumerate(schema)}
        own, theirs, last, base = batch.column(3).to_pylist(), batch.column(5).to_pylist(), None, None
        for k, (b, p, q) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 6, 7)))):
            if b != last:
                last, base = b, _unpacked(q)
            near, first, missing, full = around(_unpacked(p), base, common.value)
            salt = np.uint64(b * int(_B) % (1 << 64))
            keys = np.concatenate([first ^ salt, (missing ^ salt) + _A])
            keys = (keys ^ (keys >> np.uint64(30))) * _A
            own[k] = theirs[k] if near else own[k]
            out["near"].append(bool(near))
            out["keys"].append((keys ^ (keys >> np.uint64(31))).view(np.int64))
            out["at"].append(np.concatenate([np.arange(len(first)), np.where(np.arange(len(missing)) < full, 0, -1)]).astype(np.int32))
        return out | {"g": own}

    return per_batch(run, schema)


def _flat(column) -> np.ndarray:
    """The values of a list column of longs, as unsigned."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def repeated(lists: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(bits, marks) of n keys in lists (one column, keys), even 64-bit hashes: for each value of their first ``bits`` bits, whether a key that begins so occurs twice.

    Every key that occurs twice is marked; of the others few are, or, where they
    are too many for MARK_BITS, more.  A key travels as 4 bytes in the slice that
    its first bits name.
    """
    cuts = max(8, (n >> 20).bit_length())
    bits = min(MARK_BITS, max(16, cuts + 3, (16 * n).bit_length()))
    part, out = pa.schema([("slice", pa.int32()), ("held", pa.binary())]), pa.schema([("slice", pa.int32()), ("marks", pa.binary())])

    def split(batches):
        held, size = [], 0

        def flush():
            keys = np.sort(np.concatenate(held))
            at = np.searchsorted(keys, np.arange(1, 1 << cuts, dtype=np.uint64) << np.uint64(64 - cuts))
            rows = [(k, x) for k, x in enumerate(np.split(((keys >> np.uint64(32 - cuts)) & np.uint64(0xFFFFFFFF)).astype("<u4"), at)) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x.tobytes() for _, x in rows], pa.binary())], schema=part)

        for batch in batches:
            held.append(_flat(batch.column(0)))
            size += len(held[-1])
            if size > 1 << 20:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def meet(table):
        x = np.sort(np.concatenate([np.frombuffer(h, "<u4") for h in table["held"].to_pylist()]))
        marks = np.zeros(1 << (bits - cuts), bool)
        marks[x[1:][x[1:] == x[:-1]] >> np.uint32(32 - (bits - cuts))] = True
        return pa.Table.from_arrays([table["slice"][:1], pa.array([zlib.compress(np.packbits(marks).tobytes(), 1)], pa.binary())], schema=out)

    found = lists.mapInArrow(split, "slice int, held binary").groupBy("slice").applyInArrow(meet, "slice int, marks binary").toArrow()
    marks = np.zeros((1 << cuts, 1 << (bits - cuts - 3)), np.uint8)
    for k, held in zip(found["slice"].to_pylist(), found["marks"].to_pylist()):
        marks[k] = np.frombuffer(zlib.decompress(held), np.uint8)
    return bits, marks.ravel()


def is_marked(keys: np.ndarray, found: tuple[int, np.ndarray]) -> np.ndarray:
    bits, marks = found
    at = keys >> np.uint64(64 - bits)
    return (marks[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _met_again(marks):
    """The rows (set, n, g, part, keys, at) with only the keys that are marked."""
    schema = pa.schema([("set", pa.int64()), ("n", pa.int32()), ("g", pa.int64()), ("part", pa.float64()), ("keys", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

    def run(batch):
        keep = is_marked(_flat(batch.column(4)), marks.value)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False))]).astype(np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(keep)])[ends], pa.int32())
        left = [pa.ListArray.from_arrays(ends, batch.column(k).flatten().filter(pa.array(keep))) for k in (4, 5)]
        return {f.name: batch.column(k) if k < 4 else left[k - 4] for k, f in enumerate(schema)}

    return per_batch(run, schema)


def _apart(placed: DataFrame, docs: DataFrame, sets: DataFrame, common) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of sets of different components g to be compared, and links (a, b) found; placed(s, set, n, at, part, g) is used up.

    Among the sets at an s all similar pairs are to be found, but for those of one component.
    """
    spark = docs.sparkSession
    pairs, links, empty = [], [], sets.select(F.col("set").alias("a"), F.col("set").alias("b")).where("false")
    rows = placed.count()
    for turn in range(ROUNDS + 1):
        crowd = placed.groupBy("s").agg(F.count("*").alias("held"), F.min("g").alias("least"), F.max("g").alias("most"), F.max_by(F.struct("set", "g"), F.struct("part", "set")).alias("pivot"))
        here = cut(placed.join(crowd.where("least != most"), "s"), "crowds")
        large = here.where(F.col("held") > CROWD).agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
        anew = turn < ROUNDS and large > (2 * CROWD * rows if turn else 0)
        few = here.where(F.col("held") <= CROWD) if anew else here
        x, y = (few.select("s", F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("at").alias(f"at{c}"), F.col("g").alias(f"g{c}")) for c in "ab")
        meet = (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & ((F.col("ata") >= 0) | (F.col("atb") >= 0))
        meet &= _may(F.col("na"), F.greatest("ata", F.lit(0)), F.col("nb"), F.greatest("atb", F.lit(0)))
        pairs.append(cut(x.join(y, "s").where(meet).select("a", "b"), "apart"))
        if not anew:
            discard(placed, here)
            break
        # of a set's components, all joined in the end, any will do
        asked = here.where((F.col("held") > CROWD) & (F.col("set") != F.col("pivot.set"))).groupBy("set", F.col("pivot.set").alias("b"))
        asked = cut(asked.agg(F.first("n").alias("n"), F.min("g").alias("g"), F.first("part").alias("part"), F.min("pivot.g").alias("h")), "asked")
        discard(placed, here)
        held = _packed_texts(asked.select(F.col("set").alias("a"), "b"), docs, sets)

        both = asked.join(held.select("set", F.col("packed").alias("x")), "set").join(held.select(F.col("set").alias("b"), F.col("packed").alias("y")), "b")
        both = both.select("set", "b", "n", "g", "part", "h", "x", "y")
        dealt_anew = cut(both.mapInArrow(_again(common), "set long, b long, n int, g long, part double, near boolean, keys array<long>, at array<int>"), "dealt-anew")
        links.append(cut(dealt_anew.where("near").select(F.col("set").alias("a"), "b"), "pivot-links"))
        # most keys are one set's alone: only those met twice become rows
        marks = spark.sparkContext.broadcast(repeated(dealt_anew.select("keys"), dealt_anew.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]))
        again = dealt_anew.select("set", "n", "g", "part", "keys", "at").mapInArrow(_met_again(marks), "set long, n int, g long, part double, keys array<long>, at array<int>")
        placed = again.select("set", "n", "part", "g", F.explode(F.arrays_zip("keys", "at")).alias("k")).select(F.col("k.keys").alias("s"), "set", "n", F.col("k.at").alias("at"), "part", "g")
        placed = cut(placed, "placed")
        discard(asked, held, dealt_anew)
        marks.unpersist()
    tables = [*pairs, *links]
    out = []
    for parts, name in ((pairs, "all-apart"), (links, "all-pivot-links")):
        whole = empty
        for p in parts:
            whole = whole.unionByName(p)
        out.append(cut(whole.distinct(), name))
    discard(*tables)
    return out[0], out[1]


def _close(sets: DataFrame) -> DataFrame:
    """(a, b): each set with the smallest set of its component of SimHash fingerprints."""
    points = cut(sets.select("fp").distinct(), "points")
    found = cut(connected_components(links(points)), "close-points")
    placed = sets.select("set", "fp").join(found.withColumnRenamed("node", "fp"), "fp", "left").select("set", F.coalesce("component", "fp").alias("g"))
    least = placed.groupBy("g").agg(F.min("set").alias("a"), F.count("*").alias("held")).where("held > 1").select("g", "a")
    out = cut(placed.join(least, "g").where("a != set").select("a", F.col("set").alias("b")), "close-pairs")
    discard(points, found)
    return out


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with all its columns: the smallest id's, and of its texts the smallest set's.

    Rows that repeat an id stay if their texts are of different groups; of rows
    that repeat an id and a set one stays.  Rows without an id can't be named as
    their group's row: they belong to no group and stay.
    """

    clash = [c for c in docs.columns if c in ("first_id", "first_set", "again_id", "again_set")]
    if clash:
        renamed = {c: f"own_{k}_{c}" for k, c in enumerate(clash)}
        kept = one_of_each_group(docs.withColumnsRenamed(renamed), id_col, text_col)
        return kept.withColumnsRenamed({n: c for c, n in renamed.items()})

    @F.pandas_udf("long")
    def set_of(text: pd.Series) -> pd.Series:
        return pd.Series([_key(shingle_set(t)) for t in text], dtype="int64")

    found = groups(docs, id_col, text_col)
    least = found.groupBy("component").agg(F.min(F.struct("least", "set")).alias("first"))
    least = cut(least.select(F.col("first.least").alias("first_id"), F.col("first.set").alias("first_set")), "firsts")
    discard(found)
    kept = docs.join(least.select("first_id").distinct(), F.col(id_col).cast("long") == F.col("first_id"), "left_semi")
    kept = cut(kept.withColumn("first_set", set_of(F.col(text_col).cast("string"))), "first-rows")
    kept = kept.join(least, (F.col(id_col).cast("long") == F.col("first_id")) & (kept["first_set"] == least["first_set"]), "left_semi")
    again = kept.groupBy(id_col, "first_set").count().where("count > 1").select(F.col(id_col).alias("again_id"), F.col("first_set").alias("again_set"))
    again = cut(again, "repeated")
    match = (F.col(id_col) == F.col("again_id")) & (F.col("first_set") == F.col("again_set"))
    # texts of ids that are not repeated are not shuffled for this
    once, more = kept.join(again, match, "left_anti"), kept.join(again, match, "left_semi").dropDuplicates([id_col, "first_set"])
    return once.unionByName(more).drop("first_set").unionByName(docs.where(F.col(id_col).isNull()))
