"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a block of training documents holds, for
each of its terms, the sorted word positions where it stands, so one index
answers for any benchmark.  Test items are sent to
all blocks, in bounded parts; every block answers on its own, so nothing is
shuffled and no term, however frequent, meets in one task.  A phrase is found
by taking the postings of its rarest term, shifted to the phrase's start, and
intersecting them with those of the other terms, rarest first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import pick, slices, table
from halyard.session import cut, scratch

WINDOW = 10
#: Words of the benchmark that are collected and sent to the blocks at a time
PART_WORDS = 1_000_000
BLOCK_DOCS = 512

#: Word characters are digits, a-z and everything beyond ASCII; A-Z counts as a-z.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Block:
    """Postings of a few documents.

    Positions run through the block; documents are one free position apart, so
    no phrase spans two.  ``keys`` is term number << 32 |
    position, ascending: the postings of all terms, one after the other.
    """

    def __init__(self, ids: list, n_words: np.ndarray, terms: list[bytes], counts: np.ndarray, positions: np.ndarray):
        self.ids, self.n_words, self.terms, self.counts, self.positions = ids, n_words, terms, counts, positions
        self.firsts = np.concatenate([[0], np.cumsum(n_words + 1)[:-1]]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        self.keys = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) | positions

    @classmethod
    def build(cls, ids: list, texts: list) -> "Block":
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").translate(_TO_WORDS) for t in texts]
        split = pc.ascii_split_whitespace(pa.array(raw, pa.binary()).view(pa.string()))
        n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        # white space at a text's ends splits off empty words
        found = split.flatten()
        full = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0
        doc = np.repeat(np.arange(len(texts)), n_words)[full]
        n_words = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        coded = found.filter(pa.array(full)).view(pa.binary()).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        terms = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        return cls(ids, n_words, terms, np.bincount(number, minlength=len(terms)), (np.arange(len(doc)) + doc)[order])

    def packed(self, no: int) -> dict:
        """A row of the index; words hold no line ends."""
        return {"block": no, "ids": self.ids, "n_words": self.n_words.astype("<i8").tobytes(), "terms": b"\n".join(self.terms), "counts": self.counts.astype("<i4").tobytes(), "positions": self.positions.astype("<i4").tobytes()}

    @classmethod
    def unpacked(cls, row: dict) -> "Block":
        read = lambda k, t: np.frombuffer(row[k], t).astype(np.int64)
        return cls(row["ids"], read("n_words", "<i8"), row["terms"].split(b"\n") if row["terms"] else [], read("counts", "<i4"), read("positions", "<i4"))

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, positions, side="right") - 1


class Phrases:
    """A part of the test items: their windows as term numbers, padded with -1."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, ws in items if ws})
        number = {name: k for k, name in enumerate(self.names)}
        rows, of = [], []
        for name, ws in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
            for at in range(max(1, len(ws) - window + 1) if ws else 0):
                part = codes[at : at + window]
                rows.append(part + [-1] * (window - len(part)))
                of.append(number[name])
        self.windows = np.array(rows, np.int64).reshape(-1, window)
        self.lengths = (self.windows >= 0).sum(1)
        self.item = np.array(of, np.int64)

    def _terms_in(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each term of the phrases: postings in the block, their start, the block's number."""
        n = len(self.vocabulary)
        count, number = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        here = np.array([self.vocabulary.get(t, n) for t in block.terms], np.int64)
        count[here], number[here] = block.counts, np.arange(len(block.terms))
        count[n] = 0
        starts = np.concatenate([[0], np.cumsum(block.counts)]).astype(np.int64)
        return count, starts[number], number

    def find(self, block: Block, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence, in parts of bounded memory."""
        count, start, number = self._terms_in(block)
        often = np.where(self.windows >= 0, count[self.windows], np.iinfo(np.int64).max)
        alive = np.nonzero(often.min(1) > 0)[0] if len(often) else np.zeros(0, np.int64)
        order = np.argsort(often[alive], axis=1, kind="stable")
        work = np.cumsum(often[alive, order[:, 0]]) if len(alive) else np.zeros(0, np.int64)
        found_w, found_s, done = [], [], 0
        while done < len(alive):
            upto = max(done + 1, int(np.searchsorted(work, (work[done - 1] if done else 0) + most, side="right")))
            w, o = alive[done:upto], order[done:upto]
            rare = self.windows[w, o[:, 0]]
            n = count[rare]
            row = np.repeat(np.arange(len(w)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = block.positions[np.repeat(start[rare], n) + within] - o[row, 0]
            row, at = row[at >= 0], at[at >= 0]
            for rank in range(1, self.windows.shape[1]):
                term = self.windows[w[row], o[row, rank]]
                key = (number[term] << 32) | (at + o[row, rank])
                place = np.minimum(np.searchsorted(block.keys, key), len(block.keys) - 1)
                ok = (term < 0) | (block.keys[place] == key)
                row, at = row[ok], at[ok]
            found_w.append(w[row]), found_s.append(at)
            done = upto
        none = np.zeros(0, np.int64)
        return (np.concatenate(found_w), np.concatenate(found_s)) if found_w else (none, none)

    def near(self, block: Block, within: int) -> list[tuple[int, str, int]]:
        """(document's place, item, word) where the item's rarest term stands and
        every other term of a window stands at most ``within`` words away."""
        count, start, number = self._terms_in(block)
        out = set()
        for w, codes in enumerate(self.windows):
            terms = sorted({int(c) for c in codes if c >= 0}, key=lambda c: (count[c], c))
            if not terms or not count[terms[0]]:
                continue
            at = block.positions[start[terms[0]] : start[terms[0]] + count[terms[0]]]
            doc = block.doc_of(at)
            low = np.maximum(block.firsts[doc], at - within)
            high = np.minimum(block.firsts[doc] + block.n_words[doc] - 1, at + within)
            ok = np.ones(len(at), bool)
            for term in terms[1:]:
                base = number[term] << 32
                place = np.searchsorted(block.keys, base | low)
                ok &= count[term] > 0
                ok &= (place < len(block.keys)) & (block.keys[np.minimum(place, len(block.keys) - 1)] <= (base | high))
            out |= {(int(d), self.names[self.item[w]], int(p - block.firsts[d])) for d, p in zip(doc[ok], at[ok])}
        return sorted(out)

    def hits(self, block: Block) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
        """Per document: merged [from, to) word ranges of the occurrences, and the items found."""
        w, s = self.find(block)
        spans: list[list[tuple[int, int]]] = [[] for _ in block.ids]
        items: list[list[str]] = [[] for _ in block.ids]
        if not len(w):
            return spans, items
        edge = np.zeros(int((block.n_words + 1).sum()) + 1, np.int64)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + self.lengths[w], -1)
        inside = np.concatenate([[False], np.cumsum(edge) > 0, [False]])
        turns = np.nonzero(inside[1:] != inside[:-1])[0]
        for d, a, b in zip(block.doc_of(turns[::2]).tolist(), turns[::2].tolist(), turns[1::2].tolist()):
            spans[d].append((a - int(block.firsts[d]), b - int(block.firsts[d])))
        for d, k in np.unique(np.stack([block.doc_of(s), self.item[w]], 1), axis=0).tolist():
            items[d].append(self.names[k])
        return spans, items


INDEX = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_words", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])
INDEX_SQL = "block long, ids array<long>, n_words binary, terms binary, counts binary, positions binary"


def parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_words: int = PART_WORDS):
    """The benchmark's items as Phrases, a bounded part at a time.

    Null ids are named by the empty string; items without a word have no window.
    """
    items = pick(benchmark, item_id=id_col, text=text_col).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // (5 * part_words)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        yield Phrases([(r["item_id"], item_words(r["text"])) for r in sorted(rows, key=lambda r: (r["item_id"], r["text"] or ""))])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Writes the postings of all terms of all documents as Parquet, a row per block, and reads them back.

    Null and empty texts have no words but stay in the index; null ids and
    repeated rows are documents like others; an empty table gives an empty index.
    """
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for batch in slices(batches, block_docs):
            k += 1
            yield pa.RecordBatch.from_pylist([Block.build(batch.column(0).to_pylist(), batch.column(1).to_pylist()).packed((task << 32) | k)], INDEX)

    pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX_SQL).write.parquet(path)
    return spark.read.schema(INDEX_SQL).parquet(path)


def _blocks(batches):
    for batch in slices(batches, 1):
        row = batch.to_pylist()[0]
        yield row["block"], Block.unpacked(row)


FOUND_SQL = "block long, place int, doc_id long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"
FOUND = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _answers(phrases):
    def run(batches):
        for no, block in _blocks(batches):
            spans, items = phrases.value.hits(block)
            n = len(block.ids)
            rows = {"block": [no] * n, "place": list(range(n)), "doc_id": block.ids, "n_words": block.n_words, "spans": [[{"a": a, "b": b} for a, b in x] for x in spans], "items": items}
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in FOUND], schema=FOUND)

    return run


def _joined(rows: pa.Table) -> pa.Table:
    first = rows.slice(0, 1).to_pylist()[0]
    merged: list = []
    for a, b in sorted((s["a"], s["b"]) for x in rows["spans"].to_pylist() for s in x):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    first["spans"] = [{"a": a, "b": b} for a, b in merged]
    first["items"] = sorted({i for x in rows["items"].to_pylist() for i in x})
    return pa.Table.from_pylist([first], FOUND)


def exact_matches(index: DataFrame, all_parts) -> DataFrame:
    """A row per document: doc_id, n_words, spans (word ranges inside occurrences), items."""
    sc, found, before = index.sparkSession.sparkContext, [], None
    for p in all_parts:
        # the answer to a part is written before the next part is read, so the driver holds one part at a time
        if before is not None:
            found.append(cut(before, "part-answers"))
        before = index.mapInArrow(_answers(sc.broadcast(p)), FOUND_SQL)
    if not found:
        return before
    both = before
    for x in found:
        both = both.unionByName(x)
    return both.groupBy("block", "place").applyInArrow(_joined, FOUND_SQL)  # a document's rows: one for each part


def proximity_matches(index: DataFrame, phrases: Phrases, within: int) -> DataFrame:
    """(doc_id, item_id, word): where all terms of an item's window stand within so many words of its rarest."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("word", pa.int64())])

    def run(batches):
        for _, block in _blocks(batches):
            rows = [{"doc_id": block.ids[d], "item_id": i, "word": p} for d, i, p in shared.value.near(block, within)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return index.mapInArrow(run, "doc_id long, item_id string, word long")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has no word inside an occurrence of a window.

    Blocks are indexed and asked in one task each, without storing the index.
    Null and empty texts are clean.
    """
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index(text_col)

    def stage(rows: DataFrame, phrases: Phrases) -> DataFrame:
        shared = sc.broadcast(phrases)

        def run(batches):
            for batch in slices(batches, BLOCK_DOCS):
                block = Block.build(list(range(batch.num_rows)), batch.column(at).to_pylist())
                w, s = shared.value.find(block)
                clean = np.ones(batch.num_rows, bool)
                clean[block.doc_of(s)] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(run, docs.schema)

    for phrases in parts(benchmark):
        docs = stage(docs, phrases)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"), scratch(spark, "postings"))
    found = exact_matches(index, parts(table(spark, sf_dir, "benchmark")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM bw),
lens AS (SELECT DISTINCT m FROM win),
dg AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d CROSS JOIN lens WHERE len(w) >= m),
occ AS (SELECT x.doc_id, x.i, x.m, win.item_id FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM dg) AS x JOIN win ON win.m = x.m AND win.g = x.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
