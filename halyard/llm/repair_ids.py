"""Token-ID output as Re-Pair grammars.

Texts are encoded in ascending id order and cut into shards.  In each shard the
most frequent pairs of neighbouring symbols are replaced by nonterminals until
none is frequent enough to save what its rule costs; rules, expansion lengths and
each document's place are stored, so any document is decoded without its
neighbours.  A round takes many pairs at once, all at least as frequent as its
level: every symbol is the first, the second or both of its most frequent pair
alone, so occurrences never overlap and a round is a few array operations.
"""

from __future__ import annotations

import gc
import json as json_format
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import give_back, pick, slices, table
from halyard.session import scratch

END_ID = 1
SHARD_IDS = 1 << 18
#: A rule takes 12 bytes (two symbols, a length), each replacement saves a symbol of 2 bytes: a pair met less often would not save what it costs
LEAST_COUNT = 7
#: The level falls by this factor when a round replaces less than 1 symbol in FEW
FALL = 8
FEW = 60
#: Bytes of text in a task's sorted range of ids, and the number of ranges from which they grow instead: sorting spills, and shards bound the rest
RANGE_BYTES = 16 << 20
MOST_RANGES = 20_000
#: Distinct words whose ids a worker remembers; when there are more it keeps those met again, or none if these are over half
CACHE_WORDS = 550_000
LONGEST_CACHED = 64
#: Rows that are encoded together, words that are given to the tokenizer as one text, and such texts at a time
BATCH_ROWS = 512
JOINED_WORDS = 256
JOINED_TEXTS = 16

_HASH_BITS = 18


def _bins(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A bin for each pair of uint32 symbols."""
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B))
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - _HASH_BITS)


def _every_other(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of ascending places of pairs, in a run of one symbol every other place from its start."""
    twin = np.nonzero(seq[at] == seq[at + 1])[0]
    if not len(twin):
        return at
    place = at[twin]
    start = np.concatenate([[True], np.diff(place) != 1])
    run = place[start][np.cumsum(start) - 1]
    keep = np.ones(len(at), bool)
    keep[twin[(place - run) & 1 == 1]] = False
    return at[keep]


def _chosen(pairs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, the most frequent first, those that are the best of both their symbols; ``size`` is above all symbols."""
    a, b = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    rank, twin = np.arange(len(pairs)), a == b
    first, second, both = (np.full(size, len(pairs)) for _ in range(3))
    np.minimum.at(both, a[twin], rank[twin])
    np.minimum.at(first, a[~twin], rank[~twin])
    np.minimum.at(second, b[~twin], rank[~twin])
    best = np.minimum(first, second)
    good = np.where(twin, both[a] < best[a], (first[a] < np.minimum(second, both)[a]) & (second[b] < np.minimum(first, both)[b]))
    return a[good].astype(np.uint32), b[good].astype(np.uint32)


def compress(ids: np.ndarray, ends: np.ndarray, first_free: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, document ends in symbols) of uint32 ids.

    ``ends`` are the documents' ends in ids; no pair spans two documents.  Rule
    k, a row of two symbols, is that of nonterminal first_free + k.  In the
    result no pair of neighbours occurs ``least`` times.
    """
    seq, ends = ids.astype(np.uint32), ends.astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules, size, level, able = [np.zeros((0, 2), np.uint32)], first_free, None, None
    while len(seq) > 1:
        if able is None:
            # a pair can't be more frequent than its bin
            h = _bins(seq[:-1], seq[1:])
            often = np.bincount(h, minlength=1 << _HASH_BITS)
            level = max(least, int(often.max()) // FALL) if level is None else max(least, level // FALL)
            able = np.nonzero((often >= level)[h] & ~last[:-1])[0]
        at = _every_other(seq, able)
        a, b = seq[at], seq[at + 1]
        keys = np.sort(a.astype(np.uint64) << np.uint64(32) | b)
        edge = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(keys)))
        found, count = keys[edge][count >= level], count[count >= level]
        if not len(found):
            if level == least:
                break
            able = None
            continue
        first, second = _chosen(found[np.argsort(-count, kind="stable")], size)
        # of chosen pairs in one bin the most frequent goes first; the others have a later round
        bins, slot = _bins(first, second), np.full(1 << _HASH_BITS, -1, np.int32)
        slot[bins[::-1]] = np.arange(len(bins))[::-1]
        own = slot[bins] == np.arange(len(bins))
        first, second = first[own], second[own]
        slot[bins] = -1
        slot[bins[own]] = np.arange(len(first))
        k = slot[_bins(a, b)]
        hit = np.nonzero(k >= 0)[0]
        hit = hit[(a[hit] == first[k[hit]]) & (b[hit] == second[k[hit]])]
        at, k = at[hit], k[hit]
        seq[at] = (size + k).astype(np.uint32)
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        place = np.cumsum(keep, dtype=np.int32)
        place -= 1
        ends = np.concatenate([[0], place + 1])[ends]
        seq, last = seq[keep], last[keep]
        # from here on pairs can only be frequent where they were, or beside a new symbol
        at, near = place[at], np.zeros(len(seq), bool)
        near[place[able[keep[able]]]] = near[at] = near[at - 1] = True
        able = np.nonzero(near[:-1] & ~last[:-1])[0] if level == least or len(at) * FEW >= len(seq) else None
        rules.append(np.stack([first, second], 1))
        size += len(first)
    return seq, np.concatenate(rules).astype(np.uint32), ends


def _in_order(rules: np.ndarray, first_free: int):
    """Numbers of rules, in groups that need no rule but those of earlier groups."""
    inner, k = rules >= first_free, np.where(rules >= first_free, rules.astype(np.int64) - first_free, 0)
    done, left = np.zeros(len(rules), bool), np.arange(len(rules))
    while len(left):
        ready = (~inner[left] | done[k[left]]).all(1)
        yield left[ready]
        done[left[ready]] = True
        left = left[~ready]


def expansion_lengths(rules: np.ndarray, first_free: int) -> np.ndarray:
    """Ids that each nonterminal stands for."""
    out, k = np.zeros(len(rules), np.int64), np.where(rules >= first_free, rules.astype(np.int64) - first_free, 0)
    for now in _in_order(rules, first_free):
        out[now] = np.where(rules[now] >= first_free, out[k[now]], 1).sum(1)
    return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] places, then the same of the next."""
    upto = np.cumsum(lengths)
    return np.repeat(starts - upto + lengths, lengths) + np.arange(upto[-1] if len(upto) else 0)


class Grammar:
    """Decodes any run of symbols; every nonterminal's ids are laid out once."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first_free: int):
        self.first_free, self.lengths = first_free, lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.flat = np.zeros(int(self.starts[-1]), np.uint32)
        for now in _in_order(rules, first_free):
            self.flat[_spread(self.starts[now], lengths[now])] = self.decode(rules[now].ravel())

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        inner = symbols >= self.first_free
        k = np.where(inner, symbols.astype(np.int64) - self.first_free, 0)
        n = np.where(inner, self.lengths[k] if len(self.lengths) else 1, 1)
        out = np.repeat(symbols, n).astype(np.uint32)
        if inner.any():
            out[np.repeat(inner, n)] = self.flat[_spread(self.starts[k[inner]], n[inner])]
        return out


#: The tokenizer files whose ids are those of their white-space-separated words one after the other: these two steps
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Stands between words that are encoded as one text; words that hold it are encoded alone
_BETWEEN = "\x01"
#: Punctuation that ends words: never in one piece with the letters before it, nor the end of a special token
_TAIL = "!\"#$%&()*+,-./:;<=?@[\\]^_`{|}~"


class Encoder:
    """Ids of texts as uint32 arrays; words met before are not encoded again.

    With the word tokenizer a text's ids are those of its words, and a word's
    are those of its letters and of the marks behind them.  Words of a-z alone,
    which its normalizer and splitter leave as they are, skip both; other words
    of letters go in one text and are told apart by the ends of words; the rest
    by a mark between them.  Any other tokenizer encodes whole texts.
    """

    def __init__(self, json: str, end_id: int = END_ID):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        def beside() -> Tokenizer:
            """A tokenizer of words of letters on the same model in memory; one that has the added tokens too, should letters make one."""
            return Tokenizer.from_str(json) if any(t.isalpha() for t in self.special) else Tokenizer(self.full.model)

        read = json_format.loads(json)
        self.full, self.end_id = Tokenizer.from_str(json), end_id
        self.size = max(self.full.get_vocab_size(with_added_tokens=True), end_id + 1)
        suffix = read["model"].get("end_of_word_suffix")
        self.by_word = read.get("normalizer") == WORD_NORMALIZER and read.get("pre_tokenizer") == WORD_SPLITTER and bool(suffix)
        self.special = [t["content"] for t in read.get("added_tokens", [])]
        if self.by_word:
            self.lean = beside()
            self.lean.normalizer = None
            self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.letters = beside()
            self.letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
            self.letters.pre_tokenizer = self.lean.pre_tokenizer
            self.ends_word = np.zeros(self.size, bool)
            self.ends_word[[k for w, k in read["model"]["vocab"].items() if w.endswith(suffix)]] = True
            self.mark = self.full.encode(_BETWEEN, add_special_tokens=False).ids
            self.ends: dict[str, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Piece number -> ids: piece 0 has none, piece 1 is the document's end."""
        self.known: dict[str, int] = {"": 0}
        self.flat, self.starts, self.lengths, self.n_flat, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0, 0
        self.again = np.zeros(CACHE_WORDS, bool)
        self._learn(np.array([self.end_id]), np.array([0, 1]))

    def _forget_most(self) -> None:
        """Forgets the pieces that were met in one batch alone."""
        kept = [(w, k) for w, k in self.known.items() if w and k < len(self.again) and self.again[k]]
        if 2 * len(kept) > CACHE_WORDS:
            kept = []
        old = np.array([k for _, k in kept], np.int64)
        lengths = self.lengths[old]
        ids = self.flat[_spread(self.starts[old], lengths)]
        self._forget()
        self._learn(ids, lengths)
        self.known.update(zip([w for w, _ in kept], range(2, self.n)))

    def _ends_letters(self, c: str) -> bool:
        """Whether a word's piece that ends in this character ends before a mark."""
        if c not in self.ends:
            read = self.full.normalizer.normalize_str(f"{c}.")
            self.ends[c] = self.full.pre_tokenizer.pre_tokenize_str(read)[-1][0] == "."
        return self.ends[c]

    def _learn(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(lengths) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.starts[self.n : self.n + len(lengths)] = self.n_flat + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(lengths)] = lengths
        self.n_flat, self.n = self.n_flat + len(ids), self.n + len(lengths)

    @staticmethod
    def _ids(found) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[np.array(e.ids, np.int64) for e in found]])

    def _joined(self, words: list[str], tokenizer, sep: str):
        texts = [sep.join(words[k : k + JOINED_WORDS]) for k in range(0, len(words), JOINED_WORDS)]
        # what the library returns takes many times the ids' room
        parts = [self._ids(tokenizer.encode_batch_fast(texts[k : k + JOINED_TEXTS], add_special_tokens=False)) for k in range(0, len(texts), JOINED_TEXTS)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def _of_letters(self, words: list[str], tokenizer) -> bool:
        """Learns words of one piece each; not if the pieces are more or fewer."""
        ids = self._joined(words, tokenizer, " ")
        last = np.nonzero(self.ends_word[ids])[0] if len(ids) else np.zeros(0, np.int64)
        if len(last) != len(words):
            return False
        self._learn(ids, np.diff(np.concatenate([[-1], last])))
        return True

    def _any(self, words: list[str]) -> None:
        """Learns words of whatever characters."""
        able = len(self.mark) == 1 and not any(_BETWEEN in w or any(t in w for t in self.special) for w in words)
        for k in range(0, len(words), JOINED_WORDS):
            part = words[k : k + JOINED_WORDS]
            ids = self._joined(part, self.full, f" {_BETWEEN} ") if able else np.zeros(0, np.int64)
            at = np.nonzero(ids == self.mark[0])[0] if able else ids
            if able and len(at) == len(part) - 1:
                lengths = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
                self._learn(np.delete(ids, at), lengths)
            else:
                found = [np.array(e.ids, np.int64) for e in self.full.encode_batch_fast(part, add_special_tokens=False)]
                self._learn(np.concatenate(found), np.array([len(f) for f in found]))

    def _add(self, pieces: list[str]) -> None:
        """Numbers pieces that are not known yet."""
        plain, letters, rest = [], [], []
        ends = self._ends_letters
        for w in pieces:
            (rest if not w.isalpha() else plain if w.isascii() else letters if all(map(ends, set(w))) else rest).append(w)
        for words, read, tokenizer in ((plain, [w.lower() for w in plain], self.lean), (letters, letters, self.letters)):
            if words and self._of_letters(read, tokenizer):
                self.known.update(zip(words, range(self.n - len(words), self.n)))
            else:
                rest += words
        if rest:
            self._any(rest)
            self.known.update(zip(rest, range(self.n - len(rest), self.n)))

    def _heads(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, list[str]]:
        """The words without the marks behind them where these are pieces of their own; which words these are, and their marks."""
        heads = pc.utf8_rtrim(words, _TAIL)
        n = pc.binary_length(heads).to_numpy(zero_copy_only=False)
        cut = (n > 0) & (n < pc.binary_length(words).to_numpy(zero_copy_only=False))
        ends = pc.utf8_slice_codeunits(heads.filter(pa.array(cut)), -1).dictionary_encode()
        apart = np.array([self._ends_letters(c) for c in ends.dictionary.to_pylist()], bool)
        cut[cut] = apart[ends.indices.to_numpy(zero_copy_only=False)]
        at, cut = np.nonzero(cut)[0], pa.array(cut)
        tails = [w[len(h) :] for w, h in zip(words.filter(cut).to_pylist(), heads.filter(cut).to_pylist())]
        return pc.if_else(cut, heads, words).dictionary_encode(), at, tails

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each text's number of ids), end ids included."""
        if not self.by_word:
            found = self.full.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            parts = [np.array([*e.ids, self.end_id], np.uint32) for e in found]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        if len(self.known) > CACHE_WORDS:
            self._forget_most()
        known, before = self.known, min(self.n, len(self.again))
        heads, at, tails = self._heads(coded.dictionary)
        names = heads.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, names))
        new = list({p for p, k in zip(names, found) if k is None} | {p for p in set(tails) if p not in known})
        if new:
            self._add(new)
            found = list(map(known.__getitem__, names))
        piece = np.zeros((len(heads), 2), np.int64)
        found, tails = np.array(found, np.int64), [known[p] for p in tails]
        piece[:, 0], piece[at, 1] = found[heads.indices.to_numpy(zero_copy_only=False)], tails
        for met in (found, piece[at, 1]):
            self.again[met[met < before]] = True
        for w in new:
            if len(w) > LONGEST_CACHED:
                del known[w]
        # the pieces of all words in order, an end behind each text
        of = piece[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        of = np.insert(of, 2 * np.cumsum(counts), 1)
        n = self.lengths[of]
        ids = self.flat[_spread(self.starts[of], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        last = 2 * np.cumsum(counts) + np.arange(1, len(counts) + 1)
        return ids, np.diff(np.concatenate([[0], total[last]]))


_ENCODERS: dict = {}


def _encoder(json: str, end_id: int) -> Encoder:
    key = (zlib.crc32(json.encode()), len(json), end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(json, end_id)
    return _ENCODERS[key]


def _release() -> None:
    """A worker outlives a stage: what it remembers of words goes back to the system before others need the memory."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        give_back()


SHARD = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("first_free", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.binary()), ("doc_ends", pa.binary()), ("rules", pa.binary()), ("expansions", pa.binary()), ("symbols", pa.binary())])
SHARD_SQL = "part int, no int, start_in_part long, n_ids long, first_free long, doc_ids array<long>, doc_lengths binary, doc_ends binary, rules binary, expansions binary, symbols binary"


def pack_shard(part: int, no: int, start: int, first_free: int, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> dict:
    """A shard's row: 32-bit little-endian arrays, symbols in 16 or 24 bits where they fit."""
    symbols, rules, ends = compress(ids, np.cumsum(lengths), first_free)
    return {
        "part": part, "no": no, "start_in_part": start, "n_ids": len(ids), "first_free": first_free, "doc_ids": doc_ids,
        "doc_lengths": lengths.astype("<u4").tobytes(), "doc_ends": ends.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(),
        "expansions": expansion_lengths(rules, first_free).astype("<u4").tobytes(), "symbols": _packed(symbols, first_free + len(rules)),
    }


def _width(size: int) -> int:
    return 2 if size <= 1 << 16 else 3 if size <= 1 << 24 else 4


def _packed(symbols: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : _width(size)]).tobytes()


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(raw) // _width(size), 4), np.uint8)
    wide[:, : _width(size)] = np.frombuffer(raw, np.uint8).reshape(-1, _width(size))
    return wide.view("<u4").ravel()


class Shard:
    """A shard read back: whole, or any document alone."""

    def __init__(self, row: dict):
        self.row, self.lengths, self.ends = row, np.frombuffer(row["doc_lengths"], "<u4"), np.frombuffer(row["doc_ends"], "<u4")
        rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.grammar = Grammar(rules, np.frombuffer(row["expansions"], "<u4").astype(np.int64), row["first_free"])
        self.symbols = _unpacked(row["symbols"], row["first_free"] + len(rules))

    def document(self, k: int) -> np.ndarray:
        return self.grammar.decode(self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]])

    def documents(self):
        ids = self.grammar.decode(self.symbols)
        at = 0
        for n in self.lengths.tolist():
            yield ids[at : at + n]
            at += n


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Writes the shards of all documents in ascending id order, null ids first.

    * null and empty texts are documents of the end id alone;
    * rows with equal ids stand in order of a hash of their text; equal rows are
      interchangeable; a document longer than a shard is a shard of its own;
    * other columns are not read; an empty table writes no shard.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        json = spark.sparkContext.broadcast(file.read())  # one vocabulary file
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, min(MOST_RANGES, math.ceil(size / RANGE_BYTES)))
    # a range bound may fall inside an id, and even inside equal rows
    keys = [F.asc("doc_id"), F.xxhash64("text"), F.spark_partition_id()]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _encoder(json.value, end_id)
        no = start = size = 0
        doc_ids, ids, lengths = [], [], []

        def shard():
            return pa.RecordBatch.from_pylist([pack_shard(part, no, start, encoder.size, doc_ids, np.concatenate(ids), np.array(lengths, np.int64))], SHARD)

        for batch in slices(batches, BATCH_ROWS):
            found, counts = encoder.encode(batch.column(1))
            names, at = batch.column(0).to_pylist(), 0
            for name, n in zip(names, counts.tolist()):
                if size and size + n > shard_ids:
                    yield shard()
                    no, start, size, doc_ids, ids, lengths = no + 1, start + size, 0, [], [], []
                doc_ids.append(name)
                ids.append(found[at : at + n])
                lengths.append(n)
                size, at = size + n, at + n
        if size:
            yield shard()

    dealt.mapInArrow(run, SHARD_SQL).write.parquet(path)


def read_ids(spark: SparkSession, path: str, digest) -> DataFrame:
    """(part, start_in_part, doc_id, n_tokens, value): decoded from the shards, value = digest(ids)."""
    schema = pa.schema([("part", pa.int32()), ("start_in_part", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("value", pa.int64())])

    def run(batches):
        _release()
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            shard = Shard(row)
            n = shard.lengths.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([row["part"]] * len(n), row["start_in_part"] + np.cumsum(n) - n, row["doc_ids"], n, [digest(d) for d in shard.documents()]), schema)], schema=schema)

    return spark.read.schema(SHARD_SQL).parquet(path).mapInArrow(run, "part int, start_in_part long, doc_id long, n_tokens long, value long")


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def written_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""
    sums = spark.read.schema(SHARD_SQL).parquet(path).groupBy("part").agg(F.sum("n_ids")).collect()  # a row for each write task
    before, at = {}, 0
    for part, n in sorted(tuple(r) for r in sums):
        before[part] = at
        at += n
    rows = read_ids(spark, path, crc32_of)
    if not before:
        return rows.select("doc_id", F.col("start_in_part").alias("start"), "n_tokens", F.col("value").alias("ids_crc32"))
    offsets = spark.createDataFrame(sorted(before.items()), "o_part int, o_start long")
    rows = rows.join(F.broadcast(offsets), rows.part == offsets.o_part)
    return rows.select("doc_id", (F.col("o_start") + F.col("start_in_part")).alias("start"), "n_tokens", F.col("value").alias("ids_crc32"))


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes docs to the shared folder and returns what reads back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    path = scratch(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer_path)
    return written_documents(docs.sparkSession, path)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
