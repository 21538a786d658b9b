"""Language identification by cross-parsing entropy.

Texts are lower-cased and every run of characters other than letters counts as
one blank.  A suffix automaton of each language's labelled text accepts that
text's substrings.  Another text is parsed greedily into the longest phrases that a
language's text contains; the fewer phrases, normalised by the length of the
language's text, the closer the two.  Every label is learned and every letter of
its sample has a symbol.  An automaton parses many texts at once, a character per step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import crc32_of_id, per_batch, pick, table

UNKNOWN = "und"
#: Bounds of the labelled sample: documents of a language, characters of one that is learned whole, characters of a language
SAMPLE_DOCS = 64
DOC_CHARS = 4096
TRAIN_CHARS = 16384
#: Cells of all languages' dense tables together; a language whose share is too small has a sparse one
DENSE_CELLS = 1 << 25
#: Texts are parsed in blocks of so many characters side by side; the parse is then mended over the blocks' edges
BLOCK = 512


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Each state's transitions {symbol: state} in the automaton of all substrings."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Automaton:
    """One language's automaton over its own letters: a dense table, or sorted transitions where that were too large."""

    def __init__(self, coded: np.ndarray, size: int, cells: int):
        letters = np.unique(coded[coded > 1])
        #: 0 is a blank, 1 any letter that the language lacks; the last symbol stands after a text's end
        self.local = np.ones(size, np.int32)
        self.local[0], self.local[letters], self.local[-1] = 0, np.arange(2, len(letters) + 2), len(letters) + 2
        self.size = len(letters) + 3
        states = suffix_automaton(self.local[coded].tolist())
        at = np.array([k * self.size + c for k, row in enumerate(states) for c in row], np.int64)
        to = np.array([t for row in states for t in row.values()], np.int64)
        root = np.full(self.size, -1, np.int64)
        root[list(states[0])] = list(states[0].values())
        # no longer phrase: it ends here, and the character begins the next one, or is one if the language lacks it
        self.miss = (np.maximum(root, 0) * self.size << 2) | (1 + (root < 0))
        self.table = None
        if len(states) * self.size <= cells:
            self.table = np.tile(self.miss, len(states))
            self.table[at] = to * self.size << 2
            self.table[: self.size][root < 0] = 1
            self.table[self.size - 1 :: self.size] = np.arange(len(states)) * self.size << 2
            if self.table.max() < 2**31:
                self.table = self.table.astype(np.int32)
        else:
            order = np.argsort(at)
            self.at, self.to = at[order], to[order] * self.size << 2

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states, shifted by two bits, with the phrases that end; states are multiples of size."""
        if self.table is not None:
            return self.table[state + symbol]
        if not len(self.at):
            got = np.where(state == 0, 1, self.miss[symbol])
        else:
            key = state + symbol
            k = np.minimum(np.searchsorted(self.at, key), len(self.at) - 1)
            got = np.where(self.at[k] == key, self.to[k], np.where(state == 0, 1, self.miss[symbol]))
        return np.where(symbol == self.size - 1, state << 2, got)


class Languages:
    """The labelled samples' automata; deterministic for equal samples."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        texts = {name: samples[name].lower() for name in self.names}
        self.chars = np.array([max(2, len(texts[n])) for n in self.names])
        points = np.unique(np.frombuffer("".join(texts.values()).encode("utf-32-le", "surrogatepass"), np.uint32))
        usual = [p for p in points.tolist() if chr(p).isalpha()]
        #: 0 is a blank, 1 any letter that no sample has; the last symbol stands after a text's end
        self.symbol_of = np.fromiter((chr(p).isalpha() for p in range(0x110000)), np.int32, 0x110000)
        self.symbol_of[usual] = np.arange(2, len(usual) + 2)
        self.size = len(usual) + 3
        self.automata = [Automaton(self.symbols(texts[name]), self.size, DENSE_CELLS // len(self.names)) for name in self.names]

    def symbols(self, text: str) -> np.ndarray:
        found = self.symbol_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = found > 0
        keep[1:] |= found[:-1] > 0
        return found[keep]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """[language, text]: phrases of each text's greedy parse."""
        coded = [self.symbols(t.lower()) for t in texts]
        lanes = [max(1, -(-len(c) // BLOCK)) for c in coded]
        grid = np.full((sum(lanes), BLOCK), self.size - 1, np.int32)
        flat, at = grid.ravel(), 0
        for c, n in zip(coded, lanes):
            flat[at : at + len(c)] = c
            at += n * BLOCK
        longest = min(BLOCK, max((len(c) for c in coded), default=0))
        steps = np.ascontiguousarray(grid.T[:longest])
        count = np.zeros((len(self.automata), grid.shape[0]), np.int64)
        first = np.concatenate([[0], np.cumsum(lanes)[:-1]])
        inner = np.ones(grid.shape[0], bool)
        inner[first] = False
        for found, automaton in zip(count, self.automata):
            kind = np.int64 if automaton.table is None else automaton.table.dtype
            local = automaton.local[steps]
            seen = np.zeros((longest + 1, grid.shape[0]), kind)
            for k in range(longest):
                got = automaton.step(seen[k], local[k])
                found += got & 3
                seen[k + 1] = got >> 2
            # a block began at a fresh phrase: go on from the block before instead, up to where both parses agree
            start = np.zeros(grid.shape[0], kind)
            while len(rows := np.nonzero(inner & (start != np.concatenate([[0], seen[longest][:-1]]).astype(kind)))[0]):
                state = start[rows] = seen[longest][rows - 1]
                own = rows
                for k in range(longest):
                    differ = state != seen[k][own]
                    if not differ.any():
                        break
                    own, state = own[differ], state[differ]
                    before, after = automaton.step(seen[k][own], local[k][own]), automaton.step(state, local[k][own])
                    found[own] += (after & 3).astype(np.int64) - (before & 3)
                    seen[k][own] = state
                    state = after >> 2
                else:
                    seen[longest][own] = state
            last = np.append(first[1:], grid.shape[0]) - 1
            found[last] += seen[longest][last] != 0
        return np.add.reduceat(count, first, axis=1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score from 0 to 1); und and 0 where there is no letter or nothing was learned."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        able = [k for k, t in enumerate(texts) if t and has_letter(t)] if self.names else []
        if able:
            bits = self.phrases([texts[k] for k in able]) * np.log2(self.chars)[:, None]
            order = np.argsort(bits, axis=0, kind="stable")
            best = np.take_along_axis(bits, order[:1], 0)[0]
            second = np.take_along_axis(bits, order[1:2], 0)[0] if len(self.names) > 1 else best * 2
            for k, lang, a, b in zip(able, order[0], best, second):
                out[k] = (self.names[lang], float(min(1.0, 1 - a / b)) if b > 0 else 0.0)
        return out


_MODELS: dict = {}


def _model(samples: tuple) -> Languages:
    """Built once in each worker from the samples, which are small."""
    if samples not in _MODELS:
        _MODELS.clear()
        _MODELS[samples] = Languages(dict(samples))
    return _MODELS[samples]


def learn(docs: DataFrame) -> tuple:
    """A bounded sample of text for each label of docs(doc_id, text, lang).

    Rows without text or label teach nothing.  A language's documents of up to
    DOC_CHARS characters are drawn by a hash below a bound set from their count,
    and taken whole until SAMPLE_DOCS of them, or TRAIN_CHARS characters, are
    there; a language of longer ones alone is learned from its shortest.
    Repeated rows count once; an empty table teaches nothing.
    """
    usable = docs.where("text is not null and lang is not null").withColumn("size", F.char_length("text"))
    counts = usable.groupBy("lang").agg(F.count_if(F.col("size") <= DOC_CHARS).alias("short"), F.min("size").alias("least")).collect()
    if not counts:
        return ()
    rates = docs.sparkSession.createDataFrame([(r["lang"], 2.0 * SAMPLE_DOCS / max(1, r["short"]), DOC_CHARS if r["short"] else r["least"]) for r in counts], "lang string, rate double, most long")
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = usable.join(F.broadcast(rates), "lang").withColumn("draw", draw).where("size <= most and draw < rate").select("lang", "draw", "text").distinct()
    samples: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["draw"], r["text"])):
        got = samples.setdefault(r["lang"], [])
        if not got or (len(got) < SAMPLE_DOCS and sum(map(len, got)) + len(r["text"]) <= TRAIN_CHARS):
            got.append(r["text"])
    return tuple((lang, " ".join(texts)) for lang, texts in sorted(samples.items()))


def identify(docs: DataFrame, samples: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row, from the whole text.

    Null, empty and letterless texts are ``und`` with score 0; ties go to the
    first name; rows that repeat, null ids too, each get their row; an empty table
    gives none; only the id and the text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batch):
        found = _model(shared.value).predict(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(per_batch(run, schema), "doc_id long, lang_pred string, score double")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc32_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    samples = learn(pick(docs, doc_id="doc_id", text="text", lang="lang").where(~held))
    return identify(docs, samples).select("doc_id", held.alias("held_out"), "lang_pred", "score")
