"""Language-model scores from Brown class-based bigrams.

P(text) is the product over its words of P(class | class before) P(word | class).
Every word of the training corpus has a class of its own choosing.  The most
frequent words are clustered by exchange, with the endings of all others as
stand-ins, until no move raises the likelihood.  Then each other word, however
rare, goes to the class that gives the class bigrams the largest likelihood,
from the counts of the classes on both its sides in the whole corpus.  Classes of
these words are a distributed table; only the most frequent words, a bounded
number, are sent to the tasks, the rest is joined.  Counts of class bigrams come
from all training texts once every word has its class.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import crc32_of_id, lower_words, per_batch, pick, slices, table
from halyard.session import cut, dealt, discard

#: Sizes of the fixed tables: words and endings that are clustered first, classes, words sent to every task
WORD_UNITS = 768
ENDING_UNITS = 254
CLASSES = 64
CORE_WORDS = 50_000
ADDED = 0.1
#: Counts of a word's neighbours up to which a word's gains are looked up
SMALL = 16
#: Places of neighbours that a task holds before it adds them up
PLACES = 500_000
#: Distinct words a task counts before it hands them on
FLUSH = 300_000
#: The end token; no word is empty
END = b""
#: Bytes of a rare word's ending
ENDING = 2


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c long): how often each token occurs in docs(text), the end token included."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def emit(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], schema=schema)

    def run(batches):
        found: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found.update(lower_words(text))
            found[END] += batch.num_rows
            if len(found) > FLUSH:
                yield emit(found)
                found = Counter()
        if found:
            yield emit(found)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Classes of units from their bigram counts; unit 0 keeps class 0 to itself.

    Each unit in turn moves to the class that gives the class bigrams the
    largest likelihood, until a sweep moves none.
    """
    n = len(pairs)
    classes = max(1, min(classes - 1, n - 1)) + 1
    of = np.concatenate([[0], 1 + np.arange(n - 1) % (classes - 1)]) if n > 1 else np.zeros(n, np.int64)
    xlogx = _xlogx
    pairs = pairs.astype(float)
    table_ = np.zeros((classes, classes))
    np.add.at(table_, (of[:, None], of[None, :]), pairs)
    weight = pairs.sum(1) + pairs.sum(0)
    moved, least = True, 1e-6 + 1e-13 * float(xlogx(table_.sum()))  # more than what rounding makes of an even gain
    while moved:  # each move raises the likelihood, so this ends
        moved = False
        for w in range(1, n):
            if not weight[w]:
                continue
            own, now = pairs[w, w], of[w]
            row = np.bincount(of, pairs[w], classes)
            col = np.bincount(of, pairs[:, w], classes)
            row[now] -= own
            col[now] -= own
            table_[now] -= row
            table_[:, now] -= col
            table_[now, now] -= own
            # gain of putting w in class g, the diagonal cell apart
            gain = (xlogx(table_ + row[None, :]) - xlogx(table_)).sum(1) + (xlogx(table_ + col[:, None]) - xlogx(table_)).sum(0)
            d = np.diag(table_)
            gain += xlogx(d + row + col + own) - xlogx(d + row) - xlogx(d + col) + xlogx(d)
            # the other classes keep what precedes and follows w, wherever it goes
            rs, cs = table_.sum(1) + col, table_.sum(0) + row
            gain -= xlogx(rs + row.sum() + own) - xlogx(rs) + xlogx(cs + col.sum() + own) - xlogx(cs)
            gain[0] = -np.inf
            to = int(np.argmax(gain))
            if gain[to] <= gain[now] + least:
                to = int(now)
            table_[to] += row
            table_[:, to] += col
            table_[to, to] += own
            moved |= to != now
            of[w] = to
    return of


class Units:
    """Numbers of units: 0 the end token, then words, then endings, last any other ending."""

    def __init__(self, words: list[bytes], endings: list[bytes]):
        self.words = {w: k for k, w in enumerate(words, 1)}
        self.endings = {e: k for k, e in enumerate(endings, 1 + len(words))}
        self.other = 1 + len(words) + len(endings)
        self.size = self.other + 1

    def of(self, word: bytes) -> int:
        return self.words.get(word) or self.endings.get(word[-ENDING:], self.other)


def unit_pairs(docs: DataFrame, units: Units) -> np.ndarray:
    """Counts of neighbouring units in all docs(text); every text stands between end tokens."""
    size = units.size
    shared = docs.sparkSession.sparkContext.broadcast(units)
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        units, total = shared.value, np.zeros(size * size, np.int64)
        known: dict[bytes, int] = {}
        for batch in slices(batches):
            codes = [0]
            for text in batch.column(0).to_pylist():
                ws = lower_words(text)
                for w in set(ws).difference(known):
                    known[w] = units.of(w)
                codes.extend([known[w] for w in ws])
                codes.append(0)
            c = np.array(codes, np.int64)
            total += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
            if len(known) > FLUSH:
                known = {}
        at = np.nonzero(total)[0]
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], schema=schema)

    rows = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # size * size rows at most
    out = np.zeros(size * size, np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def _per_class(classes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    g = int(classes.max()) + 1 if len(classes) else 1
    out = np.zeros((g, g))
    np.add.at(out, (classes[:, None], classes[None, :]), pairs.astype(float))
    return out


def neighbours(docs: DataFrame, units: Units, classes: np.ndarray) -> DataFrame:
    """(word, slots, counts) of words that are no units: how often which class stands before (slot = class) or behind (slot = CLASSES + class).

    A word has a row for each time that a task handed on what it had counted.
    """
    shared = docs.sparkSession.sparkContext.broadcast((units, classes))
    schema = pa.schema([("word", pa.binary()), ("slots", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        units, classes = shared.value
        known, names, of = {}, [END], [0]
        held, n_held, none = [], 0, (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        sums = none

        def summed():
            """Keys and counts of all that is held, which is given up: the sums so far, and keys that count once each."""
            keys, n = sums
            new = np.sort(np.concatenate([np.zeros(0, np.int64), *held]))
            held.clear()
            start = np.nonzero(np.concatenate([[True], new[1:] != new[:-1]]))[0] if len(new) else np.zeros(0, np.int64)
            times = np.diff(np.append(start, len(new))).astype(np.uint32)
            new = new[start]
            at = np.searchsorted(keys, new)
            known = at < len(keys)
            known[known] = keys[at[known]] == new[known]
            n[at[known]] += times[known]
            at, new, times = at[~known], new[~known], times[~known]
            return np.insert(keys, at, new), np.insert(n, at, times)

        def emit():
            keys, n = summed()
            word = keys // (2 * CLASSES)
            start = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
            slots, counts = (keys % (2 * CLASSES)).astype(np.uint8).tobytes(), n.astype("<u4").tobytes()
            upto = np.append(start, len(keys))
            for k in range(0, len(start), 1 << 14):
                at = upto[k : k + (1 << 14) + 1]
                cut_at = lambda raw, w: pa.array([raw[w * x : w * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in word[at[:-1]].tolist()], pa.binary()), cut_at(slots, 1), cut_at(counts, 4)], schema=schema)

        for batch in slices(batches):
            codes = [0]
            for text in batch.column(0).to_pylist():
                ws = lower_words(text)
                for w in set(ws).difference(known):
                    known[w] = len(names)
                    names.append(w)
                    of.append(units.of(w))
                codes.extend([known[w] for w in ws])
                codes.append(0)
            c, unit = np.array(codes, np.int64), np.array(of, np.int64)
            cls, rest = classes[unit[c]], np.nonzero((unit > len(units.words))[c])[0]
            keys = c[rest] * (2 * CLASSES)
            held.append(np.concatenate([keys + cls[rest - 1], keys + CLASSES + cls[rest + 1]]))
            n_held += 2 * len(rest)
            if len(known) > FLUSH:
                yield from emit()
                known, names, of, n_held, sums = {}, [END], [0], 0, none
            elif n_held > PLACES:
                sums, n_held = summed(), 0
        yield from emit()

    return docs.select("text").mapInArrow(run, "word binary, slots binary, counts binary")


def best_classes(table_: np.ndarray, word: np.ndarray, slot: np.ndarray, n: np.ndarray, now: np.ndarray) -> np.ndarray:
    """The class of each word that gains most; ``word`` (ascending, from 0), ``slot`` and ``n`` are its counts of neighbours, ``now`` its class in table_.

    A word's own counts are taken out of its present class first; it stays there
    unless another gains more.  Class 0 is the end token's alone.
    """
    g = len(table_)
    if g < 2 or not len(now):
        return now
    base = np.zeros((2 * CLASSES, g))
    base[:g], base[CLASSES : CLASSES + g] = table_, table_.T  # a class h before: table_[h, :]; behind: table_[:, h]
    of_base = _xlogx(base)
    small = np.stack([_xlogx(base + k) - of_base for k in range(1, SMALL + 1)])
    gains = small[np.minimum(n, SMALL) - 1, slot]
    large = np.nonzero(n > SMALL)[0]
    gains[large] = _xlogx(base[slot[large]] + n[large, None]) - of_base[slot[large]]
    here = base[slot, now[word]]
    gains[np.arange(len(word)), now[word]] = _xlogx(here) - _xlogx(np.maximum(here - n, 0))
    total = np.add.reduceat(gains, np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0], axis=0)
    # the cell of a class with itself, where a word has that class on both sides
    sides = np.zeros((2, len(now), g))
    sides[slot // CLASSES, word, slot % CLASSES] = n
    w, h = np.nonzero((sides[0] > 0) & (sides[1] > 0))
    x, y = sides[0, w, h], sides[1, w, h]
    d = np.where(h == now[w], np.maximum(table_[h, h] - x - y, 0), table_[h, h])
    apart = np.where(h == now[w], 2 * _xlogx(table_[h, h]) - _xlogx(np.maximum(table_[h, h] - x, 0)) - _xlogx(np.maximum(table_[h, h] - y, 0)), _xlogx(d + x) + _xlogx(d + y) - 2 * _xlogx(d))
    total[w, h] += _xlogx(d + x + y) - _xlogx(d) - apart
    c = sides[1].sum(1)[:, None]
    for margin in (table_.sum(1), table_.sum(0)):
        own = np.maximum(margin[now] - c[:, 0], 0)
        loss = _xlogx(margin + c) - _xlogx(margin)
        loss[np.arange(len(now)), now] = _xlogx(own + c[:, 0]) - _xlogx(own)
        total -= loss
    total[:, 0] = -np.inf
    to = total.argmax(1)
    rows = np.arange(len(now))
    return np.where((total[rows, to] > total[rows, now] + 1e-9) | (now == 0), to, now)


def placed_words(met: DataFrame, units: Units, classes: np.ndarray, table_: np.ndarray) -> DataFrame:
    """(word, c, class) of each word of neighbours()."""
    shared = met.sparkSession.sparkContext.broadcast((units, classes, table_))
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("class", pa.int32())])

    def run(batches):
        units, classes, table_ = shared.value

        def placed(rows):
            """Rows as (word, slots, counts), those of a word together."""
            names, number, slots, counts = [], [], b"".join([r[1] for r in rows]), b"".join([r[2] for r in rows])
            for w, *_ in rows:
                if not names or names[-1] != w:
                    names.append(w)
                number.append(len(names) - 1)
            word = np.repeat(np.array(number, np.int64), [len(r[1]) for r in rows])
            key, at = np.unique(word * (2 * CLASSES) + np.frombuffer(slots, np.uint8), return_inverse=True)
            n = np.bincount(at, np.frombuffer(counts, "<u4"), len(key)).astype(np.int64)
            word, slot = key // (2 * CLASSES), key % (2 * CLASSES)
            now = classes[[units.of(w) for w in names]]
            c = np.bincount(word, np.where(slot >= CLASSES, n, 0), len(names)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(c), pa.array(best_classes(table_, word, slot, n, now).astype(np.int32))], schema=schema)

        held = []
        for batch in slices(batches, 4096):
            held += zip(*(batch.column(k).to_pylist() for k in range(3)))
            ends = next((k for k in range(len(held) - 1, 0, -1) if held[k][0] != held[k - 1][0]), 0)
            if ends:
                yield placed(held[:ends])
                held = held[ends:]
        if held:
            yield placed(held)

    return met.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, c long, class int")


class Vocabulary:
    """What tasks need to know of words: units with their classes, and the core words with counts and classes."""

    def __init__(self, units: Units, classes: np.ndarray, core: dict[bytes, tuple[int, int]], tokens: int, types: int, types_of: np.ndarray):
        self.units, self.class_of, self.core, self.tokens, self.types, self.types_of = units, classes, core, tokens, types, types_of


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The classes of all words of docs(text): (word, c, class) of those that are no units, and the rest."""
    counts = cut(word_counts(docs), "word-counts")
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.octet_length("word") > 0).orderBy(F.desc("c"), "word").limit(WORD_UNITS).toArrow()
    words, times = top["word"].to_pylist(), top["c"].to_pylist()
    named = docs.sparkSession.createDataFrame([(bytearray(w),) for w in words], "word binary")
    ending = F.expr(f"substring(word, greatest(octet_length(word) - {ENDING - 1}, 1), {ENDING})")
    rest = counts.where(F.octet_length("word") > 0).join(F.broadcast(named), "word", "left_anti")
    often = rest.groupBy(ending.alias("ending")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "ending").limit(ENDING_UNITS).collect()
    units = Units(words, [bytes(r["ending"]) for r in often])
    discard(counts)
    pairs = unit_pairs(docs, units)
    classes = exchange(pairs)
    table_ = _per_class(classes, pairs)
    placed = cut(placed_words(neighbours(docs, units, classes), units, classes, table_), "word-classes")
    core = {END: (int(pairs[:, 0].sum()), 0)} | {w: (c, int(classes[k])) for k, (w, c) in enumerate(zip(words, times), 1)}
    more = placed.orderBy(F.desc("c"), "word").limit(max(0, CORE_WORDS - len(words))).toArrow()
    core |= zip(more["word"].to_pylist(), zip(more["c"].to_pylist(), more["class"].to_pylist()))
    types_of = np.bincount(classes[: 1 + len(words)], minlength=len(table_)).astype(float)
    for r in placed.groupBy("class").count().collect():  # CLASSES rows at most
        types_of[r["class"]] += r["count"]
    return Vocabulary(units, classes, core, int(tokens), int(types), types_of), placed


CODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("codes", pa.binary()), ("rare", pa.list_(pa.binary())), ("times", pa.binary()), ("usual", pa.binary())])
CODED_SQL = "row long, doc_id long, n_tokens long, known long, logs double, codes binary, rare array<binary>, times binary, usual binary"
#: Rare words of a text up to which its codes have 16 bits
NARROW = 1 << 15


def _coded(shared):
    """Each text's words as codes: the class of a core word, -1 - k of the text's rare word k."""

    def run(batches):
        from pyspark import TaskContext

        m: Vocabulary = shared.value
        row = TaskContext.get().partitionId() << 40
        number = {w: k for k, w in enumerate(m.core)}
        core_class = np.array([g for _, g in m.core.values()], np.int64)
        core_log = np.log10(np.array([c for c, _ in m.core.values()], float) + ADDED)
        end = number[END]
        end_known = int(m.core[END][0] > 0)
        for batch in slices(batches):
            out = {f.name: [] for f in CODED}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = lower_words(text)
                at = np.array([number.get(w, -1) for w in ws], np.int64)
                is_core = at >= 0
                codes = np.where(is_core, core_class[at], 0)
                rest = [ws[k] for k in np.nonzero(~is_core)[0].tolist()]
                found = Counter(rest)
                place = {w: -1 - k for k, w in enumerate(found)}
                codes[~is_core] = [place[w] for w in rest]
                out["row"].append(row)
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(ws) + 1)
                out["known"].append(int(is_core.sum()) + end_known)
                out["logs"].append(float(core_log[at[is_core]].sum() + core_log[end]))
                out["codes"].append(codes.astype("<i2" if len(found) <= NARROW else "<i4").tobytes())
                out["rare"].append(list(found))
                out["times"].append(np.array(list(found.values()), "<i8").tobytes())
                out["usual"].append(m.class_of[[m.units.of(w) for w in found]].astype(np.uint8).tobytes() if found else b"")
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in CODED], schema=CODED)

    return run


def sequences(docs: DataFrame, words: Vocabulary, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, logs, classes): the class of each token, the end last, and the sum of log10(count + ADDED); a row per input row.

    Rare words are joined with the table of classes; words of the core, however
    frequent, are not part of that join.  A word that training has not met takes
    the class of its ending.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    coded = cut(pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(_coded(shared), CODED_SQL), "coded-texts")
    rare = coded.select("row", F.posexplode("rare").alias("place", "word"))
    met = rare.join(dealt(placed), "word").groupBy("row").agg(F.collect_list(F.struct("place", "c", "class")).alias("met"))
    both = coded.drop("rare").join(dealt(met), "row", "left").select("doc_id", "n_tokens", "known", "logs", "codes", "times", "usual", F.col("met.place").alias("place"), F.col("met.c").alias("c"), F.col("met.class").alias("class"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("classes", pa.binary())])

    def run(batch):
        col = {n: batch.column(k).to_pylist() if k >= 4 and k < 7 else batch.column(k) for k, n in enumerate(("doc_id", "n_tokens", "known", "logs", "codes", "times", "usual", "place", "c", "class"))}
        n_rare = np.array([len(u) for u in col["usual"]], np.int64)
        start = np.cumsum(n_rare) - n_rare
        cls, times = np.frombuffer(b"".join(col["usual"]), np.uint8).copy(), np.frombuffer(b"".join(col["times"]), "<i8")
        c = np.zeros(len(cls), np.int64)
        of = pc.list_parent_indices(col["place"]).to_numpy()
        at = start[of] + pc.list_flatten(col["place"]).to_numpy()
        cls[at], c[at] = pc.list_flatten(col["class"]).to_numpy(), pc.list_flatten(col["c"]).to_numpy()
        doc = np.repeat(np.arange(len(n_rare)), n_rare)
        logs = col["logs"].to_numpy() + np.bincount(doc, times * np.log10(c + ADDED), len(n_rare))
        known = col["known"].to_numpy() + np.bincount(doc, times * (c > 0), len(n_rare)).astype(np.int64)
        classes = []
        for raw, k, n in zip(col["codes"], start.tolist(), n_rare.tolist()):
            codes = np.frombuffer(raw, "<i2" if n <= NARROW else "<i4")
            own = codes.astype(np.uint8)
            at = np.nonzero(codes < 0)[0]
            own[at] = cls[k - 1 - codes[at].astype(np.int64)]
            classes.append(own.tobytes() + b"\0")
        return {"doc_id": col["doc_id"], "n_tokens": col["n_tokens"], "n_known": known, "logs": logs, "classes": classes}

    out = cut(both.mapInArrow(per_batch(run, schema), "doc_id long, n_tokens long, n_known long, logs double, classes binary"), "class-sequences")
    discard(coded)
    return out


def class_pairs(rows: DataFrame, g: int) -> np.ndarray:
    """Counts of neighbouring classes in all rows of sequences(); every text stands between end tokens."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(g * g, np.int64)
        for batch in slices(batches):
            c = np.frombuffer(b"\0" + b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(c[:-1] * g + c[1:], minlength=g * g)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(total)[0]), pa.array(total[total > 0])], schema=schema)

    met = rows.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # g * g rows at most
    out = np.zeros(g * g)
    out[met["pair"].to_numpy()] = met["n"].to_numpy()
    return out.reshape(g, g)


class Model:
    """Log probabilities of classes, and of words in them but for the word's own count."""

    def __init__(self, words: Vocabulary, pairs: np.ndarray):
        self.words, self.tokens = words, words.tokens
        g = len(pairs)
        share = (pairs.sum(0) + 1) / (pairs.sum() + g)
        # Witten-Bell: as much weight for the shorter context as the class has followers
        followers = np.maximum((pairs > 0).sum(1), 1)[:, None]
        self.transition = np.log10((pairs + followers * share[None, :]) / (pairs.sum(1)[:, None] + followers))
        self.emission_base = np.log10(pairs.sum(0) + ADDED * (words.types_of + 1))
        self.token_base = float(np.log10(words.tokens + ADDED * (words.types + 1)))


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of docs(text) and the table of classes of all words but the units."""
    words, placed = vocabulary(docs)
    if "doc_id" not in docs.columns:
        docs = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    rows = sequences(docs, words, placed)
    model = Model(words, class_pairs(rows, len(words.types_of)))
    discard(rows)
    return model, placed


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """sequences()' rows as score() returns them."""
    transition, base, token_base = model.transition, model.emission_base, model.token_base
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batch):
        raw, logs, n = batch.column(4).to_pylist(), batch.column(3).to_numpy(), batch.column(1).to_numpy()
        c = np.frombuffer(b"\0" + b"".join(raw), np.uint8)
        steps = transition[c[:-1], c[1:]] - base[c[1:]]
        return {"doc_id": batch.column(0), "n_tokens": n, "n_known": batch.column(2), "base_score": logs - n * token_base, "score": logs + np.add.reduceat(steps, np.cumsum(n) - n)}

    return rows.mapInArrow(per_batch(run, schema), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, model: Model, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), one row per input row.

    Null and empty texts hold the end token alone; repeated rows are scored
    alike; only the id and the text are read.
    """
    return scored(sequences(docs, model.words, placed, id_col, text_col), model)


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    held = F.coalesce(crc32_of_id(F.col("doc_id")) % 10 == 0, F.lit(False))
    words, placed = vocabulary(docs.where(~held))
    rows = sequences(docs, words, placed)
    model = Model(words, class_pairs(rows.where(~held), len(words.types_of)))
    return scored(rows, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
