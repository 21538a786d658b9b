"""Quality rules judged by an isolation forest over rule statistics.

Every text gets the statistics that hand-written rules use: shares of symbols,
of words that end in one, of capitals, of shouted words, of the commonest word.
What the forest sees is by how much a statistic leaves its usual range, so that
ordinary spread says nothing.  Trees of random splits grow, each on its own draw
of all rows, as the published method has it; a row that few splits set apart has
a short path and a high anomaly score.  Usual ranges and the score above which a
document is rejected are exact figures of every labelled row, however many.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.common import per_batch, pick, slices, table, words
from halyard.session import cut, discard

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
TREES = 200
PER_TREE = 256
#: Bits of a value that each pass over the rows settles when an exact quantile is sought
RADIX = 16
#: Ranges of scores that are summed up apart
SCORE_RANGES = 4096
#: Part of the labelled good rows that may score above the threshold, and what their loss weighs against bad rows kept
MOST_GOOD_LOST = 0.01
LOSS_WEIGHT = 10.0
SEED = 20

_NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_ALPHA = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))
_CONTINUED = bytes(range(0x80, 0xC0))

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_ratio", "symbol_words", "upper_ratio", "shout_ratio", "top_word_ratio")
#: A statistic is unusual beyond so many times the spread of 9 rows in 10
USUAL = 5
#: Words of an ordinary text that are added to each text, so that short ones are not judged by a word or two
PRIOR_WORDS = 10


def repeat_words(ws: list[bytes], width: int = WINDOW) -> int:
    """Words inside ``width``-word windows that occur twice or more, the first included."""
    n = len(ws) - width + 1
    if n < 2:
        return 0
    grams = list(zip(*(ws[k:] for k in range(width))))
    if len(set(grams)) == n:
        return 0
    found = Counter(grams)
    hit = np.zeros(len(ws) + 1, np.int64)
    at = np.fromiter((k for k, g in enumerate(grams) if found[g] > 1), np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + width, -1)
    return int((np.cumsum(hit) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(BASE, FEATURES) of a whole text; a null text counts as an empty one."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    ws = words(text)
    n = len(ws)
    joined = b"".join(ws)
    chars = len(joined.translate(None, _CONTINUED))
    symbols = len(raw.translate(None, _NOT_SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    repeated = repeat_words(ws)
    base = [n, chars, symbols, dup, repeated]
    if not n:
        return base, [0.0] * len(FEATURES)
    counts = Counter(ws)
    alpha = len(joined.translate(None, _NOT_ALPHA)) or 1
    features = [
        symbols / chars,
        sum(c for w, c in counts.items() if w[-1] in SYMBOLS) / n,
        len(joined.translate(None, _NOT_UPPER)) / alpha,
        sum(c for w, c in counts.items() if w[-1] == 33) / n,
        max(counts.values()) / n,
    ]
    return base, features


class IsolationForest:
    """Random split trees as flat arrays; scores as in the published method."""

    def __init__(self, draws: list[np.ndarray], seed: int = SEED):
        """A tree for each draw of rows."""
        rng = np.random.default_rng(seed)
        self.size = max(map(len, draws))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        self.trees = [self._grow(rows, rng) for rows in draws]

    @staticmethod
    def expected(n: float) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, split, left, path = [], [], [], []
        todo = [(rows, 0, self._new(feature, split, left, path))]
        while todo:
            part, depth, at = todo.pop()
            low, high = part.min(0), part.max(0)
            able = np.nonzero(high > low)[0]
            if len(part) <= 1 or depth >= self.depth or not len(able):
                path[at] = depth + self.expected(len(part))
                continue
            f = int(rng.choice(able))
            cut_at = float(rng.uniform(low[f], high[f]))
            goes = part[:, f] <= cut_at
            feature[at], split[at] = f, cut_at
            left[at] = self._new(feature, split, left, path)
            right = self._new(feature, split, left, path)
            todo += [(part[goes], depth + 1, left[at]), (part[~goes], depth + 1, right)]
        return np.array(feature), np.array(split), np.array(left), np.array(path)

    @staticmethod
    def _new(feature, split, left, path) -> int:
        feature.append(-1), split.append(0.0), left.append(0), path.append(0.0)
        return len(feature) - 1

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1; 1 is the most anomalous."""
        rows, of = np.unique(rows, axis=0, return_inverse=True)
        total = np.zeros(len(rows))
        for feature, split, left, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                x = rows[np.arange(len(rows)), np.maximum(f, 0)]
                at = np.where(inner, left[at] + (x > split[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.expected(self.size), 1e-9))[of.ravel()]


def fails_base(base: np.ndarray) -> np.ndarray:
    """Too few words, or too many of them in repeated windows; columns as in BASE."""
    return (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])


def _arrays(texts) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics(t) for t in texts]
    return np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE)), np.array([f for _, f in found], float).reshape(-1, len(FEATURES))


STATISTICS_SQL = "doc_id long, key long, " + ", ".join(f"{n} long" for n in BASE) + ", " + ", ".join(f"{n} double" for n in FEATURES)
_STATISTICS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), *((n, pa.int64()) for n in BASE), *((n, pa.float64()) for n in FEATURES)])
#: As fails_base()
_FAILS = f"(n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, BASE, FEATURES) of every row; key is a hash of id and text."""

    def run(batch):
        base, features = _arrays(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "key": batch.column(2), **{n: base[:, k] for k, n in enumerate(BASE)}, **{n: features[:, k] for k, n in enumerate(FEATURES)}}

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("key"))
    return rows.mapInArrow(per_batch(run, _STATISTICS), STATISTICS_SQL)


def _columns(batch: pa.RecordBatch, names) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1) if batch.num_rows else np.zeros((0, len(names)))


def quantiles(rows: DataFrame, values, q: float) -> np.ndarray:
    """The exact quantile, as numpy has it, of each column of values(batch), which are not negative; rows aren't empty.

    Doubles that are not negative are in the order of their bits.  Each pass
    counts, of what agrees with a sought value so far, the next RADIX bits.
    """
    schema = pa.schema([("target", pa.int32()), ("digit", pa.int64()), ("n", pa.int64())])
    place = q * (rows.count() - 1)
    ranks = [int(np.floor(place)), int(np.ceil(place))]
    first, left, width = None, None, None
    for shift in range(64 - RADIX, -1, -RADIX):

        def run(batch, first=first, shift=shift):
            bits = np.ascontiguousarray(values(batch) + 0.0).view(np.int64)
            out = {f.name: [np.zeros(0, np.int64)] for f in schema}
            for t in range(2 * bits.shape[1]):
                own = bits[:, t // 2]
                digit, n = np.unique((own if first is None else own[own >> (shift + RADIX) == first[t]]) >> shift, return_counts=True)
                for name, x in (("target", np.full(len(n), t)), ("digit", digit), ("n", n)):
                    out[name].append(x)
            return {k: np.concatenate(x) for k, x in out.items()}

        met = rows.mapInArrow(per_batch(run, schema, 1 << 14), "target int, digit long, n long").groupBy("target", "digit").agg(F.sum("n").alias("n")).toArrow()  # 2 ** RADIX rows a target at most
        target, digit, n = (met[c].to_numpy() for c in ("target", "digit", "n"))
        width = int(target.max()) + 1
        left = [ranks[t % 2] for t in range(width)] if left is None else left
        first = [0] * width if first is None else list(first)
        for t in range(width):
            order = np.argsort(digit[target == t])
            d, upto = digit[target == t][order], np.cumsum(n[target == t][order])
            k = int(np.searchsorted(upto, left[t], "right"))
            first[t], left[t] = int(d[k]), left[t] - (int(upto[k - 1]) if k else 0)
    found = np.array(first, np.int64).view(np.float64).reshape(-1, 2)
    return found[:, 0] + (found[:, 1] - found[:, 0]) * (place - ranks[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(rows: DataFrame, values, trees: int = TREES, per_tree: int = PER_TREE, seed: int = SEED) -> list[np.ndarray]:
    """For each tree, values(batch) of ``per_tree`` of all the rows (all, if they are fewer): those with the smallest hash of key and tree.

    Rows of one key are equal; they are drawn together and count as often as they are.
    """
    names = [f"x{k}" for k in range(len(FEATURES))]
    schema = pa.schema([("tree", pa.int32()), ("h", pa.int64()), *((c, pa.float64()) for c in names), ("n", pa.int64())])
    # twice as many as needed are drawn: that half of them are missing does not happen
    part = min(1.0, 2 * per_tree / max(1, rows.select("key").distinct().count()))
    bound = np.uint64(min(int(part * 2**63), 2**63 - 1))

    def run(batch):
        key, at, n = np.unique(batch.column("key").to_numpy().view(np.uint64), return_index=True, return_counts=True)
        x = values(batch)[at]
        out = []
        for t in range(trees):
            h = _mixed(key + _mixed(np.array([seed * 1_000_003 + t], np.uint64))) >> np.uint64(1)
            hit = np.nonzero(h <= bound)[0]
            out.append((np.full(len(hit), t), h[hit].view(np.int64), x[hit], n[hit]))
        tree, h, x, n = (np.concatenate(c) for c in zip(*out))
        return {"tree": tree, "h": h, **{c: x[:, k] for k, c in enumerate(names)}, "n": n}

    sql = "tree int, h long, " + ", ".join(f"{c} double" for c in names) + ", n long"
    drawn = rows.mapInArrow(per_batch(run, schema, 1 << 14), sql).groupBy("tree", "h", *names).agg(F.sum("n").alias("n")).toArrow()  # about 2 * trees * per_tree rows at most
    drawn = drawn.sort_by([(c, "ascending") for c in ("tree", "h", *names)])
    tree, n, x = drawn["tree"].to_numpy(), np.minimum(drawn["n"].to_numpy(), per_tree), np.stack([drawn[c].to_numpy() for c in names], 1)
    return [np.repeat(x[tree == t], n[tree == t], axis=0)[:per_tree] for t in range(trees)]


class Judge:
    """A forest, the usual range of each statistic and a threshold."""

    def __init__(self):
        self.forest, self.limit = None, float("inf")
        self.middle, self.spread = np.zeros(len(FEATURES)), np.ones(len(FEATURES))

    def _off(self, n_words: np.ndarray, features: np.ndarray) -> np.ndarray:
        n = n_words.reshape(-1, 1).astype(float)
        return np.abs((features * n + self.middle * PRIOR_WORDS) / (n + PRIOR_WORDS) - self.middle)

    def unusual(self, n_words: np.ndarray, features: np.ndarray) -> np.ndarray:
        return np.log1p(np.maximum(0, self._off(n_words, features) / self.spread - USUAL))

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame | None = None, rows: DataFrame | None = None) -> "Judge":
        """docs(doc_id, text), labels(doc_id, quality); rows: measure(docs), if it is at hand.

        Of the rows that pass the base rule, all that are labelled good give the
        usual ranges (all rows, if none is); every tree draws from all; all that
        are labelled give the threshold.  Null ids and null labels are no
        labels; of an id's labels the smallest holds.  Without a good label the
        score of 1 row in 100 is the threshold; without any row nothing is
        anomalous.
        """
        made = [] if rows is not None else [cut(measure(docs), "statistics")]
        able = (made[0] if made else rows).where(f"not {_FAILS}")
        judge, known = cls(), None
        if labels is not None:
            one = pick(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
            known = cut(able.join(one, "doc_id").select("n_words", *FEATURES, (F.col("quality") > 0).alias("good")), "labelled")
            made.append(known)
            known = known if known.where("good").limit(1).count() else None
        if able.limit(1).count():
            usual = known.where("good") if known is not None else able
            judge.middle = quantiles(usual, lambda b: _columns(b, FEATURES), 0.5)
            off = judge._off
            judge.spread = np.maximum(quantiles(usual, lambda b: off(_columns(b, ["n_words"]), _columns(b, FEATURES)), 0.9), 1e-3)
            judge.forest = IsolationForest(draws(able, lambda b: judge.unusual(_columns(b, ["n_words"]), _columns(b, FEATURES))))
            judge.limit = judge._limit(known) if known is not None else float(quantiles(able, lambda b: judge.anomalous(_columns(b, ["n_words"]), _columns(b, FEATURES))[0].reshape(-1, 1), 0.99)[0])
        discard(*made)
        return judge

    def _limit(self, known: DataFrame, most_lost: float = MOST_GOOD_LOST, weight: float = LOSS_WEIGHT) -> float:
        """The score, half way between labelled ones, above which rejecting costs least.

        The cost is the part of the bad rows that is kept and, ``weight`` times,
        the part of the good rows that is lost, which is ``most_lost`` at most: a
        good row or two with odd statistics do not lift the bar above all bad
        ones.  Without bad rows nothing is rejected; ties go to the highest score.
        """
        schema = pa.schema([("score", pa.float64()), ("good", pa.bool_())])
        run = lambda b: {"score": self.anomalous(_columns(b, ["n_words"]), _columns(b, FEATURES))[0], "good": b.column("good")}
        scored = known.mapInArrow(per_batch(run, schema, 1 << 13), "score double, good boolean").withColumn("score_range", F.floor(F.col("score") * SCORE_RANGES))
        levels = cut(scored.groupBy("score_range", "score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")), "levels")
        before, n_good, n_bad = [], 0, 0
        for r in levels.groupBy("score_range").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).orderBy("score_range").collect():  # SCORE_RANGES + 1 rows at most
            before.append((r["score_range"], n_good, n_bad))
            n_good, n_bad = n_good + r["g"], n_bad + r["b"]
        if not n_good or not n_bad:
            discard(levels)
            return float("inf")
        upto = Window.partitionBy("score_range").orderBy("score")
        kept = levels.join(F.broadcast(levels.sparkSession.createDataFrame(before, "score_range long, g0 long, b0 long")), "score_range")
        kept = kept.select("score", (F.lit(n_good) - F.col("g0") - F.sum("g").over(upto)).alias("lost"), (F.col("b0") + F.sum("b").over(upto)).alias("bad"))
        cost = F.col("bad") / F.lit(float(n_bad)) + F.lit(weight) * (F.col("lost") / F.lit(float(n_good)))
        best = kept.where(F.col("lost") <= F.lit(most_lost * n_good)).orderBy(cost, F.desc("score")).first()["score"]
        above = levels.where(F.col("score") > F.lit(best)).agg(F.min("score")).first()[0]
        discard(levels)
        return best if above is None else (best + above) / 2

    def anomalous(self, n_words: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, verdict) of each row."""
        if self.forest is None or not len(features):
            return np.zeros(len(features)), np.zeros(len(features), bool)
        scores = self.forest.score(self.unusual(n_words, features))
        return scores, scores > self.limit


def judged(rows: DataFrame, judge: Judge) -> DataFrame:
    """measure()'s rows as assess() returns them."""
    kinds = [("doc_id", pa.int64()), *((n, pa.int64()) for n in BASE), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())]

    def run(batch):
        base = _columns(batch, BASE)
        score, odd = judge.anomalous(base[:, 0], _columns(batch, FEATURES))
        failed = fails_base(base)
        return {"doc_id": batch.column("doc_id"), **{n: batch.column(n) for n in BASE}, "base_failed": failed, "kept": ~failed & ~odd, "score": score}

    names = "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, kept boolean, score double"
    return rows.mapInArrow(per_batch(run, pa.schema(kinds), 1 << 13), names)


def assess(docs: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the BASE counts, base_failed, kept, score.

    Null and empty texts have no words, fail the base rule and are not kept.
    Repeated rows are judged alike, each on its own; an empty table gives none;
    columns other than the two named are not read.
    """
    return judged(measure(docs, id_col, text_col), judge)


def good_documents(docs: DataFrame, judge: Judge, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that assess() keeps; nothing is shuffled.

    Null and empty texts go; repeated rows are judged alike, each on its own.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            base, features = _arrays(batch.column(at).to_pylist())
            _, odd = judge.anomalous(base[:, 0], features)
            yield batch.filter(pa.array(~fails_base(base) & ~odd, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", quality="quality")
    rows = cut(measure(docs), "statistics")
    return judged(rows, Judge.fit(docs, labels, rows)).select("doc_id", "n_words", *BASE[1:], "base_failed", "kept", "score")
