"""Weighted sums over strictly dominated points, exact for any number of rows."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.operators.ranks import with_rank
from halyard.session import cut, dealt


#: Cells of all grids of a level together, rows that a slab aims at, rows that one task takes, rows that meet pair by pair
CELLS, SLAB, MOST, PAIRS = 1 << 18, 1 << 15, 1 << 18, 256


def _pairs(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over dominated rows, each row with each; no more than some megabytes at a time."""
    size = np.abs(w.astype(float)).sum()
    plain, out = size < 2**53 if w.dtype == np.int64 else np.isfinite(size), np.zeros_like(w)
    step = max(1, (1 << 21) // len(w))
    for a in range(0, len(w), step):
        below = np.ones((len(x[a : a + step]), len(w)), bool)
        for c in x.T:
            below &= c[None, :] < c[a : a + step, None]
        out[a : a + step] = below.astype(float) @ w.astype(float) if plain else np.where(below, w, 0).sum(1)
    return out


def _prefixes(sums: np.ndarray) -> np.ndarray:
    """At each cell of a grid the sum over the cells below it in every coordinate."""
    out = np.zeros([c + 1 for c in sums.shape], sums.dtype)
    inner = out[(slice(1, None),) * sums.ndim]
    inner[...] = sums
    for k in range(sums.ndim):
        np.cumsum(inner, axis=k, out=inner)
    return out


def _sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sums of dominated() over rows in memory, coordinates as whole numbers: a grid, then the slabs of each coordinate."""
    m, d = x.shape
    if d == 1:
        order = np.argsort(x[:, 0], kind="stable")
        return np.concatenate([np.zeros(1, w.dtype), np.cumsum(w[order])])[np.searchsorted(x[order, 0], x[:, 0])]
    if m <= PAIRS or 3**d > 16 * m:
        return _pairs(x, w)
    size = -(-m // max(3, min(-(-m // PAIRS), int((4 * m) ** (1 / d)))))
    cells, slabs = np.empty_like(x), []
    for k in range(d):
        order = np.argsort(x[:, k], kind="stable")
        v = x[order, k]
        first = np.searchsorted(v, v)
        # a value of more than size rows has a cell of its own, other cells have less than 2 * size rows
        _, numbers = np.unique(2 * (first // size) + (np.searchsorted(v, v, "right") - first > size), return_inverse=True)
        cells[order, k] = numbers
        starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
        slabs += [(k, order[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), m]) if v[a] != v[b - 1]]
    sums = np.zeros(cells.max(0) + 1, w.dtype)
    np.add.at(sums, tuple(cells.T), w)
    out = _prefixes(sums)[tuple(cells.T)]
    for k, rows in slabs:
        out[rows] += _sums(np.concatenate([cells[rows, :k], x[rows, k:]], 1), w[rows])
    return out


def _as_double(rows: DataFrame, names: list[str]) -> DataFrame:
    """Coordinates as doubles in the same order, values apart staying apart; those that a double can't hold become ranks."""
    kinds = {n: rows.schema[n].dataType for n in names}
    long = [n for n in names if isinstance(kinds[n], T.LongType)]
    ends = rows.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in long for f in (F.min, F.max)]).first() if long else {}
    for n, kind in kinds.items():
        if isinstance(kind, T.LongType):
            fits = max(abs(ends[f"{f}_{n}"] or 0) for f in ("min", "max")) <= 2**53
        else:
            fits = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)) or isinstance(kind, T.DecimalType) and kind.precision <= 15
        if not fits:
            ranked = cut(with_rank(rows.select(n).distinct(), [n]), "by-coordinate").select(n, F.col("rank0").alias("rank"))
            rows = rows.join(dealt(ranked), n).drop(n).withColumnRenamed("rank", n)
        rows = rows.withColumn(n, F.col(n).cast("double"))
    return rows


class _Split:
    """Groups of rows cut into grids: cells are value ranges between quantiles, a value that fills several has its own."""

    def __init__(self, quantiles: dict[int, list[list[float]]]):
        self.starts, self.hot, self.shape = {}, {}, {}
        for g, of in quantiles.items():
            found = [np.unique(np.array(q, float), return_counts=True) for q in of]
            self.starts[g], self.hot[g] = [v for v, _ in found], [v[n > 1] for v, n in found]
            self.shape[g] = tuple(len(a) + len(h) + 1 for a, h in zip(self.starts[g], self.hot[g]))
        self.grids: dict[int, np.ndarray] = {}
        self.slabs: dict[tuple[int, int], np.ndarray] = {}

    def cell(self, g: int, k: int, v: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts[g][k], v, "right") + np.searchsorted(self.hot[g][k], v, "left")

    def _met(self, batches, d: int):
        """(group, batch's rows of it, their coordinates, their cells), batch by batch."""
        for batch in batches:
            of = batch.column("grp").to_numpy()
            x = np.stack([batch.column(f"x{k}").to_numpy() for k in range(d)], 1)
            for g in np.unique(of).tolist():
                mine = np.flatnonzero(of == g)
                if g in self.shape:
                    yield g, batch.take(pa.array(mine)), x[mine], [self.cell(g, k, x[mine, k]) for k in range(d)]

    def count(self, rows: DataFrame, d: int) -> dict[int, int]:
        """Sums the weights in every cell, numbers the slabs that have rows of several values and gives each one's rows."""
        kind = rows.schema["w"].dataType.simpleString()

        def counted(batches):
            sums, ends = {}, {}
            for g, batch, x, cells in self._met(batches, d):
                flat = np.ravel_multi_index(cells, self.shape[g])
                w = batch.column("w").to_numpy()
                if g not in sums:
                    sums[g] = np.zeros(math.prod(self.shape[g]), w.dtype), np.zeros(math.prod(self.shape[g]), np.int64)
                    ends[g] = [(np.zeros(c, np.int64), np.full(c, np.inf), np.full(c, -np.inf)) for c in self.shape[g]]
                np.add.at(sums[g][0], flat, w)
                np.add.at(sums[g][1], flat, 1)
                for k, (n, low, high) in enumerate(ends[g]):
                    np.add.at(n, cells[k], 1)
                    np.minimum.at(low, cells[k], x[:, k])
                    np.maximum.at(high, cells[k], x[:, k])
            for g in sums:
                for k, (s, n, low, high) in enumerate([(*sums[g], None, None), *[(None, *e) for e in ends[g]]]):
                    at = np.flatnonzero(n)
                    none = pa.nulls(len(at), pa.float64())
                    yield pa.RecordBatch.from_pydict({
                        "grp": np.full(len(at), g, np.int64), "k": np.full(len(at), k - 1, np.int64), "cell": at, "n": n[at],
                        "s": pa.nulls(len(at), pa.int64() if kind == "bigint" else pa.float64()) if s is None else s[at],
                        "low": none if low is None else low[at], "high": none if high is None else high[at],
                    })

        found = rows.select("grp", "w", *[f"x{k}" for k in range(d)]).mapInArrow(counted, f"grp long, k long, cell long, n long, s {kind}, low double, high double")
        found = found.groupBy("grp", "k", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        of, at, cell = (found.column(c).to_numpy() for c in ("grp", "k", "cell"))
        rows_of: dict[int, int] = {}
        for g in sorted(self.shape):
            mine = (of == g) & (at == -1)
            sums = np.zeros(math.prod(self.shape[g]), np.int64 if kind == "bigint" else float)
            sums[cell[mine]] = found.column("s").filter(pa.array(mine)).to_numpy()
            self.grids[g] = _prefixes(sums.reshape(self.shape[g]))
            for k in range(d):
                mine = (of == g) & (at == k)
                n, low, high = (found.column(c).filter(pa.array(mine)).to_numpy() for c in ("n", "low", "high"))
                several = (low != high) & ~np.isin(cell[mine], self.cell(g, k, self.hot[g][k]))
                self.slabs[g, k] = np.full(self.shape[g][k], -1, np.int64)
                for c, rows_in in zip(cell[mine][several].tolist(), n[several].tolist()):
                    self.slabs[g, k][c] = len(rows_of)
                    rows_of[len(rows_of)] = rows_in
        return rows_of

    def at_grid(self, rows: DataFrame, d: int) -> DataFrame:
        """(row_no, s): the weights of the cells below a row's in every coordinate."""

        def taken(batches):
            for g, batch, _, cells in self._met(batches, d):
                yield pa.RecordBatch.from_arrays([batch.column("row_no"), pa.array(self.grids[g][tuple(cells)])], names=["row_no", "s"])

        return rows.mapInArrow(taken, f"row_no long, s {rows.schema['w'].dataType.simpleString()}")

    def to_slabs(self, rows: DataFrame, d: int, to: set[int]) -> DataFrame:
        """A row for each slab it stands in; the coordinates before the slab's own become cells, so no pair meets twice."""
        wanted = {key: np.where(np.isin(ids, list(to)), ids, -1) for key, ids in self.slabs.items()}

        def spread(batches):
            for g, batch, x, cells in self._met(batches, d):
                for k in range(d):
                    ids = wanted[g, k][cells[k]]
                    at = np.flatnonzero(ids >= 0)
                    if len(at):
                        new = {"grp": ids[at]} | {f"x{j}": cells[j][at].astype(float) if j < k else x[at, j] for j in range(d)}
                        rest = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_pydict({c: new[c] if c in new else rest.column(c) for c in batch.schema.names})

        return rows.mapInArrow(spread, rows.schema)


def _quantiles(spread: DataFrame, names: list[str], ranges: int) -> dict[int, list[list[float]]]:
    """For each group the values between its ``ranges`` ranges of about equal counts, coordinate by coordinate."""
    of = spread.groupBy("grp").agg(*[F.percentile_approx(c, [i / ranges for i in range(1, ranges)]).alias(c) for c in names])
    # a summary takes a megabyte: beyond a few groups they are made one after the other, from sorted rows
    conf, setting = spread.sparkSession.conf, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = conf.get(setting)
    conf.set(setting, "8")
    try:
        return {r["grp"]: [r[c] for c in names] for r in of.collect()}
    finally:
        conf.set(setting, before)


def _parts(spread: DataFrame, names: list[str], n: int) -> list[DataFrame]:
    """Tables (row_no, s) that add up to the sums of dominated(); ``spread`` has grp (0), row_no, w and coordinates as doubles."""
    d, kind = len(names), spread.schema["w"].dataType.simpleString()

    def met(group: pa.Table) -> pa.Table:
        at = np.stack([np.unique(group.column(c).to_numpy(), return_inverse=True)[1] for c in names], 1)
        return pa.table([group.column("row_no"), _sums(at, group.column("w").to_numpy())], names=["row_no", "s"])

    alone = lambda t: t.groupBy("grp").applyInArrow(met, f"row_no long, s {kind}")
    if n <= SLAB:
        return [alone(spread)]
    parts, sizes = [], {0: n}
    while sizes:
        ranges = max(3, min(-(-max(sizes.values()) // SLAB), 1024, int((CELLS / len(sizes)) ** (1 / d) + 1e-9)))
        split = _Split(_quantiles(spread, names, ranges))
        found = split.count(spread, d)
        parts.append(split.at_grid(spread, d))
        large = {g: m for g, m in found.items() if m > MOST}
        if len(large) < len(found):
            parts.append(alone(split.to_slabs(spread, d, found.keys() - large.keys())))
        spread, sizes = cut(split.to_slabs(spread, d, set(large)), "slabs") if large else spread, large
    return parts


def dominated(df: DataFrame, x: str | list[str], y: str | None = None, w: str = "w", key: str = "id") -> DataFrame:
    """(key, s): the sum of w over rows below this one in every coordinate, strictly; coordinates as a list, or two names.

    Each coordinate is cut into value ranges, and a row takes the weights of the
    grid's cells below its own in every coordinate.  The pairs left share a range:
    those of the first coordinate meet in its slabs, those apart there but not in
    the second in its slabs, and so on, so a row is copied once a coordinate, and
    not at all where a range has one value.  A slab of more than MOST rows is cut
    in the same way again.  The driver holds the cells, about CELLS of them (3 to
    the power of the coordinates, if that is more).  Rows with a null or NaN
    coordinate neither give nor take; equal keys are told apart.  Whole weights
    add up exactly; a sum beyond 64 bits is an error.
    """
    xs = [x, y] if y is not None else list(x)
    names = [f"x{k}" for k in range(len(xs))]
    kind = "long" if isinstance(df.schema[w].dataType, T.IntegralType) else "double"
    rows = df.select(F.monotonically_increasing_id().alias("row_no"), F.col(key).alias("row_key"), F.coalesce(F.col(w).cast(kind), F.lit(0).cast(kind)).alias("w"), *[F.col(c).alias(n) for c, n in zip(xs, names)]).dropna(subset=names)
    rows = cut(rows, "points")
    n, weight = rows.agg(F.count("*"), F.sum(F.abs(F.col("w").cast("decimal(20,0)"))) if kind == "long" else F.lit(0)).first()
    spread = _as_double(rows.drop("row_key"), names).select(F.lit(0).cast("long").alias("grp"), "row_no", "w", *names)
    if (weight or 0) < 2**63:
        parts = _parts(spread, names, n)
    else:
        # high and low halves of the weights, as sums on the way may need more than 64 bits
        halves = {1 << 32: F.shiftright("w", 32), 1: F.col("w").bitwiseAND(F.lit((1 << 32) - 1))}
        parts = [p.withColumn("s", F.col("s").cast("decimal(20,0)") * F.lit(by).cast("decimal(11,0)")) for by, half in halves.items() for p in _parts(spread.withColumn("w", half), names, n)]
    parts = [p.withColumn("row_key", F.lit(None).cast(rows.schema["row_key"].dataType)) for p in parts]
    sums = functools.reduce(DataFrame.unionByName, [rows.select("row_no", "row_key", F.lit(0).cast(kind).alias("s")), *parts])
    return sums.groupBy("row_no").agg(F.first("row_key", ignorenulls=True).alias(key), F.sum("s").cast(kind).alias("s")).select(key, "s")


def all_orthants(df: DataFrame, x: str | list[str], y: str | None = None, w: str | list = "w", key: str = "id") -> DataFrame:
    """(key, orthant, s) for all orthants of two or more coordinates: bit k set means above in coordinate k.

    ``w`` may be a list, one weight column for each orthant.
    """
    xs, out = ([x, y] if y is not None else list(x)), []
    for orthant in range(2 ** len(xs)):
        turned = df
        for k, c in enumerate(xs):
            if orthant >> k & 1:
                turned = turned.withColumn(c, -F.col(c))
        weight = w if isinstance(w, str) else w[orthant]
        out.append(dominated(turned, xs, None, weight, key).select(key, F.lit(orthant).alias("orthant"), "s"))
    return functools.reduce(DataFrame.unionByName, out)


def cdf_of_sample(df: DataFrame, xs: list[str], y: str, key: str) -> DataFrame:
    """(key, f): the sum of y over rows strictly below in every coordinate, and the row's own, over the number of rows."""
    n = df.dropna(subset=xs).count()
    got = dominated(df.select(key, y, *xs), xs, None, y, key)
    own = df.groupBy(key).agg(F.sum(y).alias("own"))
    return got.join(dealt(own), key).select(key, ((F.col("s") + F.col("own")) / max(1, n)).alias("f"))


#: Rows at a leaf of a kernel sum's first tree, a power of 2; they meet pair by pair
LEAF = 64


def _terms_scan(keys: list[str], trees: int, terms: list[tuple], h: list[float]):
    """Running kernel sums over rows sorted by keys and z, of one partition; a last row keeps the state of its last group.

    Sums stand for rows before this one, about its z and about the pivots.  Where
    rows lie within 30 h of each other they share a cumulative sum; from one such
    stretch to the next the sums decay, so nothing overflows.
    """
    index, d = {t: k for k, t in enumerate(terms)}, trees + 1

    def shifted(values: np.ndarray, k: int, by) -> np.ndarray:
        """Sums of (x - a - by)^p from those of (x - a)^q, in coordinate k; terms are the last axis."""
        out = values.copy()
        for t, (c, p) in enumerate(terms):
            for q in range(p[k]):
                out[..., t] += math.comb(p[k], q) * (-by) ** (p[k] - q) * values[..., index[c, (*p[:k], q, *p[k + 1 :])]]
        return out

    def scan(batches):
        from pyspark import TaskContext

        part, state, at, group, whole = TaskContext.get().partitionId(), None, 0.0, None, True
        kinds = _scanned(keys, trees)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            ks = np.stack([column(c) for c in keys], 1) if keys else np.zeros((batch.num_rows, 0), np.int64)
            z, side = column("z"), column("side")
            giving = np.stack([column(f"w{c}") for c, _ in terms], 1).astype(float)
            for k in range(trees):
                apart = column(f"z{k}") - column(f"v{k}")
                giving *= np.exp(-np.abs(apart) / h[k])[:, None] * np.stack([apart ** p[k] for _, p in terms], 1)
            taken = np.zeros((batch.num_rows, len(terms)))
            new = np.r_[True, (ks[1:] != ks[:-1]).any(1)]
            starts = np.nonzero(new)[0]
            cell = np.floor((z - z[starts][np.cumsum(new) - 1]) / (30 * h[-1]))
            starts = np.nonzero(new | np.r_[False, cell[1:] != cell[:-1]])[0]
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                here, m = tuple(ks[a].tolist()), z[a]
                if here != group:
                    whole, group, state = whole and group is None, here, np.zeros((2**trees, len(terms)))
                else:
                    state = shifted(state, d - 1, m - at) * np.exp(-(m - at) / h[-1])
                if b - a == 1:
                    taken[a] = state[(2**trees - 1) ^ side[a] if trees else 0]
                    state[side[a]] += [giving[a, t] if not p[-1] else 0.0 for t, (_, p) in enumerate(terms)]
                    at = m
                    continue
                step = z[a:b] - m
                given = giving[a:b] * np.exp(step / h[-1])[:, None] * np.stack([step ** p[-1] for _, p in terms], 1)
                fade, last = np.exp(-step / h[-1])[:, None], np.empty_like(state)
                for s in range(2**trees):
                    mine = np.where((side[a:b] == s)[:, None], given, 0.0)
                    upto = np.cumsum(mine, axis=0) + state[s]
                    before = np.concatenate([state[s][None, :], upto[:-1]])
                    takes = side[a:b] == ((2**trees - 1) ^ s)
                    taken[a:b][takes] = (shifted(before, d - 1, step) * fade)[takes]
                    last[s] = shifted(upto[-1], d - 1, step[-1]) * fade[-1]
                state, at = last, z[b - 1]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kinds.field(k).type) for k, v in enumerate([column("row_no"), np.full(batch.num_rows, part), _lists(ks), z, side, *[column(f"{n}{k}") for k in range(trees) for n in "zv"], _lists(taken), [None] * batch.num_rows, [False] * batch.num_rows])], schema=kinds)
        if group is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], kinds.field(k).type) for k, v in enumerate([None, part, list(group), at, None, *[None] * (2 * trees), None, state.ravel(), whole])], schema=kinds)

    return scan, shifted


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32), rows.ravel())


def _within_leaves(ranked: DataFrame, d: int, terms: list[tuple], h: list[float]) -> DataFrame:
    """(row_no, t0, t1, ...): the terms over the other rows of a row's leaf, LEAF rows of consecutive ranks, pair by pair."""
    schema = pa.schema([("row_no", pa.int64()), *[(f"t{t}", pa.float64()) for t in range(len(terms))]])

    def met(leaf: pa.Table) -> pa.Table:
        z = np.stack([leaf.column(f"z{k}").to_numpy() for k in range(d)], 1)
        apart = z[None, :, :] - z[:, None, :]
        kernel = np.exp(-(np.abs(apart) / np.array(h)).sum(2))
        np.fill_diagonal(kernel, 0.0)
        sums = [(kernel * np.prod(apart ** np.array(p), axis=2)) @ leaf.column(f"w{c}").to_numpy() for c, p in terms]
        return pa.table([leaf.column("row_no"), *sums], schema=schema)

    rows = ranked.withColumn("leaf", F.expr(f"rank0 div {LEAF}"))
    return rows.groupBy("leaf").applyInArrow(met, "row_no long, " + ", ".join(f"t{t} double" for t in range(len(terms))))


def _scanned(keys: list[str], trees: int) -> pa.Schema:
    coordinates = [(f"{n}{k}", pa.float64()) for k in range(trees) for n in "zv"]
    return pa.schema([("row_no", pa.int64()), ("part_no", pa.int32()), ("group", pa.list_(pa.int64())), ("z", pa.float64()), ("side", pa.int32()), *coordinates, ("sums", pa.list_(pa.float64())), ("state", pa.list_(pa.float64())), ("whole", pa.bool_())])


def _swept(spread: DataFrame, keys: list[str], trees: int, terms: list[tuple], h: list[float]) -> DataFrame:
    """(row_no, t0, t1, ...): for each row its terms over the rows of its groups that are before it in z."""
    scan, shifted = _terms_scan(keys, trees, terms, h)
    names = "row_no long, part_no int, group array<long>, z double, side int, " + "".join(f"z{k} double, v{k} double, " for k in range(trees)) + "sums array<double>, state array<double>, whole boolean"
    rows = cut(spread.repartitionByRange(*keys, "z", "tie").sortWithinPartitions(*keys, "z", "tie").mapInArrow(scan, names), "kernel-scan")
    carried, state, at, group = {}, None, 0.0, None
    for r in rows.where("state is not null").select("part_no", "group", "z", "state", "whole").orderBy("part_no").collect():  # a row a partition
        if group is not None:
            carried[r["part_no"]] = (group, at, state)
        own = np.array(r["state"]).reshape(2**trees, len(terms))
        if r["whole"] and group == r["group"]:
            own = own + shifted(state, trees, r["z"] - at) * np.exp(-(r["z"] - at) / h[-1])
        group, at, state = r["group"], r["z"], own
    schema = pa.schema([("row_no", pa.int64()), *[(f"t{t}", pa.float64()) for t in range(len(terms))]])

    def finish(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            number = lambda name: column(name).to_numpy(zero_copy_only=False)
            sums = column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(terms)).copy()
            part, z, side = number("part_no"), number("z"), number("side")
            groups = column("group").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if keys else np.zeros((batch.num_rows, 0), np.int64)
            for p in np.unique(part).tolist():
                if p in carried:
                    group, at, state = carried[p]
                    mine = np.nonzero((part == p) & (groups == np.array(group, np.int64)[None, :]).all(1))[0]
                    if len(mine):
                        by = z[mine] - at
                        sums[mine] += shifted(state[((2**trees - 1) ^ side[mine]) if trees else np.zeros(len(mine), int)], trees, by) * np.exp(-by / h[-1])[:, None]
            for k in range(trees):
                by = number(f"z{k}") - number(f"v{k}")
                sums = shifted(sums, k, by) * np.exp(-np.abs(by) / h[k])[:, None]
            yield pa.RecordBatch.from_arrays([column("row_no"), *[pa.array(sums[:, t]) for t in range(len(terms))]], schema=schema)

    return rows.where("state is null").mapInArrow(finish, "row_no long, " + ", ".join(f"t{t} double" for t in range(len(terms))))


def laplacian_moments(df: DataFrame, xs: list[str], weights: list[str], terms: list[tuple], h: list[float], key: str) -> DataFrame:
    """(key, k0, k1, ...): for each term (c, p) the sum of weight c times prod (x_j - x)^p under exp(-sum |x_j - x| / h) at every row, itself included.

    Terms with a lower power of a coordinate must be among the terms.  Along the
    last coordinate sums decay from row to row, upwards and downwards.  In the
    others rows stand at the leaves of a binary tree, LEAF rows
    at a leaf of the first one, and meet the rows of the sibling node: the kernel factors at the largest value of the
    left one, so no factor is over 1, and ranges of any width are exact.  Rows of
    one value are told apart by their numbers; rows with a null are left out.
    """
    trees = len(xs) - 1
    base = df.select(F.col(key).alias("id"), *[F.col(x).cast("double").alias(f"z{k}") for k, x in enumerate(xs)], *[F.col(c).cast("double").alias(f"w{j}") for j, c in enumerate(weights)]).dropna()
    base = cut(base.withColumn("row_no", F.monotonically_increasing_id()), "kernel-rows")
    spread, keys, side, parts = base.drop("id"), [], F.lit(0), []
    for k in range(trees):
        ranked = cut(with_rank(spread, [f"z{k}", "row_no"], keys), "by-coordinate")
        top = ranked.agg(F.max("n_rows")).first()[0] or 0
        lowest = 0 if k else LEAF.bit_length() - 1
        if not k:
            parts.append(_within_leaves(ranked, len(xs), terms, h))
        levels = F.sequence(F.lit(lowest), F.lit(max(lowest + 1, (top - 1).bit_length()) - 1))
        spread = ranked.withColumn(f"level{k}", F.explode(levels)).withColumn(f"level{k}", F.col(f"level{k}").cast("long")).withColumn("node", F.expr(f"shiftright(rank0, cast(level{k} as int))"))
        spread = spread.withColumn(f"parent{k}", F.expr("shiftright(node, 1)")).withColumn(f"side{k}", (F.col("node") % 2).cast("int"))
        spread = cut(spread.where(f"shiftleft(2 * parent{k} + 1, cast(level{k} as int)) < n_rows").drop("node", "rank0", "n_rows"), "by-node")
        keys += [f"level{k}", f"parent{k}"]
        pivots = cut(spread.where(f"side{k} = 0").groupBy(*keys).agg(F.max(f"z{k}").alias(f"v{k}")), "pivots")
        spread = spread.join(pivots, keys)
        side = side + F.col(f"side{k}") * (1 << k)
    if trees:
        spread = cut(spread, "kernel-nodes")
    spread = spread.withColumn("side", side.cast("int"))
    last = f"z{trees}"
    for up in (1, -1):
        turned = spread.withColumn("z", F.col(last) * up).withColumn("tie", F.col("row_no") * up)
        got = _swept(turned, keys, trees, terms, h)
        parts.append(got.select("row_no", *[(F.col(f"t{t}") * float(up ** p[-1])).alias(f"t{t}") for t, (_, p) in enumerate(terms)]))
    parts.append(base.select("row_no", *[(F.lit(0.0) if any(p) else F.col(f"w{c}")).alias(f"t{t}") for t, (c, p) in enumerate(terms)]))
    sums = functools.reduce(DataFrame.unionByName, parts).groupBy("row_no").agg(*[F.sum(f"t{t}").alias(f"k{t}") for t in range(len(terms))])
    return base.select("row_no", F.col("id").alias(key)).join(sums, "row_no").drop("row_no")


def laplacian_sums(df: DataFrame, xs: list[str], weights: list[str], h: list[float], key: str) -> DataFrame:
    """(key, k0, k1, ...): for each weight column, its sum under the kernel exp(-sum |dx| / h) at every row, the row itself included."""
    return laplacian_moments(df, xs, weights, [(j, (0,) * len(xs)) for j in range(len(weights))], h, key)


def laplacian_density(df: DataFrame, xs: list[str], h: list[float], key: str) -> DataFrame:
    """(key, density): kernel density estimate at every row."""
    n = df.count()
    scale = 2 ** len(xs) * max(1, n) * functools.reduce(lambda a, b: a * b, h, 1.0)
    sums = laplacian_sums(df.withColumn("one_weight", F.lit(1.0)), xs, ["one_weight"], h, key)
    return sums.select(key, (F.col("k0") / scale).alias("density"))


def laplacian_regression(df: DataFrame, xs: list[str], y: str, h: list[float], key: str, linear: bool = False) -> DataFrame:
    """(key, fit): kernel-weighted mean of y at every row, or the value there of the kernel-weighted affine fit."""
    d = len(xs)
    made = df.select(key, *xs, F.lit(1.0).alias("one_weight"), F.col(y).alias("y_weight"))
    if not linear:
        sums = laplacian_sums(made, xs, ["one_weight", "y_weight"], h, key)
        return sums.select(key, (F.col("k1") / F.col("k0")).alias("fit"))
    unit = [tuple(int(i == k) for i in range(d)) for k in range(d)]
    both = lambda a, b: tuple(i + j for i, j in zip(a, b))
    low = [(0,) * d, *unit]
    terms = [(0, p) for p in low] + [(0, both(unit[i], unit[j])) for i in range(d) for j in range(i, d)] + [(1, p) for p in low]
    sums = laplacian_moments(made, xs, ["one_weight", "y_weight"], terms, h, key)
    scale = np.array([1.0, *h])

    @F.pandas_udf("double")
    def solved(s: pd.Series) -> pd.Series:
        # coordinates count from the row in widths h, so the fit's value there is its constant
        s = np.array(s.tolist()).reshape(-1, len(terms))
        gram = np.stack([np.stack([s[:, terms.index((0, both(a, b)))] for b in low], 1) for a in low], 1) / np.outer(scale, scale)
        right = s[:, [terms.index((1, p)) for p in low]] / scale
        return pd.Series((np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ right[:, :, None])[:, 0, 0])

    return sums.select(key, solved(F.array(*[f"k{k}" for k in range(len(terms))])).alias("fit"))
