"""Linear cuts: intercepts, boxes, evaluation at particles; distinct states."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.session import cut

#: Cuts of a mesh that are held in one array
LISTED = 4096


def intercept(value: Column, slopes: list[Column], at: list[Column]) -> Column:
    """a0 of the cut value + slope (x - at): value - sum of slope * at."""
    for s, x in zip(slopes, at):
        value = value - s * x
    return value


def in_box(df: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside a closed box."""
    for x, (low, high) in box.items():
        df = df.where(F.col(x).between(low, high))
    return df


def upper_envelope(particles: DataFrame, cuts: DataFrame, mesh: str, xs: list[str], slopes: list[str], key: str, a0: str = "a0") -> DataFrame:
    """(key, value), a row for each particle: the largest cut of its mesh at the particle, null if the mesh has none.

    A mesh's cuts are held in arrays of LISTED at most.  Where each mesh has one
    array, particles are joined with it and nothing else is shuffled; meshes with
    more are taken array by array, and the largest value of a numbered row stays.
    """
    cut_struct = F.struct(F.col(a0).cast("double").alias("a0"), *[F.col(s).cast("double").alias(f"s{k}") for k, s in enumerate(slopes)])
    counts = cuts.groupBy(mesh).agg(F.ceil(F.count("*") / F.lit(LISTED)).alias("lists"))
    many = counts.agg(F.max("lists")).first()[0] or 1
    part = F.pmod(F.xxhash64(a0, *slopes), F.lit(int(many)))
    listed = cuts.select(F.col(mesh).alias("c_mesh"), cut_struct.alias("c"), part.alias("part")).groupBy("c_mesh", "part").agg(F.collect_list("c").alias("listed"))
    line = lambda c: sum((c[f"s{k}"] * F.col(x) for k, x in enumerate(xs)), c["a0"])
    if many == 1:
        return particles.join(listed, F.col(mesh) == F.col("c_mesh"), "left").select(key, F.array_max(F.transform("listed", line)).alias("value"))
    rows = cut(particles.select(F.monotonically_increasing_id().alias("row_no"), F.col(key).alias("row_key"), mesh, *xs), "particles")
    met = rows.join(listed, F.col(mesh) == F.col("c_mesh"), "left").select("row_no", "row_key", F.array_max(F.transform("listed", line)).alias("value"))
    return met.groupBy("row_no").agg(F.first("row_key").alias(key), F.max("value").alias("value")).drop("row_no")


def hull(cuts: DataFrame, mesh: str, slope: str, key: str, a0: str = "a0") -> DataFrame:
    """(mesh, slope, a0): each mesh's cuts on its upper envelope in one dimension.

    Of cuts with equal slope the largest stays.  Cuts are thinned within hash
    groups of ``key`` first, so that what meets in one task is hulls alone.
    """
    schema = f"{mesh} {cuts.schema[mesh].dataType.simpleString()}, {slope} double, {a0} double"

    def envelope(found: pd.DataFrame) -> pd.DataFrame:
        best = found.groupby(slope, as_index=False)[a0].max()
        kept: list[tuple[float, float, float]] = []
        for s, a in zip(best[slope].tolist(), best[a0].tolist()):
            low = -math.inf  # where this cut overtakes the one before
            while kept:
                low = (kept[-1][1] - a) / (s - kept[-1][0])
                if low > kept[-1][2]:
                    break
                kept.pop()
                low = -math.inf
            kept.append((s, a, low))
        return pd.DataFrame({mesh: found[mesh].iloc[: len(kept)].to_numpy(), slope: [k[0] for k in kept], a0: [k[1] for k in kept]})

    lines = cuts.where(F.col(mesh).isNotNull() & F.col(slope).isNotNull() & F.col(a0).isNotNull())
    lines = lines.select(mesh, F.col(slope).cast("double").alias(slope), F.col(a0).cast("double").alias(a0), F.pmod(F.xxhash64(key), F.lit(64)).alias("part"))
    thinned = lines.groupBy(mesh, "part").applyInPandas(envelope, schema)
    return thinned.groupBy(mesh).applyInPandas(envelope, schema)


def envelope_at(particles: DataFrame, cuts: DataFrame, mesh: str, x: str, slope: str, key: str, cut_key: str, a0: str = "a0") -> DataFrame:
    """(key, value): as upper_envelope in one dimension, each particle meeting the hull of its mesh alone."""
    return upper_envelope(particles, hull(cuts, mesh, slope, cut_key, a0), mesh, [x], [slope], key, a0)


def distinct_states(df: DataFrame, within: list[str], xs: list[str], width: float) -> DataFrame:
    """One state, the smallest, for each mesh and each cell of that width."""
    cells = [F.floor(F.col(x) / width + 0.5).alias(f"cell_{x}") for x in xs]
    return df.groupBy(*within, *cells).agg(F.min(F.struct(*xs)).alias("state")).select(*within, *[F.col(f"state.{x}").alias(x) for x in xs])


def distinct_within(df: DataFrame, within: list[str], xs: list[str], tiny: float) -> DataFrame:
    """States of each mesh, in ascending order, without those within ``tiny`` of a kept one in every coordinate.

    States of one cell of width ``tiny`` are one state already before a mesh's
    states meet, so what meets are states far apart, or neighbours over an edge.
    """
    few = df.select(*within, *[F.col(x).cast("double").alias(x) for x in xs]).dropna(subset=xs)
    few = few.groupBy(*within, *[F.floor(F.col(x) / tiny).alias(f"cell_{k}") for k, x in enumerate(xs)]).agg(F.min(F.struct(*xs)).alias("state")).select(*within, *[F.col(f"state.{x}").alias(x) for x in xs])

    def thin(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(xs, kind="stable")
        kept: list[int] = []
        rows = found[xs].to_numpy()
        for i, row in enumerate(rows):
            # kept states too far below in the first coordinate can't be near
            if not any(rows[k][0] >= row[0] - tiny and (abs(rows[k] - row) <= tiny).all() for k in reversed(kept[-64:])):
                kept.append(i)
        return found.iloc[kept]

    return few.groupBy(*within).applyInPandas(thin, few.schema) if within else few.groupBy(F.lit(0)).applyInPandas(thin, few.schema)
