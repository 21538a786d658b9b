"""Scenario trees: generators, tables of nodes and edges, archives, sampled node paths."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from halyard.sources.noise import uniforms


class Tree:
    """nodes[t]: coordinates [node, factor]; edges[t]: (src, dst, prob) arrays from date t to t + 1."""

    def __init__(self, nodes: list[np.ndarray], edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]], dt: float):
        self.nodes, self.edges, self.dt = nodes, edges, dt
        for src, _, prob in edges:
            if len(src) and not np.allclose(np.bincount(src, prob), 1):
                raise ValueError("probabilities out of a node must sum to one")

    @property
    def steps(self) -> int:
        return len(self.edges)

    def expected(self, t: int, values: np.ndarray) -> np.ndarray:
        """Expectation at the nodes of t of values at those of t + 1 (first axis)."""
        src, dst, prob = self.edges[t]
        out = np.zeros((len(self.nodes[t]), *values.shape[1:]))
        np.add.at(out, src, prob.reshape(-1, *[1] * (values.ndim - 1)) * values[dst])
        return out

    def thinned(self, dates: list[int]) -> "Tree":
        """The tree seen at some of its dates only, transitions multiplied out."""
        edges = []
        for a, b in zip(dates, dates[1:]):
            p = np.eye(len(self.nodes[a]))
            for t in range(a, b):
                src, dst, prob = self.edges[t]
                step = np.zeros((len(self.nodes[t]), len(self.nodes[t + 1])))
                np.add.at(step, (src, dst), prob)
                p = p @ step
            src, dst = np.nonzero(p)
            edges.append((src, dst, p[src, dst]))
        return Tree([self.nodes[d] for d in dates], edges, self.dt * (dates[1] - dates[0] if len(dates) > 1 else 1))

    def walk(self, ids: np.ndarray, seed: int = 1) -> np.ndarray:
        """[id, date]: node paths from node 0, one uniform number a step."""
        out = np.zeros((len(ids), self.steps + 1), np.int64)
        for t, (src, dst, prob) in enumerate(self.edges):
            order = np.lexsort((dst, src))
            src, dst, prob = src[order], dst[order], prob[order]
            upto = np.cumsum(prob)
            first = np.searchsorted(src, np.arange(len(self.nodes[t])))
            base = np.concatenate([[0.0], upto])[first]
            last = np.searchsorted(src, np.arange(len(self.nodes[t])), "right") - 1
            node = out[:, t]
            at = np.searchsorted(upto, base[node] + uniforms(seed, ids, t, 0), "right")
            out[:, t + 1] = dst[np.clip(at, first[node], last[node])]
        return out

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(step, node, coord) and (step, src, dst, prob)."""
        nodes = [(t, k, [float(v) for v in x]) for t, rows in enumerate(self.nodes) for k, x in enumerate(rows)]
        edges = [(t, int(a), int(b), float(p)) for t, (s, d, q) in enumerate(self.edges) for a, b, p in zip(s, d, q)]
        return spark.createDataFrame(nodes, "step int, node int, coord array<double>"), spark.createDataFrame(edges, "step int, src int, dst int, prob double")

    def save(self, spark: SparkSession, path: str) -> None:
        nodes, edges = self.tables(spark)
        nodes.write.partitionBy("step").parquet(f"{path}/nodes")
        edges.write.partitionBy("step").parquet(f"{path}/edges")

    @staticmethod
    def load(spark: SparkSession, path: str, dt: float) -> "Tree":
        """Read back what save() wrote; trees are small, their tables come to the driver."""
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("step", "node").collect()
        edges = spark.read.parquet(f"{path}/edges").orderBy("step", "src", "dst").collect()
        steps = max(r["step"] for r in nodes) + 1
        at = [np.array([r["coord"] for r in nodes if r["step"] == t]) for t in range(steps)]
        links = [[(r["src"], r["dst"], r["prob"]) for r in edges if r["step"] == t] for t in range(steps - 1)]
        return Tree(at, [tuple(np.array(c) for c in zip(*x)) for x in links], dt)


def trinomial(sigma: float, reversion: float, steps: int, dt: float) -> Tree:
    """Recombining trinomial tree of a mean-reverting factor; moments of each step are matched.

    Nodes of a date stand ``sqrt(3 * variance of a step)`` apart; a node's three
    branches go around the level nearest to its conditional mean.
    """
    variance = sigma * sigma * -math.expm1(-2 * reversion * dt) / (2 * reversion)
    gap, keep = math.sqrt(3 * variance), math.exp(-reversion * dt)
    levels, nodes, edges = np.array([0]), [np.zeros((1, 1))], []
    for _ in range(steps):
        mean = levels * keep
        middle = np.rint(mean).astype(int)
        off = mean - middle
        reached = np.unique(np.concatenate([middle - 1, middle, middle + 1]))
        probs = [1 / 6 + (off * off - off) / 2, 2 / 3 - off * off, 1 / 6 + (off * off + off) / 2]
        src = np.tile(np.arange(len(levels)), 3)
        dst = np.searchsorted(reached, np.concatenate([middle - 1, middle, middle + 1]))
        edges.append((src, dst, np.concatenate(probs)))
        levels = reached
        nodes.append(levels[:, None] * gap)
    return Tree(nodes, edges, dt)


def deterministic(values: np.ndarray, dt: float) -> Tree:
    """One node a date."""
    one = np.array([0])
    return Tree([np.atleast_2d(v) for v in values], [(one, one, np.array([1.0]))] * (len(values) - 1), dt)
