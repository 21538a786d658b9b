"""Dynamic programming on scenario trees.

A tree's nodes times its grid are small against the data this library is for, and
each step is one expectation over edges: arrays on the driver, with the table form
(trees.expected) for trees that are DataFrames.  Forward passes map simulations,
however many, over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from halyard.control.regressors import list_array
from halyard.sources.paths import ROWS
from halyard.sources.trees import Tree


class TreeContinuation:
    """Expected values of the next date at the nodes of this one: [node, point]."""

    def __init__(self, expected: np.ndarray, grid):
        self.expected, self.grid = expected, grid

    def at_nodes(self, stock: np.ndarray) -> np.ndarray:
        numbers, weights = self.grid.weights(np.atleast_2d(stock))
        return self.expected[:, numbers[0]] @ weights[0]

    def at(self, node: np.ndarray, stock: np.ndarray) -> np.ndarray:
        """[row]: each row at its node, at one stock or a stock for each."""
        stock = np.broadcast_to(np.atleast_2d(stock), (len(node), self.grid.dimension))
        numbers, weights = self.grid.weights(stock)
        return (self.expected[node[:, None], numbers] * weights).sum(1)


class TreeCuts(TreeContinuation):
    """Expected cuts [node, point, (value, slopes)]; ``cuts`` shifts the intercepts to stock zero."""

    def cuts(self, node: np.ndarray, box: list[tuple[float, float]] | None = None) -> np.ndarray:
        """[row, cut, (intercept, slopes)], only those of grid points in the box if one is given."""
        got = self.expected[node].copy()
        got[:, :, 0] -= (got[:, :, 1:] * self.grid.points[None]).sum(2)
        if box is None:
            return got
        low, high = np.array(box).T
        return got[:, ((self.grid.points >= low) & (self.grid.points <= high)).all(1)]


def solve_tree(tree: Tree, grid, optimize: Callable, final: Callable, discount: float = 1.0, cuts: bool = False) -> tuple[np.ndarray, list, list]:
    """(values at date 0 [node, point(, cut)], continuations by date, controls by date).

    optimize(grid, stock, continuation, nodes [node, factor], node numbers, date)
    -> (value [node] or cut [node, 1 + d], control [node]); final(stock [point, d],
    nodes) -> [node, point] or, with cuts, [node, point, 1 + d].
    """
    values = final(grid.points, tree.nodes[-1])
    held, kept = [], []
    for t in reversed(range(tree.steps)):
        expected = discount * tree.expected(t, values)
        now = TreeCuts(expected, grid) if cuts else TreeContinuation(expected, grid)
        number = np.arange(len(tree.nodes[t]))
        got = [optimize(grid, stock, now, tree.nodes[t], number, t) for stock in grid.points]
        values = np.stack([g[0] for g in got], 1)
        held.append(now)
        kept.append(TreeContinuation(np.stack([g[1] for g in got], 1), grid) if got[0][1] is not None else None)
    return values, held[::-1], kept[::-1]


def simulate_tree(spark: SparkSession, tree: Tree, sims: int, step: Callable, held: list, stock: list[float], final: Callable, discount: float = 1.0, seed: int = 1) -> DataFrame:
    """(sim_id, gain, stock): forward along sampled node paths.

    step(continuation or control, stock [row, d], nodes' coordinates [row, factor],
    node numbers, date) -> (stock, gain); final(stock [row, d], coordinates) -> [row].
    """
    shared = spark.sparkContext.broadcast((tree, held))

    def run(batches):
        tree, held = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(at, ROWS).to_numpy(zero_copy_only=False)
                path, own, gain = tree.walk(ids, seed), np.tile(np.array(stock, float), (len(ids), 1)), np.zeros(len(ids))
                for t in range(tree.steps):
                    own, more = step(held[t], own, tree.nodes[t][path[:, t]], path[:, t], t)
                    gain += more * discount**t
                gain += final(own, tree.nodes[-1][path[:, -1]]) * discount**tree.steps
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gain), list_array(own)], names=["sim_id", "gain", "stock"])

    return spark.range(sims).mapInArrow(run, "sim_id long, gain double, stock array<double>")


def american_tree(tree: Tree, payoff: Callable[[np.ndarray, int], np.ndarray], discount: float) -> float:
    """Price at node 0 of a claim that may be exercised at every date: payoff(nodes, date)."""
    value = payoff(tree.nodes[-1], tree.steps)
    for t in reversed(range(tree.steps)):
        value = np.maximum(discount * tree.expected(t, value), payoff(tree.nodes[t], t))
    return float(value[0])
