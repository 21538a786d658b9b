"""Dominance sums: results over several levels of slabs, and how often a row is copied."""

import decimal

import numpy as np
import pytest
from pyspark.errors import ArithmeticException

from halyard.operators import dominance


def _below(x: np.ndarray, w: np.ndarray) -> list:
    return [w[(x < r).all(1)].sum() for r in x]


def _table(spark, x: np.ndarray, w: np.ndarray, kinds: str = "a double, b double, c double"):
    return spark.createDataFrame([(k, *r, v) for k, (r, v) in enumerate(zip(x.tolist(), w.tolist()))], f"id long, {kinds}, w {'long' if w.dtype == np.int64 else 'double'}")


def _rows_written(spark) -> int:
    """Rows in shuffles and files of all stages so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() + stages.apply(k).outputRecords() for k in range(stages.size()))


def test_a_row_is_copied_once_a_coordinate(spark, monkeypatch):
    monkeypatch.setattr(dominance, "SLAB", 1000, raising=False)
    rng, n = np.random.default_rng(12), 6000
    x, w = np.stack([rng.integers(0, 25, n), rng.permutation(n), rng.permutation(n)], 1).astype(float), rng.integers(1, 99, n)
    df, before = _table(spark, x, w), _rows_written(spark)
    got = {r["id"]: r["s"] for r in dominance.dominated(df, ["a", "b", "c"]).collect()}
    assert got == dict(enumerate(_below(x, w)))
    # stored once, 3 copies at most into slabs, a sum for each of these, of the grid and of the row itself; and the cells
    assert _rows_written(spark) - before < 15 * n


@pytest.mark.parametrize("shape", ["apart", "few values", "one value often", "doubles as weights"])
def test_slabs_too_large_for_a_task_are_cut_again(spark, monkeypatch, shape):
    for name, value in (("SLAB", 100), ("MOST", 250), ("CELLS", 200)):
        monkeypatch.setattr(dominance, name, value, raising=False)
    rng, n = np.random.default_rng(4), 2000
    x = np.stack([rng.permutation(n), rng.permutation(n), rng.permutation(n)], 1).astype(float)
    if shape == "few values":
        x = np.stack([x[:, 0] % 7, x[:, 1] // 400, x[:, 2]], 1)
    if shape == "one value often":
        x[rng.random((n, 3)) < 0.6] = 77.0
    w = rng.normal(size=n) if shape == "doubles as weights" else rng.integers(-9, 99, n)
    got = {r["id"]: r["s"] for r in dominance.dominated(_table(spark, x, w), ["a", "b", "c"]).collect()}
    want = _below(x, w)
    assert len(got) == n and all(got[k] == (pytest.approx(v, abs=1e-9) if shape == "doubles as weights" else v) for k, v in enumerate(want))


def test_coordinates_that_doubles_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(dominance, "SLAB", 50, raising=False)
    rng = np.random.default_rng(9)
    x, w = np.stack([2**60 + rng.integers(0, 90, 300), rng.integers(0, 90, 300)], 1), rng.integers(1, 9, 300)
    rows = [(k, int(a), decimal.Decimal(int(b)), int(v)) for k, ((a, b), v) in enumerate(zip(x, w))]
    df = spark.createDataFrame(rows, "id long, a long, b decimal(30,2), w int")
    assert {r["id"]: r["s"] for r in dominance.dominated(df, "a", "b").collect()} == dict(enumerate(_below(x, w)))


def test_weights_that_add_up_beyond_64_bits(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, w = np.stack([rng.permutation(300), rng.permutation(300)], 1).astype(float), rng.integers(2**57, 2**58, 300) * rng.choice([-1, 1], 300)
    want = {k: int(v) for k, v in enumerate(_below(x, w.astype(object)))}
    assert sum(abs(w.astype(object))) > 2**64 and max(map(abs, want.values())) < 2**63
    monkeypatch.setattr(dominance, "SLAB", 50, raising=False)
    assert {r["id"]: r["s"] for r in dominance.dominated(_table(spark, x, w, "a double, b double"), "a", "b").collect()} == want
    df = spark.createDataFrame([(k, float(k), float(k), 2**62) for k in range(3)], "id long, a double, b double, w long")
    with pytest.raises(ArithmeticException):
        dominance.dominated(df, "a", "b").collect()


def test_null_weights_give_nothing(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, None), (1, 1.0, 1.0, 4), (2, 2.0, 2.0, 1)], "id long, a double, b double, w long")
    assert {r["id"]: r["s"] for r in dominance.dominated(df, "a", "b").collect()} == {0: 0, 1: 0, 2: 4}
