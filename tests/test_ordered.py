import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellgrid.operators.ordered import framed, numbered, running
from dwellgrid.operators.quantiles import quantiles, with_mad


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows; another is NULL."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        k = "hot" if i % 2 else rng.choice(["a", "b", None, "c"])
        rows.append((k, rng.randrange(200), i, rng.choice([None, float(rng.randrange(50))])))
    return spark.createDataFrame(rows, "k string, t int, i int, x double").cache()


def _rows(df, cols):
    return sorted(map(repr, df.select(*cols).collect()))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_is_the_same_in_slices(skewed, keys):
    args = dict(
        sums={"s": F.col("x"), "p": F.lit(1)}, last={"l": F.col("x")}, next={"n": F.col("x")},
        lag={"g": F.col("x"), "gt": F.col("t")}, lead={"d": F.col("x")},
    )
    plain = running(skewed, keys, ["t", "i"], **args)
    sliced = running(skewed, keys, ["t", "i"], limit=100, **args)
    assert _rows(plain, plain.columns) == _rows(sliced, plain.columns)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("edge", [None, "nearest"])
def test_frames_are_the_same_in_blocks(skewed, keys, edge):
    def make(frame, _):
        return {"m": F.max("x").over(frame), "c": F.count("t").over(frame)}

    plain = framed(skewed, keys, ["t", "i"], 3, 2, make, edge=edge)
    blocks = framed(skewed, keys, ["t", "i"], 3, 2, make, edge=edge, limit=40)
    assert plain.count() == skewed.count()
    assert _rows(plain, plain.columns) == _rows(blocks, plain.columns)


def test_nearest_edge_pads(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 9, 2, 8, 3])], "i int, x double")
    out = framed(df, [], ["i"], 1, 1, lambda f, w: {"m": F.percentile("x", F.lit(0.5)).over(f)}, edge="nearest")
    assert [r.m for r in out.orderBy("i").collect()] == [1, 2, 8, 3, 3]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_by_bracket_are_exact(spark, keys):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else str(i % 5), rng.choice([rng.gauss(0, 1), 0.5, None])) for i in range(90_000)]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = {"lo": 0.05, "med": 0.5, "hi": 0.95, "top": 1.0}
    plain = {r[0] if keys else 0: r for r in quantiles(df, keys, F.col("x"), probs).collect()}
    split = {r[0] if keys else 0: r for r in quantiles(df, keys, F.col("x"), probs, limit=7000).collect()}
    assert plain.keys() == split.keys()
    for k in plain:
        assert plain[k]["n"] == split[k]["n"]
        np.testing.assert_allclose([plain[k][q] for q in probs], [split[k][q] for q in probs], rtol=1e-12)


def test_mad_in_both_forms(skewed):
    plain = with_mad(skewed, ["k"], F.col("x"), "c", "s")
    split = with_mad(skewed, ["k"], F.col("x"), "c", "s", limit=100)
    assert _rows(plain, plain.columns) == _rows(split, plain.columns)


def test_position(skewed):
    out = numbered(skewed, ["k"], ["t", "i"], limit=50).groupBy("k").agg(
        F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m"))
    assert all(r.n == r.d == r.m + 1 for r in out.collect())
