import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellgrid.operators.neighbours import isolated_outliers, nearest_neighbours


@pytest.mark.parametrize("leaf", [16, 64])
def test_matches_brute_force(spark, leaf):
    rng = np.random.default_rng(2)
    az = np.r_[rng.uniform(-np.pi, np.pi, 120), rng.normal(3.1, 0.01, 200), np.full(40, 1.0)]
    el = np.r_[rng.uniform(-1.5, 1.5, 120), rng.normal(0.2, 0.01, 200), np.full(40, 0.5)]
    v = rng.normal(size=len(az))
    df = spark.createDataFrame([(i, float(a), float(e), float(x)) for i, (a, e, x) in enumerate(zip(az, el, v))], "i bigint, az double, el double, v double")
    xy = np.column_stack([np.cos(az), np.sin(az), np.cos(el), np.sin(el)])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    out = nearest_neighbours(df, "i", F.col("az"), F.col("el"), F.col("v"), 6, leaf).collect()
    assert len(out) == len(az)
    for r in out:
        assert np.allclose(r.d, np.sort(d[r.i])[:6], atol=1e-9)
        assert len(set(r.n)) == 6 and r.i not in r.n
    flags = isolated_outliers(df.withColumn("v", F.when(F.col("i") == 5, 100.0).otherwise(F.col("v"))), "i", F.col("az"), F.col("el"), F.col("v"), F.lit(True), 8.0, 6, leaf=leaf)
    assert [r.i for r in flags.where("outlier").collect()] == [5]
