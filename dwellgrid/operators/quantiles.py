"""Exact quantiles (linear interpolation) per group, at any group size.

The built-in ``percentile`` keeps every distinct value of a group in one task.
It is used for groups up to ``GROUP_LIMIT`` rows.  For larger groups a sketch
with a guaranteed rank error brackets the wanted ranks, one more pass counts
what lies below the bracket, and only the values inside it are ranked (by the
sliced running sum, so not in one task either).  The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.operators.ordered import GROUP_LIMIT, Size, _by, attach, measure, running

SCALE = 1.4826  # MAD to standard deviation of a normal sample
_ACCURACY = 10_000
_MARGIN = 5e-4


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: Column,
    probs: dict[str, float],
    size: Size | None = None,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """One row per group: keys, ``n`` (non-NULL values) and the named quantiles."""
    data = df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL")
    size = size or measure(df.select(*keys), keys)
    if size.largest <= limit:
        return _builtin(data, keys, probs)
    marks = sorted({min(1.0, max(0.0, p + s)) for p in probs.values() for s in (-_MARGIN, _MARGIN)})
    sketch = data.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(m) for m in marks]), F.lit(_ACCURACY)).alias("_marks"),
    ).where(F.col("_n") > min(limit, 20_000))
    tagged = attach(data, sketch, keys)
    few = tagged.where("_n IS NULL").select(*keys, "_v")
    many = tagged.where("_n IS NOT NULL")

    def bracket(p):
        lo, hi = max(0.0, p - _MARGIN), min(1.0, p + _MARGIN)
        # below 20,000 values the sketch's slack of one rank could matter: take all
        wide = F.col("_n") <= 20_000
        a = F.col("_min") if lo == 0.0 else F.when(wide, F.col("_min")).otherwise(F.col("_marks")[marks.index(lo)])
        b = F.col("_max") if hi == 1.0 else F.when(wide, F.col("_max")).otherwise(F.col("_marks")[marks.index(hi)])
        return a, b

    inside, below = F.lit(False), F.lit(0)
    for i, p in enumerate(probs.values()):
        a, b = bracket(p)
        inside = inside | F.col("_v").between(a, b)
        below = below + F.when(F.col("_v") > b, 1 << i).otherwise(0)
    # values outside every bracket collapse to one row per gap between brackets
    counted = many.groupBy(*keys, "_n", F.when(inside, F.col("_v")).alias("_x"),
                           F.when(~inside, below).alias("_gap")).agg(
        F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_o"))
    ranked = running(counted, keys, ["_o"], sums={"_upto": F.col("_c")}, limit=limit)
    picks = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(at), F.ceil(at)
        first = F.col("_upto") - F.col("_c")
        has = lambda r: (first <= r) & (r < F.col("_upto"))
        picks += [F.max(F.when(has(lo), F.col("_x"))).alias(f"_a_{name}"),
                  F.max(F.when(has(hi), F.col("_x"))).alias(f"_b_{name}"),
                  F.max(at - lo).alias(f"_f_{name}")]
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("n"), *picks)
    exact = found.select(*keys, "n", *[
        F.when(F.col(f"_a_{q}").isNotNull() & F.col(f"_b_{q}").isNotNull(),
               F.col(f"_a_{q}") + (F.col(f"_b_{q}") - F.col(f"_a_{q}")) * F.col(f"_f_{q}"))
        .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")).alias(q)
        for q in probs])
    return _builtin(few, keys, probs).unionByName(exact)


def _builtin(data, keys, probs):
    ps = list(probs.values())
    out = data.groupBy(*keys).agg(
        F.count("_v").alias("n"),
        F.percentile("_v", F.array(*[F.lit(float(p)) for p in ps])).alias("_q"))
    if not keys:
        out = out.where("n > 0")
    return out.select(*keys, "n", *[F.col("_q")[i].alias(q) for i, q in enumerate(probs)])


def with_median(df: DataFrame, keys: list[str], value: Column, name: str,
                size: Size | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """Add each group's median to its rows (NULL values carry no weight)."""
    size = size or measure(df, keys)
    if size.largest <= limit:
        return df.withColumn(name, F.percentile(value.cast("double"), F.lit(0.5)).over(_by(keys)))
    table = quantiles(df, keys, value, {name: 0.5}, size, limit).drop("n")
    return attach(df, table, keys)


def with_mad(df: DataFrame, keys: list[str], value: Column, center: str, scale: str,
             size: Size | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """Add median and 1.4826 x median absolute deviation of each group."""
    size = size or measure(df, keys)
    out = with_median(df, keys, value, center, size, limit)
    out = with_median(out, keys, F.abs(value - F.col(center)), scale, size, limit)
    return out.withColumn(scale, SCALE * F.col(scale))
