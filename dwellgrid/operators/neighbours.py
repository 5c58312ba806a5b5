"""Exact nearest neighbours on directions, and residuals against them.

Distance is between (cos az, sin az, cos el, sin el).  No cell is searched by
pairing all its rows.  Rows are ordered along a space-filling curve and cut
into leaves of equal size, so dense regions simply get more leaves.  A leaf is
searched within itself; the distance of its k-th neighbours then says which
other leaves could hold nearer ones, and those are found by hashing boxes to a
hierarchy of cells.  Rows at one and the same position are interchangeable but
for their id, so only the first k + 1 of a position are ever candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.arrays import median
from dwellgrid.operators.ordered import GROUP_LIMIT, attach, numbered
from dwellgrid.operators.quantiles import with_mad
from dwellgrid.session import cut

_BITS = 20  # fixed value: finest cells are 2 pi / 2^20
_FOUND = "id bigint, d array<double>, v array<double>, n array<bigint>"


def _interleave(a: Column, b: Column) -> Column:
    """Morton code of two cell numbers."""
    code = F.lit(0).cast("bigint")
    for i in range(_BITS):
        bit = lambda c, k: F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("bigint")), k)
        code = code.bitwiseOR(bit(a, 2 * i)).bitwiseOR(bit(b, 2 * i + 1))
    return code


def _best(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k candidates nearest to each query row, itself left out; ties to the
    lower id."""
    c = c.sort_values("id", ignore_index=True)  # a stable sort by distance then leaves ties to the lower id
    xy = lambda p: np.column_stack([np.cos(p.az), np.sin(p.az), np.cos(p.el), np.sin(p.el)])
    a, b = xy(q), xy(c)
    d = np.sqrt(sum((a[:, None, i] - b[None, :, i]) ** 2 for i in range(4)))
    ids, vals = c.id.to_numpy(), c.v.to_numpy(float)
    d[q.id.to_numpy()[:, None] == ids[None, :]] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    d = np.take_along_axis(d, order, axis=1)
    found = np.isfinite(d).sum(axis=1)
    cut_to = lambda x: [row[:n].tolist() for row, n in zip(x, found)]
    return pd.DataFrame({"id": q.id.to_numpy(), "d": cut_to(d), "v": cut_to(vals[order]), "n": cut_to(ids[order])})


def _cells(df: DataFrame, keep: list[str], az0: Column, az1: Column, el0: Column, el1: Column) -> DataFrame:
    """(level, cell) of a box at the level of its own size and all coarser
    ones; at most four cells each.  ``own`` marks the level of its size."""
    turn = 2 * math.pi
    side = F.greatest(az1 - az0, el1 - el0, F.lit(turn / 2 ** _BITS))
    fine = F.greatest(F.least(F.floor(F.log2(turn / side)), F.lit(_BITS)), F.lit(0)).cast("int")
    out = df.select(*keep, az0.alias("_a0"), az1.alias("_a1"), el0.alias("_e0"), el1.alias("_e1"), fine.alias("_own"))
    out = out.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_own")))).withColumn("_n", F.pow(F.lit(2.0), F.col("level")))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / turn * F.col("_n")), F.floor(F.col(hi) / turn * F.col("_n")))
    out = out.withColumn("_ca", F.explode(span("_a0", "_a1"))).withColumn("_ce", F.explode(span("_e0", "_e1")))
    # both angles wrap
    wrap = lambda c: F.pmod(F.col(c), F.col("_n").cast("bigint"))
    return out.select(*keep, "level", wrap("_ca").alias("ca"), wrap("_ce").alias("ce"), (F.col("level") == F.col("_own")).alias("own")).distinct()


def nearest_neighbours(df: DataFrame, id: str, az: Column, el: Column, value: Column, k: int = 12, leaf: int = 256,
                       portion: int = 4096, limit: int = GROUP_LIMIT) -> DataFrame:
    """id -> d, v, n: distance, value and id of its k nearest other rows,
    nearest first.  ``az`` and ``el`` in radians."""
    turn = 2 * math.pi
    pts = df.select(F.col(id).cast("bigint").alias("id"), F.pmod(az, F.lit(turn)).alias("az"), F.pmod(el, F.lit(turn)).alias("el"), value.cast("double").alias("v"))
    # rows of one position: the first k + 1 by id are all anyone can need
    pts = numbered(pts, ["az", "el"], ["id"], "_same", limit=limit)
    cell = lambda c: F.least(F.floor(F.col(c) / turn * 2 ** _BITS), F.lit(2 ** _BITS - 1)).cast("bigint")
    pts = pts.withColumn("_z", _interleave(cell("az"), cell("el")))
    pts = numbered(pts, [], ["_z", "id"], "_pos", limit=limit).withColumn("leaf", F.floor(F.col("_pos") / leaf))
    pts = cut(pts.select("id", "az", "el", "v", "leaf", (F.col("_same") <= k).alias("cand")))
    cands = pts.where("cand").select("leaf", "id", "az", "el", "v")
    # an extra copy of the row's own position beyond k + 1 is no candidate, its twins are
    here = pts.groupBy("leaf").applyInPandas(lambda p: _best(p, p[p.cand], k), _FOUND)
    bound = F.when(F.size("d") >= k, F.element_at("d", -1)).otherwise(F.lit(2 * math.sqrt(2)))
    first = cut(pts.join(here.select("id", "d", F.col("n").alias("near"), F.col("v").alias("vals")), "id").withColumn("_bound", bound))
    # what a row could still miss lies within this angle of it
    first = first.withColumn("r", 2 * F.asin(F.least(F.col("_bound") / 2, F.lit(1.0))))
    boxes = first.groupBy("leaf").agg(F.min("az").alias("a0"), F.max("az").alias("a1"), F.min("el").alias("e0"), F.max("el").alias("e1"),
                                      F.max("r").alias("_r"), F.max(F.when(F.col("cand"), 1)).alias("has"))
    A0, A1, E0, E1, R = (F.col(c) for c in ("a0", "a1", "e0", "e1", "_r"))
    asks = _cells(boxes, ["leaf"], A0 - R, A1 + R, E0 - R, E1 + R)
    holds = _cells(boxes.where("has = 1"), ["leaf", "a0", "a1", "e0", "e1"], A0, A1, E0, E1).withColumnRenamed("leaf", "other").withColumnRenamed("own", "h_own")
    meet = asks.join(holds, ["level", "ca", "ce"]).where((F.col("own") | F.col("h_own")) & (F.col("leaf") != F.col("other")))
    meet = meet.select("leaf", "other", "a0", "a1", "e0", "e1").distinct()
    gap = lambda x, lo, hi: F.when(F.col(x).between(F.col(lo), F.col(hi)), 0.0).otherwise(F.least(
        F.pmod(F.col(lo) - F.col(x), F.lit(turn)), F.pmod(F.col(x) - F.col(hi), F.lit(turn))))
    asked = first.select("id", "az", "el", "v", "r", "leaf").join(meet, "leaf")
    asked = asked.where((gap("az", "a0", "a1") <= F.col("r")) & (gap("el", "e0", "e1") <= F.col("r"))).select("id", "az", "el", "v", "other")
    # an asked leaf meets its askers in portions: a leaf everybody asks is no hot group
    parts = asked.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / portion).alias("_parts"))
    asked = attach(asked, parts, ["other"]).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts"))).drop("_parts")
    stock = cands.withColumnRenamed("leaf", "other").join(parts, "other").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    stock = stock.select(*[F.col(c).alias(f"c_{c}") for c in stock.columns])  # its own column identities
    there = asked.groupBy("other", "_part").cogroup(stock.groupBy("c_other", "c__part")).applyInPandas(
        lambda q, c: _best(q, c.rename(columns=lambda n: n[2:]), k) if len(q) and len(c) else pd.DataFrame(columns=["id", "d", "v", "n"]), _FOUND)
    every = here.unionByName(there)
    # at most k per leaf asked
    merged = every.select("id", F.explode(F.arrays_zip("d", "n", "v")).alias("x")).groupBy("id").agg(F.array_sort(F.collect_set("x")).alias("x"))
    top = F.slice("x", 1, k)
    return merged.select(F.col("id").alias(id), F.transform(top, lambda x: x["d"]).alias("d"), F.transform(top, lambda x: x["v"]).alias("v"), F.transform(top, lambda x: x["n"]).alias("n"))


def isolated_outliers(df: DataFrame, id: str, az: Column, el: Column, residual: Column, valid: Column, clip: float = 5.0,
                      k: int = 12, min_rows: int = 20, leaf: int = 256, limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``outlier``: the residual less the median of its k nearest neighbours
    is beyond clip x MAD.  Too few valid rows flag nothing."""
    good = df.where(valid & residual.isNotNull() & ~F.isnan(residual))
    if good.limit(max(k + 1, min_rows)).count() < max(k + 1, min_rows):
        return df.withColumn("outlier", F.lit(False))
    near = nearest_neighbours(good, id, az, el, residual, k, leaf, limit=limit).select(id, median(F.col("v")).alias("_local"))
    high = good.select(id, residual.alias("_res")).join(near, id).withColumn("_h", F.col("_res") - F.col("_local"))
    high = with_mad(high, [], F.col("_h"), "_c", "_s", limit=limit)
    far = F.abs(F.col("_h") - F.col("_c")) > F.when(F.col("_s") > 1e-12, clip * F.col("_s")).otherwise(1e-12)
    return df.join(high.select(id, far.alias("outlier")), id, "left").withColumn("outlier", F.coalesce("outlier", F.lit(False)))
