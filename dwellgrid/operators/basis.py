"""Least squares on a small basis per group of rows, as window sums and columns.

A group here is one spectrum, or one class or window of it: its size is that of
the channel axis, whatever the table's. All steps of a fit partition by the
same keys, so a fit with several rounds is one shuffle. The normal equations
are eliminated column by column in plain projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: A normal distribution's scatter in units of its median absolute deviation.
MAD_SIGMA = 1.4826


def by_group(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def with_basis(df: DataFrame, basis: list[Column]) -> DataFrame:
    return df.withColumns({f"_b{i}": b.cast("double") for i, b in enumerate(basis)})


def eliminated(df: DataFrame, k: int, tag: str) -> DataFrame:
    """Solve the k x k systems in columns ``<tag>i_j`` (i <= j) and ``<tag>ri``; adds ``<tag>ci``.

    A system without an answer has NULL."""
    a, r = (lambda i, j: F.col(f"{tag}{i}_{j}")), (lambda i: F.col(f"{tag}r{i}"))
    out = df
    for t in range(k - 1):
        part = {i: F.try_divide(a(t, i), a(t, t)) for i in range(t + 1, k)}
        step = {f"{tag}{i}_{j}": a(i, j) - part[i] * a(t, j) for i in part for j in range(i, k)}
        out = out.withColumns(step | {f"{tag}r{i}": r(i) - part[i] * r(t) for i in part})
    for i in range(k - 1, -1, -1):
        known = r(i)
        for j in range(i + 1, k):
            known = known - a(i, j) * F.col(f"{tag}c{j}")
        out = out.withColumn(f"{tag}c{i}", F.try_divide(known, a(i, i)))
    return out


def fitted(df: DataFrame, keys: list[str], k: int, y: str, use: str, ridge: float, tag: str) -> tuple[DataFrame, Column]:
    """The fit of ``y`` on ``_b0 .. _b<k-1>`` over a group's rows with ``use``, and its value in every row."""
    w, b = by_group(keys), [F.col(f"_b{i}") for i in range(k)]
    sums = {f"{tag}{i}_{j}": F.sum(F.when(F.col(use), b[i] * b[j])).over(w) + (ridge if i == j else 0.0) for i in range(k) for j in range(i, k)}
    sums |= {f"{tag}r{i}": F.sum(F.when(F.col(use), b[i] * F.col(y))).over(w) for i in range(k)}
    out = eliminated(df.withColumns(sums), k, tag)
    value = F.col(f"{tag}c0") * b[0]
    for i in range(1, k):
        value = value + F.col(f"{tag}c{i}") * b[i]
    return out.drop(*sums), value


def robust_row_model(cells: DataFrame, keys: list[str], value: str, fit: Column, basis: list[Column], *, log: bool = True, ridge: float = 1e-6,
                     clip: float = 3.0, extra: int = 2) -> DataFrame:
    """Add ``model``: a ridge fit of each spectrum (``keys``) on ``basis``, cells well above it left out of a second fit.

    Fitted are the cells that ``fit`` admits, with ``log`` the positive ones in
    logarithms, raised to the first percentile. A cell more than ``clip``
    robust standard deviations above the first fit is left out; none is for
    being low. NULL for spectra with fewer than ``len(basis) + extra`` cells
    before or after that."""
    k, w = len(basis), by_group(keys)
    good = fit & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    good = good & (F.col(value) > 0) if log else good
    work = with_basis(cells, basis).withColumn("_ok", F.coalesce(good, F.lit(False)))
    if log:
        work = work.withColumn("_floor", F.percentile(F.when(F.col("_ok"), F.col(value)), F.lit(0.01)).over(w))
        work = work.withColumn("_y", F.when(F.col("_ok"), F.ln(F.greatest(value, "_floor"))))
    else:
        work = work.withColumn("_y", F.when(F.col("_ok"), F.col(value)))
    work, model = fitted(work, keys, k, "_y", "_ok", ridge, "_f")
    work = work.withColumn("_res", F.col("_y") - model).withColumn("_mid", F.median("_res").over(w))
    work = work.withColumn("_mad", F.median(F.abs(F.col("_res") - F.col("_mid"))).over(w))
    high = F.col("_res") > F.col("_mid") + clip * (MAD_SIGMA * F.col("_mad") + 1e-8)
    work = work.withColumn("_kept", F.col("_ok") & ~F.coalesce(high, F.lit(False)))
    work, model = fitted(work, keys, k, "_y", "_kept", ridge, "_s")
    enough = F.count_if("_kept").over(w) >= k + extra  # those left are no more than those before
    work = work.withColumn("_enough", enough)
    return work.select(*cells.columns, F.when(F.col("_enough"), F.exp(model) if log else model).alias("model"))


def clipped_fit(df: DataFrame, keys: list[str], k: int, y: str, base: str, *, clip: float, rounds: int) -> tuple[DataFrame, Column]:
    """Fit, leave out what lies further than ``clip`` robust deviations on either side, and fit again, in ``rounds`` rounds.

    A round's mask is taken from all ``base`` rows anew, so a row can come back;
    once no row changes sides, further rounds change nothing. The deviation is
    the median distance of the rows in use."""
    w, out = by_group(keys), df.withColumn("_use", F.col(base))
    for n in range(rounds):
        out, value = fitted(out, keys, k, y, "_use", 0.0, "_f")
        if n == rounds - 1:
            return out, value
        out = out.withColumn("_far", F.abs(F.col(y) - value))
        out = out.withColumn("_dev", MAD_SIGMA * F.median(F.when(F.col("_use"), F.col("_far"))).over(w))
        out = out.withColumn("_use", F.coalesce(F.col(base) & (F.col("_far") <= clip * F.col("_dev")), F.lit(False)))
        out = out.drop(*[f"_fc{i}" for i in range(k)])
    raise ValueError("at least one round")


def windows(first: int, last: int, width: float, step: float) -> list[float]:
    """Centres of windows of ``width`` channels, every ``step``, none reaching beyond the axis."""
    low, high = first + width / 2, last - width / 2
    out, at = [], low
    while at < high + step:
        out.append(min(max(at, low), high))
        at += step
    return out


def comb_background(cells: DataFrame, keys: list[str], chan: str, value: str, teeth: list[int], first: int, last: int, basis, k: int, *, spacing: int = 8,
                    guard: int = 1, width: float = 48.0, step: float = 24.0, exclude: Column | None = None, clip: float = 4.0, rounds: int = 6, extra: int = 5) -> DataFrame:
    """keys, tooth -> background under each tooth and residual_rms beside it.

    Each window of ``width`` channels is fitted by itself on ``basis(u)``, k
    columns over its own axis u from -1 to 1, in units of its median, without
    the multiples of ``spacing`` and ``guard`` channels beside them, and
    without cells that ``exclude`` names, that are missing or not positive;
    outliers on either side go in up to ``rounds`` rounds. A tooth is read in
    the window whose centre is nearest (the first of two), NULL with fewer than
    ``k + extra`` cells. residual_rms is that of value / fit - 1 over channels 2
    to 4 away on both sides."""
    centres = windows(first, last, width, step)
    own = {t: min(range(len(centres)), key=lambda n: (abs(t - centres[n]), n)) for t in teeth}
    used = sorted(set(own.values()))
    c = F.col(chan)
    inside = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(centres[n]).alias("at")) for n in used]),
                      lambda x: (c >= x["at"] - width / 2) & (c < x["at"] + width / 2))
    work = cells.select(*keys, chan, F.col(value).cast("double").alias("_v"), (exclude if exclude is not None else F.lit(False)).alias("_out"), F.explode(inside).alias("_w"))
    beside = F.abs(F.pmod(c + spacing // 2, F.lit(spacing)) - spacing // 2) <= guard
    part = [*keys, "_win"]
    w = by_group(part)
    work = work.withColumns({"_win": F.col("_w.n"), "_base": F.coalesce(~beside & ~F.col("_out") & (F.col("_v") > 0), F.lit(False))})
    work = with_basis(work, basis(2 * (c - F.col("_w.at")) / width))
    work = work.withColumn("_scale", F.median(F.when(F.col("_base"), F.col("_v"))).over(w))
    work = work.withColumn("_y", F.col("_v") / F.col("_scale"))
    work, fit = clipped_fit(work, part, k, "_y", "_base", clip=clip, rounds=rounds)
    work = work.withColumns({"_fit": fit, "_n": F.count_if("_base").over(w)}).withColumn("_x", F.pow(F.try_divide(F.col("_y"), F.col("_fit")) - 1, F.lit(2)))
    left, right = (w.orderBy(c).rangeBetween(*r) for r in ((-4, -2), (2, 4)))
    sums = sum((F.coalesce(F.sum("_x").over(s), F.lit(0.0)) for s in (left, right)), F.lit(0.0))
    n = F.count("_x").over(left) + F.count("_x").over(right)
    work = work.withColumn("_rms", F.sqrt(F.try_divide(sums, n)))
    tooth = F.lit(False)
    for n in used:
        tooth = tooth | ((F.col("_win") == n) & c.isin([t for t in teeth if own[t] == n]))
    enough = F.col("_n") >= k + extra
    return work.where(tooth).select(*keys, c.alias("tooth"), F.when(enough, F.col("_fit") * F.col("_scale")).alias("background"), F.when(enough, F.col("_rms")).alias("residual_rms"))
