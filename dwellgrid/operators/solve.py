"""Many small least-squares problems, solved from sums.

A row contributes products of its design and data; a group's normal equations
are plain sums, which combine before the shuffle.  Leaving rows out of a fit is
subtracting their sums.  Small systems are solved in closed form, k x k ones on
batches of groups.  Normal equations lose digits where a problem is badly
conditioned: results are gated on the condition number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions import complexnum as C
from dwellgrid.operators.ordered import GROUP_LIMIT, attach, numbered, running
from dwellgrid.operators.quantiles import quantiles
from dwellgrid.operators.segments import dwell_clusters, unwrapped

_SYM = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
SUMS = [f"n{i}{j}" for i, j in _SYM] + [f"{p}{i}" for p in ("re", "im") for i in range(3)] + ["bb", "cnt"]


def sample_products(e1: list[Column], e2: list[Column], r: list[Column], ex: Column, ey: Column) -> list[Column]:
    """What one sample adds to its pixel: three design rows (e1, e2, r) against
    the data (ex, ey, 0), ex and ey complex."""
    rows = [(e1, ex), (e2, ey), (r, None)]
    out = [sum((d[i] * d[j] for d, _ in rows[1:]), rows[0][0][i] * rows[0][0][j]).alias(f"n{i}{j}") for i, j in _SYM]
    for part in ("re", "im"):
        out += [(e1[i] * ex[part] + e2[i] * ey[part]).alias(f"{part}{i}") for i in range(3)]
    return [*out, (C.abs2(ex) + C.abs2(ey)).alias("bb"), F.lit(1).cast("long").alias("cnt")]


def solve3(df: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """Solve the summed 3 x 3 systems in columns ``<prefix>n00 ...``.

    Adds u (3 complex parts as ure0..2, uim0..2), ``cond`` of the design and
    ``resid_frac``.  Steps are separate projections, so that no expression is
    expanded over and over."""
    a = {f"{i}{j}": F.col(f"{prefix}n{i}{j}") for i, j in _SYM}
    cof = {
        "00": a["11"] * a["22"] - a["12"] * a["12"], "01": a["02"] * a["12"] - a["01"] * a["22"],
        "02": a["01"] * a["12"] - a["02"] * a["11"], "11": a["00"] * a["22"] - a["02"] * a["02"],
        "12": a["01"] * a["02"] - a["00"] * a["12"], "22": a["00"] * a["11"] - a["01"] * a["01"],
    }
    out = df.withColumns({f"_c{k}": v for k, v in cof.items()} | {"_q": (a["00"] + a["11"] + a["22"]) / 3})
    det = a["00"] * F.col("_c00") + a["01"] * F.col("_c01") + a["02"] * F.col("_c02")
    q = F.col("_q")
    off = a["01"] * a["01"] + a["02"] * a["02"] + a["12"] * a["12"]
    p = F.sqrt(((a["00"] - q) * (a["00"] - q) + (a["11"] - q) * (a["11"] - q) + (a["22"] - q) * (a["22"] - q) + 2 * off) / 6)
    out = out.withColumns({"_det": F.nullif(det, F.lit(0.0)), "_p": p})
    # eigenvalues of the symmetric matrix in closed form
    d0, d1, d2 = a["00"] - q, a["11"] - q, a["22"] - q
    shifted = d0 * (d1 * d2 - a["12"] * a["12"]) - a["01"] * (a["01"] * d2 - a["12"] * a["02"]) + a["02"] * (a["01"] * a["12"] - d1 * a["02"])
    half = F.least(F.greatest(F.try_divide(shifted, 2 * F.col("_p") * F.col("_p") * F.col("_p")), F.lit(-1.0)), F.lit(1.0))
    out = out.withColumn("_phi", F.acos(F.coalesce(half, F.lit(1.0))) / 3)
    top = q + 2 * F.col("_p") * F.cos("_phi")
    low = q + 2 * F.col("_p") * F.cos(F.col("_phi") + 2 * F.pi() / 3)
    inv = lambda i, j: F.col(f"_c{min(i, j)}{max(i, j)}")
    sol = {f"u{part}{i}": sum((inv(i, j) * F.col(f"{prefix}{part}{j}") for j in (1, 2)), inv(i, 0) * F.col(f"{prefix}{part}0")) / F.col("_det")
           for part in ("re", "im") for i in range(3)}
    out = out.withColumns(sol | {"cond": F.sqrt(F.try_divide(top, F.when(low > 0, low)))})
    fitted = sum((F.col(f"{prefix}{part}{i}") * F.col(f"u{part}{i}") for part in ("re", "im") for i in range(3)), F.lit(0.0))
    rss = F.greatest(F.col(f"{prefix}bb") - fitted, F.lit(0.0))
    frac = F.sqrt(rss) / (F.sqrt(F.col(f"{prefix}bb")) + 1e-30)
    return out.withColumn("resid_frac", frac).select(*keep, *sol, "cond", "resid_frac")


def _sums(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def pixel_solve(samples: DataFrame, pixel: str, min_visits: int = 1, max_cond: float = 30.0) -> DataFrame:
    """One solution per pixel with enough visits and a good condition number.

    ``samples`` has the columns of ``sample_products``."""
    sums = _sums(samples, [pixel]).where(F.col("cnt") >= min_visits).withColumnRenamed("cnt", "n_visits").withColumn("cnt", F.col("n_visits"))
    return solve3(sums, [pixel, "n_visits"]).where(F.col("cond") <= max_cond)


def _less(df: DataFrame, keys: list[str], own: str) -> DataFrame:
    """Replace the pixel sums t_* by t_* minus the row's own sums."""
    return df.withColumns({f"o_{c}": F.col(f"t_{c}") - F.col(f"{own}{c}") for c in SUMS})


def _totals(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(*keys, *[F.col(c).alias(f"t_{c}") for c in SUMS])


def predictions(solved: DataFrame, keep: list[str], e1: list[str], e2: list[str]) -> DataFrame:
    """ex and ey predicted by the solution in u*."""
    dot = lambda e, part: sum((F.col(e[i]) * F.col(f"u{part}{i}") for i in (1, 2)), F.col(e[0]) * F.col(f"u{part}0"))
    return solved.select(*keep, *[dot(e, part).alias(f"{n}_{part}") for n, e in (("ex", e1), ("ey", e2)) for part in ("re", "im")])


def leave_one_out(samples: DataFrame, ids: list[str], pixel: str, e1: list[str], e2: list[str], min_visits: int = 3,
                  max_cond: float = 30.0) -> DataFrame:
    """Predict every visit of a multiply visited, well conditioned pixel from its other visits."""
    total = _sums(samples, [pixel]).where(F.col("cnt") >= min_visits)
    good = solve3(total, [pixel]).where(F.col("cond") <= max_cond).select(pixel)
    total = _totals(total.join(good, pixel, "left_semi"), [pixel])
    rows = _less(samples.join(total, pixel), [pixel], "")
    solved = solve3(rows, [*ids, pixel, *e1, *e2], "o_").where(F.col("cond") <= max_cond)
    return predictions(solved, [*ids, pixel], e1, e2)


def predict_other_dwells(samples: DataFrame, ids: list[str], pixel: str, index: str, e1: list[str], e2: list[str], gap: int = 20,
                         max_cond: float = 30.0, limit: int = GROUP_LIMIT) -> DataFrame:
    """Predict each dwell's samples on a pixel from the pixel's other dwells."""
    tagged = dwell_clusters(samples, [pixel], index, gap, limit)
    own = _sums(tagged, [pixel, "cluster"])
    total = _totals(_sums(own, [pixel]), [pixel])
    rest = _less(own.join(total, pixel), [pixel], "").where(F.col("o_cnt") > 0)
    solved = solve3(rest, [pixel, "cluster"], "o_").where(F.col("cond") <= max_cond)
    rows = tagged.select(*ids, pixel, "cluster", *e1, *e2).join(solved, [pixel, "cluster"])
    return predictions(rows, [*ids, pixel], e1, e2)


def split_half(samples: DataFrame, pixel: str, index: str, gap: int = 20, min_dwells: int = 2, max_cond: float = 30.0,
               limit: int = GROUP_LIMIT) -> DataFrame:
    """Two solutions per pixel, from its alternating dwells: u* columns with
    suffix _a and _b and the dwell count."""
    tagged = dwell_clusters(samples, [pixel], index, gap, limit)
    own = _sums(tagged, [pixel, "cluster"]).withColumn("_half", F.col("cluster") % 2)
    dwells = own.groupBy(pixel).agg(F.count(F.lit(1)).alias("n_dwells"))
    halves = solve3(_sums(own, [pixel, "_half"]), [pixel, "_half"]).where(F.col("cond") <= max_cond)
    cols = [c for c in halves.columns if c.startswith("u")]
    side = lambda h, s: halves.where(F.col("_half") == h).select(pixel, *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return side(0, "a").join(side(1, "b"), pixel).join(dwells.where(F.col("n_dwells") >= min_dwells), pixel)


def block_phase(df: DataFrame, order: list[str], data: Column, pred: Column, block: int = 20, min_count: int = 3,
                limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``phase``: the angle aligning a block of consecutive samples with its
    predictions, NULL with fewer than ``min_count`` comparisons."""
    placed = numbered(df, [], order, "_p", limit=limit).withColumn("_b", F.floor(F.col("_p") / block))
    z = C.mul(data, C.conj(pred))
    sums = placed.select("_b", z.alias("z")).groupBy("_b").agg(F.sum("z.re").alias("_re"), F.sum("z.im").alias("_im"), F.count("z").alias("_n"))
    phase = F.when(F.col("_n") >= min_count, F.atan2("_im", "_re"))
    return attach(placed, sums.select("_b", phase.alias("phase")), ["_b"]).select(*df.columns, "phase")


def align_and_correlate(df: DataFrame, hat: list[str], true: list[str], n_mad: float = 5.0, min_rows: int = 20,
                        limit: int = GROUP_LIMIT) -> DataFrame:
    """One row: complex scale aligning two sets of complex 3-vectors, and the
    correlations of squared moduli per component and in total.

    Rows of absurd total power go first.  Fewer than ``min_rows`` give NULLs.
    The aligned |a u|^2 is |a|^2 |u|^2, so the correlations need no second pass."""
    power = lambda cols: sum((C.abs2(F.col(c)) for c in cols[1:]), C.abs2(F.col(cols[0])))
    whole = F.lit(True)
    for c in [*hat, *true]:
        whole = whole & F.col(c).isNotNull()
    work = df.where(whole).withColumn("_h", power(hat)).withColumn("_t", power(true))
    from dwellgrid.operators.filters import absurd_cells
    work = absurd_cells(work, [], "_h", n_mad)
    keep = ~F.col("absurd")
    n = F.count_if(keep)
    dot_re = sum((F.col(h)["re"] * F.col(t)["re"] + F.col(h)["im"] * F.col(t)["im"] for h, t in zip(hat, true)), F.lit(0.0))
    dot_im = sum((F.col(h)["re"] * F.col(t)["im"] - F.col(h)["im"] * F.col(t)["re"] for h, t in zip(hat, true)), F.lit(0.0))
    only = lambda c: F.when(keep, c)
    norm = F.sum(only(F.col("_h"))) + 1e-30
    enough = lambda c: F.when(n >= min_rows, c)
    return work.agg(
        n.alias("n"), F.count_if(F.col("absurd")).alias("n_absurd"),
        enough(F.sum(only(dot_re)) / norm).alias("scale_re"), enough(F.sum(only(dot_im)) / norm).alias("scale_im"),
        enough(F.corr(only(F.col("_h")), only(F.col("_t")))).alias("power"),
        *[enough(F.corr(only(C.abs2(F.col(h))), only(C.abs2(F.col(t))))).alias(name) for name, h, t in zip("xyz", hat, true)])


def nnls2(df: DataFrame, keys: list[str], a: Column, b: Column, y: Column) -> DataFrame:
    """Two non-negative gains per group, y ~ g1 a + g2 b, in closed form."""
    s = df.groupBy(*keys).agg(F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"),
                              F.sum(a * y).alias("ay"), F.sum(b * y).alias("by"))
    det = F.nullif(F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab"), F.lit(0.0))
    free1 = (F.col("bb") * F.col("ay") - F.col("ab") * F.col("by")) / det
    free2 = (F.col("aa") * F.col("by") - F.col("ab") * F.col("ay")) / det
    one = F.greatest(F.coalesce(F.try_divide(F.col("ay"), F.col("aa")), F.lit(0.0)), F.lit(0.0))
    two = F.greatest(F.coalesce(F.try_divide(F.col("by"), F.col("bb")), F.lit(0.0)), F.lit(0.0))
    s = s.withColumns({"_f1": free1, "_f2": free2, "_o1": one, "_o2": two})
    inside = F.coalesce((F.col("_f1") >= 0) & (F.col("_f2") >= 0), F.lit(False))
    # at the border only one gain is left: the one that explains more
    first = F.col("_o1") * F.col("ay") >= F.col("_o2") * F.col("by")
    return s.select(*keys, F.when(inside, F.col("_f1")).when(first, F.col("_o1")).otherwise(0.0).alias("g1"),
                    F.when(inside, F.col("_f2")).when(first, 0.0).otherwise(F.col("_o2")).alias("g2"))


def _packed_sums(df: DataFrame, keys: list[str], basis: list[Column], y: Column, w: Column) -> DataFrame:
    """Weighted normal equations: a{i}_{j}, b{i}, yy, sw, n per group."""
    k = len(basis)
    cols = df.select(*keys, w.cast("double").alias("_w"), y.cast("double").alias("_y"), *[b.cast("double").alias(f"_x{i}") for i, b in enumerate(basis)])
    cols = cols.where("_w > 0 AND _y IS NOT NULL")
    W, Y, X = F.col("_w"), F.col("_y"), [F.col(f"_x{i}") for i in range(k)]
    return cols.groupBy(*keys).agg(
        *[F.sum(W * X[i] * X[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)],
        *[F.sum(W * X[i] * Y).alias(f"b{i}") for i in range(k)], F.count(F.lit(1)).alias("n"))


def _packed_names(k: int) -> list[str]:
    return [f"a{i}_{j}" for i in range(k) for j in range(i, k)] + [f"b{i}" for i in range(k)]


def _coefficients(k: int):
    """Vectorised solve of a batch of packed k x k systems (columns scaled)."""

    @F.pandas_udf("array<double>")
    def solve(packed: pd.Series) -> pd.Series:
        if not len(packed):
            return pd.Series([], dtype=object)
        v = np.stack(packed.to_list()).astype(float)
        m, at = np.empty((len(v), k, k)), 0
        for i in range(k):
            for j in range(i, k):
                m[:, i, j] = m[:, j, i] = v[:, at]
                at += 1
        scale = np.sqrt(np.maximum(m[:, range(k), range(k)], 1e-300))
        m = m / scale[:, :, None] / scale[:, None, :]
        rhs = (v[:, at:at + k] / scale)[:, :, None]
        c = (np.linalg.pinv(m, rcond=1e-14, hermitian=True) @ rhs)[:, :, 0] / scale
        return pd.Series(list(c))

    return solve


def weighted_ls(df: DataFrame, keys: list[str], basis: list[Column], y: Column, w: Column) -> DataFrame:
    """keys -> n, coef: weighted least squares on a small basis (k <= 16)."""
    k = len(basis)
    sums = _packed_sums(df, keys, basis, y, w)
    return sums.select(*keys, "n", _coefficients(k)(F.array(*_packed_names(k))).alias("coef"))


def block_cv(df: DataFrame, keys: list[str], axis: str, width: float, basis: list[Column], y: Column, sigma: Column) -> DataFrame:
    """Held-out-block score per series: rms, its standard error, chi2, n, nblock.

    Blocks of ``width`` start at the lowest good point; only whole blocks with
    good points on both sides are scored.  Leaving a block out of the fit
    subtracts its sums."""
    k, names = len(basis), _packed_names(len(basis))
    good = y.isNotNull() & sigma.isNotNull() & (sigma > 0)
    work = df.where(good).select(*keys, F.col(axis).alias("_f"), y.cast("double").alias("_y"), sigma.cast("double").alias("_s"),
                                 *[b.cast("double").alias(f"_b{i}") for i, b in enumerate(basis)])
    ends = work.groupBy(*keys).agg(F.min("_f").alias("_lo"), F.max("_f").alias("_hi"))
    work = attach(work, ends, keys).withColumn("_block", F.floor((F.col("_f") - F.col("_lo")) / width))
    cols, weight = [F.col(f"_b{i}") for i in range(k)], 1 / (F.col("_s") * F.col("_s"))
    own = _packed_sums(work, [*keys, "_block"], cols, F.col("_y"), weight)
    total = own.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in names], F.min("_block").alias("_first"), F.max("_block").alias("_last"))
    rest = attach(own, total, keys).where("_block > _first AND _block < _last")
    coef = _coefficients(k)(F.array(*[F.col(f"t_{c}") - F.col(c) for c in names]))
    fits = rest.select(*keys, "_block", coef.alias("_coef"))
    held = work.join(fits, [*keys, "_block"]).where(F.col("_lo") + (F.col("_block") + 1) * width <= F.col("_hi"))
    r = F.col("_y") - sum((F.col(f"_b{i}") * F.col("_coef")[i] for i in range(1, k)), F.col("_b0") * F.col("_coef")[0])
    per = held.withColumn("_r", r).groupBy(*keys, "_block").agg(
        F.avg(F.col("_r") * F.col("_r")).alias("_ms"), F.sum(F.col("_r") * F.col("_r")).alias("_ss"),
        F.sum(F.col("_r") * F.col("_r") / (F.col("_s") * F.col("_s"))).alias("_chi"), F.count(F.lit(1)).alias("_n"))
    rms = F.sqrt(F.sum("_ss") / F.sum("_n"))
    return per.groupBy(*keys).agg(
        rms.alias("rms"), F.try_divide(F.stddev_samp("_ms") / F.sqrt(F.count("_ms")), 2 * rms).alias("rms_se"),
        (F.sum("_chi") / F.sum("_n")).alias("chi2"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("nblock"))


def principal_plane_angle(df: DataFrame, order: list[str], axes: list[str], anchor: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``angle``: degrees within the plane a 3-axis stream sweeps, unwrapped,
    with sign and offset taken from ``anchor`` (NULL readings stay NULL).

    The plane comes from six sums over all rows; its two axes are constants."""
    ok = F.lit(True)
    for a in axes:
        ok = ok & F.col(a).isNotNull() & ~F.isnan(a)
    valid = df.where(ok)
    moments = valid.agg(*[F.sum(F.col(axes[i]) * F.col(axes[j])).alias(f"m{i}{j}") for i, j in _SYM]).first()
    if moments["m00"] is None:
        return df.withColumn("angle", F.lit(None).cast("double"))
    m = np.array([[moments[f"m{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
    vectors = np.linalg.eigh(m)[1]
    u, v = vectors[:, 2], vectors[:, 1]
    dot = lambda e: sum((F.col(axes[i]) * float(e[i]) for i in (1, 2)), F.col(axes[0]) * float(e[0]))
    raw = unwrapped(valid.withColumn("_raw", F.degrees(F.atan2(dot(v), dot(u)))), [], order, "_raw", 360.0, "_deg", limit)
    usable = F.col(anchor).isNotNull() & ~F.isnan(anchor)
    link = raw.agg(F.count_if(usable).alias("n"), F.covar_samp(F.when(usable, F.col("_deg")), F.when(usable, F.col(anchor))).alias("c")).first()
    if link["n"] < 2:
        angle = F.col("_deg") - 180
    else:
        sign = -1.0 if (link["c"] or 0.0) < 0 else 1.0
        offset = quantiles(raw, [], F.when(usable, F.col(anchor) - sign * F.col("_deg")), {"o": 0.5}, limit=limit).first()["o"]
        angle = sign * F.col("_deg") + float(offset)
    return raw.select(*df.columns, angle.alias("angle")).unionByName(df.where(~ok).withColumn("angle", F.lit(None).cast("double")))


def zero_crossings(df: DataFrame, order: list[str], tilt: str, az: str, within: float = 10.0, limit: int = GROUP_LIMIT) -> DataFrame:
    """Pairs of neighbouring rows around each sign change of ``tilt`` that starts
    within the limit: ids of both rows, mix weight and azimuth there."""
    node = F.struct(*order, F.col(tilt).alias("e"), F.col(az).alias("a"))
    led = running(df.select(*order, tilt, az), [], order, lead={"_n": node}, limit=limit)
    w = F.try_divide(-F.col(tilt), F.col("_n.e") - F.col(tilt))
    crosses = (F.signum(tilt) != F.signum(F.col("_n.e"))) & (F.abs(tilt) < within)
    return led.where(crosses).select(*[F.col(c).alias(f"{c}_0") for c in order], *[F.col(f"_n.{c}").alias(f"{c}_1") for c in order],
                                     w.alias("w"), (F.col(az) + w * (F.col("_n.a") - F.col(az))).alias("az"))


def cos2_peak(df: DataFrame, chan: str, az: Column, power: Column, min_points: int = 4) -> DataFrame:
    """Peak of min + (peak - min) cos^2(az - phase) per channel.

    The law is linear in (1, cos 2a, sin 2a): mean plus amplitude is the peak."""
    a = 2 * F.radians(az)
    fit = weighted_ls(df, [chan], [F.lit(1.0), F.cos(a), F.sin(a)], power, F.lit(1.0))
    return fit.select(chan, F.when(F.col("n") >= min_points, F.col("coef")[0] + F.hypot(F.col("coef")[1], F.col("coef")[2])).alias("peak"))


def arm_scale(peaks: DataFrame, chan: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """Odd channels: peak of the even channels interpolated there over the own."""
    from dwellgrid.operators.timejoins import hold_ends
    strong = peaks.where((F.col(chan) % 2 == 0) & F.col("peak").isNotNull()).select(F.col(chan).cast("double").alias("c"), F.col("peak").alias("expected"))
    weak = peaks.where(F.col(chan) % 2 == 1)
    return hold_ends(weak.withColumn("c", F.col(chan).cast("double")), "c", strong, "c", "expected", limit=limit).select(
        chan, "peak", F.try_divide(F.col("expected"), F.col("peak")).alias("scale"))


def grid_search(df: DataFrame, cost, first: list[float], second: list[float], refine: float | None = None) -> DataFrame:
    """Every grid point (p, q) with its mean cost, coarse then around the best.

    ``cost(p, q)`` is a column expression.  All points of a grid are aggregates
    of one pass, so rows are read once per round and never multiplied."""

    def scored(ps, qs):
        points = [(float(p), float(q)) for p in ps for q in qs]
        sums = df.agg(*[F.avg(cost(p, q)).alias(f"c{i}") for i, (p, q) in enumerate(points)])
        rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.col(f"c{i}").alias("cost")) for i, (p, q) in enumerate(points)])
        return sums.select(F.inline(rows))

    coarse = scored(first, second)
    if refine is None:
        return coarse
    best = coarse.orderBy("cost", "p", "q").first()
    around = lambda v, axis: np.arange(v - np.diff(axis).min(), v + np.diff(axis).min() + 1e-9, refine)
    return coarse.unionByName(scored(around(best["p"], first), around(best["q"], second)))
