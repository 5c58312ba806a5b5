"""Grouped aggregates, plain and robust.

Means, counts and sums combine before the shuffle, so a hot group costs one
row per task.  Medians go through ``quantiles``, which bounds the group size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions import bits
from dwellgrid.operators.folds import Fold, folded
from dwellgrid.operators.ordered import GROUP_LIMIT, attach, numbered
from dwellgrid.operators.quantiles import quantiles, with_mad


def robust_summary(df: DataFrame, keys: list[str], value: Column, limit: int = GROUP_LIMIT) -> DataFrame:
    """n, median, 95th percentile and maximum per group."""
    return quantiles(df, keys, value, {"median": 0.5, "p95": 0.95, "max": 1.0}, limit=limit)


def rows_per_file(df: DataFrame, file: str, position: list[str]) -> DataFrame:
    """Counts per file in the order files first appear."""
    return df.groupBy(file).agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(*position)).alias("_p")).orderBy("_p").drop("_p")


def state_counts(df: DataFrame, state: str) -> DataFrame:
    """Rows per state, the most frequent first; every state."""
    return df.groupBy(state).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), state)


def block_average(df: DataFrame, file: str, row: list[str], n: int, means: list[str], firsts: list[str],
                  limit: int = GROUP_LIMIT) -> DataFrame:
    """Means over n consecutive rows within a file, metadata of the first row.

    The trailing remainder of a file is dropped."""
    placed = numbered(df, [file], row, "_p", limit=limit)
    return placed.groupBy(file, F.floor(F.col("_p") / n).alias("block")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in means], *[F.min_by(c, "_p").alias(c) for c in firsts],
    ).where(F.col("_n") == n).drop("_n")


def block_remainder(df: DataFrame, file: str, n: int) -> DataFrame:
    """Rows each file loses to ``block_average``."""
    return df.groupBy(file).agg((F.count(F.lit(1)) % n).alias("dropped"))


def mean_spectrum(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Element means of an array column per group."""
    cells = df.select(*keys, F.posexplode(array).alias("_i", "_x"))
    means = cells.groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    # one entry per channel: bounded by the channel count
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_a"))
    return packed.select(*keys, F.transform("_a", lambda s: s["_m"]).alias(array))


def usable(x: Column, w: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c)
    return finite(x) & finite(w) & (w > 0)


def weighted_mean(x: Column, w: Column, bad: Column | None = None) -> Column:
    """Aggregate: mean over usable samples, NULL without one."""
    ok = usable(x, w) if bad is None else usable(x, w) & ~F.coalesce(bad, F.lit(True))
    weight = F.sum(F.when(ok, w))
    return F.sum(F.when(ok, x * w)) / F.nullif(weight, F.lit(0.0))


def masked_mean(x: Column, w: Column, flagged: Column) -> Column:
    """Weighted mean without flagged and wrapped (negative) samples."""
    return weighted_mean(x, w, flagged | (x < 0))


def dwell_rows(df: DataFrame, keys: list[str], time: str, weight: str, position: str, skip_first: int,
               columns: list[str]) -> DataFrame:
    """Per dwell: weighted time, row count, weighted means of the columns."""
    keep = df.where((F.col(position) >= skip_first) & (F.col(keys[-1]) >= 0))
    w = F.col(weight)
    return keep.groupBy(*keys).agg(F.try_divide(F.sum(F.col(time) * w), F.sum(w)).alias("t"), F.count(F.lit(1)).alias("n"),
                                   *[weighted_mean(F.col(c), w).alias(c) for c in columns])


def dwell_means(cells: DataFrame, keys: list[str], chan: str, value: str, weight: str, position: str,
                flagged: Column, zero_row: Column, skip_first: int) -> DataFrame:
    """Per dwell and channel: weighted mean; flagged cells and all-zero rows
    carry no weight; the first rows of a dwell are dropped."""
    keep = cells.where((F.col(position) >= skip_first) & (F.col(keys[-1]) >= 0))
    return keep.groupBy(*keys, chan).agg(weighted_mean(F.col(value), F.col(weight), flagged | zero_row).alias("mean"))


STATS = {"mean": F.avg, "min": F.min, "max": F.max}


def block_stats(cells: DataFrame, keys: list[str], chan: str, value: str, stat: str | Fold = "median",
                limit: int = GROUP_LIMIT) -> DataFrame:
    """One value per block and channel by a named reduction or a fold of the user's own."""
    if isinstance(stat, Fold):
        return folded(cells, [*keys, chan], F.col(value), stat)
    if stat == "median":
        return quantiles(cells, [*keys, chan], F.col(value), {"value": 0.5}, limit=limit).drop("n")
    return cells.groupBy(*keys, chan).agg(STATS[stat](value).alias("value"))


def block_times(rows: DataFrame, keys: list[str], time: str, load: str) -> DataFrame:
    """Per block: mean, first and last time, rows, mean of the finite loads."""
    return rows.groupBy(*keys).agg(F.avg(time).alias("t"), F.min(time).alias("t_start"), F.max(time).alias("t_stop"),
                                   F.count(F.lit(1)).alias("n"), F.avg(F.when(~F.isnan(load), F.col(load))).alias("t_load"))


def visit_log(visits: DataFrame, n: str, regime: str, min_rows: int, regimes: list[str]) -> DataFrame:
    """Counts of visits found, dropped for size or regime, and kept."""
    small, known = F.col(n) < min_rows, F.coalesce(F.col(regime).isin(*regimes), F.lit(False))
    return visits.agg(F.count(F.lit(1)).alias("found"), F.count_if(small).alias("dropped_partial"),
                      F.count_if(~small & ~known).alias("dropped_regime"), F.count_if(~small & known).alias("kept"))


def mad_scale(df: DataFrame, keys: list[str], value: Column, floor: float = 1.0) -> DataFrame:
    """Center and scale with the scale floored and a missing center taken as 0."""
    out = with_mad(df, keys, value, "center", "scale")
    return out.withColumn("center", F.coalesce("center", F.lit(0.0))).withColumn(
        "scale", F.greatest(F.coalesce("scale", F.lit(floor)), F.lit(floor)))


def waterfall_stats(cells: DataFrame, keys: list[str], row: str, chan: str, value: str, flagged: Column,
                    limit: int = GROUP_LIMIT) -> DataFrame:
    """Summary of a waterfall per group: sizes, zeros, flags, power range."""
    mag = F.abs(F.col(value))
    work = cells.withColumn("_m", mag).withColumn("_f", flagged.cast("double"))
    per_row = work.groupBy(*keys, row).agg(F.max("_m").alias("_top"))
    rows = per_row.groupBy(*keys).agg(F.count(F.lit(1)).alias("ntimes"), F.count_if(F.col("_top") == 0).alias("n_zero_rows"))
    per_chan = work.groupBy(*keys, chan).agg(F.avg("_m").alias("_mean"))
    peak = per_chan.groupBy(*keys).agg(F.count(F.lit(1)).alias("nchan"),
                                       F.max_by(chan, F.struct(F.col("_mean"), -F.col(chan))).alias("peak_chan"))
    flat = work.groupBy(*keys).agg(F.avg((F.col("_m") == 0).cast("double")).alias("zero_frac"), F.avg("_f").alias("flag_frac"),
                                   F.max("_m").alias("max_power"))
    med = quantiles(work, keys, F.when(F.col("_m") > 0, F.col("_m")), {"med": 0.5}, limit=limit).drop("n")
    out = flat
    for part in (rows, peak, med):
        out = attach(out, part, keys)
    power = F.coalesce("med", F.lit(0.0))
    return out.withColumn("med_power", power).withColumn("dyn_range_db", F.when(
        F.col("med_power") > 0, 10 * F.log10(F.col("max_power") / F.col("med_power"))).otherwise(0.0)).drop("med")


def occupancy_broadcast(cells: DataFrame, row: str, chan: str, flag: str, row_above: float, chan_above: float) -> DataFrame:
    """Flag whole channels and rows whose share of flagged cells, on the input
    flags, is strictly above the threshold."""
    share = F.avg(F.col(flag).cast("double"))
    by_chan = cells.groupBy(chan).agg((share > chan_above).alias("_c"))
    by_row = cells.groupBy(row).agg((share > row_above).alias("_r"))
    out = attach(attach(cells, by_chan, [chan]), by_row, [row])
    return out.withColumn(flag, F.col(flag) | F.col("_c") | F.col("_r")).drop("_c", "_r")


def flag_summary(cells: DataFrame, day: str, input: str, band: str, flags: str) -> DataFrame:
    """Counts and fractions per (day, input) and per (day, input, band).

    Fractions are of sky cells: neither calibration nor wrapped."""
    f = F.col(flags)
    sky = ~bits.any_of(f, bits.CAL | bits.OVERFLOW)
    hits = {"rfi": bits.INTERFERENCE, **bits.CATEGORY_BITS}
    counts = cells.groupingSets([[day, input], [day, input, band]], day, input, band).agg(
        F.grouping(band).alias("_all"), F.count_if(sky).alias("n_sky"),
        F.count_if(bits.any_of(f, bits.CAL)).alias("n_cal"), F.count_if(bits.any_of(f, bits.OVERFLOW)).alias("n_overflow"),
        *[F.count_if(sky & bits.any_of(f, m)).alias(f"_{n}") for n, m in hits.items()])
    return counts.select(day, input, F.when(F.col("_all") == 1, "all").otherwise(F.col(band)).alias(band),
                         "n_sky", "n_cal", "n_overflow",
                         *[(F.col(f"_{n}") / F.greatest(F.col("n_sky"), F.lit(1))).alias(f"frac_{n}") for n in hits])


def comb_phase(cells: DataFrame, keys: list[str], chan: str, value: str, spacing: int, min_excess: float,
               limit: int = GROUP_LIMIT) -> DataFrame:
    """Residue class with the largest median, and its excess over the median of
    the positive values; below ``min_excess`` there is no phase."""
    work = cells.select(*keys, F.pmod(F.col(chan), F.lit(spacing)).alias("_phase"), F.abs(F.col(value)).alias("_m"))
    base = quantiles(work, keys, F.when(F.col("_m") > 0, F.col("_m")), {"_base": 0.5}, limit=limit).drop("n")
    score = quantiles(work, [*keys, "_phase"], F.col("_m"), {"_score": 0.5}, limit=limit)
    best = score.groupBy(*keys).agg(F.max_by("_phase", F.struct(F.col("_score"), -F.col("_phase"))).alias("_phase"),
                                    F.max("_score").alias("_score"))
    excess = F.try_divide(F.col("_score"), F.col("_base"))
    return attach(best, base, keys).select(*keys, F.when(excess >= min_excess, F.col("_phase")).alias("phase"), excess.alias("excess"))


def normalize_by_mean(cells: DataFrame, chan: str, value: str, valid: Column, eps: float = 1e-12) -> DataFrame:
    """Divide each channel by its valid mean; NULL where that mean is about 0."""
    means = cells.groupBy(chan).agg(F.avg(F.when(valid, F.col(value))).alias("_mean"))
    return attach(cells, means, [chan]).withColumn(
        value, F.when(F.abs("_mean") > eps, F.col(value) / F.col("_mean"))).drop("_mean")


def score_splits(df: DataFrame, series: str, split: str, data: str, model: str, good: Column) -> DataFrame:
    """Per series and split, plus split 'all': fractional RMS, R2, mean residual."""
    d, e = F.col(data), F.col(data) - F.col(model)
    sums = df.where(good).groupingSets([[series, split], [series]], series, split).agg(
        F.grouping(split).alias("_all"), F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_ee"),
        F.sum(d * d).alias("_dd"), F.var_pop(d).alias("_var"), F.avg(e).alias("mean_residual"))
    return sums.select(series, F.when(F.col("_all") == 1, "all").otherwise(F.col(split)).alias(split), "n",
                       F.sqrt(F.try_divide(F.col("_ee"), F.col("_dd"))).alias("fractional_rms"),
                       (1 - F.col("_ee") / F.nullif(F.col("n") * F.col("_var"), F.lit(0.0))).alias("r_squared"), "mean_residual")


def nonneg_gain(model: Column, data: Column, use: Column) -> Column:
    """Aggregate: the non-negative least-squares gain of data on model."""
    num = F.coalesce(F.sum(F.when(use, model * data)), F.lit(0.0))
    den = F.coalesce(F.sum(F.when(use, model * model)), F.lit(0.0))
    return F.greatest(num / F.greatest(den, F.lit(1e-30)), F.lit(0.0))


def isolation(df: DataFrame, series: str, data: Column, background: Column, good: Column, error: DataFrame,
              limit: int = GROUP_LIMIT) -> DataFrame:
    """90th percentile of (D - B)/B over good rows, in units of the background error."""
    ratio = F.when(good, F.try_divide(data - background, background))
    p90 = quantiles(df, [series], ratio, {"signal": 0.9}, limit=limit)
    return attach(p90, error, [series]).select(series, "n", "signal", F.try_divide(F.col("signal"), F.col("error")).alias("isolation"))


def residual_audit(cells: DataFrame, row: str, expect: Column, value: Column, tol_frac: float, max_off: int,
                   limit: int = GROUP_LIMIT) -> DataFrame:
    """Calibrated reference rows against what they should read: one row of
    residual statistics, share of cells off, rows with too many cells off."""
    off = F.abs(value - expect) > tol_frac * F.abs(expect)
    work = cells.select(row, (value - expect).alias("_r"), off.alias("_off"))
    med = quantiles(work, [row], F.col("_r"), {"_med": 0.5}, limit=limit).drop("n")
    per_row = attach(work.groupBy(row).agg(F.count_if("_off").alias("_k"), F.count("_off").alias("_n")), med, [row])
    flat = per_row.agg(F.count(F.lit(1)).alias("rows"), (F.sum("_k") / F.sum("_n")).alias("fraction_off"),
                       F.count_if(F.col("_k") > max_off).alias("rows_off"))
    center = quantiles(per_row, [], F.col("_med"), {"median": 0.5}, limit=limit).drop("n")
    spread = quantiles(per_row, [], F.abs("_med"), {"p95_abs": 0.95, "max_abs": 1.0}, limit=limit).drop("n")
    return attach(attach(flat, center, []), spread, [])


def coverage(cells: DataFrame, row: str, calibrated: Column, min_fraction: float = 0.99) -> DataFrame:
    """Share of calibrated cells, and of rows with enough of them."""
    per_row = cells.groupBy(row).agg(F.avg(calibrated.cast("double")).alias("_f"), F.count(F.lit(1)).alias("_n"),
                                     F.count_if(calibrated).alias("_k"))
    return per_row.agg(F.count(F.lit(1)).alias("rows"), (F.sum("_k") / F.sum("_n")).alias("cell_fraction"),
                       F.count_if(F.col("_f") >= min_fraction).alias("rows_calibrated"))


def gross_excursions(cells: DataFrame, row: str, chan: str, value: str, valid: Column, factor: float = 5.0,
                     negative_factor: float = 2.0, limit: int = GROUP_LIMIT) -> DataFrame:
    """row -> flagged: some channel is beyond factor x its 99th percentile of
    positives, or below -negative_factor x it."""
    v = F.when(valid, F.col(value))
    ref = quantiles(cells, [chan], F.when(v > 0, v), {"_pos": 0.99}, limit=limit).drop("n")
    alt = quantiles(cells, [chan], F.abs(v), {"_abs": 0.99}, limit=limit).drop("n")
    work = attach(attach(cells.withColumn("_v", v), ref, [chan]), alt, [chan])
    scale = F.greatest(F.coalesce("_pos", "_abs"), F.lit(1e-30))
    hit = F.coalesce((F.col("_v") > factor * scale) | (F.col("_v") < -negative_factor * scale), F.lit(False))
    return work.groupBy(row).agg(F.bool_or(hit).alias("flagged"))


def fused_angle(a: Column, b: Column, w: float) -> Column:
    """Weighted circular mean of two angles in degrees; one alone as it is."""
    mean = F.degrees(F.atan2(w * F.sin(F.radians(a)) + (1 - w) * F.sin(F.radians(b)),
                             w * F.cos(F.radians(a)) + (1 - w) * F.cos(F.radians(b))))
    return F.coalesce(mean, a, b)


def reject_summary(df: DataFrame, file: str, rule: str, status: str) -> DataFrame:
    """Rejected files and rows per rule."""
    per_file = df.where(F.col(status) == "reject").groupBy(rule, file).agg(F.count(F.lit(1)).alias("_n"))
    return per_file.groupBy(rule).agg(F.count(F.lit(1)).alias("files"), F.sum("_n").alias("rows"), F.min(file).alias("first_file"))


def run_totals(cells: DataFrame, keys: list[str], flags: str, supported: Column) -> DataFrame:
    """Cells and the excluded, interference and supported fractions (NULL without cells)."""
    f = F.col(flags)
    n = F.count(F.lit(1))
    share = lambda c: F.count_if(c) / F.nullif(n, F.lit(0))
    return cells.groupBy(*keys).agg(n.alias("cells"), share(bits.excluded(f)).alias("excluded"),
                                    share(bits.interference(f)).alias("interference"), share(supported).alias("supported"))


def negative_fraction(cells: DataFrame, chan: str, value: str) -> DataFrame:
    return cells.groupBy(chan).agg(F.try_divide(F.count_if(F.col(value) < 0), F.count(value)).alias("negative"))


def overflow_top(df: DataFrame, channels: str, top: int = 8) -> DataFrame:
    """Channels with most wrapped samples over per-file maps of channel -> count."""
    spread = df.select(F.explode(channels).alias("chan", "_n"))
    return spread.groupBy("chan").agg(F.sum("_n").alias("wrapped")).orderBy(F.desc("wrapped"), "chan").limit(top)


def locked_teeth(chan: Column, spacing: int) -> dict[float, Column]:
    """phase -> tooth predicate of a comb at fixed channels."""
    return {float(p): F.pmod(chan, F.lit(spacing)) == p for p in range(spacing)}


def walking_teeth(freq: Column, spacing: float, width: float, phases: int = 16) -> dict[float, Column]:
    """phase -> tooth predicate of a comb off the channel grid: within half a channel."""
    out = {}
    for i in range(phases):
        off = (freq - i * spacing / phases) / spacing
        out[i * spacing / phases] = F.abs(off - F.rint(off)) * spacing <= 0.5 * width
    return out


def tooth_contrast(spectra: DataFrame, keys: list[str], resid: str, teeth: dict[float, Column], limit: int = GROUP_LIMIT) -> DataFrame:
    """keys -> contrast and phase of a comb: median of its teeth minus that of
    the others in units of the residual MAD, at the best phase.

    Input: in-band residuals of one median spectrum per group, one row per
    channel.  A phase needs 8 teeth and 8 others, the band 32 channels."""
    offers = F.array(*[F.struct(F.lit(p).alias("phase"), hit.alias("tooth")) for p, hit in teeth.items()])
    work = with_mad(spectra.select(*keys, F.col(resid).alias("_r"), offers.alias("_o")), keys, F.col("_r"), "_c", "_s", limit=limit)
    scale = work.groupBy(*keys).agg(F.max("_s").alias("_s"), F.count(F.lit(1)).alias("_all"))
    # every channel counts as tooth or other of each phase: a spectrum times the phases
    sides = work.select(*keys, "_r", F.inline("_o"))
    med = quantiles(sides, [*keys, "phase", "tooth"], F.col("_r"), {"_m": 0.5}, limit=limit)
    pick = lambda tooth, c: F.max(F.when(F.col("tooth") == tooth, F.col(c)))
    both = med.groupBy(*keys, "phase").agg(pick(True, "_m").alias("_mt"), pick(False, "_m").alias("_mo"),
                                           pick(True, "n").alias("_nt"), pick(False, "n").alias("_no"))
    both = attach(both, scale, keys).where("_nt >= 8 AND _no >= 8 AND _all >= 32 AND _s >= 1e-12")
    both = both.withColumn("contrast", (F.col("_mt") - F.col("_mo")) / F.col("_s"))
    return both.groupBy(*keys).agg(F.max("contrast").alias("contrast"),
                                   F.max_by("phase", F.struct(F.col("contrast"), -F.col("phase"))).alias("phase"))


def comb_present(cells: DataFrame, keys: list[str], chan: str, value: str, lo: int, hi: int, snr: float = 20.0,
                 min_tones: int = 20, limit: int = GROUP_LIMIT) -> DataFrame:
    """Whether at least ``min_tones`` channels of [lo, hi) have a second
    difference above ``snr`` MADs of the band."""
    from dwellgrid.operators.rolling import second_difference
    d2 = second_difference(cells, keys, chan, value, "_d", limit=limit).where((F.col(chan) >= lo) & (F.col(chan) < hi))
    scaled = with_mad(d2.where("_d IS NOT NULL"), keys, F.col("_d"), "_c", "_s", limit=limit)
    tones = F.count_if(F.col("_d") > snr * F.greatest(F.col("_s"), F.lit(1e-30)))
    return scaled.groupBy(*keys).agg(tones.alias("tones"), (tones >= min_tones).alias("present"))


def line_fit(df: DataFrame, keys: list[str], x: Column, y: Column, sigma: Column, use: Column) -> DataFrame:
    """Regression y = a + b x per group with residual chi-square per point and
    the standard error of b, from sums alone (centred by the built-ins)."""
    work = df.where(use).select(*keys, x.alias("_x"), y.alias("_y"), sigma.alias("_s"))
    fit = work.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("b"), F.regr_intercept("_y", "_x").alias("a"),
        F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_syy("_y", "_x").alias("_syy"), F.regr_sxy("_y", "_x").alias("_sxy"),
        F.avg(F.col("_s") * F.col("_s")).alias("_ss"))
    rss = F.greatest(F.col("_syy") - F.col("b") * F.col("_sxy"), F.lit(0.0))
    return fit.select(*keys, "n", "a", "b", F.sqrt(F.try_divide(F.try_divide(rss, F.col("n") - 2), F.col("_sxx"))).alias("b_error"),
                      F.try_divide(rss, F.col("n") * F.col("_ss")).alias("chi2"))
