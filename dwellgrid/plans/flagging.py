"""Flagging jobs put together from the parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.functions import bits
from dwellgrid.operators import aggregates as ag
from dwellgrid.operators import rolling as ro
from dwellgrid.operators.fits import segment_background
from dwellgrid.operators.ordered import GROUP_LIMIT, Size, attach, framed, measure
from dwellgrid.operators.quantiles import with_mad, with_median
from dwellgrid.session import cut


@dataclass(frozen=True)
class Bands:
    """Channel predicates of the emitter bands."""

    analysis: Column
    fm: Column
    dtv: Column
    orbit: Column
    local: Column  # where a steady line is taken for one's own


def overflow_repair(cells: DataFrame, keys: list[str], chan: str, raw: str, size: Size | None = None,
                    limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``wrapped`` and ``logp``: a wrapped (negative) sample gets its
    channel's median log power, 0 without one."""
    wrapped = F.col(raw) < 0
    logp = F.log10(F.greatest(F.col(raw).cast("double"), F.lit(1.0)))
    out = cells.withColumns({"wrapped": F.coalesce(wrapped, F.lit(False)), "_logp": logp})
    out = with_median(out, [*keys, chan], F.when(~F.col("wrapped"), F.col("_logp")), "_fill", size, limit)
    return out.select(*cells.columns, "wrapped", F.when(F.col("wrapped"), F.coalesce("_fill", F.lit(0.0))).otherwise(F.col("_logp")).alias("logp"))


def categorise(pixel: Column, steady: Column, own: Column, broadband: Column, scatter: Column, bands: Bands) -> Column:
    """Category bit of a cell, attributable causes first; 0 when not flagged."""
    air = bands.fm | bands.dtv
    return (F.when(~(pixel | steady), 0).when(own | (steady & bands.local), bits.SELF)
            .when(broadband & air, bits.BROADBAND).when(scatter & air, bits.SCATTER)
            .when(bands.orbit & ~air, bits.ORBIT).otherwise(bits.UNKNOWN))


def identify_combs(medians: DataFrame, keys: list[str], chan: str, value: str, in_band: Column,
                   combs: list[tuple[str, int, dict[float, Column]]], threshold: float = 3.0,
                   limit: int = GROUP_LIMIT) -> DataFrame:
    """keys -> for each comb its contrast, phase and whether it is credited:
    at least the threshold and above every comb listed before it.

    A comb is (name, half width of its smoothing, teeth by phase)."""
    out = medians.select(*keys).distinct()
    best = F.lit(float("-inf"))
    for name, half, teeth in combs:
        smooth = ro.rolling_median(medians, keys, [chan], F.col(value), half, "_smooth", limit=limit)
        smooth = smooth.where(in_band).withColumn("_resid", F.col(value) - F.col("_smooth"))
        got = ag.tooth_contrast(smooth, keys, "_resid", teeth, limit)
        got = got.select(*keys, F.col("contrast").alias(f"{name}_contrast"), F.col("phase").alias(f"{name}_phase"))
        out = attach(out, got, keys)
        c = F.coalesce(f"{name}_contrast", F.lit(0.0))
        out = out.withColumn(f"{name}_detected", (c >= threshold) & (c > best))
        best = F.greatest(best, c)
    return out


def flag_cells(cells: DataFrame, keys: list[str], row: str, chan: str, raw: str, antenna: Column, bands: Bands,
               combs: list[tuple[str, int, dict[float, Column]]], *, clip: float = 5.0, steady_clip: float = 6.0,
               comb_threshold: float = 3.0, limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``flags``: repair, transient and steady tracks, combs, row events,
    category; calibration rows get the calibration bit; wrapped samples lose
    interference bits and get the overflow bit last.  All-zero groups drop out."""
    size = measure(cells, [*keys, chan])
    work = overflow_repair(cells, keys, chan, raw, size, limit).withColumn("_ant", antenna)
    work = cut(with_median(work, keys, F.col("logp"), "_level", limit=limit).where("_level > 0").drop("_level"))
    # transient departures along time, steady lines along channel
    pix = cut(ro.transient_track(work, chan, [row], "logp", F.col("_ant"), clip=clip, keys=keys, size=size, limit=limit))
    steady = ro.persistent_track(work, keys, chan, "logp", F.col("_ant"), bands.analysis, clip=steady_clip, size=size, limit=limit)
    steady = cut(steady)  # one row per channel and group, read by several small medians
    found = identify_combs(steady.select(*keys, chan, "med"), keys, chan, "med", bands.analysis, combs, comb_threshold, limit)
    out = attach(pix, steady.select(*keys, chan, "persistent"), [*keys, chan])
    out = attach(out, found, keys)
    own = F.lit(False)
    for name, _, teeth in combs:
        for phase, tooth in teeth.items():
            own = own | (F.col(f"{name}_detected") & (F.col(f"{name}_phase") == phase) & tooth & bands.analysis)
    share = lambda where: F.coalesce(F.avg(F.when(where, F.col("transient").cast("double"))), F.lit(0.0))
    events = pix.groupBy(*keys, row).agg((share(bands.analysis) > 0.15).alias("_broad"),
                                         ((share(bands.fm) > 0.05) & (share(bands.dtv) > 0.05)).alias("_scatter"))
    out = attach(out, events, [*keys, row])
    category = categorise(F.col("transient"), F.coalesce("persistent", F.lit(False)), F.coalesce(own, F.lit(False)),
                          F.col("_broad"), F.col("_scatter"), bands)
    flags = category.bitwiseOR(F.when(~F.col("_ant"), bits.CAL).otherwise(0))
    flags = F.when(F.col("wrapped"), flags.bitwiseAND(255 & ~bits.INTERFERENCE).bitwiseOR(bits.OVERFLOW)).otherwise(flags)
    return out.select(*cells.columns, flags.alias("flags"))


def quicklook_flags(cells: DataFrame, keys: list[str], row: str, chan: str, value: str, *, nsig: float = 8.0, spacing: int = 16,
                    pad: int = 1, min_excess: float = 3.0, limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``flag``: zeros, comb channels with padding, mostly dead channels, and
    outliers from the moving median over the remaining channels of live rows."""
    work = cells.withColumn("_m", F.abs(F.col(value).cast("double")))
    rows = work.groupBy(*keys, row).agg((F.max("_m") > 0).alias("_live"))
    work = attach(work, rows, [*keys, row])
    alive = work.where("_live")
    med = cut(ag.block_stats(alive, keys, chan, "_m", limit=limit))
    comb = ag.comb_phase(med, keys, chan, "value", spacing, min_excess, limit).select(*keys, "phase")
    dead = alive.groupBy(*keys, chan).agg((F.avg((F.col("_m") == 0).cast("double")) > 0.9).alias("_dead"))
    work = attach(attach(work, comb, keys), dead, [*keys, chan])
    side = F.pmod(F.col(chan) - F.col("phase"), F.lit(spacing))
    static = F.coalesce(F.least(side, spacing - side) <= pad, F.lit(False))
    work = work.withColumn("_static", static | F.coalesce("_dead", F.lit(True)))
    tested = F.col("_live") & ~F.col("_static")
    # the remaining channels of a row, in order: bounded by the channel count
    packed = work.where(tested).groupBy(*keys, row).agg(
        F.array_sort(F.collect_list(F.struct(chan, "_m", F.struct(*cells.columns).alias("_c")))).alias("_p"))
    packed = packed.withColumn("_a", F.transform("_p", lambda s: s["_m"]))
    judged = ro.median_flagger(packed, keys, "_a", nsig, limit=limit)
    hits = judged.select(F.inline(F.arrays_zip(F.col("_p").alias("p"), F.col("flags").alias("f")))).select("p._c.*", F.col("f").alias("_f"), F.col("p._m").alias("_m"))
    hits = hits.select(*cells.columns, (F.col("_f") | (F.col("_m") == 0)).alias("flag"))
    rest = work.where(~tested).select(*cells.columns, (F.col("_static") | (F.col("_m") == 0)).alias("flag"))
    return hits.unionByName(rest)


@dataclass(frozen=True)
class Cuts:
    """Thresholds of the group detector (fixed values of the method)."""

    fit_clip: float = 8.0
    point: float = 6.0
    other_point: float = 8.0
    negative: float = 8.0
    cross: float = 8.0
    group: float = 6.0
    group_cell: float = 2.0
    group_fraction: float = 0.35
    tile: int = 8
    comb: float = 6.0
    comb_tooth: float = 2.0
    comb_fraction: float = 0.10
    comb_min_teeth: int = 16
    comb_spacing: int = 8
    quiet: tuple[float, float] = (88.0, 108.0)
    regions: tuple[tuple[float, float], ...] = ((35.0, 108.0), (108.0, 174.0), (174.0, 235.0))


REPORT_BANDS = {  # fixed values: report bands in MHz, half open
    "50-88": (50.0, 88.0), "88-108": (88.0, 108.0), "108-137": (108.0, 136.5), "137-138": (136.5, 138.5),
    "138-174": (138.5, 174.0), "174-216": (174.0, 216.0), "216-235": (216.0, 235.0),
}


def _center_scale(df: DataFrame, keys: list[str], value: Column, center: str, scale: str, limit: int, size: Size | None = None) -> DataFrame:
    """Group median (0 without) and MAD scale (at least 1) over non-NULL values."""
    out = with_mad(df, keys, value, center, scale, size, limit)
    return out.withColumn(center, F.coalesce(center, F.lit(0.0))).withColumn(scale, F.greatest(F.coalesce(scale, F.lit(1.0)), F.lit(1.0)))


def group_triggers(cells: DataFrame, keys: list[str], row: str, chan: str, freq: str, z: str, cross: str, valid: str, reference: str,
                   cuts: Cuts = Cuts(), bands: dict[str, tuple[float, float]] | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """Add one boolean per reason: point excess in units of the channel's
    measured scatter, negative residuals, cross change, comb groups (channels
    modulo 8) and groups of a report band or an 8-channel tile of it.

    ``z`` NULL stands for a residual that is not finite.  Rows of one group
    (``keys``) are compared with the group's reference rows, channel by channel."""
    bands = REPORT_BANDS if bands is None else bands
    f, zc = F.col(freq), F.col(z)
    ok, ref = F.col(valid), F.col(reference) & F.col(valid)
    in_report = F.lit(False)
    for lo, hi in bands.values():
        in_report = in_report | ((f >= lo) & (f < hi))
    size = measure(cells, [*keys, chan])
    work = _center_scale(cells, [*keys, chan], F.when(ref & (zc < cuts.fit_clip), zc), "_c", "_s", limit, size)
    threshold = F.when(in_report, cuts.point).otherwise(cuts.other_point)
    work = work.withColumns({
        "positive_auto_excess": ok & F.coalesce(zc / F.col("_s") > threshold, F.lit(False)),
        "negative_or_model_failure": ok & F.coalesce(zc < -cuts.negative, F.lit(True)),
        "cross_change": ok & F.coalesce(F.col(cross) > cuts.cross, F.lit(False)),
        "_std": F.coalesce((zc - F.col("_c")) / F.col("_s"), F.lit(0.0))})
    # curvature along channel: teeth stand out of both neighbours
    side = F.struct(F.coalesce(zc, F.lit(0.0)).alias("z"), (ok & zc.isNotNull()).alias("e"))
    work = ro.beside(work, [*keys, row], chan, {"_l": (side, -1), "_r": (side, 1)}, limit, measure(cells, [*keys, row]))
    quiet = (f >= cuts.quiet[0]) & (f < cuts.quiet[1])
    work = work.withColumns({
        "_curv": (F.coalesce(zc, F.lit(0.0)) - (F.col("_l.z") + F.col("_r.z")) / 2) / (1.5 ** 0.5),
        "_ev": F.coalesce(ok & zc.isNotNull() & F.col("_l.e") & F.col("_r.e") & ~quiet, F.lit(False))}).drop("_l", "_r")
    work = _center_scale(work, [*keys, chan], F.when(F.col("_ev") & ref, F.col("_curv")), "_cc", "_cs", limit, size)
    work = work.withColumns({"_tooth": F.coalesce(F.col("_curv") / F.col("_cs"), F.lit(0.0)), "_phase": F.pmod(F.col(chan), F.lit(cuts.comb_spacing))})
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    hit = F.col("_ev") & (F.col("_tooth") > cuts.comb_tooth)
    # a phase of a row is a share of one spectrum: sums beside the cells, no join back
    phase = Window.partitionBy(*keys, row, "_phase")
    number = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(phase)
    work = work.withColumns({
        "_n": number(F.col("_ev")), "_sum": F.sum(F.when(F.col("_ev"), clip(F.col("_tooth"), -3.0, 8.0)).otherwise(0.0)).over(phase), "_hits": number(hit),
        **{f"_g{i}": number(hit & (f >= lo) & (f < hi)) for i, (lo, hi) in enumerate(cuts.regions)}})
    on = ((F.col("_sum") / F.sqrt(F.greatest("_n", F.lit(1))) > cuts.comb) & (F.col("_hits") >= F.greatest(F.lit(4.0), cuts.comb_fraction * F.col("_n")))
          & (F.col("_n") >= cuts.comb_min_teeth))
    for i in range(len(cuts.regions)):
        on = on & (F.col(f"_g{i}") >= 2)
    reasons = ["positive_auto_excess", "negative_or_model_failure", "cross_change"]
    used = dict.fromkeys([*cells.columns, *reasons, "_std"])
    work = cut(work.select(*used, on.alias("_comb")))  # read for the bands and for the result
    # a cell belongs to its band and to one tile of it
    low = cells.groupBy(chan).agg(F.min(freq).alias("_f"))
    groups = None
    for name, (lo, hi) in bands.items():
        inside = low.where((F.col("_f") >= lo) & (F.col("_f") < hi))
        first = inside.agg(F.min(chan).alias("_first"))
        tiles = attach(inside, first, []).select(chan, F.explode(F.array(
            F.lit(name), F.concat(F.lit(f"{name}/tile"), F.floor((F.col(chan) - F.col("_first")) / cuts.tile).cast("string")))).alias("_group"))
        groups = tiles if groups is None else groups.unionByName(tiles)
    sizes = groups.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    groups = cut(attach(groups, sizes, ["_group"]).where("_size >= 3").select(chan, "_group"))  # two rows per channel
    member = work.join(groups, chan)
    good = F.col(valid) & ~F.col("_comb")
    per = member.groupBy(*keys, "_group", row).agg(
        F.count_if(good).alias("_n"), F.sum(F.when(good, clip(F.col("_std"), -3.0, 6.0)).otherwise(0.0)).alias("_sum"),
        F.count_if(good & (F.col("_std") > cuts.group_cell)).alias("_high"), F.bool_or(ref).alias("_ref"))
    per = per.withColumn("_raw", F.col("_sum") / F.sqrt(F.greatest("_n", F.lit(1))))
    per = cut(per)  # one row per (row, group), read for its medians and its hits
    per = _center_scale(per, [*keys, "_group"], F.when(F.col("_ref"), F.col("_raw")), "_gc", "_gs", limit)
    lit = (((F.col("_raw") - F.col("_gc")) / F.col("_gs") > cuts.group) & (F.col("_high") / F.greatest("_n", F.lit(1)) >= cuts.group_fraction) & (F.col("_n") >= 3))
    hits = per.where(lit).select(*keys, row, "_group").join(groups, "_group").select(*keys, row, chan).distinct().withColumn("_band", F.lit(True))
    work = attach(work, hits, [*keys, row, chan])
    return work.select(*cells.columns, *reasons,
                       (ok & F.col("_comb")).alias("comb_group_trigger"), (ok & F.coalesce("_band", F.lit(False))).alias("band_group_trigger"))


def segment_flags(cells: DataFrame, keys: list[str], row: str, chan: str, freq: str, data: str, noise: Column, reference: Column, cross: str, *,
                  cuts: Cuts = Cuts(), guard_rows: int = 1, max_scatter: float = 5.0, limit: int = GROUP_LIMIT) -> DataFrame:
    """Cells with their reason bits: background, detection, guard rows.

    ``keys`` (all of them) hold the segment; segments of two inputs that share a
    number stay apart.  The background is the separable one of
    ``fits.segment_background``; ``noise`` is the expected scatter of
    data / background - 1."""
    seen = segment_background(cells, keys, row, chan, data, noise, reference, clip=cuts.fit_clip)
    on = F.coalesce(reference, F.lit(False))
    seen = cut(seen.withColumns({"z": (F.col(data) / F.col("model") - 1) / noise, "_ok": F.col("model").isNotNull(), "_on": on}))
    out = group_triggers(seen.withColumn("_valid", F.col("_ok") & F.col("_on")), keys, row, chan, freq, "z", cross, "_valid", "_on", cuts, limit=limit)
    out = _center_scale(out, [*keys, chan], F.when(F.col("_valid"), F.col("z")), "_mid", "_scatter", limit, measure(seen, [*keys, chan]))
    reasons = {n: F.col(n) for n in ("positive_auto_excess", "negative_or_model_failure", "cross_change", "comb_group_trigger", "band_group_trigger")}
    reasons |= {"non_sky_switch_state": ~F.col("_on"), "unsupported_background": ~F.col("_ok")}
    hard = F.lit(False)
    for c in reasons.values():
        hard = hard | c
    out = framed_rows(out.withColumn("_hard", hard), [*keys, chan], row, "_hard", guard_rows, "_near", limit)
    reasons |= {"high_scatter": F.col("_valid") & (F.col("_scatter") > max_scatter), "guard": F.col("_near") & ~F.col("_hard")}
    return out.select(*keys, row, chan, bits.encode(reasons).alias("flags"))


def framed_rows(df: DataFrame, keys: list[str], order: str, flag: str, reach: int, name: str, limit: int) -> DataFrame:
    """Add whether a row within ``reach`` is flagged."""
    return framed(df, keys, [order], reach, reach, lambda f, _: {name: F.max(flag).over(f)}, limit=limit)
