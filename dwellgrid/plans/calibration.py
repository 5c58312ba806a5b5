"""Calibration jobs: rows to kelvin, and checks of the result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions import complexnum as C
from dwellgrid.functions import scalars as S
from dwellgrid.operators import aggregates as ag
from dwellgrid.operators import segments as sg
from dwellgrid.operators import timejoins as tj
from dwellgrid.operators.ordered import GROUP_LIMIT, attach
from dwellgrid.operators.quantiles import quantiles
from dwellgrid.operators.rangejoins import in_intervals


@dataclass(frozen=True)
class Limits:
    """Gaps and tolerances of the node tables, seconds and kelvin."""

    # fixed values of the method
    max_cal_gap_s: float = 3600.0
    max_s11_gap_s: float = 7200.0
    s11_hold_s: float = 1800.0
    therm_tol_s: float = 60.0
    t_ns_k: float = 917.0


def calibrated_visits(rows: DataFrame, time: str, ties: list[str], power: str, weight: Column, state: str, want: str,
                      start: float, stop: float, gap_s: float, nodes: DataFrame, node_time: str, scale: str, offset: str,
                      tolerance_s: float, limit: int = GROUP_LIMIT) -> DataFrame:
    """Mean power per visit of one state, in calibrated units, in time order."""
    chosen = rows.where((F.col(state) == want) & (F.col(time) >= start) & (F.col(time) < stop))
    visited = sg.visits(chosen, time, ties, gap_s, limit=limit).where("visit >= 0")
    means = visited.groupBy("visit").agg(F.count(F.lit(1)).alias("n"), ag.weighted_mean(F.col(time), weight).alias("t"),
                                         ag.weighted_mean(F.col(power), weight).alias("power"))
    near = tj.nearest(means, "t", nodes, node_time, [scale, offset], tolerance_s=tolerance_s, prefix="_", limit=limit)
    return near.select("visit", "n", "t", "power", F.col("_dt").alias("node_dt"),
                       (F.col(f"_{scale}") * F.col("power") + F.col(f"_{offset}")).alias("calibrated")).orderBy("visit")


def calibrate_rows(rows: DataFrame, ids: list[str], time: str, visits: dict[str, DataFrame], reflections: dict[str, DataFrame],
                   therm: DataFrame, limits: Limits, applies: Column, window: tuple[str, str] | None = None,
                   limit: int = GROUP_LIMIT) -> DataFrame:
    """Add scale and offset of T = scale P + offset to every row.

    ``visits`` has nodes (t, p, label) of ``amb`` and ``non``; ``reflections``
    nodes (t, re, im, label) of ``ant``, ``amb``, ``rec``; ``therm`` (t, k).
    All nodes and the rows share one time line, so one sort serves every lookup;
    rows without all of them stay, as NULLs.
    """
    streams = {n: tj.Stream(d, "t", ["p", "label"]) for n, d in visits.items()}
    streams |= {f"g_{n}": tj.Stream(d, "t", ["re", "im", "label"]) for n, d in reflections.items()}
    streams["load"] = tj.Stream(therm, "t", ["k"])
    both = tj.around_many(rows, time, streams, limit=limit)
    sides = lambda n: (F.col(f"prev_{n}"), F.col(f"next_{n}"), F.col(time))
    cols = {}
    for n in visits:
        cols[f"{n}_p"] = tj.bracket_values(*sides(n), ["p"], "label", limits.max_cal_gap_s)["p"]
    for n in reflections:
        got = tj.bracket_values(*sides(f"g_{n}"), ["re", "im"], "label", limits.max_s11_gap_s, limits.s11_hold_s)
        cols |= {f"g_{n}_re": got["re"], f"g_{n}_im": got["im"]}
    cols["t_load"] = tj.nearest_values(*sides("load"), ["k"], limits.therm_tol_s)["k"]
    out = both.select(*rows.columns, *[c.alias(n) for n, c in cols.items()])
    if window is not None:
        out = tj.window_mean_or_nearest(out.drop("t_load"), ids, time, *window, therm, "t", "k", limits.therm_tol_s, limit)
        out = out.drop("n", "dt").withColumnRenamed("k", "t_load")
    g = {name: C.cplx(F.col(f"g_{name}_re"), F.col(f"g_{name}_im")) for name in reflections}
    slope, at0 = S.calibration_line(F.col("non_p"), F.col("amb_p"), limits.t_ns_k, F.col("t_load"))
    out = out.withColumns({"_a": slope, "_b": at0})
    scale, offset = S.receiver_line(F.col("_a"), F.col("_b"), F.col("t_load"), g["ant"], g["amb"], g["rec"])
    return out.select(*rows.columns, "t_load", F.when(applies, scale).alias("scale"), F.when(applies, offset).alias("offset"))


def as_received(sweeps: DataFrame, chan: str, g_ns: Column, g_load: Column, g_rec: Column, t_off: float, t_excess: float,
                t_load: float, limit: int = GROUP_LIMIT) -> DataFrame:
    """Per channel: noise-source excess as the receiver sees it, from the mean
    reflections, and the median and largest move of single sweeps from it."""
    work = sweeps.select(chan, g_ns.alias("a"), g_load.alias("l"), g_rec.alias("r"))
    mean = lambda c: C.cplx(F.avg(f"{c}.re"), F.avg(f"{c}.im")).alias(f"m_{c}")
    conv = lambda a, l, r: C.mismatch(a, r) * (t_off + t_excess) - C.mismatch(l, r) * t_load
    means = work.groupBy(chan).agg(mean("a"), mean("l"), mean("r"))
    means = means.select(chan, conv(F.col("m_a"), F.col("m_l"), F.col("m_r")).alias("t_ns"))
    each = attach(work, means, [chan])
    move = F.abs(conv(F.col("a"), F.col("l"), F.col("r")) - F.col("t_ns"))
    spread = quantiles(each, [chan], move, {"median_move": 0.5, "max_move": 1.0}, limit=limit).drop("n")
    return attach(means, spread, [chan])


def reference_spectrum(cells: DataFrame, state: str, time: str, chan: str, value: str, sky: str, noise: str, load: str,
                       t_load: float, t_ns: float, gap_s: float, limit: int = GROUP_LIMIT) -> DataFrame:
    """Median T* per channel over sky blocks, each with its nearest calibrators."""
    rows = cells.select(time, state).distinct()
    blocks = sg.switch_blocks(rows, state, time, [], gap_s, limit)
    keyed = attach(cells, blocks.select(time, "block"), [time])
    t = blocks.groupBy("block", state).agg(F.avg(time).alias("t"))
    spec = attach(ag.block_stats(keyed, ["block"], chan, value, limit=limit), t, ["block"])
    pick = lambda s, name: spec.where(F.col(state) == s).select(chan, "t", F.col("value").alias(name))
    out = pick(sky, "p_sky")
    for s, name in ((noise, "p_non"), (load, "p_amb")):
        out = tj.nearest(out, "t", pick(s, name), "t", [name], keys=[chan], prefix=f"{name}_", limit=limit).withColumnRenamed(f"{name}_{name}", name)
    t_star = S.three_state(F.col("p_sky"), F.col("p_non"), F.col("p_amb"), F.lit(t_load), t_ns)
    return quantiles(out, [chan], t_star, {"t_star": 0.5}, limit=limit)


def cross_check(rows: DataFrame, time: str, value: Column, visits: DataFrame, visit: str, start: str, stop: str, reference: str,
                limit: int = GROUP_LIMIT) -> DataFrame:
    """One row: quantiles over visits of the ratio of the median calibrated
    value in a visit to an independent value of it."""
    inside = in_intervals(rows.select(F.col(time).alias("_at"), value.alias("_v")), "_at", visits.select(visit, start, stop), start, stop)
    med = quantiles(inside, [visit], F.col("_v"), {"_m": 0.5}, limit=limit)
    ratio = F.try_divide(F.col("_m"), F.col(reference))
    return quantiles(attach(visits, med, [visit]).where("_m IS NOT NULL"), [], ratio,
                     {"p5": 0.05, "median": 0.5, "p95": 0.95, "worst": 1.0}, limit=limit)
