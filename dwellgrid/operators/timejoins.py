"""Joins on time: nearest, bracketing, window means, cycles.

No join here compares rows with nodes pairwise.  Both are put on one time line
and every row looks up the latest node before and the earliest after it with a
running value (see ``ordered``), so the cost is one sort whatever the cadences,
and a node that serves a third of the rows is no hot join key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.scalars import ieee_divide
from dwellgrid.operators.ordered import GROUP_LIMIT, Size, attach, framed, numbered, running
from dwellgrid.operators.quantiles import quantiles


@dataclass(frozen=True)
class Stream:
    """A node table on its own cadence; times are unique within a key."""

    nodes: DataFrame
    time: str
    payload: list[str]


def around_many(rows: DataFrame, time: str, streams: dict[str, Stream], keys: list[str] | None = None,
                size: Size | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``prev_<name>`` (latest node at or before the row) and ``next_<name>``
    (earliest at or after) per stream, as structs of (t, payload).

    Rows and all streams share one time line: one sort serves them all.  A row
    without a time has neither."""
    keys = keys or []
    # many rows may share a time, or have none: a hash spreads them over slices
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "array", "struct"))]
    line = rows.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(len(streams)).alias("_k"),
                       F.xxhash64(*plain).alias("_h"), F.struct(*rows.columns).alias("_row"))
    for i, (name, s) in enumerate(streams.items()):
        node = F.struct(F.col(s.time).cast("double").alias("t"), *s.payload)
        line = line.unionByName(s.nodes.where(F.col(s.time).isNotNull()).select(
            *keys, F.col(s.time).cast("double").alias("_t"), F.lit(i).alias("_k"), F.lit(0).cast("bigint").alias("_h"),
            node.alias(f"_n_{name}")), allowMissingColumns=True)
    seen = running(line, keys, ["_t", "_k", "_h"], last={f"prev_{n}": F.col(f"_n_{n}") for n in streams},
                   next={f"_next_{n}": F.col(f"_n_{n}") for n in streams}, size=size, limit=limit)
    # rows without a time sort first: nothing lies before them, what follows is not theirs
    return seen.where(F.col("_k") == len(streams)).select("_row.*", *[c for n in streams for c in (
        F.col(f"prev_{n}"), F.when(F.col(f"prev_{n}.t") == F.col("_t"), F.col(f"prev_{n}"))
        .when(F.col("_t").isNotNull(), F.col(f"_next_{n}")).alias(f"next_{n}"))])


def around(rows: DataFrame, time: str, nodes: DataFrame, node_time: str, payload: list[str],
           keys: list[str] | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """``around_many`` for one stream, as ``prev`` and ``next``."""
    return (around_many(rows, time, {"": Stream(nodes, node_time, payload)}, keys, limit=limit)
            .withColumnRenamed("prev_", "prev").withColumnRenamed("next_", "next"))


def nearer(prev: Column, next: Column, time: Column) -> Column:
    """The nearer of two neighbours; equally near: the earlier."""
    return F.when(next["t"].isNull() | (time - prev["t"] <= next["t"] - time), prev).otherwise(next)


def nearest_values(prev: Column, next: Column, time: Column, payload: list[str], tolerance_s: float | None, strict: bool = False) -> dict[str, Column]:
    """``dt`` = row time - node time and the payload of the nearest node."""
    near = nearer(prev, next, time)
    dt = time - near["t"]
    usable = F.lit(True)
    if tolerance_s is not None:
        usable = (F.abs(dt) < tolerance_s) if strict else (F.abs(dt) <= tolerance_s)
    return {"dt": F.when(usable, dt), **{p: F.when(usable, near[p]) for p in payload}}


def nearest(rows: DataFrame, time: str, nodes: DataFrame, node_time: str, payload: list[str], *,
            tolerance_s: float | None = None, strict: bool = False, keys: list[str] | None = None,
            prefix: str = "near_", limit: int = GROUP_LIMIT) -> DataFrame:
    """Nearest node: its payload, and ``<prefix>dt`` = row time - node time.

    The tolerance is inclusive unless ``strict``; outside it everything is NULL."""
    both = around(rows, time, nodes, node_time, payload, keys, limit)
    got = nearest_values(F.col("prev"), F.col("next"), F.col(time), payload, tolerance_s, strict)
    return both.select(*rows.columns, *[c.alias(f"{prefix}{n}") for n, c in got.items()])


def _lerp(a: Column, b: Column, w: Column) -> Column:
    return (1 - w) * a + w * b


def _lerp_arrays(a: Column, b: Column, w: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (1 - w) * x + w * y)


def bracket_values(prev: Column, next: Column, time: Column, values: list[str], label: str, max_gap_s: float,
                   hold_s: float | None = None, arrays: bool = False) -> dict[str, Column]:
    """The values interpolated between two neighbours, ``width`` of the bracket
    and ``dt`` to the nearest node; see ``bracket``."""
    on_node = F.coalesce(prev["t"] == time, F.lit(False))
    width = next["t"] - prev["t"]
    ok = on_node | F.coalesce((prev[label] == next[label]) & (width <= max_gap_s), F.lit(False))
    w = F.try_divide(time - prev["t"], width)
    near = nearer(prev, next, time)
    dt = F.abs(time - near["t"])
    held = F.lit(False) if hold_s is None else F.coalesce(~ok & (dt <= hold_s), F.lit(False))
    mix = _lerp_arrays if arrays else _lerp
    # on a node: its own value, whatever the other one is
    out = {v: F.when(on_node, prev[v]).when(ok, mix(prev[v], next[v], w)).when(held, near[v]) for v in values}
    return {**out, "width": F.when(on_node, 0.0).when(ok, width), "dt": F.when(ok | held, dt)}


def bracket(rows: DataFrame, time: str, nodes: DataFrame, node_time: str, values: list[str], label: str, *,
            max_gap_s: float, hold_s: float | None = None, keys: list[str] | None = None, prefix: str = "",
            arrays: bool = False, limit: int = GROUP_LIMIT) -> DataFrame:
    """Linear interpolation between the nodes around the row.

    Only between nodes of one label at most ``max_gap_s`` apart; a row on a
    node takes that node (width 0); nothing is extrapolated.  With ``hold_s``
    a row without a bracket takes the nearest node within that time.
    """
    both = around(rows, time, nodes, node_time, [label, *values], keys, limit)
    got = bracket_values(F.col("prev"), F.col("next"), F.col(time), values, label, max_gap_s, hold_s, arrays)
    return both.select(*rows.columns, *[c.alias(f"{prefix}{n}") for n, c in got.items()])


def hold_ends(rows: DataFrame, time: str, nodes: DataFrame, node_time: str, value: str,
              keys: list[str] | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """Linear in time between nodes, held before the first and after the last."""
    both = around(rows, time, nodes, node_time, [value], keys, limit)
    p, n, t = F.col("prev"), F.col("next"), F.col(time)
    w = F.try_divide(t - p["t"], n["t"] - p["t"])
    inside = F.when(p["t"] == n["t"], p[value]).otherwise(_lerp(p[value], n[value], w))
    return both.select(*rows.columns, F.coalesce(inside, p[value], n[value]).alias(value))


def window_mean_or_nearest(rows: DataFrame, ids: list[str], time: str, start: str, stop: str, readings: DataFrame,
                           reading_time: str, value: str, tolerance_s: float, limit: int = GROUP_LIMIT) -> DataFrame:
    """Mean of the finite readings in the closed window; without any, the
    nearest within the tolerance.  Adds value, ``n`` averaged and ``dt``.

    The mean is a difference of running sums at the two window ends."""
    checked = F.when(F.col(stop) < F.col(start), F.raise_error(F.lit("a window ends before it starts")).cast("double"))
    edges = rows.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).select(
        *ids, F.explode(F.array(
            F.struct(F.col(start).alias("_t"), F.lit(-1).alias("_k")),
            F.struct(F.coalesce(checked, F.col(stop)).alias("_t"), F.lit(1).alias("_k")))).alias("_e"),
    ).select(*ids, "_e.*", F.xxhash64(*ids).alias("_h"))
    finite = F.when(~F.isnan(value), F.col(value))
    line = edges.unionByName(readings.select(F.col(reading_time).alias("_t"), F.lit(0).alias("_k"), F.xxhash64(finite).alias("_h"), finite.alias("_v")),
                             allowMissingColumns=True)
    # edges add nothing and readings of one time are all in or all out: their
    # order does not matter, the hash only spreads them over slices
    summed = running(line, [], ["_t", "_k", "_h"], sums={
        "_s": F.coalesce("_v", F.lit(0.0)), "_c": F.col("_v").isNotNull().cast("long")}, limit=limit).where("_k <> 0")
    means = summed.groupBy(*ids).agg(F.sum(F.col("_s") * F.col("_k")).alias("_sum"), F.sum(F.col("_c") * F.col("_k")).alias("_n"))
    near = nearest(rows, time, readings, reading_time, [value], tolerance_s=None, prefix="_near_", limit=limit)
    near_v = F.when(F.abs("_near_dt") <= tolerance_s, F.col(f"_near_{value}"))
    out = attach(near, means, ids)
    n = F.coalesce("_n", F.lit(0))
    return out.select(*rows.columns, F.when(n > 0, F.col("_sum") / n).otherwise(near_v).alias(value),
                      n.alias("n"), F.abs("_near_dt").alias("dt"))


def near_sweep(rows: DataFrame, time: str, sweeps: DataFrame, guard: tuple[float, float], limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``near_sweep``: strictly inside (start - g0, stop + g1) of a sweep.

    Sweeps do not overlap, so only the latest one opened can hold the row."""
    opened = sweeps.select((F.col("start") - guard[0]).alias("_open"), "stop")
    # strictly after the opening: a row at the opening itself looks one sweep back
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "array", "struct"))]
    line = rows.select(F.col(time).alias("_t"), F.lit(0).alias("_k"), F.xxhash64(*plain).alias("_h"), F.struct(*rows.columns).alias("_row")).unionByName(
        opened.select(F.col("_open").alias("_t"), F.lit(1).alias("_k"), F.lit(0).cast("bigint").alias("_h"), F.col("stop").alias("_stop")), allowMissingColumns=True)
    seen = running(line, [], ["_t", "_k", "_h"], last={"_last": F.col("_stop")}, limit=limit).where("_k = 0")
    return seen.select("_row.*", F.coalesce(F.col("_t") < F.col("_last") + guard[1], F.lit(False)).alias("near_sweep"))


def assemble_cycles(dwells: DataFrame, time: str, state: str, order: list[str], payload: list[str],
                    max_span_s: float, limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per cycle: each start dwell with the first dwell of every other
    state strictly after it, before the next start, less than ``max_span_s`` on.
    Cycles lacking a state are dropped."""
    first, rest = order[0], order[1:]
    row = F.struct(F.col(time).alias("t"), *payload)
    # at one time, starts sort last, so that what follows a start is strictly later
    line = dwells.where(F.col(state).isin(order)).select(
        F.col(time).alias("_t"), (F.col(state) == first).cast("int").alias("_k"), state, row.alias("_d"))
    starts = line.where("_k = 1")
    starts = running(starts, [], ["_t"], lead={"_until": F.col("_t")}, limit=limit)
    line = starts.unionByName(line.where("_k = 0"), allowMissingColumns=True)
    seen = running(line, [], ["_t", "_k"], next={f"_n_{s}": F.when(F.col(state) == s, F.col("_d")) for s in rest},
                   limit=limit).where("_k = 1")
    ok = F.lit(True)
    for s in rest:
        t = F.col(f"_n_{s}")["t"]
        ok = ok & t.isNotNull() & (F.col("_until").isNull() | (t < F.col("_until"))) & (t - F.col("_t") < max_span_s)
    return seen.where(ok).select(F.col("_t").alias("t"), F.col("_d").alias(first), *[F.col(f"_n_{s}").alias(s) for s in rest])


def borrow_valid(sweeps: DataFrame, time: str, mode: str, standard: str, valid: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """Own standard if valid, else the nearest valid one of the same mode.

    Adds ``used_t``, ``used`` and ``status``."""
    bank = sweeps.where(F.col(valid)).groupBy(mode, time).agg(F.min(standard).alias(standard))
    out = nearest(sweeps, time, bank, time, [standard], keys=[mode], prefix="_b_", limit=limit)
    own = F.col(valid)
    return out.select(*sweeps.columns, F.when(own, F.col(time)).otherwise(F.col(time) - F.col("_b_dt")).alias("used_t"),
                      F.when(own, F.col(standard)).otherwise(F.col(f"_b_{standard}")).alias("used"),
                      F.when(own, "own").when(F.col("_b_dt").isNotNull(), "borrowed").otherwise("none").alias("status"))


def bracket_errors(nodes: DataFrame, time: str, value: str, spans: list[int], limit: int = GROUP_LIMIT) -> DataFrame:
    """Error of predicting every interior node of every span of m nodes.

    One row per (m, left node, interior node): fractional error of linear
    interpolation.  The outer nodes are fixed row offsets away, so a frame as
    wide as the longest span holds them all and no self-join is needed."""
    reach = max(spans) - 1
    pos = numbered(nodes.select(time, value), [], [time], "_i", limit=limit)
    node = F.struct("_i", F.col(time).alias("t"), F.col(value).alias("v"))
    table = framed(pos, [], [time], reach, reach, lambda frame, _: {"_near": F.collect_list(node).over(frame)}, limit=limit)
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(j).alias("j")) for m in spans for j in range(1, m)])
    got = table.select(F.col("_i").alias("k"), "_near", F.explode(pairs).alias("_p"))

    def at(offset):
        return F.get("_near", (F.col("k") + offset - F.col("_near")[0]["_i"]).cast("int"))

    left, right, own = at(-F.col("_p.j")), at(F.col("_p.m") - F.col("_p.j")), at(F.lit(0))
    w = (own["t"] - left["t"]) / (right["t"] - left["t"])
    error = F.abs(F.try_divide(_lerp(left["v"], right["v"], w) - own["v"], own["v"]))
    return got.select(F.col("_p.m").alias("m"), (F.col("k") - F.col("_p.j")).alias("i"), "k", error.alias("error")).where("error IS NOT NULL")


def across_gap(nodes: DataFrame, time: str, value: str, tolerance_s: float, limit: int = GROUP_LIMIT) -> DataFrame:
    """Change across the longest gap, and over equal spans before it.

    One row: gap edges, change across the gap, count and median of the changes
    between nodes the same span apart (to within the tolerance).  From a node of
    zero the change is infinite (NaN to another zero), and counts."""
    led = running(nodes.select(time, value), [], [time], lead={"_t1": F.col(time), "_v1": F.col(value)}, limit=limit)
    gap = led.where("_t1 IS NOT NULL").agg(F.max_by(
        F.struct(F.col(time).alias("before"), F.col("_t1").alias("after"), (ieee_divide(F.col("_v1"), F.col(value)) - 1).alias("r")),
        F.struct(F.col("_t1") - F.col(time), -F.col(time))).alias("g")).select(
        "g.before", "g.after", F.abs("g.r").alias("change"))
    early = attach(nodes.select(F.col(time).alias("t"), F.col(value).alias("v")), gap, []).where("t <= before")
    early = early.withColumn("_target", F.col("t") + F.col("after") - F.col("before"))
    mate = nearest(early, "_target", nodes.select(F.col(time).alias("nt"), F.col(value).alias("nv")), "nt", ["nv"],
                   tolerance_s=tolerance_s, strict=True, prefix="m_", limit=limit)
    pairs = mate.where("m_nv IS NOT NULL AND _target - m_dt <= before").withColumn("c", F.abs(ieee_divide(F.col("m_nv"), F.col("v")) - 1))
    other = quantiles(pairs, [], F.col("c"), {"median_elsewhere": 0.5}, limit=limit).withColumnRenamed("n", "n_elsewhere")
    return attach(gap, other, [])
