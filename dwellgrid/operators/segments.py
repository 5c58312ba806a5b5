"""Runs of rows: visits, dwells, blocks, segments, batches, plateaus.

All are islands: a row that breaks from the one before starts the next number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.operators.ordered import GROUP_LIMIT, attach, measure, numbered, running
from dwellgrid.operators.quantiles import quantiles
from dwellgrid.session import cut


def islands(df: DataFrame, keys: list[str], order: list[str], before: list[str],
            breaks: Callable[[dict[str, Column]], Column], name: str, limit: int = GROUP_LIMIT,
            outside: Column | None = None) -> DataFrame:
    """Number the runs 0, 1, 2... in order.  ``breaks`` gets the columns of the
    row before and says whether this row starts a run; the first row always does.
    Rows ``outside`` (sorting first) are in no run: -1."""
    size = measure(df, keys)
    lagged = running(df, keys, order, lag={f"_b_{c}": F.col(c) for c in before} | {"_b": F.lit(True)},
                     size=size, limit=limit)
    starts = F.col("_b").isNull() | breaks({c: F.col(f"_b_{c}") for c in before})
    starts = F.coalesce(starts, F.lit(True))
    number = F.col(name) - 1
    if outside is not None:
        starts, number = starts & ~outside, F.when(outside, -1).otherwise(number)
    out = running(lagged, keys, order, sums={name: starts.cast("long")}, size=size, limit=limit)
    return out.select(*df.columns, number.cast("long").alias(name))


def visits(df: DataFrame, time: str, ties: list[str], gap_s: float, keys: list[str] | None = None,
           name: str = "visit", limit: int = GROUP_LIMIT) -> DataFrame:
    """A gap strictly above ``gap_s`` starts a visit; a NULL time gets -1 and
    neither starts nor bridges one."""
    # NULL sorts first; the first row with a time follows a NULL and so starts a visit
    return islands(df, keys or [], [time, *ties], [time], lambda b: F.col(time) - b[time] > gap_s, name, limit,
                   outside=F.col(time).isNull())


def dwells(df: DataFrame, state: str, time: str, ties: list[str], gap_s: float = 5.0,
           limit: int = GROUP_LIMIT) -> DataFrame:
    """Visits within each state, with the position of each row in its dwell."""
    out = visits(df, time, ties, gap_s, [state], "dwell", limit)
    return numbered(out, [state, "dwell"], [time, *ties], "pos_in_dwell", limit=limit)


def switch_blocks(df: DataFrame, state: str, time: str, ties: list[str], gap_s: float = 5.0,
                  limit: int = GROUP_LIMIT) -> DataFrame:
    """A change of state or a gap above ``gap_s`` starts a block."""
    return islands(df, [], [time, *ties], [state, time],
                   lambda b: (F.col(state) != b[state]) | (F.col(time) - b[time] > gap_s), "block", limit)


def sweep_spans(df: DataFrame, state: str, time: str, ties: list[str], prefix: str, gap_s: float = 60.0,
                limit: int = GROUP_LIMIT) -> DataFrame:
    """Start and stop of each run of rows whose state starts with ``prefix``."""
    rows = df.where(F.col(state).startswith(prefix) & F.col(time).isNotNull())
    return visits(rows, time, ties, gap_s, name="sweep", limit=limit).groupBy("sweep").agg(
        F.min(time).alias("start"), F.max(time).alias("stop"))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def segments(df: DataFrame, time: str, dt: str, ties: list[str], factor: float, limit: int = GROUP_LIMIT) -> DataFrame:
    """A missing time, a gap above factor x the previous dt, or a change of dt breaks."""
    def broken(b):
        gap = F.col(time) - b[time]
        return gap.isNull() | (gap > factor * b[dt]) | ~is_close(F.col(dt), b[dt])

    return islands(df, [], [time, *ties], [time, dt], broken, "segment", limit)


def batches(rows: DataFrame, *, file: str, time: str, dt: str, same: list[str], per_batch: int,
            gap_s: float = 600.0, limit: int = GROUP_LIMIT) -> DataFrame:
    """Islands of consecutive files of equal setup, chunked into batches.

    ``same`` are per-file columns (day, phase, key set) that must not change.
    One row per batch: id, block, file count, rows, first and last time.
    """
    files = (rows.groupBy(file).agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"),
                                    F.max(time).alias("last_time"), *[F.min(c).alias(c) for c in same])
             .withColumn("_bad", F.when(F.col("first_time").isNull(),
                                        F.raise_error(F.concat(F.col(file), F.lit(": no finite time"))).cast("int"))))
    step = quantiles(rows.select(file, dt), [file], F.col(dt), {"dt": 0.5}, limit=limit).drop("n")
    files = cut(attach(files.where("_bad IS NULL"), step, [file]))  # one row per file; all below reads it alone

    def changed(b):
        out = (F.col("first_time") - b["last_time"] > gap_s) | ~is_close(F.col("dt"), b["dt"], atol=0.0)
        for c in same:
            out = out | (F.col(c) != b[c])
        return out

    order = ["first_time", file]
    blocks = islands(files, [], order, ["last_time", "dt", *same], changed, "block", limit)
    placed = numbered(blocks, ["block"], order, "_p", limit=limit)
    chunks = placed.groupBy("block", F.floor(F.col("_p") / per_batch).alias("_chunk")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.min("first_time").alias("start"),
        F.max_by("last_time", F.struct(*order)).alias("stop"), *[F.min(c).alias(c) for c in same])
    return numbered(chunks, [], ["block", "_chunk"], "batch", limit=limit).drop("_chunk")


def dwell_clusters(df: DataFrame, keys: list[str], index: str, gap: int = 20, limit: int = GROUP_LIMIT) -> DataFrame:
    """Within a group, an index jump above ``gap`` starts a cluster."""
    return islands(df, keys, [index], [index], lambda b: F.col(index) - b[index] > gap, "cluster", limit)


def dedup_first(df: DataFrame, time: str, value: str, ties: list[str]) -> DataFrame:
    """Finite readings, the first of each time by ``ties``; an aggregate, not a
    window, so a time shared by many rows combines before the shuffle."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & F.col(time).isNotNull()
    return df.where(ok).groupBy(time).agg(F.min_by(value, F.struct(*ties)).alias(value))


def unwrapped(df: DataFrame, keys: list[str], order: list[str], angle: str, period: float, name: str,
              limit: int = GROUP_LIMIT) -> DataFrame:
    """Add multiples of the period so that no step exceeds half of it.

    A step of exactly half a period keeps its sign."""
    size = measure(df, keys)
    step = F.col(angle) - F.col("_a")
    wrapped = F.pmod(step + period / 2, F.lit(period)) - period / 2
    wrapped = F.when((wrapped == -period / 2) & (step > 0), period / 2).otherwise(wrapped)
    turn = F.when(F.abs(step) < period / 2, 0.0).otherwise(F.coalesce(wrapped - step, F.lit(0.0)))
    lagged = running(df, keys, order, lag={"_a": F.col(angle)}, size=size, limit=limit)
    out = running(lagged.withColumn("_turn", turn), keys, order, sums={"_turns": F.col("_turn")}, size=size, limit=limit)
    return out.select(*df.columns, (F.col(angle) + F.col("_turns")).alias(name))


def plateau_clean(df: DataFrame, order: list[str], value: str, step: str, *, min_rows: int = 10, settle: int = 3,
                  keys: list[str] | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """Median of every long run of constant step, straight ramps between them.

    Runs of ``min_rows`` or more are plateaus: their median skips ``settle``
    rows.  Before the first and after the last plateau its value is held; a
    plateau without a reading stays NULL; without any plateau nothing changes.
    """
    keys = keys or []
    rows = numbered(df, keys, order, "_pos", limit=limit)
    rows = islands(rows, keys, ["_pos"], [step], lambda b: ~F.col(step).eqNullSafe(b[step]), "_run", limit)
    rkeys = [*keys, "_run"]
    runs = rows.groupBy(*rkeys).agg(F.min("_pos").alias("_start"), (F.max("_pos") + 1).alias("_end"))
    long_run = F.col("_end") - F.col("_start") >= min_rows
    settled = attach(rows.select(*rkeys, "_pos", value), runs, rkeys).where(
        long_run & (F.col("_pos") >= F.least(F.col("_start") + settle, F.col("_end") - 1)))
    medians = quantiles(settled, rkeys, F.col(value), {"_med": 0.5}, limit=limit).drop("n")
    runs = attach(runs, medians, rkeys)
    plateau = F.when(F.col("_med").isNotNull(), F.struct("_start", "_end", "_med"))
    runs = running(runs, keys, ["_run"], last={"_prev": plateau}, next={"_next": plateau}, limit=limit)
    runs = runs.select(*rkeys, F.col("_med"), "_prev", "_next",
                       (long_run & F.col("_med").isNull()).alias("_dropped"))
    out = attach(rows, runs, rkeys)
    p, n = F.col("_prev"), F.col("_next")
    ramp = p["_med"] + (n["_med"] - p["_med"]) * (F.col("_pos") - p["_end"] + 1) / (n["_start"] - p["_end"] + 1)
    clean = (F.when(F.col("_dropped"), F.lit(None))
             .when(F.col("_med").isNotNull(), F.col("_med"))
             .otherwise(F.coalesce(ramp, n["_med"], p["_med"], F.col(value))))
    return out.select(*df.columns, clean.cast("double").alias("clean"))
