"""How well a detector works: labelled windows and injected signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions import arrays as A
from dwellgrid.operators.ordered import GROUP_LIMIT, framed, measure
from dwellgrid.operators.quantiles import quantiles, with_mad
from dwellgrid.operators.rangejoins import in_intervals
from dwellgrid.operators.rolling import rolling_median


def labelled_recall(cells: DataFrame, row: str, time: str, flag: Column, windows: DataFrame, start: str, stop: str, label: str,
                    limit: int = GROUP_LIMIT) -> DataFrame:
    """label -> rows and median flagged fraction of the rows in its windows."""
    rows = cells.groupBy(row, time).agg(F.avg(flag.cast("double")).alias("_f"))
    inside = in_intervals(rows, time, windows.select(start, stop, label), start, stop).select(row, label, "_f").distinct()
    return quantiles(inside, [label], F.col("_f"), {"median_flagged": 0.5}, limit=limit)


def injection_curve(df: DataFrame, keys: list[str], order: list[str], value: str, chosen: Column, amplitudes: list[float],
                    half: int = 4, clip: float = 5.0, limit: int = GROUP_LIMIT) -> DataFrame:
    """amplitude -> injected cells and the share the transient track finds.

    A spike of amplitude x the group's scatter goes on each chosen cell.  Only
    its own window changes, so each amplitude costs one small median per chosen
    cell, not another run over the table."""
    size = measure(df, keys)
    base = rolling_median(df, keys, order, F.col(value), half, "_m", size, limit).withColumn("_r", F.col(value) - F.col("_m"))
    base = with_mad(base, keys, F.col("_r"), "_c", "_s", size, limit).withColumn("_chosen", chosen)
    window = framed(base, keys, order, half, half, lambda f, _: {"_w": F.collect_list(F.col(value)).over(f)}, edge="nearest", size=size, limit=limit)
    spikes = window.where("_chosen").select("_s", "_w", F.explode(F.array(*[F.lit(float(a)) for a in amplitudes])).alias("amplitude"))
    at = F.get("_w", F.lit(half)) + F.col("amplitude") * F.col("_s")
    spikes = spikes.withColumn("_x", at).withColumn(
        "_w", F.transform("_w", lambda v, i: F.when(i == half, F.col("_x")).otherwise(v)))
    hit = (F.col("_s") >= 1e-9) & (F.abs(F.col("_x") - A.median(F.col("_w"))) > clip * F.col("_s"))
    return spikes.groupBy("amplitude").agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("detected"))


def smooth_dip(chan: Column, center: float, width: float) -> Column:
    """Shape of a smooth dip along channel, 1 at its centre and nothing beyond four widths."""
    u = (chan - center) / width
    return F.when(F.abs(u) <= 4, F.exp(-u * u / 2)).otherwise(0.0)


def smooth_injection(df: DataFrame, keys: list[str], order: list[str], value: str, shape: Column, depths: list[float], half: int = 4,
                     clip: float = 5.0, limit: int = GROUP_LIMIT) -> DataFrame:
    """depth -> cells looked at anew, flagged before and after, and the share newly flagged, where value * (1 - depth * shape) takes the place of the value.

    A smooth signal is what the transient track must not flag. Cells are
    compared with the median of the rows around them (``half`` on each side,
    ends repeated) in units of their group's scatter, which is that of the
    table as it is. Only frames that hold a cell with a shape can change, so
    only these are judged again, the frame as it was and as it would be side by
    side; no altered table is made."""
    size = measure(df, keys)
    base = rolling_median(df, keys, order, F.col(value), half, "_m", size, limit).withColumn("_r", F.col(value) - F.col("_m"))
    base = with_mad(base, keys, F.col("_r"), "_c", "_s", size, limit)
    cell = F.struct(F.col(value).cast("double").alias("v"), F.coalesce(shape.cast("double"), F.lit(0.0)).alias("k"))
    frames = framed(base, keys, order, half, half, lambda f, _: {"_w": F.collect_list(cell).over(f)}, edge="nearest", size=size, limit=limit)
    frames = frames.where(F.exists("_w", lambda x: x["k"] != 0)).select("_s", "_w", F.explode(F.array(*[F.lit(float(d)) for d in depths])).alias("depth"))
    frames = frames.select("depth", "_s", F.transform("_w", lambda x: x["v"]).alias("_before"), F.transform("_w", lambda x: x["v"] * (1 - F.col("depth") * x["k"])).alias("_after"))
    off = lambda w: F.coalesce((F.col("_s") >= 1e-9) & (F.abs(F.get(w, F.lit(half)) - A.median(F.col(w))) > clip * F.col("_s")), F.lit(False))
    judged = frames.select("depth", off("_before").alias("b"), off("_after").alias("a"))
    return judged.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.count_if("b").alias("before"), F.count_if("a").alias("after"),
                                       F.avg((F.col("a") & ~F.col("b")).cast("double")).alias("newly_flagged"))
