"""Cross products of two interleaved tone classes, from raw channels to both classes on every tone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.operators import fits
from dwellgrid.operators import rolling as ro
from dwellgrid.operators.ordered import GROUP_LIMIT

CLASSES = ("even", "odd")


def _turned(re: Column, im: Column, phase: Column) -> tuple[Column, Column]:
    """(re + i im) * exp(i phase), by parts."""
    return re * F.cos(phase) - im * F.sin(phase), re * F.sin(phase) + im * F.cos(phase)


def reduce_cross(cells: DataFrame, row: str, chan: str, re: str, im: str, tone: Column, flag: Column, gain: Column, phase: Column, bases: dict[str, dict[int, list[float]]], *,
                 trusted: Column | None = None, max_bad: float = 0.35, max_cond: float | None = None, window: int = 31, sigma: float = 7.0, rel_floor: float = 0.3,
                 clip_fills: bool = True, bracketed: bool = True, limit: int = GROUP_LIMIT) -> DataFrame:
    """row, tone, class, re, im, measured, bad: both classes' value on every tone.

    In order: each tone less the mean of the channels beside it; times ``gain``
    (the square root of the weak class's power scale; 1 elsewhere); flagged
    tones out; turned by -``phase``, the delay in radians by tone, so that what
    is left is smooth; both parts filled class by class on ``bases``
    (``fits.interleaved_fill``); fills that stand out along time out, and those
    without a trusted measured tone of their class on both sides; turned back.

    ``tone`` is the tone's number or NULL where a channel has none or it is
    dropped; ``flag``, ``gain``, ``phase`` and ``trusted`` are in terms of the
    channel columns and ``_tone``. Classes are the even and the odd numbers.
    ``row`` is an integer. NULL parts are gaps; a row with more than
    ``max_bad`` flagged tones has neither class."""
    both = F.struct(F.col(re).alias("re"), F.col(im).alias("im"))
    work = ro.beside(cells, [row], chan, {"_l": (both, -1), "_r": (both, 1)}, limit).withColumn("_tone", tone.cast("int")).where("_tone IS NOT NULL")
    less = {p: (F.col(c) - (F.col(f"_l.{p}") + F.col(f"_r.{p}")) / 2) * gain for p, c in (("re", re), ("im", im))}
    sure = F.lit(True) if trusted is None else trusted
    work = work.select(F.col(row).alias("row"), F.col("_tone").alias("tone"), less["re"].alias("_x"), less["im"].alias("_y"), F.coalesce(flag, F.lit(False)).alias("_f"), phase.alias("_phase"), sure.alias("_sure"))
    work = work.withColumn("_gap", F.col("_f") | F.col("_x").isNull() | F.col("_y").isNull())
    out = _turned(F.when(~F.col("_gap"), F.col("_x")), F.when(~F.col("_gap"), F.col("_y")), -F.col("_phase"))
    work = work.withColumns({"_re": out[0], "_im": out[1]}).drop("_x", "_y")
    classes = {name: (F.col("tone") % 2 == parity, bases[name], F.col("_sure")) for parity, name in enumerate(CLASSES)}
    for part in ("_re", "_im"):
        work = fits.interleaved_fill(work, ["row"], "tone", part, "_f", classes, max_bad=max_bad, max_cond=max_cond)
        work = work.withColumnsRenamed({name: f"{part}_{name}" for name in CLASSES}).drop(*(["bad"] if part == "_re" else []), *[f"{name}_cond" for name in CLASSES])
    each = F.explode(F.array(*[F.struct(F.lit(parity).alias("class"), F.col(f"_re_{name}").alias("re"), F.col(f"_im_{name}").alias("im")) for parity, name in enumerate(CLASSES)]))
    long = work.select("row", "tone", "bad", "_phase", "_sure", (~F.col("_gap") & ~F.col("bad")).alias("_there"), each.alias("c"))
    long = long.select("row", "tone", "bad", "_phase", "_sure", "c.*", (F.col("_there") & (F.col("tone") % 2 == F.col("c.class"))).alias("measured"))
    long = long.withColumns({"_amp": F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), "_line": F.col("row") * 2 + F.col("class")})
    gone = F.lit(False)
    if clip_fills:
        long = ro.iterative_clip(long, ["class", "tone"], ["row"], "_amp", "measured", window, sigma, rel_floor, limit=limit)
        gone = gone | F.col("outlier")
    if bracketed:
        long = ro.unbracketed(long, "_line", "tone", "measured", F.col("_sure"), limit)
        gone = gone | F.col("unbracketed")
    back = _turned(F.when(~gone, F.col("re")), F.when(~gone, F.col("im")), F.col("_phase"))
    return long.select(F.col("row").alias(row), "tone", "class", back[0].alias("re"), back[1].alias("im"), "measured", "bad")
