"""Row, file and channel filters, and the audit of what each removed."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.operators.ordered import attach, numbered
from dwellgrid.operators.quantiles import SCALE, with_median


def match_one(column: str, want) -> Column:
    """Scalar -> equality; list, tuple or set -> membership."""
    c = F.col(column)
    return c.isin(*want) if isinstance(want, (list, tuple, set, frozenset)) else c == want


def in_time(t: Column, start: float | None, stop: float | None) -> Column:
    """Half-open window; NULL times are never inside."""
    out = t.isNotNull()
    if start is not None:
        out = out & (t >= start)
    return out & (t < stop) if stop is not None else out


def glob_regex(glob: str) -> str:
    """Whole-string regular expression of a file glob."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1:close].replace("\\", "\\\\")
            out.append(f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return f"(?s)^{''.join(out)}$"


def is_range(files) -> bool:
    return isinstance(files, tuple) and len(files) == 2 and not any(set("*?[") & set(f) for f in files)


def files_match(name: Column, files) -> Column:
    """A string is a glob, a list several, a pair without wildcards an
    inclusive range of names."""
    if is_range(files):
        return (name >= files[0]) & (name <= files[1])
    globs = [files] if isinstance(files, str) else list(files)
    out = F.lit(False)
    for g in globs:
        out = out | name.rlike(glob_regex(g))
    return out


def select_rows(df: DataFrame, *, files=None, time: tuple | None = None, file_column: str = "file",
                time_column: str = "time_best", where: Column | Callable[[DataFrame], DataFrame] | None = None,
                **columns) -> DataFrame:
    """Filter an index by file names, half-open time, column values, then ``where``."""
    out = df
    for _, cond in conditions(df, files=files, time=time, file_column=file_column, time_column=time_column, **columns):
        out = out.where(cond)
    if where is not None:
        out = where(out) if callable(where) and not isinstance(where, Column) else out.where(where)
    return out


def conditions(df: DataFrame, *, files=None, time=None, file_column="file", time_column="time_best", **columns):
    """The named conditions of ``select_rows`` in the order they apply."""
    steps = []
    if files is not None:
        steps.append(("files", files_match(F.col(file_column), files)))
    if time is not None:
        steps.append(("time", in_time(F.col(time_column), *time)))
    for name, want in columns.items():
        if name not in df.columns:
            raise KeyError(f"no column {name!r}; columns: {df.columns}")
        steps.append((name, match_one(name, want)))
    return steps


def filter_funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(position, step, before, after) of filters applied in order, in one pass."""
    kept, passed = F.lit(True), []
    for _, cond in steps:
        kept = kept & F.coalesce(cond, F.lit(False))
        passed.append(kept)
    n = F.count(F.lit(1)).alias("_c0")
    counts = df.agg(n, *[F.count_if(c).alias(f"_c{i + 1}") for i, c in enumerate(passed)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name).alias("step"),
                              F.col(f"_c{i}").alias("before"), F.col(f"_c{i + 1}").alias("after"))
                     for i, (name, _) in enumerate(steps)])
    return counts.select(F.inline(rows))


def in_band(f: Column, lo: float, hi: float, closed: bool = True) -> Column:
    """Closed [lo, hi] or half-open [lo, hi)."""
    return (f >= lo) & ((f <= hi) if closed else (f < hi))


def band_slice(freqs: list[float], lo: float, hi: float, closed: bool = True) -> tuple[int, int]:
    """(first channel, count) of a band on an axis; an empty band raises."""
    inside = [i for i, f in enumerate(freqs) if lo <= f and (f <= hi if closed else f < hi)]
    if not inside:
        raise ValueError(f"no channel in [{lo}, {hi}{']' if closed else ')'}")
    return inside[0], inside[-1] - inside[0] + 1


def band_of(array: Column, freqs: list[float], lo: float, hi: float, closed: bool = True) -> Column:
    first, n = band_slice(freqs, lo, hi, closed)
    return F.slice(array, first + 1, n)


def frequency_trust(f: Column, lo: float, hi: float, excluded: list[tuple[float, float]]) -> Column:
    """Finite, within [lo, hi] and outside every closed excluded band."""
    ok = f.isNotNull() & ~F.isnan(f) & (f >= lo) & (f <= hi)
    for a, b in excluded:
        ok = ok & ~f.between(a, b)
    return F.coalesce(ok, F.lit(False))


def fit_channels(chan: Column, trusted: Column, lo: int | None, hi: int | None, comb: list[int], guard: int) -> Column:
    """Channel range and trust, away from every comb channel; a bound of 0 counts."""
    ok = trusted
    if lo is not None:
        ok = ok & (chan >= lo)
    if hi is not None:
        ok = ok & (chan <= hi)
    if comb:
        ok = ok & ~F.exists(F.array(*[F.lit(c) for c in comb]), lambda c: F.abs(chan - c) <= guard)
    return ok


def state_gate(df: DataFrame, file: str, state: str, want: str, assumed: str) -> DataFrame:
    """Add ``in_state``: a file with nothing but MISSING has the assumed state;
    single gaps are never reassigned."""
    blank = df.groupBy(file).agg(F.bool_and(F.coalesce(F.col(state), F.lit("MISSING")) == "MISSING").alias("_blank"))
    seen = F.when(F.col("_blank"), assumed).otherwise(F.col(state))
    return attach(df, blank, [file]).withColumn("in_state", F.coalesce(seen == want, F.lit(False))).drop("_blank")


def resampled(values: Column, row: Column, rows: Column) -> Column:
    """Entry of a stream of another cadence that belongs to ``row`` of ``rows``."""
    return F.get(values, F.floor(row * F.size(values) / rows).cast("int"))


def mode_filter(modes: dict[str, list]) -> Column:
    """Values OR within a mode, AND across modes, compared as text."""
    ok = F.lit(True)
    for column, wanted in modes.items():
        ok = ok & F.col(column).cast("string").isin(*[str(w) for w in wanted])
    return F.coalesce(ok, F.lit(False))


def channel_validity(x: Column, time: Column, sigma: Column, threshold: float, bad_row: Column) -> Column:
    finite = x.isNotNull() & ~F.isnan(x)
    return F.coalesce(finite & (time > 0) & (sigma > 0) & (x > threshold) & ~bad_row, F.lit(False))


def on_stride(chan: Column, spacing: int, phase: int = 0) -> Column:
    return F.pmod(chan, F.lit(spacing)) == phase


def near_tone(chan: Column, tones: list[int], pad: int) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in tones]), lambda t: F.abs(chan - t) <= pad)


def near_integer(f: Column, within: float) -> Column:
    """Strictly within ``within`` of an integer (half to even, as rint)."""
    return F.abs(f - F.rint(f)) < within


def near_comb(f: Column, spacing: float, phase: float, tol: float) -> Column:
    """Within ``tol`` (inclusive) of phase + n x spacing."""
    n = F.rint((f - phase) / spacing)
    return F.abs(f - phase - n * spacing) <= tol


def comb_arm(chan: Column, spacing: int) -> Column:
    return F.pmod(F.floor(chan / spacing), F.lit(2)).cast("int")


def row_slice(df: DataFrame, order: list[str], lo: int, hi: int, keys: list[str] | None = None) -> DataFrame:
    """Positions lo (inclusive) to hi (exclusive)."""
    return numbered(df, keys or [], order, "_p").where((F.col("_p") >= lo) & (F.col("_p") < hi)).drop("_p")


def absurd_cells(df: DataFrame, keys: list[str], value: str, n_mad: float) -> DataFrame:
    """Add ``absurd``: below zero, or above median + n MADs of the positive values."""
    positive = F.when(F.col(value) > 0, F.col(value))
    out = with_median(df, keys, positive, "_m")
    out = with_median(out, keys, F.abs(positive - F.col("_m")), "_s")
    flag = (F.col(value) < 0) | (F.col(value) > F.col("_m") + n_mad * SCALE * F.col("_s"))
    return out.withColumn("absurd", F.coalesce(flag, F.lit(False))).drop("_m", "_s")


def steady_rows(df: DataFrame, kind: str, column: str | None = None, below: float | None = None) -> DataFrame:
    out = df.where(F.col(kind) == "steady")
    return out.where(F.col(column) < below) if column else out


def every_nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Stride sample of an ordered table: positions 0, n, 2n, ..."""
    return numbered(df, [], order, "_p").where(F.col("_p") % n == 0).drop("_p")


def keys_in_all(df: DataFrame, file: str, key: str) -> DataFrame:
    """Keys every file has."""
    files = df.select(file).distinct().agg(F.count(F.lit(1)).alias("_files"))
    per_key = df.select(file, key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return attach(per_key, files, []).where("_n = _files").select(key)


def coverage_gaps(labelled: DataFrame, usable: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Keys on one side only of: labelled = usable + excluded."""
    a = labelled.select(key).distinct()
    b = usable.select(key).union(excluded.select(key)).distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full_outer")
    return both.where("_a IS NULL OR _b IS NULL").select(
        key, F.when(F.col("_a").isNull(), "not labelled").otherwise("not covered").alias("problem"))


def first_seen(df: DataFrame, column: str, position: list[str]) -> DataFrame:
    """Distinct values in order of first appearance."""
    return (df.groupBy(column).agg(F.min(F.struct(*position)).alias("_first")).orderBy("_first")
            .select(column, "_first.*"))
