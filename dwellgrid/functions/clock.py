"""Time expressions: Unix seconds, names that carry a time stamp, local windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unix_seconds(ts: Column) -> Column:
    """Unix seconds as a double; a naive time is taken as UTC (the session zone)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def utc_text(t: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Unix seconds as text in the session zone (UTC)."""
    return F.date_format(F.timestamp_micros(F.round(t * 1e6).cast("bigint")), fmt)


# fixed value: the stamp in a file name, with an optional "-1" suffix
STAMP = r"_(\d{8})_(\d{6})Z?(?:-\d+)?\."


def file_time(name: Column) -> Column:
    """Unix seconds of the stamp in a file name, NULL where there is none."""
    text = F.concat(F.regexp_extract(name, STAMP, 1), F.regexp_extract(name, STAMP, 2))
    return unix_seconds(F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyyMMddHHmmss")))


def file_day(name: Column) -> Column:
    """Characters 5 to 13 of a file name (0-based): its day."""
    return F.substring(name, 6, 8)


def phase_of(t: Column, pivots: list[tuple[float, str]], first: str) -> Column:
    """Label of the last pivot at or before ``t``."""
    out = F.lit(first)
    for at, label in sorted(pivots):
        out = F.when(t >= at, label).otherwise(out)
    return F.when(t.isNotNull(), out)


def local_window(start: str, stop: str, zone: str) -> tuple[Column, Column]:
    """Wall-clock pair in ``zone`` as Unix seconds."""
    return tuple(unix_seconds(F.to_utc_timestamp(F.lit(s).cast("timestamp"), zone)) for s in (start, stop))


def best_time(time: Column, stamp: Column, last_time: Column, rows: Column, row: Column,
              dt: Column, tolerance_s: float = 3600.0) -> dict[str, Column]:
    """Clock repair of a scanned row: header time where the header agrees with
    the file name to within the tolerance (inclusive), else counted back from
    the file name."""
    consistent = F.coalesce(F.abs(stamp - last_time) <= tolerance_s, F.lit(False))
    from_name = stamp - (rows - 1 - row) * dt
    return {
        "sync_consistent": consistent,
        "time_fname": from_name,
        "time_best": F.when(consistent, time).otherwise(from_name),
    }
