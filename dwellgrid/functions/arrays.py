"""Expressions on one spectrum held as an array column (no shuffle).

Lambda bodies name the array many times, so the array passed in should be a
plain column, not a long expression.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def median(values: Column) -> Column:
    """Median of the non-NULL entries; NULL for none."""
    ordered = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    # one evaluation of the sort, then the middle entries
    return F.aggregate(
        F.array(ordered), F.lit(None).cast("double"),
        lambda _, s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                       lambda a, x: F.struct((a["s"] + F.coalesce(x, F.lit(0.0))).alias("s"),
                                             (a["n"] + x.isNotNull().cast("int")).alias("n")),
                       lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


# numpy names of the edge rules: nearest (aaa|abc), mirror (cb|abc), reflect (ba|abc)
_EDGES = {"nearest": "edge", "mirror": "reflect", "reflect": "symmetric"}


def windows(x: np.ndarray, half: int, edge: str) -> np.ndarray:
    """(rows, channels, 2 half + 1) view of the padded rows."""
    padded = np.pad(x, ((0, 0), (half, half)), mode=_EDGES[edge])
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1, axis=1)


def by_length(fn: Callable[..., np.ndarray], *columns: pd.Series) -> pd.Series:
    """Apply ``fn`` to dense (rows, channels) blocks of equally long arrays."""
    out = pd.Series([None] * len(columns[0]), index=columns[0].index, dtype=object)
    lengths = columns[0].map(lambda a: -1 if a is None else len(a))
    for n, rows in lengths.groupby(lengths).groups.items():
        if n > 0:
            block = fn(*[np.stack(c.loc[rows].to_list()).astype(float) for c in columns])
            out.loc[rows] = pd.Series(list(block), index=rows)
        elif n == 0:
            out.loc[rows] = pd.Series([[]] * len(rows), index=rows)
    return out


def rolling_median(values: Column, half: int, edge: str) -> Column:
    """Moving median along the array, missing entries ignored.

    A batch of spectra is one numpy call: sorting small windows entry by entry
    in array lambdas costs far more, and Catalyst may inline them repeatedly."""

    @F.pandas_udf("array<double>")
    def medians(x: pd.Series) -> pd.Series:
        return by_length(lambda a: np.nanmedian(windows(a, half, edge), axis=2), x)

    return medians(values)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def second_difference(values: Column) -> Column:
    """x - (left + right)/2; NULL at both ends."""
    n = F.size(values)
    return F.transform(values, lambda x, i: F.when(
        (i > 0) & (i < n - 1), x - (F.get(values, i - 1) + F.get(values, i + 1)) / 2))


def clipped(values: Column, lo: float, hi: float) -> Column:
    return F.transform(values, lambda x: F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def rolled(values: Column, by: int) -> Column:
    """Circular shift towards higher indices."""
    n = F.size(values)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, F.pmod(i - by, n)))


def residue(values: Column, spacing: int, phase: Column | int) -> Column:
    """Every ``spacing``-th entry starting at ``phase``."""
    return F.filter(values, lambda x, i: F.pmod(i, F.lit(spacing)) == phase)
