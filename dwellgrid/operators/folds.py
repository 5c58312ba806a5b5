"""Aggregates of a user's own, as expressions on a state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.session import cut

#: Values, or states, that one array holds.
FAN = 4096


@dataclass(frozen=True)
class Fold:
    """A reduction: the state of no values, a state and one value more, two states as one, and the result.

    ``merge`` must not mind the order; all states have one type."""

    init: Callable[[], Column]
    update: Callable[[Column, Column], Column]
    merge: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column]


def trimmed_mean() -> Fold:
    """The mean without the lowest and the highest value; NULL for fewer than three."""

    def state(total, n, low, high):
        return F.struct(total.alias("total"), n.alias("n"), low.alias("low"), high.alias("high"))

    none = F.lit(None).cast("double")
    return Fold(
        lambda: state(F.lit(0.0), F.lit(0).cast("long"), none, none),
        lambda s, x: state(s["total"] + x, s["n"] + 1, F.least(s["low"], x), F.greatest(s["high"], x)),
        lambda a, b: state(a["total"] + b["total"], a["n"] + b["n"], F.least(a["low"], b["low"]), F.greatest(a["high"], b["high"])),
        lambda s: F.when(s["n"] > 2, F.try_divide(s["total"] - s["low"] - s["high"], s["n"] - 2)))


def folded(df: DataFrame, keys: list[str], value: Column, fold: Fold, name: str = "value", fan: int = FAN) -> DataFrame:
    """keys -> ``name``: the fold of a group's values; NULLs are left out, a group of none folds its ``init``.

    Values are folded into states ``fan`` at a time, then states into states in
    as many rounds as the largest group needs, so no array grows with a group."""
    rows = df.select(*keys, value.alias("_v"), F.floor(F.monotonically_increasing_id() / fan).alias("_part"))
    # rows of one part are neighbours in one partition: at most ``fan``
    states = rows.groupBy(*keys, "_part").agg(F.collect_list("_v").alias("_l"))
    states = cut(states.select(*keys, "_part", F.aggregate("_l", fold.init(), fold.update).alias("_s")))
    while True:
        most = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= fan:
            break
        # half full on average, so that an uneven hash still fits
        states = states.withColumn("_part", F.pmod(F.xxhash64("_part"), F.lit(-(-2 * most // fan))))
        states = states.groupBy(*keys, "_part").agg(F.collect_list("_s").alias("_l"))
        states = cut(states.select(*keys, "_part", F.aggregate("_l", fold.init(), fold.merge).alias("_s")))
    out = states.groupBy(*keys).agg(F.collect_list("_s").alias("_l"))
    return out.select(*keys, F.aggregate("_l", fold.init(), fold.merge, fold.finish).alias(name))
