"""Selecting, bundling and planning over a campaign of files."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.operators import rangejoins as rj
from dwellgrid.operators import segments as sg
from dwellgrid.operators.filters import mode_filter
from dwellgrid.operators.ordered import GROUP_LIMIT, attach
from dwellgrid.session import cut
from dwellgrid.sources.checked import require_version

# name -> fn(base, version, source) -> base with the product's columns joined
PRODUCTS: dict[str, Callable[[DataFrame, str, DataFrame], DataFrame]] = {}


def register(name: str):
    def wrap(fn):
        PRODUCTS[name] = fn
        return fn
    return wrap


def parse_spec(spec: str) -> tuple[str, str]:
    """``kind@version``; a version is always named."""
    kind, at, version = spec.partition("@")
    if not at or not version:
        raise ValueError(f"{spec!r}: name a version, as kind@version")
    if kind not in PRODUCTS:
        raise KeyError(f"no product {kind!r}; registered: {sorted(PRODUCTS)}")
    return kind, version


def bundle(base: DataFrame, products: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """Every product (``kind@version`` -> its table of all versions) joined to
    the base rows, none dropped, in time order.  A table without the version is refused."""
    out = base
    for spec, source in products.items():
        kind, version = parse_spec(spec)
        out = PRODUCTS[kind](out, version, require_version(source, "version", version))
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in order])


def skipped_files(base: DataFrame, products: dict[str, DataFrame], file: str, ids: list[str]) -> DataFrame:
    """(file, product, reason, rows): files that a product lacks ``rows`` rows of:
    all (absent) or some (partial)."""
    out = None
    for spec, source in products.items():
        _, version = parse_spec(spec)
        have = source.where(F.col("version") == version).select(*ids).distinct().withColumn("_have", F.lit(1))
        per = base.select(*ids).join(have, ids, "left").groupBy(file).agg(F.count(F.lit(1)).alias("_n"), F.count("_have").alias("_k"))
        reason = F.when(F.col("_k") == 0, "absent").otherwise("partial")
        gaps = per.where("_k < _n").select(file, F.lit(spec).alias("product"), reason.alias("reason"), (F.col("_n") - F.col("_k")).alias("rows"))
        out = gaps if out is None else out.unionByName(gaps)
    return out


def campaign_select(files: DataFrame, file: str, closed: str, start: float, stop: float, phase: str, phases: list[str],
                    modes: DataFrame, masks: DataFrame, wanted: dict[str, list], limit: int = GROUP_LIMIT, *,
                    mask_names: list[str] | None = None, inputs: list[int] | None = None, overflow: DataFrame | None = None,
                    overflow_mask: tuple[str, float] = ("overflow", 0.0), aliases: dict[str, str] | None = None) -> DataFrame:
    """file -> reason it is dropped for, NULL if kept.

    Closed time window on the file's close time, phases, modes by name range
    (a file in no range is excluded), masks: the lowest rank that holds it.
    With ``mask_names`` the mandatory masks and the named ones hold, as far as
    they concern ``inputs``, overflow among them (``first_mask``)."""
    out = rj.name_ranges(files, file, modes, "file_first", "file_last", "number", "mode", limit=limit)
    if mask_names is None:
        out = rj.first_interval(out, [file], closed, masks, "start", "stop", "rank", "mask")
    else:
        out = first_mask(out, file, closed, masks, mask_names, inputs, overflow, overflow_mask, aliases)
    reason = (F.when(~F.col(closed).between(start, stop), "time").when(~F.col(phase).isin(*phases), "phase")
              .when(F.col("mode") == "", "unmapped").when(~mode_filter(wanted), "mode")
              .when(F.col("mask").isNotNull(), F.concat(F.lit("mask: "), F.col("mask"))))
    return out.withColumn("reason", reason)


def current_names(names: list[str], aliases: dict[str, str]) -> list[str]:
    """Old names replaced by their present ones, each with a warning; unknown names pass."""
    for old in sorted(set(names) & set(aliases)):
        warnings.warn(f"{old!r} is now called {aliases[old]!r}", FutureWarning, stacklevel=3)
    return sorted({aliases.get(n, n) for n in names})


def first_mask(files: DataFrame, file: str, closed: str, masks: DataFrame, wanted: list[str], inputs: list[int] | None = None,
               overflow: DataFrame | None = None, overflow_mask: tuple[str, float] = ("overflow", 0.0),
               aliases: dict[str, str] | None = None) -> DataFrame:
    """Add ``mask``: the first mask that holds a file's close time, or NULL.

    ``masks``: mask, start, stop, rank, mandatory, inputs (an array; NULL or
    empty for all).  Mandatory masks come first and always hold; of the others
    the ``wanted`` ones do, unless bound to inputs none of which is asked for.
    ``overflow`` (file, input): inputs with wrapped samples; if its mask (name,
    rank) is wanted, it holds files in which an asked input wrapped.  Without
    ``inputs`` all are asked for."""
    names = current_names(wanted, aliases or {})
    asked = F.lit(True) if not inputs else F.arrays_overlap(F.col("inputs").cast("array<bigint>"), F.array(*map(F.lit, inputs)).cast("array<bigint>"))
    scoped = F.coalesce(F.size("inputs") > 0, F.lit(False))
    must = F.coalesce("mandatory", F.lit(False))
    active = masks.where(must | (F.col("mask").isin(names) & (~scoped | asked)))
    active = active.select("start", "stop", "mask", F.struct((~must).alias("late"), F.col("rank").cast("double").alias("rank")).alias("_order"))
    hits = rj.in_intervals(files.select(file, closed), closed, active, "start", "stop").select(file, "mask", "_order")
    name, rank = overflow_mask
    if overflow is not None and name in names:
        wrapped = overflow if not inputs else overflow.where(F.col("input").isin(inputs))
        hits = hits.unionByName(wrapped.select(file).distinct().select(file, F.lit(name).alias("mask"), F.struct(F.lit(True).alias("late"), F.lit(float(rank)).alias("rank")).alias("_order")))
    return attach(files, hits.groupBy(file).agg(F.min_by("mask", "_order").alias("mask")), [file])


def selection_warnings(selected: DataFrame) -> DataFrame:
    """Counts of files by outcome."""
    return selected.groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("files"))


def resume_plan(rows: DataFrame, file: str, status: str, completed: DataFrame, per_batch: int, time: str, dt: str,
                same: list[str], limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(one-row report, batches) of what is still to be run."""
    per_file = rows.groupBy(file).agg(F.min(status).alias("status"))
    per_file = cut(attach(per_file, completed.select(file).distinct().withColumn("_done", F.lit(True)), [file]))
    use = F.col("status") == "use"
    report = per_file.agg(F.count(F.lit(1)).alias("requested"), F.count_if(use).alias("approved"),
                          F.count_if(F.col("status") == "reject").alias("rejected"), F.count_if(use & F.col("_done").isNotNull()).alias("completed"))
    todo = per_file.where(use & F.col("_done").isNull()).select(file)
    plan = sg.batches(rows.join(todo, file, "left_semi"), file=file, time=time, dt=dt, same=same, per_batch=per_batch, limit=limit)
    totals = plan.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("files"), F.lit(0)).alias("pending"),
                      F.coalesce(F.sum("rows"), F.lit(0)).alias("pending_rows"))
    both = report.unionByName(totals, allowMissingColumns=True)  # two rows
    return both.agg(*[F.max(c).alias(c) for c in both.columns]), plan
