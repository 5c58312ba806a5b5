"""Running values and moving frames over ordered rows, at any group size.

A SQL window sends a whole group to one task.  That is fine for a group of
known size and fatal for a group holding a third of a large table, or for an
order with no key at all.  Every operator here therefore looks at the size of
the largest group first (one aggregation over the key columns):

* up to ``GROUP_LIMIT`` rows it is a plain window;
* beyond, the rows are range-partitioned by (keys, order), so that a group is
  spread over many slices of even size (at most the limit or ``SLICE_ROWS`` rows,
  whichever is more), the window runs inside each slice, and
  what earlier or later slices contribute comes from one row per slice.

Only the first and the last key of a slice can continue in another slice, so
the table of contributions has at most two rows per slice and is broadcast.
``order`` must be a total order within a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.session import cut

GROUP_LIMIT = 1_000_000
SLICE_ROWS = 100_000  # no slice is cut smaller for a low limit: each is a task

Exprs = dict[str, Column]


@dataclass(frozen=True)
class Size:
    """Row count of a table and of its largest group."""

    total: int
    largest: int


def measure(df: DataFrame, keys: list[str]) -> Size:
    """Count rows and the largest group; reads the key columns only."""
    if not keys:
        n = df.count()
        return Size(n, n)
    r = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
        .first()
    )
    return Size(r["total"] or 0, r["largest"] or 0)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality on all keys, NULL equal to NULL."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def _by(keys: list[str]):
    return Window.partitionBy(*(keys or [F.lit(0)]))


def _backwards(order: list[str]) -> list[Column]:
    """The reverse order.  Looking ahead is done as looking back in it: a frame
    that is unbounded ahead is evaluated anew for every row."""
    return [F.col(c).desc() for c in order]


def _in_slices(df: DataFrame, keys: list[str], order: list[str], size: Size, limit: int) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, 2, -(-size.total // max(limit, SLICE_ROWS)))
    sliced = df.repartitionByRange(n, *keys, *order)
    return cut(sliced.withColumn("_slice", F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    sums: Exprs | None = None,
    last: Exprs | None = None,
    next: Exprs | None = None,
    lag: Exprs | None = None,
    lead: Exprs | None = None,
    size: Size | None = None,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add running columns to ``df``.

    ``sums``: sum up to and including the row.  ``last`` / ``next``: the latest
    non-NULL value at or before / the earliest at or after the row.  ``lag`` /
    ``lead``: the value of the row before / after.
    """
    sums, last, next, lag, lead = (d or {} for d in (sums, last, next, lag, lead))
    size = size or measure(df, keys)
    if size.largest <= limit:
        w = _by(keys).orderBy(*order)
        up = w.rowsBetween(Window.unboundedPreceding, 0)
        down = _by(keys).orderBy(*_backwards(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*",
            *[F.sum(c).over(up).alias(n) for n, c in sums.items()],
            *[F.last(c, ignorenulls=True).over(up).alias(n) for n, c in last.items()],
            *[F.last(c, ignorenulls=True).over(down).alias(n) for n, c in next.items()],
            *[F.lag(c).over(w).alias(n) for n, c in lag.items()],
            *[F.lead(c).over(w).alias(n) for n, c in lead.items()],
        )

    out_names = [*df.columns, *sums, *last, *next, *lag, *lead]
    work = df.select("*", *[c.alias(f"_s_{n}") for n, c in sums.items()],
                     *[c.alias(f"_l_{n}") for n, c in last.items()],
                     *[c.alias(f"_n_{n}") for n, c in next.items()],
                     *[F.struct(c.alias("v")).alias(f"_g_{n}") for n, c in lag.items()],
                     *[F.struct(c.alias("v")).alias(f"_d_{n}") for n, c in lead.items()])
    rows = _in_slices(work, keys, order, size, limit)

    def placed(name):
        return F.struct(*order, F.col(name).alias("v"))

    parts = rows.groupBy("_slice", *keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums],
        *[F.max(F.when(F.col(f"_l_{n}").isNotNull(), placed(f"_l_{n}")))["v"].alias(f"_l_{n}") for n in last],
        *[F.min(F.when(F.col(f"_n_{n}").isNotNull(), placed(f"_n_{n}")))["v"].alias(f"_n_{n}") for n in next],
        *[F.max(placed(f"_g_{n}"))["v"].alias(f"_g_{n}") for n in lag],
        *[F.min(placed(f"_d_{n}"))["v"].alias(f"_d_{n}") for n in lead],
    )
    wk = _by(keys).orderBy("_slice")
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    after = _by(keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col("_slice").alias("_c_slice"),
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.count(F.lit(1)).over(_by(keys)).alias("_c_slices"),
        *[F.sum(f"_s_{n}").over(before).alias(f"_cs_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in last],
        *[F.last(f"_n_{n}", ignorenulls=True).over(after).alias(f"_cn_{n}") for n in next],
        *[F.lag(f"_g_{n}").over(wk).alias(f"_cg_{n}") for n in lag],
        *[F.lead(f"_d_{n}").over(wk).alias(f"_cd_{n}") for n in lead],
    ).where("_c_slices > 1")

    w = Window.partitionBy("_slice", *keys).orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_slice", *keys).orderBy(*_backwards(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        "_slice", *df.columns,
        *[F.sum(f"_s_{n}").over(up).alias(f"_s_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(up).alias(f"_l_{n}") for n in last],
        *[F.last(f"_n_{n}", ignorenulls=True).over(down).alias(f"_n_{n}") for n in next],
        *[F.lag(f"_g_{n}").over(w).alias(f"_g_{n}") for n in lag],
        *[F.lead(f"_d_{n}").over(w).alias(f"_d_{n}") for n in lead],
    )
    cond = F.col("_slice") == F.col("_c_slice")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    # at most two rows per slice: a key in several slices is the first or last of each
    joined = local.join(F.broadcast(carried), cond, "left")

    def total(n):
        both = F.coalesce(f"_s_{n}", f"_cs_{n}")
        return F.when(F.col(f"_s_{n}").isNotNull() & F.col(f"_cs_{n}").isNotNull(),
                      F.col(f"_s_{n}") + F.col(f"_cs_{n}")).otherwise(both)

    return joined.select(
        *df.columns,
        *[total(n).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_cl_{n}").alias(n) for n in last],
        *[F.coalesce(f"_n_{n}", f"_cn_{n}").alias(n) for n in next],
        *[F.coalesce(f"_g_{n}", f"_cg_{n}")["v"].alias(n) for n in lag],
        *[F.coalesce(f"_d_{n}", f"_cd_{n}")["v"].alias(n) for n in lead],
    ).select(*out_names)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "pos",
             size: Size | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """Add the 0-based position of each row within its group."""
    out = running(df, keys, order, sums={name: F.lit(1).cast("long")}, size=size, limit=limit)
    return out.withColumn(name, F.col(name) - 1)


def framed(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    back: int,
    ahead: int,
    make,
    *,
    edge: str | None = None,
    size: Size | None = None,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add columns computed over a frame of ``back`` rows before to ``ahead``
    after each row; ``make(frame, ordered)`` returns ``{name: Column}`` given the
    framed and the unframed window.

    ``edge='nearest'`` repeats the first and last row beyond the ends.  Groups
    above the limit are cut into blocks of positions; each block also gets
    copies of the rows its outer frames reach into.
    """
    size = size or measure(df, keys)
    if size.largest <= limit and edge is None:
        w = _by(keys).orderBy(*order)
        cols = make(w.rowsBetween(-back, ahead), w)
        return df.select("*", *[c.alias(n) for n, c in cols.items()])
    rows = numbered(df, keys, order, "_pos", size, limit)
    work_keys = list(keys)
    places = F.array(F.col("_pos"))
    if edge == "nearest":
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
        rows = attach(rows, counts, keys)
        before = F.when(F.col("_pos") == 0, F.sequence(F.lit(-back), F.lit(-1)).cast("array<bigint>"))
        after = F.when(F.col("_pos") == F.col("_len") - 1,
                       F.sequence(F.col("_len"), F.col("_len") + F.lit(ahead - 1)))
        none = F.array().cast("array<bigint>")
        places = F.concat(places,
                          F.coalesce(before, none) if back else none,
                          F.coalesce(after, none) if ahead else none)
    rows = rows.withColumn("_at", F.explode(places)).withColumn("_own", F.col("_at") == F.col("_pos"))
    if size.largest > limit:
        span = max(limit // 2, back + ahead + 1)
        home = F.floor(F.col("_at") / span)
        # the blocks whose frames can reach this position
        reach = F.sequence(F.floor((F.col("_at") - ahead) / span), F.floor((F.col("_at") + back) / span))
        rows = rows.withColumn("_home", home).withColumn("_block", F.explode(reach))
        rows = rows.withColumn("_own", F.col("_own") & (F.col("_home") == F.col("_block")))
        work_keys.append("_block")
    w = _by(work_keys).orderBy("_at")
    cols = make(w.rowsBetween(-back, ahead), w)
    out = rows.select("*", *[c.alias(n) for n, c in cols.items()]).where("_own")
    return out.select(*df.columns, *cols)


def attach(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a table with one row per key back to the rows (NULL keys match)."""
    extra = [c for c in table.columns if c not in keys]
    if not keys:
        # one row: a proven size
        return df.join(F.broadcast(table), F.lit(True), how)
    renamed = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *extra)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def bounded_broadcast(table: DataFrame, rows: int = 10_000) -> DataFrame | None:
    """``broadcast(table)`` if it has at most ``rows`` rows, else None."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else None
