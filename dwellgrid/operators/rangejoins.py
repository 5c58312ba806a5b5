"""Joins to intervals and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.operators.ordered import GROUP_LIMIT, attach, bounded_broadcast, numbered
from dwellgrid.session import cut

BROADCAST_ROWS = 10_000


def in_intervals(rows: DataFrame, at: str, intervals: DataFrame, start: str, stop: str,
                 how: str = "inner", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows with every closed interval [start, stop] that holds them (``how``: inner or left).

    Each interval goes to the one or two bins it touches at the bin width of its
    own length, each row to its bin at every width in use, so long intervals
    never spread over many bins and no row meets an interval far away.  A table
    of at most ``broadcast_rows`` bins is broadcast; the join is the same."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    length = F.greatest(F.col(stop) - F.col(start), F.lit(1.0))
    level = F.ceil(F.log(8.0, length)).cast("int")
    width = F.pow(F.lit(8.0), level)
    binned = intervals.where(F.col(stop) >= F.col(start)).withColumn("_level", level).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    levels = binned.agg(F.sort_array(F.collect_set("_level"))).first()[0]  # at most the exponents of a double
    if how == "left":
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    spots = F.array(*[F.struct(F.lit(v).alias("_level"), F.floor(F.col(at) / (8.0 ** v)).alias("_bin")) for v in levels or [0]])
    spread = rows.withColumn("_spot", F.explode(spots)).select(*rows.columns, "_spot.*")
    small = bounded_broadcast(binned, broadcast_rows)
    hits = spread.join(binned if small is None else small, ["_level", "_bin"]).where(F.col(at).between(F.col(start), F.col(stop))).drop("_level", "_bin")
    if how == "inner":
        return hits
    none = rows.join(hits.select("_row").distinct(), "_row", "left_anti")
    return hits.unionByName(none, allowMissingColumns=True).drop("_row")


def first_interval(rows: DataFrame, ids: list[str], at: str, intervals: DataFrame, start: str, stop: str,
                   rank: str, label: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add the label of the lowest-ranked interval holding each row, or NULL."""
    hits = in_intervals(rows.select(*ids, at), at, intervals.select(start, stop, rank, label), start, stop,
                        broadcast_rows=broadcast_rows)
    best = hits.groupBy(*ids).agg(F.min_by(label, rank).alias(label))
    return attach(rows, best, ids)


def name_ranges(rows: DataFrame, name: str, ranges: DataFrame, first: str, last: str, number: str, label: str,
                wins: str = "first", by_position: bool = False, broadcast_rows: int = BROADCAST_ROWS,
                limit: int = GROUP_LIMIT) -> DataFrame:
    """Label of the inclusive name range holding each row's name; '' without one.

    Overlaps: the first or the last range wins.  ``by_position`` ignores ranges
    whose end points are not both names of the table.  Names are matched once
    each, not once per row.
    """
    names = rows.select(name).distinct()
    if by_position:
        known = names.select(F.col(name).alias("_k"))
        ranges = (ranges.join(known, F.col(first) == F.col("_k"), "left_semi")
                  .join(known, F.col(last) == F.col("_k"), "left_semi"))
    pick = F.min_by if wins == "first" else F.max_by
    # rank all names involved, then join intervals of ranks
    every = names.select(F.col(name).alias("_s")).union(ranges.select(first)).union(ranges.select(last)).distinct()
    place = numbered(every, [], ["_s"], "_r", limit=limit)
    at = lambda df, c, out: df.join(place.select(F.col("_s").alias(f"_s_{out}"), F.col("_r").cast("double").alias(out)),
                                    F.col(c) == F.col(f"_s_{out}")).drop(f"_s_{out}")
    hits = in_intervals(at(names, name, "_at"), "_at", at(at(ranges, first, "_lo"), last, "_hi"), "_lo", "_hi",
                        broadcast_rows=broadcast_rows)
    best = hits.groupBy(name).agg(pick(label, number).alias(label))
    return attach(rows, best, [name]).withColumn(label, F.coalesce(label, F.lit("")))


def policy_match(df: DataFrame, rules: list[dict], strict: bool = True) -> DataFrame:
    """Add ``rule``, ``status``, ``reason`` of the one rule that matches.

    A rule is a dict of name, match (column -> value), status and reason; all
    its equalities must hold.  Anything but one match raises when ``strict``.
    The rules are a short document, so they become one expression, not a join.
    """
    hits = F.filter(F.array(*[
        F.when(_all(rule["match"]), F.struct(F.lit(rule["name"]).alias("rule"), F.lit(rule["status"]).alias("status"),
                                             F.lit(rule.get("reason", "")).alias("reason")))
        for rule in rules]), lambda h: h.isNotNull())
    out = df.withColumn("_hits", hits).withColumn("n_rules", F.size("_hits"))
    one = F.when(F.col("n_rules") == 1, F.col("_hits")[0])
    if strict:
        wrong = F.raise_error(F.concat(F.lit("rules matched: "), F.col("n_rules").cast("string")))
        rule = F.when(F.col("n_rules") == 1, one["rule"]).otherwise(wrong)
    else:
        rule = one["rule"]
    return out.select(*df.columns, rule.alias("rule"), one["status"].alias("status"), one["reason"].alias("reason"), "n_rules")


def _all(match: dict) -> Column:
    out = F.lit(True)
    for c, v in match.items():
        out = out & F.coalesce(F.col(c) == v, F.lit(False))
    return out


def input_order(key: Column) -> Column:
    """Wired (even) inputs first, then by number."""
    n = key.cast("int")
    return F.struct((n % 2).alias("odd"), n.alias("n"))


def resolve_key(files: DataFrame, file: str, mapping: str, antenna: str, available: str) -> DataFrame:
    """file -> the preferred available input carrying the antenna, or NULL."""
    entries = F.filter(F.map_entries(mapping), lambda e: (e["value"] == antenna) & F.array_contains(available, e["key"]))
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct(input_order(e["key"]).alias("o"), e["key"].alias("key"))))
    return files.select(file, F.get(ranked, F.lit(0))["key"].alias("key"))


def resolve_cross(files: DataFrame, file: str, mapping: str, pair: tuple[str, str], available: str) -> DataFrame:
    """file -> cross key of a pair (lower input first) and whether to conjugate.

    Inputs of one file are few: pairs form inside the row's map."""
    def inputs(ant):
        found = F.filter(F.map_entries(mapping), lambda e: e["value"] == ant)
        return F.transform(found, lambda e: e["key"])

    combos = F.flatten(F.transform(inputs(pair[0]), lambda a: F.transform(inputs(pair[1]), lambda b: F.struct(
        input_order(a).alias("oa"), input_order(b).alias("ob"),
        F.when(a.cast("int") < b.cast("int"), F.concat(a, b)).otherwise(F.concat(b, a)).alias("key"),
        (a.cast("int") > b.cast("int")).alias("conjugated"), (a == b).alias("same")))))
    usable = F.filter(combos, lambda c: ~c["same"] & F.array_contains(available, c["key"]))
    best = F.get(F.array_sort(usable), F.lit(0))
    return files.select(file, best["key"].alias("key"), best["conjugated"].alias("conjugated"))


def misaligned(left: DataFrame, right: DataFrame, ids: list[str], axis: list[str]) -> DataFrame:
    """Rows of two inputs that lack a partner or differ on the axis columns."""
    a = left.select(*ids, F.struct(*axis).alias("_a"))
    b = right.select(*ids, F.struct(*axis).alias("_b"))
    both = a.join(b, ids, "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        *ids, F.when(F.col("_b").isNull(), "right missing").when(F.col("_a").isNull(), "left missing").otherwise("axis differs").alias("problem"))


def locate_axis(data: DataFrame, product: DataFrame, chan: str, freq: str, tol: float = 1e-6) -> DataFrame:
    """One row: first data channel and count of the product axis within the
    data's, and whether it is one contiguous run; nothing is regridded."""
    key = F.round(F.col(freq) / tol).cast("bigint")
    d = data.select(F.col(chan).alias("_dc"), key.alias("_f"))
    p = product.select(F.col(chan).alias("_pc"), key.alias("_f"))
    joined = p.join(d, "_f", "left")
    return joined.agg(
        F.min("_dc").alias("first"), F.count(F.lit(1)).alias("n"),
        ((F.count("_dc") == F.count(F.lit(1))) & (F.max("_dc") - F.min("_dc") + 1 == F.count(F.lit(1)))
         & (F.min(F.col("_dc") - F.col("_pc")) == F.max(F.col("_dc") - F.col("_pc")))).alias("contiguous"))


def axis_fingerprint(axis: DataFrame, freq: str) -> DataFrame:
    return axis.agg(F.count(freq).alias("n"), F.min(freq).alias("first"), F.max(freq).alias("last"))


def pending(requested: DataFrame, completed: DataFrame, ids: list[str], marks: list[str], clash: bool = True) -> DataFrame:
    """Requested rows not completed with equal marks (hashes, revision).

    A row completed with other marks raises (``clash``)."""
    if clash:
        other = completed.select(*ids, F.struct(*marks).alias("_m")).join(
            requested.select(*ids, F.struct(*marks).alias("_r")), ids).where(~F.col("_m").eqNullSafe(F.col("_r")))
        bad = other.select(*ids).limit(3).collect()
        if bad:
            raise ValueError(f"completed with other parameters: {[tuple(r) for r in bad]}")
    return requested.join(completed.select(*ids, *marks).distinct(), [*ids, *marks], "left_anti")


def join_exact(rows: DataFrame, product: DataFrame, ids: list[str], prefix: str) -> DataFrame:
    """Equi join on the row identity; rows without a match stay, as NULLs."""
    cols = [c for c in product.columns if c not in ids]
    return rows.join(product.select(*ids, *[F.col(c).alias(f"{prefix}{c}") for c in cols]), ids, "left")


def skipped_files(rows: DataFrame, product: DataFrame, file: str) -> DataFrame:
    """Files the product does not have, with their row counts."""
    lacking = rows.join(product.select(file).distinct(), file, "left_anti")
    return lacking.groupBy(file).agg(F.count(F.lit(1)).alias("rows"))


def require_within(rows: DataFrame, row: str, file: str, lengths: DataFrame, length: str) -> DataFrame:
    """Raise if a file's largest row lies beyond its companion's length."""
    top = rows.groupBy(file).agg(F.max(row).alias("_top"))
    bad = top.join(lengths.select(file, length), file).where(F.col("_top") >= F.col(length)).limit(3).collect()
    if bad:
        raise ValueError(f"rows beyond the companion in {[r[file] for r in bad]}")
    return rows
