"""Scans: file rows with arrays and JSON streams become integration rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellgrid.functions.clock import best_time

MISSING = "MISSING"  # fixed value: text of a string field nobody recorded


def scan_integrations(files: DataFrame, stamp: str, dt: str, times: str = "times",
                      counts: str = "acc_cnt", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per integration of every file, with repaired times.

    Per-file values (last header time, row count) come from the array itself,
    so the scan needs no window and no shuffle, and spectra are never read.
    """
    per_file = files.select(
        *keep, F.col(stamp).alias("_stamp"), F.col(dt).alias("integration_time"), counts,
        F.size(times).alias("_n"), F.element_at(times, -1).alias("_last"), times)
    rows = per_file.select("*", F.posexplode(times).alias("row_no", "time"))
    fixed = best_time(F.col("time"), F.col("_stamp"), F.col("_last"), F.col("_n"), F.col("row_no"),
                      F.col("integration_time"))
    count = F.get(counts, F.col("row_no"))
    return rows.select(
        *keep, "row_no", "time", "integration_time", count.alias("acc_cnt"),
        (F.col("time") - count * F.col("integration_time")).alias("sync_recovered"),
        *[c.alias(n) for n, c in fixed.items()])


def override(header: Column, root: Column) -> Column:
    """A header attribute wins over the root attribute of the same name."""
    return F.coalesce(header, root)


def flatten_stream(df: DataFrame, text: str, stream: str, fields: dict[str, str]) -> DataFrame:
    """JSON text of one stream -> ``<stream>_<field>`` columns and ``<stream>_ok``.

    ``fields`` maps names to ``double``, ``boolean`` or ``string``.  An absent
    stream and a null entry clear ok; a null field does not; status "error"
    clears ok but keeps the values.
    """
    ddl = ", ".join(f"`{n}` {t}" for n, t in {**fields, "status": "string"}.items())
    entry = F.from_json(F.col(text), ddl)
    present = F.col(text).isNotNull() & (F.trim(F.col(text)) != "null")
    cols = []
    for name, kind in fields.items():
        value = F.col("_entry")[name]
        if kind == "string":
            value = F.coalesce(value, F.lit(MISSING))
        elif kind == "boolean":
            value = value.cast("int").cast("double")
        else:
            value = F.when(~F.isnan(value), value)
        cols.append(value.alias(f"{stream}_{name}"))
    ok = F.col("_present") & (F.coalesce(F.col("_entry")["status"], F.lit("")) != "error")
    return (df.withColumn("_entry", entry).withColumn("_present", present)
            .select(*df.columns, *cols, F.coalesce(ok, F.lit(False)).alias(f"{stream}_ok")))


def stream_columns(df: DataFrame, want: str | list[str], catalog: dict[str, dict[str, str]],
                   keep: list[str]) -> DataFrame:
    """Project the requested streams; a named stream always yields its columns.

    ``want`` is "all", one stream or a list.  Fields a table lacks become typed
    NULLs, 'MISSING' or false.
    """
    names = sorted(catalog) if want == "all" else sorted({want} if isinstance(want, str) else set(want))
    unknown = set(names) - set(catalog)
    if unknown:
        raise KeyError(f"unknown streams {sorted(unknown)}; known: {sorted(catalog)}")
    blank = {"double": F.lit(None).cast("double"), "boolean": F.lit(None).cast("double"), "string": F.lit(MISSING)}
    cols = []
    for s in names:
        for field, kind in catalog[s].items():
            n = f"{s}_{field}"
            cols.append(F.col(n) if n in df.columns else blank[kind].alias(n))
        n = f"{s}_ok"
        cols.append(F.col(n) if n in df.columns else F.lit(False).alias(n))
    return df.select(*keep, *cols)


def covers(have: str | list[str], want: str | list[str]) -> bool:
    """Whether a table scanned for ``have`` answers a request for ``want``."""
    if have == "all":
        return True
    if want == "all":
        return False
    as_set = lambda s: {s} if isinstance(s, str) else set(s)
    return as_set(want) <= as_set(have)


def quarantine(df: DataFrame, text: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with the parsed stream or NULL, the rows whose text is corrupt).

    A bad stream never drops its row: it stays, with the stream lost."""
    schema = T._parse_datatype_string(ddl)
    schema = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = df.withColumn("_p", F.from_json(
        F.col(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_p")["_corrupt"].isNotNull()
    good = parsed.select(*df.columns, *[F.when(~bad, F.col("_p")[f.name]).alias(f.name) for f in schema.fields[:-1]],
                         F.coalesce(bad, F.lit(False)).alias("stream_lost"))
    return good, good.where("stream_lost")


def finalise_union(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Union of tables with differing columns: string gaps become 'MISSING',
    gaps of ``*_ok`` become false, numeric gaps stay NULL; sorted NULL last."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    cols = []
    for f in out.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(F.coalesce(f.name, F.lit(MISSING)).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType) and f.name.endswith("_ok"):
            cols.append(F.coalesce(f.name, F.lit(False)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return out.select(*cols).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def manifest_changes(old: DataFrame, new: DataFrame, name: str, marks: list[str]) -> DataFrame:
    """name -> added / removed / changed / same between two manifests."""
    a = old.select(F.col(name).alias("_old"), F.struct(*marks).alias("_m0"))
    b = new.select(F.col(name).alias("_new"), F.struct(*marks).alias("_m1"))
    both = a.join(b, F.col("_old") == F.col("_new"), "full_outer")
    change = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .when(F.col("_m0").eqNullSafe(F.col("_m1")), "same").otherwise("changed"))
    return both.select(F.coalesce("_old", "_new").alias(name), change.alias("change"))


def decode_complex(pairs: Column) -> Column:
    """Array of [re, im] pairs -> array of structs."""
    return F.transform(pairs, lambda x: F.struct(x[0].alias("re"), x[1].alias("im")))


MAX_KEYS = 10_000


def load_spectra(spectra: DataFrame, chosen: DataFrame, ids: list[str], key: str, value: str,
                 keys: list[str] | None = None, missing: str = "null") -> DataFrame:
    """Selected rows with one column per key.

    Default keys are those every selected file (first id column) has; more than
    ``MAX_KEYS`` of them are refused, since each becomes a column.
    ``missing='raise'`` refuses rows that lack a key. Where ``value`` is an
    array, spectra of the selected rows and keys with differing numbers of
    channels are refused before anything is built on them; NULL ones don't
    count."""
    rows = spectra.join(chosen.select(*ids).distinct(), ids, "left_semi")
    if keys is None:
        files = rows.select(ids[0]).distinct().count()
        have = (rows.select(key, ids[0]).distinct().groupBy(key).count()
                .where(F.col("count") == files).orderBy(key))
        keys = [r[0] for r in have.limit(MAX_KEYS + 1).collect()]
        if len(keys) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} keys would become columns")
    keys = list(dict.fromkeys(keys))
    if isinstance(spectra.schema[value].dataType, T.ArrayType):
        n = F.when(F.col(value).isNotNull(), F.size(value))
        low, high = rows.where(F.col(key).isin(keys)).agg(F.min(n), F.max(n)).first()
        if low != high:
            raise ValueError(f"spectra have {low} to {high} channels")
    wide = rows.where(F.col(key).isin(keys)).groupBy(*ids).pivot(key, keys).agg(F.first(value))
    if missing == "raise":
        gap = F.array(*[F.col(f"`{k}`").isNull() for k in keys])
        wide = wide.where(F.when(F.exists(gap, lambda g: g), F.raise_error(F.lit("a selected row lacks a key")))
                          .otherwise(F.lit(True)))
    return chosen.select(*ids).distinct().join(wide, ids, "left")


def null_block(df: DataFrame, companion: DataFrame, ids: list[str], array: str, n: int) -> DataFrame:
    """Left join of an array companion; rows without one get ``n`` NULLs."""
    gap = F.array_repeat(F.lit(None).cast("double"), n)
    return (df.join(companion.select(*ids, array), ids, "left")
            .withColumn("present", F.col(array).isNotNull()).withColumn(array, F.coalesce(array, gap)))


def scan_window(df: DataFrame, stamp: Column, time: Column, t0: float, t1: float, margin_s: float = 1200.0) -> DataFrame:
    """Two levels of pruning: whole files by their stamp, then rows, half open."""
    return df.where((stamp >= t0) & (stamp <= t1 + margin_s)).where((time >= t0) & (time < t1))
