"""Adapter views: the given tables seen as integrations, cells, spectra and nodes.

Each view has the matching CTE text for the SQL side.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.functions.clock import unix_seconds
from dwellgrid.operators.ordered import numbered

LARGE = 1.7976931348623157e308  # fixed value: the largest double
STATES = {"click": "RFANT", "view": "RFAMB", "purchase": "RFNON", "signup": "VNAANT", "error": "UNKNOWN"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _state() -> F.Column:
    out = F.lit(None).cast("string")
    for event, state in STATES.items():
        out = F.when(F.col("event_type") == event, state).otherwise(out)
    return out


def samples(spark: SparkSession, folder: str, window: tuple[float, float] | None = None, states: list[str] | None = None,
            placed: bool = False) -> DataFrame:
    """Integrations without the row number (no shuffle).

    A half-open time window and a list of states are also stated on the stored
    columns, where the Parquet reader can use them.  ``placed`` adds where a row
    is stored: ``source``, the file it is read from, and ``place``, its number there."""
    ev = table(spark, folder, "events")
    if window is not None:
        naive = [F.lit(datetime.fromtimestamp(t, timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz") for t in window]
        ev = ev.where((F.col("ts") >= naive[0]) & (F.col("ts") < naive[1]))
    if states is not None:
        ev = ev.where(F.col("event_type").isin([e for e, s in STATES.items() if s in states]))
    place = [F.col("_metadata.file_path").alias("source"), F.col("_metadata.row_index").alias("place")] if placed else []
    return ev.select(
        "event_id", unix_seconds(F.col("ts")).alias("t"),
        F.concat(F.lit("corr_"), F.date_format("ts", "yyyyMMdd"), F.lit("_235959Z.h5")).alias("file"),
        (F.col("user_id") % 4).cast("int").alias("input"), "user_id", _state().alias("state"),
        F.col("value").alias("power"), F.col("props").alias("meta"), *place,
    )


SAMPLES = """ev AS (SELECT event_id, epoch_us(ts)/1e6 AS t,
  'corr_'||strftime(ts,'%Y%m%d')||'_235959Z.h5' AS file, CAST(user_id%4 AS INT) AS input, user_id,
  CASE event_type WHEN 'click' THEN 'RFANT' WHEN 'view' THEN 'RFAMB' WHEN 'purchase' THEN 'RFNON'
    WHEN 'signup' THEN 'VNAANT' WHEN 'error' THEN 'UNKNOWN' END AS state,
  value AS power, props AS meta FROM events)"""


def integrations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per integration: (file, row_no) is the identity."""
    return numbered(samples(spark, folder), ["file"], ["t", "event_id"], "row_no")


INTEG = SAMPLES + """, integ AS (SELECT *,
  CAST(row_number() OVER (PARTITION BY file ORDER BY t, event_id)-1 AS BIGINT) AS row_no FROM ev)"""


def spectra(spark: SparkSession, folder: str) -> DataFrame:
    """Array form: one row per time sample with its spectrum."""
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("row_no"), "label",
                    F.col("embedding").cast("array<double>").alias("spec"))


SPECTRA = """spectra AS (SELECT vec_id AS row_no, label, CAST(embedding AS DOUBLE[]) AS spec FROM embeddings)"""


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cell form: one row per (time sample, channel)."""
    return spectra(spark, folder).select(
        "row_no", "label", F.posexplode("spec").alias("chan", "x")
    ).withColumn("p", 1000 * F.exp("x"))


CELLS = SPECTRA + """, cells AS (SELECT row_no, label, CAST(chan AS INT) AS chan, x, 1000*exp(x) AS p FROM (
  SELECT row_no, label, unnest(spec) AS x, generate_subscripts(spec,1)-1 AS chan FROM spectra))"""


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One node per order date: time, label, value."""
    o = table(spark, folder, "orders")
    return o.groupBy(unix_seconds(F.col("o_orderdate")).alias("t")).agg(
        F.min("o_orderpriority").alias("label"), F.avg("o_totalprice").alias("v"))


NODES = """nodes AS (SELECT epoch_us(o_orderdate)/1e6 AS t, min(o_orderpriority) AS label,
  avg(o_totalprice) AS v FROM orders GROUP BY o_orderdate)"""


def shipped(spark: SparkSession, folder: str) -> DataFrame:
    """Rows on the order time line, six hours apart by flag: flag, time, value."""
    li = table(spark, folder, "lineitem")
    shift = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 21600).otherwise(43200)
    return li.groupBy(F.col("l_returnflag").alias("flag"), (unix_seconds(F.col("l_shipdate")) + shift).alias("t")).agg(
        F.sum("l_quantity").alias("x"), F.count(F.lit(1)).alias("n"))


SHIPPED = """shipped AS (SELECT l_returnflag AS flag, epoch_us(l_shipdate)/1e6 +
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 21600 ELSE 43200 END AS t,
  sum(l_quantity) AS x, count(*) AS n FROM lineitem GROUP BY 1, 2)"""


def r6(c, digits: int = 6):
    """Round for comparison as SQL rounds: the scaled number, scaled back, or the number
    itself where it is too large to scale; adding 0.0 turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.when(F.abs(c) < LARGE / scale, F.round(c * scale) / scale).otherwise(c) + F.lit(0.0)
