"""Queries that run a stream over the events table to its end."""

from pyspark.sql import functions as F

from dwellgrid.catalog.aggregates import rounded
from dwellgrid.catalog.registry import query
from dwellgrid.catalog.scan import _folder
from dwellgrid.catalog.views import SAMPLES, r6, table
from dwellgrid.streaming import streams as st


def _part(e, parts: int, moved):
    """``e`` with the part of the time line in which a row arrives: that of its time, or the next where ``moved`` says so."""
    u = F.unix_micros("ts")
    lo, span = e.agg(F.min(u), F.max(u) - F.min(u) + 1).first()
    return e.withColumn("part", F.expr(f"{parts} * (unix_micros(ts) - {lo}L) div {span}L") + moved(lo, span / parts).cast("int"))


def _late_halves(lo, width):
    """Every other row of the last ten minutes of a part comes with the next one, so parts overlap in time."""
    return (F.col("event_id") % 2 == 0) & (F.pmod(F.unix_micros("ts") - lo, F.lit(width)) > width - 600e6)


def arriving(spark, folder, start, parts: int = 4, moved=_late_halves) -> str:
    """Let events come part by part, each written as Spark writes it, and start a stream on what is new: one run per part, from the same checkpoint.

    ``start(stream, path)``: the running query. Returns ``path``."""
    path = _folder(spark)
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    dealt = _part(e, parts, moved)
    for k in range(parts + 1):
        dealt.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{path}/in")
        stream = st.file_stream(spark, f"{path}/in", e.schema, "*.parquet")
        stream = stream.withColumn("state", F.col("event_type")).withColumn("input", (F.col("user_id") % 4).cast("int"))
        start(stream, path).awaitTermination()
    return path


def drained(spark, folder, make, mode="append"):
    """The rows that a stream over arriving events has written in the end."""
    kept = {}

    def start(stream, path):
        kept["df"] = make(stream)
        return (kept["df"].writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
                .trigger(availableNow=True).start())

    path = arriving(spark, folder, start)
    return spark.read.schema(kept["df"].schema).parquet(f"{path}/out")


@query("stream_index", f"WITH {SAMPLES} SELECT strftime(ts,'%Y%m%d') AS day, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1")
def stream_index(spark, folder):
    path = arriving(spark, folder, lambda s, at: st.append_index(s, f"{at}/index", f"{at}/cp", F.date_format("ts", "yyyyMMdd")))
    back = spark.read.schema("event_id bigint, value double, day string").parquet(f"{path}/index")
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("total"))


# rows the watermark has not passed stay open: append mode emits what is final
_FINAL = "(SELECT max(ts) - INTERVAL 16 MINUTE FROM events)"


@query("stream_visits", f"""WITH l AS (SELECT ts, event_type AS state, value, ts-lag(ts) OVER (PARTITION BY event_type ORDER BY ts,event_id) AS g FROM events), v AS (SELECT *, sum(CASE WHEN g>INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY state ORDER BY ts) AS v FROM l)
SELECT state, epoch_us(min(ts))/1e6 AS start, epoch_us(max(ts))/1e6 AS stop, count(*) AS n, round(avg(value),7) AS mean FROM v GROUP BY state, v HAVING max(ts) + INTERVAL 10 MINUTE <= {_FINAL}""")
def stream_visits(spark, folder):
    out = drained(spark, folder, lambda s: st.visits(s, "ts", "10 minutes", ["state"], "value"))
    sec = lambda c: (F.unix_micros(c) / 1e6).alias(c)
    return out.select("state", sec("start"), sec("stop"), "n", r6("mean", 7).alias("mean"))


@query("stream_summary", f"""SELECT strftime(ts,'%Y%m%d') AS day, CAST(user_id%4 AS INT) AS input, count(*) AS n, round(avg((value>50)::INT),9) AS flagged FROM events GROUP BY 1,2,date_trunc('day',ts) HAVING date_trunc('day',ts) + INTERVAL 1 DAY <= {_FINAL}""")
def stream_summary(spark, folder):
    return rounded(drained(spark, folder, lambda s: st.summary(s, "ts", ["input"], F.col("value") > 50)))


@query("stream_rolling", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * j AS b, state, value FROM (SELECT ts, event_type AS state, value FROM events), (SELECT unnest(range(0,3)) AS j))
SELECT CAST(epoch(b) AS BIGINT) AS start, state, count(*) AS n, round(avg(value),7) AS mean FROM w GROUP BY b, state HAVING b + INTERVAL 3 HOUR <= {_FINAL}""")
def stream_rolling(spark, folder):
    out = drained(spark, folder, lambda s: st.rolling_mean(s, "ts", "3 hours", "1 hour", ["state"], "value"))
    return out.select("start", "state", "n", r6("mean", 7).alias("mean"))


# four parts of the time line arrive one after the other, each tenth event a part later
@query("stream_late", """WITH e AS (SELECT event_id, epoch_us(ts) AS u FROM events), r AS (SELECT min(u) AS lo, max(u)-min(u)+1 AS span FROM e),
b AS (SELECT event_id, u, CAST(4*(u-lo)//span + (event_id%10=0)::INT AS INT) AS part FROM e, r), m AS (SELECT part, max(u) AS top FROM b GROUP BY 1)
SELECT event_id, coalesce(u < (SELECT max(top) FROM m WHERE m.part<b.part) - 960000000, false) AS late FROM b""")
def stream_late(spark, folder):
    tenth = lambda lo, width: F.col("event_id") % 10 == 0
    path = arriving(spark, folder, lambda s, at: st.route_late(s.select("event_id", "ts"), "ts", f"{at}/out", f"{at}/marks", f"{at}/cp"), moved=tenth)
    return spark.read.schema("event_id bigint, late boolean").parquet(f"{path}/out").select("event_id", "late")


@query("stream_gate", f"""WITH {SAMPLES}, l AS (SELECT event_id AS id, user_id, t, state, power, lag(state) OVER w AS ps, t-lag(t) OVER w AS g FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t,event_id)),
n AS (SELECT id, user_id AS key, CAST(sum(CASE WHEN ps IS NULL OR ps<>state OR g>3600 THEN 1 ELSE 0 END) OVER w-1 AS BIGINT) AS block, last_value(CASE WHEN state='RFNON' THEN power END IGNORE NULLS) OVER w AS node FROM l WINDOW w AS (PARTITION BY user_id ORDER BY t,id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT n.* FROM n JOIN events ON event_id=id WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 960000 FROM events)""")
def stream_gate(spark, folder):
    """Blocks of one user's events, rows out of order over five runs of the stream."""
    # the state store with list states and timers; a runtime setting of this stream only
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return drained(spark, folder, lambda s: st.gate(s, "ts", "user_id", "event_id", "state", "value", 3600.0, "purchase")).select("id", "key", "block", "node")
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
