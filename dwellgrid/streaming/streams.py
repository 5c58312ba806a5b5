"""Streaming forms of the batch operators on Structured Streaming.

State is bounded by the watermark in every form; batch and streaming give the
same rows for data that arrives in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BACKLOG = "16 minutes"  # fixed value: how late a file may be written


def file_stream(spark: SparkSession, path: str, schema, pattern: str = "*", per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as they appear, at most ``per_trigger`` at once; the checkpoint keeps the manifest."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def append_index(stream: DataFrame, index_path: str, checkpoint: str, day: Column):
    """Append every new file's rows to the integration table, one folder per day."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch replaces its own folders instead of adding rows
        (batch.withColumn("day", day).withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(index_path))

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def visits(stream: DataFrame, ts: str, gap: str, keys: list[str], value: str, late: str = BACKLOG) -> DataFrame:
    """Sessions split where rows are more than ``gap`` apart; a gap equal to it merges."""
    return (stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("stop"), F.avg(value).alias("mean"))
            .select(*keys, "start", "stop", "n", "mean"))


def summary(stream: DataFrame, ts: str, keys: list[str], flag: Column, late: str = BACKLOG) -> DataFrame:
    """Daily counts and flagged share per key."""
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("flagged"))
            .select(F.date_format("w.start", "yyyyMMdd").alias("day"), *keys, "n", "flagged"))


def rolling_mean(stream: DataFrame, ts: str, length: str, step: str, keys: list[str], value: str, late: str = BACKLOG) -> DataFrame:
    """Averages over sliding windows."""
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, length, step).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
            .select(F.unix_seconds("w.start").alias("start"), *keys, "n", "mean"))


def route_late(stream: DataFrame, ts: str, path: str, marks: str, checkpoint: str, late_s: float = 960.0):
    """Mark rows by lateness: those more than ``late_s`` behind the latest time
    of earlier batches are late; nothing is dropped.

    Rows are written once, partitioned by ``late`` and batch.  The latest time of
    each batch is one row of the side table ``marks``, so a restarted query goes
    on from what it wrote, and a batch written again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = None
        if batch_id:
            earlier = spark.read.schema("top timestamp, batch bigint").parquet(marks).where(F.col("batch") < batch_id)
            seen = earlier.agg(F.max("top")).first()[0]
        is_late = F.lit(False) if seen is None else F.col(ts) < F.lit(seen) - F.make_dt_interval(secs=F.lit(late_s))
        tagged = batch.withColumns({"late": F.coalesce(is_late, F.lit(False)), "batch": F.lit(batch_id)})
        replace = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
        replace(tagged, "batch", "late").parquet(path)
        done = spark.read.schema(tagged.schema).parquet(path).where(F.col("batch") == batch_id)
        replace(done.agg(F.max(ts).alias("top")).withColumn("batch", F.lit(batch_id)), "batch").parquet(marks)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


_WAITING = ["none", "key", "us", "id", "state", "value"]
_BY = ["none", "key"]


class BlockGate(StatefulProcessor):
    """Number the switch blocks of the keys of one shard in order of event time, with the last node.

    Rows wait in the state, packed as Arrow tables, until the watermark has passed
    them; a timer at the earliest waiting row then releases all that are due at
    once, in order, and is set again for the next. So a shard holds the rows of
    one watermark delay, besides one small row per key: last time and state,
    block number, and time and value of the last row in the node state. Calls to
    the state go by shard, not by key or row."""

    def __init__(self, gap_s: float, node_state: str):
        self.gap_us, self.node_state = round(gap_s * 1e6), node_state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")
        self.last = handle.getValueState("last", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.pending.appendValue((_packed(batch[_WAITING]),))
            first = batch.us.min() if first is None else min(first, batch.us.min())
        if first is not None:
            self.handle.registerTimer(int(first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        chunks = [_unpacked(c[0]) for c in self.pending.get()]
        if not chunks:
            return
        held = pd.concat(chunks, ignore_index=True)
        due = held.us // 1000 < timerValues.getCurrentWatermarkInMs()
        if not due.any():
            return
        wait = held[~due]
        if len(wait):
            self.pending.put([(_packed(wait),)])
            self.handle.registerTimer(int(wait.us.min() // 1000))
        else:
            self.pending.clear()
        yield self._numbered(held[due].sort_values([*_BY, "us", "id"], ignore_index=True))

    def _numbered(self, rows: pd.DataFrame) -> pd.DataFrame:
        known = _unpacked(self.last.get()[0]) if self.last.exists() else None
        if known is not None:
            rows = rows.merge(known, on=_BY, how="left")
        else:
            rows = rows.assign(last_us=np.nan, last_state=None, last_block=np.nan, node_us=np.nan, node=np.nan)
        first = ~rows.duplicated(_BY)
        before_us, before = rows.us.shift().where(~first, rows.last_us), rows.state.shift().where(~first, rows.last_state)
        new = (rows.state != before) | (rows.us - before_us > self.gap_us) | (first & rows.last_block.isna())
        at = rows.state == self.node_state
        seen = rows.assign(new=new.astype("int64"), at_us=rows.us.where(at), at_value=rows.value.where(at)).groupby(_BY, sort=False)
        times, nodes = seen.at_us.ffill().fillna(rows.node_us), seen.at_value.ffill().fillna(rows.node)
        blocks = rows.last_block.fillna(-1).astype("int64") + seen.new.cumsum()
        ends = pd.DataFrame({"none": rows.none, "key": rows.key, "last_us": rows.us, "last_state": rows.state, "last_block": blocks,
                             "node_us": times.astype("Int64"), "node": nodes}).drop_duplicates(_BY, keep="last")
        if known is not None:
            ends = pd.concat([known, ends], ignore_index=True).drop_duplicates(_BY, keep="last")
        self.last.update((_packed(ends),))
        return pd.DataFrame({"key": rows.key.astype("Int64").mask(rows.none), "id": rows.id, "us": rows.us, "block": blocks,
                             "node_us": times.astype("Int64"), "node": nodes})

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def gate(stream: DataFrame, ts: str, key: str, id: str, state: str, value: str, gap_s: float, node_state: str, late: str = BACKLOG,
         shards: int = 256) -> DataFrame:
    """id, key, time, block and last node of every row, once the watermark has passed it.

    A block ends where the state changes or more than ``gap_s`` pass without a
    row; rows of one time follow by id. Rows may come in any order within
    ``late``; later ones are dropped by the watermark. Rows after the last
    watermark stay open. ``key`` and ``id`` are integers; a NULL value is no
    node. Keys are dealt over ``shards``, each with one state and one timer; a
    checkpoint keeps its number of shards."""
    k = F.col(key).cast("bigint")
    rows = stream.withWatermark(ts, late).select(F.pmod(F.xxhash64(k), F.lit(shards)).alias("shard"), k.isNull().alias("none"), F.coalesce(k, F.lit(0)).alias("key"),
                                                 F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.col(id).cast("bigint").alias("id"),
                                                 F.col(state).alias("state"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=BlockGate(gap_s, node_state),
        outputStructType="key bigint, id bigint, us bigint, block bigint, node_us bigint, node double",
        outputMode="Append", timeMode="EventTime")
