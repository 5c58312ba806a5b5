"""Writes behind assertions: whole files, one axis, no silent overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def whole_files(result: DataFrame, raw: DataFrame, file: str, row: str) -> DataFrame:
    """Files whose result rows are not exactly the raw rows (empty when right)."""
    got = result.groupBy(file).agg(F.count(F.lit(1)).alias("_got"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("_gh"))
    distinct = result.select(file, row).distinct().groupBy(file).agg(F.count(F.lit(1)).alias("_distinct"))
    want = raw.groupBy(file).agg(F.count(F.lit(1)).alias("_want"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("_wh"))
    same = (F.col("_got").eqNullSafe(F.col("_want")) & F.col("_distinct").eqNullSafe(F.col("_want"))
            & F.col("_gh").eqNullSafe(F.col("_wh")))
    return got.join(distinct, file).join(want, file, "full_outer").where(~same).select(file)


def write_product(result: DataFrame, raw: DataFrame, path: str, *, version: str, file: str, row: str,
                  day: str, overwrite: bool = False) -> None:
    """Write one version, one folder per day, rows in (file, row) order.

    Refuses partial files, and an existing version unless ``overwrite``; the
    overwrite replaces the days written and no others.
    """
    spark = result.sparkSession
    bad = whole_files(result, raw, file, row).limit(3).collect()
    if bad:
        raise ValueError(f"rows are not exactly the raw rows in {[r[0] for r in bad]}")
    if not overwrite and _exists(spark, f"{path}/version={version}"):
        raise FileExistsError(f"{path}/version={version}")
    (result.withColumn("version", F.lit(version))
     # rows of one day still go to several tasks: a day may hold most rows
     .repartitionByRange(day, file, row).sortWithinPartitions(file, row)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version", day).parquet(path))


def write_day_tables(masks: DataFrame, log: DataFrame, bits: dict[str, int], path: str, day: str) -> None:
    """Day-partitioned masks with their detection log and bit dictionary."""
    spark = masks.sparkSession
    masks.write.mode("overwrite").partitionBy(day).parquet(f"{path}/masks")
    log.write.mode("overwrite").partitionBy(day).parquet(f"{path}/log")
    spark.createDataFrame(sorted(bits.items()), "reason string, bit int").write.mode("overwrite").parquet(f"{path}/bits")


def write_solutions(on: DataFrame, path: str, version: str, overwrite: bool = False) -> None:
    """Persist per-channel solutions of one version: excess = on - off."""
    target = f"{path}/version={version}"
    if not overwrite and _exists(on.sparkSession, target):
        raise FileExistsError(target)
    on.withColumn("excess", F.col("on") - F.col("off")).write.mode("overwrite").parquet(target)


def load_solutions(spark: SparkSession, path: str, version: str, channels: int) -> DataFrame:
    """Read a version back; every channel of the axis must be there once."""
    df = spark.read.parquet(f"{path}/version={version}")
    n, d = df.agg(F.count("chan"), F.countDistinct("chan")).first()
    if n != channels or d != channels:
        raise ValueError(f"{n} rows on {d} channels, the axis has {channels}")
    return df
