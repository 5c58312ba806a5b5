"""Connected components by alternating large and small stars, as joins and minima.

Each step only takes a minimum per node (combined before the shuffle) and joins
it back, so a node with very many links is a skewed join key at worst, which
adaptive execution splits; nothing is gathered per node or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.store import drop_folder, new_folder


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; component: its smallest node.

    ``edges``: two columns a and b of one ordered type; loops and nulls are left
    out, repeats and direction don't matter. No edges give no rows.
    """
    spark = edges.sparkSession
    e, path = _written(edges.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        new, new_path = _written(_small_star(_large_star(e)), "links")
        drop_folder(spark, path)
        e, path = new, new_path
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
