"""From documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.llm.contamination import decontaminate
from dwellgrid.llm.lines import dedup_lines
from dwellgrid.llm.near import near_duplicates
from dwellgrid.llm.packing import pack
from dwellgrid.llm.quality import classify
from dwellgrid.llm.store import new_folder, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.join(scored.where("NOT accepted").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten or more sources share; n_chars is counted anew."""
    out = dedup_lines(docs)
    n = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id; of rows alike, one."""
    verdicts = stored(near_duplicates(docs), "near-verdicts")
    out = docs.join(verdicts.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = verdicts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    if again.isEmpty():
        return out
    alike = out.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(alike)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where(F.size("hits") == 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents, placed in sequences of 2048 tokens."""
    return pack(docs, with_ids=False)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("decontamination", decontamination), ("packing", packing)]
#: SQL can't express training, tokens or packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
