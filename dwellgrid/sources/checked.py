"""Sources that must satisfy a contract before anything reads on."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, text: str, ddl: str, header_only: str | None = None) -> DataFrame:
    """JSON lines -> rows; blank lines and a provenance-only line are skipped."""
    rows = lines.where(F.trim(F.col(text)) != "")
    if header_only is not None:
        rows = rows.where(F.get_json_object(text, f"$.{header_only}").isNull())
    return rows.select(*[c for c in lines.columns if c != text], F.from_json(text, ddl).alias("_r")).select(
        *[c for c in lines.columns if c != text], "_r.*")


def read_lines(spark: SparkSession, path: str, ddl: str, header_only: str | None = None) -> DataFrame:
    """A JSON-lines file through ``parse_lines``."""
    return parse_lines(spark.read.text(path), "value", ddl, header_only)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Raise if a key occurs twice; returns ``df``."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"duplicate {keys}: {[tuple(r[k] for k in keys) for r in twice]}")
    return df


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    """Raise if a table lacks columns; checked before a plan is built on it."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise KeyError(f"{what} lacks {lacking}; it has {df.columns}")
    return df


def require_version(df: DataFrame, column: str, version: str) -> DataFrame:
    """Rows of exactly the requested version; naming what exists if absent."""
    out = df.where(F.col(column) == version)
    if out.limit(1).count() == 0:
        have = [r[0] for r in df.select(column).distinct().orderBy(column).limit(50).collect()]
        raise KeyError(f"no version {version!r}; available: {have}")
    return out


def read_product(df: DataFrame, version: str, day: Column, keep_day: str, key: tuple[str, str] | None = None) -> DataFrame:
    """One version, one day (and one input) of a product table.

    On a table partitioned by (version, day) both predicates prune folders."""
    out = require_version(df, "version", version).where(day == keep_day)
    if key is not None:
        out = out.where(F.col(key[0]) == key[1])
    if out.limit(1).count() == 0:
        raise KeyError(f"version {version!r} has nothing for {keep_day} {key or ''}")
    return out


def parameter_hash(parameters: dict) -> str:
    """SHA-256 of the parameters as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of every file under a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "length", content_hash(F.col("content")).alias("sha256"))
