"""Cross-site boilerplate lines by their spread over distinct sites.

A line is known by a 128-bit hash. Lines that occur often enough to reach the
spread at all get a HyperLogLog sketch of their sites, merged by aggregation; a
line whose estimate lies near the limit gets an exact distinct count. A line
that is spread widely stays in the first document that has it and goes
everywhere else, so that text shared by copies isn't lost altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.store import stored

#: Sketch of 2^12 registers: a relative standard error of 1.6 %.
LOG_REGISTERS = 12
NEAR = 5 * 1.04 / 2 ** (LOG_REGISTERS / 2)


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _exploded(docs: DataFrame, min_chars: int) -> DataFrame:
    rows = docs.select("k1", "k2", "doc_id", "site", F.posexplode(_lines("text")).alias("pos", "line")).withColumn("line", F.trim("line"))
    rows = rows.where(F.char_length("line") >= min_chars)
    return rows.select("k1", "k2", "doc_id", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, first place) of lines on at least ``min_sites`` distinct sites."""
    often = stored(lines.where("site IS NOT NULL").groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2"), "lines-often")
    found = lines.join(often, ["h1", "h2"])
    spread = found.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("about"),
        F.min(F.struct("doc_id", "k1", "k2", "pos")).alias("first"),
    )
    spread = stored(spread, "lines-spread")
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    near = spread.where(F.col("about").between(int(low), int(high) + 1))
    exact = found.join(near.select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(F.col("about") > int(high) + 1).select("h1", "h2", "first").unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, min_chars: int = 20, site: str = "source") -> DataFrame:
    """``docs`` without cross-site boilerplate lines; adds n_lines and n_removed.

    A line is trimmed of spaces for comparison; lines under ``min_chars``
    characters always stay. A line on ``min_sites`` distinct sites or more
    stays only at its first place (smallest doc_id, then line; a null id comes
    first). The other lines are joined again as they were. A null site counts
    for no line, but its lines are removed as well. Null text stays null and
    counts no line; empty text has one line. Equal rows are treated alike. Every
    row stays, also when no line of it does. A column of ``docs`` that has one
    of the new names is replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    key = [F.col("doc_id").cast("string"), F.col(site).cast("string"), F.col("text")]
    keyed = docs.select(
        F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].alias("doc_id"), docs[site].cast("string").alias("site"), docs["text"].alias("text"),
        F.xxhash64(*key).alias("k1"), F.xxhash64(F.lit("second"), *key).alias("k2"),
    )
    lines = _exploded(keyed, min_chars)
    spread = stored(boilerplate(lines, min_sites), "lines-boilerplate")
    place = F.struct("doc_id", "k1", "k2", "pos")
    gone = lines.join(spread, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    gone = stored(gone, "lines-gone")
    all_lines = _lines("text")
    left = F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("long")
    out = keyed.join(gone, ["k1", "k2"], "left")
    return out.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names], n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


LINES_SQL = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
b AS (
  SELECT trim(line) AS t, min({'d': doc_id, 'p': pos}) AS first FROM l WHERE length(trim(line)) >= 20
  GROUP BY 1 HAVING count(DISTINCT source) >= 10)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (b.t IS NOT NULL AND b.first <> {'d': l.doc_id, 'p': l.pos}) AS BIGINT) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (b.t IS NULL OR b.first = {'d': l.doc_id, 'p': l.pos}), '') AS text
FROM l LEFT JOIN b ON trim(l.line) = b.t GROUP BY l.doc_id
"""
