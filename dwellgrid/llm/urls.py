"""URL filters: host and path rules first, else gradient-boosted trees on lexical features."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.store import stored

#: Most labelled URLs that the trees are fitted on, the first by hash.
FIT_ROWS = 20_000
# Words that mark a host as unwanted when it labels URLs for training.
UNWANTED = ["pills", "casino", "bets", "spam", "ads"]
FEATURES = [
    "length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "dots",
    "entropy", "host_entropy", "parameters", "longest_label", "vowel_ratio", "special", "secure", "fragment", "host_pages", "suffix_pages", "suffix_hosts",
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(length, rule, verdict) of the longest rule ``host/path`` that fits; null if none.

    A rule fits its host and every subdomain if the path starts with the rule's.
    """
    found = []
    for rule, verdict in rules:
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found)) if found else F.lit(None)


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """The features that a URL has by itself, in the order of FEATURES."""
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".") if host else []
    letters = [c for c in host if c.isalpha()]
    n = max(1, len(url))
    return [
        len(url), len(host), len(path), len(query), len([p for p in path.split("/") if p]), len(labels), sum(c.isdigit() for c in url) / n,
        sum(c.isdigit() for c in host), host.count("-"), url.count("."), _entropy(url), _entropy(host), len([p for p in query.split("&") if p]),
        max(map(len, labels), default=0), sum(c in "aeiou" for c in letters) / max(1, len(letters)), len(re.findall(r"[^\w./:?=&#-]", url)),
        float(url.startswith("https")), float("#" in url),
    ]


def featured(urls: DataFrame) -> DataFrame:
    """``urls`` (id, url, host, path) with its feature array; host and suffix statistics are over all rows."""
    suffix = F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)

    def run(batches):
        for batch in batches:
            rows = [lexical(*x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names, "own"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields), "own array<double>"])
    out = urls.mapInArrow(run, schema).withColumn("suffix", suffix)
    hosts = urls.groupBy("host").agg(F.count("*").alias("host_pages")).withColumn("suffix", suffix)
    suffixes = hosts.groupBy("suffix").agg(F.sum("host_pages").alias("suffix_pages"), F.count("*").alias("suffix_hosts"))
    out = out.join(hosts.select("host", "host_pages"), "host").join(suffixes, "suffix")
    logs = F.array(*[F.log1p(F.col(c).cast("double")) for c in ("host_pages", "suffix_pages", "suffix_hosts")])
    return out.withColumn("features", F.concat("own", logs)).drop("own", "suffix", "host_pages", "suffix_pages", "suffix_hosts")


def fit_trees(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> GBTClassificationModel | None:
    """Boosted trees on (features, blocked 0/1), or None if a class is missing."""
    labelled = labelled.orderBy(F.xxhash64("features"), "blocked").limit(fit_rows)
    some = {r["blocked"]: r["n"] for r in labelled.groupBy("blocked").agg(F.count("*").alias("n")).collect()}
    if len(some) < 2:
        return None
    n = sum(some.values())
    weight = F.when(F.col("blocked") == 1, n / 2 / some[1]).otherwise(n / 2 / some[0])
    rows = labelled.select(array_to_vector("features").alias("features"), F.col("blocked").cast("double").alias("label"), weight.alias("weight"))
    return GBTClassifier(maxIter=10, maxDepth=4, weightCol="weight", seed=7).fit(stored(rows.repartition(6), "url-fit"))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row.

    ``labelled``: url, blocked (0 or 1), from which the trees learn; null labels
    are left out. The longest fitting rule decides; else the trees: block from a
    score of 0.5. Without labels of both kinds the score is null and the verdict
    allow. Null urls and urls without ``://`` have an empty host and path.
    Repeated rows are judged each.
    """
    cols = lambda df, *more: df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).select(*more, "url", "host", "path")
    rows = stored(featured(cols(pages.select(pages[page_id].alias("page_id"), pages[url].alias("url")), "page_id")), "url-features")
    known = labelled.where("blocked IS NOT NULL AND url IS NOT NULL").groupBy("url").agg(F.max("blocked").cast("int").alias("blocked"))
    taught = rows.dropDuplicates(["url"]).join(known, "url").select("features", "blocked")
    model = fit_trees(stored(taught, "url-labelled"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    if model is None:
        out = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(rows.withColumn("features", array_to_vector("features")))
        out = scored.withColumn("score", vector_to_array("probability")[1])
    out = out.withColumn("hit", rule)
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")


def seeded_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) for URLs of known documents: a document's URL ends in its id.

    Block: the host has one of the UNWANTED words as a part between hyphens or
    dots; allow: the document is labelled good and the host has none.
    """
    rows = pages.select("url", host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), r"/(\d+)(?:\.html)?/?$", 1).alias("doc"))
    rows = rows.where(F.col("url").isNotNull())
    bad = rows.where(F.arrays_overlap(F.split("host", r"[.-]"), F.array(*map(F.lit, UNWANTED)))).select("url", F.lit(1).alias("blocked"))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("string").alias("doc")).distinct()
    return rows.join(good, "doc").select("url", F.lit(0).alias("blocked")).unionByName(bad)
