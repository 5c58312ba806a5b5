"""Quality classifier by co-training on two views of a document.

The text view sees counts and shares of the text and its hashed words; the
metadata view sees source, language and stated length. Each view's classifier
labels the unlabelled documents that it is sure of; in the next round these
teach the other view. At the end each view is calibrated on labelled documents
that no round has seen, and the calibrated views are combined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.rules import _chunk_stats
from dwellgrid.llm.store import stored
from dwellgrid.llm.text import VISIBLE, U, bounded_batches, chunks, hashed, row_sums, words

BUCKETS = 32
ROUNDS = 2
SURE = 0.95
#: Most labelled rows that calibrate the views, the first by hash.
CALIBRATION_ROWS = 20_000
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?,;:")] = True


def text_view(chunk) -> np.ndarray:
    """Features of each row of a chunk, all within 0..1."""
    n_words, chars, symbols, n_lines, n_dup, n_repeat = (x.astype(float) for x in _chunk_stats(chunk))
    w = words(chunk, VISIBLE, lower=True)
    h = hashed(chunk, w)
    total = np.maximum(n_words, 1)
    size = np.maximum(np.diff(chunk.offs), 1)
    order = np.lexsort((h, w.row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.row[order][1:] != w.row[order][:-1])
    distinct = np.bincount(w.row[order][new], minlength=chunk.n)
    runs = np.zeros(len(h), bool)
    runs[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    share = np.zeros((chunk.n, BUCKETS))
    np.add.at(share, (w.row, (h % U(BUCKETS)).astype(np.int64)), 1)
    long = np.bincount(w.row[(w.end - w.start) > 14], minlength=chunk.n)
    stats = [
        np.minimum(1, np.log1p(n_words) / 12), np.minimum(1, symbols / total / 4), n_dup / np.maximum(n_lines, 1), n_repeat / total,
        np.minimum(1, chars / total / 32), distinct / total, row_sums(runs, w.first) / total, row_sums(_UPPER[chunk.buf], chunk.offs) / size,
        row_sums(_DIGIT[chunk.buf], chunk.offs) / size, row_sums(_STOP[chunk.buf], chunk.offs) / size, long / total,
        (symbols > 0).astype(float), (n_words < 50).astype(float), np.minimum(1, n_lines / total * 5), np.minimum(1, row_sums(chunk.buf == ord("|"), chunk.offs) / total),
    ]
    return np.column_stack([*stats, share / total[:, None]])


def _one_hot(column: str, n: int):
    at = F.when(F.col(column).isNull(), F.lit(n)).otherwise(F.pmod(F.xxhash64(column), F.lit(n)))
    return [F.when(at == i, 1.0).otherwise(0.0) for i in range(n + 1)]


def views(docs: DataFrame) -> DataFrame:
    """doc_id, row number and the feature arrays of both views, for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    meta = F.array(
        F.least(F.lit(1.0), F.log1p(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)).cast("double")) / 14), F.when(F.col("n_chars").isNull(), 1.0).otherwise(0.0),
        F.when(F.col("n_chars") < 400, 1.0).otherwise(0.0), *_one_hot("source", 24), *_one_hot("lang", 6),
    )
    have = [c for c in ("source", "lang", "n_chars") if c in docs.columns]
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *[docs[c] for c in have])
    for c, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long")):
        src = src.withColumn(c, src[c].cast(kind) if c in have else F.lit(None).cast(kind))
    src = src.select("doc_id", "text", meta.alias("meta"))

    def run(batches):
        for batch in batches:
            rows = [x for c in chunks(batch.column(1)) for x in text_view(c).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "meta", "content"])

    return src.mapInArrow(run, "doc_id long, meta array<double>, content array<double>")


def _fit(rows: DataFrame, view: str):
    """(weights, intercept) of a logistic regression, or None if a class is missing."""
    if rows.select("y").distinct().limit(2).count() < 2:
        return None
    data = rows.select(array_to_vector(view).alias("features"), F.col("y").cast("double").alias("label"))
    m = LogisticRegression(maxIter=40, regParam=1e-4, standardization=True).fit(data)
    return m.coefficients.toArray().tolist(), float(m.intercept)


def _margin(model, view: str):
    """The classifier's log-odds as one sum over the feature array; 0 without a model."""
    if model is None:
        return F.lit(0.0)
    weights, intercept = model
    return F.aggregate(F.zip_with(view, F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(intercept), lambda a, x: a + x)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method for a few columns (the last one constant), with a slight pull to zero."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(b)), x.T @ (y - p) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def classify(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE, reject_below: float = 0.3) -> DataFrame:
    """doc_id, content_score, meta_score, score and accepted of every row of ``docs``.

    score: probability of label 1; accepted if it is at least ``reject_below``.
    labels: doc_id, quality (0/1; null left out; repeated labels count as bad
    if one does). A fifth of the labelled documents, by checksum of the id,
    calibrates and is learned from in no round. Null text is empty; a missing or
    null source, language or length is a value of its own. Without labels of
    both kinds every score is 0.5. Repeated rows are scored each.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    rows = stored(views(docs).join(known, "doc_id", "left"), "quality-views")
    aside = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    taught, pool = rows.where(F.col("y").isNotNull() & ~aside), rows.where("y IS NULL")
    models = {v: _fit(taught, v) for v in ("content", "meta")}
    for _ in range(rounds):
        told = {}
        for v, other in (("content", "meta"), ("meta", "content")):
            p = 1 / (1 + F.exp(-_margin(models[other], other)))
            if models[other] is None:
                told[v] = taught
                continue
            given = pool.withColumn("y", F.when(p >= sure, 1).when(p <= 1 - sure, 0)).where("y IS NOT NULL")
            told[v] = taught.unionByName(given)
        models = {v: _fit(told[v], v) for v in models}
    margins = rows.select("doc_id", "y", _margin(models["content"], "content").alias("a"), _margin(models["meta"], "meta").alias("b"))
    margins = stored(margins, "quality-margins")
    held = margins.where(F.col("y").isNotNull() & aside).orderBy(F.xxhash64("doc_id"), "a", "b").limit(CALIBRATION_ROWS).toPandas()
    y = held.y.to_numpy(float)
    if len(y) and 0 < y.mean() < 1:
        one = np.ones(len(y))
        platt = {v: _logistic(np.column_stack([held[v], one]), y) for v in ("a", "b")}
        both = _logistic(np.column_stack([*(np.column_stack([held[v], one]) @ platt[v] for v in ("a", "b")), one]), y)
    else:
        platt = {v: np.array([1.0, 0.0]) for v in ("a", "b")}
        both = np.array([1.0, 0.0, 0.0])
    logit = {v: F.col(v) * float(platt[v][0]) + float(platt[v][1]) for v in ("a", "b")}
    total = logit["a"] * float(both[0]) + logit["b"] * float(both[1]) + float(both[2])
    prob = lambda x: 1 / (1 + F.exp(-x))
    return margins.select("doc_id", prob(logit["a"]).alias("content_score"), prob(logit["b"]).alias("meta_score"), prob(total).alias("score")).withColumn("accepted", F.col("score") >= reject_below)
