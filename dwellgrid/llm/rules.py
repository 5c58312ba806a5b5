"""Quality rules with risk-controlled cutoffs.

A rule rejects a document whose measure lies above a cutoff. Labelled documents
are the holdout, in two halves: one lays out a path of joint sets of cutoffs for
all rules of a stratum, each rejecting more than the one before, the other
tests them in this order. The number of good documents that a set would reject
is binomial, and it is valid only if the exact (Clopper-Pearson) upper bound of
its false-rejection rate is within the stratum's allowance and so are all sets
before it. The error probability is shared out over the strata (Bonferroni), so
all bounds hold together. Among valid sets the one that rejects most bad
documents net of good ones is used; where none is valid, or none pays, the
rules stay silent in that stratum.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.store import stored
from dwellgrid.llm.text import VISIBLE, bounded_batches, chunks, hashed, only, row_sums, words

SYMBOLS = b"#*$%&|<>"
MEASURES = ["symbol_share", "dup_line_share", "repeat_share", "mean_word", "short_word"]
STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Cutoffs lie on this many steps of each measure, and a path has this many sets besides the first.
STEPS, PATH = 1024, 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _again(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur again in their row, and which have occurred before."""
    order = np.lexsort((np.arange(len(h)), h, row))
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    many, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    many[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return many, later


def _chunk_stats(chunk) -> list[np.ndarray]:
    w = words(chunk, VISIBLE, lower=False)
    h = hashed(chunk, w)
    points = np.zeros(len(chunk.buf) + 1, np.int64)
    np.cumsum((chunk.buf & 0xC0) != 0x80, out=points[1:])
    word_chars = row_sums(points[w.end] - points[w.start], w.first)
    symbols = row_sums(_SYMBOL[chunk.buf], chunk.offs)
    # lines: those that hold a word are the lines that words begin in
    breaks = np.zeros(len(chunk.buf) + 1, np.int64)
    np.cumsum(chunk.buf == 10, out=breaks[1:])
    line_of = breaks[w.start]
    new = np.ones(len(line_of), bool)
    new[1:] = (line_of[1:] != line_of[:-1]) | (w.row[1:] != w.row[:-1])
    head = np.flatnonzero(new)
    row = w.row[head]
    stops = np.flatnonzero(chunk.buf == 10)
    before = np.searchsorted(stops, w.start[head]) - 1
    begin = np.maximum(np.where(before >= 0, stops[np.maximum(before, 0)] + 1 if len(stops) else 0, 0), chunk.offs[row])
    after = before + 1
    end = np.where(after < len(stops), stops[np.minimum(after, len(stops) - 1)] if len(stops) else 0, len(chunk.buf))
    end = np.minimum(end, chunk.offs[row + 1])
    line_hash = chunk.spans(begin, end)
    _, later = _again(line_hash, row)
    n_lines = np.bincount(row, minlength=chunk.n)
    n_dup = np.bincount(row[later], minlength=chunk.n)
    # words covered by a 3-word window that the text has twice
    g, at = w.grams(h, 3)
    many, _ = _again(g, w.row[at])
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at[many] + k] = True
    return [w.counts(), word_chars, symbols, n_lines, n_dup, row_sums(covered, w.first)]


def text_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of words, word characters, symbols, repeated lines and repeated 3-word windows of whole texts.

    One row per row of ``docs``: the columns ``keep`` and the counts. Null text
    has no words. Other columns of ``docs`` aren't read.
    """
    bounded_batches(docs.sparkSession)
    src = only(docs, *keep, text)
    fields = [f.simpleString().replace(":", " ", 1) for f in src.schema.fields if f.name in keep]
    names = [c.split()[0] for c in STATS.split(", ")]

    def run(batches):
        for batch in batches:
            parts = [_chunk_stats(c) for c in chunks(batch.column(len(keep)))]
            if parts:
                cols = [np.concatenate(x).astype(np.int64) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, cols)], names=[*keep, *names])

    return src.mapInArrow(run, ", ".join([*fields, STATS]))


def measures(stats: DataFrame) -> DataFrame:
    """Add the rules' measures, each scaled to 0..1; a text without words has 0."""
    words_ = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words_
    return (
        stats.withColumn("symbol_share", F.least(F.lit(1.0), F.col("n_symbols") / words_ / 4))
        .withColumn("dup_line_share", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))
        .withColumn("repeat_share", F.col("n_repeat_words") / words_)
        .withColumn("mean_word", F.least(F.lit(1.0), mean / 32))
        .withColumn("short_word", F.when(F.col("n_words") > 0, F.greatest(F.lit(0.0), 1 - mean / 16)).otherwise(0.0))
    )


def tail_probability(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial of n trials with probability p."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def within_risk(k: int, n: int, allowed: float, error: float) -> bool:
    """Is the exact upper bound (confidence 1 - error) of a rate seen k times in n at most ``allowed``?"""
    return n > 0 and tail_probability(k, n, allowed) <= error


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, rules: list[str], allowed: float, error: float, price: float) -> DataFrame:
    """(stratum, rule, cutoff, good_rejected, bad_rejected) of the strata where rejecting is safe and pays.

    ``measured``: doc_id, stratum and the measures, one row per document;
    ``labels``: doc_id, quality. One half of the labels finds each rule's best
    cutoff, by documents won and lost within ``allowed``; a rule that wins none
    stays out. All rules of a stratum go along one path to these: at step i a
    rule rejects at most i / PATH of the good ones that its best cutoff does,
    so every step rejects all that the one before does. The other half tests
    the steps in this order, and the first whose bound isn't low enough ends
    the path: fixed-sequence testing, which needs no share of the
    error for a step or a rule, and gives all rules together the whole
    ``allowed``. ``error`` is shared over strata. Of the steps that hold the
    best by documents won and lost is taken. Half of a stratum's good labels
    must number log(error / strata) / log(1 - allowed) at least (217 for four
    strata as they are by default). Only counts per stratum, rule and step
    leave the tasks.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bins = F.array(*[F.least(F.lit(STEPS - 1), F.floor(F.col(r) * STEPS)).cast("int") for r in rules])
    half = (F.crc32(F.col("doc_id").cast("string")) % 2).cast("int")
    seen = stored(measured.join(known, "doc_id").select(F.col(stratum).alias("stratum"), (F.col("quality") == 1).alias("good"), half.alias("half"), bins.alias("bins")), "rule-labelled")
    reached = (
        seen.where("half = 0").select("stratum", "good", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )

    def steps(pdf):
        pdf = pdf.sort_values("bin", ascending=False)
        good, bad, bins = pdf.good.cumsum().to_numpy(), pdf.bad.cumsum().to_numpy(), pdf.bin.to_numpy()
        gain = np.where(good <= allowed * good[-1], bad - price * good, -np.inf)
        best = int(gain.argmax())  # of equals the highest cutoff
        edges = [STEPS] * (PATH + 1)
        if gain[best] > 0:
            within = [np.flatnonzero(good[: best + 1] <= good[best] * i / PATH) for i in range(PATH + 1)]
            edges = [int(bins[w[-1]]) if len(w) else int(bins[0]) + 1 for w in within]
        return pdf.head(1)[["stratum", "rule"]].assign(edges=[edges])

    paths = reached.groupBy("stratum", "rule").applyInPandas(steps, "stratum string, rule int, edges array<int>")
    paths = stored(paths.groupBy("stratum").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "edges"))), lambda x: x["edges"]).alias("paths")), "rule-paths")
    # the first step at which any rule rejects a document: as many as have their cutoff above it
    first = F.array_min(F.zip_with("bins", "paths", lambda b, edges: F.size(F.filter(edges, lambda e: e > b))))
    counts = (
        seen.join(paths, "stratum").select("stratum", "half", "good", first.alias("step")).groupBy("stratum", "half", "step")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    counts = stored(counts, "rule-counts")
    share = error / max(1, counts.select("stratum").distinct().count())

    def choose(pdf):
        held, best = pdf[pdf.half == 1], None
        n = int(held.good.sum())
        for i in range(PATH + 1):
            if not within_risk(int(held.good[held.step <= i].sum()), n, allowed, share):
                break
            out = pdf[pdf.step <= i]
            g, b = int(out.good.sum()), int(out.bad.sum())
            gain = b - price * g
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, i, g, b)
        out = pdf.head(1 if best else 0)[["stratum"]]
        return out.assign(step=best[1] if best else 0, good_rejected=best[2] if best else 0, bad_rejected=best[3] if best else 0)

    chosen = counts.groupBy("stratum").applyInPandas(choose, "stratum string, step int, good_rejected long, bad_rejected long")
    out = chosen.join(paths, "stratum").select("stratum", "step", "good_rejected", "bad_rejected", F.posexplode("paths").alias("at", "edges"))
    out = out.withColumn("cutoff", F.get("edges", F.col("step")) / STEPS).where("cutoff < 1")
    return out.select("stratum", F.get(F.array(*map(F.lit, rules)), F.col("at")).alias("rule"), "cutoff", "good_rejected", "bad_rejected")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", allowed: float = 0.02, error: float = 0.05, price: float = 5.0) -> DataFrame:
    """Every document with its counts, the rules it breaks and the verdict.

    allowed: rate of good documents that pass the base and may be rejected in a
    stratum, all rules together; error: probability that any such bound is
    wrong; price: bad documents that one lost good one must buy. A null stratum is one of its own.
    base_failed: under 50 words, or more than half of the words in repeated
    3-word windows. kept is false if the base fails or a rule rejects.
    Repeated rows are judged each; repeated labels of a document count as bad
    if one does; no documents or no labels give no rules.
    """
    src = docs.select("doc_id", "text", F.coalesce(docs[stratum].cast("string"), F.lit("∅")).alias("stratum"))
    stats = stored(text_stats(src, keep=("doc_id", "stratum")), "rule-stats")
    measured = measures(stats)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    chosen = cutoffs(measured.where(~base), labels, "stratum", MEASURES, allowed, error, price)
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in MEASURES])
    wide = stored(wide, "rule-cutoffs")
    strata = wide.limit(100_001).count()
    out = measured.join(F.broadcast(wide) if strata <= 100_000 else wide, "stratum", "left")
    broken = F.filter(F.array(*[F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in MEASURES]), lambda x: x.isNotNull())
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        broken.alias("broken_rules"), (~base & (F.size(broken) == 0)).alias("kept"), F.col("stratum"),
    )
