"""Benchmark decontamination as a prefix-filtered set join.

A window is ``size`` consecutive words of an item (a shorter item is one
window). Its tokens are its word shingles. A document that contains a window
has all of the window's shingles, so one of them is prefix enough: the rarest
over all documents. Documents are scanned for these prefix shingles alone;
where one is met, the place in the window tells where the window would begin
(position), the document must be long enough for it there (length), the hash of
the whole window must agree, and then the words themselves.

The benchmark is cut into blocks of bounded size, each broadcast and held
against all documents; a larger benchmark takes more passes, not more memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.store import stored
from dwellgrid.llm.text import LETTERS, U, bounded_batches, chunks, hashed, mix, only, words

SHINGLE = 5
#: Windows that one pass over the documents looks for.
BLOCK_WINDOWS = 200_000
_WINDOW = "item_id string, at int, size int, gram int, shingles array<long>, whole long, words string"


def item_windows(benchmark: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows per item: shingle hashes in order, hash and words of the whole window."""
    src = benchmark.select(benchmark[item_id].cast("string").alias("item_id"), benchmark[text].alias("text")).where(F.col("item_id").isNotNull())

    def run(batches):
        for batch in batches:
            rows = []
            for c in chunks(batch.column(1)):
                w = words(c, LETTERS, lower=True)
                h = hashed(c, w)
                for r in range(c.n):
                    lo, hi = int(w.first[r]), int(w.first[r + 1])
                    span = min(size, hi - lo)
                    if not span:
                        continue
                    gram = min(SHINGLE, span)
                    own = type(w)(w.start[lo:hi], w.end[lo:hi], w.row[lo:hi], w.first, w.buf)
                    g, _ = own.grams(h[lo:hi], gram)
                    whole, _ = own.grams(h[lo:hi], span)
                    for k in range(len(whole)):
                        said = b" ".join(w.buf[s:e].tobytes() for s, e in zip(w.start[lo + k : lo + k + span], w.end[lo + k : lo + k + span]))
                        rows.append((batch.column(0)[c.first + r].as_py(), k, span, gram, g[k : k + span - gram + 1].astype(np.int64).tolist(), int(whole[k : k + 1].view(np.int64)[0]), said.decode()))
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "at", "size", "gram", "shingles", "whole", "words"), x)) for x in rows], schema=_ARROW)

    return src.mapInArrow(run, _WINDOW)


_ARROW = pa.schema([("item_id", pa.string()), ("at", pa.int32()), ("size", pa.int32()), ("gram", pa.int32()), ("shingles", pa.list_(pa.int64())), ("whole", pa.int64()), ("words", pa.string())])


class Lookup:
    """A fixed set of 64-bit values: a bit table turns most others away, a sorted array finds the rest."""

    BITS = 22

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(np.int64).view(U))
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[(self.values & U((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that hold a value, and which value."""
        at = np.flatnonzero(self.bits[(h & U((1 << self.BITS) - 1)).astype(np.int64)])
        if not len(self.values) or not len(at):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        good = self.values[k] == h[at]
        return at[good], k[good]


def shingle_counts(docs: DataFrame, text: str, wanted: dict[int, np.ndarray]) -> DataFrame:
    """(gram, shingle, n): how often each wanted shingle occurs in all documents."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast({g: Lookup(v) for g, v in wanted.items()})

    def run(batches):
        total = {g: np.zeros(len(x.values), np.int64) for g, x in sent.value.items()}
        for batch in batches:
            for c in chunks(batch.column(0)):
                w = words(c, LETTERS, lower=True)
                h = hashed(c, w)
                for g, look in sent.value.items():
                    np.add.at(total[g], look.find(w.grams(h, g)[0])[1], 1)
        for g, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g, np.int32)), pa.array(sent.value[g].values[some].view(np.int64)), pa.array(n[some])], names=["gram", "shingle", "n"])

    return only(docs, text).mapInArrow(run, "gram int, shingle long, n long").groupBy("gram", "shingle").agg(F.sum("n").alias("n"))


class Block:
    """The windows of one pass, by their prefix shingle."""

    def __init__(self, rows):
        self.rows = rows
        self.by: dict[int, dict] = {}
        for gram in {r["gram"] for r in rows}:
            own = [i for i, r in enumerate(rows) if r["gram"] == gram]
            look = Lookup(np.array([rows[i]["prefix"] for i in own]))
            where = np.searchsorted(look.values, np.array([rows[i]["prefix"] for i in own]).view(U))
            order = np.argsort(where, kind="stable")
            self.by[gram] = {
                "look": look, "window": np.array(own)[order], "first": np.searchsorted(where[order], np.arange(len(look.values) + 1)),
            }
        self.place = np.array([r["place"] for r in rows], np.int64)
        self.size = np.array([r["size"] for r in rows], np.int64)
        self.whole = np.array([r["whole"] for r in rows], np.int64).view(U)

    def matches(self, w, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every verified occurrence in a chunk."""
        starts, wins = [], []
        sums: dict[int, np.ndarray] = {}
        for gram, x in self.by.items():
            g, at = w.grams(h, gram)
            place, k = x["look"].find(g)
            n = x["first"][k + 1] - x["first"][k]
            rep = np.repeat(np.arange(len(k)), n)
            win = x["window"][x["first"][k][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)]
            start = at[place][rep] - self.place[win]
            row = w.row[at[place][rep]]
            fits = (start >= w.first[row]) & (start + self.size[win] <= w.first[row + 1])
            starts.append(start[fits])
            wins.append(win[fits])
        start, win = np.concatenate(starts), np.concatenate(wins)
        good = np.zeros(len(start), bool)
        for size in np.unique(self.size[win]):
            if size not in sums:
                g, at = w.grams(h, int(size))
                sums[size] = np.zeros(len(h) + 1, U)
                sums[size][at] = g
            own = self.size[win] == size
            good |= own & (sums[size][start] == self.whole[win])
        start, win = start[good], win[good]
        same = np.zeros(len(start), bool)
        for i, (s, k) in enumerate(zip(start.tolist(), win.tolist())):
            size = int(self.size[k])
            said = w.buf[w.start[s] : w.end[s + size - 1]]
            if len(said) == len(self.rows[k]["bytes"]) and said.tobytes() == self.rows[k]["bytes"]:
                same[i] = True
            else:
                same[i] = b" ".join(w.buf[a:b].tobytes() for a, b in zip(w.start[s : s + size], w.end[s : s + size])) == self.rows[k]["bytes"]
        return start[same], win[same]


def _blocks(windows: DataFrame, size: int):
    """Lists of at most ``size`` windows, one at a time on the driver."""
    part = []
    for row in windows.toLocalIterator(prefetchPartitions=False):
        part.append(row.asDict() | {"bytes": row["words"].encode()})
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with what they share with the benchmark.

    Adds n_words, hits (array of [first word, end) spans, merged, in order) and
    items (sorted ids of the items that have a window in the text). Words are
    runs of digits, a-z (after lower-casing A-Z) and characters beyond ASCII.
    Null or empty text, no documents, no items: no hits. Items with a null id
    are left out; equal ids count as one item. Repeated documents are judged
    each. A column of ``docs`` that has one of the new names is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    new = ("n_words", "hits", "items")
    docs = docs.drop(*[c for c in docs.columns if c in new])
    windows = stored(item_windows(benchmark, size), "bench-windows")
    distinct = windows.groupBy("gram", "shingles", "size", "whole", "words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    distinct = stored(distinct, "bench-distinct")
    shingles = distinct.select("gram", F.explode("shingles").alias("shingle")).distinct()
    counts = None
    for part in _counted_parts(shingles, block_windows * SHINGLE):
        found = shingle_counts(docs, text, part)
        counts = found if counts is None else counts.unionByName(found)
    tokens = distinct.select("*", F.posexplode("shingles").alias("place", "prefix"))
    if counts is not None:
        counts = stored(counts, "bench-counts")
        tokens = tokens.join(counts.withColumnRenamed("shingle", "prefix"), ["gram", "prefix"], "left")
    else:
        tokens = tokens.withColumn("n", F.lit(0).cast("long"))
    # absent from all documents means that no document has the window
    rarest = (
        tokens.groupBy("gram", "size", "whole", "words", "item_ids")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "prefix")).alias("x"))
        .where("x.n > 0").select("gram", "size", "whole", "words", "item_ids", "x.place", "x.prefix").orderBy("prefix", "whole", "words")
    )
    rarest = stored(rarest, "bench-prefixes")
    out = docs.withColumn("n_words", F.lit(None).cast("long")).withColumn("hits", F.array().cast("array<struct<first:long,end:long>>")).withColumn("items", F.array().cast("array<string>"))
    passes = 0
    for part in _blocks(rarest, block_windows):
        if passes:
            out = stored(out, "bench-pass")
        out, passes = _scan(out, text, Block(part)), passes + 1
    return out if passes else _scan(out, text, None)


def _counted_parts(shingles: DataFrame, size: int):
    part: dict[int, list[int]] = {}
    n = 0
    for row in shingles.toLocalIterator(prefetchPartitions=False):
        part.setdefault(row["gram"], []).append(row["shingle"])
        n += 1
        if n >= size:
            yield {g: np.array(v) for g, v in part.items()}
            part, n = {}, 0
    if n:
        yield {g: np.array(v) for g, v in part.items()}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(docs: DataFrame, text: str, block: Block | None) -> DataFrame:
    """One pass: spans and items of a block of windows are added to those of earlier passes."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    at = [docs.columns.index(c) for c in (text, "n_words", "hits", "items")]
    names = docs.columns

    def run(batches):
        block = sent.value
        for batch in batches:
            n_words, hits, items = [], batch.column(at[2]).to_pylist(), batch.column(at[3]).to_pylist()
            for c in chunks(batch.column(at[0])):
                w = words(c, LETTERS, lower=True)
                n_words.extend(w.counts().tolist())
                if block is None:
                    continue
                start, win = block.matches(w, hashed(c, w))
                found: dict[int, tuple[list, set]] = {}
                for s, k in zip(start.tolist(), win.tolist()):
                    row = int(w.row[s])
                    spans, ids = found.setdefault(row, ([], set()))
                    first = s - int(w.first[row])
                    spans.append((first, first + int(block.size[k])))
                    ids.update(block.rows[k]["item_ids"])
                for row, (spans, ids) in found.items():
                    i = c.first + row
                    hits[i] = [{"first": a, "end": b} for a, b in _merged(spans + [(x["first"], x["end"]) for x in hits[i]])]
                    items[i] = sorted(ids | set(items[i]))
            new = {at[1]: pa.array(n_words, pa.int64()), at[2]: pa.array(hits, batch.schema.field(at[2]).type), at[3]: pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(i, x) for i, x in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)
