"""Whole columns of text as arrays: words, their hashes and word windows.

An Arrow batch of strings is one buffer of UTF-8 bytes. The word rules used
here only name ASCII characters as separators, and a byte of 0x80 or more never
is a part of an ASCII character, so words are found on bytes, for all rows of a
chunk at once. Hashes are 64-bit: a polynomial of random byte codes with an odd
base, taken from prefix sums, then mixed; the same word has the same hash in
every batch, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 2 << 20
U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=U)


def _table(members) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


#: `[^\x20\x09-\x0D]+`: everything but ASCII white space.
VISIBLE = ~_table([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and all beyond ASCII.
LETTERS = ~_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    """Powers of the base (or of its inverse), kept for the life of the worker."""
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        steps = np.full(max(n, CHUNK_BYTES + 1), base, U)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h *= U(0x81DADEF4BC2DD44D)
    h ^= h >> U(33)
    return h


def seeded(*values: int) -> int:
    """One 64-bit constant from a few integers."""
    h = 0x243F6A8885A308D3
    for v in values:
        h = int(mix(np.array([(h * 0x100000001B3 ^ v) & _MASK], U))[0])
    return h


@dataclass
class Chunk:
    """Rows ``first`` .. ``first + n`` of a batch, as one buffer of bytes."""

    first: int
    buf: np.ndarray  # uint8
    offs: np.ndarray  # int64, n + 1 ends of rows in buf
    sums: dict | None = None  # prefix sums by buffer

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def spans(self, h_from: np.ndarray, h_to: np.ndarray, buf: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the byte spans [from, to)."""
        buf = self.buf if buf is None else buf
        self.sums = self.sums or {}
        if id(buf) not in self.sums:
            sums = np.zeros(len(buf) + 1, U)
            np.cumsum(_CODES[buf] * _power(len(buf), False), out=sums[1:])
            self.sums[id(buf)] = (sums, buf)  # the buffer too, so that its id stays its own
        sums = self.sums[id(buf)][0]
        h = (sums[h_to] - sums[h_from]) * _power(len(buf) + 1, True)[h_from]
        return mix(h + (h_to - h_from).astype(U) * U(0xD6E8FEB86659FD93))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column into runs of whole rows of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield Chunk(at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


@dataclass
class Words:
    start: np.ndarray  # byte where each word begins
    end: np.ndarray
    row: np.ndarray  # row of the chunk
    first: np.ndarray  # n + 1: where each row's words begin
    buf: np.ndarray  # the bytes, lower-cased if asked for

    def grams(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every window of ``n`` words inside one row, and where it begins."""
        m = len(h) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        g = np.full(m, seeded(n), U)
        for k in range(n):
            g = (g ^ h[k : k + m]) * U(0x9FB21C651E98DF25)
            g ^= g >> U(32)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 : n - 1 + m])
        return mix(g[at]), at

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(chunk: Chunk, kind: np.ndarray, lower: bool) -> Words:
    """All words of a chunk."""
    buf = _LOWER[chunk.buf] if lower else chunk.buf
    inside = kind[buf]
    size = len(buf)
    flow = np.zeros(size + 1, bool)  # does a word run on over the edge before byte i
    if size > 1:
        flow[1:size] = inside[1:] & inside[:-1]
    flow[chunk.offs] = False
    start = np.flatnonzero(inside & ~flow[:-1])
    end = np.flatnonzero(inside & ~flow[1:]) + 1
    row = np.searchsorted(chunk.offs, start, "right") - 1
    first = np.zeros(chunk.n + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=chunk.n), out=first[1:])
    return Words(start, end, row, first, buf)


def hashed(chunk: Chunk, w: Words) -> np.ndarray:
    return chunk.spans(w.start, w.end, w.buf)


def row_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive edges (edges may repeat)."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[edges[1:]] - sums[edges[:-1]]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough that very long texts don't add up in a worker."""
    for key, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", str(16 << 20))):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that other columns can't clash with ours."""
    return df.select(*[df[c] for c in columns])
