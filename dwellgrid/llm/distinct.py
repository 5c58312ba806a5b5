"""Texts through a table of their distinct parts: each part is worked on once.

For work on a text that falls apart into the same work on its parts:

1. Documents are read in blocks of some megabytes. A block becomes one row: its
   documents as numbers of parts, and the distinct parts themselves, dealt by
   hash into shares.
2. A share goes to one task, which answers each distinct part once and all
   blocks in turn; it holds its share of the vocabulary, never a whole column.
3. The answers, arrays of numbers, meet the documents again by block, in a
   bucketed table, and are joined by position.

A block, not a document or a part, is the unit of every shuffle: a part that all
documents hold is one entry of each block, and copies cost what any other
document costs.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.store import new_folder
from dwellgrid.llm.text import bounded_batches

#: Characters of text that one block holds, at least one document.
BLOCK_CHARS = 16 << 20
#: Part numbers that are turned into answers at once, and documents.
STEP, STEP_DOCS = 1 << 19, 1000


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.astype("<u4").tobytes() for a in arrays))


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4")


def _planes(codes: np.ndarray) -> bytes:
    """Numbers by their bytes, the lowest first: high bytes compress well."""
    by = np.ascontiguousarray(codes.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(by).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    by = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(by.T).view("<u4").ravel()


class Block:
    """Documents as numbers of their distinct parts."""

    def __init__(self):
        self.ids, self.codes, self.counts, self.number, self.chars = [], [], [], {}, 0

    def add(self, doc_id, parts: list[str], chars: int) -> None:
        number = self.number
        codes = np.array([number.setdefault(p, len(number)) for p in parts], np.uint32)
        self.ids.append(doc_id)
        self.codes.append(codes)
        self.counts.append(len(codes))
        self.chars += chars

    def row(self, shares: int) -> tuple:
        """(ids, counts, codes, shares' numbers, shares' parts); codes follow (share, part)."""
        share = {p: zlib.crc32(p.encode()) % shares for p in self.number}
        order = sorted(self.number, key=lambda p: (share[p], p))
        new = np.empty(len(order), np.uint32)
        new[[self.number[p] for p in order]] = np.arange(len(order), dtype=np.uint32)
        held: dict[int, list[str]] = {}
        for p in order:
            held.setdefault(share[p], []).append(p)
        pack = zstandard.ZstdCompressor(level=3)
        said = [pack.compress(json.dumps(v, ensure_ascii=False).encode()) for v in held.values()]
        return self.ids, _pack(np.array(self.counts)), _planes(new[np.concatenate(self.codes)]), list(held), said


def _blocks(docs: DataFrame, split: Callable[[str | None], list[str]], shares: int, block_chars: int) -> DataFrame:
    kind = docs.schema["id"].dataType
    schema = f"block long, ids array<{kind.simpleString()}>, counts binary, codes binary, shares array<int>, parts array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task, block = 0, TaskContext.get().partitionId(), Block()
        id_type = None

        def out(block):
            cols = [[v] for v in (task << 32 | made, *block.row(shares))]
            types = [pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types)], names=["block", "ids", "counts", "codes", "shares", "parts"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    block.add(doc_id, split(text), len(text or ""))
                    if block.chars >= block_chars:
                        yield out(block)
                        block, made = Block(), made + 1
        if block.ids:
            yield out(block)

    return docs.mapInArrow(run, schema)


def _answered(asked: DataFrame, answer: Callable[[list[str]], list[np.ndarray]]) -> DataFrame:
    """(block, share, parts) to (block, share, packed counts, packed answers); a share lies in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for batch in batches:
            counts, said = [], []
            for data in batch.column(2).to_pylist():
                parts = json.loads(zstandard.ZstdDecompressor().decompress(data))
                new = [p for p in parts if p not in known]
                for at in range(0, len(new), 10_000):
                    some = new[at : at + 10_000]
                    known.update(zip(some, [a.astype("<u4").tobytes() for a in answer(some)]))
                found = [known[p] for p in parts]
                counts.append(_pack(np.fromiter(map(len, found), np.uint32, len(found)) // 4))
                said.append(zstandard.ZstdCompressor(level=3).compress(b"".join(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary()), pa.array(said, pa.binary())], names=["block", "share", "n", "said"])

    return asked.mapInArrow(run, "block long, share int, n binary, said binary")


def _joined(rows: DataFrame, schema: str, finish: Callable[[list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """Answers of every document of a block, from its numbers and the answers of its shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                doc_ids = one.column(0).flatten()
                n_parts = _unpack(one.column(1)[0].as_py()).astype(np.int64)
                codes = _from_planes(one.column(2)[0].as_py())
                answers = sorted(one.column(3)[0].as_py() or [], key=lambda a: a["share"])
                n = np.concatenate([_unpack(a["n"]) for a in answers] or [np.zeros(0, "<u4")]).astype(np.int64)
                flat = np.concatenate([_unpack(a["said"]) for a in answers] or [np.zeros(0, "<u4")])
                if len(n) != (codes.max() + 1 if len(codes) else 0) or len(flat) != n.sum():
                    raise ValueError("a block's parts were not answered")
                first, edges = np.cumsum(n) - n, np.concatenate([[0], np.cumsum(n_parts)])
                at = 0
                while at < len(n_parts):
                    to = min(max(at + 1, int(np.searchsorted(edges, edges[at] + STEP, "right")) - 1), at + STEP_DOCS)
                    made = []
                    for d in range(at, to):
                        c = codes[edges[d] : edges[d + 1]]
                        m = n[c]
                        if len(m) and not m.min():
                            made.append(flat[:0])
                            continue
                        ends = np.cumsum(m)
                        made.append(flat[np.arange(ends[-1] if len(m) else 0) + np.repeat(first[c] - (ends - m), m)])
                    cols = [doc_ids.slice(at, to - at), *finish(made)]
                    yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])
                    at = to

    return rows.mapInArrow(run, schema)


def by_distinct_parts(docs: DataFrame, id_column: str, text: str, split, answer, finish, columns: str, shares: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ``columns`` of every row.

    ``split(text)``: the parts; ``answer(parts)``: an array of numbers for each;
    ``finish(arrays)``: the columns of some documents from their parts' answers
    in order. A document with an empty answer gets no numbers at all.
    ``shares``: into how many the parts are dealt, four times the number of
    shuffle partitions if not given."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(docs[id_column].alias("id"), docs[text].alias("text"))
    table = f"distinct_{uuid.uuid4().hex}"
    # by block in buckets, so that the numbers are not shuffled when the answers come
    made = _blocks(src, split, shares or 4 * shuffles, block_chars)
    made.write.format("parquet").option("compression", "zstd").option("path", new_folder(spark, "distinct")).bucketBy(shuffles, "block").saveAsTable(table)
    blocks = spark.table(table)
    asked = blocks.select("block", F.explode(F.arrays_zip("shares", "parts")).alias("q")).select("block", F.col("q.shares").alias("share"), F.col("q.parts").alias("parts"))
    answers = _answered(asked.repartition(shuffles, "share"), answer)
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("share", "n", "said")).alias("answers"))
    rows = blocks.select("block", "ids", "counts", "codes").join(answers.hint("merge"), "block", "left")
    return _joined(rows.select("ids", "counts", "codes", "answers"), f"doc_id {src.schema['id'].dataType.simpleString()}, {columns}", finish)
