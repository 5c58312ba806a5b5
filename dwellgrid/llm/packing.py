"""Packing token sequences into windows of fixed size, best fit decreasing.

Every document is tokenised whole and cut into full windows; what is left over
is shorter than a window and is packed: pieces in order of falling length, each
into the open window that it fills best. A segment tree over remaining
capacities finds that window in a few steps. Only (row, start, length) of the
left-over pieces is shuffled, dealt by hash into groups of bounded size, each
packed by one task; a group leaves at most its last windows unfilled.
"""

from __future__ import annotations

import base64
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.store import stored
from dwellgrid.llm.text import bounded_batches

#: Left-over pieces packed together by one task.
GROUP_PIECES = 50_000
_PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


class Tokens:
    """Ids of the public byte-level tokenizer, made once per worker.

    The ranks file holds the same vocabulary and is read by a faster library; a
    text that holds a special token's string goes through the JSON file itself.
    """

    def __init__(self, name: str = "byte_bpe_50k", end: int = 1):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.end = end

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if any(s in text for s in self.special):
            ids = self.plain.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_to_numpy(text)
        return np.append(np.asarray(ids, "<u4"), np.uint32(self.end)).astype("<u4")


_made: dict[tuple, Tokens] = {}


def tokens(name: str, end: int) -> Tokens:
    if (name, end) not in _made:
        _made[name, end] = Tokens(name, end)
    return _made[name, end]


def cut_pieces(docs: DataFrame, window: int, tokenizer: str, end: int, with_ids: bool, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of at most ``window`` tokens; full windows first, the rest last.

    ``source_row`` tells rows of equal ids apart.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(docs[id_column].alias("doc_id"), docs[text].alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_PIECES}" + (", ids array<int>" if with_ids else "")

    def run(batches):
        encode = tokens(tokenizer, end)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    all_ids = encode(text)
                    for start in range(0, len(all_ids), window):
                        piece = all_ids[start : start + window]
                        rows.append(i)
                        starts.append(start)
                        lengths.append(len(piece))
                        crcs.append(zlib.crc32(piece))
                        totals.append(len(all_ids))
                        if with_ids:
                            ids.append(piece.astype(np.int32))
                cols = [part.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return src.mapInArrow(run, schema)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree tells which capacities have one."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window of the smallest capacity of at least ``need``, and that capacity."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.stacks[capacity].pop(), capacity


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every piece; ``lengths`` in falling order, each at most ``size``."""
    tree, made = OpenWindows(size), 0
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        found = tree.take(need)
        if found is None:
            found, made = (made, size), made + 1
        at, capacity = found
        window[i], offset[i] = at, size - capacity
        if capacity > need:
            tree.put(capacity - need, at)
    return window, offset


def pack(docs: DataFrame, window: int = 2048, tokenizer: str = "byte_bpe_50k", end: int = 1, with_ids: bool = True, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents with the sequence and the place where each lies.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, ids (if asked for),
    sequence_id, offset. Null text is empty and is one piece that holds the end
    token alone. Repeated rows are packed each. No documents give no rows.
    Sequences are filled from 0 without gaps, none beyond ``window``.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, window, tokenizer, end, with_ids), "pack-pieces")
    pieces = pieces.withColumn("piece", F.monotonically_increasing_id())  # over files that no longer change
    rest = pieces.where(F.col("length") < window)
    n = rest.count()
    groups = max(1, math.ceil(n / group_pieces))
    payload = [c for c in pieces.columns if c != "piece"]

    def run(key, pdf):
        pdf = pdf.sort_values(["length", "piece"], ascending=[False, True], ignore_index=True)
        at, offset = best_fit(pdf.length.to_numpy(), window)
        return pd.DataFrame({"piece": pdf.piece, "sequence_id": at * groups + key[0], "offset": offset})

    group = F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("group")
    small = rest.select("piece", "length", group) if with_ids else rest.select(*payload, "piece", group)
    if with_ids:
        places = small.groupBy("group").applyInPandas(run, "piece long, sequence_id long, offset long")
        packed = rest.join(places, "piece").select(*payload, "sequence_id", "offset")
    else:
        def whole(key, pdf):
            pdf = pdf.sort_values(["length", "piece"], ascending=[False, True], ignore_index=True)
            at, offset = best_fit(pdf.length.to_numpy(), window)
            return pdf[payload].assign(sequence_id=at * groups + key[0], offset=offset)

        packed = small.groupBy("group").applyInPandas(whole, spark_schema(pieces, payload))
    full = pieces.where(F.col("length") == window).select(*payload, (-1 - F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def spark_schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + ", sequence_id long, offset long"


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences themselves: sequence_id and its ids, from ``pack(..., with_ids=True)``."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(pieces, lambda x: x["ids"])).alias("ids"))
