"""SentencePiece ids of whole texts through a table of distinct chunks.

A text, with a marker for every space and one put before it, falls into chunks:
a run of markers and what follows up to the next run. In a model none of whose
pieces has a marker after another character, no merge reaches over a chunk's
edge, so a text's ids are its chunks' ids in order, and a chunk's ids are
always the same. Each distinct chunk is segmented once, and the ids are joined
back by position (``distinct``).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dwellgrid.llm.distinct import BLOCK_CHARS, by_distinct_parts

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    """A SentencePiece model whose pieces stay inside chunks."""

    def __init__(self, name: str = "piece_bpe_32k"):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        for piece in names:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} crosses a whitespace marker")
        for probe in (" a", "a  b", "a ", "Ａ́　x"):
            if self.model.normalize(probe) != MARK + probe.replace(" ", MARK):
                raise ValueError("the model's normaliser changes texts")
        self.end = self.model.eos_id()
        self.mark = [self.model.piece_to_id(MARK)]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks, given without their first marker (the model adds it)."""
        return [ids if chunk else self.mark for chunk, ids in zip(chunks, self.model.encode(chunks, num_threads=1))]


_made: dict[str, Pieces] = {}


def pieces(name: str) -> Pieces:
    if name not in _made:
        _made[name] = Pieces(name)
    return _made[name]


def chunked(text: str | None) -> list[str]:
    """The chunks of a text, each without its first marker; none of an empty text."""
    if not text:
        return []
    return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]


def encode(docs: DataFrame, model: str = "piece_bpe_32k", id_column: str = "doc_id", text: str = "text", decode: bool = True, shares: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Ids of every text, ending in the model's end id, and the text that they decode to.

    Columns: doc_id, ids, decoded (if asked for). One row per row of ``docs``,
    in no order; repeated rows and repeated or null ids stay as they are. A null
    text is empty: the end id alone, which decodes to an empty text. A text
    without spaces is one chunk, whatever its length. No documents give no
    rows. Only the id and the text are read, so other columns can't clash.
    Raises ``ValueError`` for a model that changes texts or whose pieces have a
    marker after another character: there the chunks' ids need not be the
    text's.
    """
    pieces(model)

    def answer(chunks: list[str]) -> list[np.ndarray]:
        return [np.array(ids, "<u4") for ids in pieces(model).segment(chunks)]

    def finish(found: list[np.ndarray]) -> list[pa.Array]:
        made = pieces(model)
        ids = [np.append(x.astype(np.int32), np.int32(made.end)) for x in found]
        out = [pa.array(ids, pa.list_(pa.int32()))]
        if decode:
            out.append(pa.array(made.model.decode([x.tolist() for x in ids], num_threads=1), pa.string()))
        return out

    columns = "ids array<int>" + (", decoded string" if decode else "")
    return by_distinct_parts(docs, id_column, text, chunked, answer, finish, columns, shares, block_chars)
