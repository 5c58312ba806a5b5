"""Aligning the tokens of two tokenizers over whole texts by their spans.

A is a byte-level tokenizer of the tokenizers library, B a SentencePiece model.
Each tells where in the text a token comes from, A in characters, B in bytes of
UTF-8 (its proto). Where such a span is as long as the token's own bytes, it is
a cut; where it isn't, since several tokens share one character, a byte stands
for itself, or white space was trimmed off, the decoded bytes say where the
token ends. Tokens between two neighbouring common ends are a group, and all A
and B tokens of a group are linked.

Texts are aligned in stretches that begin at a space after a visible character.
There A's words and B's pieces both begin anew, so both libraries give a
stretch the tokens that it has inside the whole text. Each distinct stretch is
aligned once (``distinct``).

How many documents hold a pair of ids linked is counted over all documents.
Pairs in so many documents that they could crowd one task are few and are
broadcast; all others are joined by shuffle.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.distinct import BLOCK_CHARS, by_distinct_parts
from dwellgrid.llm.pieces import MARK
from dwellgrid.llm.store import stored

#: Most pairs that are broadcast with their counts.
HEAD_PAIRS = 1 << 18
#: Larger groups are counted by distinct ids, not by tokens.
LARGE_GROUP = 4096
#: A token is kept as its id times four and what it is.
A_INNER, A_LAST, B_INNER, B_LAST = range(4)
_AFTER = (",", "|", ",", ";")
_CUT = re.compile(r"(?<=\S) (?=.)", re.S)


def byte_alphabet() -> dict[str, int]:
    """The characters in which byte-level vocabularies write bytes: visible Latin-1 as itself, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def token_ends(first: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte offsets where tokens end, from their spans and the lengths of their own bytes.

    A span as long as its token is a cut. A token without such a span ends its
    own bytes' length after the last one."""
    said = np.cumsum(sizes)
    cut = end - first == sizes
    last = np.maximum.accumulate(np.where(cut, np.arange(len(sizes)), -1))
    base = np.where(last >= 0, end[last] - said[last], 0)
    return said + base


def _edges(counts) -> np.ndarray:
    return np.cumsum(np.array([0, *counts], np.int64))


class Aligner:
    """Two tokenizers and what stretches of text gave."""

    def __init__(self, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(f"{a}.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path(f"{b}.model"))
        code = byte_alphabet()
        self.a_bytes = [bytes(code[c] for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.written = pa.array([f"{i}{after}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for after in _AFTER], pa.large_string())

    def _stretches(self, parts: list[str]) -> list[np.ndarray]:
        """Tokens of stretches, each a space and the part, in the order of their groups; none if the bytes differ.

        They are encoded as one text, so none but the last may end in white space."""
        texts = [f" {p}" for p in parts]
        text = "".join(texts)
        data = text.encode()
        a, b = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        a_ids, b_ids = np.array(a.ids), np.array([p.id for p in b])
        said = [b"".join(map(names.__getitem__, ids.tolist())) for names, ids in ((self.a_bytes, a_ids), (self.b_bytes, b_ids))]
        if said != [data, data]:
            if len(parts) == 1:
                return [np.zeros(0, "<u4")]
            half = len(parts) // 2  # few stretches differ: find them by halves
            return self._stretches(parts[:half]) + self._stretches(parts[half:])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        spans = byte[np.fromiter(itertools.chain.from_iterable(a.offsets), np.int64).reshape(-1, 2)]
        a_ends = token_ends(spans[:, 0], spans[:, 1], self.a_sizes[a_ids])
        # one byte on, for the space that the model puts before, which is its first token's
        first, end = np.array([p.begin for p in b]) + 1, np.array([p.end for p in b]) + 1
        first[0] = 0
        b_ends = token_ends(first, end, self.b_sizes[b_ids])
        edges = byte[_edges(map(len, texts))]
        a_edges, b_edges = (np.searchsorted(x, edges, "right") for x in (a_ends, b_ends))
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_last, b_last = np.isin(a_ends, both, assume_unique=True), np.isin(b_ends, both, assume_unique=True)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        # a token comes after all of earlier groups; A's before B's
        a_at = np.arange(len(a_ids)) + np.searchsorted(b_group, a_group)
        b_at = np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, "right")
        out = np.empty(len(a_ids) + len(b_ids), "<u4")
        out[a_at] = a_ids * 4 + np.where(a_last, A_LAST, A_INNER)
        out[b_at] = b_ids * 4 + np.where(b_last, B_LAST, B_INNER)
        return np.split(out, (a_edges + b_edges)[1:-1])

    def stretches(self, parts: list[str]) -> list[np.ndarray]:
        """The same of any stretches."""
        visible = [p for p in parts if not p[-1].isspace()]
        found = {}
        for some in [visible[at : at + 2000] for at in range(0, len(visible), 2000)] + [[p] for p in parts if p[-1].isspace()]:
            found.update(zip(some, self._stretches(some)))
        return [found[p] for p in parts]

    def columns(self, made: list[np.ndarray]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups and links of texts, from their tokens in the order of their groups."""
        flat = np.concatenate([np.zeros(0, np.int64), *made]).astype(np.int64)
        edges = _edges(map(len, made))
        kind, ids = flat & 3, flat >> 2
        row = np.repeat(np.arange(len(made)), np.diff(edges))
        is_a, last = kind < B_INNER, kind == B_LAST
        group = np.cumsum(last) - last
        n = int(last.sum())
        own, other = np.bincount(group[is_a], minlength=n), np.bincount(group[~is_a], minlength=n)
        group_row = row[last]
        times = own * other
        totals = [np.bincount(x, weights=w, minlength=len(made)).astype(np.int64) for x, w in ((row[is_a], None), (row[~is_a], None), (group_row, None), (group_row, times))]
        written = self.written.take(pa.array(flat))
        ends = np.frombuffer(written.buffers()[1], np.int64)[: len(flat) + 1][edges] if len(flat) else np.zeros(len(made) + 1, np.int64)
        data = written.buffers()[2].to_pybytes() if len(flat) else b""
        said = [data[x : max(x, y - 1)].decode() for x, y in zip(ends.tolist(), ends[1:].tolist())]  # not the last semicolon
        return [*map(pa.array, totals), pa.array(said, pa.string()), self._links(ids, is_a, group, group_row, own, other, len(made))]

    def _links(self, ids, is_a, group, group_row, own, other, rows: int) -> pa.Array:
        """Distinct pairs of ids of each row and how often they are linked."""
        large = np.flatnonzero(own * other > LARGE_GROUP)
        a_ids, b_ids, a_group = ids[is_a], ids[~is_a], group[is_a]
        a_first, b_first = _edges(own), _edges(other)
        repeat = other[a_group] * (~np.isin(a_group, large))
        at = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat) + np.repeat(b_first[a_group], repeat)
        keys, times = [np.repeat(group_row[a_group] << 40 | a_ids << 20, repeat) | b_ids[at]], [np.ones(len(at), np.int64)]
        for g in large.tolist():
            x, n = np.unique(a_ids[a_first[g] : a_first[g + 1]], return_counts=True)
            y, m = np.unique(b_ids[b_first[g] : b_first[g + 1]], return_counts=True)
            keys.append((group_row[g] << 40 | x[:, None] << 20 | y[None, :]).ravel())
            times.append((n[:, None] * m[None, :]).ravel())
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.add.reduceat(times, first) if len(first) else times
        keys = keys[first]
        low = (1 << 20) - 1
        links = pa.StructArray.from_arrays([pa.array((keys >> 20 & low).astype(np.int32)), pa.array((keys & low).astype(np.int32)), pa.array(times)], names=["a", "b", "n"])
        return pa.ListArray.from_arrays(pa.array(_edges(np.bincount(keys >> 40, minlength=rows)), pa.int32()), links)


def stretched(text: str | None) -> list[str]:
    """The stretches of a text, each without the space that it begins with."""
    return _CUT.split(text) if text else []


_made: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _made:
        _made[a, b] = Aligner(a, b)
    return _made[a, b]


def align(docs: DataFrame, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k", id_column: str = "doc_id", text: str = "text", shares: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Groups and links of every text, of a space and the text for A, of the text for B, which adds the space.

    Columns: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``:
    ids in order), links (each linked pair of ids, a, b, and n, how often it is
    linked). Strings of special tokens are ordinary text. A text that is null,
    empty or not what the tokens' bytes say (it holds U+2581) has no tokens:
    zeros, empty groups, no links. Rows stay one by one, repeated ones and null
    ids too. No documents give no rows; other columns are not read.
    """
    def finish(found: list[np.ndarray]) -> list[pa.Array]:
        # a few documents at a time: groups and links are many times a token
        parts = [aligner(a, b).columns(found[at : at + 50]) for at in range(0, len(found), 50)]
        return [pa.concat_arrays([p[k] for p in parts]) for k in range(6)]

    columns = "n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int,n:long>>"
    return by_distinct_parts(docs, id_column, text, stretched, lambda parts: aligner(a, b).stretches(parts), finish, columns, shares, block_chars)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked), best (no pair of this a has more)."""
    pairs = aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count("*").alias("count"))
    pairs = stored(pairs, "span-pairs")
    most = pairs.groupBy("a").agg(F.max("count").alias("most"))
    # at most one row per id of the first vocabulary
    return pairs.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def score(aligned: DataFrame, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``aligned`` without its links, with n_best (links whose pair has its a's highest count) and count_sum (over links)."""
    rows = stored(aligned.withColumn("row", F.monotonically_increasing_id()), "span-rows")
    pairs = stored(pair_counts(rows), "span-counts")
    size = F.floor(F.log2("count")).cast("int").alias("size")
    held, head = 0, 62
    for r in sorted(pairs.groupBy(size).agg(F.count("*").alias("pairs")).collect(), reverse=True):  # at most 64 rows
        held += r["pairs"]
        if held > head_pairs:
            break
        head = r["size"]
    often = pairs.where(F.col("count") >= 2**head).withColumnRenamed("count", "times")
    links = rows.select("row", F.explode("links").alias("l")).select("row", "l.a", "l.b", "l.n")
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    seen = links.join(F.broadcast(often), ["a", "b"], "left")
    known = seen.where("times IS NOT NULL").groupBy("row").agg(*sums)
    other = seen.where("times IS NULL").select("row", "a", "b", "n").join(pairs.withColumnRenamed("count", "times").hint("merge"), ["a", "b"]).groupBy("row").agg(*sums)
    both = known.unionByName(other).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("links").join(both, "row", "left").drop("row")
    return out.fillna(0, ["n_best", "count_sum"])
