"""Pieces, manifests and spans against the libraries and plain versions."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import connect
from dwellgrid.llm import merkle, pieces, spans
from dwellgrid.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, block string, tree string, pos string, digest string, row string, links string, n_a string"
TEXTS = [(1, ""), (2, None), (3, " "), (4, "a "), (5, "  a   b  "), (6, "x▁y ▁ "), (7, "<s> </s> <unk> <0x41><|endoftext|> x"), (8, "日本 語\n\tx\r\n é"), (9, "\x00 a\x00 \x1c b"), (9, "\x00 a\x00 \x1c b"), (None, "q" * 60_000), (10, "🙂 é é　ñ's '' ́")]
LONG = (11, " ".join(f"w{i % 3000}x{i // 7}" for i in range(40_000)))
ODD = st.text(alphabet="aB9 \n\t\x0b,.é日-'s　\x1c\x85▁🙂ñ́<|>", max_size=50)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "xx", None, 3, *["x"] * 8) for r in [*TEXTS, LONG]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return connect(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall()


# pieces


def encoded(text):
    model = pieces.pieces("piece_bpe_32k").model
    ids = model.encode(text or "", add_eos=True)
    return ids, model.decode(ids)


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_pieces_edges(odd, block):
    got = pieces.encode(odd, block_chars=block).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == sorted((str(i), *encoded(t)) for i, t in [*TEXTS, LONG])


def test_pieces_empty(odd):
    assert pieces.encode(odd.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_chunks_have_the_ids_of_the_text(text):
    made = pieces.pieces("piece_bpe_32k")
    assert [i for ids in made.segment(pieces.chunked(text)) for i in ids] == made.model.encode(text)


def test_pieces_query(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op11_sentencepiece"](spark, FOLDER).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids, decoded = encoded(text)
        assert tuple(got[doc_id])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


# manifest


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, i):
    path = []
    for level in levels[:-1]:
        run = i // 8 * 8
        path.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        i //= 8
    return path


def plain_manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(((r[0] is not None, r[0] or 0), sha(*map(said, r)), r[0]))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([leaf for _, leaf, _ in sorted(by[x], key=lambda y: y[:2])]) for x in names}
    top = levels_of([trees[x][-1][0] for x in names])
    return [(doc_id, leaf, trees[x][-1][0], top[-1][0], path_of(trees[x], i) + path_of(top, k)) for k, x in enumerate(names) for i, (_, leaf, doc_id) in enumerate(sorted(by[x], key=lambda y: y[:2]))]


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize(("n", "langs", "every"), [(1, 1, 2), (9, 1, 1), (64, 1, 2), (65, 2, 2), (600, 70, 3), (700, 3, 1)])
def test_manifest_against_plain_trees(spark, n, langs, every):
    rows = [([i, None, 3, i][i % 4], "s" if i % 3 else None, f"l{i % langs}é" if i % langs else None, i, [None, "", f"T{i}", "é" * i][i % 4]) for i in range(n)] + [(3, "s", None, 1, "x")] * 2
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string").repartition(4)
    got = merkle.verify(docs, COLUMNS, "lang", "doc_id", every=every).collect()
    want = plain_manifest(rows)
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in got) == sorted((str(w[0]), *w[1:]) for w in want)
    assert all(r["folded_root"] == r["root"] for r in got)


def test_manifest_finds_what_was_changed(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    claim = merkle.digest_of([F.col("doc_id"), F.when(F.col("doc_id") % 7 == 0, "y").otherwise(F.col("text"))])
    got = merkle.verify(docs, ["doc_id", "text"], "text", "doc_id", claim).collect()
    assert all((r["folded_root"] == r["root"]) == (r["doc_id"] % 7 > 0) for r in got)
    assert merkle.verify(docs.limit(0), ["doc_id", "text"], "text", "doc_id").count() == 0


def test_manifest_holds_few_nodes(spark):
    rows = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    made = merkle.build(rows, F.lit("x"), ["id"], every=2)
    assert [x.count() for x in made.rows.levels] == [1000, 16, 1] and [x.count() for x in made.top.levels] == [1]


# spans


def plain_alignment(text):
    made = spans.aligner("byte_bpe_50k", "piece_bpe_32k")
    if not text:
        return None
    ids = made.a.encode(f" {text}", add_special_tokens=False).ids, made.b.encode(text)
    said = [made.a_bytes[i] for i in ids[0]], [made.b_bytes[i] for i in ids[1]]
    if any(b"".join(s) != f" {text}".encode() for s in said):
        return None
    ends, at, groups = [list(accumulate(map(len, s))) for s in said], [0, 0], []
    for end in sorted(set(ends[0]) & set(ends[1])):
        group = []
        for side in (0, 1):
            first = at[side]
            while at[side] < len(ends[side]) and ends[side][at[side]] <= end:
                at[side] += 1
            group.append(ids[side][first : at[side]])
        groups.append(group)
    links = Counter((x, y) for a, b in groups for x in a for y in b)
    return len(ids[0]), len(ids[1]), len(groups), sum(links.values()), ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups), dict(links)


def aligned(texts):
    made = spans.aligner("byte_bpe_50k", "piece_bpe_32k")
    found = [made.stretches(spans.stretched(t)) for t in texts]
    columns = made.columns([np.concatenate(f) if f and all(map(len, f)) else np.zeros(0, int) for f in found])
    rows = zip(*[c.to_pylist() for c in columns])
    return [(*r[:5], {(x["a"], x["b"]): x["n"] for x in r[5]}) if r[0] else None for r in rows]


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_alignment_of_odd_texts(texts):
    assert aligned(texts) == [plain_alignment(t) for t in texts]


def test_alignment_of_documents(texts):
    some = [t for _, t in texts] + [t for _, t in TEXTS[:-2]] + [" " * 500 + "x" + "é" * 3000]
    assert aligned(some) == [plain_alignment(t) for t in some]


def test_large_groups_count_by_distinct_ids(monkeypatch, texts):
    some = [t for _, t in texts[:40]]
    want = aligned(some)
    monkeypatch.setattr(spans, "LARGE_GROUP", 1)
    assert aligned(some) == want


@pytest.mark.parametrize("head", [spans.HEAD_PAIRS, 50])
def test_alignment_scores(spark, texts, odd, head):
    frames = [(spark.read.parquet(f"{FOLDER}/documents.parquet"), texts), (odd, [*TEXTS, LONG])]
    for docs, rows in frames:
        made = [(i, plain_alignment(t) or (0, 0, 0, 0, "", {})) for i, t in rows]
        held = Counter(pair for _, m in made for pair in m[5])
        most = Counter()
        for (a, _), n in held.items():
            most[a] = max(most[a], n)
        want = [(str(i), *m[:5], sum(n for p, n in m[5].items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in m[5].items())) for i, m in made]
        got = spans.score(spans.align(docs), head).collect()
        assert sorted((str(r["doc_id"]), *[r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")]) for r in got) == sorted(want)


def test_alignment_query(spark, odd):
    got = QUERIES["op13_tokenizer_alignment"](spark, FOLDER).collect()
    assert len(got) == 200 and all((r["n_a"] == 0) == (r["groups_sha256"] == "") for r in got)
    assert spans.score(spans.align(odd.limit(0))).count() == 0
