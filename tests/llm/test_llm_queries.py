"""Every query of the llm folder over the smallest tables: against its SQL, or against a plain version."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from compare import compare, connect
from dwellgrid.llm.queries import ORACLE, QUERIES, URL_RULES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def frame(spark, name):
    return QUERIES[name](spark, FOLDER).toPandas()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, FOLDER), duck, ORACLE[name]) is None


def test_html_extraction(spark, duck):
    got = frame(spark, "op1_html_extraction").set_index("page_id")
    pages = duck.execute("SELECT page_id, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for page_id, page in pages:
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>|<br>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got.loc[page_id].text, got.loc[page_id].n_chars) == (want, len(want))


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = frame(spark, "op4_packing")
    assert set(got.doc_id) == set(texts)
    for doc_id, pieces in got.groupby("doc_id"):
        ids = np.array([*plain.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = pieces.sort_values("start")
        assert pieces.start.tolist() == [0, *pieces.length.cumsum()[:-1]] and pieces.length.sum() == len(ids) and (pieces.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[a : a + n]) for a, n in zip(pieces.start, pieces.length)] == pieces.ids_crc32.tolist()
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert pieces.offset.tolist() == [0, *pieces.length.cumsum()[:-1]] and pieces.length.sum() <= 2048
    assert got.length.sum() / 2048 / got.sequence_id.nunique() > 0.98


def test_quality_learns(spark, duck):
    got = frame(spark, "op6_quality").merge(duck.execute("SELECT * FROM labels").df(), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert len(held) and (held.accepted == (held.quality == 1)).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_toxicity_learns(spark, duck, texts):
    got = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    labels = connect("/root/testdata/sf0.01").execute("SELECT * FROM labels").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.2
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.97


def test_url_rules(spark, duck):
    got = frame(spark, "op9_url_filter").set_index("page_id")
    urls = duck.execute("SELECT page_id, url FROM pages").fetchall()
    assert len(got) == len(urls)
    for page_id, url in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = m[1].lower(), m[2]
        fit = [(len(r), r, v) for r, v in URL_RULES for own, rest in [r.split("/", 1)] if (host == own or host.endswith("." + own)) and path.startswith("/" + rest)]
        row = got.loc[page_id]
        assert (row.host, row.path) == (host, path) and row.verdict in ("allow", "block")
        if fit:
            assert (row.rule, row.verdict) == max(fit)[1:]
        else:
            assert row.rule is None


def test_quality_rules(spark, texts):
    got = frame(spark, "op10_quality_rules").set_index("doc_id")
    for doc_id, text in texts.items():
        words, seen, dup = WORD.findall(text or ""), set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often, covered = Counter(windows), set()
        for k, w in enumerate(windows):
            if often[w] > 1:
                covered |= {k, k + 1, k + 2}
        row = got.loc[doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))
        assert row.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row.base_failed and row.kept)


def near_groups(texts):
    """Brute force: every pair that shares a shingle."""
    sets, by = {}, defaultdict(list)
    for i, t in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for g in sets[i]:
            by[g].append(i)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {(a, b) for ids in by.values() for a in ids for b in ids if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}, sets


def test_near_against_all_pairs(spark, texts):
    want, sets = near_groups(texts)
    got = frame(spark, "op8_near_dedup").set_index("doc_id")
    assert {i: (got.loc[i].n_shingles, got.loc[i].component_id) for i in texts} == {i: (len(sets[i]), want[i]) for i in texts}


def test_pipeline_against_plain_steps(spark, duck, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.toPandas()
    bad = set(duck.execute("SELECT doc_id FROM labels WHERE quality = 0").df().doc_id)
    good = set(duck.execute("SELECT doc_id FROM labels WHERE quality = 1").df().doc_id)
    first = set(kept["quality"].doc_id)
    assert len(good - first) <= 0.02 * len(good) and len(bad & first) <= 0.1 * len(bad)
    assert set(kept["lines"].doc_id) == first
    want, _ = near_groups(dict(zip(kept["lines"].doc_id, kept["lines"].text)))
    assert set(kept["near"].doc_id) == {i for i, c in want.items() if i == c}
    assert set(kept["packing"].doc_id) == set(kept["decontamination"].doc_id) <= set(kept["near"].doc_id)
    run = corpus_pipeline.run(spark, FOLDER).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, run[key].values.tolist())) == sorted(map(tuple, kept["packing"][key].values.tolist()))


def test_item_digests(spark, duck):
    got = frame(spark, "op3_decontamination")
    assert got.items_sha256[~got.contaminated].eq(hashlib.sha256(b"").hexdigest()).all() and got.contaminated.any()
