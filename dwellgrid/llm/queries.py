"""The named queries of this folder, and SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.llm import merkle, pieces, spans, toxicity, warc
from dwellgrid.llm.contamination import decontaminate
from dwellgrid.llm.html import extract
from dwellgrid.llm.lines import LINES_SQL, dedup_lines
from dwellgrid.llm.near import near_duplicates
from dwellgrid.llm.packing import pack
from dwellgrid.llm.quality import classify
from dwellgrid.llm.rules import quality_rules
from dwellgrid.llm.urls import filter_urls, seeded_labels

# The host and path rules of op9.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, folder, "pages"))


@query(LINES_SQL)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without lines that ten or more sources share."""
    return dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS said FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM s)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS said FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n)),
m AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.said = iw.said),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query(DECONTAMINATION_SQL)
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in ten-word windows of benchmark items."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, folder, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query()
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens in sequences of 2048."""
    return pack(table(spark, folder, "documents"), with_ids=False)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
l AS (SELECT body, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, n AS payload_bytes, sha1(p.body) AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN l ON p.body = l.body AND n >= 1000
"""


@query(WARC_SQL)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record as the merged index of the archives tells it."""
    out = warc.archive_pages(table(spark, folder, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score from two co-trained views."""
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity from weakly supervised training."""
    out = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, w.doc_id = min(root) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id
"""


@query(NEAR_SQL)
def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its near-duplicate component."""
    return near_duplicates(table(spark, folder, "documents"))


@query()
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL under the rules, and else the boosted trees."""
    pages = table(spark, folder, "pages")
    out = filter_urls(pages, seeded_labels(pages, table(spark, folder, "labels")), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


@query()
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document under rules whose false-rejection rate is bounded per language."""
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and the text they decode to, as digests."""
    out = pieces.encode(table(spark, folder, "documents"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def merkle_sql(levels: int = 7, top_levels: int = 4) -> str:
    """SQL of op12 with its levels unrolled: up to 8 ** levels documents a language, 8 ** top_levels languages."""
    said = lambda text: ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in (text if c == "text" else c for c in LEAF_COLUMNS))
    crc = "SELECT i, i AS c FROM range(256) r(i)"
    for _ in range(8):
        crc = f"SELECT i, xor(c >> 1, 3988292384 * (c & 1)) AS c FROM ({crc})"
    steps = [
        f"crc AS (SELECT list(c ORDER BY i) AS t FROM ({crc}))",
        """own AS (SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claimed FROM documents, crc)""",
        f"leaf AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(concat({said('text')})) AS leaf, sha256(concat({said('claimed')})) AS claim FROM own)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaf)",
        "n0 AS (SELECT g, p, leaf AS h FROM placed)",
    ]

    def grow(name: str, count: int) -> None:
        for j in range(count):
            steps.append(f"{name}r{j} AS (SELECT g, p // 8 AS p, list(h ORDER BY p) AS hs, max(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {name}{j}) GROUP BY g, p // 8)")
            steps.append(f"{name}{j + 1} AS (SELECT g, p, CASE WHEN m > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}r{j})")

    def climb(name: str, count: int, start: str, last: str) -> None:
        """From (.., g, p, acc, proof) of ``start`` to ``last``."""
        at = start
        for j in range(count):
            i = f"CAST(a.p // {8**j} % 8 AS INT)"
            left, right = f"array_to_string(hs[1:{i}], '')", f"array_to_string(hs[{i} + 2:], '')"
            to = last if j == count - 1 else f"{last}{j}"
            steps.append(f"{to} AS (SELECT a.* REPLACE (CASE WHEN m > 1 THEN sha256({left} || acc || {right}) ELSE acc END AS acc, CASE WHEN m > 1 THEN proof || {left} || {right} ELSE proof END AS proof) FROM {at} a JOIN {name}r{j} r ON r.g = a.g AND r.p = a.p // {8 ** (j + 1)})")
            at = to

    grow("n", levels)
    steps.append(f"t0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS p, h, g AS name FROM n{levels})")
    grow("t", top_levels)
    steps.append("c AS (SELECT doc_id, leaf, g, p, claim AS acc, '' AS proof FROM placed)")
    climb("n", levels, "c", "mid")
    steps.append("d AS (SELECT m.doc_id, m.leaf, t0.h AS subroot, '' AS g, t0.p, m.acc, m.proof FROM mid m JOIN t0 ON t0.name = m.g)")
    climb("t", top_levels, "d", "fin")
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = h AS verified FROM fin, t{top_levels}"


@query(merkle_sql())
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's proof against the manifest, and the root that its claimed row leads to."""
    docs = table(spark, folder, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(tampered, lower).otherwise(F.col("text"))
    claim = merkle.digest_of([text if c == "text" else docs[c] for c in LEAF_COLUMNS])
    out = merkle.verify(docs, LEAF_COLUMNS, "lang", "doc_id", claim)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query()
def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's groups and links of two tokenizers."""
    aligned = spans.align(table(spark, folder, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return spans.score(aligned.withColumn("groups_sha256", digest).drop("groups"))
