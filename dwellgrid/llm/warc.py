"""WARC archives and their index.

Records are written as text files whose lines are whole records (the payload is
UTF-8), gzip-compressed, through Spark's own writer: any shared file system,
and a lost task is simply written again. Reading parses the archives by the
lengths in the headers. The index is an external merge: each archive gives a
capture run, sorted by URL key and time; the key space is cut into ranges of
even size, a run is dealt over the ranges, and in each range the runs are
merged by a loser tree. Ranges in order are the globally ordered history.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.llm.store import new_folder, stored

#: Rows that share an archive file, so that a reader's memory is bounded.
FILE_RECORDS = 500
_HEAD = re.compile(rb"([^:\r\n]+): *([^\r\n]*)\r\n")


def url_key(url: Column) -> Column:
    """Host labels turned around, then path and query: ``com,example,www)/a?b``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(rest)), F.lit(")"))


def with_revisits(pages: DataFrame, least: int) -> DataFrame:
    """Digest, size and record type of each page; of equal payloads of ``least`` bytes the largest page_id is the response."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", "captured", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    many = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    many = stored(many, "warc-repeats")
    bound = many.limit(200_001).count()
    out = rows.join(F.broadcast(many) if bound <= 200_000 else many, "payload_digest", "left")
    again = F.coalesce((F.col("response") != F.col("page_id")), F.col("response").isNotNull()) & (F.col("payload_bytes") >= least)
    return out.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("response"))).drop("response")


def _safe(value: Column) -> Column:
    """A header value on one line; percent-encodes what would break it."""
    return F.replace(F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_of() -> Column:
    """A row of ``with_revisits`` as the text of its WARC record, without the two closing line ends."""
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit("")))
    length = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")
    head = [
        (F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type")),
        (F.lit("\r\nWARC-Record-ID: <urn:page:"), F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        (F.lit("\r\nWARC-Date: "), F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        (F.lit("\r\nWARC-Target-URI: "), F.concat(F.when(F.col("url").isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(_safe(F.col("url")), F.lit("")))),
        (F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        (F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string")),
        (F.when(revisit, "\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:").otherwise(""), F.when(revisit, F.concat(F.col("refers_to").cast("string"), F.lit(">"))).otherwise("")),
        (F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length),
    ]
    return F.concat(*[x for pair in head for x in pair], F.lit("\r\n\r\n"), body)


def write_archives(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """One gzip-compressed archive per task and ``file_records`` rows."""
    rows = records.select(record_of().alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = {k.decode(): v.decode() for k, v in _HEAD.findall(data[at : end + 2])}
        size = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _id(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The archives' captures; each archive is one run, sorted by key and time (``place`` counts)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    key = url_key

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for offset, head, payload in parse(gzip.decompress(content.as_py())):
                    uri = head["WARC-Target-URI"]
                    url = re.sub("%(25|0D|0A)", lambda m: chr(int(m[1], 16)), uri[1:]) if uri[:1] == "+" else None
                    rows.append((url, head["WARC-Date"], _id(head["WARC-Record-ID"]), head["WARC-Type"], _id(head.get("WARC-Refers-To")), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].partition(":")[2], hashlib.sha1(payload).hexdigest(), offset, name.rpartition("/")[2]))
                yield pa.RecordBatch.from_pylist([dict(zip(_RUN.names, r)) for r in rows], schema=_RUN)

    out = files.mapInArrow(run, "url string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, stored_digest string, offset long, archive string")
    return out.withColumn("urlkey", key(F.col("url")))


_RUN = pa.schema([
    ("url", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stored_digest", pa.string()), ("offset", pa.int64()), ("archive", pa.string()),
])


class LoserTree:
    """Merge of sorted iterators: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.rank = [self._rank(i) for i in range(self.k)]
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _rank(self, i: int):
        return (1,) if self.head[i] is None else (0, self.key(self.head[i]), i)

    def _play(self, i: int) -> None:
        at = (i + self.k) >> 1
        while at > 0:
            other = self.loser[at]
            if other == -1:
                self.loser[at] = i
                return
            if self.rank[other] < self.rank[i]:
                self.loser[at], i = i, other
            at >>= 1
        self.loser[0] = i

    def __iter__(self):
        while self.k:
            i = self.loser[0]
            if self.head[i] is None:
                return
            yield self.head[i]
            self.head[i] = next(self.runs[i], None)
            self.rank[i] = self._rank(i)
            at = (i + self.k) >> 1
            while at > 0:
                if self.rank[self.loser[at]] < self.rank[i]:
                    self.loser[at], i = i, self.loser[at]
                at >>= 1
            self.loser[0] = i


def merged_index(runs: DataFrame) -> DataFrame:
    """All captures in order of URL key, time and archive place; ``position`` counts within a range.

    Each archive's captures are sorted where they are (one run per archive),
    written, dealt to ranges of the key space and merged there by a loser tree.
    Captures of one key may fill many ranges: a range edge is a full key.
    """
    spark = runs.sparkSession
    order = ["urlkey", "captured", "archive", "offset"]
    local = stored(runs.sortWithinPartitions("archive", *order), "warc-runs")
    dealt = local.repartitionByRange(*order).sortWithinPartitions("archive", *order)
    names = dealt.columns
    at = [names.index(c) for c in order]

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        keys = list(zip(*(table.column(i).to_pylist() for i in at)))
        archive = [k[2] for k in keys]
        edges = [0, *(i for i in range(1, len(keys)) if archive[i] != archive[i - 1]), len(keys)]
        merged = LoserTree([iter(range(a, b)) for a, b in zip(edges, edges[1:])], key=keys.__getitem__)
        out = table.take(pa.array(list(merged), pa.int64()))
        out = out.append_column("position", pa.array(range(len(keys)), pa.int64()))
        yield from out.combine_chunks().to_batches()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields), "position long"])
    return dealt.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, path: str | None = None, least: int = 1000, captured: Column | None = None) -> DataFrame:
    """Write a record per page, read the archives back and return their ordered index.

    Columns: url, captured, page_id, record_type, refers_to, payload_bytes,
    payload_digest (of the full payload, as the header has it), stored_digest
    (of the bytes read back), offset, archive, urlkey, position. Null html is an
    empty payload; a null url is kept as null and has the key ``)``. Rows of one
    page_id and equal payload are all response. Without ``captured``, the
    time of capture is page_id seconds after the start of 2024. No pages give
    no rows.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc-archives")
    when = captured if captured is not None else F.timestamp_seconds(F.lit(1704067200) + F.coalesce(pages["page_id"], F.lit(0)))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"), when.alias("captured"))
    write_archives(with_revisits(rows, least), path)
    return merged_index(capture_runs(spark, path))
