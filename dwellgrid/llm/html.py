"""Main text of web pages by equivalence-class template deduction.

1. Every page is read as elements and text blocks. A token is an element at its
   place in the tree (tag, class, ancestors), or a text at its place. Over all
   pages of a host each token has an occurrence vector: how often it stands in
   each page. A vector is kept as page count, occurrence count and an XOR of
   (page, count) hashes, so it is a plain aggregate at any number of pages.
2. Tokens of a host with equal vectors are one class. A class is valid if it
   has more than one token, its pages are at least half of the host's, and it
   nests: its elements stand inside elements of a valid class. Valid classes,
   nested, are the template; texts found once in every page are template too,
   and those of the class of a layout: of an html, body, article or main
   element, in however many of the host's pages, most of whose words differ.
3. What lies between template tokens are slots. The host's main slot is the
   template element that holds its text: an article or main element if the
   template has one, else the innermost element with most of the words. A
   page's text is its blocks inside that slot, without template texts and
   without menus, notices and the like, which their elements or names tell.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.markup import next_tag, raw_end
from dwellgrid.llm.store import stored
from dwellgrid.llm.text import bounded_batches, seeded
from dwellgrid.llm.urls import host_of

#: A host with fewer pages has no template texts: what they share may be what they say.
TEXT_PAGES = 8
#: Most hosts whose templates are broadcast; beyond, they are joined by a shuffle.
BROADCAST_HOSTS = 20_000
# HTML elements by what they mean for blocks of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noframes".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul".split()
)
NOT_TEXT = set("aside button dialog footer form head header menu nav noscript option select template iframe object svg canvas audio video".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
# Words in class, id or role that name what isn't main text.
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices alert newsletter subscribe signup popup modal comment comments disqus respond replies "
    "share sharing social related recommended widget toolbar pagination pager login search contentinfo complementary".split()
)
# First parts of a name that tells what stands beside or is missing.
BESIDE = {"with", "has", "no", "without"}

def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Element:
    __slots__ = ("tag", "sig", "parent", "depth", "apart", "main", "words", "order")

    def __init__(self, tag, sig, parent, depth, apart, main, order):
        self.tag, self.sig, self.parent, self.depth, self.apart, self.main, self.words, self.order = tag, sig, parent, depth, apart, main, 0, order


def _named(attributes: dict[str, str]) -> tuple[str, int, bool]:
    """(class, how surely its names tell that it isn't main text: 0 to 2, do they tell that it is)."""
    own, apart, main = "", 0, False
    for name in ("class", "id", "role", "itemprop"):
        parts = attributes.get(name, "").lower().split()
        if name == "class" and parts:
            own = parts[0]
        main |= (name, parts) in (("role", ["main"]), ("itemprop", ["articlebody"]))
        for p in parts:
            bits = re.split(r"[-_]+", p)
            if bits[0] in BESIDE:
                continue
            sure = p in NAMES or bits[0] in ("comment", "comments")
            apart = max(apart, 2 if sure else int(bits[0] in NAMES or bits[-1] in NAMES))
    return own, apart, main


def read(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """(elements, blocks) of a page in order; a block is (element it stands in, text with single spaces)."""
    root = Element("", seeded_sig, 0, 0, False, False, 0)
    stack, elements, blocks, said = [root], [], [], []
    opened: Counter[str] = Counter()  # open elements by tag

    def flush():
        if said:
            text = " ".join(html.unescape("".join(said)).split())
            said.clear()
            if text:
                here = stack[-1]
                blocks.append((here, text))
                if not here.apart:
                    here.words += text.count(" ") + 1

    def close(n: int):
        while len(stack) > n:
            gone = stack.pop()
            opened[gone.tag] -= 1
            stack[-1].words += gone.words

    at, size = 0, len(page)
    while at < size:
        m = next_tag(page, at)
        if m is None:
            said.append(page[at:])
            break
        if m.start > at:
            said.append(page[at : m.start])
        at, tag = m.end, m.name
        if not tag:
            continue
        if m.closing:
            if tag in BLOCK or tag in NOT_TEXT:
                flush()
                if opened[tag]:
                    i = len(stack) - 1
                    while stack[i].tag != tag:
                        i -= 1
                    close(i)
            elif tag == "br":
                said.append(" ")
            continue
        if tag in RAW:
            at = raw_end(page, tag, at)
            continue
        if tag == "br":
            said.append(" ")
            continue
        if tag == "hr":
            flush()
        if tag in VOID or tag not in BLOCK and tag not in NOT_TEXT:
            continue
        flush()
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        for closed in (CLOSES.get(tag) or ()):
            if stack[-1].tag in CLOSES[tag]:
                close(len(stack) - 1)
        own, apart, main = _named(m.attributes)
        up = stack[-1]
        main = main or tag in ("article", "main")
        by_tag = tag in NOT_TEXT
        # half a name doesn't set apart what holds the article
        if tag in ("html", "body"):
            level = 0
        elif up.apart == 2 or by_tag or apart == 2:
            level = 2
        else:
            level = 0 if main else int(up.apart or apart)
        # what a token is taken for is a part of it, so that all its pages agree
        el = Element(tag, _hash(up.sig, tag, own, level, main), up.sig, up.depth + 1, level, main, len(elements))
        elements.append(el)
        if m.empty and tag in ("svg", "iframe", "object"):
            continue
        stack.append(el)
        opened[tag] += 1
    flush()
    close(1)
    return elements, blocks


seeded_sig = seeded(31) - (1 << 63)
_TOKENS = "host string, token long, parent long, text boolean, tag string, main boolean, depth int, apart boolean, pages long, occ long, fp long, place double, words long"


def host_tokens(pages: DataFrame) -> DataFrame:
    """Occurrence vectors: one row per host and token, summed over all its pages."""

    def run(batches):
        for batch in batches:
            found: dict[tuple, list] = {}
            for page_id, host, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                elements, blocks = read(page or "")
                own: dict[tuple, list] = {}
                for el in elements:
                    x = own.setdefault((el.sig, el.parent, False, el.tag, el.main, el.depth, bool(el.apart)), [0, el.order, 0])
                    x[0] += 1
                    x[2] += el.words
                for el, text in blocks:
                    x = own.setdefault((_hash(el.sig, text), el.sig, True, el.tag, False, el.depth, bool(el.apart)), [0, el.order, 0])
                    x[0] += 1
                    x[2] += 0 if el.apart else text.count(" ") + 1
                one = _hash(page_id, page)
                for token, (n, order, words) in own.items():
                    x = found.setdefault((host, *token), [0, 0, 0, 0.0, 0])
                    x[0] += 1
                    x[1] += n
                    x[2] ^= _hash(one, n)
                    x[3] += order
                    x[4] += words
            rows = [(*k, *v) for k, v in found.items()]
            cols = [list(c) for c in zip(*rows)] or [[] for _ in range(13)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in _TOKENS.split(", ")])

    partial = pages.select("page_id", "host", "html").mapInArrow(run, _TOKENS)
    return partial.groupBy("host", "token").agg(
        *[F.first(c).alias(c) for c in ("parent", "text", "tag", "main", "depth", "apart")],
        F.sum("pages").alias("pages"), F.sum("occ").alias("occ"), F.bit_xor("fp").alias("fp"), F.sum("place").alias("place"), F.sum("words").alias("words"),
    )


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, texts): the main slot's element and the template texts of every host."""
    tokens = host_tokens(pages)
    sizes = pages.where(F.col("html").rlike(r"\S")).groupBy("host").agg(F.count("*").alias("host_pages"))
    half = 2 * F.col("pages") >= F.col("host_pages")
    repeated = stored(tokens.join(sizes, "host").where(half | (F.col("pages") >= TEXT_PAGES)), "html-tokens")
    often = repeated.where(half)
    # classes of equal vectors; a host's tokens of half its pages are as few as twice a page's tokens
    classes = often.groupBy("host", "pages", "occ", "fp").agg(F.count("*").alias("members"))
    valid = often.join(classes.where("members > 1"), ["host", "pages", "occ", "fp"])
    elements = valid.where("NOT text")
    up = elements.select(F.col("host"), F.col("token").alias("parent")).distinct()
    nested = elements.join(up, ["host", "parent"], "left_semi").unionByName(elements.where("depth = 1")).distinct()
    main = (
        nested.where("main AND NOT apart").withColumn("score", F.struct(F.lit(2).alias("a"), F.col("words").alias("b"), F.col("depth").alias("c")))
        .unionByName(
            nested.where("NOT apart AND tag NOT IN ('p', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'li')")
            .join(nested.where("tag IN ('body', 'html') OR depth = 1").groupBy("host").agg(F.max("words").alias("all_words")), "host")
            .where("10 * words >= 6 * all_words").drop("all_words")
            .withColumn("score", F.struct(F.lit(1).alias("a"), F.col("depth").cast("long").alias("b"), F.lit(0).alias("c")))
        )
        .groupBy("host").agg(F.max(F.struct("score", "token"))["token"].alias("main"))
    )
    constant = valid.where((F.col("text")) & (F.col("occ") == F.col("pages")) & (F.col("pages") == F.col("host_pages")) & (F.col("host_pages") >= TEXT_PAGES))
    vector = ["host", "pages", "occ", "fp"]
    said = repeated.where(F.col("text") & (F.col("occ") == F.col("pages")) & (F.col("pages") >= TEXT_PAGES))
    layouts = repeated.where("NOT text AND NOT apart AND (main OR tag IN ('html', 'body'))").groupBy(*vector).agg(F.max("words").alias("all_words"))
    # what copies of one page share is what they say
    layouts = said.groupBy(*vector).agg(F.sum("words").alias("own_words")).join(layouts, vector).where("2 * own_words < all_words").select(*vector)
    constant = constant.select("host", "token").unionByName(said.join(layouts, vector).select("host", "token"))
    texts = constant.groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("texts"))
    return main.join(texts, "host", "full_outer").select("host", "main", F.coalesce("texts", F.array().cast("array<bigint>")).alias("texts"))


def main_text(page: str | None, main: int | None, texts: set[int]) -> str:
    """The blocks of a page inside the main slot, joined by empty lines.

    A page without the host's main slot falls back on its own article or main
    elements, and without these on all that isn't set apart.
    """
    elements, blocks = read(page or "")
    inside: dict[int, bool] = {}
    starts = {el.sig for el in elements if el.sig == main and not el.apart} or {el.sig for el in elements if el.main and not el.apart}
    by_sig = {el.sig: el for el in elements}

    def held(el: Element) -> bool:
        path = []
        while el.sig not in inside:
            path.append(el.sig)
            if el.sig in starts or el.parent not in by_sig:
                inside[el.sig] = el.sig in starts
                break
            el = by_sig[el.parent]
        for sig in path:
            inside[sig] = inside[el.sig]
        return inside[path[0]] if path else inside[el.sig]

    out = []
    for el, text in blocks:
        if el.apart or (starts and not held(el)) or (texts and _hash(el.sig, text) in texts):
            continue
        out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Null or empty html gives empty text. Pages with no host (null url, or no
    ``://``) are taken as one host's. Repeated rows are extracted each. No pages
    give no rows. White space of any kind inside a block is one space.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[source].alias("html")).withColumn("host", host_of(F.col("url")))
    known = stored(templates(rows), "html-templates")
    hosts = known.limit(BROADCAST_HOSTS + 1).count()
    joined = rows.join(F.broadcast(known) if hosts <= BROADCAST_HOSTS else known, "host", "left").select("page_id", "url", "html", "main", "texts")

    def run(batches):
        for batch in batches:
            text = [main_text(p, m, set(t or ())) for p, m, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
