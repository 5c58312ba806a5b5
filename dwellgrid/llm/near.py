"""Near duplicates by chosen-path set similarity join.

1. Every text becomes the set of its word shingles; equal sets are one class
   from then on, whatever the number of copies.
2. A tree sends a set down from its root: at each node one or two of the
   minwise coordinates are chosen (4/3 on average, the inverse of 0.75; the
   choice depends on the node alone), and the set goes on to the child named by
   its value there. Sets of similarity 0.75 meet at the leaf of a tree with a
   chance of 0.6 at depth three; independent trees repeat this until the chance to miss is
   below 1e-5.
3. Nodes of at most ``leaf`` shingles in all are compared exhaustively inside
   one task, on the full sets.
4. The first two trees are compared first, their larger nodes in blocks, dealt
   anew in each tree: this connects what is nearly alike. Of later trees only
   nodes that still hold different components are compared, and pairs already
   connected are skipped.
5. Larger nodes of any tree that still hold different components: if few sets
   are outside the largest component, these are compared with the whole node.
   Else all its sets go down further trees, whose minwise values are the node's
   own, three levels at a time until nodes are small or few are outside. Two
   sets meet less often the deeper they go, so there are as many such trees as
   the greatest depth asks for: 13 at depth three, 42 at depth 15, each for a
   chance to miss below 1e-5. A node that is still too large there is dealt
   into blocks, and then those outside its largest component are compared with
   all blocks.

A leaf gives one link per set that it connects, never all pairs, and a search
from linked sets outward is exact: a set is held against every set not yet in
its component.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.components import components
from dwellgrid.llm.store import stored
from dwellgrid.llm.text import VISIBLE, U, bounded_batches, chunks, hashed, mix, seeded, words

SHINGLE = 5
COORDS = 128
TREES = 14
DEPTH = 3
DEEPER = 3  # levels that a node too large goes on at once
DEEPEST = 15
FIRST_TREES = 2
#: Shingles, over all sets of a node, that one task compares.
LEAF = 1 << 20
#: Chance that the further trees miss a pair.
MISS = 1e-5
_rng = np.random.default_rng(97)
_XOR = _rng.integers(1, 1 << 63, COORDS, dtype=U)
_MUL = _rng.integers(1, 1 << 63, COORDS, dtype=U) * U(2) + U(1)


def _sets(chunk):
    """(hashes, edges, full): shingles of each row of a chunk, as they come."""
    w = words(chunk, VISIBLE, lower=True)
    h = hashed(chunk, w)
    g, at = w.grams(h, SHINGLE)
    n = np.bincount(w.row[at], minlength=chunk.n)
    n_words = w.counts()
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):  # the whole text is its one shingle
        extra, places = [], []
        before = np.zeros(chunk.n + 1, np.int64)
        np.cumsum(n, out=before[1:])
        for r in short:
            x = U(seeded(77, int(n_words[r])))
            for k in range(int(w.first[r]), int(w.first[r + 1])):
                x = mix(np.array([x ^ h[k]], U) * U(0x9FB21C651E98DF25))[0]
            extra.append(x)
            places.append(before[r])
        g = np.insert(g, places, np.array(extra, U))
        n[short] = 1
    edges = np.zeros(chunk.n + 1, np.int64)
    np.cumsum(n, out=edges[1:])
    return g, edges


def shingle_sets(docs: DataFrame, sketch: bool) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, two fingerprints of the set, and its minwise sketch or the set."""
    bounded_batches(docs.sparkSession)
    last = "sketch binary" if sketch else "members binary"
    schema = f"doc_id long, n_shingles long, f1 long, f2 long, {last}"

    def run(batches):
        for batch in batches:
            at = 0
            for c in chunks(batch.column(1)):
                g, edges = _sets(c)
                n, f1, f2, data = np.zeros(c.n, np.int64), np.zeros(c.n, U), np.zeros(c.n, U), [None] * c.n
                least = None
                full = np.flatnonzero(np.diff(edges))
                if sketch and len(g):
                    least = np.empty((len(full), COORDS), np.uint32)
                    for k in range(COORDS):
                        least[:, k] = np.minimum.reduceat(((g ^ _XOR[k]) * _MUL[k] >> U(32)).astype(np.uint32), edges[full])
                other = mix(g + U(0x632BE59BD9B4E019))
                for i, r in enumerate(full):
                    own = np.unique(g[edges[r] : edges[r + 1]])
                    n[r], f1[r] = len(own), own.sum(dtype=U)
                    f2[r] = mix(own + U(0x632BE59BD9B4E019)).sum(dtype=U)
                    data[r] = least[i].tobytes() if sketch else own.tobytes()
                del other
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, c.n), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(data, pa.binary())],
                    names=[x.split()[0] for x in schema.split(", ")],
                )
                at += c.n

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, schema)


def trees_at(depth: int, share: int = 75) -> int:
    """Independent trees in which two sets of similarity ``share`` per cent meet at ``depth``, but for a chance of MISS."""
    meet, p = 1.0, share / 100
    for _ in range(depth):
        meet = (2 * p * meet + 1 - (1 - p * meet) ** 2) / 3
    return math.ceil(math.log(MISS) / math.log(1 - meet))


def _descend(node: np.ndarray, own: np.ndarray, value, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Go ``levels`` further down from each node; ``own`` is the row of the set that stands there, ``value(own, node, coord)`` its minwise value."""
    for _ in range(levels):
        u = mix(node + U(0x51_7CC1B727220A95))
        first = (u % U(COORDS)).astype(np.int64)
        second = ((u >> U(20)) % U(COORDS - 1)).astype(np.int64)
        second += second >= first
        two = np.flatnonzero((u >> U(44)) % U(3) == 0)
        coord = np.concatenate([first, second[two]])
        parent = np.concatenate([np.arange(len(node)), two])
        own, node = own[parent], node[parent]
        node = mix(node ^ (value(own, node, coord).astype(U) * U(0xC2B2AE3D27D4EB4F) + coord.astype(U)))
    return node, own


_ROWS = "node long, tree int, rep long, load int"


def _rows(node: np.ndarray, tree, rep, load) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), tree, rep, load], names=["node", "tree", "rep", "load"])


def _sketched(column: pa.Array):
    """Minwise values from sketches: the same coordinates for all trees."""
    sketch = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDS)
    return lambda own, node, coord: sketch[own, coord]


def _counted(column: pa.Array):
    """Minwise values from the full sets: every node and coordinate has a hash of its own."""
    sets = [np.frombuffer(x, U) for x in column.to_pylist()]
    size, flat = np.array([len(x) for x in sets]), np.concatenate(sets)
    edges = np.cumsum(size) - size

    def value(own, node, coord):
        key = mix(node ^ mix(coord.astype(U) + U(0xA0761D6478BD642F)))
        out = np.empty(len(own), U)
        for at in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(size[own]) // LEAF)) + 1):
            n, k = size[own[at]], key[at]
            start = np.cumsum(n) - n
            span = np.repeat(edges[own[at]] - start, n) + np.arange(n.sum())
            out[at] = np.minimum.reduceat((flat[span] ^ np.repeat(k, n)) * np.repeat(mix(k) | U(1), n) >> U(32), start)
        return out

    return value


def _paths(sets: DataFrame, roots: list[int], values) -> DataFrame:
    """(node, tree, rep, load) at the first depth of the trees of ``roots``; ``sets``: rep, load and what ``values`` reads."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            value = values(batch.column(2))
            for t, root in enumerate(roots):
                node, own = _descend(np.full(n, root, U), np.arange(n), value, DEPTH)
                yield _rows(node, pa.array(np.full(len(node), t, np.int32)), batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)))

    return sets.mapInArrow(run, _ROWS)


def _branch(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes DEEPER levels below those of ``rows``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, own = _descend(np.asarray(batch.column(0)).view(U), np.arange(batch.num_rows), _counted(batch.column(4)), DEEPER)
            yield _rows(node, *(batch.column(i).take(pa.array(own)) for i in (1, 2, 3)))

    return rows.select("node", "tree", "rep", "load").join(members, "rep").select("node", "tree", "rep", "load", "members").mapInArrow(run, _ROWS)


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes that more than one set has reached, with the shingles of the node."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("sets"), F.sum("load").alias("total")).where("sets > 1").select("node", "total")
    return rows.join(sizes, "node")


def _grouped(batches, key: int):
    """Runs of rows with equal key from sorted batches, as lists of columns."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if kept and np.asarray(kept[-1].column(key))[-1] != keys[0]:
            yield kept
            kept = []
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield [*kept, batch.slice(a, b - a)]
            kept = []
        kept.append(batch.slice(edges[-2]))
    if kept:
        yield kept


def link(sets: list[np.ndarray], comp: np.ndarray, share: int, fresh: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets joined by pairs of similarity ``share`` per cent or more, given components.

    fresh: if given, pairs of two sets that aren't fresh were compared before.
    Each set is held against all sets outside its component, so no pair that
    could connect two components is left out; a pair is skipped only when its
    sizes alone forbid it.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    edges = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=edges[1:])
    flat = np.concatenate(sets)
    _, code = np.unique(flat, return_inverse=True)
    code = code.reshape(-1)
    mark = np.zeros(int(code.max()) + 1, bool) if len(code) else np.zeros(1, bool)
    comp = comp.copy()
    seen = np.zeros(n, bool)
    out = []
    for root in np.argsort(-np.unique(comp, return_inverse=True, return_counts=True)[2][np.unique(comp, return_inverse=True)[1]], kind="stable").tolist():
        queue = [root]
        while queue:
            i = queue.pop()
            if seen[i]:
                continue
            seen[i] = True
            can = (comp != comp[i]) & ~seen & (100 * np.minimum(size, size[i]) >= share * np.maximum(size, size[i]))
            if fresh is not None and not fresh[i]:
                can &= fresh
            can = np.flatnonzero(can)
            if not len(can):
                continue
            mark[code[edges[i] : edges[i + 1]]] = True
            span = np.concatenate([np.arange(edges[j], edges[j + 1]) for j in can])
            got = np.add.reduceat(mark[code[span]].astype(np.int64), np.concatenate([[0], np.cumsum(size[can])[:-1]]))
            mark[code[edges[i] : edges[i + 1]]] = False
            for j in can[100 * got >= share * (size[i] + size[can] - got)].tolist():
                if comp[j] != comp[i]:
                    out.append((i, j))
                    comp[comp == comp[j]] = comp[i]
                queue.append(j)
    return out


def _compare(rows: DataFrame, members: DataFrame, share: int) -> DataFrame:
    """(a, b) links of components found inside the groups of ``rows`` (grp, rep, comp, fresh)."""
    wide = rows.join(members.select("rep", "members"), "rep").select("grp", "rep", "comp", "fresh", "members")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = wide.repartition(4 * n, "grp").sortWithinPartitions("grp")

    def run(batches):
        for parts in _grouped(batches, 0):
            part = pa.Table.from_batches(parts)
            comp, fresh = part.column("comp").to_numpy(), part.column("fresh").to_numpy(zero_copy_only=False)
            found = link([np.frombuffer(x, U) for x in part.column("members").to_pylist()], comp, share, None if fresh.all() else fresh)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([comp[i] for i, _ in found]), pa.array([comp[j] for _, j in found])], names=["a", "b"])

    return wide.mapInArrow(run, "a long, b long")


def _with_components(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return rows.withColumn("comp", F.col("rep"))
    c = links.withColumnRenamed("node", "rep").withColumnRenamed("component", "comp")
    return rows.join(c, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _differing(rows: DataFrame, node: str) -> DataFrame:
    """Rows of nodes that still hold different components."""
    return rows.join(rows.groupBy(node).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(node), node)


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One of all groups of the very same sets: many nodes hold them, their sum of hashes tells."""
    by = rows.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("same"), F.count("*").alias("sets"))
    return rows.join(by.where("lo <> hi").groupBy("same", "sets").agg(F.min("grp").alias("grp")).select("grp"), "grp")


def near_components(docs: DataFrame, share: int = 75, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    component_id: the smallest doc_id that is reachable over links, a link being
    100 * intersection >= share * union of the sets of lower-cased word
    shingles. Null or blank text has the empty set and is linked with nothing;
    so is a row whose doc_id is null (component_id null). Repeated rows and
    equal texts are linked. No documents give no rows.
    """
    base = stored(shingle_sets(docs, sketch=True), "near-sets")
    classes = (
        base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    )
    per_class = classes.select("f1", "f2", "n_shingles", "rep", F.xxhash64("f1", "f2", "n_shingles").alias("key"), "sketch")
    per_class = stored(per_class, "near-classes")
    sketches = per_class.select(F.col("key").alias("rep"), F.col("n_shingles").cast("int").alias("load"), "sketch")
    rows = stored(_sized(_paths(sketches, [seeded(5, t) for t in range(trees)], _sketched).distinct()), "near-nodes")
    needed = rows.select("rep").distinct()
    texts = per_class.join(needed, per_class["key"] == needed["rep"], "left_semi").select(F.col("rep").alias("doc_id"), "f1", "f2", F.col("key").alias("rep"))
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found = shingle_sets(src.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), sketch=False)
    members = stored(found.join(texts, ["doc_id", "f1", "f2"]).dropDuplicates(["rep"]).select("rep", "members"), "near-members")
    whole = lambda x: x.select(F.col("node").alias("grp"), "rep", F.lit(True).alias("fresh"))

    first = rows.where(F.col("tree") < FIRST_TREES)
    part = whole(first.where(F.col("total") <= leaf)).unionByName(_dealt(first.where(F.col("total") > leaf), leaf))
    links = stored(_compare(_one_of_each(_with_components(part, None)), members, share), "near-links")
    known = stored(components(links), "near-components")

    later = rows.where((F.col("tree") >= FIRST_TREES) | (F.col("total") > leaf))
    later = stored(_differing(_with_components(later, known), "node").drop("comp"), "near-later")

    def linked(part):
        """Compare the groups of ``part``; links and components then hold what was found."""
        nonlocal links, known
        links = links.unionByName(stored(_compare(part, members, share), "near-links"))
        known = stored(components(links), "near-components")

    def apart(nodes):
        return stored(_outside(_with_components(nodes, known)), "near-later")

    few, many = 2 * F.col("outside") <= leaf, 2 * F.col("outside") > leaf
    linked(_one_of_each(_with_components(whole(later.where(F.col("total") <= leaf)), known)))
    large = apart(later.where(F.col("total") > leaf))
    sets = members.join(large.where(many).select("rep", "load").distinct(), "rep").select("rep", "load", "members")
    crowd = not large.where(many).isEmpty()
    if not large.where(few).isEmpty():
        linked(_outsiders(large.where(few), leaf))
    sets = stored(sets, "near-crowd") if crowd else sets
    done, depth = 0, DEPTH
    while crowd and done < trees_at(depth, share):
        upto, level, parts, exact = trees_at(depth, share), DEPTH, [], []
        nodes = _paths(sets, [seeded(6, t) for t in range(done, upto)], _counted)
        while True:
            here = apart(_sized(nodes.distinct()))
            small = F.col("total") <= leaf
            parts.append(whole(here.where(small)))
            exact.append(here.where(~small & few))
            large = here.where(~small & many)
            if level >= DEEPEST or large.isEmpty():
                break
            level, nodes = level + DEEPER, _branch(large, members)
        parts.append(_dealt(large, leaf))
        linked(_one_of_each(_with_components(reduce(DataFrame.unionByName, parts), known)))
        left = apart(reduce(DataFrame.unionByName, [*exact, large]).drop("comp", "top", "outside"))
        if not left.isEmpty():
            linked(_outsiders(left, leaf))
        done, depth = upto, max(depth, level)
    classed = _with_components(per_class.select("f1", "f2", "n_shingles", F.col("key").alias("rep"), F.col("rep").alias("least")), known)
    least = classed.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = classed.join(least, "comp").select("f1", "f2", "n_shingles", "component_id")
    out = base.select("doc_id", "n_shingles", "f1", "f2").join(ids, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _dealt(large: DataFrame, leaf: int) -> DataFrame:
    """Nodes too large, dealt into blocks of about ``leaf`` shingles, another deal for each tree."""
    block = F.pmod(F.xxhash64("rep", "tree", "node"), F.ceil(F.col("total") / leaf))
    return large.select(F.xxhash64("node", block).alias("grp"), "rep", F.lit(True).alias("fresh"))


def _outside(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold different components, with the node's largest one and the shingles outside it."""
    by = rows.groupBy("node", "comp").agg(F.sum("load").alias("n")).groupBy("node")
    by = by.agg(F.max(F.struct("n", "comp"))["comp"].alias("top"), (F.sum("n") - F.max("n")).alias("outside"))
    return rows.join(by.where("outside > 0"), "node")


def _outsiders(rows: DataFrame, leaf: int) -> DataFrame:
    """Blocks of sets outside their node's largest component, each with every block of the node."""
    k, outer = F.ceil(2 * F.col("total") / leaf), F.ceil(2 * F.col("outside") / leaf)
    marked = rows.withColumn("fresh", F.col("comp") != F.col("top")).withColumn("k", k).withColumn("n_outer", outer)
    own = ["node", "rep", "comp", "fresh"]
    mine = marked.where("fresh").select(*own, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("inner"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n_outer")).alias("outer"))
    theirs = marked.select(*own, F.pmod(F.xxhash64("rep"), F.col("k")).alias("inner"), F.explode(F.sequence(F.lit(0), F.col("n_outer") - 1)).alias("outer"))
    rows = mine.unionByName(theirs).dropDuplicates(["node", "rep", "inner", "outer"])
    return rows.select(F.xxhash64("node", "inner", "outer").alias("grp"), "rep", "comp", "fresh")


def near_duplicates(docs: DataFrame, share: int = 75) -> DataFrame:
    """``near_components`` with kept: the first document of each component, and those linked with nothing."""
    out = near_components(docs, share)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
