"""A Merkle manifest of a table: checkpointed levels, proofs by recomputation.

Rows are leaves of one tree per group, and the groups' roots are leaves of a
top tree. Only every ``every`` levels are written: a node of a written level
stands for an aligned subtree of ``8 ** every`` nodes of the written level
below. Whoever needs the levels between regenerates them inside such a subtree,
takes the siblings of its nodes and drops them again. So a proof costs one
grouping by subtree for each written level, the manifest holds few nodes
besides the leaves, and no task ever holds more than one subtree at a time.

Digests are lowercase hex SHA-256 and are concatenated as hex text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellgrid.llm.store import stored

#: Nodes whose digests one parent takes.
ARITY = 8
_PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def digest_of(columns: list[Column]) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 length, a colon and the value."""
    said = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*said), 256)


def joined_digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


@dataclass
class Tree:
    """Written levels of the trees of all groups, the leaves first.

    Each has the columns tree, pos, n (nodes of its tree on that level) and
    digest; the leaves also carry the rows' own columns. A tree's root is its
    node on the first written level where n is 1.
    """

    levels: list[DataFrame]
    every: int

    def roots(self) -> DataFrame:
        """tree, root; one row per tree."""
        return reduce(DataFrame.unionByName, [level.where("n = 1").select("tree", F.col("digest").alias("root")) for level in self.levels])


@dataclass
class Manifest:
    rows: Tree
    top: Tree


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add pos, the place in the row's tree under ``order``, and n, the tree's rows.

    Sorted slices of even size number themselves; what stands before a slice of
    a tree comes from one row per slice and tree. Rows that ``order`` can't tell
    apart must be alike.
    """
    sliced = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    sliced = stored(sliced.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")  # runs on inside a slice
    ends = sliced.groupBy("tree", F.shiftright("at", 33).alias("slice")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(_window(("tree",), "slice").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("tree", "slice", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(_window(("tree",))).alias("n"))
    out = sliced.withColumn("slice", F.shiftright("at", 33)).join(ends, ["tree", "slice"])
    return out.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).select(*rows.columns, "pos", "n")


def _window(keys: tuple[str, ...], *order: str):
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w


def _subtrees(level: DataFrame, every: int, columns: list[str]) -> DataFrame:
    """Aligned subtrees of a written level: tree, up (their own place), n, nodes in order."""
    nodes = F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("nodes")
    return level.where("n > 1").groupBy("tree", F.floor(F.col("pos") / ARITY**every).alias("up"), "n").agg(nodes)


def _runs(digests: Column) -> Column:
    """The parents of neighbouring digests."""
    first = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / ARITY).cast("int"))
    return F.transform(first, lambda i: joined_digest(F.slice(digests, i * ARITY + 1, F.lit(ARITY))))


def _with_levels(trees: DataFrame, every: int) -> DataFrame:
    """Add s0 .. s<every>, a subtree's digests on each of its levels, from those of its stored nodes.

    One is null where the tree ends below that level."""
    out = trees.withColumn("s0", F.transform("nodes", lambda x: x["digest"]))
    for j in range(every):
        runs = _runs(F.col(f"s{j}"))
        out = out.withColumn(f"s{j + 1}", F.when(F.col("n") > ARITY**j, runs))
    return out


def grow(leaves: DataFrame, every: int) -> Tree:
    """Write the levels above ``leaves`` (tree, pos, n, digest and more), every few one."""
    levels = [stored(leaves, "merkle-leaves")]
    most = levels[0].agg(F.max("n")).first()[0] or 1
    while most > 1:
        up = _with_levels(_subtrees(levels[-1], every, ["digest"]), every)
        top = F.coalesce(*[F.col(f"s{j}") for j in range(every, 0, -1)])[0]
        n = F.ceil(F.col("n") / ARITY**every).cast("long")
        levels.append(stored(up.select("tree", F.col("up").alias("pos"), n.alias("n"), top.alias("digest")), "merkle-level"))
        most = -(-most // ARITY**every)
    return Tree(levels, every)


def build(rows: DataFrame, group: Column, order: list[str], every: int = 2) -> Manifest:
    """Trees over ``rows``, which hold their digest in ``digest``, and the tree over their roots.

    Trees are ordered by ``group`` as UTF-8 bytes, null first; leaves by
    ``order`` (null first), then digest. Repeated rows are leaves each.
    """
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    leaves = rows.withColumn("tree", tree)
    own = grow(ranked(leaves, [*order, "digest"]), every)
    roots = own.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    return Manifest(own, grow(ranked(roots, ["name"]), every))


def _sibling_paths(tree: Tree, above: DataFrame, columns: list[str]) -> DataFrame:
    """Leaves with the sibling digests of all levels up to the root of ``above``.

    ``above`` has a row per tree: tree, path and what else its leaves get. A
    path is an array of (left, right): what stands before and after the node in
    its run, from the leaf's level upwards.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]

    def ended(level: DataFrame, named: list[str]) -> DataFrame:
        return level.where("n = 1").join(above, "tree").select("tree", "pos", *named, "path", *extra)

    def down(level: DataFrame, paths: DataFrame, named: list[str]) -> DataFrame:
        trees = _with_levels(_subtrees(level, tree.every, sorted({"digest", *named})), tree.every)
        trees = trees.join(paths.select("tree", F.col("pos").alias("up"), "path", *extra), ["tree", "up"])

        def beside(j: int, place: Column) -> Column:
            at = F.floor(place / ARITY**j).cast("int")
            own = F.pmod(at, F.lit(ARITY))
            left, right = F.slice(F.col(f"s{j}"), at - own + 1, own), F.slice(F.col(f"s{j}"), at + 2, ARITY - 1 - own)
            return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

        def child(node: Column, i: Column) -> Column:
            there = F.filter(F.array(*[F.when(F.col("n") > ARITY**j, beside(j, i)) for j in range(tree.every)]), lambda x: x.isNotNull())
            return F.struct(node["pos"].alias("pos"), *[node[c].alias(c) for c in named], F.concat(there, F.col("path")).alias("path"))

        made = trees.select("tree", *extra, F.explode(F.transform("nodes", child)).alias("node"))
        return made.select("tree", "node.*", *extra)

    paths = ended(tree.levels[-1], columns if len(tree.levels) == 1 else [])
    for k in range(len(tree.levels) - 2, -1, -1):
        level, named = tree.levels[k], columns if k == 0 else []
        paths = down(level, paths, named).unionByName(ended(level, named))
    return paths


def proofs(manifest: Manifest, columns: list[str]) -> DataFrame:
    """Every leaf's ``columns``, digest, path, subroot and root.

    The path leads over the tree's root to that of the top tree. A lone leaf of
    a lone tree has an empty path.
    """
    root = manifest.top.roots().select("tree", "root", F.array().cast(_PATH).alias("path"))
    tops = _sibling_paths(manifest.top, root, ["name", "digest"])
    above = stored(tops.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "merkle-tops")
    return _sibling_paths(manifest.rows, above, [*columns, "digest"]).drop("tree", "pos")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path give."""
    return F.aggregate(path, digest, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level."""
    return joined_digest(F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def verify(docs: DataFrame, columns: list[str], group: str, order: str, claim: Column | None = None, every: int = 2) -> DataFrame:
    """Manifest of ``docs``, a proof per row, and the root that ``claim`` leads to.

    Leaves are ``columns`` in this order; ``claim`` is the digest put to the
    proof, the leaf itself if not given. Columns: the order column, leaf,
    subroot, root, path, folded_root. Null values, groups and orders are values
    of their own, a null group is a tree; texts count whole. Rows that repeat
    the order column follow by digest; equal rows are leaves each. No rows give
    no rows. Other columns of ``docs`` are not read.
    """
    leaf = digest_of([docs[c] for c in columns])
    rows = docs.select(docs[order].alias("key"), docs[group].alias("group"), leaf.alias("digest"), (leaf if claim is None else claim).alias("claim"))
    manifest = build(stored(rows, "merkle-rows"), F.col("group"), ["key"], every)
    out = proofs(manifest, ["key", "claim"])
    return out.select(F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path", fold(F.col("claim"), F.col("path")).alias("folded_root"))
