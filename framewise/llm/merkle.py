"""Merkle manifest of a dataset: a tree per language, a tree over these, and a proof per document by pointer jumping.

Every document is a leaf, the digest of its columns. The leaves of a language, by ascending id, are the base of a
binary tree whose last node is hashed alone where a level is odd; the roots of the languages are the base of one
more tree, whose root commits to all documents.

1. Rank: leaves are range-partitioned by (language, id, leaf), numbered inside their partition, and shifted by the
   counts of the partitions before, so that no language has to fit in a task.
2. Fold: aligned blocks of 1,024 nodes give ten levels in one task; their roots are the nodes of the next round.
   Every node is written with its sibling and the key of its parent.
3. Jump: a node holds the segment of siblings towards an ancestor. A self-join of the nodes appends the ancestor's
   segment, which doubles the distance, until every leaf holds its siblings up to the root. After a join over the
   distance ``d`` only nodes of levels divisible by ``2 d`` are still anybody's ancestor, and others are left out.

Segments are bytes: per level one for the side of the sibling and 32 for its digest.

Defined results
    a null column counts as ``-``, an empty text as the text of no bytes; rows are ordered by ``doc_id``, null first,
    then by their leaf; equal rows are leaves each, in any order, since they are the same; a language of one document
    has that leaf as its root; null is a language, before all others; the proof of a leaf without siblings is the
    digest of nothing; an empty table has no root and gives no rows; further columns are neither hashed nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.shared import Scratch, columns
from framewise.plans.blocks import join_per_key

#: Levels folded in one task: blocks of 1,024 nodes.
LEVELS = 10
#: The key of the tree over the languages; theirs are their ranks.
TOP = -1
#: Bytes of a segment per level: side and digest.
STEP = 33
ALONE, SIBLING_RIGHT, SIBLING_LEFT = 0, 1, 2
#: So many nodes or roots, of at most a few hundred bytes each, go to every task; more are joined by their keys.
FEW = 10_000
KINDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}


def leaf(**changed: Column) -> Column:
    """The digest of the columns of a document; ``changed`` replaces some of them."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(part(name) for name in KINDS)), 256))


def more_chars() -> Column:
    """One more than ``n_chars``, beyond the largest long too."""
    return F.col("n_chars").cast("decimal(20,0)") + 1


def ranked(df: DataFrame, scratch: Scratch, part: str, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``idx``, the place of a row among those of its group, and ``size``, their number.

    ``by`` and ``order`` must not leave two rows equal. No group has to fit in a task.
    """
    spread = df.repartitionByRange(*by, *order).withColumn("range_part", F.spark_partition_id())
    placed = scratch.keep(spread, part)
    own = ["range_part", *by]
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition and group of it.
    counts = placed.groupBy(*own).agg(F.count(F.lit(1)).alias("here"))
    counts = counts.select(*own, F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(group).alias("size"))
    local = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    return local.join(counts, own).withColumn("idx", (F.col("before") + F.col("nth") - 1).cast("long")).drop("range_part", "before", "nth")


NODE = "tree long, level int, idx long, up_tree long, up_level int, up_idx long, done boolean, path binary, size long, digest binary, top boolean"


def fold(nodes: DataFrame, base: int, top_height: int) -> DataFrame:
    """Up to ``LEVELS`` levels over nodes (tree, idx, size, digest) of level ``base``, where ``size`` is the number of the
    tree's leaves: a row per node below with its sibling and its parent, and one per block with the digest above it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, block = key[0].as_py(), key[1].as_py()
        size = table["size"][0].as_py()
        height = (size - 1).bit_length()
        order = np.argsort(table["idx"].to_numpy())
        digests = table["digest"].take(pa.array(order)).to_pylist()
        first, levels = block << LEVELS, min(LEVELS, height - base)
        rows: list[tuple] = []
        for level in range(base, base + levels):
            ends = level + 1 == height
            above = []
            for i in range(0, len(digests), 2):
                pair = digests[i : i + 2]
                above.append(hashlib.sha256("".join(d.hex() for d in pair).encode()).digest())
                up = (TOP, 0, tree) if ends and tree != TOP else (tree, level + 1, (first + i) >> 1)
                done = ends and (tree == TOP or top_height == 0)
                for k in range(len(pair)):
                    side = ALONE if len(pair) == 1 else SIBLING_LEFT if k else SIBLING_RIGHT
                    path = bytes([side]) + (pair[1 - k] if side else bytes(32))
                    rows.append((tree, level, first + i + k, *up, done, path, None, None, None))
            digests, first = above, first >> 1
        rows.append((tree, base + levels, first, *[None] * 5, size, digests[0], base + levels == height))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()]
        names = [field.split()[0] for field in NODE.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    block = F.shiftright("idx", LEVELS).alias("block")
    return nodes.select("tree", "idx", "size", "digest").groupBy("tree", block).applyInArrow(run, NODE)


def grow(nodes: DataFrame, scratch: Scratch, name: str, height: int, top_height: int) -> tuple[DataFrame, DataFrame]:
    """All nodes but the roots, and the roots (tree, digest), of trees up to ``height`` levels high."""
    below, roots = [], []
    for base in range(0, max(height, 1), LEVELS):
        folded = scratch.keep(fold(nodes, base, top_height), f"{name}{base}")
        below.append(folded.where("digest is null").drop("size", "digest", "top"))
        roots.append(folded.where("top").select("tree", "digest"))
        nodes = folded.where("not top")
    return reduce(DataFrame.unionByName, below), reduce(DataFrame.unionByName, roots)


POINTER = ["up_tree", "up_level", "up_idx"]


def jump(walkers: DataFrame, nodes: DataFrame, many: int) -> DataFrame:
    """Appends to every walker the segment of the node it points at, and takes over that node's pointer.

    ``many`` nodes at most: where there are few, each is the ancestor of a large part of the leaves.
    """
    ahead = nodes.select(
        *(F.col(own).alias(up) for own, up in zip(("tree", "level", "idx"), POINTER, strict=True)),
        *(F.col(c).alias(f"next_{c}") for c in (*POINTER, "done", "path")),
    )
    joined = walkers.join(F.broadcast(ahead) if many <= FEW else ahead, POINTER)
    kept = [c for c in walkers.columns if c not in (*POINTER, "done", "path")]
    return joined.select(
        *kept, *(F.col(f"next_{c}").alias(c) for c in (*POINTER, "done")), F.concat("path", "next_path").alias("path")
    )


def proofs(leaves: DataFrame, nodes: DataFrame, scratch: Scratch, depth: int) -> DataFrame:
    """``leaves``, which point at their own node, with their siblings up to the root as ``path``."""
    ended, distance, many = [leaves.where("done")], 1, nodes.count()
    leaves = scratch.keep(jump(leaves.where("not done"), nodes, many), "leaves")
    while distance < depth:
        ended.append(leaves.where("done"))
        # Leaves are at level 0, so that they point at levels the distance divides.
        ahead = nodes.where((F.col("tree") == TOP) | (F.col("level") % (2 * distance) == distance))
        leaves = scratch.keep(jump(leaves.where("not done"), ahead, many), f"leaves_{2 * distance}")
        distance *= 2
        if distance < depth:
            asked = nodes.where((F.col("tree") == TOP) | ((F.col("level") > 0) & (F.col("level") % distance == 0)))
            nodes = scratch.keep(jump(asked.where("not done"), nodes, many).unionByName(asked.where("done")), f"nodes_{distance}")
            many = nodes.count()
    return reduce(DataFrame.unionByName, [*ended, leaves.where("done")])


def _at(path: str, i: Column) -> tuple[Column, Column]:
    """Side and digest (hex) of a level of a path."""
    step = F.hex(F.substring(F.col(path), i * STEP + 1, F.lit(STEP)))
    return F.substring(step, 1, 2), F.lower(F.substring(step, 3, 64))


def _levels(path: str) -> Column:
    many = (F.length(path) / STEP).cast("int")
    return F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))


def fold_path(start: Column, path: str = "path") -> Column:
    """The root (hex) that a leaf of digest ``start`` (hex) has with these siblings."""

    def up(below: Column, i: Column) -> Column:
        side, other = _at(path, i)
        return F.sha2(F.when(side == "01", F.concat(below, other)).when(side == "02", F.concat(other, below)).otherwise(below), 256)

    return F.aggregate(_levels(path), start, up)


def path_digest(path: str = "path") -> Column:
    """The digest (hex) of all siblings of a path, from the leaf up."""
    parts = F.transform(_levels(path), lambda i: F.when(_at(path, i)[0] == "00", F.lit("")).otherwise(_at(path, i)[1]))
    return F.sha2(F.array_join(parts, ""), 256)


def manifest(docs: DataFrame, scratch: Scratch, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root (hex), path and the ``carry`` columns, which are computed from the row, per document."""
    carry = dict(carry or {})
    # Sorts as the language does, null first, and is never null.
    group = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang")).alias("tree_name")
    rows = columns(docs, **KINDS)
    # The last order of equal rows; written, so that it stays.
    rows = rows.select("doc_id", group, leaf().alias("leaf"), *(c.alias(name) for name, c in carry.items()), F.monotonically_increasing_id().alias("row_no"))
    rows = ranked(scratch.keep(rows, "rows"), scratch, "placed", ["tree_name"], ["doc_id", "leaf", "row_no"])
    rows = scratch.keep(rows.drop("row_no"), "ranked")
    names = rows.groupBy("tree_name").agg(F.max("size").alias("size"))
    names = ranked(scratch.keep(names, "sizes").withColumnRenamed("size", "leaves"), scratch, "names", [], ["tree_name"])
    names = scratch.keep(names.select("tree_name", "leaves", F.col("idx").alias("tree"), F.col("size").alias("trees")), "trees")
    largest, trees = names.agg(F.max("leaves"), F.max("trees")).first()
    kept = {name: dict(rows.dtypes)[name] for name in carry}
    if not trees:
        fields = ["doc_id long", "leaf string", "subroot string", "root string", "path binary", *(f"{n} {k}" for n, k in kept.items())]
        return docs.sparkSession.createDataFrame([], ", ".join(fields))
    height, top_height = (largest - 1).bit_length(), (trees - 1).bit_length()
    rows = join_per_key(rows, names.select("tree_name", "tree"), "tree_name", "idx").drop("tree_name")
    base = rows.select("tree", "idx", "size", F.col("leaf").alias("digest"))
    below, subroots = grow(base, scratch, "tree", height, top_height)
    tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("size"), "digest")
    above, roots = grow(tops, scratch, "top", top_height, top_height)
    alone = F.col("size") == 1
    walkers = rows.select(
        "doc_id", "leaf", *carry, F.col("tree").alias("own_tree"), F.when(alone, TOP).otherwise(F.col("tree")).alias("up_tree"),
        F.lit(0).alias("up_level"), F.when(alone, F.col("tree")).otherwise(F.col("idx")).alias("up_idx"),
        (alone & F.lit(top_height == 0)).alias("done"), F.lit(b"").alias("path"),
    )
    found = proofs(walkers, below.unionByName(above), scratch, height + top_height)
    root = roots.first()["digest"].hex()
    subroots = subroots.select(F.col("tree").alias("own_tree"), F.lower(F.hex("digest")).alias("subroot"))
    found = found.join(F.broadcast(subroots), "own_tree") if trees <= FEW else join_per_key(found, subroots, "own_tree", "leaf")
    return found.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", F.lit(root).alias("root"), "path", *carry)
