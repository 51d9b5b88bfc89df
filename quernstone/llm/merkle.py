"""Merkle manifest of a table: a leaf a row, binary trees for each group, a tree over the groups' roots, a proof for each leaf.

Leaves are numbered in order (two passes over written ranges, no sort in one task) and cut into aligned blocks of ``BLOCK``. A
task walks a block's tree in postorder: each call returns its subtree's digest and, while unwinding, appends the sibling's digest
to every leaf below. The blocks' roots are the leaves of the next such traversal, and so on until each group has one node; paths
of the levels above are joined down by block. A block is ``BLOCK`` rows of digests, however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import row_key, written
from quernstone.operators.numbering import numbered

#: Leaves of a block: a power of two.
HEIGHT = 10
BLOCK = 1 << HEIGHT
#: Paths of the upper levels (at most about 5 kB each) that are broadcast.
BROADCAST_PATHS = 10_000


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(c: str | Column) -> Column:
    """A value in a leaf: ``-`` if null, else its bytes' number, a colon and itself."""
    v = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_digest(fields: Sequence[str | Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def postorder(leaves: Sequence[str], height: int) -> tuple[str, list[str], list[str]]:
    """The root over ``leaves`` (at most 2 ** height), and for each leaf its siblings' digests and sides, leaf to root.

    Sides: ``L`` / ``R``, where the sibling stands; ``-``: the node has none and is hashed alone.
    """
    siblings, sides = [""] * len(leaves), [""] * len(leaves)

    def below(low: int, high: int, level: int) -> str:
        if level == 0:
            return leaves[low]
        mid = min(low + (1 << (level - 1)), high)
        left = below(low, mid, level - 1)
        if mid == high:
            for i in range(low, high):
                sides[i] += "-"
            return digest(left)
        right = below(mid, high, level - 1)
        for i in range(low, mid):
            siblings[i] += right
            sides[i] += "R"
        for i in range(mid, high):
            siblings[i] += left
            sides[i] += "L"
        return digest(left + right)

    return below(0, len(leaves), height), siblings, sides


def fold(leaf: str, siblings: str, sides: str) -> str:
    """The root that a leaf and its path lead to."""
    at = 0
    for side in sides:
        if side == "-":
            leaf = digest(leaf)
            continue
        other = siblings[at : at + 64]
        at += 64
        leaf = digest(other + leaf) if side == "L" else digest(leaf + other)
    return leaf


def _walked(nodes: DataFrame, tag: str) -> DataFrame:
    """``nodes``: ``tree, pos, digest, total`` and more columns; adds ``block, siblings, sides`` and, at the block's first node, ``above`` (its root)."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        height = min(HEIGHT, int(pdf["total"].iloc[0] - 1).bit_length())
        root, siblings, sides = postorder(pdf["digest"].tolist(), height)
        return pdf.assign(siblings=siblings, sides=sides, above=[root] + [None] * (len(pdf) - 1))

    cut = nodes.withColumn("block", F.shiftright("pos", HEIGHT))
    kind = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", siblings string, sides string, above string"
    return written(cut.groupBy("tree", "block").applyInPandas(walk, kind), tag)


def _sized(paths: DataFrame) -> DataFrame:
    return F.broadcast(paths) if paths.count() <= BROADCAST_PATHS else paths


def merkle_trees(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes``: ``tree`` (not null)``, pos`` (0, 1, ... within the tree)``, digest, total`` (of the tree) and more columns.

    Returns the nodes with ``block, siblings, sides`` within their block, and for each ``tree, block`` the rest of the path:
    ``up_siblings, up_sides, tree_root``.
    """
    levels = [_walked(nodes, "merkle")]
    most = levels[0].agg(F.max("total")).first()[0] or 0
    while most > BLOCK:
        most = -(-most // BLOCK)
        above = levels[-1].where("above is not null")
        up = above.select("tree", F.col("block").alias("pos"), F.col("above").alias("digest"), F.shiftright(F.col("total") + (BLOCK - 1), HEIGHT).alias("total"))
        levels.append(_walked(up, "merkle"))
    first = lambda w: w.where("above is not null").select("tree", "block", "above")
    paths = first(levels[-1]).select("tree", "block", F.lit("").alias("up_siblings"), F.lit("").alias("up_sides"), F.col("above").alias("tree_root"))
    for level in levels[:0:-1]:
        on = level.select("tree", "pos", "block", "siblings", "sides").join(_sized(paths), ["tree", "block"])
        paths = on.select("tree", F.col("pos").alias("block"), F.concat("siblings", "up_siblings").alias("up_siblings"), F.concat("sides", "up_sides").alias("up_sides"), "tree_root")
    return levels[0], paths


def merkle_manifest(docs: DataFrame, fields: Sequence[str], id_col: str, group_col: str, seen: Mapping[str, Column] | None = None) -> DataFrame:
    """A row for each row of ``docs``: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``, and ``siblings, sides`` (the whole path).

    Leaves of a group (null is one) ascend by id, null ids first, ties by digest, then by place in the table (rows alike have
    the same leaf, at several places). A lone leaf is its group's root, and a lone group's root is the root. Groups are ordered by
    their text, bytewise, null first. ``seen`` holds values that columns have now, to be verified against the manifest: the leaf
    of these is folded with the original's path. Columns besides ``fields``, id and group don't count.
    """
    keyed = row_key(docs)
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    now = leaf_digest([(seen or {}).get(c, c) for c in fields])
    leaves = keyed.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf_digest(fields).alias("digest"), now.alias("found"), "__file", "__row")
    leaves = leaves.withColumn("found", F.when(F.col("found") != F.col("digest"), F.col("found"))).withColumnsRenamed({"__file": "place", "__row": "row"})
    leaves = written(leaves, "leaves")  # texts are read and hashed once
    n = numbered(leaves, ["id", "digest", "place", "row"], "pos", by=["tree"], start=0, total="total").drop("place", "row")
    low, paths = merkle_trees(n)
    paths = written(paths, "paths")
    roots = paths.groupBy("tree").agg(F.first("tree_root").alias("digest"))  # the same in each of a tree's paths
    tops = numbered(roots, ["tree"], "pos", start=0, total="total").select(F.col("tree").alias("name"), F.lit("").alias("tree"), "pos", "digest", "total")
    top, rest = merkle_trees(tops)
    ends = top.join(_sized(rest), ["tree", "block"]).select(F.col("name").alias("tree"), F.concat("siblings", "up_siblings").alias("t_siblings"), F.concat("sides", "up_sides").alias("t_sides"), F.col("tree_root").alias("root"))
    paths = paths.join(_sized(written(ends, "ends")), "tree")
    paths = paths.select("tree", "block", F.concat("up_siblings", "t_siblings").alias("up_siblings"), F.concat("up_sides", "t_sides").alias("up_sides"), F.col("tree_root").alias("subroot"), "root")
    whole = low.join(_sized(written(paths, "paths")), ["tree", "block"])
    whole = whole.select("id", F.col("digest").alias("leaf"), "found", "subroot", "root", F.concat("siblings", "up_siblings").alias("siblings"), F.concat("sides", "up_sides").alias("sides"))

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaf = pdf["found"].where(pdf["found"].notna(), pdf["leaf"])
            yield pdf.drop(columns="found").assign(proof_sha256=[digest(s) for s in pdf["siblings"]], folded_root=[fold(*x) for x in zip(leaf, pdf["siblings"], pdf["sides"], strict=True)])

    kind = dict(whole.dtypes)["id"]
    out = whole.mapInPandas(folded, f"id {kind}, leaf string, subroot string, root string, siblings string, sides string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
