"""Merkle manifest of a table: a root over the subroots of its parts, and for every row a proof that a folded row is checked with.

A row's leaf is the sha256 of its columns, each written as its UTF-8 length, a colon and the value, or `-` for null.  The leaves of
a part stand in the order of their keys; every ARITY consecutive nodes (fewer in the last run) are hashed to one until one remains,
the part's subroot.  Subroots, in the order of their parts, are hashed in the same way to the root.

Places come from a range partitioning: a row's place in its partition plus the counts of the partitions before.  A superblock is
ARITY ** DEPTH consecutive nodes.  Going up, every superblock is reduced to one node by itself, until a part has one left.  Going
down, the nodes of a superblock are cogrouped with the one row of outer nodes that the superblock needs (the siblings of its
ancestors): the group finishes its own levels, joins the proofs and folds every altered leaf.  No task sees more than one superblock.

Defined results: nulls in any column, the key and the part too, are values of their own (null keys and null parts come first); rows
with equal keys stand in the order of their leaves, and repeated rows are leaves of their own; an empty text has length 0; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.skew import small_side
from .work import stash

ARITY = 8
DEPTH = 4
SUPER = ARITY ** DEPTH
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values: Sequence[Column]) -> Column:
    """sha256 of length-prefixed values; a null is `-`."""
    written = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*written), 256)


def levels(n: int) -> int:
    """How often n nodes are reduced until one remains."""
    depth = 0
    while n > 1:
        n, depth = -(-n // ARITY), depth + 1
    return depth


def numbered(nodes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The nodes, stored, with idx, a node's place in its part, and n, the part's size.  Columns: part, node and others."""
    place = F.monotonically_increasing_id()
    ranged = stash(nodes.repartitionByRange("part", *order).sortWithinPartitions("part", *order).withColumn("place", place)
                   .withColumn("piece", F.shiftright("place", 33)), "ranged")
    pieces = ranged.groupBy("part", "piece").agg(F.count("*").alias("rows"), F.min("place").alias("first"))  # at most parts + partitions
    window = Window.partitionBy("part")
    pieces = pieces.select("part", "piece", (F.sum("rows").over(window.orderBy("piece")) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(window).alias("n"))
    return ranged.join(small_side(stash(pieces, "pieces")), ["part", "piece"]).withColumn("idx", F.col("place") + F.col("shift")).drop("place", "piece", "shift")


def local_levels(nodes: list[str], depth: int) -> list[list[str]]:
    """The nodes of a superblock and of each level above them, the last one a single node."""
    out = [nodes]
    for _ in range(depth):
        out.append([sha("".join(out[-1][i:i + ARITY])) for i in range(0, len(out[-1]), ARITY)])
    return out


def local_path(tree: list[list[str]], i: int) -> list[str]:
    """For each level but the last the joined siblings left and right of the ancestor of node i."""
    path = []
    for level in tree[:-1]:
        run = i - i % ARITY
        path += ["".join(level[run:i]), "".join(level[i + 1:run + ARITY])]
        i //= ARITY
    return path


def fold(node: str, path: Sequence[str]) -> str:
    """The root that a node and its siblings lead to."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        node = sha(left + node + right)
    return node


def up(nodes: DataFrame) -> DataFrame:
    """One node for every superblock: (part, idx, n, node)."""
    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        n = int(group["n"].iloc[0])
        top = local_levels(group["node"].tolist(), min(DEPTH, levels(n)))[-1]
        return pd.DataFrame({"part": group["part"].iloc[0], "idx": group["block"].iloc[0], "n": -(-n // SUPER), "node": top})

    blocks = nodes.select("part", "idx", "n", "node", F.expr(f"idx div {SUPER}").alias("block"))
    return blocks.groupBy("part", "block").applyInPandas(join, "part string, idx bigint, n bigint, node string")


def down(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """(part, idx, path, subroot, root) of nodes from those of the level above: (part, idx, path, subroot, root)."""
    def join(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("idx")
        tree = local_levels(inner["node"].tolist(), min(DEPTH, levels(int(inner["n"].iloc[0]))))
        rest = list(above["path"].iloc[0])
        return pd.DataFrame({"part": inner["part"], "idx": inner["idx"], "path": [local_path(tree, i) + rest for i in range(len(inner))],
                             "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0]})

    blocks = nodes.select("part", "idx", "n", "node", F.expr(f"idx div {SUPER}").alias("block"))
    return blocks.groupBy("part", "block").cogroup(outer.groupBy("part", "idx")).applyInPandas(join, "part string, idx bigint, path array<string>, subroot string, root string")


def steps(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, and after each round of superblocks those that remain; the last table has one node for each part."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(stash(up(out[-1]), "nodes"))
    return out


def outer_paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows (part, idx, path, subroot, root) that the superblocks of the lowest nodes need, from those of the parts' last nodes."""
    for nodes in reversed(rounds[1:-1]):
        tops = stash(down(nodes, tops), "paths")
    return tops


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, columns: Sequence[str] = COLUMNS, key: str = "doc_id", part: str = "lang") -> DataFrame:
    """Per row: key, leaf, subroot, root, proof (siblings up to the root, joined), folded_root and verified.

    `altered` gives other values for some columns; a row whose leaf differs with them is folded with that leaf, all siblings as they were.
    """
    altered = altered or {}
    leaf = leaf_of([F.col(c) for c in columns])
    differs = reduce(lambda a, b: a | b, [~new.eqNullSafe(F.col(c)) for c, new in altered.items()], F.lit(False))
    other = F.when(differs, leaf_of([altered.get(c, F.col(c)) for c in columns]))
    named = F.when(F.col(part).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(part).cast("string")))  # null first, then by bytes
    rows = docs.select(named.alias("part"), F.col(key).alias("key"), leaf.alias("node"), other.alias("altered"))
    leaves = numbered(rows, ["key", "node", "altered"])

    rounds = steps(leaves)
    ends = rounds[-1].select(F.lit("").alias("part"), F.col("part").alias("own"), "node")  # one row for each part
    ends = numbered(ends, ["own"])
    above = steps(ends)
    empty = F.array().cast("array<string>")
    tops = above[-1].select("part", F.lit(0).cast("bigint").alias("idx"), empty.alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    paths = outer_paths(above, tops)
    if len(above) > 1:
        paths = down(ends, paths)
    paths = paths.join(ends.select("idx", "own", F.col("node").alias("end")), "idx")  # as many rows as parts
    tops = stash(paths.select(F.col("own").alias("part"), F.lit(0).cast("bigint").alias("idx"), "path", F.col("end").alias("subroot"), "root"), "paths")
    outer = outer_paths(rounds, tops)

    def finish(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("idx")
        tree = local_levels(inner["node"].tolist(), min(DEPTH, levels(int(inner["n"].iloc[0]))))
        rest, proofs, folded = list(above["path"].iloc[0]), [], []
        for i, (node, new) in enumerate(zip(inner["node"], inner["altered"], strict=True)):
            path = local_path(tree, i) + rest
            proofs.append("".join(path))
            folded.append(fold(new if isinstance(new, str) else node, path))
        root = above["root"].iloc[0]
        return pd.DataFrame({"key": inner["key"], "leaf": inner["node"], "subroot": above["subroot"].iloc[0], "root": root, "proof": proofs, "folded_root": folded,
                             "verified": [f == root for f in folded]})

    blocks = leaves.select("part", F.col("key").cast("string").alias("key"), "idx", "n", "node", "altered", F.expr(f"idx div {SUPER}").alias("block"))
    done = blocks.groupBy("part", "block").cogroup(outer.groupBy("part", "idx")).applyInPandas(
        finish, "key string, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
    return done.withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)
