"""A Merkle manifest of documents, and what each tampered document does to it.

A source's leaves are numbered in order. A task builds the tree over an aligned block of 4,096 leaves (three levels of 16)
as a persistent tree: a changed leaf makes a version that shares all nodes but its ancestors. Block roots are merged level
by level as DataFrames; then each block gets its way up, the siblings at every level to the root, and the versions of its
leaves go on along it wherever the block's task runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import cut, shared_path

FAN = 16
#: Levels of a block, and so leaves.
LEVELS = 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**values: Column) -> Column:
    """The digest of a leaf's fields in the given order, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values.values())), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf_table(docs: DataFrame, tampered: Column, change: Column) -> DataFrame:
    """(tree, doc_id, leaf, changed): the digest of each row, and where `tampered` holds that of the row with the text `change`.

    tree stands for the source, so that null is an own one and comes first."""
    own = {c: F.col(c) for c in FIELDS}
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(
        tree.alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(**own).alias("leaf"),
        F.when(tampered, leaf_digest(**(own | {"text": change}))).alias("changed"),
    )


def _written(df: DataFrame, what: str) -> DataFrame:
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with at (from 0, by `order` inside each tree) and n (rows of the tree).

    Rows are dealt by ranges of (tree, order), so that a large tree spreads over many tasks; a range's part of a tree is
    numbered where it lies and moved by the sizes of the parts before it, of which there are as many as ranges and trees.
    """
    rows = _written(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-rows")  # so that equal rows spread too
    keys = ["tree", *order, "tie"]
    placed = _written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()).drop("tie"), "merkle-sorted")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"offset": F.coalesce(F.sum("rows").over(before), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy("tree"))})
    return placed.join(parts.drop("rows"), ["tree", "part"]).withColumn("at", F.col("place") - F.col("first") + F.col("offset")).drop("place", "part", "first", "offset")


def _merged(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Tree:
    """The levels over up to BLOCK digests: levels[0] are the leaves, every run of FAN nodes has a parent, the last has one node.

    Nodes never change. A version for another leaf is the list of its copied ancestors; all else is this tree's.
    """

    def __init__(self, leaves: list[str], depth: int):
        self.levels = [leaves]
        for _ in range(depth):
            below = self.levels[-1]
            self.levels.append([_merged(below[i : i + FAN]) for i in range(0, len(below), FAN)])

    def siblings(self, at: int) -> Iterator[tuple[str, str]]:
        """Of each level upwards: what stands left and right of the leaf's ancestor in its run."""
        for nodes in self.levels[:-1]:
            start = at - at % FAN
            yield "".join(nodes[start:at]), "".join(nodes[at + 1 : start + FAN])
            at //= FAN


def copied_path(digest: str, siblings: list[tuple[str, str]]) -> list[str]:
    """The ancestors that a version copies, from a leaf's digest and its original siblings, upwards."""
    out = []
    for left, right in siblings:
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
        out.append(digest)
    return out


def depth_of(n: int) -> int:
    """Levels above n nodes."""
    depth = 0
    while n > 1:
        n, depth = -(-n // FAN), depth + 1
    return depth


def blocks(leaves: DataFrame) -> DataFrame:
    """(tree, block, n, doc_ids, leaves, changed, root): a row for each aligned block of numbered leaves, in order."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        tree = Tree([x.hex() for x in rows.column("leaf").to_pylist()], min(LEVELS, depth_of(rows.column("n")[0].as_py())))
        lists = [pa.array([rows.column(c).to_pylist()], pa.list_(t)) for c, t in (("doc_id", pa.int64()), ("leaf", pa.binary()), ("changed", pa.binary()))]
        return pa.table([rows.column("tree")[:1], rows.column("block")[:1], rows.column("n")[:1], *lists, pa.array([tree.levels[-1][0]])], ["tree", "block", "n", "doc_ids", "leaves", "changed", "root"])

    keyed = leaves.withColumn("block", F.floor(F.col("at") / BLOCK))
    return keyed.groupBy("tree", "block").applyInArrow(pack, "tree string, block long, n long, doc_ids array<long>, leaves array<binary>, changed array<binary>, root string")


def _up(nodes: DataFrame, most: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Levels of (runs, roots) above nodes (tree, at, n, digest) of trees with up to `most` nodes, and all roots.

    A run has up to FAN children; each level has a FANth of the rows of the one below."""
    levels, roots = [], None
    for _ in range(depth_of(most) + 1):
        done = nodes.where("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        run = nodes.where("n > 1").groupBy("tree", F.floor(F.col("at") / FAN).alias("parent"), "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]).alias("children"))
        run = cut(run)
        levels.append((run, done))
        nodes = run.select("tree", F.col("parent").alias("at"), F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.array_join("children", ""), 256).alias("digest"))
    return levels, roots


def _down(levels: list[tuple[DataFrame, DataFrame]], start: DataFrame) -> DataFrame:
    """(tree, at, path, and start's other columns) of the lowest nodes: path has (left, right) of each level upwards.

    start: (tree, path, ...) of the trees' roots. Each node meets its run once."""
    others = [c for c in start.columns if c not in ("tree", "path")]
    above = None
    for run, done in reversed(levels):
        paths = done.select("tree").join(start, "tree").withColumn("at", F.lit(0).cast("long"))
        if above is not None:
            child = run.join(above.withColumnRenamed("at", "parent"), ["tree", "parent"]).select("*", F.posexplode("children").alias("i", "own"))
            side = lambda a, b: F.array_join(F.slice("children", a, b), "")
            beside = F.struct(side(F.lit(1), F.col("i")).alias("left"), side(F.col("i") + 2, F.lit(FAN)).alias("right"))
            child = child.select("tree", F.concat(F.array(beside), "path").alias("path"), *others, (F.col("parent") * FAN + F.col("i")).alias("at"))
            paths = paths.unionByName(child)
        above = paths
    return above


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of leaf_table().

    A tree's leaves ascend by doc_id (null first), equal ids by their digests; equal rows are leaves of their own. A tree
    with one leaf is that leaf. Trees ascend by their bytes, null first, and merge likewise. Without rows, no rows.
    A task holds a block of leaves; nothing is gathered by source. The intermediate tables stay in the shared folder.
    """
    packed = _written(blocks(numbered(leaves, ["doc_id", "leaf"])), "merkle-blocks")
    nodes = packed.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"))
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    levels, subroots = _up(nodes, most)
    # The tree over the subroots: its leaves are numbered as a single tree's.
    tops = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"])
    tops = cut(tops)
    most = tops.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    top_levels, root = _up(tops.select("tree", "at", "n", "digest"), most)
    first = root.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("root"))
    ways = _down(top_levels, first).join(tops.select("at", "source", F.col("digest").alias("subroot")), "at")
    ways = cut(ways.select(F.col("source").alias("tree"), "path", "subroot", "root"))
    paths = _down(levels, ways).withColumnRenamed("at", "block").withColumnRenamed("root", "whole")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1)
                value = lambda c: block.column(c)[0].as_py()
                ids, leaves, changed, root, subroot = value("doc_ids"), [x.hex() for x in value("leaves")], value("changed"), value("whole"), value("subroot")
                tree = Tree(leaves, min(LEVELS, depth_of(value("n"))))
                upper = [(s["left"], s["right"]) for s in value("path")]
                over = "".join(left + right for left, right in upper)
                proofs, folded = [], []
                for at, (leaf, other) in enumerate(zip(leaves, changed)):
                    inner = list(tree.siblings(at))
                    proofs.append(sha256(("".join(left + right for left, right in inner) + over).encode()).hexdigest())
                    version = copied_path(other.hex() if other is not None else leaf, inner)
                    inner_root = version[-1] if version else other.hex() if other is not None else leaf
                    folded.append(([inner_root] + copied_path(inner_root, upper))[-1])
                same = lambda x: pa.array([x] * len(ids), pa.string())
                columns = [pa.array(ids, pa.int64()), pa.array(leaves), same(subroot), same(root), pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    rows = packed.drop("root").join(paths, ["tree", "block"]).drop("tree", "block")
    return rows.mapInArrow(fold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
