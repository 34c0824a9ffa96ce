"""Merkle manifest of a table: one tree per value of a grouping column, and one tree over their roots.

A node of a tree is the hash of up to `fan` consecutive nodes below it; a tree grows while it has several nodes on a level.
Checkpoint and recompute: of each tree only every `stride`-th level is a table (the leaves, then the nodes `stride` levels
above, and so on). Proofs are made from the top down. A block, an aligned subtree of `stride` levels, is one row with the
stored nodes at its foot (fan ** stride at most) and the path from its top to the root; a task regenerates the nodes in
between, hands each foot its path and forgets them. So only paths of the blocks' tops are stored, not those of the leaves.

Positions in a tree come from rows dealt out by ranges of (tree, key, leaf) and counts of the ranges before: a tree that
holds a third of all rows is spread like any other. Blocks are found by position, so they are of equal size.

Rows with a null key come first in their tree, rows that share tree and key are ordered by their leaf's digest (so equal
rows are leaves side by side); a null tree is a tree of its own, before all others. An empty table has no root and no rows.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaxis.llm.common import LOWER, UPPER, partitions, written

FAN, STRIDE = 8, 3
#: Ranges whose counts are sent to all tasks; more are joined by a shuffle.
RANGES_MOST = 100_000


def field(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(df: DataFrame, columns: list[str], replaced: dict[str, Column] | None = None) -> Column:
    """The hash of a row's fields; `replaced` has expressions for some of them."""
    return F.sha2(F.concat(*(field((replaced or {}).get(c, F.col(c))) for c in columns)), 256)


def lowered(column: str) -> Column:
    """The text with A-Z in lower case."""
    return F.translate(F.col(column), UPPER, LOWER)


def digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def _depth(n: Column, fan: int) -> Column:
    """Levels above n leaves until one node is left; n is a long, so at most 64 steps."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.pow(F.lit(float(fan)), k) < n))


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree and others) with pos, the place in the tree from 0, and n, the size of the tree."""
    keys = [F.asc_nulls_first(c) for c in ["tree", *order]]
    spread = leaves.repartitionByRange(partitions(leaves), *keys).sortWithinPartitions(*keys)
    rows = written(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    ranges = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    by = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = written(ranges.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(by).alias("n")))
    found = rows.join(F.broadcast(ranges) if ranges.count() <= RANGES_MOST else ranges, ["tree", "_part"])
    return found.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _blocks(nodes: DataFrame, fan: int, stride: int, *more: str) -> DataFrame:
    """tree, block, n, depth (levels above these nodes), foot: the nodes of an aligned subtree in order, with more columns."""
    block = F.floor(F.col("pos") / fan**stride).alias("block")
    rows = nodes.groupBy("tree", block).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *more))).alias("foot"), F.first("depth").alias("depth"))
    return rows


def _levels(foot: list[bytes], up: int, fan: int) -> list[list[bytes]]:
    levels = [foot]
    for _ in range(up):
        below = levels[-1]
        levels.append([digest(below[i : i + fan]) for i in range(0, len(below), fan)])
    return levels


def _tops(blocks: DataFrame, fan: int, stride: int) -> DataFrame:
    """The nodes `stride` levels above, or the roots of trees that end there: tree, pos, digest, depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [_levels([x["digest"].encode() for x in foot], min(depth, stride), fan)[-1][0].decode() for foot, depth in zip(batch.column("foot").to_pylist(), batch.column("depth").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(tops, pa.string()), batch.column("depth")], ["tree", "pos", "digest", "depth"])

    return blocks.select("tree", "block", "foot", "depth").mapInArrow(run, "tree string, pos long, digest string, depth int").withColumn("depth", F.greatest(F.col("depth") - stride, F.lit(0)))


def grown(leaves: DataFrame, fan: int = FAN, stride: int = STRIDE) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of all trees, leaves first, and the roots (tree, digest). leaves: tree, pos, n, digest."""
    level = leaves.withColumn("depth", _depth(F.col("n"), fan)).drop("n")
    levels, roots = [level], None
    while True:
        here = level.where("depth = 0").select("tree", "digest")
        roots = here if roots is None else roots.unionByName(here)
        deep = level.where("depth > 0")
        if deep.isEmpty():
            return levels, roots
        level = written(_tops(_blocks(deep.select("tree", "pos", "digest", "depth"), fan, stride), fan, stride))
        levels.append(level)


#: A path to the root: for each level the siblings to the left and to the right, as hex text.
PATH = "array<struct<l:string,r:string>>"


def _block_paths(foot: list[bytes], up: int, fan: int) -> list[list[tuple[bytes, bytes]]]:
    """For each node of the foot the siblings on its levels inside the block; nodes above share the tails of paths."""
    levels = _levels(foot, up, fan)
    above: list[list[tuple[bytes, bytes]]] = [[]]
    for level in reversed(levels[:-1]):
        here = []
        for i in range(len(level)):
            run = i - i % fan
            here.append([(b"".join(level[run:i]), b"".join(level[i + 1 : run + fan])), *above[i // fan]])
        above = here
    return above


def paths(levels: list[DataFrame], upper: DataFrame, fan: int = FAN, stride: int = STRIDE) -> DataFrame:
    """tree, block, foot of the blocks of leaves, with up: the path from the block's top to the last root. upper: tree, up of each root."""
    for i in range(len(levels) - 1, 0, -1):
        # at this level: nodes of trees that reach it, the single node of a tree being its root
        own = levels[i].where("depth = 0").join(upper, "tree").select("tree", "pos", "up")
        deep = levels[i].where("depth > 0")
        below = _blocks(deep, fan, stride).join(above, ["tree", "block"]) if i < len(levels) - 1 else None
        found = own if below is None else own.unionByName(_foot_paths(below, fan, stride))
        above = written(found.select("tree", F.col("pos").alias("block"), "up"))
    first = levels[0]
    alone = first.where("depth = 0").join(upper, "tree").withColumn("block", F.lit(0).cast("long"))
    more = [c for c in first.columns if c not in ("tree", "pos", "digest", "depth")]
    alone = alone.select("tree", "block", F.array(F.struct("pos", "digest", *more)).alias("foot"), "depth", "up")
    if len(levels) == 1:
        return alone
    return alone.unionByName(_blocks(first.where("depth > 0"), fan, stride, *more).join(above, ["tree", "block"]).select("tree", "block", "foot", "depth", "up"))


def _foot_paths(blocks: DataFrame, fan: int, stride: int) -> DataFrame:
    """tree, pos, up of the nodes at the blocks' feet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, foot, depth, up = (batch.column(c)[i].as_py() for c in ("tree", "foot", "depth", "up"))
                inside = _block_paths([x["digest"].encode() for x in foot], min(depth, stride), fan)
                rows = [[{"l": a.decode(), "r": b.decode()} for a, b in x] + up for x in inside]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(foot)), pa.array([x["pos"] for x in foot], pa.int64()), pa.array(rows, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))], ["tree", "pos", "up"])

    return blocks.select("tree", "foot", "depth", "up").mapInArrow(run, f"tree string, pos long, up {PATH}")


def manifest(df: DataFrame, columns: list[str], group: str = "lang", key: str = "doc_id", changed: Column | None = None, fan: int = FAN, stride: int = STRIDE) -> DataFrame:
    """One row per row of df: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    changed: another leaf to hold against the manifest, null where the row's own leaf is held; folded_root is made from it
    and the original siblings, and verified says whether it is the root. proof_sha256 is the hash of all siblings up to
    the root, level by level, left to right.
    """
    tree = F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col(group).cast("string")))  # in the order of the group, null first
    changed = changed if changed is not None else F.lit(None).cast("string")
    rows = written(df.select(tree.alias("tree"), F.col(key).alias("key"), leaf(df, columns).alias("digest"), changed.alias("changed")))
    levels, roots = grown(placed(rows, ["key", "digest"]), fan, stride)
    roots = written(roots)
    top = placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), ["key"])
    top_levels, root = grown(top, fan, stride)
    whole = root.first()
    final = whole["digest"] if whole else ""
    none = F.array().cast(PATH)
    tops = _foot_paths(paths(top_levels, df.sparkSession.createDataFrame([("",)], "tree string").withColumn("up", none), fan, stride), fan, stride)
    named = top.select("pos", F.col("key").alias("tree")).join(tops.select("pos", "up"), "pos").select("tree", "up")
    blocks = paths(levels, written(named), fan, stride).join(roots.select("tree", F.col("digest").alias("subroot")), "tree")
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                foot, depth, up, subroot = (batch.column(c)[i].as_py() for c in ("foot", "depth", "up", "subroot"))
                leaves = [x["digest"].encode() for x in foot]
                upper = [(x["l"].encode(), x["r"].encode()) for x in up]
                shared = b"".join(a + b for a, b in upper)
                out = []
                for x, inside in zip(foot, _block_paths(leaves, min(depth, stride), fan), strict=True):
                    proof = hashlib.sha256(b"".join([*(a + b for a, b in inside), shared])).hexdigest()
                    node = (x["changed"] or x["digest"]).encode()
                    for a, b in (*inside, *upper):
                        node = digest([a, node, b])
                    out.append((x["key"], x["digest"], subroot, final, proof, node.decode(), node.decode() == final))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([foot_keys(batch, i), *(pa.array(c, pa.string()) for c in cols[1:6]), pa.array(cols[6], pa.bool_())], [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    def foot_keys(batch, i):
        return batch.column("foot")[i].values.field("key")

    return blocks.mapInArrow(run, f"`{key}` {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
