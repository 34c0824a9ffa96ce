"""Exact greedy non-maximum suppression as an iteration on the graph of overlapping boxes.

With boxes ordered by score (highest first) and key, an edge runs from each box to each lower one that it overlaps by
more than the threshold. A box stays exactly if no staying box has an edge to it. Boxes without edges, nearly all, never
enter the iteration. A round walks each block of the plane in the order of scores: a box is dropped if one that stays has
an edge to it, stays if all that have are dropped, and is left open if one of them is open itself, in its block or in
another. So chains inside a block end in one round, however long, and only what hangs on open boxes beyond a border is
left for the next. Each round writes small tables to the shared folder, so that lost executors cost no earlier round.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaxis.functions import geometry
from tessaxis.operators.spatial import box_pairs
from tessaxis.sources.stages import dropped, merged, written

#: Cells a side of a block.
BLOCK_CELLS = 16


def overlap_edges(dets: DataFrame, threshold: float, by_class: bool = True, cell: float = 32.0, key: str = "det_id") -> DataFrame:
    """scene_id, hi, lo: pairs of keys of a scene with IoU over the threshold, hi being ahead in the order; with the blocks of both and the score of lo."""
    on = ["scene_id", "category_id"] if by_class else ["scene_id"]
    side = lambda s: dets.select(*on, F.col(key).alias(f"k_{s}"), F.col("score").alias(f"s_{s}"), F.col("bbox").alias(f"box_{s}"))
    pairs = box_pairs(side("a"), side("b"), cell, on).where((F.col("k_a") < F.col("k_b")) & (geometry.iou(F.col("box_a"), F.col("box_b")) > threshold))
    a_first = F.col("s_a") >= F.col("s_b")
    block = lambda s: F.struct(*(F.floor(F.col(f"box_{s}.{c}") / (BLOCK_CELLS * cell)).alias(n) for c, n in (("xmin", "x"), ("ymin", "y"))))
    either = lambda a, b, name: F.when(a_first, a).otherwise(b).alias(name)
    return pairs.select("scene_id", either(F.col("k_a"), F.col("k_b"), "hi"), either(F.col("k_b"), F.col("k_a"), "lo"), either(block("a"), block("b"), "hi_block"), either(block("b"), block("a"), "lo_block"), either(F.col("s_b"), F.col("s_a"), "lo_score"))


def _decided(edges: DataFrame) -> DataFrame:
    """scene_id, lo, stays of the boxes that their blocks can decide."""
    below = edges.select("scene_id", F.col("lo").alias("hi"), F.lit(True).alias("open")).distinct()
    rows = edges.join(merged(below), ["scene_id", "hi"], "left")
    flat = rows.select("scene_id", "lo_block.x", "lo_block.y", F.col("lo_score").alias("score"), "lo", "hi", (F.col("hi_block") == F.col("lo_block")).alias("near"), F.coalesce("open", F.lit(False)).alias("open"))
    place = ["scene_id", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = box = None
        state: dict = {}  # of boxes of the block: whether they stay, null if open
        above: list = []  # of the boxes that have an edge to the present one

        def decide(out: list) -> None:
            state[box] = False if True in above else None if None in above else True
            if state[box] is not None:
                out.append((block[0], box, state[box]))

        def table(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kinds[0]), pa.array(columns[1], kinds[1]), pa.array(columns[2], pa.bool_())], ["scene_id", "lo", "stays"])

        kinds: list = []
        for batch in batches:
            kinds, out = [batch.schema.field(c).type for c in ("scene_id", "lo")], []
            for scene, x, y, lo, hi, near, is_open in zip(*(batch.column(c).to_pylist() for c in (*place, "lo", "hi", "near", "open")), strict=True):
                if (scene, x, y) != block or lo != box:
                    if above:
                        decide(out)
                    if (scene, x, y) != block:
                        block, state = (scene, x, y), {}
                    box, above = lo, []
                above.append(True if not is_open else state[hi] if near else None)
            yield table(out)
        if above:
            out = []
            decide(out)
            yield table(out)

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in ("scene_id", "lo"))
    return flat.repartition(parts, *place).sortWithinPartitions(*place, F.desc("score"), "lo").mapInArrow(run, f"{kinds}, stays boolean")


def suppressed(edges: DataFrame) -> DataFrame:
    """scene_id and the keys (lo) that greedy suppression drops; a key counts within its scene. edges: those of overlap_edges()."""
    left, out = written(edges), None
    while not left.isEmpty():
        decided = written(_decided(left))
        as_hi = lambda df: df.select("scene_id", F.col("lo").alias("hi"))
        stay = as_hi(decided.where("stays")).unionByName(left.select("scene_id", "hi").distinct().join(merged(as_hi(left)), ["scene_id", "hi"], "left_anti"))
        hit = left.join(merged(stay), ["scene_id", "hi"], "left_semi").select("scene_id", "lo")
        gone = written(decided.where("NOT stays").select("scene_id", "lo").unionByName(hit).distinct())
        out = gone if out is None else out.unionByName(gone)
        rest = left.join(merged(decided.where("stays").select("scene_id", "lo").unionByName(gone)), ["scene_id", "lo"], "left_anti").join(merged(as_hi(gone)), ["scene_id", "hi"], "left_anti")
        last, left = left, written(rest)
        dropped(last, decided)
    return out if out is not None else edges.select("scene_id", "lo").limit(0)


def nms(dets: DataFrame, threshold: float = 0.2, by_class: bool = True, cell: float = 32.0, key: str = "det_id") -> DataFrame:
    """The detections that stay. dets: key (unique in a scene), scene_id, category_id, score and bbox; sort by score for the usual order."""
    gone = suppressed(overlap_edges(dets, threshold, by_class, cell, key))
    return dets.join(merged(gone.withColumnRenamed("lo", key)), ["scene_id", key], "left_anti")


def distinct_geometries(dets: DataFrame, key: str = "det_id", geometry_column: str = "geometry") -> DataFrame:
    """One row per scene and geometry, that of the lowest key; geometries are compared by their coordinates."""
    first = Window.partitionBy("scene_id", geometry_column).orderBy(key)
    return dets.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
