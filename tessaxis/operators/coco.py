"""Detector scoring: greedy matching per image and class, then average precision over recall points.

Matching: detections of an image and class, by score, take the best truth of theirs that is left; a truth that marks a
crowd is taken only by detections without another, by any number of them, and such detections count neither way. Of an
image and class at most MOST_PER_IMAGE detections take part, and each needs no more than as many truths, its best, since
the others can take no more; so a group that is matched in a task is small however crowded the image.

Precision: detections of a class are dealt out by ranges of their score; running counts inside a range and the counts of
the ranges before give each detection's place, so no class is gathered in one task. The envelope needs only the highest
precision in each step of recall, at most RECALLS values for a class and threshold.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaxis.functions import geometry
from tessaxis.operators.spatial import sized_pairs
from tessaxis.sources.stages import merged, written

# The IoU thresholds, recall points and detections an image of the metric.
THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
RECALLS, MOST_PER_IMAGE = 101, 100
#: Counts of ranges, one row for each range and class in it, that are sent to all tasks.
RANGES_MOST = 100_000


def ground_truth(instances: DataFrame) -> DataFrame:
    """image_id, gt_id (a number in its image), category_id, box, area of the box, iscrowd."""
    b = F.col("box")
    return instances.select("image_id", F.col("inst_id").alias("gt_id"), F.col("label").alias("category_id"), geometry.box(b["x1"], b["y1"], b["x2"], b["y2"]).alias("box"), ((b["x2"] - b["x1"]) * (b["y2"] - b["y1"])).alias("area"), "iscrowd")


def predictions(dets: DataFrame, min_score: float = 0.05) -> DataFrame:
    """Detections of min_score or more, at most the best MOST_PER_IMAGE of each image and class."""
    rank = F.row_number().over(Window.partitionBy("image_id", "category_id").orderBy(F.desc("score"), "det_id"))
    return written(dets.where(F.col("score") >= min_score).withColumn("_n", rank).where(F.col("_n") <= MOST_PER_IMAGE).drop("_n"))  # read several times


def _enough(pairs: DataFrame, i: Column, a_det: Column, a_gt: Column) -> DataFrame:
    """Pairs with the share of the union, of a crowd the share of the detection, if that reaches the lowest threshold."""
    whole = F.when(F.col("iscrowd") == 1, a_det).otherwise(a_det + a_gt - i)
    found = pairs.withColumn("iou", F.coalesce(F.try_divide(i, whole), F.lit(0.0)))
    return found.where(F.col("iou") >= THRESHOLDS[0]).select("image_id", "category_id", "det_id", "score", "gt_id", "iscrowd", "iou")


def box_overlaps(gt: DataFrame, dets: DataFrame) -> DataFrame:
    """image_id, category_id, det_id, score, gt_id, iscrowd, iou of pairs that overlap by the lowest threshold or more."""
    left = dets.select("image_id", "category_id", "det_id", "score", F.col("box").alias("box_a"))
    right = gt.select("image_id", "category_id", "gt_id", "iscrowd", F.col("box").alias("box_b"))
    a, b = F.col("box_a"), F.col("box_b")
    i = (F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])) * (F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]))
    size = lambda r: (r["xmax"] - r["xmin"]) * (r["ymax"] - r["ymin"])
    return _enough(sized_pairs(left, right, ["image_id", "category_id"]), i, size(a), size(b))


def column_runs(px: DataFrame, *keys: str) -> DataFrame:
    """Masks' pixels (keys, row, col) as runs down the columns: keys, col, r0, r1 (inclusive)."""
    order = Window.partitionBy(*keys, "col").orderBy("row")
    marked = px.select(*keys, "row", "col").distinct().withColumn("_run", F.col("row") - F.row_number().over(order))
    return marked.groupBy(*keys, "col", "_run").agg(F.min("row").alias("r0"), F.max("row").alias("r1")).drop("_run")


def mask_overlaps(gt: DataFrame, dets: DataFrame, gt_runs: DataFrame, det_runs: DataFrame) -> DataFrame:
    """The same for masks, given as column_runs(): by image_id, category_id and gt_id, and by image_id, category_id and det_id."""
    on = ["image_id", "category_id"]
    side = lambda runs, s: runs.withColumnsRenamed({"r0": f"r0_{s}", "r1": f"r1_{s}"})
    size = lambda runs, key, name: runs.groupBy(*on, key).agg(F.sum(F.col("r1") - F.col("r0") + 1).alias(name))
    common = F.least("r1_a", "r1_b") - F.greatest("r0_a", "r0_b") + 1
    met = side(det_runs, "a").join(merged(side(gt_runs, "b")), [*on, "col"]).where(common > 0).groupBy(*on, "det_id", "gt_id").agg(F.sum(common).alias("i"))
    met = met.join(merged(dets.select(*on, "det_id", "score")), [*on, "det_id"]).join(merged(size(det_runs, "det_id", "a")), [*on, "det_id"])
    met = met.join(merged(gt.select(*on, "gt_id", "iscrowd")), [*on, "gt_id"]).join(merged(size(gt_runs, "gt_id", "b")), [*on, "gt_id"])
    return _enough(met, F.col("i"), F.col("a"), F.col("b"))


def matches(overlaps: DataFrame) -> DataFrame:
    """image_id, category_id, det_id, hit and ignored (booleans by threshold) of detections that overlap a truth enough; of equal overlaps the later truth is taken."""
    by = Window.partitionBy("image_id", "category_id", "det_id", "iscrowd").orderBy(F.desc("iou"), F.desc("gt_id"))
    most = F.when(F.col("iscrowd") == 1, 1).otherwise(MOST_PER_IMAGE)  # of crowds the best is enough, they are never used up
    best = overlaps.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= MOST_PER_IMAGE).where(F.col("_n") <= most).drop("_n")

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a group come one after the other, its detections by score, the pairs of each by overlap, crowds last."""
        group = det = None
        used: list[set] = []
        for batch in batches:
            rows: list[list] = []
            for image, category, own, gt, crowd, iou in zip(*(batch.column(c).to_pylist() for c in ("image_id", "category_id", "det_id", "gt_id", "iscrowd", "iou")), strict=True):
                if (image, category) != group:
                    group, det, used = (image, category), None, [set() for _ in THRESHOLDS]
                if own != det:
                    det, done = own, [False] * len(THRESHOLDS)
                for k, t in enumerate(THRESHOLDS):
                    if not done[k] and iou >= t and (crowd or gt not in used[k]):
                        done[k] = True
                        rows.append([image, category, own, k, not crowd])
                        if not crowd:
                            used[k].add(gt)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [*(batch.schema.field(c).type for c in ("image_id", "category_id", "det_id")), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["image_id", "category_id", "det_id", "k", "own"])

    on = ["image_id", "category_id"]
    kinds = ", ".join(f"{c} {overlaps.schema[c].dataType.simpleString()}" for c in (*on, "det_id"))
    parts = int(overlaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = best.repartition(parts, *on).sortWithinPartitions(*on, F.desc("score"), "det_id", "iscrowd", F.desc("iou"), F.desc("gt_id"))
    taken = dealt.select(*on, "det_id", "gt_id", "iscrowd", "iou").mapInArrow(greedy, f"{kinds}, k int, own boolean")
    per = taken.groupBy(*on, "det_id").agg(*(F.bool_or((F.col("k") == i) & (F.col("own") == own)).alias(f"{n}{i}") for n, own in (("h", True), ("c", False)) for i in range(len(THRESHOLDS))))
    return per.select(*on, "det_id", *(F.array(*(f"{n}{i}" for i in range(len(THRESHOLDS)))).alias(name) for n, name in (("h", "hit"), ("c", "ignored"))))


def _places(dets: DataFrame, overlaps: DataFrame) -> DataFrame:
    """category_id and, by threshold, hit, tps (hits so far) and k (detections so far that count): one row for each detection."""
    key = ["image_id", "category_id", "det_id"]
    none = F.array_repeat(F.lit(False), len(THRESHOLDS))
    rows = dets.select(*key, "score").join(merged(matches(overlaps)), key, "left").withColumns({"hit": F.coalesce("hit", none), "ignored": F.coalesce("ignored", none)})
    order = [F.asc("category_id"), F.desc("score"), F.asc("image_id"), F.asc("det_id")]
    parts = int(dets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    each = range(len(THRESHOLDS))
    ones = {f"t{i}": F.col("hit")[i].cast("long") for i in each} | {f"k{i}": (~F.col("ignored")[i]).cast("long") for i in each}
    spread = written(spread.select("_part", *key, "score", *(c.alias(n) for n, c in ones.items())))
    # counts of the ranges before, by class
    sums = spread.groupBy("category_id", "_part").agg(*(F.sum(n).alias(n) for n in ones))
    before = Window.partitionBy("category_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.select("category_id", "_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"o_{n}") for n in ones)))
    inside = Window.partitionBy("category_id", "_part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    counted = spread.select("category_id", "_part", *(F.struct(F.col(f"t{i}").alias("hit"), F.sum(f"t{i}").over(inside).alias("tps"), F.sum(f"k{i}").over(inside).alias("k")).alias(f"s{i}") for i in each))
    counted = counted.join(F.broadcast(offsets) if offsets.count() <= RANGES_MOST else offsets, ["category_id", "_part"])
    whole = F.array(*(F.struct(F.lit(THRESHOLDS[i]).alias("thr"), F.col(f"s{i}.hit").alias("hit"), (F.col(f"s{i}.tps") + F.col(f"o_t{i}")).alias("tps"), (F.col(f"s{i}.k") + F.col(f"o_k{i}")).alias("k")) for i in each))
    # only hits raise recall, and so hold the best precision of a step
    return counted.select("category_id", F.explode(F.filter(whole, lambda x: x["hit"] == 1)).alias("x")).select("category_id", "x.thr", "x.tps", "x.k")


def precision(gt: DataFrame, dets: DataFrame, overlaps: DataFrame) -> DataFrame:
    """thr, category_id, ap: mean over recall points of the best precision at that recall or more; classes without truth are no rows."""
    many = gt.where("iscrowd = 0").groupBy("category_id").agg(F.count("*").alias("n_gt"))
    steps = _places(dets, overlaps).join(many, "category_id")
    # the highest recall point j / (RECALLS - 1) that tps / n_gt reaches
    steps = steps.withColumn("point", F.expr(f"tps * {RECALLS - 1} div n_gt")).groupBy("thr", "category_id", "point").agg(F.max(F.col("tps") / F.col("k")).alias("p"))
    onward = Window.partitionBy("thr", "category_id").orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    below = F.coalesce(F.lead("point").over(Window.partitionBy("thr", "category_id").orderBy(F.desc("point"))), F.lit(-1))
    curve = steps.select("thr", "category_id", F.max("p").over(onward).alias("best"), (F.col("point") - below).alias("w"))
    sums = curve.groupBy("thr", "category_id").agg((F.sum(F.col("w") * F.col("best")) / RECALLS).alias("ap"))
    whole = many.select("category_id", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("thr"))
    return whole.join(sums, ["thr", "category_id"], "left").select("thr", "category_id", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def average_precision(gt: DataFrame, dets: DataFrame, overlaps: DataFrame) -> DataFrame:
    """One row: AP (over all thresholds), AP50, AP75; zeros without detections."""
    p = precision(gt, dets, overlaps)
    of = lambda t: F.avg(F.when(F.abs(F.col("thr") - t) < 1e-6, F.col("ap")))
    return p.agg(F.avg("ap").alias("ap"), of(0.5).alias("ap50"), of(0.75).alias("ap75"))
