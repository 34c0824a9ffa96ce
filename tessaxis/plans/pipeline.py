"""The two scene pipelines: tiles, a user's model, detection rows, georeference, edges, de-duplication, suppression."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaxis.functions import geometry
from tessaxis.operators import masks, nms, orientation, spatial, tiles
from tessaxis.sources.stages import written


def sliced_prediction(scenes: DataFrame, blocks: DataFrame, block: int, predictor_factory: Callable, categories: DataFrame, slice_size: int = 512, overlap: float = 0.2, min_score: float = 0.1, min_area: float = 6, downscale: bool = True, has_mask: bool = True, tracer: str = "isoline", iou: float = 0.2, batch_size: int = 8, cell: float | None = None) -> tuple[DataFrame, DataFrame]:
    """All detections of the scenes, and those that stay after suppression within each class.

    Detections near a scene's footprint or well inside their slice stay; of equal geometries the first stays. det_id counts
    the rows of a scene in order of tile and model. scenes need a footprint column.
    """
    if not has_mask:
        raise ValueError("detections need masks: areas and outlines come from them")
    raw = tiles.detect(tiles.tiles(scenes, blocks, block, slice_size, overlap), predictor_factory, batch_size, min_score)
    found = masks.georeferenced(masks.detections(raw, categories, slice_size, min_area, downscale, tracer), scenes)
    keyed = written(found.withColumn("det_id", F.shiftleft("tile_id", 20) + F.col("local_id")))
    side = cell or float(slice_size)
    rims = scenes.select("scene_id", "footprint", "res")
    flagged = spatial.near_boundary(keyed, rims, F.lit(0.10 * slice_size) * F.col("res"), side)
    kept = written(nms.distinct_geometries(flagged.where(F.col("is_at_edge") | F.col("is_within_slice"))))
    return kept, nms.nms(kept, iou, True, side)


def predict_scene(scenes: DataFrame, blocks: DataFrame, block: int, predictor_factory: Callable, slice_size: int = 256, overlap: float = 0.2, min_score: float = 0.1, min_area: float = 4, category: int = 1, iou: float = 0.5, tracer: str = "border", batch_size: int = 8) -> tuple[DataFrame, DataFrame]:
    """The second path: detections after class-agnostic suppression in pixels, and their orientation table."""
    raw = tiles.detect(tiles.tiles(scenes, blocks, block, slice_size, overlap), predictor_factory, batch_size, min_score, category)
    found = masks.component_detections(raw, slice_size, min_area, tracer)
    keyed = written(found.withColumn("det_id", F.shiftleft("tile_id", 20) + F.col("local_id")).withColumn("bbox", geometry.bounds(F.col("polygon"))))
    kept = masks.georeferenced(nms.nms(keyed, iou, False, float(slice_size)).drop("bbox"), scenes)
    located = kept.join(scenes.select("scene_id", F.when(F.col("res") > 0, F.col("res")).otherwise(1.0).alias("_res")), "scene_id")
    return kept, orientation.orientations(located, F.col("_res")).drop("_res")


def multi_scale(runs: dict[int, DataFrame], iou: float = 0.2, cell: float = 64.0) -> DataFrame:
    """Runs of several slice sizes as one: united with slice_size, de-duplicated, suppressed."""
    whole = None
    for size, dets in runs.items():
        one = dets.withColumn("slice_size", F.lit(size))
        whole = one if whole is None else whole.unionByName(one)
    keyed = whole.withColumn("det_id", F.xxhash64("scene_id", "slice_size", "det_id"))
    return nms.nms(nms.distinct_geometries(keyed), iou, True, cell)
