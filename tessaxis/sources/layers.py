"""Layers of detections: scans with pruned columns or by box, samples by row, sinks and their names."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaxis.functions import geometry

# Column names of written layers.
SHORT = {"category_id": "cat_id", "category_name": "cat_name", "is_within_slice": "isin_slice"}


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """xmin, ymin, xmax, ymax of a layer; nothing else is read."""
    return spark.read.parquet(path).select("bbox.*")


def in_box(layer: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The rows whose box meets a box, borders included; the tests reach the scan of flat or nested box columns."""
    b = F.col("bbox")
    return layer.where((b["xmin"] <= xmax) & (b["xmax"] >= xmin) & (b["ymin"] <= ymax) & (b["ymax"] >= ymin))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n random rows, the same for one seed: the first by the MD5 of "key:seed"."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def feature_count(df: DataFrame) -> int:
    return df.count()


def layer_name(stem: str, conf: float, slice_size: int, inference_size: int, overlap: float, downscaled: bool = False, kind: str = "mask", nms: bool = False) -> str:
    """A layer's name from its parameters; shares are cut, not rounded, to whole percents."""
    return f"{stem}-predictions-ct-{int(conf * 100):03d}-ss-{slice_size}-is-{inference_size}-ov-{int(overlap * 100):03d}" + "-downscaled" * downscaled + f"-{kind}" + "-nms" * nms


def _named(dets: DataFrame) -> DataFrame:
    return dets.withColumnsRenamed({k: v for k, v in SHORT.items() if k in dets.columns})


def box_layer(dets: DataFrame) -> DataFrame:
    """Detections with their boxes' rings as geometry, without polygon and bbox."""
    return _named(dets.withColumn("geometry", geometry.box_ring(F.col("bbox"))).drop("bbox", "polygon"))


def outline_layer(dets: DataFrame) -> DataFrame:
    """Detections with their outlines, without polygon and bbox."""
    return _named(dets.drop("bbox", "polygon"))


def as_geojson(layer: DataFrame) -> DataFrame:
    """One feature a line: value."""
    ring = F.array(F.transform("geometry", lambda v: F.array(v["x"], v["y"])))
    rest = F.struct(*(c for c in layer.columns if c != "geometry"))
    return layer.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"), rest.alias("properties"))).alias("value"))


def write_layers(dets: DataFrame, path: str, save_boxes: bool = True, save_masks: bool = True, output_format: str = "parquet") -> None:
    """The layers asked for, under path/layer=bbox and path/layer=mask, as Parquet or GeoJSON lines."""
    for kind, wanted, layer in (("bbox", save_boxes, box_layer(dets)), ("mask", save_masks, outline_layer(dets))):
        if wanted:
            to = f"{path}/layer={kind}"
            as_geojson(layer).write.mode("overwrite").text(to) if output_format == "geojson" else layer.write.mode("overwrite").parquet(to)


def write_orientations(table: DataFrame, path: str) -> None:
    """The orientation table as CSV with a header."""
    table.select(*(c for c, t in table.dtypes if not t.startswith(("array", "struct")))).write.mode("overwrite").option("header", True).csv(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    tiles.write.mode("overwrite").partitionBy("scene_id").parquet(path)


def with_metadata(df: DataFrame, scenes: DataFrame) -> DataFrame:
    """df with its scene's transform, crs and res; res falls back to the size of a pixel in x."""
    meta = scenes.select("scene_id", "transform", "crs", F.coalesce("res", F.abs(F.col("transform.a"))).alias("res"))
    return df.join(meta, "scene_id")
