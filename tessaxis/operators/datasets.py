"""Training labels: annotations to label lines and back, targets, augmentation."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaxis.functions import geometry
from tessaxis.operators import masks

ANNOTATIONS = "array<struct<bbox:array<double>,segmentation:struct<size:array<int>,counts:array<int>>>>"


def parse_label_lines(labels: DataFrame) -> DataFrame:
    """Label texts (split, image_id, width, height, text) to polygons in pixels: split, image_id, inst_id, polygon.

    A line is a class and x y pairs as shares of width and height. Lines of under 7 words go; a stray last value is dropped.
    """
    lines = labels.select("split", "image_id", "width", "height", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("inst_id", "line"))
    words = lines.withColumn("w", F.filter(F.split("line", r"\s+"), lambda x: x != "")).where(F.size("w") >= 7)
    pairs = F.floor((F.size("w") - 1) / 2).cast("int")
    at = lambda i: F.element_at("w", i.cast("int")).cast("double")
    ring = F.transform(F.sequence(F.lit(1), pairs), lambda i: geometry.point(at(2 * i) * F.col("width"), at(2 * i + 1) * F.col("height")))
    return words.select("split", "image_id", "width", "height", "inst_id", ring.alias("polygon"))


def rasterised(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, row, col) whose centers lie in a polygon, clipped to width x height: spans between crossings of each row."""
    ys = F.col("_ys")
    rows = polygons.withColumn("_ys", geometry.ys(F.col("polygon"))).withColumn("row", F.explode(F.sequence(F.greatest(F.ceil(F.array_min(ys)), F.lit(0)).cast("int"), F.least(F.greatest(F.floor(F.array_max(ys)), F.ceil(F.array_min(ys)), F.lit(0)), F.col("height") - 1 + F.greatest(F.ceil(F.array_min(ys)) - F.col("height") + 1, F.lit(0))).cast("int"))))
    rows = rows.where(F.col("row") < F.col("height"))
    e = F.filter(geometry.edges(F.col("polygon")), lambda s: (s["p"]["y"] <= F.col("row")) != (s["q"]["y"] <= F.col("row")))
    cross = F.array_sort(F.transform(e, lambda s: s["p"]["x"] + (F.col("row") - s["p"]["y"]) * (s["q"]["x"] - s["p"]["x"]) / (s["q"]["y"] - s["p"]["y"])))
    spans = rows.select(*keys, "width", "row", cross.alias("c")).where(F.size("c") >= 2)
    each = spans.select(*keys, "width", "row", F.explode(F.transform(F.sequence(F.lit(1), F.floor(F.size("c") / 2).cast("int")), lambda i: F.struct(F.element_at("c", (2 * i - 1).cast("int")).alias("a"), F.element_at("c", (2 * i).cast("int")).alias("b")))).alias("s"))
    first, last = F.greatest(F.ceil("s.a"), F.lit(0)).cast("int"), F.least(F.floor("s.b"), F.col("width") - 1).cast("int")
    return each.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").select(*keys, "row", F.explode(F.sequence("_a", "_b")).alias("col")).distinct()


def targets(polygons: DataFrame) -> DataFrame:
    """Instances of polygons (split, image_id, inst_id, width, height, polygon): box (ends exclusive), label 1, area of the box, iscrowd 0.

    Polygons without pixels, or one pixel wide or high, are left out.
    """
    px = rasterised(polygons, ["split", "image_id", "inst_id"])
    b = px.groupBy("split", "image_id", "inst_id").agg(F.min("col").alias("x1"), F.min("row").alias("y1"), F.max("col").alias("x2"), F.max("row").alias("y2"))
    kept = b.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    area = (F.col("x2") + 1 - F.col("x1")) * (F.col("y2") + 1 - F.col("y1"))
    box = F.struct(*(c.cast("double").alias(n) for c, n in ((F.col("x1"), "x1"), (F.col("y1"), "y1"), (F.col("x2") + 1, "x2"), (F.col("y2") + 1, "y2"))))
    return kept.select("split", "image_id", "inst_id", box.alias("box"), F.lit(1).alias("label"), area.cast("double").alias("area"), F.lit(0).alias("iscrowd"))


def ranked_images(images_: DataFrame) -> DataFrame:
    """image_id as the 0-based rank of path within its split."""
    return images_.withColumn("image_id", (F.row_number().over(Window.partitionBy("split").orderBy("path")) - 1).cast("long"))


def with_labels(images_: DataFrame, labels: DataFrame) -> DataFrame:
    """Images (split, stem, ...) with their label text; images without a label file are negatives with an empty text."""
    return images_.join(labels.select("split", "stem", "text"), ["split", "stem"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def flip_chosen(image: Column, seed: int, epoch: int, p: float = 0.5) -> Column:
    """The coin of an image in an epoch."""
    return F.pmod(F.xxhash64(image, F.lit(seed), F.lit(epoch)), F.lit(1_000_000)) < int(p * 1_000_000)


def flipped(instances: DataFrame, width: str = "width", flip: Column | None = None) -> DataFrame:
    """Instances with boxes mirrored left to right where flip holds (everywhere by default)."""
    w, b = F.col(width), F.col("box")
    turned = F.struct((w - b["x2"]).alias("x1"), b["y1"].alias("y1"), (w - b["x1"]).alias("x2"), b["y2"].alias("y2"))
    return instances.withColumn("box", turned if flip is None else F.when(flip, turned).otherwise(b))


def flipped_pixels(px: DataFrame, width: str = "width", flip: Column | None = None) -> DataFrame:
    turned = F.col(width) - 1 - F.col("col")
    return px.withColumn("col", turned if flip is None else F.when(flip, turned).otherwise(F.col("col")))


def decode_annotations(rows: DataFrame) -> DataFrame:
    """Rows (dataset, file_stem, annotations) to instances with masks decoded from integer run lengths: inst_id, mask."""
    each = rows.select("dataset", "file_stem", F.posexplode("annotations").alias("inst_id", "a"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for size, counts in zip(pdf["size"], pdf["counts"], strict=True):
                flat = np.repeat(np.arange(len(counts)) % 2, counts)
                made.append(masks.to_mask(flat.reshape(int(size[1]), int(size[0])).T))
            yield pdf.drop(columns=["size", "counts"]).assign(mask=made)

    flat = each.select("dataset", "file_stem", "inst_id", F.col("a.segmentation.size").alias("size"), F.col("a.segmentation.counts").alias("counts"))
    return flat.mapInPandas(run, f"dataset string, file_stem string, inst_id int, mask {masks.MASK}")


def holes_filled(df: DataFrame, smaller_than: int = 64) -> DataFrame:
    """Masks whose holes of under so many pixels are filled."""
    return masks.apply(df, masks.filling(smaller_than))


def label_lines(rows: DataFrame, min_area: float, max_area: float) -> DataFrame:
    """Annotations to label files (dataset, file_stem, text): holes filled, areas strictly between the bounds, contours as shares of the height.

    Coordinates, both divided by the mask's height, have three decimals. Images without instances left get an empty text.
    """
    decoded = decode_annotations(rows).withColumn("h", F.col("mask.h"))
    within = masks.keeping(lambda v: (v > min_area) & (v < max_area))
    traced = masks.apply(decoded, masks.filling(64), masks.measuring("nonzero"), within, masks.tracing(), keep_mask=False).where(F.col("polygon").isNotNull())
    h = F.col("h")
    words = F.flatten(F.transform("polygon", lambda v: F.array(F.round(v["x"] / h, 3).cast("string"), F.round(v["y"] / h, 3).cast("string"))))
    lines = traced.select("dataset", "file_stem", "inst_id", F.concat_ws(" ", F.lit("0"), words).alias("line"))
    text = lines.groupBy("dataset", "file_stem").agg(F.array_sort(F.collect_list(F.struct("inst_id", "line"))).alias("l"))
    return rows.select("dataset", "file_stem").distinct().join(text, ["dataset", "file_stem"], "left").select("dataset", "file_stem", F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("")).alias("text"))
