"""From masks to detection rows: resampling, area tests, contours, georeference; and the same on exploded mask pixels.

A mask is STRUCT<h, w, data: float32 bytes by rows>; mask_pixels is its exploded form (det_id, row, col, w).
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessaxis.functions import geometry, packed
from tessaxis.sources.stages import spread, written

MASK = "struct<h:int,w:int,data:binary>"


def to_array(mask) -> np.ndarray:
    return np.frombuffer(mask["data"], np.float32).reshape(mask["h"], mask["w"])


def to_mask(a: np.ndarray) -> dict:
    a = np.ascontiguousarray(a, np.float32)
    return {"h": a.shape[0], "w": a.shape[1], "data": a.tobytes()}


class Step(NamedTuple):
    """What happens to all masks of a batch: new columns and their types, and (masks, columns) to the same. A step may drop rows.

    cells: cells that it needs for each mask, if more than the mask has.
    """

    new: dict[str, str]
    run: Callable[[packed.Masks, dict[str, pa.Array]], tuple[packed.Masks, dict[str, pa.Array]]]
    cells: int = 1


#: Cells that one slice of a batch holds, if its first mask is not larger.
SLICE_CELLS = 1 << 18


def apply(df: DataFrame, *steps: Step, mask: str = "mask", keep_mask: bool = True) -> DataFrame:
    """df after steps on its masks, in one pass through Python. What a step gives for null or broken masks is null."""
    new = {k: v for s in steps for k, v in s.new.items()}
    same = [f for f in df.schema.fields if f.name not in new and f.name != mask]
    schema = T.StructType(same + T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in new.items())).fields if new else same)
    if keep_mask:
        schema = schema.add(mask, T._parse_datatype_string(MASK))
    out = to_arrow_schema(schema)
    least = max(s.cells for s in steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(mask)
            sides = [whole.field(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "w")]
            group = np.cumsum(np.maximum(sides[0] * sides[1], least)) // SLICE_CELLS
            borders = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                m, columns = packed.from_arrow(part.column(mask)), {f.name: part.column(f.name) for f in same}
                for step in steps:
                    m, columns = step.run(m, columns)
                columns[mask] = packed.to_arrow(m) if keep_mask else None
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _nulls(values: np.ndarray, ok: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~ok)


def resizing(h: int, w: int, how: str) -> Step:
    return Step({}, lambda m, c: (packed.resized(m, h, w, how), c), h * w)


def cutting(level: float = 0.5, strict: bool = False) -> Step:
    """Cells of `level` or more (strict: over it) become 1, others 0."""
    return Step({}, lambda m, c: (m.with_data(m.data > level if strict else m.data >= level), c))


def measuring(rule: str = "ones") -> Step:
    count = {"ones": lambda v: v == 1, "nonzero": lambda v: v != 0, "sum": lambda v: v}[rule]
    return Step({"area": "double"}, lambda m, c: (m, c | {"area": _nulls(packed.sums(m, count(m.data)), m.ok)}))


def keeping(test: Callable[[np.ndarray], np.ndarray], column: str = "area") -> Step:
    """Only rows whose column, not null, passes a test."""

    def run(m, c):
        v = c[column]
        flag = test(v.to_numpy(zero_copy_only=False)) & v.is_valid().to_numpy(zero_copy_only=False)
        return m.taken(flag), {k: x.filter(pa.array(flag)) for k, x in c.items()}

    return Step({}, run)


LARGEST = Step({}, lambda m, c: (packed.largest_parts(m), c))


def filling(smaller_than: int | None = None) -> Step:
    return Step({}, lambda m, c: (m.with_data(packed.holes_filled(m, m.data > 0, smaller_than)), c))


def _cut(m, c):
    small, row0, col0 = packed.cropped(m)
    return small, c | {"row0": _nulls(row0, m.ok), "col0": _nulls(col0, m.ok)}


CROP = Step({"row0": "int", "col0": "int"}, _cut)
TRACERS = {"isoline": packed.traced_isolines, "border": packed.traced_borders}


def tracing(tracer: str = "isoline") -> Step:
    trace = TRACERS[tracer]
    return Step({"polygon": geometry.RING}, lambda m, c: (m, c | {"polygon": packed.rings(*trace(m))}))


def checking(min_area: int = 4) -> Step:
    def run(m, c):
        flag = m.data > 0
        ok = (packed.sums(m, flag) >= min_area) & (packed.part_counts(m, flag, eight=True) == 1) & (packed.isoline_counts(m.with_data(flag)) == 1)
        return m, c | {"is_valid": _nulls(ok, m.ok)}

    return Step({"is_valid": "boolean"}, run)


def resized(df: DataFrame, h: int, w: int, how: str, mask: str = "mask") -> DataFrame:
    """Masks resampled to h x w: area, nearest, bilinear or cubic."""
    return apply(df, resizing(h, w, how), mask=mask)


def binarised(df: DataFrame, level: float = 0.5, mask: str = "mask") -> DataFrame:
    """Cells of `level` or more become 1, others 0."""
    return apply(df, cutting(level), mask=mask)


def with_area(df: DataFrame, rule: str = "ones", mask: str = "mask") -> DataFrame:
    """df with area: the count of cells that are exactly 1 ("ones"), not 0 ("nonzero"), or the sum ("sum")."""
    return apply(df, measuring(rule), mask=mask)


def kept_component(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Masks reduced to their largest 4-connected part with holes filled."""
    return apply(df, LARGEST, mask=mask)


def cropped(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Masks cut to their box, with the box's row0 and col0."""
    return apply(df, CROP, mask=mask)


def contours(df: DataFrame, tracer: str = "isoline", mask: str = "mask") -> DataFrame:
    """df with polygon: the mask's contour, (x, y) = (column, row); null for empty masks."""
    return apply(df, tracing(tracer), mask=mask)


def validity(df: DataFrame, min_area: int = 4, mask: str = "mask") -> DataFrame:
    """df with is_valid: enough area, one 8-connected part and one contour (no holes)."""
    return apply(df, checking(min_area), mask=mask)


def _sizing(slice_size: int, downscale: bool, area_rule: str) -> list[Step]:
    return [resizing(slice_size, slice_size, "area")] * downscale + [measuring(area_rule)]


def _drawing(tracer: str, mask_rule: str) -> list[Step]:
    return [cutting(0, strict=True)] * (mask_rule == "positive") + [tracing(tracer)]


_DRAWN = "polygon IS NOT NULL AND size(polygon) >= 3"


def detections(raw: DataFrame, categories: DataFrame, slice_size: int, min_area: float = 6, downscale: bool = True, tracer: str = "isoline", area_rule: str = "ones", mask_rule: str = "as is", demote: bool = True) -> DataFrame:
    """Detection rows in scene pixels from raw detections: the first path, one pass over the masks.

    Masks are brought to the slice's size by area means, or kept and their polygons scaled; rows of min_area or less, of
    failed or short contours and of unknown classes go. categories: category_id, category_name.
    """
    own = raw.select("scene_id", "tile_id", "local_id", "score", "category_id", "x0", "y0", F.col("mask.h").alias("_h"), "mask")
    found = apply(own, *_sizing(slice_size, downscale, area_rule), keeping(lambda v: v > min_area), *_drawing(tracer, mask_rule), keep_mask=False).where(_DRAWN)
    if not downscale:
        found = found.withColumn("polygon", geometry.rescale(F.col("polygon"), F.col("_h"), float(slice_size)))
    found = found.withColumn("is_within_slice", geometry.well_inside(F.col("polygon"), slice_size))
    if demote:
        found = found.withColumn("score", geometry.demoted(F.col("score"), F.col("is_within_slice")))
    found = found.withColumn("polygon", geometry.shift(F.col("polygon"), F.col("x0"), F.col("y0")))
    named = found.join(categories, "category_id")
    return named.select("scene_id", "tile_id", "local_id", "score", "polygon", "category_id", "category_name", "is_within_slice")


def rejects(raw: DataFrame, categories: DataFrame, slice_size: int, min_area: float = 6, downscale: bool = True, tracer: str = "isoline", area_rule: str = "ones", mask_rule: str = "as is") -> DataFrame:
    """Why detections() of the same parameters leaves rows out: scene_id, reason (area, contour or category, the first that holds), n."""
    own = raw.select("scene_id", "category_id", "mask")
    drawn = apply(own, *_sizing(slice_size, downscale, area_rule), *_drawing(tracer, mask_rule), keep_mask=False)
    drawn = written(drawn.select("scene_id", "category_id", "area", F.expr(_DRAWN).alias("ok")))
    known = drawn.join(categories.select("category_id", F.lit(True).alias("named")).distinct(), "category_id", "left")
    large, ok = F.coalesce(F.col("area") > min_area, F.lit(False)), F.col("ok")
    reason = F.when(~large, "area").when(~ok, "contour").when(F.col("named").isNull(), "category")
    return known.select("scene_id", reason.alias("reason")).where("reason IS NOT NULL").groupBy("scene_id", "reason").agg(F.count("*").alias("n"))


def component_detections(raw: DataFrame, inference_size: int, min_area: float = 4, tracer: str = "border") -> DataFrame:
    """Detection rows in scene pixels: the second path. Nearest resampling, rows under min_area go, largest part, contour; one pass."""
    own = raw.select("scene_id", "tile_id", "local_id", "score", "category_id", "x0", "y0", "sw", "sh", "mask")
    steps = resizing(inference_size, inference_size, "nearest"), measuring("sum"), keeping(lambda v: v >= min_area), LARGEST, tracing(tracer)
    found = apply(own, *steps, keep_mask=False).where(_DRAWN)
    scaled = F.transform("polygon", lambda v: geometry.point(v["x"] * F.col("sw") / inference_size + F.col("x0"), v["y"] * F.col("sh") / inference_size + F.col("y0")))
    return found.withColumn("polygon", scaled).select("scene_id", "tile_id", "local_id", "score", "polygon", "category_id")


def georeferenced(dets: DataFrame, scenes: DataFrame) -> DataFrame:
    """dets with geometry (closed map ring) and bbox."""
    found = dets.join(scenes.select("scene_id", "transform"), "scene_id")
    found = found.withColumn("geometry", geometry.georeference(F.col("polygon"), F.col("transform"))).drop("transform")
    return found.withColumn("bbox", geometry.bounds(F.col("geometry")))


def nearest_to_center(dets: DataFrame, size: float, max_distance: float | None, need_angle: bool = False, by: str = "patch_id") -> DataFrame:
    """Per patch the detection (cx, cy) nearest its center; then rejected if farther than max_distance or without an angle."""
    d = F.hypot(F.col("cx") - size / 2, F.col("cy") - size / 2)
    first = Window.partitionBy(by).orderBy("center_dist", "local_id")
    found = dets.withColumn("center_dist", d).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if max_distance is not None:
        found = found.where(F.col("center_dist") <= max_distance)
    return found.where(F.col("angle180").isNotNull()) if need_angle else found


def by_class(dets: DataFrame) -> DataFrame:
    """Counts of masks by class name; the masks themselves stay rows."""
    return dets.groupBy("category_name").agg(F.count("*").alias("n"))


def pixels(df: DataFrame, key: str = "det_id", mask: str = "mask") -> DataFrame:
    """Masks exploded to (key, row, col, w), cells over 0 only."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = packed.from_arrow(batch.column(mask))
            r, _ = packed.runs(m, m.data > 0)
            n = r.last - r.first
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, col, cell = np.repeat(r.row, n), np.repeat(r.column, n) + step, np.repeat(r.first, n) + step
            keys = batch.column(key).take(pa.array(np.repeat(r.mask, n)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(m.data[cell].astype(float))], [key, "row", "col", "w"])

    return df.select(key, mask).mapInArrow(run, f"{key} {kind}, row int, col int, w double")


def block_means(px: DataFrame, factor: int, key: str = "det_id") -> DataFrame:
    """mask_pixels shrunk by a whole factor: the mean over each block, absent pixels being 0."""
    f = F.floor
    cells = spread(px.select(key, "row", "col", "w"), key).groupBy(key, f(F.col("row") / factor).cast("int").alias("row"), f(F.col("col") / factor).cast("int").alias("col"))
    return cells.agg((F.sum("w") / (factor * factor)).alias("w"))


def pixel_boxes(px: DataFrame, key: str = "det_id") -> DataFrame:
    """Box and offset pixels of each mask: key, row0, row1, col0, col1 (inclusive)."""
    return px.groupBy(key).agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def mask_iou(a: DataFrame, b: DataFrame, key: str = "det_id") -> DataFrame:
    """IoU of the binary masks of equal keys, from their pixels; a pixel without a key or a place is in no other mask."""
    cell = [key, "row", "col"]
    side = lambda df, s: df.select(*cell, F.lit(s == "a").alias("_a"), F.lit(s == "b").alias("_b"))
    px = spread(side(a, "a").unionByName(side(b, "b")), key)  # both masks of a key meet in one task, once
    both = px.groupBy(*cell).agg((F.bool_or("_a") & F.bool_or("_b")).alias("_both"))
    whole = F.col(key).isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()
    hit = F.count_if(F.col("_both") & whole)
    return both.groupBy(key).agg((hit / (F.count("*") + F.count_if(F.col("_both") & ~whole))).alias("iou"))


def aligned_flavours(flavours: DataFrame, names: list[str], boxes: DataFrame, max_blowup: float = 4.0, key: str = "det_id") -> DataFrame:
    """Keys whose masks of all flavours are valid: (key, flavour, area, angle180) pivoted to one row per key.

    A flavour fails if its mask is missing, without an angle, or larger than max_blowup times the box's area.
    """
    checked = flavours.join(boxes.select(key, "box_area"), key)
    ok = F.col("angle180").isNotNull() & (F.col("area") <= max_blowup * F.col("box_area"))
    wide = checked.where(ok).groupBy(key).pivot("flavour", names).agg(F.first("angle180"))
    return wide.dropna(subset=names)


def first_failures(flavours: DataFrame, names: list[str], boxes: DataFrame, max_blowup: float = 4.0, key: str = "det_id") -> DataFrame:
    """How often each flavour, in the order given, is the first to fail: flavour, n."""
    order = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))
    spine = boxes.select(key, "box_area").withColumn("flavour", F.explode(F.array(*map(F.lit, names))))
    checked = spine.join(flavours, [key, "flavour"], "left")
    bad = checked.where(~F.coalesce(F.col("angle180").isNotNull() & (F.col("area") <= max_blowup * F.col("box_area")), F.lit(False)))
    return bad.groupBy(key).agg(F.min_by("flavour", order[F.col("flavour")]).alias("flavour")).groupBy("flavour").agg(F.count("*").alias("n"))


def rle_runs(df: DataFrame, key: str = "det_id") -> DataFrame:
    """Run-length counts (column by column, first run of zeros) to runs of ones: key, start, length; counts: ARRAY<INT>."""
    each = df.select(key, F.posexplode("counts").alias("i", "length"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0))).where((F.col("i") % 2 == 1) & (F.col("length") > 0)).select(key, "start", "length")


def rle_decode(df: DataFrame, key: str = "det_id") -> DataFrame:
    """mask_pixels of run-length counts; df: key, height, counts."""
    runs = rle_runs(df, key).join(df.select(key, "height"), key)
    at = runs.select(key, "height", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at"))
    return at.select(key, (F.col("at") % F.col("height")).cast("int").alias("row"), F.floor(F.col("at") / F.col("height")).cast("int").alias("col"), F.lit(1.0).alias("w"))


def rle_encode(px: DataFrame, sizes: DataFrame, key: str = "det_id") -> DataFrame:
    """Run-length counts of mask_pixels; sizes: key, height, width. Columns: key, counts."""
    at = px.join(sizes, key).select(key, (F.col("col").cast("long") * F.col("height") + F.col("row")).alias("at"), (F.col("height").cast("long") * F.col("width")).alias("n"))
    order = Window.partitionBy(key).orderBy("at")
    marked = at.withColumn("_run", F.col("at") - F.row_number().over(order))
    runs = marked.groupBy(key, "n", "_run").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    per = runs.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("r"))
    full = sizes.select(key, (F.col("height").cast("long") * F.col("width")).alias("n")).join(per.drop("n"), key, "left")
    r = F.coalesce("r", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    gaps = F.transform(r, lambda x, i: F.array(x["a"] - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(r, i)["b"] + 1), x["b"] - x["a"] + 1))
    tail = F.col("n") - F.when(F.size(r) == 0, F.lit(0)).otherwise(F.try_element_at(r, F.lit(-1))["b"] + 1)
    return full.select(key, F.concat(F.flatten(gaps), F.when(tail > 0, F.array(tail)).otherwise(F.array().cast("array<bigint>"))).alias("counts"))
